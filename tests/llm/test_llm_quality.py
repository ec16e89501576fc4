"""Measures against a plain count, the label model on labelled documents, edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from stockweave.llm import quality
from stockweave.llm import quality as Q
from stockweave.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c d e f g h " * 3, "x " * 40, "one\none\n\none ", "é é|<> #\x0b$\x0c\r%", "a b c d e f g h i a b c d e f g h", " nbsp　 word"])
def test_measures_equal_plain_counts(text):
    assert quality.measure(text)[:5] == plain(text)


def test_query_on_documents_and_labels(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op3_label_model"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for i, r in rows.items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(texts[i])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    judged = [(labels[i], r["kept"]) for i, r in rows.items() if labels.get(i) is not None and not r["base_failed"]]
    clean, junk = [k for q, k in judged if q == 1], [k for q, k in judged if q == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.15 * len(junk)


def test_label_model_learns_whom_to_trust():
    counts = {"+++": 900, "++-": 20, "---": 60, "--+": 20}
    model = quality.fit_label_model(counts)
    odds = {p: model.prior + sum(w[c] for w, c in zip(model.weights, p)) for p in counts}
    assert odds["+++"] > 0 > odds["--+"] and odds["---"] < odds["--+"]
    assert quality.fit_label_model({}).weights == () and quality.fit_label_model({"..": 5}).prior == 0.0


def test_filter_keeps_columns_and_edge_cases(spark, docs, awkward):
    kept = quality.filter_documents(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == set()
    assert quality.filter_documents(awkward.limit(0)).collect() == []
    clean = [(i, " ".join(f"word{i}x{k} goes here." for k in range(12))) for i in range(30)]
    assert quality.filter_documents(docs(clean)).count() == 30
    measured = docs(clean).withColumn("m", quality.measures("text"))
    assert quality.judge(measured, "m").where(F.col("kept")).count() == 30


def test_clashing_columns_are_kept(spark, docs):
    from pyspark.sql import functions as F

    table = docs([(k, "one two three four five six seven eight nine ten " * 3 + f"word{k}.") for k in range(30)] + [(99, "short")])
    measured = table.select("doc_id", Q.measures("text").alias("m"), F.lit("mine").alias("kept"), F.lit(7).alias("P_good"))
    judged = Q.judge(measured, "m")
    row = judged.where("doc_id = 99").first()
    assert row["base_failed"] is True and row["kept"] is False and row["_kept"] == "mine" and row["_p_good"] == 7
