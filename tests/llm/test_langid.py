"""Language identification: held-out accuracy, calibration, determinism, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from stockweave.llm import langid as N
from stockweave.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op9_subword_language"](spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    sure = [r for r in held if r["accepted"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in sure) >= 0.98 * len(sure) and len(sure) > 0.8 * len(held)


def test_sample_is_bounded_and_leaves_the_held_out_fifth(spark, docs, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE_PER_LANG", 20)
    data = docs([(i, f"text {i}", "en" if i % 3 else "fr") for i in range(600)] + [(601, "no label", None), (602, None, "en")])
    sample = N.training_sample(data)
    assert 20 <= len(sample) <= 40 and {lang for _, lang in sample} == {"en", "fr"}
    assert all(zlib.crc32(t.split()[1].encode()) % 5 for t, _ in sample)


def test_training_is_deterministic_whatever_the_order():
    sample = [(f"the and of {k} thing", "en") for k in range(60)] + [(f"le la des {k} chose", "fr") for k in range(60)]
    a, b = N.train(sample), N.train(sample[::-1])
    assert np.array_equal(a.logits, b.logits) and a.accept == b.accept
    assert a.predict("the thing and the of")[0] == "en" and a.predict("la chose des le")[0] == "fr"


def test_chunks_do_not_change_subwords(monkeypatch):
    text = "some text with ünïcode " * 40
    whole = np.sort(np.concatenate(N.subwords(text)))
    monkeypatch.setattr(N, "CHUNK", 50)
    assert np.array_equal(whole, np.sort(np.concatenate(N.subwords(text))))


def test_edge_cases(spark, docs, awkward):
    nothing = N.train(N.training_sample(awkward.limit(0)))
    assert nothing.predict("abc") == ("und", 0.0)
    model = N.train(N.training_sample(docs([(i, "plain words here", "en") for i in range(40)])))
    found = awkward.select("doc_id", N.identify(awkward, model).alias("p")).collect()
    by = {r["doc_id"]: r["p"] for r in found}
    assert all((by[i]["lang"], by[i]["score"], by[i]["accepted"]) == ("und", 0.0, False) for i in (1, 2, 3))
    assert by[4]["lang"] == by[6]["lang"] == "en" and by[4]["score"] == 1.0
    assert not N.held_out(F.lit(None).cast("long")) is None


def test_predictions_equal_a_plain_mean_and_softmax():
    """Without the chunks: the mean of all subwords' logits, and a softmax in plain Python."""
    import math

    from stockweave.llm import langid as M

    def plain(model, text):
        raw, rows = (" " + text.lower() + " ").encode(), []
        for n in M.NGRAMS:
            for i in range(len(raw) - n + 1):
                code = n
                for byte in raw[i : i + n]:
                    code = (code * 0x01000193 ^ byte) % 2**32
                rows.append(((code * 0x9E3779B1) % 2**32) >> 16)
        z = [sum(float(model.logits[r, k]) for r in rows) / len(rows) for k in range(len(model.langs))]
        top = max(z)
        return model.langs[z.index(top)], 1 / sum(math.exp(v - top) for v in z)

    words = {"en": "the quick brown fox and the lazy dog", "de": "der schnelle braune fuchs und der hund", "fr": "le renard brun et rapide avec le chien"}
    model = M.train([(f"{w} {k}", lang) for lang, w in words.items() for k in range(40)])
    for text in [*words.values(), "the hund avec", "x", "Über den Wolken", "dog" * 40, "ab " * 2000]:
        lang, score = model.predict(text)
        assert (lang, round(score, 6)) == (plain(model, text)[0], round(plain(model, text)[1], 6))


def test_a_language_of_long_texts_only_is_learned(spark, docs):
    from stockweave.llm import langid as M

    rows = [(k, f"the cat and the dog {k} went over the hill", "en") for k in range(60)] + [(100 + k, "der hund und die katze gehen ueber den berg " * 400, "de") for k in range(60)]
    sample = M.training_sample(docs(rows))
    assert {lang for _, lang in sample} == {"en", "de"} and max(len(t) for t, _ in sample) == M.SAMPLE_CHARS
    model = M.train(sample)
    assert model.predict("die katze und der hund")[0] == "de" and model.predict("the dog and the cat")[0] == "en"
