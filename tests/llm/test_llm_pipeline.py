"""The pipeline's stages one after the other, each against what it is to do with its own input."""

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from stockweave.llm import quality, tiling
from stockweave.llm.queries import table, vocabulary
from tests_llm_helpers import brute_lines, brute_near

SF = "/root/testdata/sf0.01"


def test_stages_and_their_contracts(spark):
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "piece encoding"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    steps = dict(C.STAGES)

    judged = quality.judge(docs.select("doc_id", quality.measures("text").alias("m")), "m")
    kept = {r["doc_id"] for r in judged.where("kept").collect()}
    docs = steps["quality rules"](spark, docs, SF).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == kept

    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    docs = steps["line dedup"](spark, docs, SF).cache()
    assert docs.columns == columns
    rows = docs.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {i: t for i, (_, _, t) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows if want[r["doc_id"]][1])

    want = brute_near([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    docs = steps["near duplicates"](spark, docs, SF).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == {i for i, (n, c) in want.items() if i == c or n == 0}

    index = tiling.Index([(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()], 5, 0.8)
    clean = {r["doc_id"] for r in docs.collect() if not index.hits(r["text"])}
    assert len(clean) < docs.count()
    docs = steps["decontamination"](spark, docs, SF).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == clean

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    coded = {r["doc_id"]: r for r in steps["piece encoding"](spark, docs, SF).collect()}
    for r in docs.collect():
        assert np.frombuffer(coded[r["doc_id"]]["ids"], "<u4").tolist() == library.encode(r["text"]) and coded[r["doc_id"]]["n_tokens"] == len(library.encode(r["text"]))


def test_run_on_empty_and_awkward_tables(spark, awkward, tmp_path):
    for name, docs in (("empty", awkward.limit(0)), ("awkward", awkward)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert C.run(spark, f"{tmp_path}/{name}").count() == 0


def test_clean_documents_come_through(spark, docs, tmp_path):
    clean = [(i, " ".join(f"word{i}x{k} stands here." for k in range(15))) for i in range(12)]
    docs(clean).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()} == set(range(12))
