"""Registered corpus queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import langid, linededup, minhash, neighbours, ngram, pieces, pii, quality, sharding, tiling, tokens, turns, whitening
from stockweave.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from stockweave.session import cut_lineage
from stockweave.sources.files import scratch_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


FLEET = sharding.build_tree(regions=3, racks=2, shards=4)


@query("op1_shard_tree")
def op1_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on 24 shards and where a 25th would take them from; law ``key``."""
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"))
    placed = sharding.place(rows, F.col("doc_id"), FLEET)
    placed = sharding.place(placed, F.col("doc_id"), sharding.grow(FLEET), "grown_shard")
    slots = sharding.assign_slots(placed, ["doc_id", "text_crc32", "size"], docs.count())
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op2_boosted_spans")
def op2_boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base spans and the boosted trees' additions."""
    return pii.find(table(spark, sf_dir, "documents"))


@query("op3_label_model")
def op3_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule votes on every text and the documents that the label model keeps."""
    docs = table(spark, sf_dir, "documents")
    measured = cut_lineage(docs.select("doc_id", quality.measures("text").alias("m")))  # numbers only
    judged = quality.judge(measured, "m")
    numbers = [F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *numbers, "base_failed", "kept", "p_good")


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{LETTERS}', '{LETTERS.lower()}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(keeper <> doc_id, false) AS dropped FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op4_line_references", LINES_SQL)
def op4_line_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold, removed from all but the last of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = linededup.dedup_lines(docs)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", kept.alias("kept_sha256"))


@query("op5_suffix_pieces")
def op5_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's piece ids, their digest, and whether decoding gives the text back."""
    docs, path = table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    coded = docs.select("doc_id", pieces.digest(F.col("text"), path).alias("p"))
    return coded.select("doc_id", "p.n_tokens", "p.ids_crc32", "p.round_trip")


@query("op6_string_tiling")
def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that their tiles cover by 80 % or more."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SCORE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'),
                                                         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w),
c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w),
d1 AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY doc_id, w),
c2 AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w),
d2 AS (SELECT doc_id, v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY doc_id, v, w),
s AS (SELECT b.doc_id, coalesce(c2.n - d2.n, 0) AS n2, c1.n - d1.n AS n1, cv.n - dv.n AS nv
      FROM b JOIN c1 ON c1.w = b.w JOIN d1 ON d1.doc_id = b.doc_id AND d1.w = b.w
      LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN d2 ON d2.doc_id = b.doc_id AND d2.v = b.v AND d2.w = b.w
      LEFT JOIN c1 cv ON cv.w = b.v LEFT JOIN d1 dv ON dv.doc_id = b.doc_id AND dv.w = b.v),
t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE n2 <= 0) AS n_without_context,
             sum(CAST(round(1e6 * CASE WHEN n2 > 0 THEN ln(n2 / nv)
                                      ELSE ln(greatest(n1, 0.5) / (SELECT count(*) FROM w)) + ln(0.4) END) AS BIGINT)) AS score
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_without_context, 0) AS n_without_context,
       CAST(coalesce(score, 0) AS BIGINT) AS score_micro
FROM d LEFT JOIN t USING (doc_id)
"""


TRIGRAM_SCORE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'),
                                                         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT *, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w),
d1 AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY doc_id, w),
c2 AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w),
d2 AS (SELECT doc_id, v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY doc_id, v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM b WHERE u IS NOT NULL GROUP BY u, v, w),
d3 AS (SELECT doc_id, u, v, w, count(*) AS n FROM b WHERE u IS NOT NULL GROUP BY doc_id, u, v, w),
s AS (SELECT b.doc_id, coalesce(c3.n - d3.n, 0) AS n3, coalesce(c2.n - d2.n, 0) AS n2, c1.n - d1.n AS n1, cv.n - dv.n AS nv, cu.n - du.n AS nu
      FROM b JOIN c1 ON c1.w = b.w JOIN d1 ON d1.doc_id = b.doc_id AND d1.w = b.w
      LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN d2 ON d2.doc_id = b.doc_id AND d2.v = b.v AND d2.w = b.w
      LEFT JOIN c3 ON c3.u = b.u AND c3.v = b.v AND c3.w = b.w
      LEFT JOIN d3 ON d3.doc_id = b.doc_id AND d3.u = b.u AND d3.v = b.v AND d3.w = b.w
      LEFT JOIN c1 cv ON cv.w = b.v LEFT JOIN d1 dv ON dv.doc_id = b.doc_id AND dv.w = b.v
      LEFT JOIN c2 cu ON cu.v = b.u AND cu.w = b.v LEFT JOIN d2 du ON du.doc_id = b.doc_id AND du.v = b.u AND du.w = b.v),
t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE n3 <= 0 AND n2 <= 0) AS n_without_context,
             sum(CAST(round(1e6 * CASE WHEN n3 > 0 THEN ln(n3 / nu)
                                      WHEN n2 > 0 THEN ln(n2 / nv) + ln(0.4)
                                      ELSE ln(greatest(n1, 0.5) / (SELECT count(*) FROM w)) + 2 * ln(0.4) END) AS BIGINT)) AS score
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_without_context, 0) AS n_without_context,
       CAST(coalesce(score, 0) AS BIGINT) AS score_micro
FROM d LEFT JOIN t USING (doc_id)
"""


@query("op7_stupid_backoff_trigrams", TRIGRAM_SCORE_SQL)
def op7_stupid_backoff_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the counts of all other documents, with contexts of two words and of one."""
    return ngram.score_documents(table(spark, sf_dir, "documents"), order=3)


@query("op7_stupid_backoff", SCORE_SQL)
def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with contexts of one word only."""
    return ngram.score_documents(table(spark, sf_dir, "documents"), order=2)


NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'),
                                                              '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS gs FROM d),
x0 AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM g),
x AS (SELECT doc_id, n, hash(g) AS h, g FROM x0),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT g.doc_id, len(gs) AS n_shingles, min(other) AS component_id, g.doc_id = min(other) AS kept
FROM g JOIN reach USING (doc_id) GROUP BY g.doc_id, gs
"""


@query("op8_minhash_components", NEAR_SQL)
def op8_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingle sets are similar by 80 % or more."""
    docs = table(spark, sf_dir, "documents")
    found = minhash.near_duplicates(docs, size=4, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query("op9_subword_language")
def op9_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every text, learned from the other four fifths' labels."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.training_sample(docs))
    named = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), langid.identify(docs, model).alias("p"))
    return named.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.accepted").alias("accepted"))


@query("op10_token_frames")
def op10_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back."""
    docs = table(spark, sf_dir, "documents")
    manifest = tokens.write_token_files(docs, scratch_path(spark, "token-files"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokens.read_token_files(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", tokens.ids_digest)


@query("op11_cholesky_whitening")
def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components, with the model's explained variance and measured error."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_turn_alignment")
def op12_turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the damaged conversations and the cheapest edits that repair them."""
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")), F.col("here"))


@query("op13_bin_tree_neighbours")
def op13_bin_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
