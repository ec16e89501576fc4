import numpy as np
import pytest
from pyspark.sql import functions as F
from stockweave.llm import whitening
from stockweave.llm.queries import op11_cholesky_whitening

SF = "/root/testdata/sf0.001"


def exact(vectors):
    """Integers, counts, sums and covariance in plain numpy."""
    x = np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    return x, n, s, centred.T @ centred / n, centred


def check(rows, ids, vectors, limit=32):
    x, n, s, cov, centred = exact(vectors)
    values = np.linalg.eigvalsh(cov)[::-1]
    rank = int((values > values[0] * 1e-12).sum()) if values[0] > 0 else 0
    k = min(limit, rank)
    assert len(rows) == len(ids) * k
    deviation = {i: int(((n * row.astype(object) - s) ** 2).sum()) for i, row in zip(ids, x)}
    w = {i: np.zeros(k) for i in ids}
    for r in rows:
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        assert r["identity_error"] < 1e-8
        w[r["vec_id"]][r["component"] - 1] = r["whitened"]
    white = np.array([w[i] for i in ids])
    assert np.abs(np.cov(white.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-8
    # the projections are those on unit eigenvectors: the components recovered from them satisfy V c = e c
    components = np.linalg.lstsq(centred, white * np.sqrt(values[:k]), rcond=None)[0]
    assert np.abs(cov @ components - components * values[:k]).max() < 1e-6 * values[0]


def test_query_equals_numpy_on_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    check(op11_cholesky_whitening(spark, SF).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_cholesky_and_jacobi_agree_with_eigh():
    rng = np.random.default_rng(3)
    for d, r in ((1, 1), (2, 2), (7, 7), (8, 3), (33, 20)):
        a = rng.normal(size=(d, r)) * 10.0 ** rng.integers(-3, 3, r)
        a = a @ a.T
        factor = whitening.pivoted_cholesky(a)
        assert np.allclose(factor @ factor.T, a, atol=1e-9 * a.max()) and factor.shape[1] <= d
        turned = whitening.one_sided_jacobi(factor)
        norms = np.sort((turned**2).sum(axis=0))[::-1]
        assert np.allclose(norms[: len(norms)], np.linalg.eigvalsh(a)[::-1][: len(norms)], atol=1e-9 * a.max())
        gram = turned.T @ turned
        size = np.sqrt(np.outer(np.diag(gram), np.diag(gram)))
        assert np.abs(gram / size - np.eye(len(norms))).max() < 1e-12


def test_nulls_other_lengths_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(None, [5.0, 1.0, 2.0]), (7, [0.5, 0.25, 0.125])]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 0.0, 0.0]), (94, [1.0]), (95, []), (96, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit("x") for c in ("component", "n", "whitened", "_vector", "v")})
    rows = whitening.whiten(df).collect()
    x, n, s, cov, _ = exact([v for _, v in good])
    assert len(rows) == 42 * 3 and {r["n"] for r in rows} == {42}
    by_id = {i: int(((n * a.astype(object) - s) ** 2).sum()) for (i, _), a in zip(good[:40], x)}
    assert all(r["deviation"] == by_id[r["vec_id"]] for r in rows if r["vec_id"] not in (None, 7))


def test_repeated_rows_and_linear_dependence(spark):
    rng = np.random.default_rng(6)
    base = (np.round(rng.normal(size=(60, 2)) * 64) / 64).tolist()
    rows = [(i, [a, b, a + b, 3.0]) for i, (a, b) in enumerate(base)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(out, [i for i, _ in rows], [v for _, v in rows])


def test_no_variance_no_rows(spark):
    shape = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        out = whitening.whiten(spark.createDataFrame(rows, shape))
        assert out.collect() == []
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [1e12, 1.0]), (2, [-1e12, 2.0]), (3, [0.0, 3.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert out and all(r["deviation"] is None for r in out if r["vec_id"] != 3)
    assert all(r["deviation"] == (3 * 192 - 6 * 64) ** 2 for r in out if r["vec_id"] == 3)
