"""The document index and exact searches over it, beside brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentweave.operators import docindex, nearest

VECTOR = "vec_id long, embedding array<double>"


def clusters(n, dim=8, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dim))
    return middles[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, dim))


def brute(ids, m, query, k):
    """Angular distances in six digits, nearest first, ties by id."""
    size = np.linalg.norm(m, axis=1) * np.linalg.norm(query)
    cosine = np.divide(m @ query, size, out=np.zeros(len(m)), where=size > 0)
    far = np.round(np.sqrt(np.maximum(2 * (1 - cosine), 0)), 6)
    return sorted(zip(far.tolist(), ids, strict=True))[:k]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(r.distance, 6), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("kind,rows_per_cell", [("clusters", 50), ("gaussian", 50), ("clusters", 10_000), ("odd", 40)])
def test_searches_are_exact(spark, kind, rows_per_cell):
    m = clusters(1_500) if kind != "gaussian" else np.random.default_rng(2).normal(size=(1_500, 8))
    if kind == "odd":  # zeros, copies of one vector, and lengths far apart
        m[::7] = 0
        m[1::7] = m[1]
        m[2::7] *= 1e200
        m[3::7] *= 1e-200
    ids = list(range(0, 4_500, 3))
    vectors = spark.createDataFrame(list(zip(ids, m.tolist(), strict=True)), VECTOR)
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = found(nearest.nearest(vectors, queries, 7, rows_per_cell=rows_per_cell))
    scaled = m / np.maximum(np.abs(m).max(1, keepdims=True), 1e-300)
    assert got == {i: brute(ids, scaled, scaled[ids.index(i)], 7) for i in ids if i % 50 == 0}


def test_fewer_rows_than_asked_for_and_rows_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [float("inf"), 0.0]), (2, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, VECTOR)
    got = found(nearest.nearest(vectors, spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "query_id string, embedding array<double>"), 5))
    assert got == {"a": [(0.0, 1), (1.414214, 2), (1.414214, 2)]}
    assert nearest.nearest(vectors.limit(0), vectors.withColumnRenamed("vec_id", "query_id")).count() == 0
    assert nearest.nearest(vectors, vectors.limit(0).withColumnRenamed("vec_id", "query_id")).count() == 0
    with pytest.raises(ValueError):
        nearest.nearest(vectors, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"))


def test_cells_are_skipped(spark, monkeypatch):
    """On vectors that cluster a query visits few cells, and none twice."""
    seen = []
    real = nearest._searched
    monkeypatch.setattr(nearest, "_searched", lambda visits, placed, k: seen.append(visits.select("query_id", "cell").collect()) or real(visits, placed, k))
    m = clusters(3_000)
    vectors = spark.createDataFrame(list(enumerate(m.tolist())), VECTOR)
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    nearest.nearest(vectors, queries, 5, rows_per_cell=75).count()
    visits = [tuple(v) for some in seen for v in some]
    assert len(visits) == len(set(visits)) < 0.25 * 60 * 40


def test_a_batch_written_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    m = clusters(400, seed=3)
    files = spark.createDataFrame([(f"p{i}", "text" if i % 9 else " ", m[i].tolist() if i % 5 else None) for i in range(400)], "path string, text string, embedding array<double>")
    half = files.where("length(path) < 4")
    one = sorted(map(str, docindex.append_index(half, path, buckets=8).collect()))
    assert sorted(map(str, docindex.append_index(half.unionByName(half), path, buckets=8).collect())) == one and 80 < len(one) < 100
    whole = docindex.append_index(files, path, buckets=8).collect()
    assert sorted(r.path for r in whole) == sorted(f"p{i}" for i in range(400) if i % 9)
    assert all((r.embedding is None) == (int(r.path[1:]) % 5 == 0) for r in whole)
    assert docindex.append_index(files.drop("embedding"), path, buckets=8).count() == len(whole)
    assert len(list((tmp_path / "index").glob("bucket=*"))) == 8

    queries = files.where("embedding IS NOT NULL").limit(30).select(F.col("path").alias("query_id"), "embedding")
    stored = {r.doc_id: r for r in whole if r.embedding}
    ids, table = list(stored), np.array([stored[i].embedding for i in stored])
    got = found(docindex.search_index(spark, path, queries, 4).withColumnRenamed("doc_id", "vec_id"))
    asked = {r.query_id: brute(ids, table, np.array(r.embedding), 4) for r in queries.collect()}
    assert {q: [i for _, i in rows] for q, rows in got.items()} == {q: [i for _, i in rows] for q, rows in asked.items()}
    assert {(r.doc_id, r.path) for r in docindex.search_index(spark, path, queries, 4).collect()} <= {(i, stored[i].path) for i in ids}


def test_an_index_of_nothing(spark, tmp_path):
    queries = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>")
    assert docindex.search_index(spark, str(tmp_path / "none"), queries).count() == 0
    assert docindex.append_index(spark.createDataFrame([("p", " ")], "path string, text string"), str(tmp_path / "none")).count() == 0
