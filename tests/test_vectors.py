"""Nearest vectors: blocks, one dimension, and the index against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import vector_index, vectors


def frame(spark, x, names=("id", "vector")):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], f"{names[0]} long, {names[1]} array<double>").repartition(5)


def exact(x, q, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(x).T, 6)
    return {i: sorted(range(len(x)), key=lambda j: (-scores[i, j], j))[:k] for i in range(len(q))}


def ranked(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_any_number_of_queries_in_one_plan(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 50)
    rng = np.random.default_rng(1)
    x, q = np.round(rng.standard_normal((700, 6)), 1), np.round(rng.standard_normal((101, 6)), 1)
    x[30:60] = x[0]  # ties are in order of the id
    found = vectors.top_k_batch(frame(spark, x), frame(spark, q, ("query_id", "probe")), 4, groups=3)
    assert ranked(found) == exact(x, q, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2


def test_odd_tables_and_dimensions(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, probe array<double>")
    assert vectors.top_k_batch(none, asked, 3).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id long, vector array<double>")
    assert ranked(vectors.top_k_batch(some, asked, 3)) == {1: [1, 3]}
    assert [r["id"] for r in vectors.top_k(some, [1.0, 0.0], 5, "id", "vector").collect()] == [1, 3]
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, vector array<double>")
    for run in (lambda: vectors.top_k_batch(mixed, asked, 3).collect(), lambda: vectors.top_k(mixed, [1.0, 0.0], 3, "id", "vector").collect(), lambda: vector_index.build(mixed, "/tmp/never")):
        with pytest.raises(Exception, match="vectors differ in dimension"):
            run()


@pytest.mark.parametrize("kind", ["clusters", "noise", "one cell"])
def test_index_recall(spark, tmp_path, kind):
    """Recall at 10 against the exact scan on clustered and on unstructured vectors, and with most rows in one cell."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 32))
    if kind == "clusters":
        x = x * 0.3 + rng.standard_normal((60, 32))[rng.integers(60, size=3000)]
    if kind == "one cell":
        x[:2000] = x[0] + 0.01 * x[:2000]
    q = x[::50] + 0.05 * rng.standard_normal((60, 32))
    index = vector_index.build(frame(spark, x), str(tmp_path / "index"))
    assert index.blocks.select(F.sum(F.size("ids"))).first()[0] == 3000
    found, want = ranked(index.search(frame(spark, q, ("query_id", "probe")), 10)), exact(x, q, 10)
    assert all(len(v) == 10 for v in found.values())
    assert sum(len(set(found[k]) & set(v)) for k, v in want.items()) >= 0.9 * 10 * len(want)
    if kind == "clusters":
        assert index.model.probes < len(index.model.cells)
        read = index.blocks.filter("cell = 3")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(cell" in read


def test_index_search_shuffles_no_candidates(spark, tmp_path):
    """All rows ask for their nearest: themselves; a task gives the best of each query only, whatever it looked at."""
    x = np.random.default_rng(3).standard_normal((4000, 16))
    index = vector_index.build(frame(spark, x), str(tmp_path / "index"))
    found = index.search(frame(spark, x, ("query_id", "probe")), 1)
    assert {(r["query_id"], r["id"], r["score"]) for r in found.collect()} == {(k, k, 1.0) for k in range(4000)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_batch_search_copies_no_queries(spark):
    """Blocks meet without an exchange before them, for any number of shuffle partitions."""
    x = np.random.default_rng(5).standard_normal((300, 8))
    found = vectors.top_k_batch(frame(spark, x), frame(spark, x[::20], ("query_id", "probe")), 5)
    assert ranked(found) == exact(x, x[::20], 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" in plan and "explode" not in plan


def test_index_of_nothing(spark, tmp_path):
    index = vector_index.build(spark.createDataFrame([], "id long, vector array<double>"), str(tmp_path / "index"))
    assert index.search(spark.createDataFrame([], "query_id long, probe array<double>"), 3).count() == 0
