"""Traversal over stored adjacency and two-ended paths against a plain search."""

import random
import re
from collections import defaultdict

import pytest

from graphloom.operators import graph


def table(spark, pairs):
    return spark.createDataFrame(pairs, "src string, tgt string")


def around(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None:
            near[a].add(b)
            near[b].add(a)
    return near


def depths(near, start):
    found, last = {start: 0}, [start]
    while last:
        last = sorted({y for x in last for y in near[x]} - set(found))
        found |= {x: found_depth for found_depth in [max(found.values()) + 1] for x in last}
    return found


def path(near, source, target):
    depth = depths(near, source)
    if target not in depth:
        return []
    out = [target]
    while out[-1] != source:
        out.append(min(x for x in near[out[-1]] if depth.get(x) == depth[out[-1]] - 1))
    return out[::-1]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    out = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(75)] + [("hub", f"v{k}") for k in range(0, 60, 9)]
    return [*out, ("x", "y"), ("y", "z"), (None, "v1"), ("v2", None), ("v3", "v3"), ("v4", "v5"), ("v4", "v5")]


@pytest.mark.parametrize("stored", [False, True])
def test_paths_are_the_least_of_the_shortest(spark, pairs, stored):
    near, edges = around(pairs), table(spark, pairs)
    edges = graph.Adjacency(edges, 3) if stored else edges
    for source, target in (("v1", "v50"), ("v7", "v33"), ("x", "z"), ("x", "v1"), ("hub", "v12"), ("v1", "nobody")):
        got = [r["name"] for r in graph.shortest_path(edges, source, target).orderBy("step").collect()]
        assert got == path(near, source, target)
    long = path(near, "v1", "v50")
    assert graph.shortest_path(edges, "v1", "v50", len(long) - 1).count() == len(long) and graph.shortest_path(edges, "v1", "v50", len(long) - 2).count() == 0


def test_levels_of_hubs_in_slots(spark, pairs, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 3)
    near = graph.Adjacency(table(spark, pairs), 4)
    assert near.some_hubs and near.table.count() == sum(map(len, around(pairs).values()))
    for few in (256, 0):  # look-ups by literals, and joins
        monkeypatch.setattr(graph, "FEW_NAMES", few)
        found = {r["name"]: r["depth"] for r in graph.levels(near, spark.createDataFrame([("v1",)], "name string"), 9).collect()}
        assert found == {k: v for k, v in depths(around(pairs), "v1").items() if v <= 9}


def test_a_level_does_not_shuffle_the_edges(spark, pairs):
    near = graph.Adjacency(table(spark, pairs), 4)
    names = spark.createDataFrame([(f"v{k}",) for k in range(50)], "name string")
    plan = near.of(names)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 1  # of the names
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells what is pruned
    few = near.of(names.limit(1), 1)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 4" in few and "Exchange" not in few
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
