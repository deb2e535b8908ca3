"""Folds of large groups against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import similarity
from graphloom.operators import resolve


def plain(texts, limit):
    acc = ""
    for d in texts:
        if d in acc:
            continue
        longer = d if acc == "" else f"{acc} | {d}"
        acc = longer if acc == "" or len(longer) <= limit else longer[: limit - 3] + "..."
    return acc


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_descriptions_fold_in_turns(spark, size):
    rng = random.Random(1)
    rows = [(rng.choice("abcd"), k, rng.choice(["T", None]), rng.choice([None, "", "x", "xy", "abc", "bc", f"text {rng.randrange(40)}", "long " * rng.randrange(9)])) for k in range(400)] + [("e", 1, "T", None), ("f", 1, "T", "w" * 300), ("f", 2, "T", "v")]
    found = resolve.merged_descriptions(spark.createDataFrame(rows, "name string, idx int, type string, description string").repartition(7), ["name"], "idx", limit=120, size=size)
    want = {n: plain([r[3] or "" for r in sorted(rows, key=lambda r: r[1]) if r[0] == n], 120) for n in "abcdef"}
    assert {r["name"]: r["description"] for r in found.collect()} == want


def test_a_cluster_of_many_members(spark):
    """Members come from many slices, in order."""
    n = 200_000
    rows = spark.range(n).select((n - F.col("id")).alias("idx"), F.lit("T").alias("type"), F.concat(F.lit("n"), F.col("id") % 1000).alias("name"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("d"), n - F.col("id"))).alias("description"), F.lit(1).alias("cluster"))
    rows = rows.unionByName(spark.createDataFrame([(-5, "T", "n999", " ", 2)], rows.schema))
    out = {r["cluster"]: r for r in resolve.canonical(rows).collect()}
    assert (out[1]["members"], out[1]["name"], out[1]["aliases"][:3]) == (n, "n999", ["n998", "n997", "n996"])
    assert out[1]["description"].split(" | ") == [f"d{k}" for k in range(100, n + 1, 100)]
    assert (out[2]["name"], out[2]["description"], out[2]["aliases"]) == ("n999", "No description available", [])


@pytest.mark.parametrize("weights", [similarity.Weights(), similarity.Weights(threshold=0.66), similarity.Weights(jaccard=0.5, containment=0.1, edit=0.3, acronym=0.1, threshold=0.52)])
def test_similar_pairs_are_those_of_all_pairs(spark, weights):
    """Blocking by rare tokens, sizes and places loses no pair; a token that most names have is no way round."""
    rng = random.Random(9)
    words = ["bank", "of", "north", "south", "first", "union", "trust", "city", "home", "warren", "state", "inc"]
    names = sorted({" ".join(["bank", *rng.sample(words, rng.randint(0, 4))]) + rng.choice(["", " Inc", ".", " ltd"]) for _ in range(120)} | {"Bank", "BANK of North", "warren home", "Warren State Home", "warren  home"})
    rows = spark.createDataFrame([(k, n, rng.choice(["ORG", "ORG", "PLACE", None])) for k, n in enumerate(names)], "idx int, name string, type string").withColumn("description", F.lit(""))
    assert weights.blocking_is_exact
    got = {(r["idx_a"], r["idx_b"], r["score"]) for r in resolve.similar_pairs(rows, weights).collect()}
    kind = resolve.entity_type(F.col("type"))
    a, b = (rows.select(kind.alias("type"), F.col("idx").alias(f"i_{x}"), F.col("name").alias(f"n_{x}")) for x in "ab")
    score = F.round(similarity.score(F.col("n_a"), F.col("n_b"), F.col("type"), F.col("type"), weights), 6)
    want = a.join(b, "type").filter("i_a < i_b").withColumn("score", score).filter(F.col("score") >= weights.threshold)
    assert got == {(r["i_a"], r["i_b"], r["score"]) for r in want.collect()} and len(got) > 1
