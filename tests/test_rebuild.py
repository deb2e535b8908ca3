"""Repeated extraction, and graphs after deletions against a build from what is left."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import gleaning, rebuild


def entity(name, text="d"):
    return f"entity<|#|>{name}<|#|>T<|#|>{text}"


def relation(a, b, text="d"):
    return f"relation<|#|>{a}<|#|>{b}<|#|>k<|#|>{text}"


def test_gleaning_stops_by_chunk(spark):
    answers = {
        "a": [entity("X", "short"), entity("x", "much longer") + "\n" + entity("Y"), entity("y") + "\n" + relation("X", "Y"), relation("x", "y", "a longer one"), entity("never")],
        "b": [entity("X"), None, entity("never")],
        "c": [entity("X"), entity("x", "a longer one without news is left out"), entity("never")],
        "d": ["nothing", entity("late"), entity("later"), entity("latest"), entity("beyond the passes")],
    }
    asked = []

    def ask(rows):
        k = len(asked) + 1
        asked.append({r["chunk_id"]: r["previous"] for r in rows.collect()})
        return spark.createDataFrame([(c, answers[c][k]) for c in asked[-1]], "chunk_id string, response string")

    first = spark.createDataFrame([(c, f"text {c}", x[0]) for c, x in answers.items()], "chunk_id string, content string, response string")
    entities, relations, passes = gleaning.glean(first, ask, 3)
    found = {(r["chunk_id"], r["name"].lower()): r["description"] for r in entities.collect()}
    assert found == {("a", "x"): "much longer", ("a", "y"): "d", ("b", "x"): "d", ("c", "x"): "d", ("d", "late"): "d", ("d", "later"): "d", ("d", "latest"): "d"}
    assert [(r["src"].lower(), r["tgt"].lower(), r["description"]) for r in relations.collect()] == [("x", "y", "d")]
    assert {r["chunk_id"]: r["passes"] for r in passes.collect()} == {"a": 2, "b": 0, "c": 0, "d": 3}
    assert [set(x) for x in asked] == [set("abcd"), {"a", "d"}, {"a", "d"}] and asked[1]["a"] == answers["a"][1]


def test_gleaning_without_passes_or_chunks(spark):
    none = spark.createDataFrame([], "chunk_id string, content string, response string")
    entities, relations, passes = gleaning.glean(none, lambda rows: rows.select("chunk_id", F.lit("").alias("response")), 2)
    assert entities.count() == relations.count() == passes.count() == 0
    one = spark.createDataFrame([("a", "t", entity("X")), ("b", None, None)], none.schema)
    assert gleaning.glean(one, None, 0)[0].count() == 1
    with pytest.raises(ValueError):
        gleaning.glean(one, None, -1)


def embed(rows):
    return rows.select("id", F.array(F.length("text").cast("double")).alias("vector"))


def contents(tables):
    return [sorted(map(str, t.select(sorted(t.columns)).collect())) for t in (tables.vertices, tables.edges, tables.vectors)]


@pytest.mark.parametrize("gone", [[], [3], [0, 1, 2, 3, 4], list(range(20)), [99, None]])
def test_deletion_equals_a_build_from_the_rest(spark, gone):
    rng = random.Random(1)
    names = ["Ann", "bob ", " Bob", "Carl", "Dora", "Eve", "F", "", None]
    e = [(f"c{rng.randrange(20)}", k, rng.choice(names), rng.choice(["P", "", None, "Q"]), rng.choice([None, "", f"text {k}"])) for k in range(60)] + [("c3", 100, "only", "P", "there"), (None, 101, "nobody", "P", "x")]
    r = [(f"c{rng.randrange(20)}", k, rng.choice(names), rng.choice(names), f"about {k}", rng.choice(["k1", "k2", None]), float(k)) for k in range(80)] + [("c5", 100, "only", "ann", "x", "k", 1.0), ("c6", 101, "ann", "unknown", "x", "k", 1.0)]
    frames = lambda keep: (
        spark.createDataFrame([(f"c{k}", f"chunk {k}") for k in range(20) if keep(f"c{k}")], "id string, text string"),
        spark.createDataFrame([x for x in e if keep(x[0])], "chunk_id string, seq int, name string, type string, description string"),
        spark.createDataFrame([x for x in r if keep(x[0])], "chunk_id string, seq int, src string, tgt string, description string, keywords string, weight double"),
    )
    dead = {None if k is None else f"c{k}" for k in gone}
    chunks, entities, relations = frames(lambda c: True)
    got = rebuild.without_chunks(rebuild.build(chunks, entities, relations, embed), spark.createDataFrame([(c,) for c in dead], "chunk_id string"), entities, relations, embed)
    assert contents(got) == contents(rebuild.build(*frames(lambda c: c is None or c not in dead), embed))


def test_vectors_of_merged_entities_go(spark):
    vertices = spark.createDataFrame([("ann", "P", "one | two", ["c1"]), ("carl", "P", "x", ["c1"])], "name string, type string, description string, source_chunk_ids array<string>")
    vectors = spark.createDataFrame([("entity", "ann", [1.0]), ("entity", "bob", [2.0]), ("entity", "carl", [3.0]), ("chunk", "bob", [4.0])], "kind string, id string, vector array<double>")
    out = rebuild.merged_vectors(vectors, vertices, spark.createDataFrame([(" Bob",)], "name string"), "Ann", embed)
    assert sorted(tuple(r) for r in out.collect()) == [("chunk", "bob", [4.0]), ("entity", "ann", [13.0]), ("entity", "carl", [3.0])]
