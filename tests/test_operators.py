"""Graph, budget, merge and lifecycle operators on the small cases of the fixtures."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import budget, cache, export, graph, legacy, lifecycle, merge, modes, resolve, vectors
from graphloom.operators.components import components
from graphloom.plans.scratch import Scratch


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, f"{a} to {b}", "k", 1.0, ["c1"]) for a, b in pairs], "src string, tgt string, description string, keywords string, weight double, source_chunk_ids array<string>")


def vertices(spark, names):
    return spark.createDataFrame([(n, "T", f"about {n}", ["c1"]) for n in names], "name string, type string, description string, source_chunk_ids array<string>")


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_traversal_of_a_line(spark):
    e, v = edges(spark, [("a", "b"), ("b", "c")]), vertices(spark, "abc")
    for depth, n, m in ((2, 3, 2), (1, 2, 1), (0, 1, 0)):
        found, inner = graph.subgraph(v, e, "A", depth)
        assert (found.count(), inner.count()) == (n, m)
    assert graph.subgraph(v, e, "missing", 2)[0].count() == 0


def test_traversal_of_a_star_is_capped(spark):
    e, v = edges(spark, [("a", x) for x in "bcde"]), vertices(spark, "abcde")
    assert names(graph.subgraph(v, e, "a", 1, 3)[0]) == ["a", "b", "c"]


def test_shortest_path(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d")])
    assert [r["name"] for r in graph.shortest_path(e, "a", "d").orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert graph.shortest_path(e, "a", "zz").count() == 0
    assert graph.shortest_path(e, "a", "a").count() == 1


def test_degrees_count_a_loop_once(spark):
    e = edges(spark, [("a", "a"), ("a", "b")])
    assert {r["name"]: r["degree"] for r in graph.degrees(e, spark.createDataFrame([("a",), ("b",), ("z",)], "name string")).collect()} == {"a": 2, "b": 1, "z": 0}


def test_incident_edges_come_once(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "d")])
    assert graph.incident(e, spark.createDataFrame([("a",), ("b",)], "name string")).count() == 2


def test_components(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert found == {k: 0 for k in range(31)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_plans_stay_small(spark, monkeypatch):
    """Each plan of a round reads the edges at most twice, so what the driver keeps and describes is little."""
    reads, save = [], Scratch.save

    def counted(self, df, name):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", counted)
    assert components(spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "src long, dst long")).count() == 5
    assert 1 <= max(reads) <= 2


def items(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "query int, source_idx int, item_idx int, content string, tokens int")


def test_round_robin_of_three_sources(spark):
    rows = [(0, 1, "E1", 10), (0, 2, "E2", 10), (1, 1, "A->B", 10), (2, 1, "C1", 10), (2, 2, "C2", 10), (2, 3, "C3", 10)]
    out = budget.merged_context(items(spark, rows), ["query"], 10000).first()
    assert out["text"].split("\n\n") == ["E1", "A->B", "C1", "E2", "C2", "C3"]


def test_budget_passes_over_what_does_not_fit(spark):
    out = budget.merged_context(items(spark, [(0, 1, "a", 10), (0, 2, "b", 20), (0, 3, "c", 50)]), ["query"], 35).first()
    assert (out["included"], out["truncated"], out["total_tokens"]) == (2, 1, 31)
    out = budget.merged_context(items(spark, [(0, 1, "a", 10), (0, 2, "b", 50), (0, 3, "c", 5)]), ["query"], 20).first()
    assert out["text"] == "a\n\nc"


def test_budget_shares():
    assert budget.budgets(4000, 0.1, 0.4, 0.3) == {"chunk": 400, "entity": 1600, "relation": 1200}


def test_stored_vector_comes_first(spark):
    rows = []
    for i, base in enumerate((0.1, 0.5, 0.9)):
        v = [base + 0.001 * k * (i + 1) for k in range(16)]
        rows.append((i, [x / sum(y * y for y in v) ** 0.5 for x in v]))
    frame = spark.createDataFrame(rows, "id int, vector array<float>")
    first = vectors.top_k(frame, [float(x) for x in rows[1][1]], 1, "id", "vector").first()
    assert first["id"] == 1 and first["score"] > 0.9
    zero = spark.createDataFrame([(1, [0.0] * 16)], "id int, vector array<float>")
    assert vectors.top_k(zero, rows[0][1], 1, "id", "vector").first()["score"] == 0.0


def test_resolution_merges_name_variants(spark):
    frame = spark.createDataFrame([(1, "Warren State Home", "ORG", "a"), (2, "Warren State Home Inc", "ORG", "b"), (3, "Apple", "FRUIT", "c"), (4, "Apple", "ORG", ""), (5, "Warren State Home", "ORG", "a2")], "idx long, name string, type string, description string")
    out = {r["name"]: r for r in resolve.resolve(frame).collect() if r["type"] == "ORG"}
    assert out["Warren State Home Inc"]["description"] == "a | b | a2" and out["Warren State Home Inc"]["aliases"] == ["Warren State Home", "Warren State Home"]
    assert out["Apple"]["description"] == "No description available"
    stats = resolve.stats(resolve.clusters(frame)).first()
    assert (stats["original"], stats["resolved"], stats["clusters"]) == (5, 3, 1)
    blank = frame.withColumn("type", F.when(F.col("idx") == 3, "").otherwise(F.col("type")))
    assert resolve.resolve(blank, compat=True).count() == 5


def test_merge_redirects_drops_loops_and_adds_weights(spark):
    e = edges(spark, [("a", "x"), ("b", "x"), ("a", "b"), ("y", "b")])
    v, out, counts = merge.merge_entities(vertices(spark, "abxy"), e, ["b", "A "], "a")
    assert names(v) == ["a", "x", "y"]
    assert {(r["src"], r["tgt"]): r["weight"] for r in out.collect()} == {("a", "x"): 2.0, ("y", "a"): 1.0}
    assert counts == {"merged": 1, "redirected": 3, "deduplicated": 1}
    assert merge.merge_entities(vertices(spark, "ab"), e, ["A"], "a")[2]["merged"] == 0


def test_merged_text_strategies(spark):
    one = spark.createDataFrame([(["ab", "", "cde", "ab", "fgh"],)], "t array<string>")
    got = {s: one.select(merge.merged_text(F.col("t"), s)).first()[0] for s in ("CONCATENATE", "KEEP_FIRST", "KEEP_LONGEST")}
    assert got == {"CONCATENATE": "ab | cde | fgh", "KEEP_FIRST": "ab", "KEEP_LONGEST": "cde"}
    with pytest.raises(ValueError):
        merge.merged_text(F.col("t"), "NO")


def test_chunk_ids_are_capped(spark):
    one = spark.createDataFrame([([[f"c{k}" for k in range(40)], [f"c{k}" for k in range(30, 70)]],)], "t array<array<string>>")
    got = one.select(merge.merged_chunks(F.col("t"))).first()[0]
    assert len(got) == 50 and got[0] == "c20" and got[-1] == "c69"


def test_upserts_and_deletes(spark):
    v, e = vertices(spark, "ab"), edges(spark, [("a", "b")])
    new = spark.createDataFrame([(" A ", "N", "new", ["c2"], 1), ("a", "N", "newer", ["c2"], 2)], "name string, type string, description string, source_chunk_ids array<string>, seq int")
    assert {r["name"]: r["description"] for r in lifecycle.upsert_entities(v, new, "seq").collect()} == {"a": "newer", "b": "about b"}
    link = spark.createDataFrame([("b", "Z", "d", "k", 1.0, ["c1"], 1)], "src string, tgt string, description string, keywords string, weight double, source_chunk_ids array<string>, seq int")
    more, links = lifecycle.upsert_relations(v, e, link, "seq", auto_vertices=True)
    assert names(more) == ["a", "b", "z"] and links.count() == 2
    left, cut = lifecycle.delete_entities(v, e, spark.createDataFrame([("B",)], "name string"))
    assert names(left) == ["a"] and cut.count() == 0


def test_deleting_chunks_rebuilds(spark):
    v = spark.createDataFrame([("a", "T", "old", ["c1", "c2"]), ("b", "T", "gone", ["c1"]), ("c", "T", "stays", None)], "name string, type string, description string, source_chunk_ids array<string>")
    e = edges(spark, [("a", "b"), ("a", "c")]).withColumn("source_chunk_ids", F.array(F.lit("c2")))
    cached = spark.createDataFrame([("c1", 0, "a", "from c1"), ("c2", 0, "A", "from c2"), ("c2", 1, "a", "again")], "chunk_id string, seq int, name string, description string")
    left, cut = lifecycle.delete_chunks(v, e, F.array(F.lit("c1")), cached)
    assert {r["name"]: (r["description"], r["source_chunk_ids"]) for r in left.collect()} == {"a": ("from c2 | again", ["c2"]), "c": ("stays", None)}
    assert [(r["src"], r["tgt"]) for r in cut.collect()] == [("a", "c")]


def test_cache_keeps_its_first_id(spark):
    schema = "id string, project_id string, cache_type string, content_hash string, chunk_id string, result string, tokens_used int, seq int"
    old = spark.createDataFrame([("i1", "p", "SUMMARY", "h", "c1", "old", 1, 0)], schema)
    new = spark.createDataFrame([("i2", "p", "SUMMARY", "h", "c2", "new", 2, 1)], schema)
    row = cache.store(old, new, "seq").first()
    assert (row["id"], row["chunk_id"], row["result"]) == ("i1", "c1", "new")


def test_csv_export(spark):
    v = vertices(spark, ["a,b", 'q"']).withColumn("description", F.lit("x\ny"))
    out = export.export_csv(v, edges(spark, [("a", "b")]), export.ExportConfig(max_items=10))
    assert out.startswith("# ENTITIES\nname,type,description,source_chunk_count\n\"a,b\",T,\"x\ny\",1\n") and '"q"""' in out and "\n\n# RELATIONS\n" in out
    assert export.ExportConfig.parse(None) == "csv"
    with pytest.raises(ValueError):
        export.ExportConfig(batch_size=0)


def test_modes(spark):
    v = spark.createDataFrame([(k, [1.0, 0.1 * k], "chunk" if k % 2 else "entity", f"text {k}", f"E{k}") for k in range(8)], "id int, vector array<float>, type string, content string, name string")
    store = modes.Store(v, spark.createDataFrame([(f"e{k}", f"entity {k}") for k in range(8)], "name string, description string"), edges(spark, [("e0", "e2"), ("e2", "e4")]))
    for mode, has in (("NAIVE", "text"), ("LOCAL", "text"), ("GLOBAL", "entity"), ("HYBRID", "entity"), ("MIX", "entity")):
        out = modes.answer_context(store, [1.0, 0.0], modes.QueryParam(mode=mode, top_k=3, chunk_top_k=3))
        assert has in out.context.first()["text"]
        assert out.sources.count() > 0
    old = modes.answer_context(store, [1.0, 0.0], modes.QueryParam(mode="HYBRID", compat=True))
    assert old.sources.count() == 0
    assert modes.answer_context(store, [1.0, 0.0], modes.QueryParam(mode="BYPASS")).sources.count() == 0
    with pytest.raises(ValueError):
        modes.answer_context(store, [1.0], modes.QueryParam(mode="X"))


def test_summaries_reduce_in_groups(spark):
    rows = spark.createDataFrame([("k", i, f"d{i:02}") for i in range(12)] + [("one", 0, "alone")], "k string, i int, description string")
    out = {r["k"]: r["description"] for r in modes.summarize(rows, ["k"], "i", lambda parts: F.concat(F.lit("("), F.array_join(parts, "+"), F.lit(")"))).collect()}
    assert out["one"] == "alone"
    assert out["k"] == "((d00+d01+d02+d03+d04)+(d05+d06+d07+d08+d09)+(d10+d11))"


def test_summaries_of_many_rounds_run_each_round_once(spark):
    rows = spark.createDataFrame([(k, i, f"d{i:03}") for k in ("a", None) for i in range(300)], "k string, i int, description string")
    out = modes.summarize(rows, ["k"], "i", lambda parts: F.concat(F.lit("("), F.array_join(parts, "+"), F.lit(")")))
    found = {r["k"]: r["description"] for r in out.collect()}
    assert set(found) == {"a", None} and found["a"] == found[None] and found["a"].startswith("((((d000+d001+d002+d003+d004)+(d005") and found["a"].count("d") == 300
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_names_and_requests_of_exports():
    status = lambda *a: export.checked_request(*a)[0]
    assert export.export_name("00000012-00ab-4000", "Markdown") == "kg-export-00000012.md"
    assert [status(False, "csv"), status(True, "pdf"), status(True, None), status(True, "csv", False, False)] == [404, 400, 200, 400]


def test_only_the_context_comes_back_without_a_model(spark):
    v = spark.createDataFrame([(k, [1.0, 0.1 * k], "chunk", f"text {k}", f"E{k}") for k in range(8)], "id int, vector array<float>, type string, content string, name string")
    store = modes.Store(v, spark.createDataFrame([("e0", "entity 0")], "name string, description string"), edges(spark, [("e0", "e2")]))
    run = lambda model=None, **k: modes.answer(store, "Which parts?", [1.0, 0.0], modes.QueryParam(mode="NAIVE", chunk_top_k=3, **k), model)
    context, sources = run(only_context=True)
    prompt, _ = run()
    assert sources.count() == 3 and "Which parts?" not in context and context in prompt and "Which parts?" in prompt
    assert run(lambda p: f"{len(p)} characters")[0] == f"{len(prompt)} characters"


def test_layouts_and_failing_rerankers(spark):
    v = spark.createDataFrame([(k, [1.0, 0.1 * k], "chunk" if k % 2 else "entity", f"text {k}", f"e{k}") for k in range(8)], "id int, vector array<float>, type string, content string, name string")
    store = modes.Store(v, spark.createDataFrame([(f"e{k}", f"entity {k}") for k in range(8)], "name string, description string"), edges(spark, [("e0", "e2")]))
    text = lambda **k: modes.answer(store, "Which?", [1.0, 0.0], modes.QueryParam(mode="HYBRID", top_k=2, chunk_top_k=2, only_context=True, **k))[0]
    assert text(layout="grouped").index("### Entities\n- e0: entity 0\n") < text(layout="grouped").index("### Relations\n") < text(layout="grouped").index("### Sources\n- [1] text 1\n")
    assert text(layout="flat").startswith("[Source] [1] text 1\n\n[Entity] e0: entity 0\n\n")
    with pytest.raises(modes.StageError):
        text(layout="round")

    def late(hits):
        return hits.withColumn("score", F.raise_error(F.lit("the provider is down")).cast("double"))

    plain = [r["source_id"] for r in modes.answer(store, "Which?", [1.0, 0.0], modes.QueryParam(mode="NAIVE", chunk_top_k=2, only_context=True))[1].orderBy("item_idx").collect()]
    kept = [r["source_id"] for r in modes.answer(store, "Which?", [1.0, 0.0], modes.QueryParam(mode="NAIVE", chunk_top_k=2, rerank=True, only_context=True), rerank=late)[1].orderBy("item_idx").collect()]
    turned = [r["source_id"] for r in modes.answer(store, "Which?", [1.0, 0.0], modes.QueryParam(mode="NAIVE", chunk_top_k=2, rerank=True, only_context=True), rerank=lambda h: h.withColumn("score", -F.col("score")))[1].orderBy("item_idx").collect()]
    assert plain == kept == ["1", "3"] and turned == ["7", "5"]


def test_legacy_modes_without_hits_or_keywords(spark):
    none = spark.createDataFrame([], "id int, vector array<float>, type string, content string, name string")
    store = modes.Store(none, vertices(spark, "ab"), edges(spark, [("a", "b")]))
    embed = lambda text: [1.0, 0.0]
    for run in (legacy.local, legacy.global_, legacy.hybrid):
        out = run(store, "Who?", embed, modes.QueryParam())
        assert out.context.first()["text"] == "" and out.sources.count() == 0
    assert legacy.search_text("Who?", lambda q: ["x", "y"]) == ("Who? x y", ["x", "y"])
    assert legacy.search_text("Who?", lambda q: []) == legacy.search_text("Who?", lambda q: 1 / 0) == legacy.search_text("Who?", None) == ("Who?", [])
