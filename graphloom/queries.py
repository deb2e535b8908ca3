"""Checked queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import code, extraction, html, similarity
from .functions import text as T
from .operators import budget, cache, chunking, export, gleaning, graph, legacy, lifecycle, lookups, merge, modes, rebuild, resolve, tenants, vector_index, vectors
from .plans.scratch import Scratch
from .sources.driver import ENTITIES_SQL, RELATIONS_SQL, entities, read
from .sources.driver import stored_adjacency as adjacency
from .sources.driver import stored_relations as relations
from .sources.driver import vectors as stored_vectors
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL if there is any."""

    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


def probe_of(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """One stored vector as a query: one row."""
    row = read(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


def stored_index(spark: SparkSession, d: str) -> vector_index.Index:
    """The index of all vectors, built once a session and folder."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        scratch = Scratch(spark, "vector-index")
        _INDEXES[key] = vector_index.build(stored_vectors(spark, d), f"{scratch.path}/cells")
        scratch.tables.add("cells")
    return _INDEXES[key]


_INDEXES: dict[tuple[str, str], vector_index.Index] = {}


# --- vectors -------------------------------------------------------------------------------------------------------

PROBE = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
TYPED = "t AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, CASE WHEN label % 2 = 0 THEN 'chunk' ELSE 'entity' END AS type, label AS project_id FROM embeddings)"


@query("vector_topk", f"WITH {PROBE} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return vectors.top_k(read(spark, d, "embeddings"), probe_of(spark, d), 10, "vec_id", "embedding")


@query("vector_topk_filtered", f"WITH {PROBE}, {TYPED} SELECT id, round(list_cosine_similarity(t.v, q.v), 6) AS score FROM t, q WHERE type = 'chunk' AND project_id = 2 ORDER BY score DESC, id LIMIT 10")
def vector_topk_filtered(spark, d):
    return vectors.top_k(vectors.filtered(stored_vectors(spark, d), "chunk", project=2), probe_of(spark, d), 10, "id", "vector")


@query("vector_topk_ids", f"WITH {PROBE} SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q WHERE vec_id IN (1, 5, 9, 13, 400) ORDER BY score DESC, id LIMIT 3")
def vector_topk_ids(spark, d):
    return vectors.top_k(vectors.filtered(stored_vectors(spark, d), ids=[1, 5, 9, 13, 400]), probe_of(spark, d), 3, "id", "vector")


@query("vector_topk_per_label", f"WITH {PROBE}, s AS (SELECT label AS project_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT project_id, id, score, rank FROM r WHERE rank <= 3")
def vector_topk_per_label(spark, d):
    return vectors.top_k_by_group(stored_vectors(spark, d), probe_of(spark, d), 3, "project_id")


@query("vector_topk_batch", "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 5")
def vector_topk_batch(spark, d):
    queries = read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))
    return vectors.top_k_batch(stored_vectors(spark, d), queries, 5)


@query("vector_index_self", "SELECT vec_id AS query_id, vec_id AS id, 1.0::DOUBLE AS score FROM embeddings")
def vector_index_self(spark, d):
    """Every stored vector is found as its own nearest, so every row is in the index."""
    queries = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))
    return stored_index(spark, d).search(queries, 1).select("query_id", "id", "score")


@query("vector_index_recall", "WITH s AS (SELECT q.vec_id AS query_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) SELECT count(DISTINCT query_id) AS queries, count(*) AS found, true AS scores_are_exact, true AS recall_is_reached FROM s WHERE r <= 10")
def vector_index_recall(spark, d):
    """What the index finds against the exact scan: rows, their scores, and the share that is the same."""
    queries = read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))
    found = stored_index(spark, d).search(queries, 10)
    scores = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(found, "id").join(queries, "query_id")
    scores = scores.select("query_id", "id", (F.abs(vectors.cosine(F.col("embedding"), F.col("probe")) - F.col("score")) < 1e-6).alias("same"))
    exact = vectors.top_k_batch(stored_vectors(spark, d), queries, 10).select("query_id", "id", F.lit(1).alias("hit"))
    return scores.join(exact, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("found"), F.every("same").alias("scores_are_exact"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_is_reached"))


@query("euclidean_topk", f"WITH {PROBE} SELECT vec_id, round(list_distance(embedding::DOUBLE[], q.v), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10")
def euclidean_topk(spark, d):
    dist = F.round(vectors.euclidean(F.col("embedding"), vectors.as_vector(probe_of(spark, d))), 6)
    return read(spark, d, "embeddings").select("vec_id", dist.alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("vector_dimension_cut", "SELECT vec_id, len(embedding[1:16]) AS dimension, round(list_sum(embedding[1:16]::DOUBLE[]), 4) AS total FROM embeddings")
def vector_dimension_cut(spark, d):
    cut = vectors.cut_dimension(F.col("embedding"), 16)
    return read(spark, d, "embeddings").select("vec_id", F.size(cut).cast("long").alias("dimension"), F.round(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("vector_counts", f"WITH {TYPED} SELECT project_id, type, count(*) AS n FROM t GROUP BY ALL")
def vector_counts(spark, d):
    return lookups.counts(stored_vectors(spark, d), "project_id", "type")


@query(
    "weighted_chunks",
    f"""WITH {PROBE}, h AS (SELECT e.vec_id AS id, doc.text AS content, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS score FROM embeddings e JOIN documents doc ON doc.doc_id = e.vec_id, q ORDER BY score DESC, id LIMIT 20),
    b AS (SELECT *, (CASE WHEN list_contains([0, 3, 9], id) THEN 0.3 ELSE 0.0 END) + (CASE WHEN contains(lower(content), 'thing') THEN 0.15 ELSE 0.0 END) + (CASE WHEN contains(lower(content), 'apache') OR contains(lower(content), 'version') THEN 0.2 ELSE 0.0 END) AS boost FROM h)
    SELECT id, round(score * (1 + boost), 6) AS weighted FROM b ORDER BY weighted DESC, id LIMIT 10""",
)
def weighted_chunks(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    hits = vectors.top_k(read(spark, d, "embeddings").join(docs, F.col("vec_id") == docs["id"], "left_semi"), probe_of(spark, d), 20, "vec_id", "embedding").withColumnRenamed("vec_id", "id").join(docs, "id")
    words = lambda *w: F.array(*map(F.lit, w))
    out = vectors.weighted(hits, words(0, 3, 9), words("Thing"), words("apache", "version"))
    return out.select("id", "weighted").orderBy(F.desc("weighted"), "id").limit(10)


@query(
    "weighted_by_entities",
    f"""WITH {PROBE}, {ENTITIES_SQL}, f AS (SELECT name, list_transform(source_chunk_ids, lambda c: substr(c, 2)) AS chunks FROM entities WHERE type = 'SUPPLIER' UNION ALL SELECT 'that' AS name, CAST([] AS VARCHAR[])),
    h AS (SELECT e.vec_id AS id, doc.text AS content, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS score FROM embeddings e JOIN documents doc ON doc.doc_id = e.vec_id, q ORDER BY score DESC, id LIMIT 40),
    b AS (SELECT *, (CASE WHEN id::VARCHAR IN (SELECT unnest(chunks) FROM f) THEN 0.3 ELSE 0.0 END) + (CASE WHEN EXISTS (SELECT 1 FROM f WHERE contains(lower(content), lower(f.name))) THEN 0.15 ELSE 0.0 END) + (CASE WHEN contains(lower(content), 'version') THEN 0.2 ELSE 0.0 END) AS boost FROM h)
    SELECT id, round(boost, 6)::DOUBLE AS boost, round(score * (1 + boost), 6) AS weighted FROM b""",
)
def weighted_by_entities(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(docs, "id")
    hits = vectors.top_k(rows, probe_of(spark, d), 40, "id", "embedding", ["content"])
    found = entities(spark, d).filter("type = 'SUPPLIER'").select("name", F.transform("source_chunk_ids", lambda c: F.regexp_replace(c, "^c", "")).alias("source_chunk_ids"))
    found = found.unionByName(spark.createDataFrame([("That", [])], "name string, source_chunk_ids array<string>"))
    return vectors.weighted_by(hits, found, F.array(F.lit("Version"))).select("id", F.round("boost", 6).alias("boost"), "weighted")


# --- ranking and budgets -------------------------------------------------------------------------------------------

TURNS = "c AS (SELECT conv_id, turn, role, text, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens FROM conversations)"


def turns(spark, d):
    return read(spark, d, "conversations").withColumn("tokens", T.token_estimate(F.col("text")))


@query("rerank_passthrough", "SELECT conv_id, turn, CAST(row_number() OVER w AS INTEGER) AS rank, round(greatest(0.1, 1 - 0.05 * (row_number() OVER w - 1)), 6) AS score FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def rerank_passthrough(spark, d):
    return budget.passthrough(read(spark, d, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "rank", "score")


@query("rerank_minscore", "WITH s AS (SELECT conv_id, turn, round((length(text) % 100) / 100.0, 6) AS s FROM conversations) SELECT conv_id, turn, s, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS INTEGER) AS new_rank, turn - row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS rank_change FROM s WHERE s >= 0.1")
def rerank_minscore(spark, d):
    scored = read(spark, d, "conversations").select("conv_id", "turn", F.round((F.length("text") % 100) / 100.0, 6).alias("s"))
    return budget.reranked(scored, ["conv_id"], "s", "turn")


@query("budget_prefix", f"WITH {TURNS}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM c) SELECT conv_id, turn, CAST(running AS BIGINT) AS running FROM r WHERE running <= 400")
def budget_prefix(spark, d):
    return budget.prefix_within(turns(spark, d), ["conv_id"], ["turn"], 400).select("conv_id", "turn", "running")


@query("budget_capacity", f"WITH {TURNS}, r AS (SELECT conv_id, sum(tokens) OVER w + row_number() OVER w - 1 AS cost FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, count(*) FILTER (WHERE cost <= 400) AS capacity FROM r GROUP BY conv_id")
def budget_capacity(spark, d):
    return budget.capacity(turns(spark, d), ["conv_id"], ["turn"], 400)


LISTS = f"{TURNS}, l AS (SELECT conv_id, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS source_idx, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS item_idx, text AS content, tokens FROM c)"


def ranked_lists(spark, d):
    source = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return turns(spark, d).select("conv_id", source.alias("source_idx"), place.alias("item_idx"), F.col("text").alias("content"), "tokens")


@query("round_robin_order", f"WITH {LISTS} SELECT conv_id, item_idx, source_idx, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY item_idx, source_idx) AS INTEGER) AS place FROM l")
def round_robin_order(spark, d):
    return budget.interleaved(ranked_lists(spark, d), ["conv_id"]).select("conv_id", "item_idx", "source_idx", "place")


@query(
    "round_robin_budget",
    f"""WITH RECURSIVE {LISTS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY item_idx, source_idx) AS p FROM l),
    f AS (SELECT conv_id, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS used, 0 AS n, 0 AS skipped FROM (SELECT DISTINCT conv_id FROM o)
      UNION ALL SELECT f.conv_id, o.p, CASE WHEN f.used + o.tokens + (f.n > 0)::INT <= 300 THEN f.used + o.tokens + (f.n > 0)::INT ELSE f.used END,
        f.n + (f.used + o.tokens + (f.n > 0)::INT <= 300)::INT, f.skipped + (f.used + o.tokens + (f.n > 0)::INT > 300)::INT FROM f JOIN o ON o.conv_id = f.conv_id AND o.p = f.p + 1)
    SELECT conv_id, arg_max(n, p) AS included, arg_max(skipped, p) AS truncated, arg_max(used, p) AS total_tokens FROM f GROUP BY conv_id""",
)
def round_robin_budget(spark, d):
    return budget.merged_context(ranked_lists(spark, d), ["conv_id"], 300).drop("text")


# --- names ---------------------------------------------------------------------------------------------------------

NORM = "trim(regexp_replace(lower(regexp_replace({0}, '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+', ' ', 'g'))"
NAMES = f"names AS (SELECT DISTINCT p_name AS name, {NORM.format('p_name')} AS n, list_distinct(list_filter(string_split({NORM.format('p_name')}, ' '), lambda x: x <> '')) AS t FROM part)"


def name_pairs(spark, d):
    names = read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    tokens = names.withColumn("token", F.explode(T.token_set(F.col("name"))))
    return tokens.withColumnRenamed("name", "a").join(tokens.withColumnRenamed("name", "b"), "token").filter("a < b").select("a", "b").distinct()


PAIRS = f"{NAMES}, p AS (SELECT x.name AS a, y.name AS b, x.n AS na, y.n AS nb, x.t AS ta, y.t AS tb FROM names x JOIN names y ON x.name < y.name WHERE list_has_any(x.t, y.t))"


@query("normalize_names", f"SELECT doc_id, md5({NORM.format('text')}) AS digest FROM documents")
def normalize_names(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.normal_name(F.col("text"))).alias("digest"))


@query("token_jaccard_pairs", f"WITH {PAIRS} SELECT a, b, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS jaccard FROM p")
def token_jaccard_pairs(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(T.jaccard(T.token_set(F.col("a")), T.token_set(F.col("b"))), 6).alias("jaccard"))


@query("containment_pairs", f"WITH {PAIRS} SELECT a, b, CASE WHEN contains(na, nb) OR contains(nb, na) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS containment FROM p")
def containment_pairs(spark, d):
    return name_pairs(spark, d).select("a", "b", T.containment(T.normal_name(F.col("a")), T.normal_name(F.col("b"))).alias("containment"))


@query("edit_similarity_pairs", f"WITH {PAIRS} SELECT a, b, round(CASE WHEN na = nb THEN 1.0 ELSE 1 - levenshtein(na, nb) / greatest(length(na), length(nb)) END, 6) AS similarity FROM p")
def edit_similarity_pairs(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(T.edit_similarity(T.normal_name(F.col("a")), T.normal_name(F.col("b"))), 6).alias("similarity"))


@query("acronym_flag", f"WITH {NAMES} SELECT name, array_to_string(list_transform(list_filter(string_split(n, ' '), lambda w: w <> '' AND NOT list_contains(['a','an','the','of','and','or','for','in','on','at','to','from'], w)), lambda w: w[1:1]), '') AS initials FROM names")
def acronym_flag(spark, d):
    names = read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", T.initials(T.normal_name(F.col("name"))).alias("initials"))


SCORE = """s AS (SELECT a, b, CASE WHEN (least(length(a), length(b)) > 10 AND greatest(length(a), length(b)) > 5 * least(length(a), length(b)))
      OR NOT ((length(a) <= 10 AND NOT contains(lower(a), ' ')) OR (length(b) <= 10 AND NOT contains(lower(b), ' '))
        OR (length(string_split(lower(a), ' ')[1]) >= 2 AND length(string_split(lower(b), ' ')[1]) >= 2 AND string_split(lower(a), ' ')[1][1:2] = string_split(lower(b), ' ')[1][1:2])
        OR len(list_filter(string_split(string_split(lower(a), ' ')[1], ''), lambda c: contains(string_split(lower(b), ' ')[1], c))) > length(string_split(lower(a), ' ')[1]) // 2) THEN 0.0
      ELSE 0.35 * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) + 0.25 * (contains(na, nb) OR contains(nb, na))::INT
        + 0.30 * (CASE WHEN na = nb THEN 1.0 ELSE 1 - levenshtein(na, nb) / greatest(length(na), length(nb)) END) END AS raw FROM p)"""


@query("composite_similarity_pairs", f"WITH {PAIRS}, {SCORE} SELECT a, b, round(raw, 6) AS score FROM s")
def composite_similarity_pairs(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(similarity.score(F.col("a"), F.col("b"), F.lit("PART"), F.lit("PART")), 6).alias("score"))


#: A lower threshold than production's, so that the 64 names of the driver's parts give clusters; blocking stays exact.
LOOSE = similarity.Weights(jaccard=0.5, containment=0.1, edit=0.3, acronym=0.1, threshold=0.52)


def part_entities(spark, d):
    return entities(spark, d).filter("type = 'PART'")


def typed_entities(spark, d):
    """All entities, parts by their own types, so that names meet names of their type only."""
    part = read(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.concat_ws(" ", "p_brand", "p_type").alias("description"))
    return part.unionByName(entities(spark, d).filter("type <> 'PART'").select(part.columns))


LOOSE_SCORE = SCORE.replace("0.35 *", "0.5 *").replace("0.25 *", "0.1 *").replace("SELECT a, b,", "SELECT type, x, y, a, b,")
TYPED_ENTITIES = f"""{ENTITIES_SQL}, typed AS (SELECT p_partkey AS idx, p_name AS name, p_type AS type, p_brand || ' ' || p_type AS description FROM part UNION ALL SELECT idx, name, type, description FROM entities WHERE type <> 'PART'),
    firsts AS (SELECT type, name, min(idx) AS first, {NORM.format('name')} AS n, list_distinct(list_filter(string_split({NORM.format('name')}, ' '), lambda x: x <> '')) AS t FROM typed GROUP BY type, name)"""
EDGES = f"""{TYPED_ENTITIES}, p AS (SELECT u.type, u.first AS x, v.first AS y, u.name AS a, v.name AS b, u.n AS na, v.n AS nb, u.t AS ta, v.t AS tb FROM firsts u JOIN firsts v ON u.type = v.type AND u.first < v.first WHERE list_has_any(u.t, v.t)),
    {LOOSE_SCORE}, e AS (SELECT type, x, y, round(raw, 6) AS score, a, b FROM s WHERE round(raw, 6) >= 0.52)"""
REACH = f"""{EDGES}, both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    reach AS (SELECT first AS node, first AS seen FROM firsts UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON b.x = r.seen), comp AS (SELECT node, min(seen) AS cluster FROM reach GROUP BY node),
    m AS (SELECT cluster, idx, typed.type, typed.name, description AS d FROM typed JOIN firsts ON firsts.type = typed.type AND firsts.name = typed.name JOIN comp ON node = first)"""


@query("similar_name_pairs", f"WITH {EDGES} SELECT type, x AS idx_a, y AS idx_b, a AS name_a, b AS name_b, score FROM e")
def similar_name_pairs(spark, d):
    return resolve.similar_pairs(typed_entities(spark, d), LOOSE)


@query("entity_clusters", f"WITH RECURSIVE {REACH} SELECT idx, type, name, cluster FROM m")
def entity_clusters(spark, d):
    return resolve.clusters(typed_entities(spark, d), LOOSE).select("idx", "type", "name", "cluster")


@query(
    "entity_resolution",
    f"""WITH RECURSIVE {REACH}, c AS (SELECT cluster, type, first(name ORDER BY length(name) DESC, idx) AS name, count(*) AS members, md5(string_agg(d, ' | ' ORDER BY idx)) AS description_md5 FROM m GROUP BY cluster, type)
    SELECT c.cluster, c.type, c.name, c.members, count(*) FILTER (WHERE m.name <> c.name) AS aliases, md5(coalesce(string_agg(m.name, ',' ORDER BY m.idx) FILTER (WHERE m.name <> c.name), '')) AS aliases_md5, c.description_md5 FROM c JOIN m ON m.cluster = c.cluster GROUP BY ALL""",
)
def entity_resolution(spark, d):
    out = resolve.canonical(resolve.clusters(typed_entities(spark, d), LOOSE))
    return out.select("cluster", "type", "name", "members", F.size("aliases").cast("long").alias("aliases"), F.md5(F.array_join("aliases", ",")).alias("aliases_md5"), F.md5("description").alias("description_md5"))


@query("resolution_stats", f"WITH RECURSIVE {REACH}, z AS (SELECT cluster, count(*) AS n FROM m GROUP BY cluster) SELECT CAST(sum(n) AS BIGINT) AS original, count(*) AS resolved, CAST(sum(n) - count(*) AS BIGINT) AS removed, count(*) FILTER (WHERE n > 1) AS clusters, round(100.0 * (sum(n) - count(*)) / sum(n), 6) AS reduction_percent, 100.0 * (sum(n) - count(*)) / sum(n) > 60 AS warning FROM z")
def resolution_stats(spark, d):
    return resolve.stats(resolve.clusters(typed_entities(spark, d), LOOSE))


@query("entities_by_type", f"WITH {ENTITIES_SQL} SELECT type, count(*) AS n, count(DISTINCT name) AS names FROM entities GROUP BY type")
def entities_by_type(spark, d):
    return entities(spark, d).groupBy(resolve.entity_type(F.col("type")).alias("type")).agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query(
    "description_merge_contained",
    f"""WITH RECURSIVE {ENTITIES_SQL}, o AS (SELECT type, name, description AS d, row_number() OVER (PARTITION BY type, name ORDER BY idx) AS k FROM entities),
    f AS (SELECT type, name, CAST(0 AS BIGINT) AS k, '' AS acc FROM (SELECT DISTINCT type, name FROM o)
      UNION ALL SELECT f.type, f.name, o.k, CASE WHEN contains(f.acc, o.d) THEN f.acc WHEN f.acc = '' THEN o.d WHEN length(f.acc || ' | ' || o.d) > 1000 THEN (f.acc || ' | ' || o.d)[1:997] || '...' ELSE f.acc || ' | ' || o.d END
      FROM f JOIN o ON o.type = f.type AND o.name = f.name AND o.k = f.k + 1)
    SELECT type, name, arg_max(acc, k) AS description FROM f GROUP BY type, name""",
)
def description_merge_contained(spark, d):
    return resolve.merged_descriptions(entities(spark, d).withColumn("kind", F.col("type")), ["kind", "name"], "idx").select("type", "name", "description")


# --- graph ---------------------------------------------------------------------------------------------------------


@query("node_degree", f"WITH {RELATIONS_SQL} SELECT name, count(*) AS degree FROM (SELECT src AS name FROM relations UNION ALL SELECT tgt FROM relations WHERE tgt <> src) GROUP BY name")
def node_degree(spark, d):
    return graph.degrees(relations(spark, d))


@query("node_degree_batch", f"WITH {RELATIONS_SQL}, w AS (SELECT 's' || s_suppkey AS name FROM supplier UNION ALL SELECT 'x' || s_suppkey FROM supplier WHERE s_suppkey < 5) SELECT w.name, count(r.src) AS degree FROM w LEFT JOIN relations r ON r.src = w.name OR r.tgt = w.name GROUP BY w.name")
def node_degree_batch(spark, d):
    s = read(spark, d, "supplier")
    names = s.select(F.concat(F.lit("s"), "s_suppkey").alias("name")).unionByName(s.filter("s_suppkey < 5").select(F.concat(F.lit("x"), "s_suppkey").alias("name")))
    return graph.degrees(relations(spark, d), names)


def all_vertices(spark, d):
    return graph.endpoints(relations(spark, d)).distinct()


@query("graph_stats", f"WITH {RELATIONS_SQL}, v AS (SELECT count(*) AS n FROM (SELECT src FROM relations UNION SELECT tgt FROM relations)), e AS (SELECT count(*) AS m FROM relations) SELECT n AS entity_count, m AS relation_count, round(CASE WHEN n > 0 THEN 2.0 * m / n ELSE 0 END, 6) AS average_degree FROM v, e")
def graph_stats(spark, d):
    return graph.stats(all_vertices(spark, d), relations(spark, d))


@query("incident_edges", f"WITH {RELATIONS_SQL} SELECT src, tgt, weight FROM relations WHERE src IN ('s1', 's2', 'n3') OR tgt IN ('s1', 's2', 'n3')")
def incident_edges(spark, d):
    names = spark.createDataFrame([("s1",), ("s2",), ("n3",)], "name string")
    return graph.incident(relations(spark, d), names).select("src", "tgt", "weight")


@query("entity_point_lookup", f"WITH {ENTITIES_SQL} SELECT idx, type, description FROM entities WHERE lower(trim(name)) = (SELECT min(lower(trim(s_name))) FROM supplier)")
def entity_point_lookup(spark, d):
    name = read(spark, d, "supplier").agg(F.min(T.stored_name(F.col("s_name")))).first()[0]
    return graph.entity(entities(spark, d).withColumn("name", T.stored_name(F.col("name"))), f" {name.upper()} ").select("idx", "type", "description")


@query("entities_multi_get", f"WITH {ENTITIES_SQL}, w AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey <= 20) SELECT idx, name, type FROM entities WHERE name IN (SELECT name FROM w)")
def entities_multi_get(spark, d):
    names = read(spark, d, "part").filter("p_partkey <= 20").select(F.col("p_name").alias("name"))
    return graph.named(entities(spark, d), names).select("idx", "name", "type")


@query("entities_in_request_order", f"WITH {ENTITIES_SQL}, w AS (SELECT s_name AS name, s_suppkey AS position FROM supplier WHERE s_suppkey <= 9) SELECT position, idx FROM w JOIN entities USING (name)")
def entities_in_request_order(spark, d):
    names = read(spark, d, "supplier").filter("s_suppkey <= 9").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("position"))
    return graph.named(entities(spark, d), names, keep_order=True).select("position", "idx")


@query("entities_by_chunk", f"WITH {ENTITIES_SQL} SELECT idx, type FROM entities WHERE list_has_any(source_chunk_ids, ['c3', 'c9'])")
def entities_by_chunk(spark, d):
    return graph.touching_chunks(entities(spark, d), ["c3", "c9"]).select("idx", "type")


@query("relations_by_chunk", f"WITH {RELATIONS_SQL} SELECT src, tgt FROM relations WHERE list_has_any(source_chunk_ids, ['c2', 'c5'])")
def relations_by_chunk(spark, d):
    chunks = spark.createDataFrame([("c2",), ("c5",)], "chunk_id string")
    return graph.touching_chunk_table(relations(spark, d), ["src", "tgt"], chunks).select("src", "tgt")


WALK = "u AS (SELECT src AS a, tgt AS b FROM relations UNION SELECT tgt, src FROM relations)"


@query("bfs_depth2", f"WITH RECURSIVE {RELATIONS_SQL}, {WALK}, w AS (SELECT 'r0' AS name, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.name WHERE w.depth < 2) SELECT name, min(depth) AS depth FROM w GROUP BY name")
def bfs_depth2(spark, d):
    return graph.levels(adjacency(spark, d), spark.createDataFrame([("r0",)], "name string"), 2).select("name", "depth")


@query("bfs_max_nodes", f"WITH RECURSIVE {RELATIONS_SQL}, {WALK}, w AS (SELECT 'n1' AS name, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.name WHERE w.depth < 2) SELECT name, min(depth) AS depth FROM w GROUP BY name ORDER BY depth, name LIMIT 25")
def bfs_max_nodes(spark, d):
    return graph.levels(adjacency(spark, d), spark.createDataFrame([("n1",)], "name string"), 2, 25).select("name", "depth")


@query("subgraph_edges", f"WITH RECURSIVE {RELATIONS_SQL}, {WALK}, w AS (SELECT 'n1' AS name, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.name WHERE w.depth < 1), s AS (SELECT DISTINCT name FROM w) SELECT src, tgt FROM relations WHERE src IN (SELECT name FROM s) AND tgt IN (SELECT name FROM s)")
def subgraph_edges(spark, d):
    return graph.subgraph(all_vertices(spark, d), relations(spark, d), "n1", 1, near=adjacency(spark, d))[1].select("src", "tgt")


@query("khop1_expand", f"WITH {RELATIONS_SQL}, seeds AS (SELECT 's' || s_suppkey AS name FROM supplier WHERE s_suppkey <= 3) SELECT name FROM seeds UNION SELECT tgt FROM relations WHERE src IN (SELECT name FROM seeds) UNION SELECT src FROM relations WHERE tgt IN (SELECT name FROM seeds)")
def khop1_expand(spark, d):
    return graph.expand(adjacency(spark, d), read(spark, d, "supplier").filter("s_suppkey <= 3").select(F.concat(F.lit("s"), "s_suppkey").alias("name")), 1)


@query("shortest_path_len", f"WITH RECURSIVE {RELATIONS_SQL}, {WALK}, w AS (SELECT 'c1' AS name, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.name WHERE w.depth < 7) SELECT CAST(min(depth) + 1 AS BIGINT) AS nodes FROM w WHERE name = 'r1'")
def shortest_path_len(spark, d):
    return graph.shortest_path(adjacency(spark, d), "c1", "r1").agg(F.count("*").alias("nodes"))


PATH_SQL = """, dist AS (SELECT name, min(depth) AS depth FROM w GROUP BY name),
    p AS (SELECT name, depth FROM dist WHERE name = '{1}' UNION ALL SELECT min(u.b), p.depth - 1 FROM p JOIN u ON u.a = p.name JOIN dist ON dist.name = u.b AND dist.depth = p.depth - 1 GROUP BY p.depth)
    SELECT CAST(depth AS INTEGER) AS step, name FROM p"""


@query("shortest_path_nodes", f"WITH RECURSIVE {RELATIONS_SQL}, {WALK}, w AS (SELECT 'p7' AS name, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.name WHERE w.depth < 5)" + PATH_SQL.replace("{1}", "c1"))
def shortest_path_nodes(spark, d):
    return graph.shortest_path(adjacency(spark, d), "p7", "c1")


@query("docs_paging", f"WITH {ENTITIES_SQL} SELECT idx, name FROM entities ORDER BY name, idx LIMIT 50 OFFSET 100")
def docs_paging(spark, d):
    return graph.page(entities(spark, d).select("idx", "name"), ["name", "idx"], 100, 50)


@query("hits_to_entities", f"WITH {PROBE}, {ENTITIES_SQL}, h AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10) SELECT h.vec_id, h.score, e.name FROM h JOIN entities e ON e.idx = h.vec_id")
def hits_to_entities(spark, d):
    hits = vectors.top_k(read(spark, d, "embeddings"), probe_of(spark, d), 10, "vec_id", "embedding")
    return hits.join(entities(spark, d), F.col("vec_id") == F.col("idx")).select("vec_id", "score", "name")


@query("relations_of_hits", f"WITH {RELATIONS_SQL}, h AS (SELECT 's' || s_suppkey AS name, s_suppkey AS r FROM supplier WHERE s_suppkey <= 5), j AS (SELECT e.src, e.tgt, h.r FROM relations e JOIN h ON h.name = e.src UNION ALL SELECT e.src, e.tgt, h.r FROM relations e JOIN h ON h.name = e.tgt) SELECT src, tgt, min(r) AS first_hit FROM j GROUP BY src, tgt")
def relations_of_hits(spark, d):
    hits = read(spark, d, "supplier").filter("s_suppkey <= 5").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.col("s_suppkey").alias("r"))
    e = relations(spark, d).select("src", "tgt")
    both = e.join(hits.withColumnRenamed("name", "src"), "src").unionByName(e.join(hits.withColumnRenamed("name", "tgt"), "tgt"))
    return both.groupBy("src", "tgt").agg(F.min("r").alias("first_hit"))


@query("pair_keys", f"WITH {RELATIONS_SQL} SELECT least(src, tgt) AS low, greatest(src, tgt) AS high, count(*) AS n FROM relations GROUP BY ALL")
def pair_keys(spark, d):
    return graph.pair_key(relations(spark, d)).groupBy("low", "high").agg(F.count("*").alias("n"))


# --- merge and lifecycle -------------------------------------------------------------------------------------------

MOVED = f"{RELATIONS_SQL}, m AS (SELECT CASE WHEN src IN ('s2', 's3', 's4') THEN 's1' ELSE src END AS src, CASE WHEN tgt IN ('s2', 's3', 's4') THEN 's1' ELSE tgt END AS tgt, keywords, weight, description FROM relations), k AS (SELECT * FROM m WHERE lower(src) <> lower(tgt))"


def redirected(spark, d):
    mapping = spark.createDataFrame([(f"s{k}", "s1") for k in (2, 3, 4)], "name string, target string")
    return merge.redirect(relations(spark, d), mapping)


@query("redirect_dedup_relations", f"WITH {MOVED} SELECT src, tgt, sum(weight) AS weight, count(*) AS merged FROM k GROUP BY src, tgt")
def redirect_dedup_relations(spark, d):
    return merge.merge_doubles(redirected(spark, d), ["keywords", "description"]).select("src", "tgt", "weight", "merged")


@query("merge_keywords", f"WITH {MOVED}, x AS (SELECT src, tgt, unnest(string_split(keywords, ', ')) AS w FROM k) SELECT src, tgt, string_agg(DISTINCT w, ', ' ORDER BY w) AS keywords FROM x WHERE w <> '' GROUP BY src, tgt")
def merge_keywords(spark, d):
    out = merge.merge_doubles(redirected(spark, d), ["keywords", "description"]).filter("keywords <> ''")
    return out.select("src", "tgt", F.array_join(F.array_sort(F.split("keywords", ", ")), ", ").alias("keywords"))


@query("entity_merge_result", f"WITH {MOVED}, o AS (SELECT src, tgt FROM k GROUP BY src, tgt) SELECT count(*) AS edges, count(*) FILTER (WHERE src = 's1' OR tgt = 's1') AS at_target FROM o")
def entity_merge_result(spark, d):
    v = all_vertices(spark, d).select("name", F.lit("NODE").alias("type"), F.col("name").alias("description"), F.array(F.col("name")).alias("source_chunk_ids"))
    _, e, _ = merge.merge_entities(v, relations(spark, d), ["s2", "S3", " s4 "], "s1")
    return e.agg(F.count("*").alias("edges"), F.count_if((F.col("src") == "s1") | (F.col("tgt") == "s1")).alias("at_target"))


@query("classify_deletion", f"WITH {ENTITIES_SQL} SELECT idx, CASE WHEN NOT list_has_any(source_chunk_ids, ['c1', 'c2']) THEN 'NO_CHANGE' WHEN len(list_filter(source_chunk_ids, lambda x: x NOT IN ('c1', 'c2'))) = 0 THEN 'FULL_DELETE' ELSE 'REBUILD' END AS action FROM entities")
def classify_deletion(spark, d):
    return lifecycle.classify(entities(spark, d), F.array(F.lit("c1"), F.lit("c2"))).select("idx", "action")


@query("delete_cascade", f"WITH {RELATIONS_SQL}, gone AS (SELECT 's' || s_suppkey AS name FROM supplier WHERE s_suppkey % 10 = 3) SELECT src, tgt FROM relations WHERE document_id <> 'd3' AND src NOT IN (SELECT name FROM gone) AND tgt NOT IN (SELECT name FROM gone)")
def delete_cascade(spark, d):
    v = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.concat(F.lit("d"), F.col("s_suppkey") % 10).alias("document_id"))
    return lifecycle.delete_document(v, relations(spark, d), "d3")[1].select("src", "tgt")


@query("delete_relations_by_key", f"WITH {RELATIONS_SQL} SELECT src, tgt FROM relations WHERE NOT (src || '->' || tgt IN ('n1->r1', 'n2->r1', 'n3->r1'))")
def delete_relations_by_key(spark, d):
    keys = spark.createDataFrame([("n1->r1",), ("N2->r1 ",), ("n3->r1",), ("broken",)], "key string")
    return lifecycle.delete_relations(relations(spark, d), keys).select("src", "tgt")


@query("upsert_last_wins", "WITH n AS (SELECT o_custkey AS id, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders), o AS (SELECT c_custkey AS id, c_mktsegment AS v FROM customer) SELECT id, v FROM n WHERE k = 1 UNION ALL SELECT id, v FROM o WHERE id NOT IN (SELECT id FROM n)")
def upsert_last_wins(spark, d):
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    new = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("v"), "o_orderkey")
    return lifecycle.upsert(old, new, ["id"], "o_orderkey")


@query("count_new_entities", "SELECT count(*) AS new FROM supplier WHERE lower(s_name) NOT IN (SELECT lower(s_name) FROM supplier WHERE s_acctbal > 0)")
def count_new_entities(spark, d):
    s = read(spark, d, "supplier").withColumnRenamed("s_name", "name")
    return lifecycle.new_count(s.filter("s_acctbal > 0"), s, "name")


@query("orphan_anti_join", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_anti_join(spark, d):
    return read(spark, d, "embeddings").join(read(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti").select("vec_id")


@query("backfill_left_join", "SELECT e.vec_id, coalesce(d.source, 'none') AS project_id FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
def backfill_left_join(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return read(spark, d, "embeddings").select("vec_id").join(docs, "vec_id", "left").select("vec_id", F.coalesce("source", F.lit("none")).alias("project_id"))


# --- texts ---------------------------------------------------------------------------------------------------------


@query("text_format", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '_{2,}', '', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def text_format(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.tidy(F.col("text"))).alias("digest"))


@query("word_count", "SELECT doc_id, len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) AS words FROM documents")
def word_count(spark, d):
    return read(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens, CASE WHEN ceil(length(text) / 4.0) <= 50 THEN text ELSE text[1:197] || '...' END AS short, right(text, 40) AS tail FROM documents")
def token_estimate(spark, d):
    x = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.token_estimate(x).alias("tokens"), T.truncated(x, 50).alias("short"), T.last_tokens(x, 10).alias("tail"))


@query("sentence_split_counts", "SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentences FROM documents")
def sentence_split_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(F.split("text", r"(?<=[.!?])\s+")).cast("long").alias("sentences"))


@query("fixed_window_chunks", "WITH n AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 400) / 360.0) AS INTEGER) + 1) AS k FROM documents WHERE length(text) > 0), i AS (SELECT doc_id, text, unnest(range(0, k)) AS pos FROM n) SELECT doc_id, CAST(pos AS INTEGER) AS chunk_index, md5(substr(text, CAST(pos * 360 + 1 AS BIGINT), 400)) AS digest FROM i")
def fixed_window_chunks(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(chunking.window_slices(F.col("text"), 100, 10)).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.md5("c").alias("digest"))


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SENTENCES_SQL = f"""WITH RECURSIVE l AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE length(text) > 0),
    s AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM l), t AS (SELECT doc_id, s, i, CAST(ceil(length(s) / 4.0) AS BIGINT) AS n FROM s),
    f AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS now, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS done FROM l
      UNION ALL SELECT doc_id, i, CASE WHEN big THEN '' WHEN full_now THEN CASE WHEN tail <> '' THEN tail || ' ' ELSE '' END || s || ' ' ELSE now || s || ' ' END,
        CASE WHEN big THEN 0 WHEN full_now THEN CAST(ceil(length(tail) / 4.0) AS BIGINT) + n ELSE used + n END,
        CASE WHEN big THEN list_concat(CASE WHEN bare <> '' THEN [bare] ELSE CAST([] AS VARCHAR[]) END, list_transform(range(0, greatest(1, CAST(ceil((length(s) - 800) / 720.0) AS BIGINT) + 1)), lambda k: substr(s, k * 720 + 1, 800))) WHEN full_now THEN [bare] ELSE CAST([] AS VARCHAR[]) END
      FROM (SELECT t.doc_id, t.i, t.s, t.n, f.now, f.used, {STRIP.format('f.now')} AS bare, right({STRIP.format('f.now')}, 80) AS tail, t.n > 200 AS big, f.used + t.n > 200 AND {STRIP.format('f.now')} <> '' AS full_now FROM f JOIN t ON t.doc_id = f.doc_id AND t.i = f.i + 1)),
    c AS (SELECT doc_id, i, unnest(done) AS content, generate_subscripts(done, 1) AS k FROM f UNION ALL SELECT doc_id, max(i) + 1, {STRIP.format('arg_max(now, i)')}, 0 FROM f GROUP BY doc_id)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INTEGER) AS chunk_index, content FROM c WHERE content <> ''"""


@query("sentence_chunks", SENTENCES_SQL)
def sentence_chunks(spark, d):
    return chunking.sentence_chunks(read(spark, d, "documents"), "doc_id", "text", 200, 20)


@query(
    "character_chunks",
    r"""WITH RECURSIVE f AS (SELECT doc_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS k, '' AS content FROM documents WHERE length(text) > 0
      UNION ALL SELECT doc_id, pos + n + CASE WHEN pos + n < size AND regexp_matches(substr(text, pos + n + 1, 1), '\s') THEN 1 ELSE 0 END, k + 1, regexp_replace(substr(text, pos + 1, n), '^\s+|\s+$', '', 'g')
        FROM (SELECT f.doc_id, f.pos, f.k, d.text, length(d.text) AS size, CASE WHEN f.pos + 500 >= length(d.text) THEN length(d.text) - f.pos WHEN length(regexp_extract(substr(d.text, f.pos + 1, 500), '(?s)^(.*)[ \n\t]', 1)) > 0 THEN length(regexp_extract(substr(d.text, f.pos + 1, 500), '(?s)^(.*)[ \n\t]', 1)) ELSE 500 END AS n FROM f JOIN documents d USING (doc_id) WHERE f.pos < length(d.text)))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, content FROM f WHERE content <> ''""",
)
def character_chunks(spark, d):
    return chunking.character_chunks(read(spark, d, "documents"), "doc_id", "text", 500)


def source_code(spark, d):
    """A file of code for each document: classes, functions, imports, empty lines and statements of many lengths."""
    line = F.expr("""transform(sequence(0, cast(n_chars % 140 as int)), i -> CASE (i * 7 + doc_id) % 13 WHEN 0 THEN concat('public class K', i, ' {') WHEN 1 THEN concat('def f', i, '(a, b):') WHEN 2 THEN 'import os' WHEN 3 THEN ''
      ELSE concat('    x', i, ' = ', repeat('y', cast((i * 11 + doc_id) % 60 as int))) END)""")
    return read(spark, d, "documents").select("doc_id", F.array_join(line, "\n").alias("code"))


CODE_SQL = """WITH RECURSIVE i AS (SELECT doc_id, CAST(n_chars % 140 AS BIGINT) + 1 AS m, unnest(range(0, CAST(n_chars % 140 AS BIGINT) + 1)) AS i FROM documents),
    l AS (SELECT doc_id, m, i, CASE (i * 7 + doc_id) % 13 WHEN 0 THEN 'public class K' || i || ' {' WHEN 1 THEN 'def f' || i || '(a, b):' WHEN 2 THEN 'import os' WHEN 3 THEN '' ELSE '    x' || i || ' = ' || repeat('y', CAST((i * 11 + doc_id) % 60 AS INTEGER)) END AS line,
      CASE (i * 7 + doc_id) % 13 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'FUNCTION' END AS kind, CASE (i * 7 + doc_id) % 13 WHEN 0 THEN 'K' || i WHEN 1 THEN 'f' || i END AS scope FROM i),
    p AS MATERIALIZED (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS before FROM l),
    b AS (SELECT x.doc_id, x.i, coalesce(max(y.i), 0) AS back FROM p x LEFT JOIN p y ON y.doc_id = x.doc_id AND y.i < x.i AND x.before - y.before >= 80 GROUP BY x.doc_id, x.i),
    q AS MATERIALIZED (SELECT p.*, b.back, p.before - o.before AS back_size FROM p JOIN b USING (doc_id, i) JOIN p o ON o.doc_id = p.doc_id AND o.i = b.back),
    f AS (SELECT DISTINCT doc_id, m, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS start, CAST(0 AS HUGEINT) AS size, 'FILE' AS scope, 'FILE' AS kind, CAST(-1 AS BIGINT) AS cut_from, '' AS cut_scope, '' AS cut_kind FROM i
      UNION ALL SELECT doc_id, m, i, CASE WHEN cut THEN back ELSE start END, CASE WHEN cut THEN back_size ELSE size END + length(line) + (i < m - 1)::INT, coalesce(new_scope, scope), coalesce(new_kind, kind), CASE WHEN cut THEN start ELSE -1 END, scope, kind
      FROM (SELECT q.doc_id, q.i, q.m, q.line, q.back, q.back_size, q.scope AS new_scope, q.kind AS new_kind, f.start, f.size, f.scope, f.kind, f.size > 0 AND f.size + length(q.line) + 1 > 800 AS cut FROM f JOIN q ON q.doc_id = f.doc_id AND q.i = f.i + 1)),
    c AS (SELECT doc_id, cut_from AS a, i AS z, cut_scope AS scope, cut_kind AS kind, true AS inner_one FROM f WHERE cut_from >= 0 UNION ALL SELECT doc_id, start, i + 1, scope, kind, false FROM f WHERE size > 0 AND i + 1 = m)
    SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY z, inner_one DESC) - 1 AS INTEGER) AS chunk_index, md5(string_agg(line, chr(10) ORDER BY l.i) || CASE WHEN inner_one THEN chr(10) ELSE '' END) AS digest, CAST(a + 1 AS INTEGER) AS start_line, CAST(z AS INTEGER) AS end_line, c.scope AS containing_scope, c.kind AS scope_type, 'CODE' AS chunk_type
    FROM c JOIN l ON l.doc_id = c.doc_id AND l.i >= a AND l.i < z GROUP BY c.doc_id, a, z, c.scope, c.kind, inner_one"""


@query("code_chunks", CODE_SQL)
def code_chunks(spark, d):
    found = chunking.code_chunks(source_code(spark, d), "doc_id", "code", 200, 20)
    return found.withColumn("digest", F.md5("content")).drop("content")


def _html_sql() -> str:
    out = "html"
    for tag in html.DROPPED:
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for name, value in html.ENTITIES:
        quoted = value.replace("'", "''")
        out = f"replace({out}, '{name}', '{quoted}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("html_to_text", f"SELECT page_id, md5({_html_sql()}) AS digest FROM pages")
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(html.text(F.col("html"))).alias("digest"))


@query("html_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, d):
    return read(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("html_metadata", f"WITH t AS (SELECT page_id, html, {_html_sql()} AS text FROM pages) SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1).trim() AS title, nullif(trim(regexp_extract(html, '(?i)<meta[^>]+name=[''\"]description[''\"][^>]+content=[''\"]([^''\"]+)[''\"]', 1)), '') AS description, length(text)::VARCHAR AS characters, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::VARCHAR AS words FROM t")
def html_metadata(spark, d):
    found = html.metadata(F.col("html"), html.text(F.col("html")))
    return read(spark, d, "pages").select("page_id", *[F.try_element_at(found, F.lit(k)).alias(n) for k, n in (("title", "title"), ("description", "description"), ("characterCount", "characters"), ("wordCount", "words"))])


@query("cache_key", "SELECT doc_id, sha256(concat_ws('|', lang, 'HYBRID', '60', '20')) AS k FROM documents")
def cache_key(spark, d):
    return read(spark, d, "documents").select("doc_id", cache.answer_key(F.col("lang"), F.lit("hybrid"), F.lit(60), F.lit(20)).alias("k"))


@query("glob_keys", "SELECT doc_id FROM documents WHERE source LIKE 'src1_%' AND lang LIKE '_n'")
def glob_keys(spark, d):
    return read(spark, d, "documents").filter(F.col("source").like(T.glob_like("src1?*")) & F.col("lang").like(T.glob_like("?n"))).select("doc_id")


@query("transient_errors", f"SELECT event_id, lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') IN ('08', '40', '53', '57') OR regexp_matches(event_type || ' ' || props, '{T.TRANSIENT_WORDS}') AS transient FROM events")
def transient_errors(spark, d):
    state = F.concat(F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lit("000"))
    return read(spark, d, "events").select("event_id", T.transient_error(state, F.concat_ws(" ", "event_type", "props")).alias("transient"))


# --- extraction ----------------------------------------------------------------------------------------------------

def responses(spark, d):
    """Answers of seven kinds: all well, too short, blank type and a loop, other spellings of markers and repeated ones (which
    count as one), pipes, glued records, quoted and over-long names."""
    name, nation = F.col("s_name"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))
    f, kind = "{tuple_delimiter}", F.col("s_suppkey") % 7
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    text = (
        F.when(kind == 0, put("entity<|#|>", name, "<|#|>SUPPLIER<|#|>", nation, f"\nrelation{f}", name, f, nation, f"{f}located{f}is in{{completion_delimiter}}"))
        .when(kind == 1, put("entity<|#|>", name, "<|#|>SUPPLIER\nrelation<|#|>", name, "<|#|>", nation, "<|#|>located\nplain words"))
        .when(kind == 2, put("ENTITY<|#|>", name, "<|#|> <|#|>", nation, "\nrelation<|#|>", name, "<|#|>", F.upper(name), "<|#|>k<|#|>d<|COMPLETE|>relation<|#|> <|#|>", nation, "<|#|>k<|#|>d"))
        .when(kind == 3, put("entity{ TUPLE_DELIMITER }", name, "{ TUPLE_DELIMITER }SUPPLIER{ TUPLE_DELIMITER }", nation, "\nrelation<|#", name, "#|>", nation, "<|#|><|#|>located<|#|> {Completion_Delimiter}"))
        .when(kind == 4, put("entity|", name, "|SUPPLIER|", nation, "|\nrelation|", name, "|", nation, "|located|is in||\nentity|too|few"))
        .when(kind == 5, put("entity<|#|>", name, "<|#|>SUPPLIER<|#|>", nation, "<|#|>entity<|#|>", nation, "<|#|>NATION<|#|>of ", name, "\nrelation<|#|>", name, "<|#|>", nation, "<|#|>a<|#|>b<|#|>relation<|#|>", nation, "<|#|>", name, "<|#|>c<|#|>d"))
        .otherwise(put("entity<|#|> \"", name, "\" <|#|>SUPPLIER<|#|>  ", nation, "\nentity<|#|>'  a   b  '<|#|>T<|#|>x\nentity<|#|>", F.repeat(F.lit("long "), 120), "<|#|>T<|#|>y\nentity<|#|>''<|#|>T<|#|>z"))
    )
    return read(spark, d, "supplier").select("s_suppkey", text.alias("response"))


@query(
    "parse_entities",
    """WITH s AS (SELECT s_suppkey, s_suppkey % 7 AS kind, s_name, 'nation ' || s_nationkey AS nation FROM supplier)
    SELECT s_suppkey, s_name AS name, CASE WHEN kind = 2 THEN 'CONCEPT' ELSE 'SUPPLIER' END AS type, nation AS description FROM s WHERE kind <> 1
    UNION ALL SELECT s_suppkey, nation, 'NATION', 'of ' || s_name FROM s WHERE kind = 5
    UNION ALL SELECT s_suppkey, 'a b', 'T', 'x' FROM s WHERE kind = 6 UNION ALL SELECT s_suppkey, left(repeat('long ', 120), 500), 'T', 'y' FROM s WHERE kind = 6""",
)
def parse_entities(spark, d):
    return extraction.parse_responses(responses(spark, d), "s_suppkey", "response")[0].drop("seq")


@query(
    "parse_relations",
    """WITH s AS (SELECT s_suppkey, s_suppkey % 7 AS kind, s_name, 'nation ' || s_nationkey AS nation FROM supplier)
    SELECT s_suppkey, s_name AS src, nation AS tgt, 'located' AS keywords, 'is in' AS description, 1.0::DOUBLE AS weight FROM s WHERE kind IN (0, 4)
    UNION ALL SELECT s_suppkey, s_name, nation, 'located', 'RELATED_TO', 1.0 FROM s WHERE kind = 3
    UNION ALL SELECT s_suppkey, s_name, nation, 'a', 'b', 1.0 FROM s WHERE kind = 5 UNION ALL SELECT s_suppkey, nation, s_name, 'c', 'd', 1.0 FROM s WHERE kind = 5""",
)
def parse_relations(spark, d):
    return extraction.parse_responses(responses(spark, d), "s_suppkey", "response")[1].drop("seq")


@query("parse_keywords", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN [lower(s_name), 'trade'] WHEN 1 THEN [] WHEN 2 THEN [lower(s_name)] ELSE ['a  b', 'a  b'] END AS high, CASE s_suppkey % 4 WHEN 0 THEN ['nation ' || s_nationkey] WHEN 3 THEN ['x'] ELSE [] END AS low FROM supplier")
def parse_keywords(spark, d):
    kind, name, nation = F.col("s_suppkey") % 4, F.col("s_name"), F.col("s_nationkey").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("HIGH_LEVEL_KEYWORDS: "), name, F.lit(", Trade, none\nlow_level_keywords: Nation "), nation)).when(kind == 1, F.concat(F.lit("no keywords: "), name))
    text = text.when(kind == 2, F.concat(F.lit("low_LEVEL_keywords: NONE, ,\nwords before High_Level_Keywords:   "), name)).otherwise(F.lit("HIGH_LEVEL_KEYWORDS:A  b,,a  B \nLOW_LEVEL_KEYWORDS:\tX"))
    return read(spark, d, "supplier").select("s_suppkey", extraction.keywords(text, "HIGH").alias("high"), extraction.keywords(text, "LOW").alias("low"))


def json_responses(spark, d):
    """Fenced and bare JSON, with blank names, missing fields, relationships, and what is no JSON."""
    kind, name = F.col("s_suppkey") % 5, F.col("s_name")
    entity = F.struct(name.alias("name"), F.when(kind != 1, F.lit("SUPPLIER")).alias("type"), F.when(kind == 2, F.lit("text")).alias("description"))
    blank = F.struct(F.lit("  ").alias("name"), F.lit("T").cast("string").alias("type"), F.lit("d").cast("string").alias("description"))
    to = F.struct(name.alias("source"), F.when(kind != 3, F.lit("Market")).otherwise(" ").alias("target"), F.when(kind != 1, F.lit("sells")).alias("type"), F.when(kind == 2, F.lit("goods")).alias("description"))
    body = F.to_json(F.struct(F.array(entity, blank).alias("entities"), F.array(to).alias("relationships")))
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("  "), body, F.lit("\n"))).when(kind == 4, F.concat(F.lit("Here it is: "), body)).otherwise(F.concat(F.lit("```"), body, F.lit("```")))
    return read(spark, d, "supplier").select("s_suppkey", text.alias("response"))


@query("parse_json_extraction", "SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 5 = 1 THEN 'CONCEPT' ELSE 'SUPPLIER' END AS type, CASE WHEN s_suppkey % 5 = 2 THEN 'text' ELSE '' END AS description FROM supplier WHERE s_suppkey % 5 <> 4")
def parse_json_extraction(spark, d):
    return extraction.parse_responses(json_responses(spark, d), "s_suppkey", "response")[0].drop("seq")


@query("parse_json_relations", "SELECT s_suppkey, s_name AS src, 'Market' AS tgt, CASE WHEN s_suppkey % 5 = 1 THEN '' ELSE 'sells' END AS keywords, CASE WHEN s_suppkey % 5 = 2 THEN 'goods' ELSE 'RELATED_TO' END AS description, 1.0::DOUBLE AS weight FROM supplier WHERE s_suppkey % 5 < 3")
def parse_json_relations(spark, d):
    return extraction.parse_responses(json_responses(spark, d), "s_suppkey", "response")[1].drop("seq")


@query("gleaning_keep_longest", f"WITH {ENTITIES_SQL} SELECT lower(name) AS k, first(description ORDER BY length(description) DESC, idx) AS description FROM entities GROUP BY lower(name)")
def gleaning_keep_longest(spark, d):
    out = extraction.keep_longer(entities(spark, d), F.lower("name"), "idx", ["name", "description"])
    return out.select(F.lower("name").alias("k"), "description")


@query(
    "citation_filter",
    r"""WITH a AS (SELECT doc_id, 'Fact [d' || doc_id || ']. More [zz], [d' || (doc_id + 1) || '] and [a[b]. ' || source AS t, CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['none'] WHEN 2 THEN ['d' || doc_id, 'a[b'] ELSE ['d' || doc_id, 'd' || (doc_id + 1), 'x'] END AS ids FROM documents),
    s AS (SELECT doc_id, t, ids, regexp_split_to_array(t, '\[[^\]]+\]') AS p, regexp_extract_all(t, '\[([^\]]+)\]', 1) AS m FROM a)
    SELECT doc_id, CASE WHEN len(ids) = 0 THEN regexp_replace(t, '\s*\[[^\]]+\]', '', 'g')
      ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda k: p[k] || CASE WHEN list_contains(ids, m[k]) THEN '[' || m[k] || ']' ELSE '' END), '') END AS answer FROM s""",
)
def citation_filter(spark, d):
    key = lambda n: F.concat(F.lit("d"), (F.col("doc_id") + n).cast("string"))
    answer = F.concat(F.lit("Fact ["), key(0), F.lit("]. More [zz], ["), key(1), F.lit("] and [a[b]. "), "source")
    k = F.col("doc_id") % 4
    ids = F.when(k == 0, F.expr("cast(array() AS array<string>)")).when(k == 1, F.array(F.lit("none"))).when(k == 2, F.array(key(0), F.lit("a[b"))).otherwise(F.array(key(0), key(1), F.lit("x")))
    return read(spark, d, "documents").select("doc_id", modes.valid_citations(answer, ids).alias("answer"))


@query("citation_strip", "SELECT conv_id, turn, regexp_replace('See [' || conv_id || '] and [x' || turn || '].', '\\s*\\[[^\\[\\]]*\\]', '', 'g') AS answer FROM conversations")
def citation_strip(spark, d):
    answer = F.concat(F.lit("See ["), F.col("conv_id").cast("string"), F.lit("] and [x"), F.col("turn").cast("string"), F.lit("]."))
    return read(spark, d, "conversations").select("conv_id", "turn", modes.valid_citations(answer, F.expr("cast(array() AS array<string>)")).alias("answer"))


@query("chat_history", "SELECT conv_id, md5(string_agg(upper(role[1:1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def chat_history(spark, d):
    return modes.history_text(read(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", F.md5("history").alias("digest"))


SNIPPETS = ["import java.util.List;", "def run(x):", "select a from b", "(defn f [x] x)", "plain words", "{\"key\": 1}", "fn main() { let mut x = 1; }", "", "package x; import java.util.List;", "export const a = (b): c => b", "contract Coin {}", "PROGRAM main"]
ENDINGS = [".java", ".PY", ".sql", ".clj", "", ".json", ".rs", ".toml", ".bak", ".ts", ".sol", ".f90", "."]


def code_files(spark, d):
    """A file for each document: name and content go through all pairs of ENDINGS and SNIPPETS."""
    some = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k.cast("int") + 1)
    k = F.col("doc_id")
    name = F.concat(F.lit("src/File.v1/a"), k.cast("string"), some(ENDINGS, k % len(ENDINGS)))
    return read(spark, d, "documents").select("doc_id", name.alias("name"), some(SNIPPETS, F.floor(k / len(ENDINGS)) % len(SNIPPETS)).alias("content"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


FILES_SQL = f"files AS (SELECT doc_id, 'src/File.v1/a' || doc_id || {_sql_list(ENDINGS)}[doc_id % {len(ENDINGS)} + 1] AS name, {_sql_list(SNIPPETS)}[(doc_id // {len(ENDINGS)}) % {len(SNIPPETS)} + 1] AS content FROM documents)"


@query(
    "detect_language",
    rf"""WITH {FILES_SQL}, l AS (SELECT *, CASE regexp_extract(lower(name), '\.[^.]+$') WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' WHEN '.sql' THEN 'sql' WHEN '.clj' THEN 'clojure' WHEN '.json' THEN 'json' WHEN '.rs' THEN 'rust' WHEN '.toml' THEN 'toml' WHEN '.ts' THEN 'typescript' WHEN '.sol' THEN 'solidity' WHEN '.f90' THEN 'fortran' END AS lang FROM files),
    f AS (SELECT *, CASE lang WHEN 'java' THEN regexp_matches(content, '\b(class|interface|package|public|private|import)\s') WHEN 'python' THEN regexp_matches(content, '\b(def|import|from|class|if|elif|else|for|while)\s') WHEN 'sql' THEN regexp_matches(content, '(?i)\b(select|insert|update|delete|create|drop|alter|from|where|join)\b')
      WHEN 'clojure' THEN regexp_matches(content, '\(\s*(defn|def|let|fn|ns|require)\s') WHEN 'json' THEN regexp_matches(content, '^\s*[{{\[]|"\w+"\s*:') WHEN 'rust' THEN regexp_matches(content, '\b(fn|impl|struct|enum|trait|pub|use|let|mut)\s') WHEN 'typescript' THEN regexp_matches(content, '\b(interface|type|const|let|function|class|import|export)\s*:\s*\w')
      WHEN 'solidity' THEN regexp_matches(content, '\b(contract|function|modifier|event|require|public|private|internal)\s') WHEN 'fortran' THEN regexp_matches(content, '(?i)\b(program|subroutine|function|integer|real|do|if|endif)\b') ELSE true END AS fits FROM l),
    g AS (SELECT *, [NULL, 'java', 'scala', 'python', 'clojure', NULL, 'json', 'javascript', NULL, 'java', 'javascript', 'solidity', 'fortran'][(doc_id // {len(ENDINGS)}) % {len(SNIPPETS)} + 2] AS guess FROM f)
    SELECT doc_id, coalesce(lang, guess, 'unknown') AS language, CASE WHEN lang IS NOT NULL THEN 'extension' WHEN guess IS NOT NULL THEN 'content' ELSE 'heuristic' END AS method,
      CAST(CASE WHEN lang IS NOT NULL THEN CASE WHEN content = '' THEN 0.85 WHEN fits THEN 0.95 ELSE 0.75 END WHEN guess IS NOT NULL THEN 0.65 ELSE 0 END AS DOUBLE) AS confidence FROM g""",
)
def detect_language(spark, d):
    return code_files(spark, d).select("doc_id", F.expr("name"), F.col("content")).select("doc_id", code.detect(F.col("name"), F.col("content")).alias("x")).select("doc_id", "x.language", "x.method", "x.confidence")


@query(
    "guess_language",
    f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN content = '' THEN NULL WHEN contains(content, 'package ') AND contains(content, 'import java.') THEN 'java' WHEN contains(content, 'def ') OR (contains(content, 'import ') AND contains(content, '__name__')) THEN 'python'
      WHEN contains(content, 'interface ') OR (contains(content, 'export ') AND contains(content, ': ')) THEN 'typescript' WHEN contains(content, 'func ') AND contains(content, 'package ') THEN 'go' WHEN contains(content, 'fn ') AND contains(content, 'use ') THEN 'rust'
      WHEN contains(content, 'function') OR contains(content, 'const ') OR contains(content, 'let ') THEN 'javascript' WHEN contains(content, 'public class') OR contains(content, 'private class') THEN 'java' ELSE 'unknown' END AS language FROM files""",
)
def guess_language(spark, d):
    return code_files(spark, d).select("doc_id", code.guessed(F.col("content")).alias("language"))


@query("display_language", rf"WITH {FILES_SQL} SELECT doc_id, CASE regexp_extract(lower(name), '\.([^.]+)$', 1) WHEN 'java' THEN 'Java' WHEN 'py' THEN 'Python' WHEN 'sql' THEN 'SQL' WHEN 'rs' THEN 'Rust' WHEN 'ts' THEN 'TypeScript' ELSE 'unknown' END AS language FROM files")
def display_language(spark, d):
    return code_files(spark, d).select("doc_id", code.display_name(F.col("name")).alias("language"))


@query("extract_imports", "SELECT s_suppkey, ['com.acme.s' || s_suppkey, 'java.util.List'] AS imports FROM supplier")
def extract_imports(spark, d):
    body = F.concat(F.lit("package x;\nimport com.acme.s"), F.col("s_suppkey").cast("string"), F.lit(";\n  import java.util.List;\nclass A {}\n"))
    return read(spark, d, "supplier").select("s_suppkey", code.imports(body, "java").alias("imports"))


# --- tokens, caches, exports ---------------------------------------------------------------------------------------


@query("token_usage_by_op", "SELECT event_type AS op, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(length(props)) AS BIGINT) AS output_tokens FROM events GROUP BY event_type")
def token_usage_by_op(spark, d):
    return usage(spark, d)


def usage(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("op"), F.floor("value").cast("long").alias("i"), F.length("props").alias("o"))
    return lookups.usage(e.withColumnsRenamed({"i": "input_tokens", "o": "output_tokens"}))


@query("token_usage_string", "WITH u AS (SELECT event_type AS op, count(*) AS c, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS i, CAST(sum(length(props)) AS BIGINT) AS o FROM events GROUP BY event_type) SELECT string_agg(op || ':' || c || ':' || i || ':' || o, ',' ORDER BY op) AS breakdown FROM u")
def token_usage_string(spark, d):
    return lookups.usage_string(usage(spark, d))


@query("cache_eviction", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-01' ORDER BY ts DESC, event_id LIMIT 500")
def cache_eviction(spark, d):
    return cache.evicted(read(spark, d, "events"), "ts", "event_id", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).select("event_id")


@query("csv_rows", f"WITH {ENTITIES_SQL}, c AS (SELECT name, type, description, len(source_chunk_ids) AS n FROM entities) SELECT concat_ws(',', CASE WHEN regexp_matches(name, '[,\"\\n\\r]') THEN '\"' || replace(name, '\"', '\"\"') || '\"' ELSE name END, type, description, n) AS line FROM c")
def csv_rows(spark, d):
    return export.csv_rows(entities(spark, d), export.ENTITY_COLUMNS)


@query("markdown_rows", f"WITH {RELATIONS_SQL} SELECT '| ' || src || ' | ' || tgt || ' | ' || description || ' | ' || keywords || ' | ' || printf('%.2f', weight::DOUBLE) || ' | ' || len(source_chunk_ids) || ' |' AS line FROM relations")
def markdown_rows(spark, d):
    return export.markdown_rows(relations(spark, d), export.RELATION_COLUMNS)


@query(
    "markdown_document",
    f"""WITH {ENTITIES_SQL}, {RELATIONS_SQL}, cut AS (SELECT *, CASE WHEN length(d) > 100 THEN left(d, 97) || '...' ELSE d END AS short FROM (SELECT *, repeat(description || '|', 12) AS d FROM entities)),
    e AS (SELECT row_number() OVER (ORDER BY name, type, idx) AS n, '| ' || name || ' | ' || type || ' | ' || replace(short, '|', '\\|') || ' | ' || document_id || ' | ' || len(source_chunk_ids) || ' |' AS line FROM cut),
    r AS (SELECT row_number() OVER (ORDER BY src, tgt) AS n, '| ' || src || ' | ' || tgt || ' | ' || description || ' | ' || keywords || ' | ' || printf('%.2f', weight::DOUBLE) || ' |' AS line FROM relations)
    SELECT 'Entities' AS section, n + 3 AS number, line FROM e UNION ALL SELECT 'Relations', n + 3, line FROM r
    UNION ALL SELECT 'Entities', 0, '## Entities (' || (SELECT count(*) FROM e) || ')' UNION ALL SELECT 'Entities', 1, '' UNION ALL SELECT 'Entities', 2, '| Name | Type | Description | Document ID | Sources |' UNION ALL SELECT 'Entities', 3, '|------|------|-------------|-------------|---------|'
    UNION ALL SELECT 'Relations', -1, '' UNION ALL SELECT 'Relations', 0, '## Relations (' || (SELECT count(*) FROM r) || ')' UNION ALL SELECT 'Relations', 1, '' UNION ALL SELECT 'Relations', 2, '| Source | Target | Description | Keywords | Weight |' UNION ALL SELECT 'Relations', 3, '|--------|--------|-------------|----------|--------|'""",
)
def markdown_document(spark, d):
    """Rows of one name and type are told apart by their line here, as their order among each other is free."""
    vertices = entities(spark, d).withColumn("description", F.repeat(F.concat("description", F.lit("|")), 12))
    return export.markdown_document(vertices, relations(spark, d))


@query("text_rows", f"WITH {ENTITIES_SQL} SELECT printf('%d. %s [%s]', row_number() OVER (ORDER BY name, idx), name, type) || chr(10) || '   ' || description AS block FROM entities")
def text_rows(spark, d):
    return export.text_blocks(entities(spark, d), ["name", "idx"])


@query("authorized_projects", "SELECT c_custkey, c_custkey % 11 = 0 OR c_nationkey % 3 = 0 OR c_custkey % 5 = 1 AS readable, c_custkey % 11 = 0 OR (c_nationkey % 3 <> 0 AND c_custkey % 5 = 1) AS writable FROM customer")
def authorized_projects(spark, d):
    owner, user, admin = F.when(F.col("c_nationkey") % 3 != 0, F.col("c_custkey") % 5), F.lit(1), F.col("c_custkey") % 11 == 0
    return read(spark, d, "customer").select("c_custkey", tenants.readable(owner, user, admin).alias("readable"), tenants.writable(owner, user, admin).alias("writable"))


@query("document_progress", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 50 ELSE 0 END AS progress FROM orders")
def document_progress(spark, d):
    from .streaming.claims import progress

    status = F.when(F.col("o_orderstatus") == "F", "PROCESSED").when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("NOT_PROCESSED")
    return read(spark, d, "orders").select("o_orderkey", progress(status).alias("progress"))


@query("name_uuid", "WITH h AS (SELECT s_suppkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('project:' || s_name)) AS x FROM supplier) SELECT s_suppkey, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', x[17:17]) - 1) % 4 + 1, 1) || x[18:20] || '-' || x[21:32] AS id FROM h")
def name_uuid(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", T.name_uuid(F.concat(F.lit("project:"), "s_name")).alias("id"))


def _store(spark, d) -> modes.Store:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    v = stored_vectors(spark, d).join(docs, "id", "left").withColumn("name", F.concat(F.lit("s"), F.col("id") % 100 + 1))
    vertices = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.concat(F.lit("nation "), "s_nationkey").alias("description"))
    return modes.Store(v.filter("content IS NOT NULL"), vertices, relations(spark, d))


MODE_HITS = f"""{PROBE}, {RELATIONS_SQL}, v AS (SELECT e.vec_id AS id, d.text AS content, e.label % 2 = 0 AS is_chunk, 's' || (e.vec_id % 100 + 1) AS name, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, q WHERE d.text IS NOT NULL),
    chunk_hits AS (SELECT 'chunk' AS kind, CAST(id AS VARCHAR) AS source_id, '[' || id || '] ' || content AS content, score FROM v WHERE is_chunk ORDER BY score DESC, id LIMIT 5),
    best AS (SELECT name, score FROM v WHERE NOT is_chunk ORDER BY score DESC, name LIMIT 10), vertices AS (SELECT 's' || s_suppkey AS name, 'nation ' || s_nationkey AS description FROM supplier)"""
MODE_ENTITIES = {
    "plain": "ent AS (SELECT name, description, score FROM best JOIN vertices USING (name))",
    "near": "near AS (SELECT name FROM best JOIN vertices USING (name) UNION SELECT tgt FROM relations WHERE src IN (SELECT name FROM best JOIN vertices USING (name)) UNION SELECT src FROM relations WHERE tgt IN (SELECT name FROM best JOIN vertices USING (name))), ent AS (SELECT v.name, v.description, coalesce(b.score, 0.0) AS score FROM vertices v LEFT JOIN (SELECT name, score FROM best) b USING (name) WHERE v.name IN (SELECT name FROM near))",
}
MODE_ITEMS = """entity_hits AS (SELECT 'entity' AS kind, name AS source_id, name || ': ' || description AS content, score FROM ent),
    relation_hits AS (SELECT 'relation' AS kind, src || '->' || tgt AS source_id, src || '->' || tgt || ': ' || description AS content, max(score) AS score FROM (SELECT r.src, r.tgt, r.description, e.score FROM relations r JOIN ent e ON r.src = e.name UNION ALL SELECT r.src, r.tgt, r.description, e.score FROM relations r JOIN ent e ON r.tgt = e.name) GROUP BY src, tgt, description)"""


def _mode_sql(mode: str) -> str:
    """Each source's items up to its share, taken in turn while they fit."""
    share = dict(zip(("chunk", "entity", "relation"), modes.SHARES[mode], strict=True))
    wants = [k for k in modes.ORDER[mode] if not (mode == "LOCAL" and k != "chunk") and not (mode == "GLOBAL" and k == "chunk")]
    hits = " UNION ALL ".join(f"SELECT *, {modes.ORDER[mode].index(k)} AS source_idx, {int(4000 * share[k])} AS most FROM {k}_hits" for k in wants)
    return f"""WITH RECURSIVE {MODE_HITS}, {MODE_ENTITIES["near" if mode == "MIX" else "plain"]}, {MODE_ITEMS},
    i AS (SELECT *, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM ({hits})),
    r AS (SELECT *, sum(tokens) OVER w AS running, row_number() OVER w AS item_idx FROM i WINDOW w AS (PARTITION BY kind ORDER BY score DESC, source_id ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT content, tokens, row_number() OVER (ORDER BY item_idx, source_idx) AS p FROM r WHERE running <= most),
    f AS (SELECT CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS used, 0 AS n, 0 AS skipped, '' AS text
      UNION ALL SELECT o.p, CASE WHEN f.used + o.tokens + (f.n > 0)::INT <= 4000 THEN f.used + o.tokens + (f.n > 0)::INT ELSE f.used END, f.n + (f.used + o.tokens + (f.n > 0)::INT <= 4000)::INT, f.skipped + (f.used + o.tokens + (f.n > 0)::INT > 4000)::INT,
        CASE WHEN f.used + o.tokens + (f.n > 0)::INT <= 4000 THEN CASE WHEN f.n > 0 THEN f.text || chr(10) || chr(10) || o.content ELSE o.content END ELSE f.text END FROM f JOIN o ON o.p = f.p + 1)
    SELECT arg_max(md5(text), p) AS text_md5, arg_max(n, p) AS included, arg_max(skipped, p) AS truncated, arg_max(used, p) AS total_tokens FROM f HAVING max(p) > 0"""


def _mode_query(mode: str):
    @query(f"mode_{mode.lower()}", _mode_sql(mode))
    def run(spark, d):
        found = modes.answer_context(_store(spark, d), probe_of(spark, d), modes.QueryParam(mode=mode, top_k=10, chunk_top_k=5)).context
        return found.select(F.md5("text").alias("text_md5"), "included", "truncated", "total_tokens")

    return run


for _mode in ("NAIVE", "LOCAL", "GLOBAL", "HYBRID", "MIX"):
    _mode_query(_mode)


QUESTION, LOW, HIGH = "Which documents speak of this?", ["thing", "that"], ["suppliers"]


def embedding_of(spark, d):
    """Stands for an embedding model: the stored vector that the length of the text picks."""
    return lambda text: probe_of(spark, d, len(text) % 50)


def legacy_store(spark, d):
    v = stored_vectors(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("document_id")), "id").filter("content IS NOT NULL")
    v = v.withColumn("name", F.concat(F.lit("s"), F.col("id") % 150 + 1))
    vertices = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.lit("SUPPLIER").alias("type"), F.concat(F.lit("nation "), "s_nationkey").alias("description"))
    return modes.Store(v, vertices, relations(spark, d).filter("description <> 'SUPPLIED_BY'"))


def legacy_sql(low, high, weighted=False):
    """Hits of chunks and of entities for the question with keywords, and the rows of both kinds."""
    vec = lambda words: f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {len(' '.join([QUESTION, *words])) % 50})"
    boost = "score * (1 + CASE WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in low or ["\x01"]) + " THEN 0.15 ELSE 0.0 END)" if weighted else "score"
    return f"""{RELATIONS_SQL}, st AS (SELECT e.vec_id AS id, d.text AS content, CASE WHEN d.doc_id % 3 > 0 THEN d.source END AS doc, e.label % 2 = 0 AS is_chunk, 's' || (e.vec_id % 150 + 1) AS name, e.embedding::DOUBLE[] AS v FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.text IS NOT NULL),
    c0 AS (SELECT id, content, doc, round(list_cosine_similarity(v, {vec(low)}), 6) AS score FROM st WHERE is_chunk ORDER BY score DESC, id LIMIT {12 if weighted else 6}),
    c AS (SELECT id, content, doc, round({boost}, 6) AS score FROM c0 ORDER BY score DESC, id LIMIT 6),
    ch AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS place, CASE WHEN doc IS NULL THEN content ELSE '[' || doc || '] ' || content END AS line FROM c),
    h AS (SELECT id, name, round(list_cosine_similarity(v, {vec(high)}), 6) AS score FROM st WHERE NOT is_chunk ORDER BY score DESC, id LIMIT 8),
    en AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS p0, name FROM h), ent AS (SELECT p0 AS place, name, 'nation ' || s_nationkey AS description FROM en JOIN supplier ON name = 's' || s_suppkey),
    rel AS (SELECT src, tgt, r.description, min(place) AS place FROM relations r JOIN ent ON name = src OR name = tgt WHERE r.description <> 'SUPPLIED_BY' GROUP BY ALL)"""


LOCAL_TEXT = "SELECT md5(coalesce(string_agg(line || chr(10) || chr(10), '' ORDER BY place), '')) AS digest, count(*) AS sources FROM ch"
GLOBAL_TEXT = "SELECT md5('Entities:' || chr(10) || (SELECT string_agg(name || ' (SUPPLIER): ' || description || chr(10), '' ORDER BY place) FROM ent) || chr(10) || 'Relationships:' || chr(10) || (SELECT string_agg('- ' || src || ' -> ' || tgt || ': ' || description || chr(10), '' ORDER BY place, src, tgt) FROM rel)) AS digest, (SELECT count(*) FROM ent) AS sources"


def _shown(result):
    return result.context.select(F.md5("text").alias("digest")).crossJoin(result.sources.agg(F.count("*").alias("sources")))


@query("legacy_local", f"WITH {legacy_sql(LOW, HIGH)} {LOCAL_TEXT}")
def legacy_local(spark, d):
    return _shown(legacy.local(legacy_store(spark, d), QUESTION, embedding_of(spark, d), modes.QueryParam(chunk_top_k=6), lambda _: LOW))


@query("legacy_local_weighted", f"WITH {legacy_sql(LOW, HIGH, True)} {LOCAL_TEXT}")
def legacy_local_weighted(spark, d):
    return _shown(legacy.local(legacy_store(spark, d), QUESTION, embedding_of(spark, d), modes.QueryParam(chunk_top_k=6, chunk_selection=" Weighted"), lambda _: LOW))


@query("legacy_global", f"WITH {legacy_sql(LOW, HIGH)} {GLOBAL_TEXT}")
def legacy_global(spark, d):
    return _shown(legacy.global_(legacy_store(spark, d), QUESTION, embedding_of(spark, d), modes.QueryParam(top_k=8), lambda _: HIGH))


@query(
    "legacy_hybrid",
    f"""WITH RECURSIVE {legacy_sql([], HIGH)}, i AS (SELECT place AS item, 0 AS src, line, CAST(ceil(length(line) / 4.0) AS BIGINT) AS tokens FROM ch UNION ALL SELECT place, 1, description, CAST(ceil(length(description) / 4.0) AS BIGINT) FROM ent),
    o AS (SELECT *, row_number() OVER (ORDER BY item, src) AS p FROM i),
    f AS (SELECT CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS used, 0 AS n, false AS kept UNION ALL SELECT o.p, CASE WHEN f.used + o.tokens + (f.n > 0)::INT <= 600 THEN f.used + o.tokens + (f.n > 0)::INT ELSE f.used END, f.n + (f.used + o.tokens + (f.n > 0)::INT <= 600)::INT, f.used + o.tokens + (f.n > 0)::INT <= 600 FROM f JOIN o ON o.p = f.p + 1),
    k AS (SELECT o.* FROM o JOIN f ON f.p = o.p WHERE f.kept), t AS (SELECT src, string_agg(line || chr(10) || chr(10), '' ORDER BY p) AS text FROM k GROUP BY src)
    SELECT md5(coalesce((SELECT 'Local Context (Text Chunks):' || chr(10) || text FROM t WHERE src = 0), '') || coalesce((SELECT 'Global Context (Knowledge Graph):' || chr(10) || text FROM t WHERE src = 1), '')) AS digest, (SELECT count(*) FROM i) AS sources""",
)
def legacy_hybrid(spark, d):
    """Without low-level keywords, as their extraction fails."""
    return _shown(legacy.hybrid(legacy_store(spark, d), QUESTION, embedding_of(spark, d), modes.QueryParam(chunk_top_k=6, top_k=8, max_tokens=600), lambda _: 1 / 0, lambda _: HIGH))


# --- more of the smaller operators ---------------------------------------------------------------------------------


@query("keywords_serialized", "SELECT doc_id, 'HIGH:' || lang || ',' || source || '|LOW:' || lang AS s, [lang, source] AS high, [lang] AS low FROM documents")
def keywords_serialized(spark, d):
    s = T.serialized_keywords(F.array("lang", "source"), F.array("lang"))
    high, low = T.parsed_keywords(s)
    return read(spark, d, "documents").select("doc_id", s.alias("s"), high.alias("high"), low.alias("low"))


@query("enhanced_query", "SELECT doc_id, 'what is new ' || lang || ' ' || source AS q FROM documents")
def enhanced_query(spark, d):
    return read(spark, d, "documents").select("doc_id", T.enhanced_query(F.lit("what is new"), F.array("lang", "source")).alias("q"))


@query("description_key", "SELECT p_partkey, sha256(p_name || p_brand || p_type) AS k FROM part")
def description_key(spark, d):
    return read(spark, d, "part").select("p_partkey", T.description_key(F.col("p_name"), F.array("p_brand", "p_type")).alias("k"))


WORDS_SQL = "w AS (SELECT conv_id * 1000 + turn AS chunk_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda x: x <> '') AS words FROM conversations), i AS (SELECT chunk_id, words, unnest(range(0, 4)) AS i FROM w), k AS (SELECT * FROM i WHERE i < len(words) AND len(list_distinct(words[1:i + 1])) = i + 1)"


def word_model(rows, place):
    """Stands for a model: its answer names one word of the content, by place, with a description as long as the place."""
    words = F.filter(F.split(F.regexp_replace(F.lower("content"), "[^a-z ]", ""), " "), lambda w: w != "")
    word = F.get(words, place)
    line = F.concat(F.lit("entity<|#|>"), word, F.lit("<|#|>WORD<|#|>n"), F.repeat(F.lit("x"), place), F.when(place > 0, F.concat(F.lit("\nrelation<|#|>"), F.get(words, F.lit(0)), F.lit("<|#|>"), word, F.lit("<|#|>near<|#|>next"))).otherwise(""))
    return rows.withColumn("response", F.coalesce(line, F.lit("nothing")))


def gleaned(spark, d):
    chunks = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("text").alias("content"))
    place = F.length(F.regexp_extract("previous", r"n(x*)(?:\n|$)", 1)) + 1
    return gleaning.glean(word_model(chunks, F.lit(0)), lambda rows: word_model(rows, place), 3)


@query("gleaned_entities", f"WITH {WORDS_SQL} SELECT chunk_id, words[i + 1] AS name, 'WORD' AS type, 'n' || repeat('x', i::INT) AS description FROM k")
def gleaned_entities(spark, d):
    return gleaned(spark, d)[0].select("chunk_id", F.lower("name").alias("name"), "type", "description")


@query("gleaned_relations", f"WITH {WORDS_SQL} SELECT chunk_id, words[1] AS src, words[i + 1] AS tgt, 'next' AS description FROM k WHERE i > 0")
def gleaned_relations(spark, d):
    return gleaned(spark, d)[1].select("chunk_id", F.lower("src").alias("src"), F.lower("tgt").alias("tgt"), "description")


@query("gleaning_passes", f"WITH {WORDS_SQL} SELECT w.chunk_id, CAST(coalesce(max(k.i), 0) AS INTEGER) AS passes FROM w LEFT JOIN k ON k.chunk_id = w.chunk_id GROUP BY w.chunk_id")
def gleaning_passes(spark, d):
    return gleaned(spark, d)[2]


def cached_extractions(spark, d):
    """What a model would have found in chunks: parts, their names and brands, and how these belong together."""
    part = read(spark, d, "part").withColumn("chunk_id", F.concat(F.lit("c"), F.col("p_partkey") % 300)).withColumn("seq", F.col("p_partkey"))
    own = F.concat(F.lit("Part "), F.col("p_partkey"))
    of = lambda name, kind, text: part.select("chunk_id", "seq", name.alias("name"), F.lit(kind).alias("type"), F.col(text).alias("description"))
    to = lambda src, tgt: part.select("chunk_id", "seq", src.alias("src"), tgt.alias("tgt"), F.col("p_type").alias("description"), F.col("p_brand").alias("keywords"), F.col("p_size").cast("double").alias("weight"))
    entities = of(own, "PART", "p_type").unionByName(of(F.col("p_name"), "NAME", "p_brand")).unionByName(of(F.col("p_brand"), "BRAND", "p_type"))
    chunks = part.groupBy(F.col("chunk_id").alias("id")).agg(F.max("p_name").alias("text"))
    return chunks, entities, to(own, F.col("p_name")).unionByName(to(F.col("p_name"), F.col("p_brand")))


def length_embedding(rows):
    """Stands for an embedding model: a vector of one number, the length of the text."""
    return rows.select("id", F.array(F.length("text").cast("double")).alias("vector"))


def after_deletion(spark, d):
    chunks, entities, relations_ = cached_extractions(spark, d)
    deleted = chunks.filter("cast(substr(id, 2) AS int) % 3 = 1").select(F.col("id").alias("chunk_id"))
    return rebuild.without_chunks(rebuild.build(chunks, entities, relations_, length_embedding), deleted, entities, relations_, length_embedding)


REST_SQL = """p AS (SELECT *, 'c' || (p_partkey % 300) AS chunk_id FROM part WHERE (p_partkey % 300) % 3 <> 1),
    e AS (SELECT chunk_id, p_partkey AS seq, lower(trim('Part ' || p_partkey)) AS name, 'PART' AS type, p_type AS description FROM p UNION ALL SELECT chunk_id, p_partkey, lower(trim(p_name)), 'NAME', p_brand FROM p UNION ALL SELECT chunk_id, p_partkey, lower(trim(p_brand)), 'BRAND', p_type FROM p),
    r AS (SELECT chunk_id, p_partkey AS seq, lower(trim('Part ' || p_partkey)) AS src, lower(trim(p_name)) AS tgt, p_type AS description, p_brand AS keywords, p_size AS weight FROM p UNION ALL SELECT chunk_id, p_partkey, lower(trim(p_name)), lower(trim(p_brand)), p_type, p_brand, p_size FROM p),
    v AS (SELECT name, first(type ORDER BY chunk_id, seq) AS type, string_agg(description, ' | ' ORDER BY chunk_id, seq) AS description, list_sort(list_distinct(list(chunk_id))) AS chunks FROM e GROUP BY name)"""


@query("vertices_after_deletion", f"WITH {REST_SQL} SELECT name, type, md5(description) AS digest, array_to_string(chunks, ',') AS chunks FROM v")
def vertices_after_deletion(spark, d):
    return after_deletion(spark, d).vertices.select("name", "type", F.md5("description").alias("digest"), F.array_join("source_chunk_ids", ",").alias("chunks"))


@query("edges_after_deletion", f"WITH {REST_SQL}, k AS (SELECT src, tgt, keywords, row_number() OVER (PARTITION BY src, tgt, keywords ORDER BY chunk_id, seq) AS n, chunk_id, seq FROM r) SELECT r.src, r.tgt, md5(string_agg(description, ' | ' ORDER BY chunk_id, seq)) AS digest, (SELECT string_agg(k.keywords, ', ' ORDER BY k.chunk_id, k.seq) FROM k WHERE k.src = r.src AND k.tgt = r.tgt AND n = 1) AS keywords, sum(weight)::DOUBLE AS weight, count(DISTINCT chunk_id) AS chunks FROM r GROUP BY r.src, r.tgt")
def edges_after_deletion(spark, d):
    return after_deletion(spark, d).edges.select("src", "tgt", F.md5("description").alias("digest"), "keywords", "weight", F.size("source_chunk_ids").cast("long").alias("chunks"))


@query("vectors_after_deletion", f"WITH {REST_SQL} SELECT 'chunk' AS kind, chunk_id AS id, length(max(p_name))::DOUBLE AS value FROM p GROUP BY chunk_id UNION ALL SELECT 'entity', name, length(name || chr(10) || description) FROM v")
def vectors_after_deletion(spark, d):
    return after_deletion(spark, d).vectors.select("kind", "id", F.get("vector", F.lit(0)).alias("value"))


LINES_SQL = "l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS line FROM documents), n AS (SELECT doc_id, count(*) AS lines, count_if(contains(line, 'license')) AS bad, count_if(regexp_matches(line, '^[A-Za-z]')) AS named FROM l GROUP BY doc_id)"


def ingested(spark, d):
    """All documents through the stream in a folder of its own; texts with a certain word make the model fail."""
    scratch = Scratch(spark, "ingest")
    scratch.save(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")), "in")

    def cut(docs):
        return docs.select("id", F.posexplode(F.filter(F.split("content", "\n"), lambda line: line != "")).alias("chunk_index", "content"))

    def embed(texts):
        if any("license" in t for t in texts):
            raise ValueError("no embedding")
        return [[float(len(t))] for t in texts]

    def extract(texts):
        return [f"entity<|#|>E<|#|>LINE<|#|>{len(t)}" if t[:1].isascii() and t[:1].isalpha() else "" for t in texts]

    ingest.ingest(spark, f"{scratch.path}/in", f"{scratch.path}/out", cut, embed, extract).awaitTermination()
    scratch.tables.add("out")
    return f"{scratch.path}/out"


@query("ingested_documents", f"WITH {LINES_SQL} SELECT d.doc_id::VARCHAR AS id, 1 AS attempt, CASE WHEN coalesce(bad, 0) = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN coalesce(bad, 0) = 0 THEN coalesce(lines, 0) ELSE 0 END AS chunk_count, CASE WHEN coalesce(bad, 0) = 0 THEN coalesce(named, 0) ELSE 0 END AS entity_count FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id")
def ingested_documents(spark, d):
    return ingest.statuses(spark, ingested(spark, d)).select("id", "attempt", "status", "chunk_count", "entity_count")


@query("ingested_vectors", f"WITH {LINES_SQL} SELECT l.doc_id::VARCHAR AS document_id, count(*) AS vectors, sum(length(line))::DOUBLE AS total FROM l JOIN n ON n.doc_id = l.doc_id WHERE bad = 0 GROUP BY l.doc_id")
def ingested_vectors(spark, d):
    rows = ingest.current(spark, ingested(spark, d), "vectors", "chunk_id string, document_id string, vector array<double>")
    return rows.groupBy("document_id").agg(F.count("*").alias("vectors"), F.sum(F.get("vector", F.lit(0))).alias("total"))


@query("legacy_tuples", "SELECT p_partkey, p_name AS name, p_type AS type, p_brand AS description FROM part")
def legacy_tuples(spark, d):
    text = F.concat(F.lit('x ("'), "p_name", F.lit('", "'), "p_type", F.lit('","'), "p_brand", F.lit('") y'))
    return read(spark, d, "part").select("p_partkey", F.inline(extraction.legacy_tuples(text)))


@query("extractor_dispatch", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'code' END AS extractor FROM documents")
def extractor_dispatch(spark, d):
    from .sources.files import extractor

    ending = F.element_at(F.array(*map(F.lit, (".MD", ".pdf", ".docx", ".java", ".unknown"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", extractor(F.concat(F.lit("file"), ending)).alias("extractor"))


@query("needs_summary", "SELECT conv_id, count(*) > 1 AND sum(CAST(ceil(length(text) / 4.0) AS INTEGER)) > 300 AS needs FROM conversations GROUP BY conv_id")
def needs_summary(spark, d):
    return lookups.needs_summary(turns(spark, d), ["conv_id"])


@query("rebuilt_descriptions", "SELECT lower(trim(p_name)) AS name, md5(string_agg(p_brand, ' | ' ORDER BY p_type, p_partkey, p_brand)) AS digest FROM part GROUP BY 1")
def rebuilt_descriptions(spark, d):
    cached = read(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("chunk_id"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("description"))
    names = cached.select(T.stored_name(F.col("name")).alias("name")).distinct()
    return lifecycle.rebuilt_descriptions(cached, names).select("name", F.md5("description").alias("digest"))


@query("cache_by_chunk", "SELECT c_nationkey AS chunk_id, count(*) AS entries, min(c_custkey) AS first FROM customer GROUP BY c_nationkey")
def cache_by_chunk(spark, d):
    return read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("chunk_id")).agg(F.count("*").alias("entries"), F.min("c_custkey").alias("first"))


@query("cache_store", "WITH n AS (SELECT o_custkey AS id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) SELECT 'k' || coalesce(c.c_custkey, n.id) AS content_hash, coalesce('first' || c.c_custkey, 'new' || n.o_orderkey) AS id, coalesce(n.o_orderpriority, c.c_mktsegment) AS result FROM customer c FULL JOIN (SELECT * FROM n WHERE k = 1) n ON n.id = c.c_custkey")
def cache_store(spark, d):
    key = lambda c: (F.lit("p").alias("project_id"), F.lit("SUMMARY").alias("cache_type"), F.concat(F.lit("k"), F.col(c).cast("string")).alias("content_hash"))
    old = read(spark, d, "customer").select(F.concat(F.lit("first"), F.col("c_custkey").cast("string")).alias("id"), *key("c_custkey"), F.lit("c").alias("chunk_id"), F.col("c_mktsegment").alias("result"))
    new = read(spark, d, "orders").select(F.concat(F.lit("new"), F.col("o_orderkey").cast("string")).alias("id"), *key("o_custkey"), F.lit("c").alias("chunk_id"), F.col("o_orderpriority").alias("result"), F.col("o_orderkey").alias("seq"))
    return cache.store(old, new, "seq").select("content_hash", "id", "result")


@query("cache_lookup", "SELECT l_orderkey, l_linenumber, o_orderpriority AS result FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'")
def cache_lookup(spark, d):
    key = lambda c: (F.lit("p").alias("project_id"), F.lit("T").alias("cache_type"), F.col(c).cast("string").alias("content_hash"))
    stored = read(spark, d, "orders").filter("o_orderstatus = 'F'").select(*key("o_orderkey"), F.col("o_orderpriority").alias("result"))
    return cache.lookup(stored, read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *key("l_orderkey"))).select("l_orderkey", "l_linenumber", "result")


@query("source_labels", "SELECT e.vec_id, coalesce(d.source, 'Unknown Document') || CASE WHEN e.label > 0 THEN ' - chunk ' || e.label ELSE '' END AS source FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
def source_labels(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return read(spark, d, "embeddings").select("vec_id", "label").join(docs, "vec_id", "left").select("vec_id", lookups.source_label(F.col("source"), F.col("label")).alias("source"))


@query("unprocessed_batch", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def unprocessed_batch(spark, d):
    from .streaming.claims import unprocessed

    status = F.when(F.col("o_orderstatus") == "O", "NOT_PROCESSED").otherwise("PROCESSED")
    return unprocessed(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at")), 25).select("id")


@query("utilization", f"WITH {TURNS} SELECT conv_id, round(sum(tokens) / 400.0, 6)::DOUBLE AS ratio FROM c GROUP BY conv_id")
def utilization(spark, d):
    return turns(spark, d).groupBy("conv_id").agg(F.sum("tokens").alias("t")).select("conv_id", F.round(budget.utilization(F.col("t"), 400), 6).alias("ratio"))


@query("code_declarations", "SELECT s_suppkey, unnest([2, 4]) AS line, unnest(['class', 'function']) AS kind, unnest(['S' || s_suppkey, 'run' || s_suppkey]) AS name FROM supplier")
def code_declarations(spark, d):
    key = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("import os\nclass S"), key, F.lit(":\n    x = 1\ndef run"), key, F.lit("():\n    return 1\n"))
    return code.declarations(read(spark, d, "supplier").select("s_suppkey", body.alias("body")), "s_suppkey", "body", "python")


@query("excel_cells", "SELECT doc_id, md5(CASE WHEN length(text) > 32767 THEN text[1:32764] || '...' ELSE text END) AS digest FROM documents")
def excel_cells(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(export.excel_cell(F.col("text"))).alias("digest"))


@query("content_encoding", "SELECT doc_id, 'UTF-8' AS encoding, length(text) - length(replace(text, chr(0), '')) > 10 AS is_binary FROM documents")
def content_encoding(spark, d):
    content = F.encode("text", "utf-8")
    return read(spark, d, "documents").select("doc_id", code.encoding(content).alias("encoding"), code.is_binary(F.lit("notes.txt"), F.substring(content, 1, 512)).alias("is_binary"))


# --- look-ups, tenants, codecs, prompts ----------------------------------------------------------------------------

#: Ids of projects for tests of names: a UUID made of a number, or something else.
PROJECT_SQL = "CASE WHEN {0} % 4 = 3 THEN 'project ' || {0} ELSE lpad(CAST({0} AS VARCHAR), 8, '0') || '-00aB-4000-8000-' || lpad(CAST({0} % 97 AS VARCHAR), 12, '0') END"


def project_id(key):
    text = F.col(key).cast("string")
    uuid = F.concat(F.lpad(text, 8, "0"), F.lit("-00aB-4000-8000-"), F.lpad((F.col(key) % 97).cast("string"), 12, "0"))
    return F.when(F.col(key) % 4 == 3, F.concat(F.lit("project "), text)).otherwise(uuid)


@query("graph_names", f"WITH p AS (SELECT c_custkey, {PROJECT_SQL.format('c_custkey')} AS project FROM customer) SELECT c_custkey, CASE WHEN project LIKE 'project%' THEN NULL ELSE 'graph_' || lower(replace(project, '-', '')) END AS graph, project NOT LIKE 'project%' AS valid FROM p")
def graph_names(spark, d):
    project = project_id("c_custkey")
    return read(spark, d, "customer").select("c_custkey", tenants.graph_name(project).alias("graph"), tenants.is_uuid(project).alias("valid"))


@query("tenant_edges", f"WITH {RELATIONS_SQL} SELECT src, tgt, weight FROM relations WHERE document_id = 'd3'")
def tenant_edges(spark, d):
    return graph.of_project(relations(spark, d).withColumnRenamed("document_id", "project_id"), "d3").select("src", "tgt", "weight")


@query("vectors_project_backfill", "SELECT v.vec_id AS id, coalesce(CASE WHEN v.vec_id % 3 = 0 THEN v.label END, d.n_chars % 5)::VARCHAR AS project_id FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id AND d.doc_id % 5 > 0")
def vectors_project_backfill(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("document_id"), F.when(F.col("vec_id") % 3 == 0, F.col("label").cast("long")).alias("project_id"))
    docs = read(spark, d, "documents").filter("doc_id % 5 > 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 5).cast("long").alias("project_id"))
    return tenants.with_project(v, docs).select("id", F.col("project_id").cast("string").alias("project_id"))


@query("vectors_without_document", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id * 3 NOT IN (SELECT doc_id FROM documents)")
def vectors_without_document(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 != 0, F.col("vec_id") * 3).alias("document_id"))
    return tenants.without_document(v, read(spark, d, "documents").select(F.col("doc_id").alias("id"))).select("id")


@query("schema_version", "SELECT max(label) AS version FROM embeddings")
def schema_version(spark, d):
    return tenants.schema_version(read(spark, d, "embeddings").select(F.col("label").alias("version")))


STATUS_SQL = "st AS (SELECT 'o' || o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'PROCESSED' WHEN 'P' THEN 'PROCESSING' ELSE 'PENDING' END AS processing_status FROM orders)"


def statuses(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "PROCESSED").when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("PENDING")
    return read(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("doc_id"), status.alias("processing_status"))


@query("status_by_id", f"WITH {STATUS_SQL} SELECT * FROM st WHERE doc_id = 'o7'")
def status_by_id(spark, d):
    return lookups.status_of(statuses(spark, d), "o7")


@query("status_by_list", f"WITH {STATUS_SQL} SELECT * FROM st WHERE doc_id IN (SELECT 'o' || l_orderkey FROM lineitem WHERE l_quantity > 48)")
def status_by_list(spark, d):
    return lookups.statuses_of(statuses(spark, d), read(spark, d, "lineitem").filter("l_quantity > 48").select(F.concat(F.lit("o"), "l_orderkey").alias("doc_id")))


@query("status_by_state", f"WITH {STATUS_SQL} SELECT * FROM st WHERE processing_status = 'PROCESSING'")
def status_by_state(spark, d):
    return lookups.in_status(statuses(spark, d), "PROCESSING")


@query("kv_multi_get", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def kv_multi_get(spark, d):
    kv = read(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), "c_custkey")
    keys = kv.join(read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("key")
    return lookups.get_many(kv.drop("c_custkey"), keys)


@query("kv_keys", "SELECT c_name AS key FROM customer WHERE c_name LIKE '%_1%' UNION ALL SELECT c_name FROM customer WHERE regexp_full_match(c_name, '.*00.2')")
def kv_keys(spark, d):
    kv = read(spark, d, "customer").select(F.col("c_name").alias("key"))
    return lookups.keys_like(kv, "*?1*").unionByName(lookups.keys_like(kv, "*00?2", whole=True))


@query("chunk_ids_of_document", "SELECT vec_id AS id FROM embeddings WHERE label % 2 = 0 AND vec_id % 10 = 3")
def chunk_ids_of_document(spark, d):
    return lookups.chunk_ids(stored_vectors(spark, d).withColumn("document_id", F.col("id") % 10), 3)


@query("documents_with_vectors", "SELECT d.doc_id AS document_id, d.doc_id IN (SELECT vec_id * 2 FROM embeddings WHERE label % 2 = 0) AS chunk, d.doc_id IN (SELECT vec_id * 2 FROM embeddings) AS any_type FROM documents d")
def documents_with_vectors(spark, d):
    v, docs = stored_vectors(spark, d).withColumn("document_id", F.col("id") * 2), read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    one, every = lookups.has_vectors(v, docs), lookups.has_vectors(v, docs, None)
    return one.withColumnRenamed("has_vectors", "chunk").join(every.withColumnRenamed("has_vectors", "any_type"), "document_id")


@query("citable_sources", f"WITH h AS (SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'chunk' ELSE 'entity' END AS type, CASE WHEN vec_id % 5 > 0 THEN {PROJECT_SQL.format('vec_id')} END AS document_id, label AS number, vec_id / 4096.0 AS score FROM embeddings), f AS (SELECT {PROJECT_SQL.format('doc_id')} AS document_id, source FROM documents WHERE doc_id % 2 = 0) SELECT CAST(NULL AS VARCHAR) AS id, 'answer' AS source, 'All in all.' AS content, 0.0::DOUBLE AS score UNION ALL SELECT CAST(h.id AS VARCHAR), coalesce(f.source, 'Unknown Document') || CASE WHEN number > 0 THEN ' - chunk ' || number ELSE '' END, 'text ' || h.id, score::DOUBLE FROM h LEFT JOIN f USING (document_id) WHERE type <> 'entity' AND document_id IS NOT NULL AND document_id NOT LIKE 'project%'")
def citable_sources(spark, d):
    v = stored_vectors(spark, d).select("id", "type", F.when(F.col("id") % 5 > 0, project_id("id")).alias("document_id"), F.col("project_id").alias("number"), F.concat(F.lit("text "), "id").alias("content"), (F.col("id") / F.lit(4096.0)).alias("score"))
    docs = read(spark, d, "documents").filter("doc_id % 2 = 0").select(project_id("doc_id").alias("id"), F.col("source").alias("file_name"))
    return lookups.labelled_sources(v, docs, F.lit("All in all."))


@query("extractions_by_chunk", "SELECT c_nationkey AS chunk_id, md5(string_agg(c_name || '=' || c_mktsegment, ';' ORDER BY c_custkey)) AS digest FROM customer GROUP BY c_nationkey")
def extractions_by_chunk(spark, d):
    cached = read(spark, d, "customer").select(F.col("c_nationkey").alias("chunk_id"), "c_custkey", "c_name", "c_mktsegment")
    line = F.array_join(F.transform("entries", lambda e: F.concat(e["c_name"], F.lit("="), e["c_mktsegment"])), ";")
    return lookups.by_chunk(cached, "c_custkey").select("chunk_id", F.md5(line).alias("digest"))


@query("keyword_cache_key", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE source END || ':' || sha256(lang || ' ' || text) AS k FROM documents")
def keyword_cache_key(spark, d):
    return read(spark, d, "documents").select("doc_id", cache.keyword_key(F.concat_ws(" ", "lang", "text"), F.when(F.col("doc_id") % 3 != 0, F.col("source"))).alias("k"))


@query("answer_json_round_trip", "SELECT conv_id, turn, text AS answer, 'MIX' AS mode, turn AS sources FROM conversations")
def answer_json_round_trip(spark, d):
    rows = read(spark, d, "conversations").withColumn("json", cache.answer_json(F.col("text"), F.lit("mix"), F.col("turn")))
    back = cache.parsed_answer(F.col("json"))
    return rows.select("conv_id", "turn", back["answer"].alias("answer"), back["mode"].alias("mode"), back["totalSources"].alias("sources"))


@query("cache_invalidate", "SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src1'")
def cache_invalidate(spark, d):
    return cache.invalidated(read(spark, d, "documents").withColumn("project_id", F.col("source")), "src1").select("doc_id")


@query("vector_base64", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, CAST(ceil(len(embedding) * 4 / 3.0) AS BIGINT) AS least, true AS same FROM embeddings")
def vector_base64(spark, d):
    rows = vectors.base64_vectors(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", "b64")
    back = vectors.vectors_of_base64(rows, "b64", "v")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", F.round(total, 4).alias("total"), F.ceil(F.size("v") * 4 / F.lit(3.0)).alias("least"), (F.col("v") == F.col("embedding").cast("array<float>")).alias("same"))


@query("legacy_relation_tuples", "SELECT p_partkey, p_name AS src, p_type AS tgt, p_brand AS description, 'k' || p_size AS keywords, p_size / 2.0::DOUBLE AS weight FROM part WHERE p_partkey % 3 > 0")
def legacy_relation_tuples(spark, d):
    text = F.concat(F.lit('("a", "b", "c") and ("'), "p_name", F.lit('", "'), "p_type", F.lit('","'), "p_brand", F.lit('",  "k'), F.col("p_size").cast("string"), F.lit('", '), F.format_string("%.1f", F.col("p_size") / 2.0), F.when(F.col("p_partkey") % 3 > 0, ")").otherwise("]"))
    return read(spark, d, "part").select("p_partkey", F.inline(extraction.legacy_relations(text)))


@query("would_exceed", f"WITH {TURNS} SELECT conv_id, turn, 380 + tokens > 400 AS over FROM c")
def would_exceed(spark, d):
    return turns(spark, d).select("conv_id", "turn", budget.would_exceed(F.lit(380), F.col("tokens"), 400).alias("over"))


@query("bfs_incident", f"WITH RECURSIVE {RELATIONS_SQL}, {WALK}, w AS (SELECT 'n1' AS name, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.name WHERE w.depth < 1), s AS (SELECT name FROM w GROUP BY name HAVING min(depth) < 2) SELECT src, tgt FROM relations WHERE src IN (SELECT name FROM s) OR tgt IN (SELECT name FROM s)")
def bfs_incident(spark, d):
    return graph.reached(all_vertices(spark, d), relations(spark, d), "N1 ", 2, near=adjacency(spark, d))[1].select("src", "tgt")


@query("bfs_of_missing_start", f"WITH {RELATIONS_SQL} SELECT src, tgt FROM relations WHERE src = 's1' OR tgt = 's1'")
def bfs_of_missing_start(spark, d):
    return graph.reached(all_vertices(spark, d).filter("name <> 's1'"), relations(spark, d), "s1", 1, near=adjacency(spark, d))[1].select("src", "tgt")


KINDS_SQL = "CASE role WHEN 'system' THEN 'entity' WHEN 'user' THEN 'relation' ELSE 'chunk' END"


def prompt_items(spark, d):
    kind = F.when(F.col("role") == "system", "entity").when(F.col("role") == "user", "relation").otherwise("chunk")
    return read(spark, d, "conversations").select("conv_id", F.col("turn").alias("place"), kind.alias("type"), F.col("text").alias("content"))


@query("prompt_grouped", f"WITH i AS (SELECT conv_id, turn, {KINDS_SQL} AS type, text FROM conversations), s AS (SELECT conv_id, type, string_agg('- ' || text || chr(10), '' ORDER BY turn) AS body FROM i GROUP BY conv_id, type) SELECT conv_id, md5(string_agg(CASE type WHEN 'entity' THEN '### Entities' WHEN 'relation' THEN '### Relations' ELSE '### Sources' END || chr(10) || body || chr(10), '' ORDER BY CASE type WHEN 'entity' THEN 0 WHEN 'relation' THEN 1 ELSE 2 END)) AS digest FROM s GROUP BY conv_id")
def prompt_grouped(spark, d):
    return modes.item_text(prompt_items(spark, d), ["conv_id"]).select("conv_id", F.md5("text").alias("digest"))


@query("prompt_flat", f"WITH i AS (SELECT conv_id, turn, {KINDS_SQL} AS type, text FROM conversations) SELECT conv_id, md5(string_agg(CASE type WHEN 'entity' THEN '[Entity] ' WHEN 'relation' THEN '[Relation] ' ELSE '[Source] ' END || text || chr(10) || chr(10), '' ORDER BY turn)) AS digest FROM i GROUP BY conv_id")
def prompt_flat(spark, d):
    return modes.item_text(prompt_items(spark, d), ["conv_id"], grouped=False).select("conv_id", F.md5("text").alias("digest"))


# --- upserts, merges and summaries ---------------------------------------------------------------------------------


def _supplier_vertices(spark, d):
    return read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.lit("SUPPLIER").alias("type"), F.concat(F.lit("nation "), "s_nationkey").alias("description"), F.array(F.lit("c1")).alias("source_chunk_ids"))


@query("upsert_entities", "WITH n AS (SELECT 's' || (c_custkey % 150) AS name, c_mktsegment AS description, row_number() OVER (PARTITION BY c_custkey % 150 ORDER BY c_custkey DESC) AS k FROM customer) SELECT 's' || s_suppkey AS name, 'SUPPLIER' AS type, 'nation ' || s_nationkey AS description FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT name FROM n) UNION ALL SELECT name, 'CUSTOMER', description FROM n WHERE k = 1")
def upsert_entities(spark, d):
    new = read(spark, d, "customer").select(F.concat(F.lit("  S"), F.col("c_custkey") % 150).alias("name"), F.lit("CUSTOMER").alias("type"), F.col("c_mktsegment").alias("description"), F.array(F.lit("c2")).alias("source_chunk_ids"), "c_custkey")
    return lifecycle.upsert_entities(_supplier_vertices(spark, d), new, "c_custkey").select("name", "type", "description")


NEW_EDGES_SQL = "n AS (SELECT 's' || (c_custkey % 120 + 1) AS src, 'n' || c_nationkey AS tgt, c_mktsegment AS description, row_number() OVER (PARTITION BY c_custkey % 120, c_nationkey ORDER BY c_custkey DESC) AS k FROM customer)"


def _upserted(spark, d):
    edges = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("tgt"), F.lit("LOCATED_IN").alias("description"))
    new = read(spark, d, "customer").select(F.concat(F.lit("S"), F.col("c_custkey") % 120 + 1).alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("tgt"), F.col("c_mktsegment").alias("description"), "c_custkey")
    return lifecycle.upsert_relations(_supplier_vertices(spark, d), edges, new, "c_custkey", auto_vertices=True)


@query("upsert_relations", f"WITH {NEW_EDGES_SQL} SELECT src, tgt, description FROM n WHERE k = 1 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN' FROM supplier WHERE ('s' || s_suppkey, 'n' || s_nationkey) NOT IN (SELECT (src, tgt) FROM n)")
def upsert_relations(spark, d):
    return _upserted(spark, d)[1]


@query("auto_vertices", f"WITH {NEW_EDGES_SQL}, e AS (SELECT src AS name FROM n UNION SELECT tgt FROM n) SELECT name, 'UNKNOWN' AS type FROM e WHERE name NOT IN (SELECT 's' || s_suppkey FROM supplier) UNION ALL SELECT 's' || s_suppkey, 'SUPPLIER' FROM supplier")
def auto_vertices(spark, d):
    return _upserted(spark, d)[0].select("name", "type")


@query("update_descriptions", "SELECT 's' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_suppkey ELSE 'nation ' || s_nationkey END AS description FROM supplier")
def update_descriptions(spark, d):
    new = read(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit(" S"), "s_suppkey").alias("name"), F.concat(F.lit("new "), "s_suppkey").alias("description"), F.array(F.lit("c9")).alias("source_chunk_ids"))
    return lifecycle.update_description(_supplier_vertices(spark, d), new).select("name", "description")


@query("delete_by_key", "SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS tgt FROM supplier WHERE s_suppkey % 4 <> 1")
def delete_by_key(spark, d):
    s = read(spark, d, "supplier")
    key = F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("S"), "s_suppkey", F.lit("->n"), "s_nationkey")).otherwise(F.concat(F.lit("s"), "s_suppkey", F.lit("->n->x")))
    edges = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("tgt"))
    return lifecycle.delete_relations(edges, s.select(key.alias("key")))


@query("new_entities_count", "SELECT count(*) AS new FROM part WHERE lower(p_brand) NOT IN (SELECT lower(p_brand) FROM part WHERE p_partkey <= 5)")
def new_entities_count(spark, d):
    p = read(spark, d, "part")
    return lifecycle.new_count(p.filter("p_partkey <= 5").select(F.upper("p_brand").alias("name")), p.select(F.col("p_brand").alias("name")), "name")


@query(
    "summaries_in_groups",
    """WITH RECURSIVE r AS (SELECT 0 AS turn, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_name AS text FROM part WHERE p_partkey % 3 > 0 OR p_size < 10
      UNION ALL SELECT turn + 1, p_brand, g + 1, CASE WHEN count(*) = 1 THEN first(text) ELSE '(' || string_agg(text, '+' ORDER BY n) || ')' END
      FROM (SELECT *, CASE WHEN size <= 10 THEN 0 ELSE (n - 1) // 5 END AS g FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS size FROM r) WHERE size > 1) GROUP BY turn, p_brand, g)
    SELECT p_brand, md5(arg_max(text, turn)) AS digest FROM r GROUP BY p_brand""",
)
def summaries_in_groups(spark, d):
    """The stand-in for a model puts brackets around each group."""
    rows = read(spark, d, "part").filter("p_partkey % 3 > 0 OR p_size < 10").select("p_brand", "p_partkey", F.col("p_name").alias("description"))
    return modes.summarize(rows, ["p_brand"], "p_partkey", lambda texts: F.concat(F.lit("("), F.array_join(texts, "+"), F.lit(")"))).select("p_brand", F.md5("description").alias("digest"))


@query("code_files", f"WITH {FILES_SQL} SELECT doc_id, regexp_extract(lower(name), '\\.([^.]+)$', 1) IN ('java', 'py', 'sql', 'clj', 'json', 'rs', 'toml', 'ts', 'sol', 'f90') AS is_code FROM files".replace("\\\\", "\\"))
def code_files_flag(spark, d):
    return code_files(spark, d).select("doc_id", code.is_code(F.col("name")).alias("is_code"))


@query("redirected_edges", "WITH e AS (SELECT CASE WHEN s_suppkey % 10 < 4 THEN 'hub' ELSE 's' || s_suppkey END AS src, CASE WHEN s_nationkey = 3 THEN 'hub' ELSE 'n' || s_nationkey END AS tgt FROM supplier) SELECT src, tgt, count(*) AS n FROM e WHERE src <> tgt GROUP BY ALL")
def redirected_edges(spark, d):
    s = read(spark, d, "supplier")
    edges = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("tgt"))
    mapping = s.filter("s_suppkey % 10 < 4").select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.lit("hub").alias("target")).unionByName(spark.createDataFrame([("n3", "hub")], "name string, target string"))
    return merge.redirect(edges, mapping).groupBy("src", "tgt").agg(F.count("*").alias("n"))


@query("merged_texts", "SELECT p_brand, first(p_name ORDER BY p_partkey) AS first, first(p_name ORDER BY length(p_name) DESC, p_partkey) AS longest FROM part GROUP BY p_brand")
def merged_texts(spark, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    rows = read(spark, d, "part").groupBy("p_brand").agg(texts.alias("t"))
    return rows.select("p_brand", merge.merged_text(F.col("t"), "KEEP_FIRST").alias("first"), merge.merged_text(F.col("t"), "KEEP_LONGEST").alias("longest"))


@query("export_round_trip", "SELECT 'd3' AS project, count(*) AS n, count(DISTINCT s_suppkey) AS ids FROM supplier WHERE s_suppkey % 10 = 3")
def export_round_trip(spark, d):
    from .plans.scratch import Scratch

    scratch = Scratch(spark, "export")
    table = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("d"), F.col("s_suppkey") % 10).alias("project_id"))
    export.export_project({"suppliers": table}, "d3", scratch.path)
    scratch.tables.add("suppliers")
    back = export.import_project(spark, scratch.path, ["suppliers"], "d3")["suppliers"]
    return back.groupBy(F.col("project_id").alias("project")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
