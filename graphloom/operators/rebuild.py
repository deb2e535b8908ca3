"""A graph built from cached extractions, and kept right when chunks go: only what depends on them is computed anew."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import stored_name

from .lifecycle import cascade
from .merge import SEPARATOR


@dataclass
class Tables:
    """vertices (name, type, description, source_chunk_ids), edges (src, tgt, description, keywords, weight, source_chunk_ids), and
    vectors (kind, id, vector): of chunks by their id, of entities by their name."""

    vertices: DataFrame
    edges: DataFrame
    vectors: DataFrame


def _in_order(rows: DataFrame, key: list[str], texts: dict[str, bool]) -> DataFrame:
    """For each key its texts joined in the order of (chunk_id, seq), whether all or distinct ones, and its chunk ids.

    Texts of a key are joined by chunk first and then by key, so that no task sorts all rows of a hub."""
    field = lambda rows, c: F.transform(rows, lambda r: r[c])
    each = lambda c: field(F.array_sort(F.collect_list(F.struct("seq", c))), c)
    parts = rows.groupBy(*key, "chunk_id").agg(*[each(c).alias(c) for c in texts])
    whole = F.array_sort(F.collect_list(F.struct("chunk_id", *texts)))
    out = parts.groupBy(*key).agg(whole.alias("_p"))
    for c, distinct in texts.items():
        every = F.filter(F.flatten(field("_p", c)), lambda t: F.trim(t) != "")
        out = out.withColumn(c, F.array_distinct(every) if distinct else every)
    return out.withColumn("source_chunk_ids", field("_p", "chunk_id")).drop("_p")


def vertices_of(entities: DataFrame) -> DataFrame:
    """Vertices of cached entities (chunk_id, seq, name, type, description): descriptions in order, the first type that is not
    blank. Rows without a chunk are of none and left out."""
    rows = entities.select(stored_name(F.col("name")).alias("name"), "chunk_id", "seq", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description"))
    found = _in_order(rows.filter("chunk_id IS NOT NULL AND name <> ''"), ["name"], {"type": False, "description": False})
    kind = F.coalesce(F.get("type", F.lit(0)), F.lit("UNKNOWN"))
    return found.select("name", kind.alias("type"), F.array_join("description", SEPARATOR).alias("description"), "source_chunk_ids")


def edges_of(relations: DataFrame) -> DataFrame:
    """Edges of cached relations (chunk_id, seq, src, tgt, description, keywords, weight): weights add up."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = relations.select(*[stored_name(F.col(c)).alias(c) for c in ("src", "tgt")], "chunk_id", "seq", text("description"), text("keywords"), "weight")
    rows = rows.filter("chunk_id IS NOT NULL AND src <> '' AND tgt <> '' AND src <> tgt")
    weights = rows.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"))
    found = _in_order(rows, ["src", "tgt"], {"description": False, "keywords": True}).join(weights, ["src", "tgt"])
    return found.select("src", "tgt", F.array_join("description", SEPARATOR).alias("description"), F.array_join("keywords", ", ").alias("keywords"), "weight", "source_chunk_ids")


def _inner(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    names = vertices.select("name")
    return edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "tgt"), "tgt", "left_semi")


def build(chunks: DataFrame, entities: DataFrame, relations: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> Tables:
    """All tables from chunks (id, text) and cached extractions. embed gives (id, vector) for rows (id, text). Edges need both
    of their vertices."""
    vertices = vertices_of(entities)
    return Tables(vertices, _inner(edges_of(relations), vertices), _vectors(chunks, "chunk", embed).unionByName(_vectors(_texts(vertices), "entity", embed)))


def _texts(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("name").alias("id"), F.concat_ws("\n", "name", "description").alias("text"))


def _vectors(rows: DataFrame, kind: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return embed(rows.select(F.col("id").cast("string").alias("id"), "text")).select(F.lit(kind).alias("kind"), "id", "vector")


def without_chunks(tables: Tables, deleted: DataFrame, entities: DataFrame, relations: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> Tables:
    """The tables without deleted chunks (chunk_id), as a build from the rest gives them.

    What changes runs along dependencies: chunks to the names and pairs they mention, these to their vertices, edges and
    vectors. Untouched rows are passed on; touched ones are built from the extractions that remain, and those with none go,
    with their edges and vectors. An edge that lacked a vertex before is not looked for again, as deletion adds none.
    """
    gone_chunks = deleted.select("chunk_id").distinct()
    mentions = entities.select("*", stored_name(F.col("name")).alias("_name"))
    pairs = relations.select("*", stored_name(F.col("src")).alias("_src"), stored_name(F.col("tgt")).alias("_tgt"))
    names = mentions.join(gone_chunks, "chunk_id", "left_semi").select("_name").distinct()
    touched = pairs.join(gone_chunks, "chunk_id", "left_semi").select("_src", "_tgt").distinct()
    again = vertices_of(mentions.join(gone_chunks, "chunk_id", "left_anti").join(names, "_name", "left_semi").select(entities.columns))
    vertices = tables.vertices.join(names.withColumnRenamed("_name", "name"), "name", "left_anti").select(again.columns).unionByName(again)
    gone = names.select(F.col("_name").alias("name")).join(again, "name", "left_anti")
    rest = pairs.join(gone_chunks, "chunk_id", "left_anti").join(touched, ["_src", "_tgt"], "left_semi").select(relations.columns)
    changed = edges_of(rest)
    kept = tables.edges.join(touched.toDF("src", "tgt"), ["src", "tgt"], "left_anti").select(changed.columns)
    edges = cascade(kept, gone).unionByName(_inner(changed, vertices))
    dead = gone_chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("id")).unionByName(names.select(F.lit("entity").alias("kind"), F.col("_name").alias("id")))
    vectors = tables.vectors.join(dead, ["kind", "id"], "left_anti").select("kind", "id", "vector").unionByName(_vectors(_texts(again), "entity", embed))
    return Tables(vertices, edges, vectors)


def merged_vectors(vectors: DataFrame, vertices: DataFrame, sources: DataFrame, target: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors after a merge of entities (sources: name) into a target: those of the sources and the target's old one go, the
    target's new text is embedded."""
    dead = sources.select(F.lit("entity").alias("kind"), stored_name(F.col("name")).alias("id")).unionByName(sources.sparkSession.range(1).select(F.lit("entity").alias("kind"), stored_name(F.lit(target)).alias("id"))).distinct()
    fresh = _texts(vertices.filter(stored_name(F.col("name")) == stored_name(F.lit(target))))
    return vectors.join(dead, ["kind", "id"], "left_anti").select("kind", "id", "vector").unionByName(_vectors(fresh, "entity", embed))
