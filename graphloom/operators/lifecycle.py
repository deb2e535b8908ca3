"""Upserts, deletes and rebuilds. Tables are immutable; each operation gives a new frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import stored_name


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of `new` replace those of the same key; of several new rows with one key the last by `order` wins."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    last = new.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")
    kept = old.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.select(old.columns))


def upsert_keeping(old: DataFrame, new: DataFrame, key: list[str], order: str, kept_columns: list[str]) -> DataFrame:
    """The same, but columns such as an id keep the value of the row that was there first."""
    first = old.select(*key, *[F.col(c).alias(f"_{c}") for c in kept_columns])
    out = upsert(old, new, key, order).join(first, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in kept_columns else F.col(c) for c in old.columns])


def upsert_entities(vertices: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """By stored name; all columns are replaced."""
    return upsert(vertices, new.withColumn("name", stored_name(F.col("name"))), ["name"], order)


def upsert_relations(vertices: DataFrame, edges: DataFrame, new: DataFrame, order: str, auto_vertices: bool = False) -> tuple[DataFrame, DataFrame]:
    """By ordered pair of stored names. With auto_vertices missing endpoints become vertices of type UNKNOWN."""
    new = new.withColumn("src", stored_name(F.col("src"))).withColumn("tgt", stored_name(F.col("tgt")))
    out = upsert(edges, new, ["src", "tgt"], order)
    if auto_vertices:
        ends = new.select(F.explode(F.array("src", "tgt")).alias("name")).distinct().join(vertices.select("name"), "name", "left_anti")
        blank = {"type": F.lit("UNKNOWN"), "description": F.lit(""), "source_chunk_ids": F.expr("cast(array() AS array<string>)")}
        vertices = vertices.unionByName(ends.select(*[F.col("name") if c == "name" else blank.get(c, F.lit(None).cast(vertices.schema[c].dataType)).alias(c) for c in vertices.columns]))
    return vertices, out


def classify(rows: DataFrame, deleted: Column) -> DataFrame:
    """What deleting chunks means for each row: NO_CHANGE, FULL_DELETE or REBUILD, and the ids that remain."""
    ids = F.coalesce("source_chunk_ids", F.expr("cast(array() AS array<string>)"))
    gone, left = F.size(F.array_intersect(ids, deleted)), F.array_except(ids, deleted)
    return rows.withColumn("action", F.when(gone == 0, "NO_CHANGE").when(F.size(left) == 0, "FULL_DELETE").otherwise("REBUILD")).withColumn("remaining", left)


def delete_document(vertices: DataFrame, edges: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """Without the document's rows; edges whose vertices go also go."""
    gone = vertices.filter(F.col("document_id") == document_id).select("name")
    return vertices.filter(~F.col("document_id").eqNullSafe(document_id)), cascade(edges.filter(~F.col("document_id").eqNullSafe(document_id)), gone)


def cascade(edges: DataFrame, gone: DataFrame) -> DataFrame:
    out = edges.join(gone.select(F.col("name").alias("src")), "src", "left_anti")
    return out.join(gone.select(F.col("name").alias("tgt")), "tgt", "left_anti")


def delete_entities(vertices: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = names.select(stored_name(F.col("name")).alias("name")).distinct()
    return vertices.join(gone, "name", "left_anti"), cascade(edges, gone)


def delete_relations(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys are `src->tgt`; others are passed over."""
    parts = F.split("key", "->")
    pairs = keys.filter(F.size(parts) == 2).select(stored_name(parts[0]).alias("src"), stored_name(parts[1]).alias("tgt")).distinct()
    return edges.join(pairs, ["src", "tgt"], "left_anti")


def update_description(vertices: DataFrame, updates: DataFrame) -> DataFrame:
    u = updates.select(stored_name(F.col("name")).alias("name"), F.col("description").alias("_d"), F.col("source_chunk_ids").alias("_c"))
    return vertices.join(u, "name", "left").select(*[F.coalesce("_d", c).alias(c) if c == "description" else F.coalesce("_c", c).alias(c) if c == "source_chunk_ids" else F.col(c) for c in vertices.columns])


def rebuilt_descriptions(cached: DataFrame, names: DataFrame) -> DataFrame:
    """Descriptions of cached extractions (chunk_id, seq, name, description) joined in order, for each name."""
    rows = cached.select(stored_name(F.col("name")).alias("name"), "chunk_id", "seq", "description").filter("trim(description) <> ''").join(names, "name", "left_semi")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "seq", "description"))), lambda r: r["description"])
    return rows.groupBy("name").agg(F.array_join(texts, " | ").alias("description"))


def delete_chunks(vertices: DataFrame, edges: DataFrame, deleted: Column, cached: DataFrame | None = None, skip_rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph without deleted chunks: rows without other sources go, the others are rebuilt from cached extractions
    of what remains, or keep their text."""
    v, e = classify(vertices, deleted), classify(edges, deleted)
    gone = v.filter("action = 'FULL_DELETE'").select("name")
    kept = v.filter("action <> 'FULL_DELETE'").withColumn("source_chunk_ids", F.when(F.col("action") == "REBUILD", F.col("remaining")).otherwise(F.col("source_chunk_ids")))
    if cached is not None and not skip_rebuild:
        ids = kept.filter("action = 'REBUILD'").select("name")
        new = rebuilt_descriptions(cached.filter(~F.array_contains(deleted, F.col("chunk_id"))), ids).withColumnRenamed("description", "_d")
        kept = kept.join(new, "name", "left").withColumn("description", F.coalesce("_d", "description"))
    left = e.filter("action <> 'FULL_DELETE'").withColumn("source_chunk_ids", F.when(F.col("action") == "REBUILD", F.col("remaining")).otherwise(F.col("source_chunk_ids")))
    return kept.select(vertices.columns), cascade(left.select(edges.columns), gone)


def new_count(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """How many found rows have a key, in any case, that is not known; doubles count each."""
    return found.select(F.lower(key).alias("k")).join(known.select(F.lower(key).alias("k")).distinct(), "k", "left_anti").agg(F.count("*").alias("new"))
