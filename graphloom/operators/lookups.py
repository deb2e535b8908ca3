"""Look-ups of statuses, keys, chunks and sources, counts by project, and token usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import glob_like, glob_regex

from .tenants import is_uuid


def status_of(statuses: DataFrame, doc_id: str) -> DataFrame:
    return statuses.filter(F.col("doc_id") == doc_id)


def statuses_of(statuses: DataFrame, ids: DataFrame) -> DataFrame:
    return statuses.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def in_status(statuses: DataFrame, status: str) -> DataFrame:
    return statuses.filter(F.col("processing_status") == status)


def get(kv: DataFrame, key: str) -> DataFrame:
    return kv.filter(F.col("key") == key)


def get_many(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select("key").distinct(), "key", "left_semi")


def keys_like(kv: DataFrame, pattern: str | None = None, whole: bool = False) -> DataFrame:
    """Keys by a pattern with * and ?; whole: as a regular expression of the whole key, where % and _ mean themselves."""
    if pattern is None:
        return kv.select("key")
    return kv.filter(F.col("key").rlike(glob_regex([pattern])) if whole else F.col("key").like(glob_like(pattern))).select("key")


def read_json_kv(spark: SparkSession, path: str) -> DataFrame:
    """Keys and values of JSON files that are one object each: (key, value as JSON text)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def write_json_kv(kv: DataFrame, path: str) -> None:
    """One object per partition; values are JSON text, or strings."""
    parsed = F.coalesce(F.when(F.get_json_object("value", "$").isNotNull(), F.get_json_object("value", "$")), F.to_json(F.array("value")))
    value = F.when(F.col("value").rlike(r"^\s*[\[{]"), parsed).otherwise(F.regexp_extract(F.to_json(F.array("value")), r"(?s)^\[(.*)\]$", 1))
    key = F.regexp_extract(F.to_json(F.array("key")), r"(?s)^\[(.*)\]$", 1)
    lines = kv.groupBy(F.spark_partition_id().alias("_p")).agg(F.array_sort(F.collect_list(F.concat(key, F.lit(" : "), value))).alias("rows"))
    lines.select(F.concat(F.lit("{\n  "), F.array_join("rows", ",\n  "), F.lit("\n}"))).write.mode("overwrite").option("lineSep", "\n").text(path)


def chunk_ids(vectors: DataFrame, document_id) -> DataFrame:
    """Ids of a document's chunks."""
    return vectors.filter((F.col("document_id") == document_id) & (F.col("type") == "chunk")).select("id")


def has_vectors(vectors: DataFrame, documents: DataFrame, kind: str | None = "chunk") -> DataFrame:
    """For each document id whether it has vectors, of a type or (None) of any."""
    some = vectors if kind is None else vectors.filter(F.col("type") == kind)
    found = some.select("document_id").distinct().withColumn("has_vectors", F.lit(True))
    return documents.select(F.col("id").alias("document_id")).join(found, "document_id", "left").withColumn("has_vectors", F.coalesce("has_vectors", F.lit(False)))


def counts(table: DataFrame, *by: str) -> DataFrame:
    return table.groupBy(*by).agg(F.count("*").alias("n"))


def by_chunk(cached: DataFrame, order: str) -> DataFrame:
    """Cached extractions of each chunk in order: chunk_id, entries."""
    rows = [c for c in cached.columns if c not in ("chunk_id", order)]
    return cached.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(order, *rows))).alias("entries"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens of each operation, from (op, input_tokens, output_tokens)."""
    return calls.groupBy("op").agg(F.count("*").alias("calls"), F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"))


def usage_string(totals: DataFrame) -> DataFrame:
    """`op:calls:in:out` of all operations, comma-joined in order of the operation."""
    rows = totals.agg(F.array_sort(F.collect_list(F.concat_ws(":", "op", "calls", "input_tokens", "output_tokens"))).alias("r"))
    return rows.select(F.array_join("r", ",").alias("breakdown"))


def needs_summary(rows: DataFrame, by: list[str], threshold: int = 300) -> DataFrame:
    """Whether descriptions of a key, with their tokens, are several and more than the threshold together."""
    return rows.groupBy(*by).agg(((F.count("*") > 1) & (F.sum("tokens") > threshold)).alias("needs"))


def source_label(name: Column, number: Column) -> Column:
    """File name of a chunk, with its number if it has one."""
    return F.concat(F.coalesce(name, F.lit("Unknown Document")), F.when(number > 0, F.concat(F.lit(" - chunk "), number.cast("string"))).otherwise(""))


def labelled_sources(hits: DataFrame, documents: DataFrame, answer: Column | None = None) -> DataFrame:
    """Sources that may be cited (id, source, content, score): no entities, a document's UUID; its file name by a left
    join. An answer, if given, comes first at distance 0.

    hits: id, type, document_id, number, content, score; documents: id, file_name.
    """
    kept = hits.filter((F.col("type") != "entity") & is_uuid(F.col("document_id")))
    names = documents.select(F.col("id").alias("document_id"), "file_name")
    rows = kept.join(names, "document_id", "left").select(F.col("id").cast("string").alias("id"), source_label(F.col("file_name"), F.col("number")).alias("source"), "content", F.col("score").cast("double").alias("score"), F.lit(1).alias("section"))
    if answer is None:
        return rows.drop("section")
    first = hits.sparkSession.range(1).select(F.lit(None).cast("string").alias("id"), F.lit("answer").alias("source"), answer.alias("content"), F.lit(0.0).alias("score"), F.lit(0).alias("section"))
    return first.unionByName(rows).orderBy("section", F.desc("score"), "id").drop("section")
