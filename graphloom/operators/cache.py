"""Caches as tables: extraction results, keywords, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import upsert_keeping

KEY = ["project_id", "cache_type", "content_hash"]


def store(cache: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Result and tokens are replaced by key; id and chunk stay those of the first row."""
    return upsert_keeping(cache, new, KEY, order, ["id", "chunk_id"])


def lookup(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(cache, KEY, "left")


def of_chunks(cache: DataFrame, chunks: DataFrame) -> DataFrame:
    return cache.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def evicted(cache: DataFrame, expires: str, key: str, now: Column, limit: int = 500) -> DataFrame:
    """What stays: nothing expired, and of more than the limit those that expire last."""
    live = cache.filter(F.col(expires) > now)
    return live.orderBy(F.desc(expires), key).limit(limit)


def answer_key(query: Column, mode: Column, top_k: Column, chunk_top_k: Column) -> Column:
    return F.sha2(F.concat_ws("|", query, F.upper(mode), top_k.cast("string"), chunk_top_k.cast("string")), 256)


def keyword_key(query: Column, project: Column | None = None) -> Column:
    """Project, or `global`, and the hash of a query."""
    owner = F.lit("global") if project is None else F.coalesce(project, F.lit("global"))
    return F.concat(owner, F.lit(":"), F.sha2(query, 256))


def answer_json(answer: Column, mode: Column, total_sources: Column) -> Column:
    """A cached answer as JSON; its sources are not kept."""
    return F.to_json(F.struct(answer.alias("answer"), F.upper(mode).alias("mode"), total_sources.cast("int").alias("totalSources")))


def parsed_answer(text: Column) -> Column:
    """The same back: a struct of answer, mode and totalSources; null fields where the text is no such JSON."""
    return F.from_json(text, "answer string, mode string, totalSources int")


def invalidated(cache: DataFrame, project: str) -> DataFrame:
    """The cache without a project's answers."""
    return cache.filter(~F.col("project_id").eqNullSafe(F.lit(project)))
