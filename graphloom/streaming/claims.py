"""The ingestion loop as a stream: new documents are claimed, processed and marked, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: States of a document and how far each is.
STATES = {"NOT_PROCESSED": 0, "PROCESSING": 50, "PROCESSED": 100}


def progress(status: Column) -> Column:
    out = F.lit(0)
    for name, percent in STATES.items():
        out = F.when(status == name, percent).otherwise(out)
    return out


def unprocessed(documents: DataFrame, limit: int) -> DataFrame:
    return documents.filter("status = 'NOT_PROCESSED'").orderBy("created_at", "id").limit(limit)


def without_vectors(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents that have no vectors yet; this makes a second run harmless."""
    return documents.join(vectors.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")


def claim_loop(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, process: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Reads new Parquet files of documents, passes over those already in the target and appends what `process` gives.

    A batch that fails is given again, and its documents are still unprocessed; a batch that was written before its
    offset was is found in the target. Runs through what is there and stops.
    """

    def each(batch: DataFrame, _: int) -> None:
        try:
            done = spark.read.parquet(target).select("document_id")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        todo = batch.dropDuplicates(["id"])
        todo = todo if done is None else without_vectors(todo, done)
        process(todo).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_queries(queries: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Each query once within its time to live: a keyword cache on a stream of (query_hash, asked_at, ...)."""
    return queries.withWatermark("asked_at", ttl).dropDuplicatesWithinWatermark(["query_hash"])
