"""Ingestion as a stream: documents are claimed by state, cut, embedded and extracted in bounded batches, each once.

A claim is a state by document: PROCESSING with a lease and a number of the attempt, COMPLETED or FAILED. Submitted
documents and outcomes come as two streams of files into one state. A batch writes its tables below its own
number and so can be run again after a failure; its outcomes reach the state with the next batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.functions.extraction import parse_responses
from graphloom.plans.session import findable

SUBMITTED = "id string, content string"
OUTCOME = "id string, attempt int, status string, chunk_count long, entity_count long, relation_count long, error string"
STATE = "status string, attempt int"
CLAIM = "id string, attempt int, status string"


def claims(submitted: DataFrame, outcomes: DataFrame, lease_ms: int = 600_000, max_attempts: int = 3) -> DataFrame:
    """A stream of claims (id, attempt, status) from streams of submitted ids and of outcomes (id, attempt, status).

    A document is claimed if nothing is known of it, or it failed and is submitted again; not while it is PROCESSING or
    when it is COMPLETED. Without an outcome when the lease ends it is claimed again, up to max_attempts in a row; then it is
    given out as FAILED. An outcome of an older attempt than the last is passed over. Null ids are no documents.
    """
    rows = submitted.select("id", F.lit(0).alias("attempt"), F.lit("SUBMITTED").alias("status")).unionByName(outcomes.select("id", "attempt", "status")).filter("id IS NOT NULL")

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempt = state.get if state.exists else ("NONE", 0)
        out = []

        def claim(n: int) -> tuple[str, int]:
            state.setTimeoutDuration(lease_ms)
            out.append((key[0], n, "PROCESSING"))
            return "PROCESSING", n

        if state.hasTimedOut:
            if status == "PROCESSING" and attempt >= max_attempts:
                status = "FAILED"
                out.append((key[0], attempt, "FAILED"))
            elif status == "PROCESSING":
                status, attempt = claim(attempt + 1)
        else:
            events = pd.concat([*batches], ignore_index=True)
            for kind, n in zip(events["status"], events["attempt"], strict=True):
                if kind != "SUBMITTED" and status == "PROCESSING" and n == attempt:
                    status = kind
            if (events["status"] == "SUBMITTED").any() and status in ("NONE", "FAILED"):
                status, attempt = claim(1)  # at a later submission the attempts begin anew
            elif status == "PROCESSING":
                state.setTimeoutDuration(lease_ms)
        state.update((status, attempt))
        yield pd.DataFrame(out, columns=["id", "attempt", "status"])

    return rows.groupBy("id").applyInPandasWithState(follow, CLAIM, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def mapped(rows: DataFrame, text_col: str, call: Callable[[list[str]], list], out: str, kind: str, size: int) -> DataFrame:
    """Rows with what a model gives for their texts, `size` texts a call, and the error of a failed call. After a failed call its
    texts are asked for one by one, so that a text does not spoil its neighbours. Null texts are empty."""
    schema = rows.schema
    findable(rows.sparkSession)
    target = rows.withColumns({out: F.lit(None).cast(kind), "error": F.lit(None).cast("string")}).schema
    arrow = pa.list_(pa.float64()) if kind == "array<double>" else pa.string()

    def asked(texts):
        try:
            values = list(call(texts))
            if len(values) != len(texts):
                raise ValueError(f"{len(values)} answers to {len(texts)} texts")
            return values, [None] * len(texts)
        except Exception as e:  # noqa: BLE001 - any failure of a model is the document's
            if len(texts) == 1:
                return [None], [str(e)[:500]]
            each = [asked([t]) for t in texts]
            return [v[0] for v, _ in each], [x[0] for _, x in each]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                texts = [t or "" for t in part.column(schema.names.index(text_col)).to_pylist()]
                values, errors = asked(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, arrow), pa.array(errors, pa.string())], target.names)

    return rows.mapInArrow(run, target)


def process(docs: DataFrame, path: str, batch: int, cut: Callable[[DataFrame], DataFrame], embed: Callable, extract: Callable, embed_size: int = 32, extract_size: int = 8) -> DataFrame:
    """Writes chunks, vectors, entities and relations of documents (id, attempt, content) below path, for one batch, and gives
    their outcomes. A document of which any call failed is FAILED and leaves nothing else."""
    spark = docs.sparkSession

    def save(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}/batch={batch}")

    docs = save(docs, "work/docs")
    chunks = save(cut(docs.select("id", "content")).select(F.col("id").alias("document_id"), "chunk_index", F.concat_ws("#", "id", "chunk_index").alias("chunk_id"), "content"), "work/chunks")
    vectors = save(mapped(chunks, "content", embed, "vector", "array<double>", embed_size), "work/vectors")
    answers = save(mapped(chunks.select("chunk_id", "document_id", "content"), "content", extract, "response", "string", extract_size).drop("content"), "work/answers")
    errors = vectors.select("document_id", "error").unionByName(answers.select("document_id", "error")).filter("error IS NOT NULL").groupBy("document_id").agg(F.min("error").alias("error"))
    good = docs.select(F.col("id").alias("document_id")).join(errors, "document_id", "left_anti")
    kept = lambda rows: rows.join(good, "document_id", "left_semi")
    save(kept(chunks).select("chunk_id", "document_id", "chunk_index", "content"), "chunks")
    save(kept(vectors).select("chunk_id", "document_id", "vector"), "vectors")
    entities, relations = parse_responses(kept(answers), "chunk_id", "response")
    entities, relations = save(entities, "entities"), save(relations, "relations")
    owner = chunks.select("chunk_id", "document_id")
    counts = [rows.join(owner, "chunk_id").groupBy("document_id").agg(F.count("*").alias(name)) for rows, name in ((entities, "entity_count"), (relations, "relation_count"))]
    counts.append(kept(chunks).groupBy("document_id").agg(F.count("*").alias("chunk_count")))
    out = docs.select(F.col("id").alias("document_id"), "attempt").join(errors, "document_id", "left")
    for c in counts:
        out = out.join(c, "document_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("document_id").alias("id"), "attempt", F.when(F.col("error").isNull(), "COMPLETED").otherwise("FAILED").alias("status"), number("chunk_count"), number("entity_count"), number("relation_count"), "error")


def ingest(spark: SparkSession, source: str, path: str, cut: Callable[[DataFrame], DataFrame], embed: Callable, extract: Callable, lease_ms: int = 600_000, max_attempts: int = 3, files_a_batch: int = 100, **sizes) -> StreamingQuery:
    """Runs through the submitted Parquet files (id, content) that are there, in bounded batches, and stops.

    Of several submissions of an id one text counts, the least. Tables are below path: chunks, vectors, entities,
    relations, outcomes (see process), each by batch. Outcomes are a source of the same stream, so a run sees those of the run
    before. What a batch wrote before it failed is written again by its next run.
    """
    schema = spark.createDataFrame([], OUTCOME).schema
    spark.createDataFrame([], OUTCOME).write.mode("append").parquet(f"{path}/outcomes/batch=-1")  # a stream wants its folder
    submitted = spark.readStream.schema(SUBMITTED).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    outcomes = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/outcomes")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/work/claims/batch={number}")  # the state must run once a batch
        claimed = spark.read.schema(CLAIM).parquet(f"{path}/work/claims/batch={number}")
        docs = spark.read.schema(SUBMITTED).parquet(source).groupBy("id").agg(F.min("content").alias("content"))
        found = process(docs.join(claimed.filter("status = 'PROCESSING'"), "id").select("id", "attempt", "content"), path, number, cut, embed, extract, **sizes)
        lost = claimed.filter("status = 'FAILED'").select("id", "attempt", "status", *[F.lit(0).cast("long").alias(f"{c}_count") for c in ("chunk", "entity", "relation")], F.lit("no outcome within the lease").alias("error"))
        found.unionByName(lost).write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")

    return started(claims(submitted, outcomes, lease_ms, max_attempts), each, f"{path}/checkpoint")


def started(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a stream of claims through what is there. Batches without data are off, as a state with leases asks for another
    one for ever; leases that ended are seen by the next batch with data."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return stream.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """The last outcome of each document: OUTCOME and its batch."""
    rows = spark.read.schema(f"{OUTCOME}, batch long").option("basePath", f"{path}/outcomes").parquet(f"{path}/outcomes")
    columns = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("batch", "attempt")).alias("r")).select("id", "r.*")


def current(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of ingested rows: those of the batch in which their document was completed last."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return rows.join(statuses(spark, path).filter("status = 'COMPLETED'").select(F.col("id").alias("document_id"), "batch"), ["document_id", "batch"], "left_semi")
