"""Vector similarity: cosine and Euclidean columns, exact top-k."""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from graphloom.plans.session import findable


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]) if values else F.expr("cast(array() AS array<double>)")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision. A zero norm gives 0; arrays of different length raise."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda y: y * y)))
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimension")).cast("double"))
    return checked.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def euclidean(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a list column without nulls as rows in double precision; they must have one dimension."""
    sizes = pc.list_value_length(column)
    if len(sizes) and (low := pc.min_max(sizes).as_py())["min"] != low["max"]:
        raise ValueError(f"vectors differ in dimension: {low['min']} and {low['max']}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cosines(x: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Cosine of each row with each probe, rounded; a zero norm gives 0."""
    if len(x) and len(probes) and x.shape[1] != probes.shape[1]:
        raise ValueError(f"vectors differ in dimension: {x.shape[1]} and {probes.shape[1]}")
    size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((probes * probes).sum(1))
    return np.round(np.divide(x @ probes.T, size, out=np.zeros_like(size), where=size > 0), 6)


def top_k(vectors: DataFrame, probe: Sequence[float], k: int, id_col: str, vector_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """The k most similar vectors, by score and then id, with further columns to keep; each Arrow batch gives its k best only.
    Null vectors are passed over, another dimension than the probe's is an error."""
    if not probe:
        return vectors.select(id_col, F.lit(None).cast("double").alias("score"), *keep).orderBy(id_col).limit(k)
    findable(vectors.sparkSession)
    src = vectors.select(id_col, vector_col, *keep).filter(F.col(vector_col).isNotNull())
    probes = np.array([probe], np.float64)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = _cosines(matrix(batch.column(1)), probes)[:, 0]
                some = pa.table([batch.column(0), pa.array(scores), *batch.columns[2:]], ["id", "score", *keep])
                best = pc.select_k_unstable(some, k, [("score", "descending"), ("id", "ascending")])
                yield from some.take(best).combine_chunks().to_batches()

    found = src.mapInArrow(run, StructType([StructField("id", src.schema[id_col].dataType), StructField("score", DoubleType()), *[src.schema[c] for c in keep]]))
    return found.orderBy(F.desc("score"), "id").limit(k).withColumnRenamed("id", id_col)


def filtered(vectors: DataFrame, kind: str | None = None, ids: Sequence | None = None, project=None) -> DataFrame:
    """Rows of a type, of ids and of a project; filters come before any similarity."""
    if kind is not None:
        vectors = vectors.filter(F.col("type") == kind)
    if ids is not None:
        vectors = vectors.filter(F.col("id").isin(list(ids)))
    if project is not None:
        vectors = vectors.filter(F.col("project_id") == project)
    return vectors


#: Queries and vectors of a block, and bytes of best rows that a task keeps.
BLOCK_QUERIES, BLOCK_VECTORS, KEPT_BYTES = 1000, 4096, 64 << 20


def blocks_of(rows: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """Rows packed into blocks of one task's rows: (ids, v, dim), v the vectors as doubles one after the other."""
    findable(rows.sparkSession)
    src = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v IS NOT NULL")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def packed():
            table = pa.Table.from_batches(held).combine_chunks()
            for k in range(0, table.num_rows, size):
                part = table.slice(k, size).combine_chunks()
                x = matrix(part.column(1).chunk(0))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0).chunk(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], ["ids", "v", "dim"])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= size:
                yield from packed()
        if held:
            yield from packed()

    return src.mapInArrow(run, StructType([StructField("ids", ArrayType(src.schema["id"].dataType)), StructField("v", BinaryType()), StructField("dim", IntegerType())]))


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, groups: int | None = None) -> DataFrame:
    """The k most similar vectors (id, vector) for each of any number of queries (query_id, probe): query_id, id, score, rank.

    One plan for any number of queries. Both sides are packed into blocks, and blocks meet as they are read: a task multiplies
    those of one part of the vectors and one part of the queries, without a shuffle of either, and keeps the k best of each
    query it meets. Those are ranked by query, again with at most k rows a task. With `groups`, blocks of vectors are dealt to
    so many groups instead, and each block of queries is sent to every group. Vectors and queries must have one
    dimension, else the run fails and says so; null vectors are passed over. A query id has one row.
    """
    stored = blocks_of(vectors, "id", "vector", BLOCK_VECTORS)
    asked = blocks_of(queries, "query_id", "probe", BLOCK_QUERIES).toDF("query_ids", "probes", "probe_dim")
    if groups:
        stored = stored.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
        asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = (stored.join(asked, "g") if groups else stored.crossJoin(asked)).select("query_ids", "probes", "probe_dim", "ids", "v", "dim")
    kinds = queries.schema["query_id"].dataType, vectors.schema["id"].dataType

    def run(batches):
        best: dict[bytes, pa.Table] = {}  # by block of queries

        for batch in batches:
            for row in range(batch.num_rows):
                probes, x = (np.frombuffer(batch.column(c)[row].as_buffer(), np.float64).reshape(-1, batch.column(c + 1)[row].as_py()) for c in (1, 4))
                names, ids = batch.column(0)[row].values, batch.column(3)[row].values
                scores = _cosines(x, probes)
                rank = pc.rank(ids, tiebreaker="first").to_numpy()
                at = np.lexsort((np.broadcast_to(rank[:, None], scores.shape), -scores), axis=0)[:k]
                found = pa.table([names.take(pa.array(np.tile(np.arange(len(names)), len(at)))), ids.take(pa.array(at.ravel())), pa.array(np.take_along_axis(scores, at, 0).ravel())], ["query_id", "id", "score"])
                key = hash(batch.column(1)[row].as_buffer().to_pybytes())
                best[key] = _best(pa.concat_tables([best[key], found]), k) if key in best else found
            if sum(t.nbytes for t in best.values()) > KEPT_BYTES:
                for t in best.values():
                    yield from t.combine_chunks().to_batches()
                best.clear()
        for t in best.values():
            yield from t.combine_chunks().to_batches()

    found = met.mapInArrow(run, StructType([StructField("query_id", kinds[0]), StructField("id", kinds[1]), StructField("score", DoubleType())]))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query."""
    rows = rows.sort_by([("query_id", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
    query = rows.column("query_id").combine_chunks().dictionary_encode()
    query = (query.combine_chunks() if isinstance(query, pa.ChunkedArray) else query).indices.to_numpy()
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    return rows.filter(pa.array(place < k))


def top_k_by_group(vectors: DataFrame, probe: Sequence[float], k: int, by: str) -> DataFrame:
    """The k most similar vectors of each group for one query."""
    scored = vectors.select(by, "id", F.round(cosine(F.col("vector"), as_vector(probe)), 6).alias("score"))
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def weighted(hits: DataFrame, linked_ids: Column, names: Column, keywords: Column) -> DataFrame:
    """Scores raised by 0.3 for chunks of a found entity, 0.15 for an entity's name in the text, 0.2 for a keyword in it."""
    content = F.lower("content")
    holds = lambda words: F.coalesce(F.exists(words, lambda w: (w != "") & F.contains(content, F.lower(w))), F.lit(False))
    boost = F.when(F.array_contains(linked_ids, F.col("id")), 0.3).otherwise(0.0) + F.when(holds(names), 0.15).otherwise(0.0) + F.when(holds(keywords), 0.2).otherwise(0.0)
    return hits.withColumn("boost", boost).withColumn("weighted", F.round(F.col("score") * (1 + boost), 6))


def linked_chunks(entities: DataFrame) -> DataFrame:
    """Ids of the chunks that entities come from, once each."""
    return entities.select(F.explode("source_chunk_ids").alias("id")).distinct()


def weighted_by(hits: DataFrame, entities: DataFrame, keywords: Column) -> DataFrame:
    """weighted() for found entities given as a table (name, source_chunk_ids): hits are marked by a join with the entities'
    chunks, of any number; names in the text by a join with the hits, which are few."""
    chunks = linked_chunks(entities).join(F.broadcast(hits.select(F.col("id").cast("string").alias("id"))), "id", "left_semi")
    marked = hits.join(chunks.select(F.col("id").alias("_id"), F.lit(True).alias("_linked")), F.col("id").cast("string") == F.col("_id"), "left").drop("_id")
    names = entities.select(F.lower("name").alias("_name")).filter("_name <> ''").distinct()
    named = names.join(F.broadcast(hits.select(F.col("id").alias("_of"), F.lower("content").alias("_text"))), F.contains("_text", "_name")).select("_of").distinct()
    marked = marked.join(named.withColumn("_named", F.lit(True)), F.col("id") == F.col("_of"), "left").drop("_of")
    content = F.lower("content")
    said = F.coalesce(F.exists(keywords, lambda w: (w != "") & F.contains(content, F.lower(w))), F.lit(False))
    boost = F.when(F.col("_linked"), 0.3).otherwise(0.0) + F.when(F.col("_named"), 0.15).otherwise(0.0) + F.when(said, 0.2).otherwise(0.0)
    return marked.withColumn("boost", boost).withColumn("weighted", F.round(F.col("score") * (1 + boost), 6)).drop("_linked", "_named")


def cut_dimension(vector: Column, dimension: int) -> Column:
    return F.slice(vector, 1, dimension)


def base64_vectors(table: DataFrame, vector: str, out: str) -> DataFrame:
    """Vectors as Base64 of their 32-bit floats, little-endian."""
    schema = table.schema
    findable(table.sparkSession)

    def run(batches):
        for batch in batches:
            found = [None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode() for v in batch.column(schema.names.index(vector)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*schema.names, out])

    return table.mapInArrow(run, StructType([*schema.fields, StructField(out, StringType())]))


def vectors_of_base64(table: DataFrame, text: str, out: str) -> DataFrame:
    """The same back, as floats."""
    schema = table.schema
    findable(table.sparkSession)

    def run(batches):
        for batch in batches:
            found = [None if t is None else np.frombuffer(base64.b64decode(t), "<f4").tolist() for t in batch.column(schema.names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], [*schema.names, out])

    return table.mapInArrow(run, StructType([*schema.fields, StructField(out, ArrayType(FloatType()))]))
