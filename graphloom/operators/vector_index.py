"""An index for nearest vectors: an inverted file of cells with product-quantised codes, exact scores at the end.

Cells and code books are learned on a bounded sample; every row is indexed. A search reads the cells next to each query,
ranks the codes of large blocks approximately, and scores the best of them with the vectors stored beside the codes. A task
keeps the best of each query it meets, so that what is shuffled grows with the queries, not with the candidates. How many cells and how many
candidates that takes is measured on the sample for a wanted recall. `vectors.top_k_batch` is the exact way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from graphloom.plans.session import findable

from .vectors import BLOCK_QUERIES, BLOCK_VECTORS, KEPT_BYTES, _best, _cosines, matrix

#: The sample: rows, and values of all its vectors. Most cells, and values a code stands for.
SAMPLE_ROWS, SAMPLE_VALUES, MAX_CELLS, SUB = 20_000, 4_000_000, 4096, 4
#: Rows of the sample that recall is measured with, and the recall that is wanted for K neighbours.
TRIED, RECALL, K = 300, 0.97, 10


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """n centres of the rows; an empty centre moves to a row."""
    centres = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], x[rng.integers(len(x), size=len(centres))])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centres.T - half, 1) for k in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


@dataclass
class Model:
    """What tasks need: centres of cells, code books (part, code, values), and how many cells and candidates a search takes."""

    cells: np.ndarray
    books: np.ndarray
    probes: int
    candidates: int

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of unit vectors."""
        cell = _nearest(x, self.cells)
        rest = self._parts(x - self.cells[cell])
        return cell, np.stack([_nearest(rest[:, j], book) for j, book in enumerate(self.books)], 1).astype(np.uint8)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        parts, width = len(self.books), self.books.shape[2]
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Scores of queries (rows) with the vectors of a cell by their codes."""
        table = np.einsum("qpw,pcw->pqc", self._parts(q), self.books)
        out = np.repeat((q @ self.cells[cell])[:, None], len(codes), 1)
        for j in range(len(self.books)):
            out += table[j][:, codes[:, j]]
        return out


def learn(sample: np.ndarray, rows: int, recall: float = RECALL, k: int = K, seed: int = 1) -> Model:
    """A model from unit vectors of a sample of so many rows."""
    rng = np.random.default_rng(seed)
    cells = _means(sample, int(min(MAX_CELLS, max(1, np.sqrt(rows)), len(sample))), rng)
    model = Model(cells, np.zeros((-(-sample.shape[1] // SUB), 1, SUB)), len(cells), 10 * k)
    near = _nearest(sample, cells)
    rest = model._parts(sample - cells[near])
    model.books = np.stack([_means(rest[:, j], min(256, len(sample)), rng) for j in range(rest.shape[1])])
    tried = rng.permutation(len(sample))[:TRIED]
    exact = sample[tried] @ sample.T
    exact[np.arange(len(tried)), tried] = -2
    wanted = np.argsort(-exact, 1)[:, :k]
    order = np.argsort(-(sample[tried] @ cells.T), 1)
    place = np.argsort(order, 1)[np.arange(len(tried))[:, None], near[wanted]]  # how many cells come before a neighbour's
    share = 1 - (1 - recall) / 2
    model.probes = int(min(len(cells), np.quantile(place, share) + 1))
    cell, codes = model.codes(sample)
    guess = np.empty_like(exact)
    for c in np.unique(cell):
        guess[:, cell == c] = model.approximate(sample[tried], c, codes[cell == c])
    guess[np.arange(len(tried)), tried] = -9
    before = np.argsort(np.argsort(-guess, 1), 1)[np.arange(len(tried))[:, None], wanted]
    model.candidates = int(max(4 * k, (np.quantile(before, share) + 1) * max(1.0, rows / len(sample))))
    return model


def sample_of(vectors: DataFrame, rows: int, dim: int) -> np.ndarray:
    """Unit vectors of a bounded sample, by a hash of the id."""
    limit = max(256, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    share = min(1.0, 0.9 * limit / max(1, rows))
    some = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))) if rows > limit else vectors
    return _unit(matrix(some.select("vector").limit(limit).toArrow().column(0).combine_chunks()))


class Index:
    """Stored blocks of cells below a folder: (cell, ids, codes, vectors); with the model, and the indexed rows."""

    def __init__(self, model: Model, blocks: DataFrame, vectors: DataFrame):
        self.model, self.blocks, self.vectors = model, blocks, vectors

    def search(self, queries: DataFrame, k: int, probes: int | None = None, candidates: int | None = None) -> DataFrame:
        """About the k most similar vectors of each query (query_id, probe): query_id, id, score, rank; scores are exact."""
        model, take = self.model, candidates or max(self.model.candidates, 4 * k)
        spark = queries.sparkSession
        findable(spark)
        shared, cells = spark.sparkContext.broadcast(model), probes or model.probes
        kinds = queries.schema["query_id"].dataType, self.vectors.schema["id"].dataType

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    q = matrix(batch.column(1))
                    near = np.argsort(-(_unit(q) @ shared.value.cells.T), 1)[:, :cells].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in q], pa.binary()), pa.array([x.tobytes() for x in near], pa.binary()), pa.array(near[:, 0])], ["query_id", "q", "near", "home"])

        def pack(batches):
            held: list[pa.RecordBatch] = []

            def blocks():
                table = pa.Table.from_batches(held).combine_chunks()
                for k in range(0, table.num_rows, BLOCK_QUERIES):
                    some = table.slice(k, BLOCK_QUERIES).combine_chunks()
                    near = b"".join(some.column("near").to_pylist())
                    wanted = np.unique(np.frombuffer(near, np.int32))
                    names = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("query_id").chunk(0))
                    yield pa.RecordBatch.from_arrays([names, pa.array([b"".join(some.column("q").to_pylist())], pa.binary()), pa.array([near], pa.binary()), pa.array([wanted.tolist()], pa.list_(pa.int32()))], ["query_ids", "qs", "near", "wanted"])
                held.clear()

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.num_rows for b in held) >= BLOCK_QUERIES:
                    yield from blocks()
            if held:
                yield from blocks()

        asked = queries.select("query_id", F.col("probe").cast("array<double>").alias("probe")).filter("probe IS NOT NULL")
        asked = asked.mapInArrow(place, StructType([StructField("query_id", kinds[0]), *StructType.fromDDL("q binary, near binary, home int").fields]))
        asked = asked.repartition("home").sortWithinPartitions("home").mapInArrow(pack, StructType([StructField("query_ids", ArrayType(kinds[0])), *StructType.fromDDL("qs binary, near binary, wanted array<int>").fields]))
        # blocks of queries meet the stored blocks as those are read: neither queries nor guesses are written for each cell
        met = asked.join(self.blocks, F.array_contains("wanted", F.col("cell"))).select("cell", "ids", "codes", "vectors", "query_ids", "qs", "near")

        def leading(scores, mine, names, ids):
            """Rows of at least the k-th score of each query, ties included."""
            least = np.partition(scores, -k, 1)[:, -k, None] if k < scores.shape[1] else -9.0
            step = max(1, (1 << 18) // scores.shape[1])
            out = []
            for a in range(0, len(scores), step):
                some = scores[a : a + step]
                who, what = np.nonzero(some >= (least if np.isscalar(least) else least[a : a + step]))
                out.append(_best(pa.table([names.take(pa.array(mine[a + who])), ids.take(pa.array(what)), pa.array(some[who, what])], ["query_id", "id", "score"]), k))
            return out

        def rank(batches):
            model = shared.value
            best: dict[int, pa.Table] = {}  # by block of queries

            for batch in batches:
                for row in range(batch.num_rows):
                    cell, ids = batch.column(0)[row].as_py(), batch.column(1)[row].values
                    names, near = batch.column(4)[row].values, batch.column(6)[row].as_buffer()
                    mine = np.flatnonzero((np.frombuffer(near, np.int32).reshape(len(names), -1) == cell).any(1))
                    if not len(mine):
                        continue
                    x = np.frombuffer(batch.column(3)[row].as_buffer(), np.float64).reshape(len(ids), -1)
                    q = np.frombuffer(batch.column(5)[row].as_buffer(), np.float64).reshape(len(names), -1)[mine]
                    scores = _cosines(x, q).T
                    if len(ids) > take:  # the codes choose, their vectors give the scores
                        codes = np.frombuffer(batch.column(2)[row].as_buffer(), np.uint8).reshape(len(ids), -1)
                        order = np.argsort(-model.approximate(_unit(q), cell, codes), 1, kind="stable")[:, take:]
                        np.put_along_axis(scores, order, -9.0, 1)
                    key = hash((names[0].as_py(), len(names)))
                    best[key] = _best(pa.concat_tables([best[key], *leading(scores, mine, names, ids)]) if key in best else pa.concat_tables(leading(scores, mine, names, ids)), k)
                if sum(t.nbytes for t in best.values()) > KEPT_BYTES:
                    for t in best.values():
                        yield from t.combine_chunks().to_batches()
                    best.clear()
            for t in best.values():
                yield from t.combine_chunks().to_batches()

        found = met.mapInArrow(rank, StructType([StructField("query_id", kinds[0]), StructField("id", kinds[1]), StructField("score", DoubleType())]))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def build(vectors: DataFrame, path: str, recall: float = RECALL, k: int = K) -> Index:
    """Indexes all rows (id, vector) below a folder, by cell, so that a search reads the cells it needs only. Null vectors are
    left out; the others must have one dimension. A cell of any size is dealt to several tasks and kept in blocks."""
    spark = vectors.sparkSession
    findable(spark)
    src = vectors.select("id", "vector").filter("vector IS NOT NULL")
    rows, low, dim = src.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low != dim:
        raise ValueError(f"vectors differ in dimension: {low} and {dim}")
    model = learn(sample_of(src, rows, dim), rows, recall, k) if rows else Model(np.zeros((1, 1)), np.zeros((1, 1, SUB)), 1, k)
    shared = spark.sparkContext.broadcast(model)
    kind = src.schema["id"].dataType

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                cell, codes = shared.value.codes(_unit(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), *(pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (codes, x))], ["id", "cell", "codes", "v"])

    def pack(batches):
        held: list[pa.RecordBatch] = []

        def blocks():
            table = pa.Table.from_batches(held).combine_chunks()
            for c in pc.unique(table.column("cell")).to_pylist():
                part = table.filter(pc.equal(table.column("cell"), c))
                for k in range(0, part.num_rows, BLOCK_VECTORS):
                    some = part.slice(k, BLOCK_VECTORS).combine_chunks()
                    ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("id").combine_chunks())
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), ids, *(pa.array([b"".join(some.column(c).to_pylist())], pa.binary()) for c in ("codes", "v"))], ["cell", "ids", "codes", "vectors"])
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * BLOCK_VECTORS:
                yield from blocks()
        if held:
            yield from blocks()

    coded = src.mapInArrow(code, StructType([StructField("id", kind), *StructType.fromDDL("cell int, codes binary, v binary").fields]))
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows // (len(model.cells) * 16 * BLOCK_VECTORS)))))
    packed = coded.repartition("cell", salt).sortWithinPartitions("cell").mapInArrow(pack, StructType([StructField("cell", StructType.fromDDL("c int")[0].dataType), StructField("ids", ArrayType(kind)), *StructType.fromDDL("codes binary, vectors binary").fields]))
    packed.write.mode("overwrite").partitionBy("cell").parquet(path)
    return Index(model, spark.read.schema(packed.schema).parquet(path), vectors)


