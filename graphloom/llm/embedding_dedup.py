"""Near copies among embeddings: binary codes by iterative quantisation, multi-index Hamming tables, vectors compared at the end.

A rotation of the principal axes is learned on a bounded sample so that signs of the rotated, centred vectors lose least;
further rotations give further bits where the vectors have fewer axes than the code has bits. The code is cut into as many
substrings (tables) as it takes for two vectors at the threshold to agree in one of them; their width grows with the logarithm of
the rows, so the rows that meet by chance stay in proportion. Rows that agree in a substring and whose first bits differ
in few places are compared with their original vectors, in double precision.

Crowds do not become pairs. A crowd is a code that many vectors share; vectors within half the threshold's angle of its
mean form a ball, and all of a ball link with each other, as angles obey the triangle inequality. A ball stands for its
members in the tables and in comparisons: by its radius a neighbour links with all of them, with none, or is compared with each, in
blocks. So counts of links are those of all links found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from graphloom.operators.components import components

from .common import Scratch, arrow_map, hash_bound, match

THRESHOLD = 0.95
#: The sample that codes are learned on: rows, and values of all its vectors.
SAMPLE_ROWS, SAMPLE_VALUES = 10_000, 4_000_000
#: Share of pairs at the threshold that agree in one substring at least, and most tables.
RECALL, MAX_TABLES = 0.98, 64
#: Vectors of a code from which on it may become a ball; rounds in which balls are looked for; rows of a block.
CROWD, ROUNDS, BLOCK = 32, 3, 512
#: Angles are compared with this margin where a bound decides, so that rounding cannot.
MARGIN = 1e-9
#: Balls that are broadcast: bytes.
BALL_BYTES = 48 << 20


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; a scale first, so that squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def dense(column: pa.Array, dtype: str) -> np.ndarray:
    """Vectors of one length that are stored as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


class Codes:
    """Signs of rotated vectors, cut into substrings."""

    def __init__(self, axes: np.ndarray, offset: np.ndarray, width: int, tables: int, near: list[int]):
        self.axes, self.offset, self.width, self.tables, self.near = axes, offset, width, tables, near

    def bits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes[: x.shape[1]] > self.offset  # shorter vectors count as filled up with zeros

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The substrings of each vector, and the first 64 bits of its code."""
        bits = self.bits(x)
        weights = 1 << np.arange(self.width, dtype=np.int64)
        parts = bits[:, : self.tables * self.width].reshape(len(x), self.tables, self.width) @ weights
        check = bits[:, :64].astype(np.uint64) @ (np.uint64(1) << np.arange(min(64, bits.shape[1]), dtype=np.uint64))
        return parts, check.view(np.int64)


def _rotation(z: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """The orthogonal matrix that brings z next to its signs, from a random one by alternating steps."""
    r = np.linalg.qr(rng.standard_normal((z.shape[1], z.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
        r = (u @ v).T
    return r


def learn(sample: np.ndarray, rows: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 1) -> Codes:
    """Codes for so many rows from unit vectors of a sample. The number of tables and the distances that two codes may have
    are measured on sample vectors and random vectors at the threshold's angle to them (and one and a half and twice of it)."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False) if len(sample) > sample.shape[1] else (0, 0, np.eye(sample.shape[1]))
    axes = axes.T[:, :128]
    z = (sample - mean) @ axes
    width = int(np.clip(np.ceil(np.log2(max(rows, 2))) - 3, 8, 40))
    some = sample[rng.permutation(len(sample))[:4000]]
    side = rng.standard_normal(some.shape)
    side = unit(side - (side * some).sum(1, keepdims=True) * some)
    angle = np.arccos(threshold)
    turned = [np.cos(k * angle) * some + np.sin(k * angle) * side for k in (1, 1.5, 2)]
    all_axes = np.empty((sample.shape[1], 0))
    for tables in range(4, MAX_TABLES + 1):
        while all_axes.shape[1] < max(tables * width, 64):
            all_axes = np.hstack([all_axes, axes @ _rotation(z, rng)])
        codes = Codes(all_axes, mean @ all_axes, width, tables, [])
        unlike = codes.bits(some) != codes.bits(turned[0])
        if (~unlike[:, : tables * width].reshape(len(some), tables, width).any(2)).any(1).mean() >= recall:
            break
    codes.near = [int(np.quantile((codes.bits(some) != codes.bits(t))[:, :64].sum(1), 0.999)) for t in turned]
    return codes


def _stored(vectors: DataFrame, id_col: str, vector_col: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """All rows with a number: (row, vec_id, dim, v); v holds the bytes of a usable vector, else null."""
    single = vectors.schema[vector_col].dataType.elementType == FloatType()
    dtype, kind = ("<f4", pa.float32()) if single else ("<f8", pa.float64())
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("x"))

    def run(batches):
        for batch in batches:
            lists, out = batch.column(1), np.full(batch.num_rows, None, object)
            length = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(length[length > 0]):
                at = np.flatnonzero(length == dim)
                x = lists.take(pa.array(at)).flatten().cast(kind).to_numpy(zero_copy_only=False).reshape(len(at), dim).astype(dtype)
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                for k, row in zip(at[good], x[good], strict=True):
                    out[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length, pa.int32()), pa.array(list(out), pa.binary())], ["vec_id", "dim", "v"])

    rows = arrow_map(src, run, "vec_id long, dim int, v binary").withColumn("row", F.monotonically_increasing_id())
    return scratch.save(rows, "rows"), dtype


def _coded(rows: DataFrame, codes: Codes, dtype: str) -> DataFrame:
    """(row, dim, v) with the substrings of the code and its first bits."""
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                keys, check = shared.value.keys(unit(dense(part.column(2), dtype)))
                keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], keys, pa.array(check)], ["row", "dim", "v", "keys", "code"])

    return arrow_map(rows.select("row", "dim", "v"), run, "row long, dim int, v binary, keys array<long>, code long")


def _centres(coded: DataFrame, codes: Codes, dtype: str, scratch: Scratch, name: str) -> DataFrame | None:
    """The means of crowds: (centre, dim, v, keys, code, n); None without crowds. A crowd shares two substrings."""
    both = F.expr(f"transform(keys, (k, i) -> xxhash64(k, keys[(i + 1) % {codes.tables}]))")
    one = coded.select("row", "dim", "v", F.posexplode(both).alias("t", "pair"))
    key = ["dim", "t", "pair"]
    crowds = scratch.save(one.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") >= CROWD).withColumn("centre", F.monotonically_increasing_id()), f"{name}-crowds")
    if crowds.isEmpty():
        return None
    found = match(one, crowds, key, "row", size="n").select("centre", "dim", "v")

    def added(batches):
        total: dict[tuple, np.ndarray] = {}

        def flush():
            rows = [(c, d, x.tobytes()) for (c, d), x in total.items()]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["centre", "dim", "v"])

        for batch in batches:
            dims, centres = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x, (names, places) = unit(dense(batch.column(2).take(pa.array(at)), dtype)), np.unique(centres[at], return_inverse=True)
                sums = np.zeros((len(names), dim))
                np.add.at(sums, places, x)
                for c, s in zip(names.tolist(), sums, strict=True):
                    total[c, int(dim)] = total.get((c, int(dim)), 0) + s
            if sum(x.nbytes for x in total.values()) > (8 << 20):
                yield flush()
        if total:
            yield flush()

    def mean(table: pa.Table) -> pa.Table:  # one row for each task that held a part
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), "<f8").reshape(table.num_rows, -1).sum(0, keepdims=True)
        x = unit(x) if np.abs(x).max() > 0 else x
        return pa.table({"centre": table.column("centre")[:1], "dim": table.column("dim")[:1], "v": pa.array([x.astype(dtype).tobytes()], pa.binary())})

    sums = arrow_map(found, added, "centre long, dim int, v binary").groupBy("centre").applyInArrow(mean, "centre long, dim int, v binary")
    rows = _coded(sums.withColumnRenamed("centre", "row"), codes, dtype).withColumnRenamed("row", "centre")
    return scratch.save(rows.join(crowds.select("centre", "n"), "centre"), name)


def _assigned(coded: DataFrame, centres: DataFrame, dtype: str, half: float, scratch: Scratch, name: str) -> DataFrame:
    """(row, centre, angle): each vector within the half angle of a centre whose code shares a substring with its own. Of several
    centres that of the largest crowd, so that copies gather in few balls."""
    balls = centres.select("dim", F.posexplode("keys").alias("t", "key"), "centre", F.col("v").alias("c"), "n")
    dim = max(1, coded.agg(F.max("dim")).first()[0] or 1)
    if balls.count() * dim * (4 if dtype == "<f4" else 8) <= BALL_BYTES:
        balls = F.broadcast(balls)
    near = coded.select("row", "dim", "v", F.posexplode("keys").alias("t", "key")).join(balls, ["dim", "t", "key"]).select("row", "dim", "v", "centre", "c", "n")

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                cosine = (unit(dense(part.column(2), dtype)) * unit(dense(part.column(4), dtype))).sum(1)
                angle = np.arccos(np.clip(cosine, -1, 1))
                keep = pa.array(angle <= half - MARGIN)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(5), pa.array(angle)], ["row", "centre", "n", "angle"]).filter(keep)

    best = F.max(F.struct("n", (-F.col("centre")).alias("c"), "angle")).alias("best")
    found = arrow_map(near, run, "row long, centre long, n long, angle double").groupBy("row").agg(best)
    return scratch.save(found.select("row", (-F.col("best.c")).alias("centre"), F.col("best.angle").alias("angle")), name)


def _balls(coded: DataFrame, codes: Codes, dtype: str, half: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Balls (item, dim, v, keys, code, alpha, w) and their members (row, item). The item is the least row of a ball, w the number
    of its members and alpha its radius. What no ball takes is looked through again, as smaller crowds may show."""
    spark = coded.sparkSession
    balls = spark.createDataFrame([], "item long, dim int, v binary, keys array<long>, code long, alpha double, w long")
    members = spark.createDataFrame([], "row long, item long")
    left = coded
    for k in range(ROUNDS):
        centres = _centres(left, codes, dtype, scratch, f"centres{k}")
        if centres is None:
            break
        taken = _assigned(left, centres, dtype, half, scratch, f"taken{k}")
        sizes = taken.groupBy("centre").agg(F.min("row").alias("item"), F.max("angle").alias("alpha"), F.count("*").alias("w")).filter("w > 1")
        sizes = scratch.save(sizes, f"sizes{k}")
        if sizes.isEmpty():
            break
        balls = balls.unionByName(centres.join(sizes, "centre").select(balls.columns))
        inside = match(taken.select("row", "centre"), sizes.select("centre", "item", "w"), ["centre"], "row", size="w").select("row", "item")
        members = scratch.save(members.unionByName(inside), f"members{k}")
        left = coded.join(members.select("row"), "row", "left_anti")
    return balls, members


def _candidates(coded: DataFrame, balls: DataFrame, members: DataFrame, codes: Codes, scratch: Scratch) -> DataFrame:
    """Pairs of items (a < b), vectors alone or balls, that agree in a substring and differ in few of the first bits."""
    tables = coded.select("row", "dim", F.posexplode("keys").alias("t", "key"), "code")
    single = tables.join(members.select("row"), "row", "left_anti").select("dim", "t", "key", F.col("row").alias("item"), "code", F.lit(False).alias("ball"))
    inside = tables.join(members, "row").select("dim", "t", "key", "item").unionByName(balls.select("dim", F.posexplode("keys").alias("t", "key"), "item")).distinct()
    inside = inside.join(balls.select("item", "code"), "item").select("dim", "t", "key", "item", "code", F.lit(True).alias("ball"))
    entries = scratch.save(single.unionByName(inside), "entries")
    side = lambda x: entries.select("dim", "t", "key", *[F.col(c).alias(f"{x}_{c}") for c in ("item", "code", "ball")])
    one, two, three = codes.near
    limit = F.when(F.col("a_ball") & F.col("b_ball"), three).when(F.col("a_ball") | F.col("b_ball"), two).otherwise(one)
    close = F.bit_count(F.col("a_code").bitwiseXOR(F.col("b_code"))) <= limit
    pairs = side("a").join(side("b"), ["dim", "t", "key"]).filter((F.col("a_item") < F.col("b_item")) & close)
    return scratch.save(pairs.select(F.col("a_item").alias("a"), F.col("b_item").alias("b")).distinct(), "pairs")


def _compared(pairs: DataFrame, items: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """(a, b, a_w, b_w, all): pairs whose vectors all link with each other (all), or may link in part; others are left out."""
    angle = float(np.arccos(threshold))
    side = lambda x: items.select(*[F.col(c).alias(x if c == "item" else f"{x}_{c}") for c in ("item", "v", "alpha", "w")])
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_w", "b_w", "a_alpha", "b_alpha", "a_v", "b_v")

    def run(batches):
        for batch in batches:
            length = pc.binary_length(batch.column(6)).to_numpy()
            for n in np.unique(length):
                part = batch.filter(pa.array(length == n))
                cosine = (unit(dense(part.column(6), dtype)) * unit(dense(part.column(7), dtype))).sum(1)
                between, radii = np.arccos(np.clip(cosine, -1, 1)), part.column(4).to_numpy() + part.column(5).to_numpy()
                alone = (part.column(2).to_numpy() == 1) & (part.column(3).to_numpy() == 1)
                every = np.where(alone, cosine >= threshold, between + radii <= angle - MARGIN)
                some = every | ~alone & (between - radii <= angle + MARGIN)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(every)], ["a", "b", "a_w", "b_w", "all"]).filter(pa.array(some))

    return arrow_map(rows, run, "a long, b long, a_w long, b_w long, all boolean")


def _in_blocks(pairs: DataFrame, rows: DataFrame, members: DataFrame, dtype: str, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b, row, n): links of single rows between the items of a pair, whose vectors are multiplied in blocks."""
    sizes = pairs.select(F.col("a").alias("item"), F.col("a_w").alias("w")).unionByName(pairs.select("b", "b_w").toDF("item", "w")).distinct()
    of = members.join(sizes, "item").unionByName(sizes.filter("w = 1").select("item", F.col("item").alias("row"), "w"))
    of = of.withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("w") / BLOCK)))
    blocks = of.join(rows.select("row", "v"), "row").groupBy("item", "block").agg(F.collect_list(F.struct("row", "v")).alias("x"))
    blocks = scratch.save(blocks.select("item", "block", F.col("x.row").alias("rows"), F.col("x.v").alias("vs")), "blocks")
    side = lambda x: blocks.select(F.col("item").alias(x), F.col("rows").alias(f"{x}_rows"), F.col("vs").alias(f"{x}_vs"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_rows", "a_vs", "b_rows", "b_vs")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a_rows, a_vs, b_rows, b_vs = (batch.column(c)[k].values for c in range(2, 6))
                links = unit(dense(a_vs, dtype)) @ unit(dense(b_vs, dtype)).T >= threshold
                n = np.concatenate([links.sum(1), links.sum(0)])
                names = np.concatenate([a_rows.to_numpy(), b_rows.to_numpy()])[n > 0]
                same = [pa.array(np.full(len(names), batch.column(c)[k].as_py(), np.int64)) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(names), pa.array(n[n > 0])], ["a", "b", "row", "n"])

    return scratch.save(arrow_map(met, run, "a long, b long, row long, n long"), "block-links")


def sample_of(rows: DataFrame, dtype: str, limit: int) -> np.ndarray:
    """Unit vectors of at most `limit` rows of the longest vectors' length, chosen by a hash of id and values; copies count once."""
    hashed = rows.select("dim", "v", F.xxhash64("vec_id", "v").alias("h"))
    bound = hash_bound(hashed, "h", limit)
    found = hashed.filter(F.col("h") <= F.lit(bound)).groupBy("h").agg(F.first("v").alias("v")).toArrow().sort_by("h")
    return unit(dense(found.column("v").combine_chunks(), dtype))


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each vector: its id, how many others it links with directly (cosine at least the threshold), the least id that
    it reaches over links, itself included, and whether that is its own.

    Vectors that are null, empty or zero or hold null or non-finite values link with nothing; so do vectors of unlike
    lengths with each other. Rows with one id are vectors of their own; a row without an id counts as a vector, but no component
    is named by it (null if no other row is in it) and it is not kept. Further columns are passed over. An empty table has
    no rows.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows, dtype = _stored(vectors, id_col, vector_col, scratch)
    usable = rows.filter("v IS NOT NULL")
    count, dim = usable.agg(F.count("*"), F.max("dim")).first()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    longest = usable.filter(F.col("dim") == dim)
    codes = learn(sample_of(longest, dtype, max(256, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))), count, threshold)
    coded = scratch.save(_coded(usable, codes, dtype), "coded")
    balls, members = _balls(coded, codes, dtype, float(np.arccos(threshold)) / 2, scratch)
    pairs = _candidates(coded, balls, members, codes, scratch)
    alone = coded.join(members.select("row"), "row", "left_anti").select(F.col("row").alias("item"), "v", F.lit(0.0).alias("alpha"), F.lit(1).cast("long").alias("w"))
    items = alone.unionByName(balls.select("item", "v", "alpha", "w"))
    links = scratch.save(_compared(pairs, items, dtype, threshold), "links")
    sure, part = links.filter("all"), links.filter("NOT all")
    degree = sure.select(F.col("a").alias("item"), F.col("b_w").alias("n")).unionByName(sure.select("b", "a_w").toDF("item", "n"))
    edges, by_row = sure.select("a", "b"), None
    if not part.isEmpty():
        by_row = _in_blocks(part, coded, members, dtype, threshold, scratch)
        edges = edges.unionByName(by_row.select("a", "b").distinct())
        by_row = by_row.groupBy("row").agg(F.sum("n").alias("more"))
    reach = components(edges, "a", "b", scratch=scratch)
    linked = degree.groupBy("item").agg(F.sum("n").alias("n")).join(balls.select("item", "w"), "item", "full").join(reach.withColumnRenamed("node", "item"), "item", "full")
    linked = scratch.save(linked.select("item", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(1)).alias("w"), F.coalesce("component", "item").alias("component")), "linked")
    placed = rows.select("row", "vec_id").join(members, "row", "left").withColumn("item", F.coalesce("item", "row"))
    placed = match(placed, linked, ["item"], "row", how="left", size="w")
    if by_row is not None:
        placed = placed.join(by_row, "row", "left")
    total = F.coalesce("n", F.lit(0)) + F.coalesce("w", F.lit(1)) - 1 + (F.coalesce("more", F.lit(0)) if by_row is not None else 0)
    placed = scratch.save(placed.select("vec_id", total.cast("long").alias("n_links"), F.coalesce("component", "item").alias("component")), "placed")
    names = placed.filter("n_links > 0").groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("size"))
    names = scratch.save(names, "names")
    found = match(placed.filter("n_links > 0"), names, ["component"], "vec_id", size="size").select("vec_id", "n_links", "component_id")
    out = found.unionByName(placed.filter("n_links = 0").select("vec_id", "n_links", F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
