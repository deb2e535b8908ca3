"""N-gram Jaccard join as a blocked product of the document by shingle incidence matrix.

Documents with one and the same set of shingles are a class; classes are the rows of the matrix. Its columns are put in
one global order, rare shingles first, and the product is taken in blocks of columns: the leading block of a row holds
the shingles of which a partner must have at least one. Overlap counts accumulate over that block, and pairs are
discarded as soon as the sizes show that they cannot reach the threshold. The rest of the product is exact intersection.

Pairs are taken in turns. At first each class meets a few leaders of the classes it shares shingles with. Links found
that way make provisional components; in each turn only pairs that would join two of them are looked at. The last turn
takes all of those: pairs of sparse columns one by one, and the rows of dense columns in blocks whose whole rows are
multiplied inside a task, which gives a spanning forest of their links. So large groups of near copies do not give all
their pairs, yet no link between different components is left out, and components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import components

from .common import MAX_BROADCAST, Scratch, arrow_map, match, small, unused
from .shingles import sets as shingle_sets

#: Similarity is at least NUM / DEN.
NUM, DEN = 3, 4
#: Columns counted as frequent: at most so many, by count; the order of the others is their hash. Only speed depends on it.
#: Of the columns that repeat within parts of the input, one that is not frequent holds at most 1 / MAX_FREQUENT of all entries.
MAX_FREQUENT, LEAST_FREQUENT = 1 << 18, 3
#: A column of so many classes is dense. Blocks of the product hold so many rows a side, fewer if rows are long.
DENSE, BLOCK_ROWS, BLOCK_ENTRIES = 16, 2048, 1 << 21
#: Values that so many rows of a block hold are multiplied as a dense matrix, so many at a time.
HEAVY, HEAVY_COLUMNS = 24, 512
#: Bits of the filter of documents whose sets are fetched, at most; what passes it wrongly is dropped by a join.
MAX_FILTER_BITS = 1 << 26
FLUSH = 1 << 21
#: Leaders that a class meets in a turn. After the first turn, columns fall into FAMILIES, each with an order of its own
#: for who leads; these turns are for the columns of components of at least LARGE classes, and go on while one of them
#: finds ENOUGH links, and one for ENOUGH_SHARE classes, so that larger tables do not take more turns. They only spare
#: work: the last turn takes all pairs that are left, whatever their number.
LEADERS, FAMILIES, LARGE, ENOUGH, ENOUGH_SHARE, MAX_TURNS = 8, 8, 8, 1 << 12, 64, 16
#: Width of a band of sizes, in logarithms: wider than the ratio of sizes that fit.
BAND = float(np.log(1.4))


def class_of(found: np.ndarray, collided: frozenset[int] = frozenset(), bits: int = 64) -> int:
    """Key of a set of shingles: a hash, or a second one where the first stands for several sets."""
    data = found.tobytes()
    key = _signed(xxhash.xxh3_64_intdigest(data) >> (64 - bits))
    return _signed(xxhash.xxh3_64_intdigest(data, 1)) if key in collided else key


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def batch_of(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names.split())


def required(a: Column, b: Column, overlap: Column) -> Column:
    """Whether an overlap makes the sets of these sizes similar: DEN * overlap >= NUM * union."""
    return (DEN + NUM) * overlap >= NUM * (a + b)


def sizes_fit(a: Column, b: Column) -> Column:
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def leading(n):
    """How many shingles of n lead: any partner must hold one of them."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def can_reach(a: Column, b: Column, count: Column) -> Column:
    """Size-derived bound on the overlap of two rows that share `count` leading shingles.

    The row whose leading block ends first shares nothing else before its end, so at most its rest can follow.
    """
    rest = lambda n: F.floor(n * NUM / DEN)  # noqa: E731  n less its leading shingles is at most this
    return sizes_fit(a, b) & required(a, b, count + F.greatest(rest(a), rest(b)))


def profile(src: DataFrame, bits: int = 64) -> DataFrame:
    """Two kinds of rows from one pass: documents (kind 0: id, row key, class, its second key, size) and counts of columns
    that occur in several rows of a part of the input (kind 1: shingle as cls, count)."""

    def run(batches: Iterator[pa.RecordBatch]):
        parts, classes = [], set()

        def frequent():
            column, count = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            classes.clear()
            keep = count >= 2
            none = pa.nulls(int(keep.sum()), pa.int64())
            return batch_of("kind id r cls other n", pa.array(np.ones(keep.sum(), np.int32)), none, none, column[keep].view(np.int64), none, count[keep].astype(np.int64))

        held = 0
        for batch in batches:
            cls, other, sizes = [], [], []
            for found in shingle_sets(batch.column(2)):
                key = class_of(found, bits=bits)
                cls.append(key)
                other.append(_signed(xxhash.xxh3_64_intdigest(found.tobytes(), 1)))
                sizes.append(len(found))
                if key not in classes:
                    classes.add(key)
                    parts.append(found)
                    held += len(found)
            yield batch_of("kind id r cls other n", pa.array(np.zeros(len(cls), np.int32)), batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array(other, pa.int64()), pa.array(sizes, pa.int64()))
            if held > FLUSH:
                yield frequent()
                held = 0
        if parts:
            yield frequent()

    return arrow_map(src, run, "kind int, id long, r long, cls long, other long, n long")


def incidence(src: DataFrame, frequent: np.ndarray, collided: frozenset[int], bits: int, common: bool, met: np.ndarray | None = None) -> DataFrame:
    """Leading shingles of each document: (shingle, cls, n), those of frequent columns or those of the others. frequent:
    columns by rising count; met: a filter of columns that several classes were seen to lead with, which come between
    columns of one class and frequent ones. What passes it wrongly only stands at another place of the order, for all rows."""
    shared = src.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent, kind="stable"), met))

    def run(batches: Iterator[pa.RecordBatch]):
        columns, ranks, mask = shared.value
        for batch in batches:
            sh, cl, ns = [], [], []
            done: set[int] = set()
            for found in shingle_sets(batch.column(0)):
                n = len(found)
                key = class_of(found, collided, bits)
                if not n or key in done:
                    continue
                done.add(key)
                rank = np.zeros(n, np.int64) if mask is None else has_bits(mask, found.view(np.int64)).astype(np.int64)
                if len(columns):
                    at = np.minimum(np.searchsorted(columns, found), len(columns) - 1)
                    rank = np.where(columns[at] == found, ranks[at] + 2, rank)
                first = np.argsort(rank, kind="stable")[: leading(n)]
                first = first[(rank[first] > 1) == common]
                sh.append(found[first])
                cl.append(np.full(len(first), key, np.int64))
                ns.append(np.full(len(first), n, np.int32))
            if sh:
                yield batch_of("sh cls n", np.concatenate(sh).view(np.int64), np.concatenate(cl), np.concatenate(ns))

    return arrow_map(src, run, "sh long, cls long, n int")


def membership_filter(keys: DataFrame, count: int) -> np.ndarray:
    """Bits set for a one-column table of hashes; its size is bounded by MAX_FILTER_BITS. Bitmaps are partial
    aggregations of 4 KB each, which the driver puts side by side."""
    bits = min(MAX_FILTER_BITS, 1 << max(15, int(16 * max(count, 1)).bit_length()))
    key = F.col(keys.columns[0])
    places = keys.select(F.explode(F.array(key.bitwiseAND(bits - 1), F.shiftrightunsigned(key, 27).bitwiseAND(bits - 1))).alias("at"))
    pages = places.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for page, held in pages.toLocalIterator():
        out[(page - 1) * 4096 : page * 4096] |= np.frombuffer(held, np.uint8)[: len(out)]
    return out


def has_bits(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64)
    out = np.ones(len(x), bool)
    for at in (x, x >> np.uint64(27)):
        at = at & np.uint64(len(mask) * 8 - 1)
        out &= (mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


class Links:
    """Checks pairs of classes by exact intersection of their whole sets, which are fetched once each."""

    def __init__(self, src: DataFrame, rows: DataFrame, scratch: Scratch, collided: frozenset[int], bits: int):
        self.src, self.rows, self.scratch, self.collided, self.bits = src, rows, scratch, collided, bits
        self.sets: DataFrame | None = None
        self.tried: DataFrame | None = None
        self.found: DataFrame | None = None
        self.turn = 0

    def fetch(self, classes: DataFrame, name: str) -> None:
        """Sets of the classes that are not there yet. rows: (cls, rep, n), rep being the key of one row of the class."""
        wanted = classes.distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("cls"), "cls", "left_anti")
        wanted = self.scratch.save(wanted.join(self.rows, "cls").select("rep"), f"wanted-{name}")
        count = wanted.count()
        if self.sets is not None and not count:
            return
        src, few = self.src.select("r", "text"), count <= MAX_BROADCAST
        if few:
            src = src.join(F.broadcast(wanted.withColumnRenamed("rep", "r")), "r", "left_semi")
        shared = None if few else src.sparkSession.sparkContext.broadcast(membership_filter(wanted, count))
        collided, bits = self.collided, self.bits

        def run(batches):
            for batch in batches:
                if shared is not None:
                    batch = batch.filter(pa.array(has_bits(shared.value, batch.column(0).to_numpy(zero_copy_only=False))))
                found = list(shingle_sets(batch.column(1)))
                if found:
                    yield batch_of("rep cls items", batch.column(0), pa.array([class_of(f, collided, bits) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary()))

        sets = arrow_map(src, run, "rep long, cls long, items binary")
        sets = sets if few else sets.join(wanted, "rep", "left_semi")
        sets = self.scratch.save(sets.dropDuplicates(["cls"]).select("cls", "items"), f"sets-{name}")
        self.sets = sets if self.sets is None else self.sets.unionByName(sets)

    def note(self, found: DataFrame) -> None:
        self.found = found if self.found is None else self.found.unionByName(found)

    def add(self, pairs: DataFrame) -> int:
        """Looks at pairs (a, b), a < b, that were not looked at before; how many are linked."""
        self.turn += 1
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = self.scratch.save(pairs, f"pairs{self.turn}")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("cls")), str(self.turn))
        both = pairs.join(self.sets.withColumnsRenamed({"cls": "a", "items": "x"}), "a").join(self.sets.withColumnsRenamed({"cls": "b", "items": "y"}), "b")

        def compare(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(DEN * common >= NUM * (len(x) + len(y) - common))
                yield batch_of("a b", batch.column(0), batch.column(1)).filter(pa.array(keep, pa.bool_()))

        found = self.scratch.save(arrow_map(both.select("a", "b", "x", "y"), compare, "a long, b long"), f"links{self.turn}")
        self.note(found)
        return found.count()


def best_leaders(counted: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class and the leaders it shares most columns with, from (cls, lead, c)."""
    best = counted.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("c"), "lead"))).filter(F.col("place") <= LEADERS)
    return best.select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()


def meet_first(block: DataFrame) -> DataFrame:
    """Pairs of each class and the leaders of its columns, each led by its first class. Counts are low, as a class does
    not lead each column it is in; hence the doubled count in the bound."""
    met = block.filter("cls <> lead").groupBy("cls", "n", "lead", "lead_n").agg(F.count("*").alias("c"))
    return best_leaders(met.filter(can_reach(F.col("n"), F.col("lead_n"), 2 * F.col("c"))))


def busy_block(block: DataFrame, part: DataFrame) -> DataFrame:
    """The columns that hold a class of a large component, with each class's component: (sh, cls, n, label)."""
    large = part.join(part.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= LARGE), "component").select(F.col("node").alias("cls"))
    columns = block.select("sh", "cls").join(small(large), "cls", "left_semi").select("sh").distinct()
    return labelled(match(block, columns, ["sh"], "cls", "left_semi"), part)


def labelled(block: DataFrame, part: DataFrame) -> DataFrame:
    return block.select("sh", "cls", "n").join(small(part.withColumnRenamed("node", "cls")), "cls", "left").select("sh", "cls", "n", F.coalesce("component", "cls").alias("label"))


def meet_leaders(block: DataFrame, turn: int) -> DataFrame:
    """Pairs of each class and leaders of other components. A column is led by its first and last class in an order that
    changes with the turn and the family of the column; a class leads few of its columns, hence the multiple of the count."""
    order = F.struct(F.xxhash64(F.col("cls"), F.pmod("sh", F.lit(FAMILIES)), F.lit(turn)).alias("h"), "cls", "n", "label")
    ends = block.groupBy("sh").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).filter("lo.cls <> hi.cls")
    met = match(block, ends, ["sh"], "cls").select("cls", "n", "label", F.explode(F.array("lo", "hi")).alias("l")).filter("l.label <> label").select("cls", "n", F.col("l.cls").alias("lead"), F.col("l.n").alias("m"))
    counted = met.groupBy("cls", "n", "lead", "m").agg(F.count("*").alias("c"))
    return best_leaders(counted.filter(can_reach(F.col("n"), F.col("m"), 2 * FAMILIES * F.col("c"))))


def band_of(n):
    """Sizes that fit are at most one band apart, with room for rounding."""
    return F.floor(F.log(n) / BAND).cast("int") if isinstance(n, Column) else np.floor(np.log(n) / BAND).astype(np.int64)


def meet_all(block: DataFrame, links: Links) -> DataFrame:
    """All pairs (a, b) of different components that share a column of fewer than DENSE classes and can reach the
    threshold; the links of rows that share a dense column go to links right away."""
    scratch = links.scratch
    columns = block.groupBy("sh").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.min(F.xxhash64("cls")).alias("leader")).filter("lo < hi")
    columns = scratch.save(columns.select("sh", "size", "leader"), "columns")
    heavy = columns.filter(F.col("size") >= DENSE).select("sh", "leader")
    # rows that share dense columns are a group, named after the first row of the column: columns of one group of near copies have few such rows
    groups = scratch.save(match(block, heavy, ["sh"], "cls").select("cls", "n", "label", "leader").distinct(), "groups")
    homes = groups.groupBy("cls").agg(F.min("leader").alias("home"))  # one of them: it only spares pairs, and is small to broadcast
    few = block.join(small(columns.filter(F.col("size") < DENSE).select("sh")), "sh").groupBy("cls", "n", "label").agg(F.collect_list("sh").alias("all"))
    few = few.join(small(homes), "cls", "left").select("cls", "n", "label", "home", F.size("all").alias("s"), F.explode("all").alias("sh"))
    few = scratch.save(few, "few")  # s columns: a pair cannot share more
    left = few.select("sh", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("home").alias("ha"), F.col("s").alias("sa"))
    right = few.select("sh", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("home").alias("hb"), F.col("s").alias("sb"))
    apart = ~F.coalesce(F.col("ha") == F.col("hb"), F.lit(False))
    near = can_reach(F.col("na"), F.col("nb"), F.least("sa", "sb"))
    product = left.join(right, "sh").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & near & apart)
    sparse = product.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c")).filter(can_reach(F.col("na"), F.col("nb"), F.col("c"))).select("a", "b")
    multiply(groups, links)
    return sparse


def multiply(groups: DataFrame, links: Links) -> None:
    """Links between rows of different components in each group of (cls, n, label, leader), from products of blocks.

    A row is dealt to two bands of sizes. The rows of the largest component of a group and band do not meet each other,
    so work is linear in them; the others meet all.
    """
    scratch = links.scratch
    rows = groups.withColumn("band", F.explode(F.array(band_of(F.col("n")) - 1, band_of(F.col("n")))))
    by_label = rows.groupBy("leader", "band", "label").agg(F.count("*").alias("c"))
    sizes = by_label.groupBy("leader", "band").agg(F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("top")).filter("total > top.c")
    per = F.greatest(F.lit(2), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_ENTRIES / F.exp((F.col("band") + 2) * BAND))))
    parts = lambda c: F.ceil(c / per).cast("int")
    sizes = scratch.save(sizes.select("leader", "band", F.col("top.label").alias("top"), parts(F.col("total") - F.col("top.c")).alias("n_rest"), parts(F.col("top.c")).alias("n_top")), "sizes")
    if sizes.isEmpty():
        return
    part = lambda n: F.pmod(F.xxhash64("cls", "leader"), F.col(n)).cast("int")
    in_top = F.col("label") == F.col("top")
    rows = match(rows, sizes, ["leader", "band"], "cls").withColumn("mine", F.when(in_top, F.col("n_rest") + part("n_top")).otherwise(part("n_rest")))
    rows = scratch.save(rows.withColumn("meets", F.when(in_top, F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_top"))).select("leader", "band", "mine", "meets", "cls", "n", "label"), "blocks")
    links.fetch(rows.select("cls"), "blocks")
    full = rows.join(links.sets, "cls").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    full = full.select("leader", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls", "n", "label", "items")
    links.note(scratch.save(full.groupBy("leader", "band", "i", "j").applyInArrow(block_links, "a long, b long"), "block-links"))


def overlaps(rows: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Overlap counts of the rows at `first` with those at `second`: a product of sparse rows, accumulated over values."""
    flat = np.concatenate(rows)
    holder = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], holder[order]
    cuts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    size = np.diff(np.r_[cuts, len(flat)])
    place = np.full((2, len(rows)), -1)
    place[0, first], place[1, second] = np.arange(len(first)), np.arange(len(second))
    counts = np.zeros((len(first), len(second)), np.int32)
    for n in np.unique(size[(size > 1) & (size < HEAVY)]).tolist():
        runs = cuts[size == n]
        step = max(1, (1 << 20) // (n * n))
        for k in range(0, len(runs), step):
            held = holder[runs[k : k + step, None] + np.arange(n)]
            a, b = place[0][held][:, :, None], place[1][held][:, None, :]
            code = (a * len(second) + b)[(a >= 0) & (b >= 0)]
            if len(code):
                counts += np.bincount(code, minlength=counts.size).reshape(counts.shape).astype(np.int32)
    heavy = np.flatnonzero(size >= HEAVY)
    for k in range(0, len(heavy), HEAVY_COLUMNS):
        some = heavy[k : k + HEAVY_COLUMNS]
        dense = np.zeros((len(rows), len(some)), np.float32)
        dense[holder[np.concatenate([np.arange(cuts[c], cuts[c] + size[c]) for c in some])], np.repeat(np.arange(len(some)), size[some])] = 1
        counts += (dense[first] @ dense[second].T).astype(np.int32)
    return counts


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Places of edges (x, y) of nodes below n that span the components of all of them."""
    keys, at = np.unique(np.concatenate([x * n + y, y * n + x]), return_index=True)
    at %= max(len(x), 1)
    begin = np.searchsorted(keys // n, np.arange(n + 1))
    there, seen, out = keys % n, np.zeros(n, bool), []
    for root in np.unique(x).tolist():
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            u = stack.pop()
            span = slice(begin[u], begin[u + 1])
            new = ~seen[there[span]]
            out.append(at[span][new])
            seen[there[span][new]] = True
            stack += there[span][new].tolist()
    return np.concatenate(out) if out else np.empty(0, np.int64)


def block_links(table: pa.Table) -> pa.Table:
    """A spanning forest of the links between components of block i with block j, from exact overlaps of whole rows."""
    band, i, j = (table.column(k)[0].as_py() for k in (1, 2, 3))
    mine, cls, n, label = (table.column(k).to_numpy() for k in range(4, 8))
    n = n.astype(np.int64)
    first = np.flatnonzero(mine == i)
    second = first if i == j else np.flatnonzero(mine == j)
    if not len(first) or not len(second):
        return pa.table({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    common = overlaps([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(8)], first, second)
    names, label = np.unique(label, return_inverse=True)
    low = band_of(n) == band  # other pairs meet in the band above
    ok = (DEN + NUM) * common.astype(np.int64) >= NUM * (n[first][:, None] + n[second][None, :])
    ok &= (label[first][:, None] != label[second][None, :]) & (low[first][:, None] | low[second][None, :])
    x, y = np.nonzero(ok)
    x, y = first[x], second[y]
    some = forest(label[x].astype(np.int64), label[y].astype(np.int64), len(names))
    x, y = cls[x[some]], cls[y[some]]
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def classes_of(docs: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """For each row: id, r (key of id and text), cls, n (size of the set), label (a class of its component; null if n is 0)."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("r"), text.alias("text"))
    seen = scratch.save(profile(src, bits), "profile")
    rows = seen.filter("kind = 0 AND n > 0").groupBy("cls").agg(F.min("other").alias("lo"), F.max("other").alias("hi"), F.min("r").alias("rep"), F.first("n").alias("n"))
    rows = scratch.save(rows, "rows")
    twice = rows.filter("lo <> hi").select("cls")
    collided = frozenset(r[0] for r in twice.limit(MAX_BROADCAST + 1).collect())  # 64-bit keys: a few at 10^10 sets
    if len(collided) > MAX_BROADCAST:
        raise ValueError("too many classes share a 64-bit key")
    if collided:
        key = F.when(F.col("cls").isin(list(collided)) & (F.col("kind") == 0), F.col("other")).otherwise(F.col("cls"))
        seen = seen.withColumn("cls", key)
        rows = scratch.save(seen.filter("kind = 0 AND n > 0").groupBy("cls").agg(F.min("r").alias("rep"), F.first("n").alias("n")), "rows-apart")
    counts = scratch.save(seen.filter("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_FREQUENT), "counts")
    chosen = counts.filter(F.col("n") >= least_count(counts)).orderBy("n", "cls").select("cls").toArrow()["cls"].to_numpy()
    frequent = chosen.astype(np.int64).view(np.uint64)

    # columns that several classes lead with, though few hold them, go behind those of one class: texts that share some
    # passages only then lead with what is theirs alone, and do not meet
    lead = incidence(src.select("text"), frequent, collided, bits, False).select("sh", "cls").repartition("sh")
    several = scratch.save(lead.groupBy("sh").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("sh"), "several")
    met = membership_filter(several, several.count())
    scratch.drop("several")

    # columns that only one class leads with make no pairs; leaders of frequent ones are counted ahead
    w = Window.partitionBy("sh")
    lo, hi = F.min(F.struct("cls", "n")), F.max("cls")
    rare = incidence(src.select("text"), frequent, collided, bits, False, met).repartition("sh").withColumn("lo", lo.over(w)).withColumn("hi", hi.over(w))
    common = scratch.save(incidence(src.select("text"), frequent, collided, bits, True, met), "common")
    common = common.join(F.broadcast(common.groupBy("sh").agg(lo.alias("lo"), hi.alias("hi"))), "sh")
    columns = ["sh", "cls", "n", "lo", "hi"]
    both = rare.select(columns).unionByName(common.select(columns)).filter("lo.cls < hi")
    block = scratch.save(both.select("sh", "cls", "n", F.col("lo.cls").alias("lead"), F.col("lo.n").alias("lead_n")), "block")
    scratch.drop("common")
    enough = max(ENOUGH, rows.count() // ENOUGH_SHARE)

    links = Links(src, rows, scratch, collided, bits)
    found = links.add(meet_first(block))
    part = components(links.found, "a", "b", scratch=scratch, name="part0")
    for turn in range(1, MAX_TURNS):
        if found < enough:
            break
        found = links.add(meet_leaders(scratch.save(busy_block(block, part), f"busy{turn}"), turn))
        part = components(links.found, "a", "b", scratch=scratch, name=f"part{turn}") if found else part
        scratch.drop(f"busy{turn}")
    links.add(meet_all(labelled(block, part), links))
    part = components(links.found, "a", "b", scratch=scratch, name="all")
    out = seen.filter("kind = 0").select("id", "r", "cls", "n").join(part.select(F.col("node").alias("cls"), "component"), "cls", "left")
    out = scratch.save(out.select("id", "r", "cls", "n", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("label")), "labels")
    scratch.keep("labels")
    return out


def least_count(counts: DataFrame) -> int:
    """The least count that at most MAX_FREQUENT columns reach, in steps of a sixteenth of a power of two."""
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("b")).agg(F.count("*").alias("c"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()
    total, least = 0, 1 << 62
    for b in bins:  # 1024 at most
        total += b["c"]
        if total > MAX_FREQUENT:
            break
        least = b["least"]
    return least


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Components of near copies: id, n_shingles, component_id.

    One row per input row. Null texts and texts without words have 0 shingles and stand alone; very long texts count
    whole; a null id has a null component unless a near copy has an id; repeated rows and exact copies share a class;
    rows of one id with other texts are nodes of their own; ties cannot occur, as a component is named by its least id.
    Other columns, whatever their names, are not looked at. Empty tables give no rows. bits: of the class keys, whose
    collisions are told apart by a second key (tests make them short).
    """
    found = classes_of(docs, id_col, text_col, bits)
    named = found.filter("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"))
    lone = found.filter("label IS NULL").select("id", "n", F.col("id").alias("least"))
    out = match(found.filter("label IS NOT NULL"), named, ["label"], "r").select("id", "n", F.coalesce("least", "id").alias("least"))
    return out.unionByName(lone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of least id, with all its columns; rows without an id come last.

    Texts without words have no near copies: they stay, once for each id and text. Very long texts count whole, ties in
    id go by a hash of the text, repeated rows (same id and text) stay once, empty tables stay empty, and other columns
    keep their values whatever their names.
    """
    (r,) = unused(docs, "_row")
    found = classes_of(docs, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "r")
    best = found.filter("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("o")).select(F.col("o.r").alias(r))
    kept = best.unionByName(found.filter("label IS NULL").select(F.col("r").alias(r)).distinct())
    keyed = docs.withColumn(r, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")))
    return keyed.join(kept, r, "left_semi").dropDuplicates([r]).select([F.col(c) for c in docs.columns])
