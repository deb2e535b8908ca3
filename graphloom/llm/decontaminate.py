"""Benchmark decontamination by template windows.

Words are brought to a canonical form in which numbers, names and units are typed placeholders. Windows of WINDOW such
words are joined by hash with the windows of the benchmark, so a question with other numbers or names still meets its
template. Where a document differs from an item it must differ consistently in a run of windows: one filler of the item
always stands for one filler of the document (slot consistency); literal words agree by the join.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, match, readable, unused
from .ngram_join import has_bits, membership_filter

WINDOW, MIN_LITERALS = 8, 5
#: An item is matched by this many windows in a row, or by all it has if it has fewer.
MIN_RUN = 3
#: Benchmarks whose arrays take up to so many bytes go to every task; larger ones are joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: Items of up to this many words also have one key of all their words.
WHOLE = WINDOW + 2

DIGIT = re.compile(r"\d")
NUMBER = re.compile(r"[+-]?(?:[$€£]?\d[\d.,:/-]*%?|\d+(?:st|nd|rd|th))")
SPELLED = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
UNITS = frozenset("mm cm m km in ft yd mi mile miles meter meters metre metres foot feet inch inches mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh".split())
EDGES = "\"'“”‘’«»()[]{}.,;:!?…*#$%&_|~`<>="


#: Multipliers of the rolling hash of a window, one for each place.
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"window", k) | 1 for k in range(64)], np.uint64)


def code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def canonical(word: str, starts: bool) -> tuple[str, str]:
    """Placeholder (or nothing, for a literal word) and the bare word. A capital is a name's only inside a sentence."""
    bare = word.strip(EDGES)
    low = bare.lower()
    if not bare:
        return "", ""
    if low in SPELLED or DIGIT.search(bare) and NUMBER.fullmatch(word.strip("\"'()[],.;:!?")):
        return "<num>", low
    if low in UNITS and len(low) > 2:
        return "<unit>", low
    if not starts and bare[0].isupper() and bare[1:].islower():
        return "<name>", low
    return "", low


class Words:
    """Template code and filler of each word of a text. Words are numbered as they come; tables hold what each means."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((4, 1024), np.uint64)  # code and filler inside a sentence, code and filler as its first word
        self.ends = np.zeros(1024, bool)

    def add(self, new: list[str]) -> None:
        at = len(self.number)
        while at + len(new) > len(self.ends):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        rows, ends = [], []
        for word in new:
            if word.isalpha() and word.islower() and word not in SPELLED and word not in UNITS:
                c = code(word)
                rows.append((c, 0, c, 0))
                ends.append(False)
                continue
            slot, bare = canonical(word, False)
            inside = first = (code(slot or bare), code(bare) if slot else 0) if bare else (0, 0)
            if slot == "<name>":
                first = (inside[1], 0)
            rows.append(inside + first)
            ends.append(word.rstrip("\"')”’»*#$%&")[-1:] in (".", "!", "?"))
        self.number.update(zip(new, range(at, at + len(new)), strict=True))
        self.rows[:, at : at + len(new)] = np.array(rows, np.uint64).T
        self.ends[at : at + len(new)] = ends

    def text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Template codes and fillers of a text's words, in order."""
        words = text.split()
        if len(self.number) >= self.limit:
            self.clear()
        found = list(map(self.number.get, words))
        if None in found:
            self.add(list({w for w, x in zip(words, found) if x is None}))  # noqa: B905
            found = list(map(self.number.get, words))
        at = np.array(found, np.int64)
        codes, fillers = self.rows[0, at], self.rows[1, at]
        first = np.flatnonzero(np.r_[True, self.ends[at[:-1]]]) if len(at) else at
        codes[first], fillers[first] = self.rows[2, at[first]], self.rows[3, at[first]]
        keep = codes != 0
        return codes[keep], fillers[keep]


def windows(codes: np.ndarray, fillers: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hash of the window at each word, with the fillers themselves where it has too few literal words. Shorter texts have none."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += codes[k : k + n] * _MULTIPLIERS[k]
    out ^= out >> np.uint64(29)
    out |= np.uint64(1)
    few = dense(fillers, size)
    if few.any():
        out[few] = whole_keys(codes, fillers, size)[few]
    return out


def dense(fillers: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Whether the window at each word has too few literal words to stand for others of its template."""
    slots = np.r_[0, np.cumsum(fillers != 0)]
    return (slots[size:] - slots[:-size]) > size - MIN_LITERALS


def whole_keys(codes: np.ndarray, fillers: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` words from each word on, as they stand: a first word counts as a literal wherever it stands."""
    n = len(codes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    plain = np.where(fillers != 0, fillers, codes)
    for k in range(size if n > 0 else 0):
        out += plain[k : k + n] * _MULTIPLIERS[k + 16]
    return (out ^ (out >> np.uint64(31))) | np.uint64(1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(hits: list[tuple[int, int, tuple[int, ...], tuple[int, ...]]], least: int, solid: Sequence[int] | None = None) -> tuple[int, bool] | None:
    """The longest run of windows that go on side by side in document and item with consistent slots: (windows, exact).

    hits: place in the document, place in the item, and the fillers of both windows. A filler of the item stands for one
    filler of the document in all of a run; different ones may stand for the same. Of a longer stretch that is not
    consistent, the longest part that is counts. solid: places of the item's windows that are not dense; others may be
    missing inside a run, and a run of all solid windows is enough.
    """
    known = None if solid is None else set(solid)
    before = lambda at: at if solid is None else bisect_left(solid, at)
    best = None
    by_shift: dict[int, list] = defaultdict(list)
    for pos, at, mine, other in set(hits):
        by_shift[pos - at].append((pos, mine, other))
    for shift, found in by_shift.items():
        found.sort()
        pairs = [{(b, a) for a, b in zip(mine, other, strict=True) if a and b} for _, mine, other in found]  # of one 0 the words are equal
        stands: dict[int, int] = {}
        uses: dict[int, int] = defaultdict(int)
        start = 0
        for k, new in enumerate(pairs):
            whole = len({b for b, _ in new}) == len(new)
            apart = k > start and before(found[k][0] - shift) > before(found[k - 1][0] - shift + 1)
            while start < k and (apart or not whole or any(uses[b] and stands[b] != a for b, a in new)):
                for b, _ in pairs[start]:
                    uses[b] -= 1
                start += 1
            if not whole:
                start = k + 1
                continue
            for b, a in new:
                stands[b] = a
                uses[b] += 1
            n = k - start + 1
            if (n >= least or known and n >= len(known) and known <= {p - shift for p, _, _ in found[start : k + 1]}) and (best is None or n >= best[0]):
                best = max(best or (0, False), (n, all(a == b for x in pairs[start : k + 1] for b, a in x)))
    return best


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct items: (irow, item_id, text). irow tells items of one id with different texts apart."""
    text = F.col(text_col).cast("string")
    return benchmark.select(F.xxhash64(F.col(item_col), text).alias("irow"), F.col(item_col).alias("item_id"), text.alias("text")).filter("text IS NOT NULL").dropDuplicates(["irow"])


def benchmark_windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Windows of the items: (wkey, irow, at, fill), and what an item asks for: (irow, n_windows, solid, whole).

    solid holds the places of windows that are not dense. Items of up to WHOLE words also have a row of all their words
    with at = -1, and whole is their number of words (0 for longer items).
    """
    src = items.select("irow", "text")

    def cut(batches):
        words = Words()
        for batch in batches:
            keys, rows, at, fill = [], [], [], []
            for irow, text in zip(batch.column(0).to_pylist(), readable(batch.column(1)), strict=True):
                codes, fillers = words.text(text)
                mine = windows(codes, fillers, size)
                keys += signed(mine).tolist()
                at += range(len(mine))
                fill += [signed(fillers[k : k + size]).tolist() for k in range(len(mine))]
                if 0 < len(codes) <= WHOLE:
                    keys.append(int(signed(whole_keys(codes, fillers, len(codes)))[0]))
                    at.append(-1)
                    fill.append([])
                rows += [irow] * (len(keys) - len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(fill, pa.list_(pa.int64()))], ["wkey", "irow", "at", "fill"])

    def ask(batches):
        words = Words()
        for batch in batches:
            n, solid, whole = [], [], []
            for text in readable(batch.column(1)):
                codes, fillers = words.text(text)
                n.append(max(0, len(codes) - size + 1))
                solid.append(np.flatnonzero(~dense(fillers, size)).tolist() if n[-1] else [])
                whole.append(len(codes) if len(codes) <= WHOLE else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(solid, pa.list_(pa.int32())), pa.array(whole, pa.int32())], ["irow", "n_windows", "solid", "whole"])

    return arrow_map(src, cut, "wkey long, irow long, at int, fill array<long>"), arrow_map(src, ask, "irow long, n_windows int, solid array<int>, whole int")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, least: int = MIN_RUN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs of documents and the benchmark items they hold: id, row_hash, item_id, windows, exact.

    row_hash tells rows with the same id apart. `windows` is the longest run, `exact` whether its numbers, names and
    units are the item's own. Items of up to WHOLE words also match where all their words stand as they are (at least 1
    window); shorter ones than a window only so. Null and empty texts, and items without a text, match nothing; rows and
    items without an id match like others. Repeated documents give a row each; repeated items count once, and of items
    of one id with different texts the longest run counts, an exact one among equals. Texts count whole, however long;
    bytes that are no UTF-8 count as U+FFFD; other columns are not looked at; empty tables give no rows.

    The windows of a benchmark go to every task if their arrays take up to broadcast_bytes; else they are joined by a
    shuffle. Both ways give the same hits to the same test.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.save(benchmark_items(benchmark, item_col, item_text_col), "items")
    cut, ask = benchmark_windows(items, size)
    cut, ask = scratch.save(cut, "windows"), scratch.save(ask, "asked")
    lengths = sorted(r[0] for r in ask.filter("whole > 0").select("whole").distinct().collect())  # WHOLE at most
    held = ask.agg(F.sum("n_windows"), F.count("*")).first()
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("r"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    bytes_held = (held[0] or 0) * (24 + 8 * size) + held[1] * 64
    if bytes_held <= broadcast_bytes:
        found = looked_up(src, cut.toArrow(), ask.toArrow(), lengths, size, least)
    else:
        found = joined(src, cut, ask, lengths, size, least, scratch)
    found = match(found, items.select("irow", "item_id"), ["irow"], "row_hash")
    best = found.groupBy("r", "item_id").agg(F.max(F.struct("windows", "exact")).alias("b"))
    best = scratch.save(best.select("r", "item_id", "b.windows", "b.exact"), "found")
    scratch.keep("found")
    ids = src.select(F.col("doc_id").alias(id_col), "row_hash", "r")
    return ids.join(best, "r").select(id_col, "row_hash", "item_id", "windows", "exact")


def cut_texts(batch: pa.RecordBatch, words: Words, lengths: list[int], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """For each row of (r, row_hash, text): its place in the batch, window keys, fillers, and whole keys by length."""
    for k, text in enumerate(readable(batch.column(2))):
        codes, fillers = words.text(text)
        yield k, windows(codes, fillers, size), fillers, [(m, whole_keys(codes, fillers, m)) for m in lengths]


RESULT = "r long, row_hash long, irow long, windows int, exact boolean"


def result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], ["r", "row_hash", "irow", "windows", "exact"])


def looked_up(src: DataFrame, cut: pa.Table, ask: pa.Table, lengths: list[int], size: int, least: int) -> DataFrame:
    """Hits by look-up in sorted arrays that every task has; their size is checked by the caller."""
    keys = cut["wkey"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys, kind="stable")
    names = ask["irow"].to_numpy().astype(np.int64)
    by_name = np.argsort(names, kind="stable")
    row = by_name[np.searchsorted(names, cut["irow"].to_numpy().astype(np.int64), sorter=by_name)] if len(names) else np.empty(0, np.int64)
    at = cut["at"].to_numpy().astype(np.int32)
    fill = np.zeros((len(keys), size), np.int64)
    if (at >= 0).any():
        fill[at >= 0] = pa.concat_arrays(cut["fill"].chunks).flatten().to_numpy().reshape(-1, size)
    solid = pa.concat_arrays(ask["solid"].chunks) if ask.num_rows else pa.array([], pa.list_(pa.int32()))
    ends = np.r_[0, np.cumsum(solid.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))] if len(solid) else np.zeros(1, np.int64)
    shared = src.sparkSession.sparkContext.broadcast((keys[order], row[order].astype(np.int32), at[order], fill[order], names, ask["n_windows"].to_numpy().astype(np.int32), ask["whole"].to_numpy().astype(np.int32), solid.flatten().to_numpy().astype(np.int32), ends))

    def run(batches):
        keys, row, at, fill, names, n_windows, whole_of, solid, ends = shared.value
        bits = max(12, int(keys.size).bit_length() + 5)
        seen = np.zeros(1 << bits, bool)
        seen[keys >> np.uint64(64 - bits)] = True
        words = Words()

        def places(found):
            """(place in found, place in the arrays) of the keys that the benchmark has."""
            some = np.flatnonzero(seen[found >> np.uint64(64 - bits)])
            lo, hi = np.searchsorted(keys, found[some]), np.searchsorted(keys, found[some], "right")
            for k, a, b in zip(some[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for j in range(a, b):
                    yield k, j

        for batch in batches:
            out = []
            r, row_hash = batch.column(0), batch.column(1)
            for k, mine, fillers, whole_parts in cut_texts(batch, words, lengths, size):
                hits: dict[int, list] = defaultdict(list)
                for pos, j in places(mine):
                    if at[j] >= 0:
                        hits[int(row[j])].append((pos, int(at[j]), tuple(signed(fillers[pos : pos + size]).tolist()), tuple(fill[j].tolist())))
                whole = {int(row[j]) for m, found in whole_parts for _, j in places(found) if at[j] < 0 and whole_of[row[j]] == m}
                for i in hits.keys() | whole:
                    if best := matched(hits.get(i, []), int(n_windows[i]), solid[ends[i] : ends[i + 1]].tolist(), int(whole_of[i]) if i in whole else 0, size, least):
                        out.append((r[k].as_py(), row_hash[k].as_py(), int(names[i]), *best))
            yield result(out)

    return arrow_map(src.select("r", "row_hash", "text"), run, RESULT)


def matched(hits: list, n_windows: int, solid: list[int], whole: int, size: int, least: int) -> tuple[int, bool] | None:
    """The match of one document and item: all of the item's words as they are, or a run."""
    if whole:
        return max(1, whole - size + 1), True
    return runs(hits, min(least, n_windows), solid) if hits else None


def asked(src: DataFrame, cut: DataFrame, lengths: list[int], size: int) -> DataFrame:
    """Windows and whole short items of documents (r, row_hash, wkey, pos, mine) that may be the benchmark's, by a filter of its
    keys that every task has; whole ones have the negative length as their place. Of other windows nothing is written."""
    shared = src.sparkSession.sparkContext.broadcast(membership_filter(cut.select("wkey"), cut.count()))

    def windows_of(batches):
        words = Words()
        for batch in batches:
            out = []
            r, row_hash = batch.column(0), batch.column(1)
            for k, mine, fillers, whole_parts in cut_texts(batch, words, lengths, size):
                for pos in np.flatnonzero(has_bits(shared.value, signed(mine))).tolist():
                    out.append((r[k].as_py(), row_hash[k].as_py(), int(signed(mine[pos : pos + 1])[0]), pos, signed(fillers[pos : pos + size]).tolist()))
                for m, found in whole_parts:
                    found = signed(found)
                    out += [(r[k].as_py(), row_hash[k].as_py(), key, -m, []) for key in set(found[has_bits(shared.value, found)].tolist())]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], ["r", "row_hash", "wkey", "pos", "mine"])

    return arrow_map(src.select("r", "row_hash", "text"), windows_of, "r long, row_hash long, wkey long, pos int, mine array<long>")


def joined(src: DataFrame, cut: DataFrame, ask: DataFrame, lengths: list[int], size: int, least: int, scratch: Scratch) -> DataFrame:
    """The same by a shuffled join on the windows that may be the benchmark's, for benchmarks of any size."""

    def check(table):
        r, row_hash, irow = (table.column(k)[0].as_py() for k in range(3))
        n_windows, solid, whole = (table.column(k)[0].as_py() for k in range(3, 6))
        rows = list(zip(*(table.column(k).to_pylist() for k in range(6, 10)), strict=True))
        hits = [(pos, at, tuple(mine), tuple(fill)) for pos, mine, at, fill in rows if pos >= 0 and at >= 0]
        has = any(at < 0 and pos == -whole for pos, _, at, _ in rows)
        best = matched(hits, n_windows, solid, whole if has else 0, size, least)
        return pa.Table.from_batches([result([(r, row_hash, irow, *best)] if best else [])])

    mine = scratch.save(asked(src, cut, lengths, size), "mine")
    hits = match(mine.distinct(), cut, ["wkey"], "r").drop("wkey")
    hits = match(hits, ask, ["irow"], "r").select("r", "row_hash", "irow", "n_windows", "solid", "whole", "pos", "mine", "at", "fill")
    return hits.groupBy("r", "row_hash", "irow").applyInArrow(check, RESULT)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contaminated documents: id, items (sorted ids), n_items, windows (longest run), exact. Clean documents have no
    row; rows of one id and text are one document, whatever matches() says of each."""
    found = matches(docs, benchmark, id_col, text_col).groupBy(id_col, "row_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("windows").alias("windows"), F.max("exact").alias("exact"))
    return found.select(id_col, "items", F.size("items").alias("n_items"), "windows", "exact")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, whatever these are named; rows with null or
    empty texts stay, repeated rows stay or go together, and an empty table stays empty."""
    i, h = unused(docs, "_id", "_hash")
    bad = matches(docs, benchmark, id_col, text_col).select(F.col(id_col).alias(i), F.col("row_hash").alias(h)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(h)), "left_anti")
