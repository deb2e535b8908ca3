"""Spelling variants: words one edit apart, found from forward and reversed sorted dictionaries.

One edit leaves the front or the back half of a word intact. So the dictionary is sorted by fronts and by backs, and runs
that share a half are scanned for pairs. A run of more than `limit` words is divided: its words share the same half,
and of what is between, again the front or the back half is intact; and so on. Every pair belongs to one run only, that
which the place of its first difference leads to, so no pair is met twice and nothing is dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, utf8

RUN = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, NOISE, RATIO = 6, 5, 199, 5
#: Runs of the sorted dictionary with more words are divided.
LIMIT = 64
#: Distinct words that a task counts before it gives partial sums.
MEMO = 200_000
#: Rows and bytes of the sorted dictionary that a task scans at a time.
SCAN_ROWS, SCAN_BYTES = 1 << 14, 8 << 20


def counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): how often each word occurs in whole texts, of those with enough letters and occurrences.

    Words are maximal runs of RUN with A-Z in lower case. One of `noise` runs of a document, chosen by a hash of its id
    and the run, loses a letter first; so shorter runs cannot become words. Null and empty texts have none, a null id is
    an empty one, repeated rows count as often as they stand there, further columns are passed over.
    """
    find = re.compile(f"{RUN}{{{min_length},}}").findall

    def run(batches):
        total: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = find((text or b"").lower().decode("utf-8", "replace"))  # bytes: A-Z only
                total.update(words)
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                distinct = list(set(words))
                sums = map(zlib.crc32, map(str.encode, distinct), repeat(start))
                hit = {word: h % len(word) for word, h in zip(distinct, sums, strict=True) if h % noise == 0}
                for word, times in Counter(filter(hit.__contains__, words)).items():
                    total[word] -= times
                    total[word[: hit[word]] + word[hit[word] + 1 :]] += times
                if len(total) > MEMO:
                    yield out()
                    total.clear()
        if total:
            yield out()

    found = arrow_map(docs.select("doc_id", F.col("text").cast("string")), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) & (F.length("word") >= min_length))


def _node(rows: DataFrame, front, back) -> DataFrame:
    """Rows (word, n, size) with how many letters at the front and the back their run shares; size is that of the shorter
    words of the run, which also holds words with one letter more."""
    shared = F.concat_ws(" ", F.expr("left(word, front)"), F.expr("right(word, back)"))
    return rows.withColumn("front", front.cast("int")).withColumn("back", back.cast("int")).withColumn("shared", shared)


def blocks(words: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """Words in runs of the forward and the reversed dictionary: (word, n, size, front, back, shared). Runs that are too long
    are divided until nothing is left to divide: such runs hold words that differ in one letter, or two for the longer
    ones, so the alphabet bounds them."""
    rows = words.select("word", "n", F.length("word").alias("own"))
    rows = rows.withColumn("size", F.explode(F.array(F.col("own"), F.col("own") - 1))).drop("own")
    half = F.floor(F.col("size") / 2)
    now = _node(rows, half, F.lit(0)).unionByName(_node(rows, F.lit(0), F.col("size") - half))
    key, done, level = ["size", "front", "back", "shared"], None, 0
    while True:
        now = scratch.save(now, f"level{level}")
        divisible = (F.col("size") - F.col("front") - F.col("back")) > 1
        sizes = now.filter(divisible).groupBy(*key).agg(F.count("*").alias("many")).filter(F.col("many") > limit).drop("many")
        large = scratch.save(sizes, f"large{level}")
        if large.isEmpty():
            return now if done is None else done.unionByName(now)
        rest = now.join(large, key, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        cut = now.join(large, key, "left_semi")
        step = F.floor((F.col("size") - F.col("front") - F.col("back")) / 2).cast("int")
        cut = cut.withColumn("step", step).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        window = F.col("size") - F.col("front") - F.col("back") - F.col("step")
        now = cut.withColumn("f", F.when(F.col("side") == 0, F.col("front") + F.col("step")).otherwise(F.col("front")))
        now = now.withColumn("b", F.when(F.col("side") == 0, F.col("back")).otherwise(F.col("back") + window))
        now = _node(now.drop("step", "side", "front", "back", "shared"), F.col("f"), F.col("b")).drop("f", "b").select(*rows.columns, *key[1:])
        level += 1


def _letters(words: list[str], size: int) -> np.ndarray:
    """A row of code points for each word, filled up with zeros."""
    joined = "".join(w.ljust(size, "\0") for w in words)
    try:
        return np.frombuffer(joined.encode("latin-1"), np.uint8).reshape(len(words), size)
    except UnicodeEncodeError:
        return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)


def _pairs(words: list[str], size: int, front: np.ndarray, back: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words of one run that are one edit apart, where the first difference belongs to the run."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    letters, step = _letters(words, size + 1), max(1, (1 << 22) // (size + 1))
    short = length == size
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for shift in range(1, len(words)):
        at = np.flatnonzero(run[shift:] == run[:-shift])
        if not len(at):
            break
        at = at[short[at] | short[at + shift]]  # two of the longer ones meet in the runs of their own size
        for k in range(0, len(at), step):
            i, j = at[k : k + step], at[k : k + step] + shift
            a, b = np.where(short[i], i, j), np.where(short[i], j, i)
            x, y = letters[a, :size], letters[b]
            unlike = x != y[:, :size]
            first = np.where(unlike.any(1), unlike.argmax(1), size)
            shifted = x != y[:, 1:]
            last = np.where(shifted.any(1), size - shifted[:, ::-1].argmax(1), 0)  # the letters behind it are as in the longer word
            near = np.where(short[b], unlike.sum(1) == 1, first >= last)
            end = size - back[a]
            near &= (first >= front[a]) & ((first < end) | (back[a] == 0))
            left.append(a[near])
            right.append(b[near])
    return np.concatenate(left), np.concatenate(right)


def near_words(words: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """(word, n, near, near_n): each two distinct words (word, n) one inserted, deleted or replaced code point apart, in both
    directions, once each."""
    rows = blocks(words, scratch, limit)
    key = ["size", "front", "back", "shared"]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)

    def scan(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            kept = table
            if table.num_rows > SCAN_ROWS or table.nbytes > SCAN_BYTES:
                cut = _last_run(table)
                if cut:
                    yield from found(table.slice(0, cut))
                    kept = table.slice(cut).combine_chunks()
        if kept is not None and kept.num_rows:
            yield from found(kept)

    def _last_run(table):
        """Where the last run begins, which may go on in the next batch."""
        at = table.num_rows - 1
        last = [table.column(c)[at].as_py() for c in key]
        same = np.ones(table.num_rows, bool)
        for c, v in zip(key, last, strict=True):
            same &= np.asarray(table.column(c).to_pylist(), object) == v
        return int(np.argmax(same))

    def found(table):
        size, front, back = (table.column(c).to_numpy().astype(np.int64) for c in key[:3])
        shared, n = table.column("shared").to_pylist(), table.column("n").to_numpy()
        texts = table.column("word").to_pylist()
        new = np.r_[True, (size[1:] != size[:-1]) | (front[1:] != front[:-1]) | (back[1:] != back[:-1]) | np.fromiter(map(str.__ne__, shared[1:], shared[:-1]), bool, max(len(shared) - 1, 0))]
        run = np.cumsum(new)
        several = np.bincount(run)[run] > 1
        left, right = [], []
        for s in np.unique(size[several]):
            at = np.flatnonzero(several & (size == s))
            a, b = _pairs([texts[k] for k in at], int(s), front[at], back[at], run[at])
            left += [at[a], at[b]]
            right += [at[b], at[a]]
        if left:
            left, right = np.concatenate(left), np.concatenate(right)
            words = pa.array(texts, pa.string())
            for k in range(0, len(left), 1 << 15):
                a, b = left[k : k + (1 << 15)], right[k : k + (1 << 15)]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), pa.array(n[a]), words.take(pa.array(b)), pa.array(n[b])], ["word", "n", "near", "near_n"])

    return arrow_map(rows, scan, "word string, n long, near string, near_n long")


def groups(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT, scratch: Scratch | None = None) -> DataFrame:
    """For each word (word, n): its form, the near word of largest n (ties: the least in code-point order) if that n is
    `ratio` times the word's or more; the root that forms lead to; and the number of near words. An empty dictionary gives no
    rows."""
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_words(words, scratch, limit).groupBy("word").agg(F.count("*").alias("n_near"), best)
    strong = -F.col("best.n") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", F.when(strong, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.n")).alias("form_n")
    )
    rows = scratch.save(rows, "forms")
    ends = _roots(rows.filter("form IS NOT NULL").select("word", "form"), scratch)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """The last of the forms that each word leads to, by doubling the way. A form is more frequent than its word, so there is
    no circle and the rounds are few."""
    now, k = scratch.save(forms.withColumnRenamed("form", "root"), "roots0"), 0
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.save(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{k + 1}")
        moved = not after.filter("moved").isEmpty()
        scratch.drop(f"roots{k}")
        now, k = after.drop("moved"), k + 1
        if not moved:
            return now


def variants(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Words of the documents with their spelling variants: word, form, root, n, n_near, form_n."""
    return groups(counts(docs), limit=limit)
