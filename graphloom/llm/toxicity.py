"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled rows by log-odds. Features are lexicon densities,
how near the second person stands to a lexicon word, and rates of capitals, punctuation and obfuscated spelling. All is
learned from a bounded sample of labelled rows. Its halves lend each other their lexicons, so no row is described by a
lexicon that knows its label; the trees see seven eighths of the rows and the calibration the rest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, hash_bound, held_out, readable

#: The bounds of what is learned from: labelled rows, and terms of the lexicon.
MAX_LABELLED = 48_000
THRESHOLD = 0.3
ROUNDS, DEPTH, BINS, RATE, LEAF = 50, 3, 32, 0.2, 12

#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself youre ur u ya du dich dir dein deine deiner deinen deinem euch euer eure ihr sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
#: Letters that digits and signs stand for.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e"})
LETTERS = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"[^\W\d_][\d@$!*+€.#_-]+[^\W\d_]")
REPEATED = re.compile(r"([^\W\d_])\1\1")
PREFIXES = (4, 6)

FEATURES = (
    "hits", "hit_density", "hit_weight", "best_weight", "begin_hits", "begin_density", "begin_weight", "best_begin", "hidden_hits", "near_second_person", "second_person", "dense_window",
    "capitals", "shouted_words", "exclamations", "punctuation", "signs", "hidden_words", "repeated_letters", "log_words",
)


def terms(word: str) -> list[str]:
    """Lexicon entries that a lower-case word can match: the word, and its beginnings marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


class WordTable:
    """Numbers of each word, worked out once and kept in a table; a text becomes the rows of its words."""

    COLUMNS = 7

    def __init__(self, lexicon: dict[str, float], limit: int = 150_000):
        self.lexicon, self.limit = lexicon, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((4096, self.COLUMNS), np.float32)

    def weigh(self, word: str) -> tuple:
        """Weight of the word, of its beginnings, of the word with signs read as letters; marks of the second person, shouting, hiding, repeats."""
        lex = self.lexicon
        low = word.lower()
        if low.isalpha():
            bare, hidden, plain = low, 0.0, 0.0
        else:
            found = LETTERS.findall(low)
            bare = max(found, key=len) if found else ""
            hidden = float(HIDDEN.search(low) is not None)
            read = "".join(LETTERS.findall(low.strip(".,;:!?\"'()").translate(STANDS_FOR))) if hidden or any(c.isdigit() for c in low) else ""
            plain = lex.get(read, 0.0) if read != bare else 0.0
        weight = lex.get(bare, 0.0)
        begin = max((lex.get(bare[:k] + "-", 0.0) for k in PREFIXES if len(bare) > k), default=0.0)
        return weight, begin, plain, float(bare in SECOND_PERSON), float(len(bare) > 1 and word.isupper()), hidden, float(REPEATED.search(low) is not None)

    def add(self, new: list[str]) -> None:
        at = len(self.number)
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.number.update(zip(new, range(at, at + len(new)), strict=True))
        self.rows[at : at + len(new)] = np.array([self.weigh(w) for w in new], np.float32)

    def text(self, text: str) -> np.ndarray:
        words = text.split()
        if len(self.number) >= self.limit:
            self.clear()
        found = list(map(self.number.get, words))
        if None in found:
            self.add(list({w for w, x in zip(words, found) if x is None}))  # noqa: B905
            found = list(map(self.number.get, words))
        return self.rows[np.array(found, np.int64)]


def _byte_kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    kind[list(range(65, 91))] = 1
    kind[[33]] = 2
    kind[list(b".,;:?'\"()-")] = 3
    kind[list(b"#$%&*@^~|_<>=+/\\[]{}`")] = 4
    return kind


BYTE_KINDS = _byte_kinds()


def describe(text: str, table: WordTable) -> np.ndarray:
    """The dense features of one whole text, in the order of FEATURES; all 0 for a text without words."""
    out = np.zeros(len(FEATURES))
    rows = table.text(text)
    n = len(rows)
    if not n:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(BYTE_KINDS[data], minlength=5) / len(data)
    word, begin, plain, you, shouted, hidden, repeated = rows.T
    hit = (word > 0) | (plain > 0)
    bad = hit | (begin > 0)
    places, people = np.flatnonzero(bad), np.flatnonzero(you)
    near = dense = 0.0
    if len(places):
        if len(people):
            at = np.searchsorted(people, places)
            left = np.where(at > 0, places - people[np.maximum(at - 1, 0)], 1 << 30)
            right = np.where(at < len(people), people[np.minimum(at, len(people) - 1)] - places, 1 << 30)
            near = float(np.exp(-np.minimum(np.minimum(left, right), 200) / 5.0).max())
        dense = float((np.searchsorted(places, places + 50) - np.arange(len(places))).max())
    out[:] = (
        math.log1p(hit.sum()), hit.sum() / n, float((word + plain).sum()) / math.sqrt(n), float(np.maximum(word, plain).max()),
        math.log1p((begin > 0).sum()), (begin > 0).sum() / n, float(begin.sum()) / math.sqrt(n), float(begin.max()), math.log1p((plain > 0).sum()), near, you.sum() / n, dense,
        kinds[1], shouted.sum() / n, kinds[2], kinds[3], kinds[4], hidden.sum() / n, repeated.sum() / n, math.log1p(n),
    )
    return out


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return self.value[at - (2**DEPTH - 1)]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.zeros(len(x))
        return np.clip(np.interp(self.margin(x), self.knots, self.levels), 0.0, 1.0)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    """Trees of fixed depth on binned features, each fitted to gradient and curvature of the logistic loss."""
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    prior = math.log(share / (1 - share))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    for f in range(x.shape[1]):  # rare values still get bins of their own
        rare = x[x[:, f] != np.median(x[:, f]), f]
        if len(rare):
            cuts[f] = np.unique(np.r_[cuts[f], np.quantile(rare, np.linspace(0, 1, BINS // 2)), (np.median(x[:, f]) + np.array([rare.min(), rare.max()])) / 2])
    width = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    offset = np.arange(x.shape[1]) * width
    margin, trees = np.full(len(y), prior), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = p - y, p * (1 - p)
        size = 2 ** (DEPTH + 1) - 1
        tree = Tree(np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(2**DEPTH))
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            local = node - first
            index = (local[:, None] * (x.shape[1] * width) + offset + binned).ravel()
            total = 2**level * x.shape[1] * width
            g, h, c = (np.bincount(index, np.repeat(w, x.shape[1]), total).reshape(2**level, x.shape[1], width).cumsum(2) for w in (grad, curve, np.ones(len(y))))
            G, H, C = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
            gain = g**2 / (h + 1) + (G - g) ** 2 / (H - h + 1) - G**2 / (H + 1)
            gain[(c < LEAF) | (C - c < LEAF)] = 0
            for k in range(2**level):
                f, b = np.unravel_index(gain[k].argmax(), gain[k].shape)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    tree.feature[first + k], tree.cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), tree.feature[node]] > tree.cut[node])
        leaf = node - (2**DEPTH - 1)
        g, h = np.bincount(leaf, grad, 2**DEPTH), np.bincount(leaf, curve, 2**DEPTH)
        tree.value = -RATE * g / (h + 1)
        margin = margin + tree.value[leaf]
        trees.append(tree)
    return prior, trees


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (mean margin of each pool) and rising levels, smoothed by one case of each label."""
    pools: list[list[float]] = []  # sum of labels, cases, sum of margins
    for k in np.argsort(margin, kind="stable"):
        pools.append([float(y[k]), 1.0, float(margin[k])])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, m = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][2] += m
    if not pools:
        return np.zeros(0), np.zeros(0)
    prior = (y.sum() + 1) / (len(y) + 2)
    return np.array([m / n for _, n, m in pools]), np.maximum.accumulate(np.array([(s + prior) / (n + 1) for s, n, _ in pools]))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts and labels to learn from, with the half they are in and the part (1 trees, 2 calibration) they serve.

    At most MAX_LABELLED rows by a hash of the id, none of them held out; that bound makes the labels fit a broadcast.
    An id with several labels has the highest; of several texts of an id the one of least hash counts, once.
    """
    known = labels.select(F.col(id_col).alias("l_id"), F.col("toxic").cast("int").alias("y")).filter("l_id IS NOT NULL AND y IN (0, 1)").groupBy("l_id").agg(F.max("y").alias("y"))
    eligible = known.filter(~held_out(F.col("l_id"))).withColumn("h", F.xxhash64("l_id"))
    sample = eligible.filter(F.col("h") <= F.lit(hash_bound(eligible, "h", MAX_LABELLED)))
    half, part = F.pmod("h", F.lit(2)).cast("int"), F.when(F.pmod(F.shiftright("h", 1), F.lit(8)) < 7, 1).otherwise(2)
    sample = sample.select("l_id", "y", half.alias("half"), part.alias("part"))
    src = docs.select(F.col(id_col).alias("l_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    chosen = src.select("l_id", F.xxhash64("text").alias("t")).join(F.broadcast(sample), "l_id").groupBy("l_id").agg(F.min("t").alias("t"), F.count("*").alias("rows"))
    chosen = Scratch(docs.sparkSession, "toxicity-sample").save(chosen, "chosen")
    rows = src.join(F.broadcast(sample.join(chosen.select("l_id", "t"), "l_id")), "l_id").filter(F.xxhash64("text") == F.col("t"))
    rows = rows if chosen.filter("rows > 1").isEmpty() else rows.dropDuplicates(["l_id"])
    return rows.select("text", "y", "half", "part")


def learn_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Terms that toxic texts hold far more often than others, with their log-odds: of all rows, and of each half."""

    def count(batches):
        seen: Counter = Counter()

        def flush():
            keys = list(seen)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["term", "cell", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text, y, half in zip(readable(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cell = 2 * half + y
                seen.update({(t, cell) for w in set(LETTERS.findall(text.lower())) if len(w) > 2 for t in terms(w)})
                seen["", cell] += 1
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(4)]
    counts = Scratch(rows.sparkSession, "toxicity").save(arrow_map(rows.select("text", "y", "half"), count, "term string, cell int, n long").groupBy("term").agg(*cells), "counts")
    total = counts.filter("term = ''").first()
    out = []
    for halves in ((0, 1), (0,), (1,)):
        n_pos, n_neg = (sum(total[f"c{2 * h + y}"] for h in halves) if total else 0 for y in (1, 0))
        pos, neg = (sum((F.col(f"c{2 * h + y}") for h in halves), F.lit(0)) for y in (1, 0))
        if not (n_pos and n_neg):
            out.append({})
            continue
        odds = F.log((pos + 0.2) / (n_pos + 0.4)) - F.log((neg + 0.2) / (n_neg + 0.4))
        found = counts.select("term", odds.alias("w"), pos.alias("pos")).filter((F.col("term") != "") & (F.col("pos") >= max(3, round(0.002 * n_pos))) & (F.col("w") >= 2.2))
        out.append({r["term"]: r["w"] for r in found.orderBy("term").collect()})  # each is in 1 of 500 toxic texts of the sample
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model that labels of rows which are not held out give. Without labels of both kinds every score is 0."""
    rows = labelled(docs, labels, id_col, text_col)
    lexicon, *of_half = learn_lexicons(rows)
    if not lexicon:
        return Model()

    def run(batches):
        tables = [WordTable(of_half[1]), WordTable(of_half[0])]
        for batch in batches:
            x = [describe(t, tables[half]).tolist() for t, half in zip(readable(batch.column(0)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(3)], ["x", "y", "part"])

    found = arrow_map(rows, run, "x array<double>, y int, part int").toArrow().combine_chunks()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if found.num_rows else np.zeros((0, len(FEATURES)))
    y, part = found["y"].to_numpy().astype(float), found["part"].to_numpy()
    order = np.lexsort((part, y, *x.T))  # the order of arrival is no input
    x, y, part = x[order], y[order], part[order]
    if not 0 < y[part == 1].sum() < (part == 1).sum():
        return Model()
    prior, trees = boost(x[part == 1], y[part == 1])
    model = Model(lexicon, prior, trees)
    held = part == 2 if (part == 2).any() else part == 1
    model.knots, model.levels = isotonic(model.margin(x[held]), y[held])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of whole texts: id, held_out, score, predicted.

    Null and empty texts get the score of all-zero features; texts count whole, however long, and bytes that are no UTF-8
    count as U+FFFD. Repeated rows stay repeated, equal texts have equal scores; other columns are not looked at; an empty
    table stays empty. The broadcast model is bounded by the labelled sample and ROUNDS.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        table = WordTable(model.lexicon)
        for batch in batches:
            x = np.array([describe(t or "", table) for t in readable(batch.column(1))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    found = arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select(F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the model does not call toxic, with all their columns, in one pass over the texts. Rows are
    judged as by score(); no column's name matters but that of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        table = WordTable(model.lexicon)
        for batch in batches:
            x = np.array([describe(t or "", table) for t in readable(batch.column(at).cast(pa.string()))]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) < THRESHOLD))

    return arrow_map(docs, run, docs.schema)
