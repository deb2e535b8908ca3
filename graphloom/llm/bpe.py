"""Byte-pair encoding from a vocabulary file: ids by a segment tree over pair ranks, counts by a heap over a linked list.

A vocabulary file is read once on the driver and broadcast; its size is that of one tokenizer (a few MB), whatever the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, arrow_map, readable, utf8

NONE = (1 << 62) - 1
#: Pieces of text that a worker remembers in each of two generations.
MEMO = 300_000
#: Children of a segment tree's node.
FAN = 16

#: The pre-tokenizer pattern of byte-level vocabularies, and the one of the word vocabulary.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Code points that newer versions of Unicode than 16, which the tokenizers follow, call letters and numbers.
LATER_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011df1"
    "\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20"
    "\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24"
    "\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
LATER_NUMBERS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"
#: Small letters of capitals that Python's Unicode 15.1 does not know: single ones, and runs at a distance.
LATER_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
LATER = re.compile(f"[{LATER_LETTERS}{LATER_NUMBERS}{''.join(map(chr, sorted(LATER_SMALL)))}]")
#: Controls that Python takes for white space and Unicode does not.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Ids, merges and pre-tokenization of one tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.words_only = bool(spec.get("normalizer"))
        self.pattern = regex.compile(WORD_PATTERN if self.words_only else BYTE_PATTERN)
        known = (WORD_PATTERN if self.words_only else BYTE_PATTERN).replace(r"[^\s\p{L}\p{N}]", r"[^\sLN]").replace(r"[\p{L}]", "L").replace(r"[\p{N}]", "N").replace(r"\p{L}", "L").replace(r"\p{N}", "N")
        self.late_pattern = regex.compile("(?V1)" + known.replace("L", rf"[\p{{L}}--[{LATER_LETTERS}]]").replace("N", rf"[\p{{N}}--[{LATER_NUMBERS}]]"))
        letters = byte_letters()
        self.first = [self.ids.get(c) for c in letters]
        self.last = [self.ids.get(c + self.suffix) for c in letters]
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def normal(self, text: str) -> str:
        """The word vocabulary's normal form; lower case is taken letter by letter, so a final sigma is no exception."""
        if not self.words_only:
            return text
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        return text.translate(LATER_SMALL) if LATER.search(text) else text

    def cut(self, text: str) -> list[str]:
        """The words of a text in normal form."""
        text = self.normal(text)
        return (self.late_pattern if LATER.search(text) else self.pattern).findall(text)

    def symbols(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        out = [self.first[b] for b in data]
        if out:
            out[-1] = self.last[data[-1]]
        return [x for x in out if x is not None]

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at special strings: plain parts, and (string, id) of each special one."""
        if self.splitter is None:
            return [(text, None)]
        return [(part, self.special.get(part)) for part in self.splitter.split(text) if part]


def merge_by_tree(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges until no pair is mergeable. A segment tree holds rank and place of each adjacent pair; its root is the
    leftmost pair of the lowest rank, and a merge changes three leaves. A node has FAN children, so that short words
    need one level."""
    n = len(ids)
    if n < 2:
        return ids
    ids = list(ids)
    find = merges.get
    leaves = [NONE] * (n - 1)
    for i, pair in enumerate(zip(ids, ids[1:])):  # noqa: B905
        if hit := find(pair):
            leaves[i] = (hit[0] << 36) | i
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    upper = levels[1:]
    top = levels[-1]
    follow, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def lift(place: int) -> None:
        below = leaves
        for level in upper:
            place //= FAN
            least = min(below[place * FAN : place * FAN + FAN])
            if level[place] == least:
                return
            level[place] = least
            below = level

    mask = (1 << 36) - 1
    while (root := min(top)) != NONE:
        i = root & mask
        j = follow[i]
        ids[i] = merged = find((ids[i], ids[j]))[1]
        ids[j] = -1
        after = follow[i] = follow[j]
        leaves[i] = NONE
        if after < n:
            before[after] = i
            leaves[j] = NONE
            if upper:
                lift(j)
            if hit := find((merged, ids[after])):
                leaves[i] = (hit[0] << 36) | i
        if upper:
            lift(i)
        if (p := before[i]) >= 0:
            leaves[p] = (hit[0] << 36) | p if (hit := find((ids[p], merged))) else NONE
            if upper:
                lift(p)
    return [x for x in ids if x >= 0]


def count_by_heap(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many tokens the symbols merge to. A heap yields the lowest-ranked pair of a linked list; a pair that has
    changed since it was pushed is skipped. Each merge takes one from the count; no ids are given out."""
    n = len(ids)
    if n < 2:
        return n
    ids = list(ids)
    find = merges.get
    follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(hit[0], i, hit[1], ids[i], ids[i + 1]) for i in range(n - 1) if (hit := find((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, merged, a, b = heapq.heappop(heap)
        j = follow[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = merged, -1
        left -= 1
        after = follow[i] = follow[j]
        if after < n:
            before[after] = i
            if hit := find((merged, ids[after])):
                heapq.heappush(heap, (hit[0], i, hit[1], merged, ids[after]))
        if (p := before[i]) >= 0 and (hit := find((ids[p], merged))):
            heapq.heappush(heap, (hit[0], p, hit[1], ids[p], merged))
    return left


class Memo:
    """Results by word in two generations: when the young one is full it becomes the old one. Bounded; only speed depends on it."""

    def __init__(self, make: Callable, limit: int):
        self.make, self.limit = make, limit
        self.young: dict = {}
        self.old: dict = {}

    def all(self, words: list[str]) -> list:
        out = list(map(self.young.get, words))
        if None in out:
            young, old, make = self.young, self.old, self.make
            missing = {w for w, x in zip(words, out) if x is None}  # noqa: B905
            for w in missing:
                if (x := old.get(w)) is None:
                    x = make(w)
                young[w] = x
            out = list(map(young.get, words))
            for w in missing:
                if len(w) > 64:
                    del young[w]
            if len(young) >= self.limit:
                self.young, self.old = {}, young
        return out


class Encoder:
    """Ids of texts by the word vocabulary, or any other: (number, ids joined by a space, decoded text)."""

    def __init__(self, vocab: Vocabulary, limit: int = MEMO):
        self.vocab = vocab
        self.memo = Memo(self.piece, limit)
        self.word_memo = Memo(self.word, limit // 2)
        self.shown = {i: str(i) for i in vocab.names}
        self.special_text = {s: (1, str(i), s) for s, i in vocab.special.items()}

    def ids(self, part: str) -> list[int]:
        """Ids of a text that holds no special string."""
        v = self.vocab
        return [i for word in v.cut(part) for i in merge_by_tree(v.symbols(word), v.merges)]

    def encode(self, text: str) -> list[int]:
        return [i for part, special in self.vocab.segments(text) for i in ([special] if special is not None else self.ids(part))]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space if words end in a suffix; else the bytes that the tokens stand for."""
        v = self.vocab
        if v.suffix:
            return " ".join(v.names[i] for i in ids if i in v.names)
        back = {c: b for b, c in enumerate(byte_letters())}
        return b"".join(v.names[i].encode() if v.names[i] in v.special else bytes(back[c] for c in v.names[i]) for i in ids if i in v.names).decode("utf-8", "replace")

    def word(self, word: str) -> tuple[int, str, str]:
        ids = merge_by_tree(self.vocab.symbols(word), self.vocab.merges)
        return len(ids), " ".join([self.shown[i] for i in ids]), self.decode(ids)

    def piece(self, part: str) -> tuple[int, str, str]:
        words = self.vocab.cut(part)
        if len(words) == 1:
            return self.word_memo.all(words)[0]
        found = self.word_memo.all(words)
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])

    def row(self, text: str) -> tuple[int, str, str]:
        """For a vocabulary that drops white space: words are encoded one by one and joined."""
        v = self.vocab
        if not v.words_only or not v.suffix:
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        found: list[tuple[int, str, str]] = []
        for part, special in v.segments(text) if any(s in text for s in v.special) else [(text, None)]:
            if special is not None:
                found.append(self.special_text[part])
            elif ODD_SPACE.search(part):
                found.append(self.piece(part))
            else:
                found += self.memo.all(part.split())
        found = [x for x in found if x[0]]
        return sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


class Counter:
    """Token counts by a byte-level vocabulary, word by word where the text has single spaces only."""

    def __init__(self, vocab: Vocabulary, limit: int = 250_000):
        self.vocab = vocab
        self.memo = Memo(self.plain, limit)
        self.word_memo = Memo(lambda word: count_by_heap(vocab.symbols(word), vocab.merges), limit // 2)

    def plain(self, part: str) -> int:
        return sum(self.word_memo.all(self.vocab.cut(part)))

    def count(self, text: str) -> int:
        v = self.vocab
        if any(s in text for s in v.special):
            return sum(1 if special is not None else self.words(part) for part, special in v.segments(text))
        return self.words(text)

    def words(self, part: str) -> int:
        """A space before a word that has none at its ends starts a new piece, whatever stands around it."""
        if self.vocab.words_only:
            return self.plain(part)
        pieces = part.split(" ")
        total, start = 0, 0
        if len(pieces) > 1 and all(pieces) and not any(p[0].isspace() or p[-1].isspace() for p in pieces):
            return self.memo.all(pieces[:1])[0] + sum(self.memo.all([" " + p for p in pieces[1:]]))
        # runs of white space: cut the text where a single space stands between two words
        for at in SINGLE_SPACE.finditer(part):
            total += self.memo.all([part[start : at.start()]])[0]
            start = at.start()
        return total + self.plain(part[start:])


#: A single space between two characters that are no white space, in Python's sense and Unicode's.
SINGLE_SPACE = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


def broadcast_file(df: DataFrame, path: str):
    """The vocabulary's text for the executors, who may not see the driver's files; a tokenizer is a few MB, whatever the data."""
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > 64 << 20:
        raise ValueError(f"{path} is too large to be a tokenizer")
    return df.sparkSession.sparkContext.broadcast(text)


def ready(kind: type, shared, key: str, *limit: int):
    """One encoder or counter per Python worker, kept with its memo from task to task of one operator."""
    if (owner := owner_of(kind, key)) not in KEPT:
        KEPT[owner] = kind(Vocabulary(shared.value), *limit)
    return KEPT[owner]


def owner_of(kind: type, key: str) -> str:
    return f"{kind.__name__} {key}"


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text and decodes it again: id, n_tokens, ids, decoded.

    Null text counts as empty: no tokens, empty strings. Texts count whole, however long, and bytes that are no UTF-8
    count as U+FFFD; of equal pair ranks the leftmost merges first. Repeated rows stay repeated; other columns are not
    looked at; an empty table stays empty. `ids` holds decimal ids joined by one space.
    """
    src = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    shared = broadcast_file(docs, path)

    def run(batches):
        encoder = ready(Encoder, shared, path)
        for batch in batches:
            rows = [encoder.row(t or "") for t in readable(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids string, decoded string", owner_of(Encoder, path)).withColumnRenamed("doc_id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """As encode_texts, with SHA-256 of the ids and of the decoded text instead of the strings themselves. memo: words that
    a worker remembers; fewer take less memory and more time."""
    src = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    shared = broadcast_file(docs, path)

    def run(batches):
        encoder = ready(Encoder, shared, path, memo)
        for batch in batches:
            rows = []
            for t in readable(batch.column(1)):
                n, ids, decoded = encoder.row(t or "")
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", owner_of(Encoder, path)).withColumnRenamed("doc_id", id_col)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts: id, n_bytes, n_tokens, over_limit.

    Null text counts as empty: 0 bytes, 0 tokens. Texts count whole, however long, and bytes that are no UTF-8 count as
    U+FFFD (n_bytes is of the text as it stands); of equal pair ranks the leftmost merges first. Repeated rows stay
    repeated; other columns are not looked at; an empty table stays empty.
    """
    src = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    shared = broadcast_file(docs, path)

    def run(batches):
        counter = ready(Counter, shared, path)
        for batch in batches:
            texts = utf8(batch.column(1))
            n = [counter.count(t.decode("utf-8", "replace")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", owner_of(Counter, path)).withColumnRenamed("doc_id", id_col)
