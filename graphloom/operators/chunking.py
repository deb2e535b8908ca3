"""Chunks of text and code. Each document is cut by itself, in one pass over its text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.code import boundary
from graphloom.plans.session import findable

CHARS = 4


def tokens(text: str) -> int:
    return -(-len(text) // CHARS)


def check(max_tokens: int, overlap: int) -> None:
    if max_tokens <= 0 or overlap < 0 or overlap >= max_tokens:
        raise ValueError("need max_tokens > 0 and 0 <= overlap < max_tokens")


def slices(text: str, max_tokens: int, overlap: int) -> list[str]:
    """Pieces of max_tokens that start every max_tokens - overlap, until one reaches the end."""
    size, step = CHARS * max_tokens, CHARS * (max_tokens - overlap)
    out = []
    for start in range(0, len(text), step):
        out.append(text[start : start + size])
        if start + size >= len(text):
            break
    return out


def by_sentence(text: str, max_tokens: int = 1200, overlap: int = 100) -> list[str]:
    """Sentences gathered up to the limit; a chunk begins with the last tokens of the one before. A sentence over the
    limit is sliced."""
    check(max_tokens, overlap)
    if not text:
        return []
    out: list[str] = []
    now, used = "", 0
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        n = tokens(sentence)
        if n > max_tokens:
            if now.strip():
                out.append(now.strip())
            now, used = "", 0
            out += slices(sentence, max_tokens, overlap)
            continue
        if used + n > max_tokens and now.strip():
            out.append(now.strip())
            tail = now.strip()[-CHARS * overlap :] if overlap else ""
            now, used = (tail + " " if tail else ""), tokens(tail)
        now += sentence + " "
        used += n
    if now.strip():
        out.append(now.strip())
    return out


def by_characters(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters that end at white space where there is some."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text) and (cut := max(text.rfind(c, at, end) for c in " \n\t")) > at:
            end = cut
        if piece := text[at:end].strip():
            out.append(piece)
        at = end + (end < len(text) and text[end].isspace())
    return out


def by_code(text: str, max_tokens: int = 1200, overlap: int = 100) -> list[tuple[str, int, int, str, str]]:
    """Lines gathered up to the limit: content, first and last line, and the last class or function before."""
    if not text:
        return []
    lines = text.split("\n")
    out: list[tuple[str, int, int, str, str]] = []
    start, size, scope, kind = 0, 0, "FILE", "FILE"
    for i, line in enumerate(lines):
        if size and size + len(line) + 1 > CHARS * max_tokens:
            out.append(("\n".join(lines[start:i]) + "\n", start + 1, i, scope, kind))
            start, size = i, 0
            while start > 0 and size < CHARS * overlap:
                start -= 1
                size += len(lines[start]) + 1
        size += len(line) + (i < len(lines) - 1)
        if (found := boundary(line)) and found[0] != "IMPORT":
            kind, scope = found
    if size:
        out.append(("\n".join(lines[start:]), start + 1, len(lines), scope, kind))
    return out


def _exploded(docs: DataFrame, id_col: str, text_col: str, cut: Callable[[str], list], fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    findable(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [(k, i, c if isinstance(c, tuple) else (c,)) for k, t in enumerate(batch.column(1).to_pylist()) for i, c in enumerate(cut(t or ""))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([k for k, _, _ in found], pa.int64())), pa.array([i for _, i, _ in found], pa.int32()), *(pa.array([c[n] for _, _, c in found], f[1]) for n, f in enumerate(fields))],
                ["id", "chunk_index", *(f[0] for f in fields)],
            )

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, chunk_index int, " + ", ".join(f"{n} {t}" for n, _, t in fields)).withColumnRenamed("id", id_col)


def sentence_chunks(docs: DataFrame, id_col: str, text_col: str, max_tokens: int = 1200, overlap: int = 100) -> DataFrame:
    check(max_tokens, overlap)
    return _exploded(docs, id_col, text_col, lambda t: by_sentence(t, max_tokens, overlap), [("content", pa.string(), "string")])


def character_chunks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    return _exploded(docs, id_col, text_col, lambda t: by_characters(t, size), [("content", pa.string(), "string")])


def code_chunks(docs: DataFrame, id_col: str, text_col: str, max_tokens: int = 1200, overlap: int = 100) -> DataFrame:
    fields = [("content", pa.string(), "string"), ("start_line", pa.int32(), "int"), ("end_line", pa.int32(), "int"), ("containing_scope", pa.string(), "string"), ("scope_type", pa.string(), "string")]
    return _exploded(docs, id_col, text_col, lambda t: by_code(t, max_tokens, overlap), fields).withColumn("chunk_type", F.lit("CODE"))


def window_slices(text: Column, max_tokens: int, overlap: int) -> Column:
    """The pieces of `slices` as an array column."""
    check(max_tokens, overlap)
    size, step = CHARS * max_tokens, CHARS * (max_tokens - overlap)
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - size) / F.lit(float(step))).cast("int") + 1)
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.expr("cast(array() AS array<string>)"))
