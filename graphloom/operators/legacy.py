"""The older forms of the local, global and hybrid modes: search by a question with keywords, plain context layouts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import stored_name, token_estimate

from . import budget, vectors
from .modes import QueryParam, Result, Store, chunk_selector

#: Headings of the contexts.
ENTITIES, RELATIONS = "Entities:\n", "\nRelationships:\n"
LOCAL, GLOBAL = "Local Context (Text Chunks):\n", "Global Context (Knowledge Graph):\n"


def search_text(question: str, keywords: Callable[[str], Sequence[str]] | None) -> tuple[str, list[str]]:
    """The question with its keywords behind it, and these; the question alone if there are none or they cannot be had."""
    try:
        found = list(keywords(question)) if keywords else []
    except Exception:  # noqa: BLE001 - any failure of a model
        found = []
    return (f"{question} {' '.join(found)}", found) if found else (question, [])


def _optional(rows: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind).alias(name) if name in rows.columns else F.lit(None).cast(kind).alias(name)


def local_sources(store: Store, question: str, embed: Callable[[str], Sequence[float]], keywords: Callable[[str], Sequence[str]] | None, param: QueryParam) -> DataFrame:
    """The best chunks (place, chunk_id, content, score, document_id, chunk_index, type) for a question and its low-level keywords. The weighted selector takes twice as many and raises
    those that name a keyword."""
    text, found = search_text(question, keywords)
    weighted = chunk_selector(param.chunk_selection) == "weighted"
    rows = vectors.filtered(store.vectors, "chunk")
    rows = rows.select("id", "vector", "content", _optional(rows, "document_id", "string"), _optional(rows, "chunk_index", "int"))
    hits = vectors.top_k(rows, embed(text), (2 if weighted else 1) * param.chunk_top_k, "id", "vector", ["content", "document_id", "chunk_index"])
    if weighted:
        none = F.expr("cast(array() AS array<string>)")
        words = F.array(*map(F.lit, found)) if found else none
        hits = vectors.weighted(hits.withColumn("_id", F.col("id").cast("string")), F.expr(f"cast(array() AS array<{rows.schema['id'].dataType.simpleString()}>)"), words, none)
        hits = hits.withColumn("score", F.col("weighted")).orderBy(F.desc("score"), "id").limit(param.chunk_top_k)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id"))  # chunk_top_k rows
    return hits.select(place.alias("place"), F.col("id").cast("string").alias("chunk_id"), "content", "score", "document_id", "chunk_index", F.lit("chunk").alias("type"))


def _chunk_text():
    return F.when(F.col("document_id").isNotNull(), F.format_string("[%s] %s", "document_id", "content")).otherwise(F.col("content"))


def _joined(rows: DataFrame, order: list[str], line, name: str) -> DataFrame:
    """One row: the lines in order, each as it is; an empty text without rows."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.agg(F.array_join(F.transform(lines, lambda r: r["line"]), "").alias(name))


def local(store: Store, question: str, embed: Callable[[str], Sequence[float]], param: QueryParam, keywords: Callable[[str], Sequence[str]] | None = None) -> Result:
    """Chunks one after the other, with their documents where they have one."""
    sources = local_sources(store, question, embed, keywords, param)
    return Result(_joined(sources, ["place"], F.concat(_chunk_text(), F.lit("\n\n")), "text"), sources)


def global_entities(store: Store, question: str, embed: Callable[[str], Sequence[float]], keywords: Callable[[str], Sequence[str]] | None, param: QueryParam) -> DataFrame:
    """The entities of the best entity vectors: place, id, name, type, description, score. Hits without a vertex are left out."""
    text, _ = search_text(question, keywords)
    hits = vectors.top_k(vectors.filtered(store.vectors, "entity"), embed(text), param.top_k, "id", "vector", ["name"])
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id"))  # top_k rows
    hits = hits.select(place.alias("place"), F.col("id").cast("string").alias("id"), stored_name(F.col("name")).alias("name"), "score")
    vertices = store.vertices.select(stored_name(F.col("name")).alias("name"), _optional(store.vertices, "type", "string"), "description")
    return F.broadcast(hits).join(vertices, "name")


def global_(store: Store, question: str, embed: Callable[[str], Sequence[float]], param: QueryParam, keywords: Callable[[str], Sequence[str]] | None = None) -> Result:
    """Entities found by high-level keywords, then all relations at them, each once, by the first entity that has it."""
    entities = global_entities(store, question, embed, keywords, param)
    names = F.broadcast(entities.groupBy("name").agg(F.min("place").alias("place")))
    at = [store.edges.join(names.withColumnRenamed("name", end), end).select("src", "tgt", "description", "place") for end in ("src", "tgt")]
    relations = at[0].unionByName(at[1]).groupBy("src", "tgt", "description").agg(F.min("place").alias("place"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = _joined(entities, ["place"], F.concat("name", F.lit(" ("), blank("type"), F.lit("): "), blank("description"), F.lit("\n")), "e")
    second = _joined(relations, ["place", "src", "tgt"], F.concat(F.lit("- "), "src", F.lit(" -> "), "tgt", F.lit(": "), blank("description"), F.lit("\n")), "r")
    text = F.when(F.col("e") == "", "").otherwise(F.concat(F.lit(ENTITIES), "e", F.lit(RELATIONS), "r"))
    sources = entities.select("place", F.col("id").alias("chunk_id"), F.col("description").alias("content"), "score", F.lit(None).cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit("entity").alias("type"))
    return Result(first.crossJoin(second).select(text.alias("text")), sources)  # two frames of one row


def hybrid(store: Store, question: str, embed: Callable[[str], Sequence[float]], param: QueryParam, low: Callable[[str], Sequence[str]] | None = None, high: Callable[[str], Sequence[str]] | None = None) -> Result:
    """Chunks and entities take turns within the budget; those that fit stand below a heading for each kind. All sources are
    given, chunks first."""
    chunks, entities = local(store, question, embed, param, low).sources, global_(store, question, embed, param, high).sources
    rows = [s.select(F.lit(0).alias("query"), F.lit(k).alias("source_idx"), F.col("place").alias("item_idx"), (_chunk_text() if k == 0 else F.coalesce("content", F.lit(""))).alias("content"), "type") for k, s in enumerate((chunks, entities))]
    every = rows[0].unionByName(rows[1]).withColumn("tokens", token_estimate(F.col("content")))
    kept = budget.kept_items(every, ["query"], param.max_tokens)
    each = lambda kind: _joined(kept.filter(F.col("type") == kind), ["source_idx", "item_idx"], F.concat("content", F.lit("\n\n")), kind)
    part = lambda kind, heading: F.when(F.col(kind) == "", "").otherwise(F.concat(F.lit(heading), kind))
    text = each("chunk").crossJoin(each("entity")).select(F.concat(part("chunk", LOCAL), part("entity", GLOBAL)).alias("text"))  # one row each
    return Result(text, chunks.unionByName(entities))

