"""Query modes: candidates from vectors and graph, cut to budgets, merged into one context and prompt."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import role_label, token_estimate
from graphloom.plans.scratch import Scratch

from . import budget, graph, vectors

MODES = ("NAIVE", "LOCAL", "GLOBAL", "HYBRID", "MIX", "BYPASS")
#: Shares of chunks, entities and relations in a mode's budget, and the order in which sources take turns.
SHARES = {"LOCAL": (0.9, 0.05, 0.05), "GLOBAL": (0.1, 0.4, 0.3), "HYBRID": (0.3, 0.4, 0.3), "MIX": (0.4, 0.3, 0.3), "NAIVE": (1.0, 0.0, 0.0)}
ORDER = {"LOCAL": ("chunk", "entity", "relation"), "GLOBAL": ("entity", "relation", "chunk"), "HYBRID": ("chunk", "entity", "relation"), "MIX": ("entity", "relation", "chunk"), "NAIVE": ("chunk",)}


@dataclass(frozen=True)
class QueryParam:
    mode: str = "HYBRID"
    top_k: int = 60
    chunk_top_k: int = 20
    max_tokens: int = 4000
    rerank: bool = False
    only_context: bool = False
    response_type: str = "Multiple Paragraphs"
    chunk_selection: str | None = None  # weighted, or by vectors
    layout: str | None = None  # grouped or flat: how items stand in a prompt; else one after the other
    compat: bool = False  # as the old service: results of pipeline modes carry no sources


@dataclass
class Store:
    """What a project holds: vectors (id, vector, type, content, name), vertices and edges."""

    vectors: DataFrame
    vertices: DataFrame
    edges: DataFrame


@dataclass
class Result:
    context: DataFrame  # one row: text, included, truncated, total_tokens
    sources: DataFrame
    prompt: Column | None = None


def chunk_hits(store: Store, probe: Sequence[float], k: int, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k best chunks; a reranker gets twice as many and gives a `score`."""
    hits = vectors.top_k(vectors.filtered(store.vectors, "chunk"), probe, 2 * k if rerank else k, "id", "vector", ["content"])
    return rerank(hits).orderBy(F.desc("score"), "id").limit(k) if rerank else hits


def entity_hits(store: Store, probe: Sequence[float], k: int) -> DataFrame:
    found = vectors.top_k(vectors.filtered(store.vectors, "entity").withColumn("name", F.lower("name")), probe, k, "name", "vector")
    return found.join(store.vertices.withColumn("name", F.lower("name")), "name")


def relation_hits(store: Store, entities: DataFrame) -> DataFrame:
    """Edges at the found entities, each once, ranked by the best score of their ends."""
    scores = entities.select("name", "score")
    both = [store.edges.join(scores.withColumnRenamed("name", end), end).select("src", "tgt", "description", "score") for end in ("src", "tgt")]
    return both[0].unionByName(both[1]).groupBy("src", "tgt").agg(F.max("score").alias("score"), F.first("description").alias("description"))


def items(rows: DataFrame, kind: str, content: Column, tie: str, limit: int, source_idx: int) -> DataFrame:
    """Context items of one source, cut at the first that overflows its share."""
    rows = rows.orderBy(F.desc("score"), F.col(tie).cast("string")).limit(max(limit, 0))  # an item has a token at least
    ranked = rows.select(F.lit(0).alias("query"), F.lit(kind).alias("type"), content.alias("content"), F.col(tie).cast("string").alias("source_id"), "score").withColumn("tokens", token_estimate(F.col("content")))
    kept = budget.prefix_within(ranked, ["query"], [F.desc("score"), F.col("source_id")], limit)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "source_id"))
    return kept.select("query", "type", "content", "source_id", "tokens", place.alias("item_idx"), F.lit(source_idx).alias("source_idx"))


def laid_out(found: DataFrame, param: QueryParam) -> DataFrame:
    """The context of items: joined, or by sections or labels as the layout says."""
    context = budget.merged_context(found, ["query"], param.max_tokens)
    if param.layout is None:
        return context
    if param.layout not in ("grouped", "flat"):
        raise ValueError(f"unknown layout {param.layout}")
    text = item_text(budget.kept_items(found, ["query"], param.max_tokens), ["query"], param.layout == "grouped")
    return context.drop("text").join(text, "query").select("query", "text", "included", "truncated", "total_tokens")


def answer_context(store: Store, probe: Sequence[float], param: QueryParam, rerank: Callable[[DataFrame], DataFrame] | None = None) -> Result:
    """Context and sources of a query in the given mode. BYPASS has neither."""
    if param.mode not in MODES:
        raise ValueError(f"unknown mode {param.mode}")
    spark = store.vectors.sparkSession
    no_items = spark.createDataFrame([], "query int, type string, content string, source_id string, tokens int, item_idx int, source_idx int")
    if param.mode == "BYPASS":
        return Result(budget.merged_context(no_items, ["query"], param.max_tokens), no_items)
    share = dict(zip(("chunk", "entity", "relation"), SHARES[param.mode], strict=True))
    found = no_items
    wants = ORDER[param.mode]
    entities = entity_hits(store, probe, param.top_k) if "entity" in wants and param.mode != "LOCAL" else None
    if param.mode == "MIX" and entities is not None:
        near = graph.expand(store.edges, entities.select("name"), 1)
        entities = store.vertices.withColumn("name", F.lower("name")).join(near, "name", "left_semi").join(entities.select("name", "score"), "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    for k, kind in enumerate(wants):
        limit = int(param.max_tokens * share[kind])
        if kind == "chunk" and param.mode != "GLOBAL":
            n = min(param.chunk_top_k, 5) if param.mode == "NAIVE" else param.chunk_top_k
            hits = chunk_hits(store, probe, n, rerank if param.rerank else None)
            found = found.unionByName(items(hits, "chunk", F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.col("content")), "id", limit, k))
        elif kind == "entity" and entities is not None:
            found = found.unionByName(items(entities, "entity", F.concat_ws(": ", "name", "description"), "name", limit, k))
        elif kind == "relation" and entities is not None:
            hits = relation_hits(store, entities).withColumn("pair", F.concat_ws("->", "src", "tgt"))
            found = found.unionByName(items(hits, "relation", F.concat_ws(": ", "pair", "description"), "pair", limit, k))
    context = laid_out(found, param)
    sources = found.limit(0) if param.compat and param.mode in ("LOCAL", "GLOBAL", "HYBRID") else found
    return Result(context, sources)


def history_text(turns: DataFrame, by: list[str], order: str) -> DataFrame:
    """Lines "Role: text" of each conversation in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.concat(role_label(F.col("role")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return turns.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("history"))


def prompt(context: Column, query: Column, history: Column, response_type: str) -> Column:
    parts = [F.lit("Answer from the data below.\n"), F.when(F.length(history) > 0, F.concat(F.lit("\n---History---\n"), history, F.lit("\n"))).otherwise(""), F.lit("\n---Context---\n"), context]
    return F.concat(*parts, F.lit("\n\n---Question---\n"), query, F.lit("\n\n---Response Format---\n" + response_type))


def valid_citations(answer: Column, ids: Column) -> Column:
    """Citations [id] of citable ids stay and other brackets go; without citable ids all go, with the space before them."""
    bracket = r"\[([^\]]+)\]"
    marks = F.transform(F.regexp_extract_all(answer, F.lit(bracket), F.lit(1)), lambda m: F.when(F.array_contains(ids, m), F.concat(F.lit("["), m, F.lit("]"))).otherwise(""))
    kept = F.array_join(F.zip_with(F.split(answer, bracket, -1), marks, lambda piece, m: F.concat(piece, F.coalesce(m, F.lit("")))), "")
    return F.when(F.coalesce(F.size(ids), F.lit(0)) == 0, F.regexp_replace(answer, r"\s*\[([^\]]+)\]", "")).otherwise(kept)


@dataclass
class Stage:
    """A step of a query: what it does to the state, and when it is passed over."""

    name: str
    process: Callable[[dict], dict]
    skip: Callable[[dict], bool] = lambda _: False


class StageError(RuntimeError):
    """A stage failed; the cause is chained."""


def run_stages(stages: Sequence[Stage], state: dict) -> dict:
    """The state after all stages that are not passed over, in order."""
    for stage in stages:
        if stage.skip(state):
            continue
        try:
            state = stage.process(state)
        except Exception as e:
            raise StageError(f"stage {stage.name} failed") from e
    return state


#: Sections of a prompt, and labels of items in a flat one.
HEADINGS = {"entity": "### Entities", "relation": "### Relations", "chunk": "### Sources"}
LABELS = {"entity": "[Entity] ", "relation": "[Relation] ", "chunk": "[Source] "}


def item_text(items: DataFrame, by: list[str], grouped: bool = True) -> DataFrame:
    """Text of context items (type, content, place): a section for each type in the order of HEADINGS, or one item after
    the other with a label."""
    rows = F.array_sort(F.collect_list(F.struct("place", "type", "content")))
    out = items.groupBy(*by).agg(rows.alias("_r"))
    if not grouped:
        label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
        return out.select(*by, F.array_join(F.transform("_r", lambda x: F.concat(F.coalesce(F.try_element_at(label, x["type"]), F.lit("")), x["content"], F.lit("\n\n"))), "").alias("text"))

    def section(kind: str, heading: str) -> Column:
        some = F.transform(F.filter("_r", lambda x: x["type"] == kind), lambda x: F.concat(F.lit("- "), x["content"], F.lit("\n")))
        return F.when(F.size(some) > 0, F.concat(F.lit(heading + "\n"), F.array_join(some, ""), F.lit("\n"))).otherwise("")

    return out.select(*by, F.concat(*(section(kind, heading) for kind, heading in HEADINGS.items())).alias("text"))


def answer(store: Store, question: str, probe: Sequence[float], param: QueryParam, model: Callable[[str], str] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, history: str = "") -> tuple[str, DataFrame]:
    """Answer and sources: the context itself, the prompt itself (without a model), or what the model makes of the prompt."""

    def context(state: dict) -> dict:
        result = answer_context(store, probe, param, with_fallback(rerank))
        row = result.context.first()
        return state | {"sources": result.sources, "context": (row["text"] if row else "") or ""}

    def build(state: dict) -> dict:
        row = store.vectors.sparkSession.range(1).select(prompt(F.lit(state["context"]), F.lit(question), F.lit(history), param.response_type).alias("p")).first()
        return state | {"prompt": row["p"]}

    def call(state: dict) -> dict:
        return state | {"answer": model(state["prompt"])}

    stages = [Stage("context", context), Stage("prompt", build, lambda _: param.only_context), Stage("model", call, lambda _: param.only_context or model is None)]
    state = run_stages(stages, {})
    return state.get("answer", state.get("prompt", state["context"])), state["sources"]


def with_fallback(rerank: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame], DataFrame] | None:
    """A reranker whose failure leaves the order as it was."""
    if rerank is None:
        return None

    def safe(hits: DataFrame) -> DataFrame:
        try:
            found = rerank(hits)
            rows = found.collect()  # twice chunk_top_k rows at most; a provider fails when it is called, not when it is planned
            return hits.sparkSession.createDataFrame(rows, found.schema)
        except Exception:  # noqa: BLE001  any failure of a provider
            return hits

    return safe


def chunk_selector(strategy: str | None) -> str:
    """`weighted` if asked for in any case; else `vector`."""
    return "weighted" if (strategy or "").strip().lower() == "weighted" else "vector"


def summarize(rows: DataFrame, by: list[str], order: str, model: Callable[[Column], Column], group: int = 5, direct: int = 10) -> DataFrame:
    """Descriptions of each key reduced by a model: one stays itself, up to `direct` go at once, more in groups of
    `group` until one is left."""
    from pyspark.sql import Window

    if group < 2:
        raise ValueError("groups of less than two do not end")
    scratch = Scratch(rows.sparkSession, "summaries")
    every = Window.partitionBy(*by)
    now = scratch.save(rows.select(*by, F.row_number().over(every.orderBy(order)).alias("n"), F.count("*").over(every).alias("size"), "description"), "round0")
    most, turn = now.agg(F.max("size")).first()[0] or 0, 0
    while most > 1:  # each round leaves a part of 1 / group of the rows of a key, or one; it is written, so no round is run again
        cell = F.when(F.col("size") <= direct, F.lit(0)).otherwise(F.floor((F.col("n") - 1) / group)).cast("int")
        left = F.when(F.col("size") <= direct, F.lit(1)).otherwise(F.ceil(F.col("size") / group)).cast("long")
        parts = now.groupBy(*by, left.alias("size"), cell.alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("n"), "description"))), lambda r: r["description"]).alias("d"))
        parts = parts.select(*by, (F.col("n") + 1).alias("n"), "size", F.when(F.size("d") == 1, F.get("d", F.lit(0))).otherwise(model(F.col("d"))).alias("description"))
        turn += 1
        now = scratch.save(parts, f"round{turn}")
        scratch.drop(f"round{turn - 1}")
        most = 1 if most <= direct else -(-most // group)
    return now.select(*by, "description")
