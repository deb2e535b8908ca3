"""Ranking and token budgets for query contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_within(items: DataFrame, by: list[str], order: list, budget: Column | int) -> DataFrame:
    """Items of each group up to the first that overflows the budget. Token counts are never negative, so a running sum decides."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("running", F.sum("tokens").over(w)).filter(F.col("running") <= (F.lit(budget) if isinstance(budget, int) else budget))


def interleaved(items: DataFrame, by: list[str]) -> DataFrame:
    """Items of ranked lists in turn: first of each list, second of each; lists that are done are passed over."""
    w = Window.partitionBy(*by).orderBy("item_idx", "source_idx")
    return items.withColumn("place", F.row_number().over(w))


def _taken(items: DataFrame, by: list[str], budget: int, separator_tokens: int, more: list[str]) -> DataFrame:
    """For each group `_r`: used, n, skipped, and parts, the items (with more columns) that fit when taken in turn."""
    rows = F.array_sort(F.collect_list(F.struct("item_idx", "source_idx", "content", "tokens", *more)))
    out = items.groupBy(*by).agg(rows.alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(0).alias("skipped"), F.slice("_rows", 1, 0).alias("parts"))

    def take(acc: Column, x: Column) -> Column:
        cost = x["tokens"].cast("long") + F.when(acc["n"] > 0, separator_tokens).otherwise(0)
        fits = acc["used"] + cost <= budget
        return F.struct(
            F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"),
            (acc["n"] + F.when(fits, 1).otherwise(0)).alias("n"),
            (acc["skipped"] + F.when(fits, 0).otherwise(1)).alias("skipped"),
            F.when(fits, F.concat(acc["parts"], F.array(x))).otherwise(acc["parts"]).alias("parts"),
        )

    return out.withColumn("_r", F.aggregate("_rows", start, take))


def merged_context(items: DataFrame, by: list[str], budget: int, separator_tokens: int = 1) -> DataFrame:
    """Items taken in turn while they fit; one that does not fit is passed over, and smaller ones may still follow.
    A separator costs tokens before all but the first. Gives: text, included, truncated, total_tokens."""
    out = _taken(items, by, budget, separator_tokens, [])
    return out.select(*by, F.array_join(F.transform("_r.parts", lambda x: x["content"]), "\n\n").alias("text"), F.col("_r.n").alias("included"), F.col("_r.skipped").alias("truncated"), F.col("_r.used").alias("total_tokens"))


def kept_items(items: DataFrame, by: list[str], budget: int, separator_tokens: int = 1) -> DataFrame:
    """The items themselves that merged_context takes, with their type and their place in it."""
    out = _taken(items, by, budget, separator_tokens, ["type"])
    return out.select(*by, F.posexplode("_r.parts").alias("place", "x")).select(*by, "place", "x.*")


def capacity(items: DataFrame, by: list[str], order: list, budget: int) -> DataFrame:
    """How many items fit until the first overflow, a separator of one token between them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    costs = F.sum("tokens").over(w) + F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return items.withColumn("_c", costs).groupBy(*by).agg(F.count_if(F.col("_c") <= budget).alias("capacity"))


def utilization(total: Column, budget: int) -> Column:
    return F.when(F.lit(budget) > 0, total / F.lit(float(budget))).otherwise(0.0)


def budgets(total: int, chunk: float = 0.4, entity: float = 0.3, relation: float = 0.3) -> dict[str, int]:
    """Shares of a token budget, rounded down; they need not add up to the whole."""
    return {"chunk": int(total * chunk), "entity": int(total * entity), "relation": int(total * relation)}


def passthrough(items: DataFrame, by: list[str], order: list) -> DataFrame:
    """Rank scores without a reranker: 1, 0.95 and so on, never under 0.1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return items.withColumn("rank", F.row_number().over(w)).withColumn("score", F.round(F.greatest(F.lit(0.1), 1 - 0.05 * (F.col("rank") - 1)), 6))


def reranked(items: DataFrame, by: list[str], score: str, original: str, min_score: float = 0.1) -> DataFrame:
    """New ranks by score; ties keep their order. Items under the least score go."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), original)
    kept = items.filter(F.col(score) >= min_score).withColumn("new_rank", F.row_number().over(w))
    return kept.withColumn("rank_change", F.col(original) - F.col("new_rank"))


def would_exceed(used: Column, added: Column, budget: Column | int) -> Column:
    """Whether more tokens would pass the budget."""
    return used + added > (F.lit(budget) if isinstance(budget, int) else budget)
