"""Exact numbers over rows that are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch


def numbered(rows: DataFrame, order: list, column: str = "number", scratch: Scratch | None = None, name: str = "numbered") -> DataFrame:
    """Rows numbered from 1 without a gap or a repeat, in order (names or columns; none: in any order).

    Rows are sorted by ranges and written once, each with its partition and its place there. Counts come from the written
    table and meet the rows on that stored partition, so neither a second sort nor another number of partitions can move
    a row. The driver sees one count for each partition. Rows that are equal in the order get numbers in any order. An
    empty table has no numbers. Further columns stay; one that is named as the new column is replaced.
    """
    scratch = scratch or Scratch(rows.sparkSession, name)
    part, place, before = (f"_{name}_{x}" for x in ("part", "place", "before"))
    placed = (rows.orderBy(*order) if order else rows).withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id())
    stored = scratch.save(placed.withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1))), name)
    counts = sorted(stored.groupBy(part).agg(F.count("*").alias("n")).collect(), key=lambda r: r[part])
    total, offsets = 0, []
    for r in counts:
        offsets.append((r[part], total))
        total += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"{part} int, {before} long"))
    return stored.join(offsets, part).withColumn(column, F.col(before) + F.col(place) + 1).drop(part, place, before)


def running_sums(rows: DataFrame, key: list[str], at: str, values: dict[str, str], descending: bool = False, block: int = 1 << 16) -> DataFrame:
    """New columns (values: name to column) with the sum of a column over the rows of a key up to and with each place (a whole
    number not below 0, unique in its key), from the other end with descending. Sums run inside blocks of places, then over
    blocks, so that no task gets all rows of a long key. Null values count as 0."""
    order = lambda c: F.desc(c) if descending else F.asc(c)
    cut = rows.withColumn("_block", F.floor(F.col(at) / F.lit(block)).cast("long"))
    totals = cut.groupBy(*key, "_block").agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    over_blocks = Window.partitionBy(*key).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, "_block", *[F.coalesce(F.sum(f"_{n}").over(over_blocks), F.lit(0)).alias(f"_{n}") for n in values])
    inside = Window.partitionBy(*key, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    found = cut.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()}).join(totals, [*key, "_block"])
    return found.withColumns({n: F.col(n) + F.col(f"_{n}") for n in values}).drop("_block", *[f"_{n}" for n in values])
