"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch


#: With so many edges, the edges of a node are joined with its minimum in SALTS parts, so that a hub is no hot key.
MANY, SALTS = 1 << 22, 32


def _starred(pairs: DataFrame, salts: int) -> DataFrame:
    """Each (u, v) with the least node among u and all its v. The minimum is a partial aggregation."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if salts == 1:
        return pairs.join(least, "u")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(least, ["u", "salt"]).drop("salt")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200, scratch: Scratch | None = None, name: str = "components") -> DataFrame:
    """The least node that each node of the edges can reach: (node, component).

    Large-star and small-star steps take turns until no edge changes; the rounds grow with the logarithm of the
    diameter, and it is an error if max_rounds do not do. Every round is written to the scratch folder. Null endpoints
    and self-loops are no edges.
    """
    scratch = scratch or Scratch(edges.sparkSession, name)
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = scratch.save(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    mark, count = None, now.count()
    for k in range(1, max_rounds + 1):
        salts = 1 if count < MANY else SALTS
        # each half of a round is written and read again: in one plan the first half stands several times, and the driver
        # keeps and describes a plan anew whenever one of its stages ends
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = scratch.save(_starred(both, salts).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-{k}-large")
        small = _starred(large, salts).select("u", F.explode(F.array("v", "u")).alias("x"), "m")
        after = small.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        after = scratch.save(after, f"{name}-{k}")
        count, total = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}-large")
        now = after
        if (count, total) == mark:
            break
        mark = (count, total)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
