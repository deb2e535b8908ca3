"""Merging entities: edges are redirected, loops dropped, doubles merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import stored_name

CAP, SEPARATOR = 50, " | "


def redirect(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with endpoints replaced by a mapping (name, target), without those that become loops."""
    m = mapping.select(stored_name(F.col("name")).alias("_n"), F.col("target").alias("_t"))
    for end in ("src", "tgt"):
        edges = edges.join(m, stored_name(F.col(end)) == F.col("_n"), "left").withColumn(end, F.coalesce("_t", end)).drop("_n", "_t")
    return edges.filter(F.lower("src") != F.lower("tgt"))


def merged_text(texts: Column, strategy: str) -> Column:
    """Distinct non-blank texts of an ordered array by strategy: CONCATENATE, KEEP_FIRST or KEEP_LONGEST (the first of equals)."""
    kept = F.array_distinct(F.filter(texts, lambda t: F.coalesce(F.trim(t), F.lit("")) != ""))
    if strategy == "KEEP_FIRST":
        one = F.get(kept, F.lit(0))
    elif strategy == "KEEP_LONGEST":
        one = F.aggregate(kept, F.lit(""), lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc))
    elif strategy in ("CONCATENATE", "LLM_SUMMARIZE"):  # a summary is asked of a model; its input is this text
        one = F.array_join(kept, SEPARATOR)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return F.coalesce(one, F.lit(""))


def merged_chunks(lists: Column) -> Column:
    """Ordered union of chunk ids; of more than CAP the oldest go."""
    every = F.array_distinct(F.flatten(lists))
    return F.when(F.size(every) > CAP, F.slice(every, -CAP, CAP)).otherwise(every)


def merged_keywords(lists: Column) -> Column:
    every = F.filter(F.flatten(F.transform(lists, lambda k: F.transform(F.split(k, ","), lambda x: F.trim(x)))), lambda x: x != "")
    return F.array_join(F.array_distinct(every), ", ")


def merge_doubles(edges: DataFrame, order: list[str], strategy: str = "CONCATENATE") -> DataFrame:
    """One edge for each ordered pair: weights add up, texts, keywords and chunk ids are merged in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], "description", "keywords", "source_chunk_ids")))
    grouped = edges.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.count("*").alias("merged"), rows.alias("_r"))
    each = lambda field: F.transform("_r", lambda r: r[field])
    return grouped.select("src", "tgt", merged_text(each("description"), strategy).alias("description"), merged_keywords(each("keywords")).alias("keywords"), "weight", merged_chunks(each("source_chunk_ids")).alias("source_chunk_ids"), "merged")


def merge_entities(vertices: DataFrame, edges: DataFrame, sources: list[str], target: str, strategy: str = "CONCATENATE", target_type: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """New vertices and edges with the sources (without the target itself) merged into the target, and counts."""
    spark = vertices.sparkSession
    names = sorted({s.strip().lower() for s in sources} - {target.strip().lower()})
    if not target.strip():
        raise ValueError("a target is needed")
    if not names:
        return vertices, edges, {"merged": 0, "redirected": 0, "deduplicated": 0}
    group = [target.strip().lower(), *names]
    mapping = spark.createDataFrame([(n, target.strip().lower()) for n in names], "name string, target string")
    touched = edges.filter(F.lower("src").isin(group) | F.lower("tgt").isin(group))
    moved = redirect(touched, mapping)
    doubles = merge_doubles(moved, ["src", "tgt", "description"], strategy)
    old = vertices.filter(stored_name(F.col("name")).isin(group)).withColumn("_place", F.array_position(F.array(*map(F.lit, group)), stored_name(F.col("name"))))
    rows = F.array_sort(F.collect_list(F.struct("_place", "description", "type", "source_chunk_ids")))
    each = lambda field: F.transform("_r", lambda r: r[field])
    kind = F.lit(target_type) if target_type else F.coalesce(F.get(F.filter(each("type"), lambda t: F.coalesce(F.trim(t), F.lit("")) != ""), F.lit(0)), F.lit("UNKNOWN"))
    merged = old.agg(rows.alias("_r")).select(F.lit(group[0]).alias("name"), kind.alias("type"), merged_text(each("description"), strategy).alias("description"), merged_chunks(each("source_chunk_ids")).alias("source_chunk_ids"))
    keep = ["name", "type", "description", "source_chunk_ids"]
    new_vertices = vertices.filter(~stored_name(F.col("name")).isin(group)).select(keep).unionByName(merged)
    columns = ["src", "tgt", "description", "keywords", "weight", "source_chunk_ids"]
    new_edges = edges.filter(~(F.lower("src").isin(group) | F.lower("tgt").isin(group))).select(columns).unionByName(doubles.select(columns))
    before, after = moved.count(), doubles.count()
    return new_vertices, new_edges, {"merged": len(names), "redirected": before, "deduplicated": before - after}
