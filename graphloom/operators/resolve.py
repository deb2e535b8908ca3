"""Entity resolution: pairs of similar names, clusters, canonical entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import similarity
from graphloom.functions.text import token_set
from graphloom.operators.components import components
from graphloom.plans.scratch import Scratch

SEPARATOR = " | "


def entity_type(column: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("UNKNOWN"))


def similar_pairs(entities: DataFrame, weights: similarity.Weights = similarity.Weights()) -> DataFrame:
    """Pairs (idx_a, idx_b, name_a, name_b, score) of one type that reach the threshold.

    Names are compared once each. Where names without a common token cannot reach the threshold, candidates come from
    an equi-join on type and token, of the rare tokens of a name of which a partner must have one, cut by what sizes and
    places still allow; otherwise from one on type.
    """
    names = entities.select(entity_type(F.col("type")).alias("type"), "name", "idx").groupBy("type", "name").agg(F.min("idx").alias("idx"))
    a, b = names.withColumnsRenamed({"name": "name_a", "idx": "idx_a"}), names.withColumnsRenamed({"name": "name_b", "idx": "idx_b"})
    if weights.blocking_is_exact:
        tokens = leading_tokens(names, weights.least_jaccard)
        side = lambda x: tokens.withColumnsRenamed({c: f"{c}_{x}" for c in ("name", "idx", "place", "size")})
        met = side("a").join(side("b"), ["type", "token"]).filter(F.col("idx_a") < F.col("idx_b"))
        pairs = met.filter(can_reach(weights.least_jaccard)).select("type", "name_a", "idx_a", "name_b", "idx_b").distinct()
    else:
        pairs = a.join(b, "type").filter("idx_a < idx_b")
    scored = pairs.withColumn("score", F.round(similarity.score(F.col("name_a"), F.col("name_b"), F.col("type"), F.col("type"), weights), 6))
    return scored.filter(F.col("score") >= weights.threshold).select("type", "idx_a", "idx_b", "name_a", "name_b", "score")


def can_reach(least: float) -> Column:
    """Whether two names whose first common token stands at place_a and place_b of their rarest-first tokens can have the
    similarity: the sizes must be near enough, and enough tokens must be left. A later common token may say no; the first
    one of a pair that is similar enough says yes."""
    shorter, longer = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    common = 1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    return (shorter >= least * longer - 1e-9) & (common * (1 + least) >= least * (F.col("size_a") + F.col("size_b")) - 1e-9)


def leading_tokens(names: DataFrame, least: float) -> DataFrame:
    """Rows (type, name, idx, token, place, size) of the rarest tokens of each name: sets of at least this similarity share one."""
    tokens = names.withColumn("token", F.explode(token_set(F.col("name"))))
    counts = tokens.groupBy("type", "token").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("type", "name")
    ranked = tokens.join(counts, ["type", "token"]).withColumn("place", F.row_number().over(w.orderBy("_n", "token"))).withColumn("size", F.count("*").over(w))
    return ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).drop("_n")


def clusters(entities: DataFrame, weights: similarity.Weights = similarity.Weights()) -> DataFrame:
    """Each entity with the least idx of its cluster: (idx, type, name, description, cluster). Equal names are one cluster."""
    named = entities.select("idx", entity_type(F.col("type")).alias("type"), "name", "description")
    firsts = named.groupBy("type", "name").agg(F.min("idx").alias("first"))
    found = components(similar_pairs(entities, weights), "idx_a", "idx_b").withColumnsRenamed({"node": "first"})
    return named.join(firsts, ["type", "name"]).join(found, "first", "left").select("idx", "type", "name", "description", F.coalesce("component", "first").alias("cluster"))


#: Members of a cluster that are folded at a time, by their place in the order of idx.
SLICE = 4096


def canonical(clustered: DataFrame) -> DataFrame:
    """One row per cluster: the longest name (the first of equally long ones), other names, descriptions joined in order.

    Members are folded in slices of idx, each by a task of its own, and slices are put together in order, so that the members of a
    large cluster are not sorted as one row; what they add up to is one."""
    best = clustered.groupBy("cluster", "type").agg(F.max_by("name", F.struct(F.length("name"), F.negate("idx"))).alias("name"), F.count("*").alias("members"))
    sliced = clustered.withColumn("_slice", F.floor(F.col("idx") / SLICE))
    parts = sliced.groupBy("cluster", "type", "_slice").agg(F.array_sort(F.collect_list(F.struct("idx", "name", "description"))).alias("rows"))
    texts = F.filter(F.transform("rows", lambda r: r["description"]), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
    parts = parts.select("cluster", "type", "_slice", F.transform("rows", lambda r: r["name"]).alias("names"), F.when(F.size(texts) > 0, F.array_join(texts, SEPARATOR)).alias("text"))
    whole = parts.groupBy("cluster", "type").agg(F.array_sort(F.collect_list(F.struct("_slice", "names", "text"))).alias("parts"))
    merged = F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t.isNotNull()), SEPARATOR)
    aliases = F.filter(F.flatten(F.transform("parts", lambda p: p["names"])), lambda n: n != F.col("name"))
    out = best.join(whole, ["cluster", "type"])
    return out.select("cluster", "type", "name", "members", aliases.alias("aliases"), F.when(merged == "", "No description available").otherwise(merged).alias("description"))


def stats(clustered: DataFrame) -> DataFrame:
    """Counts before and after, clusters of more than one, and the share removed in per cent (over 60 is a warning)."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n"))
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("original"), F.count("*").alias("resolved"), F.count_if(F.col("n") > 1).alias("clusters"))
    share = F.when(F.col("original") > 0, 100.0 * (F.col("original") - F.col("resolved")) / F.col("original")).otherwise(0.0)
    return out.select("original", "resolved", (F.col("original") - F.col("resolved")).alias("removed"), "clusters", F.round(share, 6).alias("reduction_percent"), (share > 60).alias("warning"))


def resolve(entities: DataFrame, weights: similarity.Weights = similarity.Weights(), compat: bool = False) -> DataFrame:
    """Canonical entities. With compat, a batch that has a blank type comes back as it was, as scoring it would fail."""
    if compat and not entities.filter(F.coalesce(F.trim("type"), F.lit("")) == "").isEmpty():
        return entities.select(F.col("idx").alias("cluster"), "type", "name", F.lit(1).cast("long").alias("members"), F.expr("cast(array() AS array<string>)").alias("aliases"), "description")
    return canonical(clusters(entities, weights))


def merged_descriptions(rows: DataFrame, key: list[str], order: str, limit: int = 1000, size: int = 1000) -> DataFrame:
    """Descriptions of one key folded in order: one that is already contained adds nothing; over the limit they are cut.

    A description counts where it stands first, as it is contained from then on. The first `size` different ones of each key are
    folded; only keys that have more and are not cut yet take another turn with the next, so no key is ever one row. A
    text that was cut does not change any more. The type is that of the first row."""

    def add(acc: Column, d: Column) -> Column:
        longer = F.concat(acc, F.lit(SEPARATOR), d)
        cut = F.when(F.length(longer) > limit, F.concat(F.substring(longer, 1, limit - 3), F.lit("..."))).otherwise(longer)
        return F.when(F.contains(acc, d), acc).when(acc == "", d).otherwise(cut)

    kinds = rows.groupBy(*key).agg(F.min_by("type", order).alias("type"))
    scratch = Scratch(rows.sparkSession, "descriptions")
    todo = scratch.save(rows.groupBy(*key, F.coalesce("description", F.lit("")).alias("_d")).agg(F.min(order).alias("_at")), "distinct")
    done, state, turn = None, None, 0
    while True:
        place = F.row_number().over(Window.partitionBy(*key).orderBy("_at", "_d"))
        first = (todo if state is None else todo.join(state.select(*key, "_acc", "_last"), key).filter(F.struct("_at", "_d") > F.col("_last"))).withColumn("_place", place).filter(F.col("_place") <= size)
        start = F.lit("") if state is None else F.first("_acc")
        listed = F.array_sort(F.collect_list(F.struct("_at", "_d")))
        folded = first.groupBy(*key).agg(listed.alias("_rows"), start.alias("_start"))
        folded = folded.select(*key, F.aggregate(F.transform("_rows", lambda r: r["_d"]), F.col("_start"), add).alias("_acc"), F.element_at("_rows", -1).alias("_last"), (F.size("_rows") == size).alias("_more"))
        folded = scratch.save(folded, f"turn{turn}")
        full = (F.length("_acc") == limit) & F.col("_acc").endswith("...")
        now = folded.select(*key, "_acc", F.lit(turn).alias("_turn"))
        done = now if done is None else done.unionByName(now)
        state, turn = folded.filter(F.col("_more") & ~full), turn + 1
        if state.isEmpty():
            break
    texts = done.groupBy(*key).agg(F.max_by("_acc", "_turn").alias("description"))
    return texts.join(kinds, key).select(*key, "type", "description")
