"""Graphs as two frames: vertices (name, ...) and directed edges (src, tgt, ...), at most one for each ordered pair."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import stored_name
from graphloom.plans.scratch import Scratch


def of_project(table: DataFrame, project: str) -> DataFrame:
    """The tenant's rows; on tables partitioned by project_id the scan reads no other partition."""
    return table.filter(F.col("project_id") == project)


def entity(vertices: DataFrame, name: str) -> DataFrame:
    return vertices.filter(F.col("name") == stored_name(F.lit(name)))


def relation(edges: DataFrame, src: str, tgt: str) -> DataFrame:
    return edges.filter((F.col("src") == stored_name(F.lit(src))) & (F.col("tgt") == stored_name(F.lit(tgt))))


def named(vertices: DataFrame, names: DataFrame, keep_order: bool = False) -> DataFrame:
    """Vertices of a frame of names. With keep_order a `position` column of the names stays, and repeats with it."""
    if keep_order:
        return names.join(vertices, "name")
    return vertices.join(names.select("name"), "name", "left_semi")


def incident(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges that touch any of the names, once each: two equi-joins, no disjunction."""
    out = edges.join(names.select(F.col("name").alias("src")).distinct(), "src", "left_semi")
    back = edges.join(names.select(F.col("name").alias("tgt")).distinct(), "tgt", "left_semi").join(names.select(F.col("name").alias("src")).distinct(), "src", "left_anti")
    return out.unionByName(back)


def touching_chunks(rows: DataFrame, chunk_ids: list[str]) -> DataFrame:
    """Rows whose source chunks meet a list given by the caller."""
    return rows.filter(F.arrays_overlap("source_chunk_ids", F.array(*map(F.lit, chunk_ids))))


def touching_chunk_table(rows: DataFrame, key: list[str], chunks: DataFrame) -> DataFrame:
    """The same for a table of chunk ids of any size."""
    keys = rows.select(*key, F.explode("source_chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_semi").select(*key).distinct()
    return rows.join(keys, key, "left_semi")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array_distinct(F.array("src", "tgt"))).alias("name"))


def degrees(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Edges at each node, a self-loop once. Names without edges have 0."""
    found = endpoints(edges).groupBy("name").agg(F.count("*").alias("degree"))
    if names is None:
        return found
    return names.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("degree", F.lit(0)).alias("degree"))


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts and mean degree 2E/V; 0 without vertices."""
    v, e = vertices.agg(F.count("*").alias("entity_count")), edges.agg(F.count("*").alias("relation_count"))
    mean = F.when(F.col("entity_count") > 0, 2.0 * F.col("relation_count") / F.col("entity_count")).otherwise(0.0)
    return v.crossJoin(e).withColumn("average_degree", F.round(mean, 6))  # two frames of one row


#: Names of up to so many are looked up as literals, which prunes buckets; a name with more edges is kept in several slots.
FEW_NAMES, HUB = 256, 1 << 16


class Adjacency:
    """Edges as (name, neighbour) in both directions, stored in buckets and sorted by name.

    A search for few names reads their buckets only; for many, their buckets are joined where they are stored and only the
    names are shuffled. A hub's edges are dealt to slots, so that no bucket gets all of them. Null ends are no edges.
    """

    def __init__(self, edges: DataFrame, buckets: int | None = None, scratch: Scratch | None = None):
        self.spark: SparkSession = edges.sparkSession
        scratch = scratch or Scratch(self.spark, "adjacency")
        one = edges.select(F.col("src").alias("name"), F.col("tgt").alias("neighbour"))
        both = one.unionByName(edges.select(F.col("tgt").alias("name"), F.col("src").alias("neighbour"))).filter("name IS NOT NULL AND neighbour IS NOT NULL")
        self.hubs = scratch.save(both.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("name", F.ceil(F.col("n") / HUB).cast("int").alias("parts")), "hubs")
        self.some_hubs = not self.hubs.isEmpty()
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        slots = both.join(F.broadcast(self.hubs), "name", "left") if self.some_hubs else both.withColumn("parts", F.lit(None).cast("int"))
        part = F.pmod(F.xxhash64("neighbour"), F.col("parts"))
        slots = slots.select(F.when(F.col("parts").isNull(), F.col("name")).otherwise(F.concat_ws("\u0001", "name", part)).alias("slot"), "name", "neighbour")
        table = f"adjacency_{uuid.uuid4().hex}"
        slots.repartition(self.buckets, "slot").dropDuplicates().write.bucketBy(self.buckets, "slot").sortBy("slot").option("path", f"{scratch.path}/adjacency").saveAsTable(table)
        scratch.tables.add("adjacency")
        self.table = self.spark.table(table)

    def of(self, frontier: DataFrame, size: int | None = None) -> DataFrame:
        """(name, neighbour) of the names of a frontier, once each; size: how many names, if known."""
        names = frontier.select("name")
        if self.some_hubs:
            cut = names.join(F.broadcast(self.hubs), "name", "left")
            parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))
            names = cut.select("name", "parts", parts.alias("k")).select(F.when(F.col("parts").isNull(), F.col("name")).otherwise(F.concat_ws("\u0001", "name", "k")).alias("slot"))
        else:
            names = names.withColumnRenamed("name", "slot")
        if size is not None and size <= FEW_NAMES:
            found = [r["slot"] for r in names.distinct().limit(4 * FEW_NAMES + 1).collect()]
            if len(found) <= 4 * FEW_NAMES:
                return self.table.filter(F.col("slot").isin(found)).select("name", "neighbour")
        return self.table.join(names.distinct().hint("merge"), "slot", "left_semi").select("name", "neighbour")


def neighbours(edges: DataFrame | Adjacency, frontier: DataFrame, size: int | None = None) -> DataFrame:
    """(name, neighbour) over edges in either direction; of plain edges both ends are equi-joins."""
    if isinstance(edges, Adjacency):
        return edges.of(frontier, size)
    names = frontier.select("name")
    out = edges.select(F.col("src").alias("name"), F.col("tgt").alias("neighbour")).join(names, "name", "left_semi")
    back = edges.select(F.col("tgt").alias("name"), F.col("src").alias("neighbour")).join(names, "name", "left_semi")
    return out.unionByName(back).distinct()


def levels(edges: DataFrame | Adjacency, seeds: DataFrame, max_depth: int, max_nodes: int = 0) -> DataFrame:
    """Breadth-first levels from seed names: (name, depth, parent). The parent is the least name of the level before.

    max_nodes > 0 keeps the first so many by depth and name, and no level is searched once they are found. A level is
    written to the scratch folder; the search ends when a level is empty. Of plain edges a level reads all, once; of an
    Adjacency it reads the buckets of its frontier.
    """
    scratch = Scratch(seeds.sparkSession, "levels")
    edges = edges if isinstance(edges, Adjacency) else edges.select("src", "tgt")
    seen = scratch.save(seeds.select("name").distinct().select("name", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), "l0")
    frontier, count = seen, seen.count()
    found = count
    for depth in range(1, max_depth + 1):
        if 0 < max_nodes <= count:
            break
        step = neighbours(edges, frontier, found).groupBy(F.col("neighbour").alias("next")).agg(F.min("name").alias("parent"))
        fresh = step.select(F.col("next").alias("name"), F.lit(depth).alias("depth"), "parent").join(seen.select("name"), "name", "left_anti")
        if depth == max_depth and max_nodes <= 0:
            return seen.unionByName(fresh.select("name", "depth", "parent"))  # nothing follows the last level
        frontier = scratch.save(fresh.select("name", "depth", "parent"), f"l{depth}")
        if not (found := frontier.count()):
            break
        count += found
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "name").limit(max_nodes) if max_nodes > 0 else seen


def subgraph(vertices: DataFrame, edges: DataFrame, start: str, max_depth: int, max_nodes: int = 0, near: Adjacency | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices within max_depth of the start and the edges between them; both empty if there is no such vertex.
    near: the same edges as an Adjacency, which the search then reads."""
    found = levels(near or edges, entity(vertices, start), max_depth, max_nodes)
    names = found.select("name")
    inner = edges.join(names.select(F.col("name").alias("src")), "src", "left_semi").join(names.select(F.col("name").alias("tgt")), "tgt", "left_semi")
    if max_depth == 0:
        inner = inner.limit(0)
    return vertices.join(names, "name", "left_semi"), inner


def reached(vertices: DataFrame, edges: DataFrame, start: str, max_depth: int, max_nodes: int = 0, near: Adjacency | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices within max_depth of a name, which need not be a vertex, and all edges at the nodes that were searched,
    also those to nodes found before or beyond max_nodes. Nodes at max_depth are not searched."""
    seed = edges.sparkSession.createDataFrame([(start,)], "name string").select(stored_name(F.col("name")).alias("name"))
    found = levels(near or edges, seed, max_depth, max_nodes)
    return vertices.join(found.select("name"), "name", "left_semi"), incident(edges, found.filter(F.col("depth") < max_depth).select("name"))


def shortest_path(edges: DataFrame | Adjacency, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """Nodes of a shortest undirected path: (step, name); empty if there is none, or none of max_depth edges.

    The search goes on from both ends, each time from that with fewer names in its last level, until the last levels meet.
    Levels of the target's end are then cut to nodes on shortest paths. Among equal paths that counts whose last node but one
    is the least, then the one before it, and so on. The path itself is read by one job.
    """
    spark: SparkSession = edges.spark if isinstance(edges, Adjacency) else edges.sparkSession
    row = lambda *names: spark.createDataFrame([names], ", ".join(f"n{k} string" for k in range(len(names))))
    nothing = spark.createDataFrame([], "step int, name string")
    if source == target:
        return spark.createDataFrame([(0, source)], "step int, name string")
    scratch = Scratch(spark, "path")
    edges = edges if isinstance(edges, Adjacency) else edges.select("src", "tgt")
    layers = [[spark.createDataFrame([(name, None)], "name string, parent string")] for name in (source, target)]
    seen, sizes = [layers[0][0].select("name"), layers[1][0].select("name")], [1, 1]
    while max_depth is None or len(layers[0]) + len(layers[1]) - 2 < max_depth:
        k = 0 if sizes[0] <= sizes[1] else 1
        step = neighbours(edges, layers[k][-1], sizes[k]).groupBy(F.col("neighbour").alias("next")).agg(F.min("name").alias("parent"))
        fresh = step.select(F.col("next").alias("name"), "parent").join(seen[k], "name", "left_anti")
        fresh = scratch.save(fresh, f"side{k}-{len(layers[k])}")
        sizes[k], hits = fresh.join(layers[1 - k][-1].select("name", F.lit(1).alias("met")), "name", "left").agg(F.count("*"), F.count("met")).first()
        layers[k].append(fresh)
        seen[k] = seen[k].unionByName(fresh.select("name"))
        if hits:
            break
        if not sizes[k]:
            return nothing
    else:
        return nothing
    on = layers[0][-1].select("name").join(layers[1][-1].select("name"), "name", "left_semi")
    links = []  # from the target: each node on a path with the least that comes before it
    for j in range(len(layers[1]) - 2, -1, -1):
        step = neighbours(edges, on).groupBy(F.col("neighbour").alias("next")).agg(F.min("name").alias("before"))
        step = scratch.save(step.select(F.col("next").alias("name"), "before").join(layers[1][j].select("name"), "name", "left_semi"), f"on{j}")
        links.insert(0, step)
        on = step.select("name")
    links += [layer.select("name", F.col("parent").alias("before")) for layer in reversed(layers[0][1:])]
    path = row(target)
    for k, link in enumerate(links):
        path = F.broadcast(path).join(link.select(F.col("name").alias(f"n{k}"), F.col("before").alias(f"n{k + 1}")), f"n{k}")
    names = F.array(*[f"n{k}" for k in range(len(links), -1, -1)])
    return path.select(F.posexplode(names).alias("step", "name"))


def expand(edges: DataFrame | Adjacency, seeds: DataFrame, hops: int = 1) -> DataFrame:
    return levels(edges, seeds, hops).select("name")


def page(table: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return table.orderBy(*order).offset(offset).limit(limit)


def pair_key(edges: DataFrame) -> DataFrame:
    """Edges with their unordered pair."""
    return edges.withColumn("low", F.least("src", "tgt")).withColumn("high", F.greatest("src", "tgt"))
