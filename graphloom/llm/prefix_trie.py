"""The trie of conversation prefixes, by prefix doubling.

Turns get dense names: one number for each distinct turn. Blocks of 2, 4, 8, ... turns are named by the pair of names of their
halves, one join round for each power of two. A prefix is cut as its length in binary says, 13 turns into 8, 4 and 1; it
is named by the name of what stands before its last block and the name of that block, again a round for each power,
the largest first. Equal names of equal length are equal prefixes, which are the nodes of the trie.

Rounds grow with the logarithm of the longest conversation, and names are exact: no node depends on a hash of a sequence.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ordering import numbered, running_sums

from .common import Scratch, arrow_map, match

#: Conversations that share a start, and most turns that they may share.
FAMILY, MOST_SHARED = 100, 6
#: Ids that are joined to one string at a time.
IDS = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered(turns: DataFrame, scratch: Scratch, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Turns in order, (conv, at from 0, k1, k2, size), and the turns of each conversation, (conv, own). k1 and k2 are hashes of role
    and text, size is the text's length. Rows are sorted as one table and numbered, so that a conversation of any length
    is spread over tasks; texts do not travel."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), clean(role).alias("role"), clean(text).alias("text"))
    src = src.select("conv", "turn", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "role").alias("k2"), F.length("text").cast("long").alias("size"))
    rows = numbered(src.filter("conv IS NOT NULL"), ["conv", F.asc_nulls_first("turn"), "k1", "k2"], "number", scratch, "ordered")
    firsts = scratch.save(rows.groupBy("conv").agg(F.min("number").alias("first"), F.count("*").alias("own")), "firsts")
    rows = match(rows, firsts, ["conv"], "number", size="own").select("conv", (F.col("number") - F.col("first")).alias("at"), "k1", "k2", "size")
    return scratch.save(rows, "turns"), firsts.select("conv", "own")


def rebuilt(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the start of their family, and their sizes (conv, n): the first h turns of the family's first
    conversation, then what each has of its own after its first h."""
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("long")
    convs = sizes.withColumn("h", head).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    starts = sizes.select(F.col("conv").alias("base"), F.col("own").alias("has"))
    convs = convs.join(starts, "base", "left").withColumn("got", F.least("h", F.coalesce("has", F.lit(0))))
    shared = rows.filter(F.col("at") < MOST_SHARED).withColumnRenamed("conv", "base")
    start = convs.filter("got > 0").select("base", "conv", "got").join(shared, "base").filter("at < got").select(*rows.columns)
    own = match(rows, convs.select("conv", "h", "got", "own"), ["conv"], "at", size="own").filter("at >= h")
    own = own.withColumn("at", F.col("at") - F.col("h") + F.col("got")).select(*rows.columns)
    return start.unionByName(own), convs.select("conv", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def _named(rows: DataFrame, key: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Rows with a dense name in place of the key: 1 to the number of distinct keys. A key of a third of all rows is counted in
    parts and meets its name apart."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("same"))
    names = numbered(counts, [], "name", scratch, f"{name}_names")
    kept = [c for c in rows.columns if c not in key or c == "depth"]
    return scratch.save(match(rows, names, key, "conv", size="same").select(*kept, "name"), name)


def prefixes(turns: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """The name of each prefix of one turn or more: (conv, depth, name), by doubling. turns: (conv, at, key columns k1, k2)."""
    longest = sizes.agg(F.max("n")).first()[0] or 0
    level = _named(turns, ["k1", "k2"], scratch, "blocks0")  # (conv, at, name); at counts blocks
    blocks = [level]
    while (1 << len(blocks)) <= longest:
        odd = F.col("at") % 2 == 1
        halves = level.groupBy("conv", F.floor(F.col("at") / 2).alias("at")).agg(F.max(F.when(~odd, F.col("name"))).alias("x"), F.max(F.when(odd, F.col("name"))).alias("y"))
        level = _named(halves.filter("y IS NOT NULL"), ["x", "y"], scratch, f"blocks{len(blocks)}")
        blocks.append(level)
    found = sizes.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"))
    for k in reversed(range(len(blocks))):
        last = blocks[k].filter("at % 2 = 0").select("conv", (F.col("at") * (1 << k)).alias("depth"), F.col("name").alias("y"))
        longer = found.withColumnRenamed("name", "x").join(last, ["conv", "depth"]).withColumn("depth", F.col("depth") + (1 << k))
        found = found.unionByName(_named(longer, ["depth", "x", "y"], scratch, f"prefixes{k}"))
    return found


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of members (depth, node, conv): the digest of ids in numeric order, comma-joined.

    Ids are sorted by ranges and joined in parts first, also those of one node; a digest then takes parts one by one."""
    spread = ends.repartitionByRange("depth", "node", "conv").sortWithinPartitions("depth", "node", "conv")

    def join(batches):
        now, ids = None, []

        def part():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["depth", "node", "first", "ids"])

        for batch in batches:
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (depth, node) or len(ids) == IDS:
                    if ids:
                        yield part()
                    now, ids = (depth, node), []
                ids.append(conv)
        if ids:
            yield part()

    parts = arrow_map(spread, join, "depth long, node long, first long, ids string")
    parts = parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")

    def digest(batches):
        now, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], ["depth", "node", "ends_sha256"])
        for batch in batches:
            for depth, node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (depth, node):
                    if state:
                        yield row()
                    now, state = (depth, node), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield row()

    return arrow_map(parts, digest, "depth long, node long, ends_sha256 string")


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand in order of their number, null first, then of two hashes of role and text, so repeated numbers have a
    defined order; null roles and texts are empty. Rows without a conversation are no turns of any. Turns are told apart
    by those hashes (128 bits), of whole texts of any length. Further columns are passed over; without rows there is no root.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    rows, sizes = ordered(turns, scratch, conv, turn, role, text)
    rows, convs = rebuilt(rows, sizes)
    rows, convs = scratch.save(rows, "rebuilt"), scratch.save(convs, "convs")
    found = prefixes(rows.select("conv", "at", "k1", "k2"), convs, scratch)
    groups = found.groupBy("depth", "name").agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"))
    groups = scratch.save(groups, "groups")
    members = scratch.save(match(found, groups, ["depth", "name"], "conv", size="n_convs").select("conv", "depth", "node", "n_convs"), "members")
    # A node is told by its depth and its least member, whose own prefixes are the node's ancestors.
    parents = members.filter("conv = node").select("conv", (F.col("depth") - 1).alias("depth"), F.col("n_convs").alias("n")).filter("depth >= 0")
    parents = parents.join(members.select("conv", "depth", F.col("node").alias("parent")), ["conv", "depth"])
    parents = scratch.save(parents.select(F.col("conv").alias("node"), (F.col("depth") + 1).alias("depth"), "parent"), "parents")
    children = parents.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = groups.select("depth", "node", "n_convs").join(children, ["depth", "node"], "left").join(parents, ["depth", "node"], "left")
    nodes = scratch.save(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    # What a node adds is put down at its least member; sums over the rest of each member's way give the sums of subtrees.
    lengths = rows.select("conv", (F.col("at") + 1).alias("depth"), "size")
    own = nodes.select(F.col("node").alias("conv"), "depth", "n_convs", (F.col("n_children") == 0).cast("long").alias("leaf")).join(lengths, ["conv", "depth"], "left")
    own = own.select("conv", "depth", "leaf", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    worth = members.select("conv", "depth", "node").join(own, ["conv", "depth"], "left")
    below = running_sums(worth, ["conv"], "depth", {"saved_below": "saved", "leaves_below": "leaf"}, descending=True)
    sums = below.groupBy("depth", "node").agg(F.sum("leaves_below").alias("n_leaves"), F.sum("saved_below").alias("saved_tokens"))
    ends = members.join(convs.select("conv", F.col("n").alias("depth")), ["conv", "depth"]).select("depth", "node", "conv")
    out = nodes.join(sums, ["depth", "node"]).join(_digests(ends), ["depth", "node"], "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )

