"""Repeated extraction: a model is asked again about a chunk as long as it finds something new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.extraction import keep_longer, parse_responses
from graphloom.plans.scratch import Scratch

ENTITY, RELATION = ["chunk_id", "name", "type", "description"], ["chunk_id", "src", "tgt", "keywords", "description", "weight"]


def entity_key() -> Column:
    return F.struct("chunk_id", F.lower("name").alias("name"))


def relation_key() -> Column:
    return F.struct("chunk_id", F.lower("src").alias("src"), F.lower("tgt").alias("tgt"))


def glean(first: DataFrame, ask: Callable[[DataFrame], DataFrame], max_passes: int = 1, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and relations of chunks (chunk_id, content, response), and the passes that each chunk took.

    ask gets the chunks that still change, (chunk_id, content, previous), and gives their next answers, (chunk_id,
    response); a null answer stands for a failed call and a missing one too. A chunk stops when an answer has no new
    entity and no new relation for it, which leaves that answer out, or after max_passes; what was found stays. Of
    equal names, or equal pairs, in a chunk the longest description counts, of equally long ones the first. Each pass is
    written and reads the chunks that are left only.
    """
    if max_passes < 0:
        raise ValueError("max_passes must not be negative")
    scratch = scratch or Scratch(first.sparkSession, "gleaning")
    texts = first.select("chunk_id", "content")
    answers = scratch.save(first.select("chunk_id", "response"), "answers0")
    found = [_parsed(answers, 0, scratch)]
    passes = answers.select("chunk_id", F.lit(0).alias("passes"))
    for k in range(1, max_passes + 1):
        asked = ask(answers.withColumnRenamed("response", "previous").join(texts, "chunk_id").select("chunk_id", "content", "previous"))
        answers = scratch.save(asked.select("chunk_id", "response").filter("response IS NOT NULL"), f"answers{k}")
        entities, relations = _parsed(answers, k, scratch)
        known = [_all(found, n) for n in (0, 1)]
        fresh = [rows.withColumn("key", key()).join(old.select(key().alias("key")).distinct(), "key", "left_anti").select("chunk_id") for rows, old, key in ((entities, known[0], entity_key), (relations, known[1], relation_key))]
        changed = scratch.save(fresh[0].unionByName(fresh[1]).distinct(), f"changed{k}")
        if changed.isEmpty():
            break
        found.append(tuple(rows.join(changed, "chunk_id", "left_semi") for rows in (entities, relations)))
        passes = passes.unionByName(changed.select("chunk_id", F.lit(k).alias("passes")))
        answers = answers.join(changed, "chunk_id", "left_semi")
    entities = keep_longer(_all(found, 0), entity_key(), "at", ENTITY)
    relations = keep_longer(_all(found, 1), relation_key(), "at", RELATION)
    return entities, relations, passes.groupBy("chunk_id").agg(F.max("passes").alias("passes"))


def _parsed(answers: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    at = (F.lit(k).cast("long") * (1 << 32) + F.col("seq")).alias("at")
    entities, relations = parse_responses(answers, "chunk_id", "response")
    return scratch.save(entities.select(*ENTITY, at), f"entities{k}"), scratch.save(relations.select(*RELATION, at), f"relations{k}")


def _all(found: list[tuple[DataFrame, DataFrame]], which: int) -> DataFrame:
    rows = found[0][which]
    for more in found[1:]:
        rows = rows.unionByName(more[which])
    return rows
