"""The domain's frames built from the driver tables: entities, relations, vectors, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Adjacency
from graphloom.plans.scratch import Scratch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, suppliers and customers: idx, name, type, description, document_id, source_chunk_ids. Part names repeat."""
    chunks = lambda key: F.array(F.concat(F.lit("c"), F.col(key) % 7), F.concat(F.lit("c"), F.col(key) % 11))
    doc = lambda key: F.concat(F.lit("d"), F.col(key) % 10)
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"), F.lit("PART").alias("type"), F.concat_ws(" ", "p_brand", "p_type").alias("description"), doc("p_partkey").alias("document_id"), chunks("p_partkey").alias("source_chunk_ids"))
    supplier = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000000).alias("idx"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("type"), F.concat(F.lit("nation "), F.col("s_nationkey")).alias("description"), doc("s_suppkey").alias("document_id"), chunks("s_suppkey").alias("source_chunk_ids"))
    customer = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 2000000000).alias("idx"), F.col("c_name").alias("name"), F.lit("CUSTOMER").alias("type"), F.col("c_mktsegment").alias("description"), doc("c_custkey").alias("document_id"), chunks("c_custkey").alias("source_chunk_ids"))
    return part.unionByName(supplier).unionByName(customer)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges: part to supplier, supplier and customer to nation, nation to region; one for each ordered pair."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ").alias("keywords"), F.min("l_orderkey").alias("o"))
    edge = lambda s, sk, t, tk: (F.concat(F.lit(s), F.col(sk)).alias("src"), F.concat(F.lit(t), F.col(tk)).alias("tgt"))
    rest = lambda d, k: (F.lit(d).alias("description"), F.lit("").alias("keywords"), F.lit(1.0).alias("weight"), F.concat(F.lit("d"), F.col(k) % 10).alias("document_id"), F.array(F.concat(F.lit("c"), F.col(k) % 7)).alias("source_chunk_ids"))
    a = li.select(*edge("p", "l_partkey", "s", "l_suppkey"), F.lit("SUPPLIED_BY").alias("description"), "keywords", "weight", F.concat(F.lit("d"), F.col("o") % 10).alias("document_id"), F.array(F.concat(F.lit("c"), F.col("o") % 7)).alias("source_chunk_ids"))
    b = read(spark, sf_dir, "supplier").select(*edge("s", "s_suppkey", "n", "s_nationkey"), *rest("LOCATED_IN", "s_suppkey"))
    c = read(spark, sf_dir, "customer").select(*edge("c", "c_custkey", "n", "c_nationkey"), *rest("LOCATED_IN", "c_custkey"))
    d = read(spark, sf_dir, "nation").select(*edge("n", "n_nationkey", "r", "n_regionkey"), *rest("PART_OF", "n_nationkey"))
    return a.unionByName(b).unionByName(c).unionByName(d)


_STORED: dict[tuple, DataFrame | Adjacency] = {}


def stored_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relations() as a stored table, written once a session: traversals read edges level by level and should not make
    them anew each time."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        _STORED[key] = Scratch(spark, "edges").save(relations(spark, sf_dir), "relations")
    return _STORED[key]


def stored_adjacency(spark: SparkSession, sf_dir: str) -> Adjacency:
    """The same edges by their ends, in buckets, written once a session."""
    key = spark.sparkContext.applicationId, sf_dir, "adjacency"
    if key not in _STORED:
        _STORED[key] = Adjacency(stored_relations(spark, sf_dir))
    return _STORED[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors: id, vector, type (chunk or entity) and project."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "chunk").otherwise("entity").alias("type"), F.col("label").alias("project_id"))


#: The same frames in SQL.
ENTITIES_SQL = """entities AS (
  SELECT p_partkey AS idx, p_name AS name, 'PART' AS type, p_brand || ' ' || p_type AS description, 'd' || (p_partkey % 10) AS document_id, ['c' || (p_partkey % 7), 'c' || (p_partkey % 11)] AS source_chunk_ids FROM part
  UNION ALL SELECT s_suppkey + 1000000000, s_name, 'SUPPLIER', 'nation ' || s_nationkey, 'd' || (s_suppkey % 10), ['c' || (s_suppkey % 7), 'c' || (s_suppkey % 11)] FROM supplier
  UNION ALL SELECT c_custkey + 2000000000, c_name, 'CUSTOMER', c_mktsegment, 'd' || (c_custkey % 10), ['c' || (c_custkey % 7), 'c' || (c_custkey % 11)] FROM customer)"""
RELATIONS_SQL = """relations AS (
  SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, 'SUPPLIED_BY' AS description, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS keywords, sum(l_quantity) AS weight, 'd' || (min(l_orderkey) % 10) AS document_id, ['c' || (min(l_orderkey) % 7)] AS source_chunk_ids FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN', '', 1.0, 'd' || (s_suppkey % 10), ['c' || (s_suppkey % 7)] FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LOCATED_IN', '', 1.0, 'd' || (c_custkey % 10), ['c' || (c_custkey % 7)] FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF', '', 1.0, 'd' || (n_nationkey % 10), ['c' || (n_nationkey % 7)] FROM nation)"""
