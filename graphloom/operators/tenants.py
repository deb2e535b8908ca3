"""Graphs by tenant: names, existence, access, and the tables of a tenant below a folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID), F.lit(False))


def graph_name(project: Column) -> Column:
    """`graph_` and the 32 hex digits of a project's UUID; null for what is no UUID."""
    return F.when(is_uuid(project), F.concat(F.lit("graph_"), F.substring(F.lower(F.replace(project, F.lit("-"), F.lit(""))), 1, 32)))


def _folder(spark: SparkSession, root: str, project: str):
    if not re.match(UUID, project):
        raise ValueError(f"{project} is no UUID")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/graph_{project.replace('-', '').lower()}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def create_graph(spark: SparkSession, root: str, project: str, vertices: DataFrame, edges: DataFrame) -> bool:
    """Makes an empty graph with the columns of two frames; whether there was none before."""
    path, fs = _folder(spark, root, project)
    if fs.exists(path):
        return False
    for name, like in (("vertices", vertices), ("edges", edges)):
        spark.createDataFrame([], like.schema).write.parquet(f"{path}/{name}")
    return True


def graph_exists(spark: SparkSession, root: str, project: str) -> bool:
    path, fs = _folder(spark, root, project)
    return fs.exists(path)


def drop_graph(spark: SparkSession, root: str, project: str) -> bool:
    """Removes a graph with all it holds; whether there was one."""
    path, fs = _folder(spark, root, project)
    return fs.delete(path, True)


def open_graph(spark: SparkSession, root: str, project: str) -> tuple[DataFrame, DataFrame]:
    path, _ = _folder(spark, root, project)
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def readable(owner: Column, user: Column, admin: Column | bool = False) -> Column:
    """Admins read all, anyone what has no owner, an owner what is theirs."""
    return F.coalesce(F.lit(admin) if isinstance(admin, bool) else admin, F.lit(False)) | owner.isNull() | F.coalesce(owner == user, F.lit(False))


def writable(owner: Column, user: Column, admin: Column | bool = False) -> Column:
    """Admins and owners write."""
    return F.coalesce(F.lit(admin) if isinstance(admin, bool) else admin, F.lit(False)) | F.coalesce(owner == user, F.lit(False))


def with_project(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors whose empty project_id is filled in from their document (id, project_id)."""
    d = documents.select(F.col("id").alias("document_id"), F.col("project_id").alias("_p"))
    return vectors.join(d, "document_id", "left").select(*[F.coalesce(c, "_p").alias(c) if c == "project_id" else F.col(c) for c in vectors.columns])


def without_document(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors whose document is not there (any more). Those that name none are not among them."""
    return vectors.filter(F.col("document_id").isNotNull()).join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def schema_version(versions: DataFrame) -> DataFrame:
    """The latest version of a migrations table; 0 if it is empty."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
