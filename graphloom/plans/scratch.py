"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[Scratch] = []
#: After so many tables the driver's garbage is collected, as Spark removes the shuffle files and broadcasts of plans that
#: are gone only then; a driver with room to spare may not do it for long.
COLLECT = 4
_SAVED = itertools.count(1)


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


class Scratch:
    """A folder for intermediate tables below the session's checkpoint folder, which all executors share.

    Written tables cut lineage, so a lost executor costs only the tasks it was running. Tables are removed by drop() and
    keep(); what a lazy result still reads goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not on_one_machine(spark):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "/tmp/checkpoints"
        self.path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()
        _LEFT.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.tables.add(name)
        if next(_SAVED) % COLLECT == 0:
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing will read again."""
        for name in self.tables & set(names):
            self._delete(f"{self.path}/{name}")
        self.tables -= set(names)

    def keep(self, *names: str) -> None:
        """Removes all tables but these."""
        self.drop(*(self.tables - set(names)))


@atexit.register
def _clean() -> None:
    for scratch in _LEFT:
        with contextlib.suppress(Exception):  # the session may have ended before
            if scratch.tables and scratch.spark.sparkContext._jsc is not None:
                scratch._delete(scratch.path)
