"""What Python workers need to know of this session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .scratch import on_one_machine

PACKAGE = Path(__file__).resolve().parents[1]
ROOT = str(PACKAGE.parent)
_SHIPPED: set[str] = set()


def findable(spark: SparkSession) -> None:
    """Lets Python workers import the package: from its folder on this machine, wherever the driver was started, and from
    an archive that Spark sends to the executors of a cluster."""
    context = spark.sparkContext
    env = context.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), ROOT]))
    if not on_one_machine(spark) and context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        archive = Path(tempfile.mkdtemp(prefix=PACKAGE.name)).resolve() / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for part in PACKAGE.rglob("*.py"):
                z.write(part, part.relative_to(PACKAGE.parent))
        context.addPyFile(str(archive))  # the driver serves it; executors fetch it once
