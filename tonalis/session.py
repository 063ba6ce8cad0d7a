"""Getting this package to the Python workers, and tables to where all executors find them."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless their ``PYTHONPATH`` already names it."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp()) / "tonalis_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "tonalis").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the folder that all executors share and read again, so what is used several times is computed once and survives lost executors.

    The folder is ``spark.checkpoint.dir``; only where that is unset and there is
    one machine, a temporary folder of it.  What is written goes with the session.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tonalis-tables-")
        context.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
