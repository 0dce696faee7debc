"""Lineage cuts in the folder that all executors share, and the package for their Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back. Where a session has none (tests on one machine) a local one is made.

    Parquet is a fraction of the size of Spark's own checkpoints, and its sizes are known to the planner.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-"))
        base = context._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/newsloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="newsloom-"), "newsloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
