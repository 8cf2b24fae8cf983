"""Tables written to the folder that driver and executors share, where several later steps read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only with a local master, and where that is unset, a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """Write once, read back: later steps see the same rows, and a lost executor costs repeated reads only."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def unsent(rows: DataFrame) -> DataFrame:
    """Rows that a join must not broadcast: Spark takes a written table for as large as its packed files, and keys pack to a
    tenth and less, so by that size tables of a million rows would be sent through the driver."""
    return rows.hint("merge")
