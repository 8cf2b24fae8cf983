"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 spelling of the ASCII white space class that the contracts use.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text; none for null and empty texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors can reach.

    The cluster names the place in spark.checkpoint.dir. Where that is unset, a local master gets a local folder; on a
    cluster that is an error, as executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    Shuffle files of what has been written are let go at once, unless the table is `small`.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if not small:
        spark._jvm.System.gc()  # the shuffle files of what has just been written go now, not when the driver's heap is full
    return spark.read.schema(df.schema).parquet(path)


def struct_of(columns: list[str] | tuple[str, ...], name: str) -> Column:
    """Columns of any names in one struct, so that they cannot clash with those an operator makes."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias(name)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of written tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unique_ids(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, _id (a unique long in the order of doc_id) and, if there are any, the columns `keep` as a struct.

    Where doc_id is unique and never null it is itself the key. Else rows are numbered in the order of (doc_id, text),
    null ids last, and written, so that a recomputed task cannot number tied rows anew.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"), *([struct_of(keep, "keep")] if keep else []))
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull())
    if twice.isEmpty():
        return rows.withColumn("_id", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
