"""Domain tables as views of the driver's tables, by projection only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, scan, mz, intensity: peaks of scans."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("scan"), (F.col("l_extendedprice") / 100).alias("mz"), F.col("l_quantity").alias("intensity"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax").alias("ord"),
    )


SCAN_PEAKS = "SELECT l_suppkey AS source, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS scan, l_extendedprice / 100 AS mz, l_quantity AS intensity, (l_orderkey, l_linenumber, l_partkey, l_discount, l_tax) AS ord FROM lineitem"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, source, mz, tol, lo, hi (scan window) of a feature table."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_sources"))
    return table(spark, sf_dir, "part").crossJoin(F.broadcast(n)).select(  # one row
        F.col("p_partkey").alias("feature"), (F.col("p_partkey") % F.col("n_sources") + 1).alias("source"), F.col("p_retailprice").alias("mz"), (F.col("p_retailprice") * 500e-6).alias("tol"),
        (F.col("p_size") * 50 - 60).alias("lo"), (F.col("p_size") * 50 + 60).alias("hi"),
    )


FEATURES = "SELECT p_partkey AS feature, p_partkey % (SELECT count(*) FROM supplier) + 1 AS source, p_retailprice AS mz, p_retailprice * 500e-6 AS tol, p_size * 50 - 60 AS lo, p_size * 50 + 60 AS hi FROM part"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace, i, y: one intensity trace for each user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), (F.row_number().over(order) - 1).alias("i"), F.greatest("value", F.lit(0.0)).alias("y"))


TRACES = "SELECT user_id AS trace, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i, greatest(value, 0.0) AS y FROM events"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, source, domain, size, label, flag: labelled rows with their provenance."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("seed"), "source", F.col("lang").alias("domain"), F.col("n_chars").alias("size"), F.col("quality").alias("label"), F.col("toxic").alias("flag")
    )


SEEDS = "SELECT doc_id AS seed, source, lang AS domain, n_chars AS size, quality AS label, toxic AS flag FROM documents LEFT JOIN labels USING (doc_id)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, source, score, label, flag of rows with a label and a model's probability."""
    return seeds(spark, sf_dir).filter("label is not null").select("seed", "source", F.least(F.col("size") / 40000.0, F.lit(1.0)).alias("score"), "label", "flag")


SCORED = f"SELECT seed, source, least(size / 40000.0, 1.0) AS score, label, flag FROM ({SEEDS}) WHERE label IS NOT NULL"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, box, target, x1, y1, x2, y2, score: odd lines are annotated boxes, even ones predictions."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample"), (F.col("l_linenumber") % 2 == 1).alias("target"), F.col("l_quantity").alias("x1"), F.lit(0.0).alias("y1"),
        (F.col("l_quantity") + 5 + 100 * F.col("l_tax")).alias("x2"), (F.col("l_partkey") % 50 + 10).cast("double").alias("y2"), (F.col("l_discount") * 10).alias("score"), F.col("l_extendedprice").alias("ord"),
    )


BOXES = "SELECT l_orderkey AS sample, l_linenumber % 2 = 1 AS target, l_quantity AS x1, CAST(0 AS DOUBLE) AS y1, l_quantity + 5 + 100 * l_tax AS x2, CAST(l_partkey % 50 + 10 AS DOUBLE) AS y2, l_discount * 10 AS score, l_extendedprice AS ord FROM lineitem"


def eics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace, i, x (minutes), y: an ion chromatogram for each user, a peak every 20 scans, as high as the events near it say."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), (F.row_number().over(order) - 1).alias("i"), F.greatest("value", F.lit(0.0)).alias("v"))
    at = F.col("i") % 20 - 10
    return d.select("trace", "i", (F.col("i") * 0.02).alias("x"), ((F.col("v") + 20) * F.exp(-(at * at) / 18.0) + F.col("v") / 50).alias("y"))


EICS = f"SELECT trace, i, i * CAST(0.02 AS DOUBLE) AS x, (y + 20) * exp(-((i % 20 - 10) * (i % 20 - 10)) / CAST(18 AS DOUBLE)) + y / 50 AS y FROM ({TRACES})"
