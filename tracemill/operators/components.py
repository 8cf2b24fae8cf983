"""Connected components of pairs, by joins; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import unsent, written


def connected(pairs: DataFrame) -> DataFrame:
    """id, root (least id that pairs(a, b) reach). Labels spread to neighbours and then jump to their label's label."""
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("root")), "labels")
    while True:
        near = both.join(unsent(labels.select(F.col("id").alias("b"), "root")), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(unsent(near), "id").select("id", "root", F.least("root", "near").alias("least"))
        jump = labels.select(F.col("id").alias("least"), F.col("root").alias("far"))
        new = written(step.join(unsent(jump), "least").select("id", F.col("root").alias("was"), F.least("least", "far").alias("root")), "labels")
        if new.filter("was != root").isEmpty():
            return new.select("id", "root")
        labels = new.select("id", "root")


def grouped(ids: DataFrame, pairs: DataFrame, prefix: str = "G") -> DataFrame:
    """id, root, members and group of every id: groups of two and more are numbered in the order of their roots, an id without a pair is its own root and has no group."""
    from .tables import numbered

    roots = connected(pairs)
    sizes = roots.groupBy("root").agg(F.count("*").alias("members"))
    names = numbered(sizes, ["root"], prefix, "group")
    return ids.select("id").join(unsent(roots), "id", "left").withColumn("root", F.coalesce("root", "id")).join(unsent(names), "root", "left").select("id", "root", F.coalesce("members", F.lit(1)).alias("members"), "group")
