"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(links: DataFrame) -> DataFrame:
    """_id, component (least id that links reach) of every id in links(a, b).

    Each round takes the least label of the neighbours and then the label of the label, so long chains halve; every
    round is written to the shared folder. Counting combines in the map tasks, so a hub of any degree is no hot task.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = both.groupBy(F.col("a").alias("_id")).agg(F.min("b").alias("b")).select("_id", F.least("_id", "b").alias("component"))
    while True:
        labels = written(labels, "labels")
        near = both.join(labels.select(F.col("_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("_id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "_id").select("_id", "component", F.least("component", "near").alias("least"))
        jump = labels.select(F.col("_id").alias("least"), F.col("component").alias("far"))
        new = written(step.join(jump, "least").select("_id", F.col("component").alias("was"), F.least("least", "far").alias("component")), "labels")
        if new.filter("was != component").isEmpty():
            return new.select("_id", "component")
        labels = new.select("_id", "component")
