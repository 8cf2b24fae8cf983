"""Greedy alignment of detectors' tables, cell by cell, to a fixed point.

In the greedy order (detector, m/z, RT) a row joins the centroid that was made first among those within both tolerances,
and moves it, or makes one. What a row does depends on earlier rows within two tolerances of it only: a centroid that it
can see was last moved by such a row.

So the plane of m/z and RT is cut into cells of bounded numbers of rows, at borders that are four tolerances apart at
least. A cell takes its own rows in order, and replays, between them, what the rows of its neighbours within two tolerances
of the border did when their cells were last taken. Cells whose neighbours did something else than before are taken again,
all of them in parallel, until none is left. Then each row did what the rows before it imply, which is the greedy answer: by
induction over the order there is only one. Rounds are as many as the longest chain of cells along which an answer changes.

The first time, a cell has nothing to replay. So it also takes a margin of its neighbours' rows as if they were its own, a
quarter of a cell on each side at most. What it thus holds those near the border to have done is mostly what their own cells
find, and then the cell is not taken again.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .tables import numbered

#: Rows of a cell, unless more of them lie within four tolerances; a margin is a cell's part in so many.
CELL, PARTS = 50_000, 4
#: A row of a cell: its own, or of its margin, and there one that it has to replay, or not.
OWN, REPLAYED, MARGIN = 0, 1, 2
EVENT = ("algo", "mz", "rt", "id", "f_algo", "f_mz", "f_rt", "f_id", "c_mz", "c_rt", "c_n")
TYPES = {"algo": "string", "mz": "double", "rt": "double", "id": "long", "f_algo": "string", "f_mz": "double", "f_rt": "double", "f_id": "long", "c_mz": "double", "c_rt": "double", "c_n": "long"}
ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}


def _grouped(counts: DataFrame, part: list[str], bucket: str, name: str, size: int) -> DataFrame:
    """Consecutive buckets in groups of about `size` rows, from a table with one row for each bucket."""
    line = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(bucket)
    before = F.coalesce(F.sum("k").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn(name, F.floor(before / size)).drop("k")


def _near(v: Column, bucket: Column, width: float, reach: float) -> Column:
    """A value's bucket, and those next to it that the value is within reach of."""
    low, high = F.when(v - bucket * width <= reach, bucket - 1), F.when((bucket + 1) * width - v <= reach, bucket + 1)
    return F.array_compact(F.array(bucket, low, high))


def _besides(part: str) -> Column:
    """The groups of PARTS parts that a part is in or next to."""
    return F.array_distinct(F.transform(F.array(*(F.col(part) + k for k in (-1, 0, 1))), lambda v: F.floor(v / PARTS)))


def cells(rows: DataFrame, mz_tol: float, rt_tol: float, size: int = CELL) -> tuple[DataFrame, DataFrame]:
    """rows (id, mz, rt, ...) with their cell, and readers: id and cell of the rows that another cell replays."""
    return cells_and_margins(rows, mz_tol, rt_tol, size)[:2]


def cells_and_margins(rows: DataFrame, mz_tol: float, rt_tol: float, size: int = CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (id, mz, rt, ...) with their cell, readers: id and cell of the rows that another cell replays, and margins: the rows beside other cells, with those cells."""
    wide, high = 4 * mz_tol, 4 * rt_tol
    d = rows.withColumns({"bx": F.floor(F.col("mz") / wide), "by": F.floor(F.col("rt") / high)})
    slabs = _grouped(d.groupBy("bx").agg(F.count("*").alias("k")), [], "bx", "slab", size / PARTS)  # a row for each four tolerances of m/z
    strips = slabs.withColumn("strip", F.floor(F.col("slab") / PARTS))
    d = d.join(strips, "bx")
    parts = _grouped(d.groupBy("strip", "by").agg(F.count("*").alias("k")), ["strip"], "by", "part", size / PARTS)
    cell = F.concat_ws(":", "strip", "block").alias("cell")
    parts = written(parts.withColumn("block", F.floor(F.col("part") / PARTS)).select("strip", "by", "part", cell), "parts")
    blocks, strips = parts.drop("part"), strips.drop("slab")
    d = written(d.join(blocks, ["strip", "by"]), "cells")
    slack = 1 + 1e-9
    around = d.select("id", F.col("cell").alias("own"), F.explode(_near(F.col("mz"), F.col("bx"), wide, 2 * mz_tol * slack)).alias("bx"), _near(F.col("rt"), F.col("by"), high, 2 * rt_tol * slack).alias("bys"))
    around = around.join(strips, "bx").select("id", "own", "strip", F.explode("bys").alias("by")).join(blocks, ["strip", "by"])
    readers = around.filter("cell <> own").select("id", "cell").distinct()
    beside = d.withColumnRenamed("cell", "own").withColumn("strip", F.explode(_besides("slab"))).join(parts.drop("cell"), ["strip", "by"]).withColumn("block", F.explode(_besides("part")))
    margins = beside.withColumn("cell", cell).filter("cell <> own").join(parts.select("cell").distinct(), "cell", "left_semi")
    return d.drop("bx", "by", "strip", "slab"), written(readers, "readers"), margins.select(*rows.columns, "cell")


def _settle(mz_tol: float, rt_tol: float):
    """Of one cell: what each of its own rows does, given what others' rows did, and what those of its margin would do that it has to replay."""

    def run(key: tuple, own: pa.Table, halo: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        mine = [(r, None) for r in zip(*(own[c].to_pylist() for c in ("algo", "mz", "rt", "id", "weight", "role")), strict=True)]
        others = [(r[:4], r[4:]) for r in zip(*(halo[c].to_pylist() for c in EVENT), strict=True)]
        state: dict[tuple, tuple[float, float, int]] = {}  # by founder: m/z, RT, rows
        line: list[tuple] = []  # m/z and founder

        def put(founder: tuple, mz: float, rt: float, n: int) -> None:
            if founder in state:
                del line[bisect_left(line, (state[founder][0], founder))]
            state[founder] = (mz, rt, n)
            insort(line, (mz, founder))

        out = []
        for row, event in sorted(mine + others, key=lambda x: x[0][:4]):
            if event is not None:
                put(tuple(event[:4]), *event[4:])
                continue
            algo, mz, rt, id_, weight, role = row
            founder = None
            for at in range(bisect_left(line, (mz - 1.5 * mz_tol,)), len(line)):
                c_mz, f = line[at]
                if c_mz - mz > mz_tol:
                    break
                if abs(c_mz - mz) <= mz_tol and abs(state[f][1] - rt) <= rt_tol and (founder is None or f < founder):
                    founder = f
            if founder is None:
                founder, (c_mz, c_rt, n) = row[:4], (mz, rt, 0)
            else:
                c_mz, c_rt, n = state[founder]
            put(founder, (c_mz * n + mz * weight) / (n + weight), (c_rt * n + rt * weight) / (n + weight), n + weight)
            if role != MARGIN:
                out.append((*row[:4], *founder, *state[founder], role))
        *columns, roles = list(zip(*out, strict=True)) or [()] * (len(EVENT) + 1)
        arrays = [pa.array([cell] * len(out), pa.string()), *(pa.array(list(v), ARROW[TYPES[c]]) for c, v in zip(EVENT, columns, strict=True)), pa.array(roles, pa.int32())]
        return pa.Table.from_arrays(arrays, ["cell", *EVENT, "role"])

    return run


def events(rows: DataFrame, mz_tol: float, rt_tol: float, size: int = CELL) -> DataFrame:
    """What each row (id, algo, mz, rt, weight) does in the greedy order: the founder of its centroid, and that after it (c_mz, c_rt, c_n)."""
    d, readers, margins = cells_and_margins(rows, mz_tol, rt_tol, size)
    schema = "cell string, " + ", ".join(f"{c} {TYPES[c]}" for c in EVENT)
    seen = ["cell", *EVENT]
    d = d.withColumn("role", F.lit(OWN))
    beside = margins.join(readers.withColumn("read", F.lit(True)), ["id", "cell"], "left").withColumn("role", F.when(F.col("read"), REPLAYED).otherwise(MARGIN)).drop("read")
    halo, dirty, done, n = readers.sparkSession.createDataFrame([], schema), None, [], 0
    while True:
        todo = d.join(dirty, "cell", "left_semi") if n else d.unionByName(beside)
        replayed = halo.join(dirty, "cell", "left_semi") if n else halo
        did = written(todo.groupBy("cell").cogroup(replayed.groupBy("cell")).applyInArrow(_settle(mz_tol, rt_tol), schema + ", role int"), "events")
        if n == 0:
            halo = did.filter(F.col("role") == REPLAYED).select(*seen)  # as it seemed beside the border
        did = did.filter(F.col("role") == OWN).drop("role")
        done.append(did.withColumn("round", F.lit(n)))
        told = readers.join(did.drop("cell"), "id").select(*seen)
        if n:  # what rows of the other cells did stands
            told = told.unionByName(halo.join(did.select("id"), "id", "left_anti"))
        told = written(told, "halo")
        dirty = written(told.exceptAll(halo).select("cell").distinct(), "dirty")
        halo, n = told, n + 1
        if dirty.isEmpty():
            break
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    last = every.groupBy("cell").agg(F.max("round").alias("round"))
    return every.join(last, ["cell", "round"]).drop("cell", "round")


def align(rows: DataFrame, mz_tol: float, rt_tol: float, size: int = CELL) -> DataFrame:
    """aligned (A1 ... by m/z and RT), n, mz, rt and the greatest intensity per detector (null counts as 0) of the greedy
    alignment of (algo, mz, rt, intensity). Rows without m/z or RT go.

    Equal rows of a detector follow each other and join the same centroid, so they are one row of a weight.
    """
    one = rows.filter(F.col("mz").isNotNull() & F.col("rt").isNotNull()).groupBy("algo", F.col("mz").cast("double").alias("mz"), F.col("rt").cast("double").alias("rt"))
    points = written(one.agg(F.count("*").alias("weight"), F.max(F.coalesce(F.col("intensity").cast("double"), F.lit(0.0))).alias("intensity")).withColumn("id", F.monotonically_increasing_id()), "points")
    done = events(points.select("id", "algo", "mz", "rt", "weight"), mz_tol, rt_tol, size).join(points.select("id", "intensity"), "id")
    founder = ["f_algo", "f_mz", "f_rt", "f_id"]
    order, centre = F.struct("algo", F.col("mz"), F.col("rt"), "id"), F.struct("c_mz", "c_rt", "c_n")
    per = done.groupBy(*founder, "algo").agg(F.max("intensity").alias("most"), F.max(F.struct(order.alias("o"), centre.alias("c"))).alias("last"))  # a row for each detector
    d = per.groupBy(*founder).agg(F.max("last").alias("last"), F.map_from_entries(F.collect_list(F.struct("algo", "most"))).alias("intensity"))
    d = d.select(F.col("last.c.c_n").alias("n"), F.col("last.c.c_mz").alias("mz"), F.col("last.c.c_rt").alias("rt"), "intensity", F.col("f_id").alias("_id"))
    return numbered(d, ["mz", "rt", "_id"], "A", "aligned", 1).select("aligned", "n", "mz", "rt", "intensity")


def missed_by(aligned: DataFrame, algo: str) -> DataFrame:
    """Aligned features that other detectors have, with an intensity above 0, and this one has not."""
    has = F.coalesce(F.col("intensity")[algo] > 0, F.lit(False))
    others = F.exists(F.map_entries("intensity"), lambda e: (e["key"] != algo) & (e["value"] > 0))
    return aligned.filter(~has & others)
