"""Peaks of traces: prominence, core walks, valley folds, windows around peaks and what lies between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traces import EPS, apexes, by_place, smoothed


def maxima(points: DataFrame, height: float = 0.0, *more: str) -> DataFrame:
    """Places of local maxima above a height: peak (ordinal), i, y, and more columns of theirs."""
    d = points.withColumns({"p": F.lag("y").over(by_place()), "q": F.lead("y").over(by_place())})
    tops = d.filter((F.col("y") > height) & (F.col("y") > F.col("p")) & (F.col("y") >= F.col("q")))
    return tops.select("trace", F.row_number().over(by_place()).alias("peak"), "i", "y", *more)


def prominences(points: DataFrame) -> DataFrame:
    """place and prominence of each local maximum of y inside a trace; a plateau counts once, at its middle.

    Plateaus are islands of equal neighbours, found by window functions. A maximum's base on one side is the least value
    before the trace rises above it, on the trace's array of islands; a trace is bounded by the scans of its window.
    """
    new = F.when(F.lag("y").over(by_place()).eqNullSafe(F.col("y")), 0).otherwise(1)
    steps = points.withColumn("_new", new).withColumn("island", F.sum("_new").over(by_place().rowsBetween(Window.unboundedPreceding, 0)))
    islands = steps.groupBy("trace", "island").agg(F.floor((F.min("i") + F.max("i")) / 2).alias("place"), F.first("y").alias("y"))
    rows = islands.groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("island", "place", "y"))).alias("x"))
    low = lambda part, y: F.aggregate(part, F.struct(y.alias("low"), F.lit(False).alias("done")), lambda s, e: F.when(s["done"] | (e["y"] > y), F.struct(s["low"].alias("low"), F.lit(True).alias("done"))).otherwise(F.struct(F.least(s["low"], e["y"]).alias("low"), F.lit(False).alias("done"))))["low"]
    x = F.col("x")

    def judged(e: Column, k: Column) -> Column:
        top = (k > 0) & (k < F.size(x) - 1) & (F.get(x, k - 1)["y"] < e["y"]) & (F.get(x, k + 1)["y"] < e["y"])
        base = F.greatest(low(F.reverse(F.slice(x, 1, k)), e["y"]), low(F.slice(x, k + 2, F.size(x)), e["y"]))
        return F.struct(e["place"].alias("place"), F.when(top, e["y"] - base).alias("prominence"))

    found = rows.select("trace", F.explode(F.filter(F.transform(x, judged), lambda s: s["prominence"].isNotNull())).alias("s"))
    return found.select("trace", "s.place", "s.prominence")


def secondary(points: DataFrame, away: int = 2) -> DataFrame:
    """MOD: the greatest prominence on the smoothed trace of a maximum more than `away` points from the apex, over the smoothed value at the apex; 0 without one."""
    tops = apexes(points).select("trace", "apex")
    m = smoothed(points).select("trace", "i", F.col("m").alias("y"))
    best = prominences(m).join(tops, "trace").filter(F.abs(F.col("place") - F.col("apex")) > away).groupBy("trace").agg(F.max("prominence").alias("p"))
    at_apex = m.join(tops, "trace").filter("i = apex").select("trace", F.col("y").alias("m"))
    return at_apex.join(best, "trace", "left").select("trace", F.least(F.lit(1.0), F.coalesce("p", F.lit(0.0)) / (F.col("m") + EPS)).alias("MOD"))


def core(points: DataFrame, share: float = 0.05, confirm: int = 2) -> DataFrame:
    """lo, hi: from the apex outward to where `confirm` consecutive points are at or under a share of the apex, or to the end."""
    d = points.join(apexes(points), "trace").withColumn("low", (F.col("y") <= share * F.col("top")).cast("int"))
    ahead, behind = Window.partitionBy("trace").orderBy("i").rowsBetween(0, confirm - 1), Window.partitionBy("trace").orderBy("i").rowsBetween(-(confirm - 1), 0)
    d = d.withColumns({"f": (F.sum("low").over(ahead) == confirm), "b": (F.sum("low").over(behind) == confirm)})
    return d.groupBy("trace", "n", "apex").agg(
        F.coalesce(F.max(F.when((F.col("i") < F.col("apex")) & F.col("b"), F.col("i"))), F.lit(0)).alias("lo"),
        F.coalesce(F.min(F.when((F.col("i") > F.col("apex")) & F.col("f"), F.col("i"))), F.col("n") - 1).alias("hi"),
    )


def valley_right(points: DataFrame, rise: float = 0.05, patience: int = 3) -> DataFrame:
    """The place where the descent right of the apex ends: the least value before a rise of more than a share of the apex, or before
    `patience` points without a new least one. A fold over the ordered points of a trace, on the JVM."""
    d = points.join(apexes(points), "trace").filter("i > apex").groupBy("trace", "apex", "top").agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("x"))
    start = F.struct(F.col("apex").cast("long").alias("at"), F.col("top").alias("least"), F.lit(0).alias("waited"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        lower = p["y"] < s["least"]
        stop = (p["y"] - s["least"] > rise * F.col("top")) | (s["waited"] + 1 >= patience)
        moved = F.struct(p["i"].cast("long").alias("at"), p["y"].alias("least"), F.lit(0).alias("waited"), F.lit(False).alias("done"))
        stayed = F.struct(s["at"].alias("at"), s["least"].alias("least"), (s["waited"] + 1).alias("waited"), stop.alias("done"))
        return F.when(s["done"], s).when(lower, moved).otherwise(stayed)

    return d.select("trace", "apex", F.aggregate("x", start, step).alias("s")).select("trace", "apex", F.col("s.at").alias("valley"), F.col("s.least").alias("y"))


def shared_valleys(points: DataFrame, height: float) -> DataFrame:
    """Between each peak and the next: the first place of the least value, where that is under both peaks.

    One window over the ordered trace numbers the stretches between peaks, so points meet no peaks but their own.
    """
    d = points.withColumns({"p": F.lag("y").over(by_place()), "q": F.lead("y").over(by_place())})
    d = d.withColumn("top", F.coalesce((F.col("y") > height) & (F.col("y") > F.col("p")) & (F.col("y") >= F.col("q")), F.lit(False)))
    d = d.withColumn("peak", F.sum(F.col("top").cast("int")).over(by_place().rowsBetween(Window.unboundedPreceding, 0)).cast("int")).filter("peak > 0")
    inner = F.when(~F.col("top"), F.struct("y", "i"))
    s = d.groupBy("trace", "peak").agg(F.max(F.when(F.col("top"), F.col("y"))).alias("own"), F.min(inner).alias("x"))
    s = s.withColumn("next", F.lead("own").over(Window.partitionBy("trace").orderBy("peak")))
    return s.filter(F.col("x.y") < F.least("own", "next")).filter("next is not null").select("trace", "peak", F.col("x.i").alias("valley"), F.col("x.y").alias("y"))


def gaussian(points: DataFrame, sigma: float = 1.0, reach: int = 3) -> DataFrame:
    """y smoothed with a truncated Gaussian over the places that a trace has."""
    import math

    weights = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)}
    near = lambda k: F.lag("y", -k).over(by_place())
    total = sum((w * F.coalesce(near(k), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    norm = sum((w * near(k).isNotNull().cast("int") for k, w in weights.items()), F.lit(0.0))
    return points.select("trace", "i", (total / norm).alias("y"))


def window_diagnostics(points: DataFrame, half: int = 10) -> DataFrame:
    """Of the window around the apex: points, height, baseline (fifth part from below), net area by trapezoids, whether the top is at an edge."""
    d = points.join(apexes(points), "trace").filter(F.abs(F.col("i") - F.col("apex")) <= half)
    area = (F.col("y") + F.lead("y").over(by_place())) / 2
    d = d.withColumn("area", area)
    s = d.groupBy("trace", "apex", "top").agg(F.count("*").alias("n_points"), F.percentile("y", F.lit(0.2)).alias("baseline"), F.sum("area").alias("area"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    return s.select("trace", "n_points", (F.col("top") - F.col("baseline")).alias("height"), "baseline", (F.col("area") - F.col("baseline") * (F.col("hi") - F.col("lo"))).alias("net_area"), ((F.col("apex") == F.col("lo")) | (F.col("apex") == F.col("hi"))).alias("at_edge"))


def interval_overlaps(a: DataFrame, b: DataFrame, span: int = 64) -> DataFrame:
    """Pairs of closed intervals (trace, id, lo, hi) of one trace that touch, with whether b's middle lies in a.

    Joined by buckets of the axis; a pair that shares several buckets counts in the one where it begins to touch.
    """
    bucket = F.explode(F.sequence(F.floor(F.col("lo") / span), F.floor(F.col("hi") / span))).alias("bucket")
    x = a.select("trace", "id", "lo", "hi", bucket)
    y = b.select("trace", F.col("id").alias("other"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), bucket)
    middle = (F.col("other_lo") + F.col("other_hi")) / 2
    touch = (F.col("lo") <= F.col("other_hi")) & (F.col("other_lo") <= F.col("hi")) & (F.floor(F.greatest("lo", "other_lo") / span) == F.col("bucket"))
    return x.join(y, ["trace", "bucket"]).filter(touch).select("trace", "id", "other", ((middle >= F.col("lo")) & (middle <= F.col("hi"))).alias("core"))


def plot_windows(points: DataFrame, features: DataFrame, width: float = 2.0) -> DataFrame:
    """Points (trace, i, x, y) of each feature (feature, trace, RT) within RT -+ width / 2, both ends closed, clamped to what the trace has."""
    ends = points.groupBy("trace").agg(F.min("x").alias("x0"), F.max("x").alias("x9"))
    f = features.join(ends, "trace").select("feature", "trace", F.greatest(F.col("RT") - width / 2, "x0").alias("lo"), F.least(F.col("RT") + width / 2, "x9").alias("hi"))
    return points.join(f, "trace").filter("x >= lo and x <= hi").select("feature", "trace", "i", "x", "y")


def seed_diagnostics(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """Of each seed (seed, trace, rt, lo, hi) in its window: width_sec, height, height_rt, area (net, over seconds), seed_intensity
    (at the scan nearest to rt), max_at_edge and point_count. The baseline is the fifth part from below of a minute on
    either side of rt (of the whole trace if that is empty). An empty window has nulls, its maximum counts as at an edge."""
    y = F.when((F.col("y") > 0) & (F.col("y") < float("inf")), F.col("y")).otherwise(0.0)
    d = points.select("trace", "i", "x", y.alias("y")).join(seeds.select("seed", "trace", "rt", "lo", "hi"), "trace")
    inside, plot = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")), F.abs(F.col("x") - F.col("rt")) <= 1.0
    s = d.groupBy("seed", "rt", "lo", "hi").agg(
        F.coalesce(F.percentile(F.when(plot, F.col("y")), F.lit(0.2)), F.percentile("y", F.lit(0.2))).alias("base"), F.min_by("y", F.struct(F.abs(F.col("x") - F.col("rt")), "i")).alias("seed_intensity"),
        F.count_if(inside).alias("point_count"), F.max_by(F.struct("i", "x", "y"), F.when(inside, F.struct("y", -F.col("i")))).alias("top"), F.min(F.when(inside, F.col("i"))).alias("first"),
    )
    inner = d.filter(inside).join(s.select("seed", "base"), "seed")
    net = F.greatest(F.col("y") - F.col("base"), F.lit(0.0))
    line = Window.partitionBy("seed").orderBy("i")
    inner = inner.withColumn("net", net).withColumn("strip", (F.col("net") + F.lag("net").over(line)) / 2 * (F.col("x") - F.lag("x").over(line)) * 60)
    s = s.join(inner.groupBy("seed").agg(F.sum("strip").alias("area")), "seed", "left")
    margin, at, n = F.least(F.lit(2), F.floor(F.col("point_count") / 5)), F.col("top.i") - F.col("first"), F.col("point_count")
    edge = F.when(n == 0, True).otherwise((at <= margin) | (at >= n - 1 - margin))
    return s.select(
        "seed", F.greatest(F.lit(0.0), (F.col("hi") - F.col("lo")) * 60).alias("width_sec"), F.col("top.y").alias("height"), F.col("top.x").alias("height_rt"), F.when(n >= 2, F.col("area")).when(n == 1, 0.0).alias("area"),
        F.when(n > 0, F.col("seed_intensity")).alias("seed_intensity"), edge.alias("max_at_edge"), "point_count",
    )


def seed_relations(seeds: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of a seed (trace, seed, rt, lo, hi) and a peak of its trace (trace, peak, lo, hi, apex) that touch or lie about it:
    overlap (closed intervals touch), core (the apex is inside the seed's as well), anchor (rt is within the peak's bounds, `tolerance` wider)."""
    p = found.select("trace", "peak", F.col("lo").alias("left"), F.col("hi").alias("right"), "apex")
    overlap = (F.col("right") >= F.col("lo")) & (F.col("left") <= F.col("hi"))
    anchor = (F.col("rt") >= F.col("left") - tolerance) & (F.col("rt") <= F.col("right") + tolerance)
    core = overlap & (F.col("apex") >= F.col("lo")) & (F.col("apex") <= F.col("hi"))
    return seeds.join(p, "trace").filter(overlap | anchor).select("seed", "peak", overlap.alias("overlap"), core.alias("core"), anchor.alias("anchor"))


def best_boxes(boxes: DataFrame, score: float = 0.0, most: int = 2) -> DataFrame:
    """sample, num_boxes, has_peak and, of the `most` predictions of the highest score, box1_x1 ... box1_y2, box1_score, box2_x1 ...; samples without one have nulls."""
    kept = F.when(~F.col("target") & (F.col("score") >= score), F.struct((-F.col("score")).alias("s"), "ord", "x1", "y1", "x2", "y2", "score"))
    d = boxes.groupBy("sample").agg(F.count(kept).alias("num_boxes"), F.slice(F.array_sort(F.collect_list(kept)), 1, most).alias("b"))  # a sample's boxes
    of = lambda k, c: F.get("b", F.lit(k))[c].alias(f"box{k + 1}_{c}")
    return d.select("sample", "num_boxes", (F.col("num_boxes") > 0).cast("int").alias("has_peak"), *(of(k, c) for k in range(most) for c in ("x1", "y1", "x2", "y2", "score")))
