"""Standardised boxes of annotated peaks: edges moved to low points that the trace's shape confirms, valleys that
neighbours share, and updates of a feature's bounds from an annotated box.

Points are (trace, i, x, y), i numbering the scans of a trace from 0 in the order of x (minutes). Spark shuffles the points
once, by trace, and gathers each trace into one array; edges and boxes meet the array of their own trace, so no row is made
for an edge and a point. What depends on the way from the apex outward is an array step over places counted that way, for
all edges of an Arrow batch together, left and right alike. A trace is bounded by the scans of one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boundaries import _medians, _together, core_ends, descend, padded, paths
from .shared import written

#: Minutes around an apex that count as its plot; scans of a tail; shares of steps that must fall or rise; fixed values.
PLOT, TAIL = 1.0, 8
TAIL_SHARE, OUT_SHARE, IN_SHARE = 0.70, 0.80, 0.75
#: Least and greatest share of the height that is a low tail, and most of an edge that may still move outward; fixed values.
LOW, LOW_MOST, EDGE_MOST = 0.01, 0.05, 0.03
FIRM, OUT_OF_PLOT = "True_Peak", "OUT_FIG"


def _clean(y: Column) -> Column:
    """Values that are not finite, and negative ones, are 0."""
    return F.coalesce(F.when((y > 0) & (y < float("inf")) & ~F.isnan(y), y), F.lit(0.0))


def lightly_smoothed(points: DataFrame) -> DataFrame:
    """points with n (scans of the trace) and s: weights 1 2 3 2 1 over five places, ends repeated; traces under five places stay."""
    by, whole = Window.partitionBy("trace").orderBy("i"), Window.partitionBy("trace")
    d = points.withColumn("c", _clean(F.col("y").cast("double"))).withColumn("n", F.count("*").over(whole))
    all_ = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("c").over(all_), F.last("c").over(all_)
    back = lambda k: F.coalesce(F.lag("c", k).over(by), first)
    ahead = lambda k: F.coalesce(F.lead("c", k).over(by), last)
    s = (back(2) + 2 * back(1) + 3 * F.col("c") + 2 * ahead(1) + ahead(2)) / 9
    return d.withColumn("s", F.when(F.col("n") >= 5, s).otherwise(F.col("c"))).drop("c")


def _arrays(points: DataFrame, *columns: str) -> DataFrame:
    """trace, p: the points of each trace in their order, as structs of i and the columns."""
    return points.groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("i", *columns))).alias("p"))


def _fifths(v: np.ndarray) -> np.ndarray:
    """The value a fifth up each sorted row, between neighbours by proportion; NaN come last and do not count."""
    row, k = np.arange(len(v)), np.sum(~np.isnan(v), axis=1)
    at = np.maximum(k - 1, 0) * 0.2
    lo, hi = v[row, np.floor(at).astype(int)], v[row, np.ceil(at).astype(int)]
    return lo + (hi - lo) * (at - np.floor(at))


def confirmed(traces: list[tuple[np.ndarray, np.ndarray]], edge: np.ndarray, apex: np.ndarray, side: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each edge goes by its smoothed trace (x, s), and the reason, as shape_edges says; side is -1 or 1, apex -1 if there is none."""
    n = np.array([len(x) for x, _ in traces])
    x, s = padded([t[0] for t in traces], np.inf), padded([t[1] for t in traces])
    row, places = np.arange(len(n)), np.arange(x.shape[1])
    real = places < n[:, None]
    known, seat = (apex >= 0) & (apex < n), np.clip(apex, 0, n - 1)
    with np.errstate(invalid="ignore"):
        v = np.sort(np.where(real & known[:, None] & (np.abs(x - x[row, seat][:, None]) <= PLOT), s, np.nan), axis=1)
        near = np.where(real, np.abs(x - edge[:, None]), np.inf).argmin(axis=1)
    base, low = _fifths(v), np.where(v <= _medians(v)[:, None], v, np.nan)
    sigma, top = 1.4826 * _medians(np.abs(low - _medians(low)[:, None])), np.where(known, s[row, seat], np.nan)
    height = np.fmax(top - base, 1e-12)
    share = np.fmin(LOW_MOST, np.fmax(LOW, 4 * sigma / height))
    noise = np.fmax(np.fmax(0.25 * sigma, 0.00025 * top), 1e-12)

    # what follows is by places from the apex outward
    at, there = paths(seat, side[:, None], n, x.shape[1] - 1)
    t, z = np.where(there, x[row[:, None], at], np.nan), np.where(there, s[row[:, None], at], np.nan)
    shifted = lambda a, k: np.pad(a, ((0, 0), (k, 0)), constant_values=np.nan)[:, : a.shape[1]] if k > 0 else np.pad(a, ((0, 0), (0, -k)), constant_values=np.nan)[:, -k:]
    inner, following = shifted(z, 1), shifted(z, -1)
    after = np.where(np.isnan(shifted(z, -2)), following, shifted(z, -2))
    step, noise_, p = z - inner, noise[:, None], np.arange(x.shape[1])
    n_falls, n_rises = np.cumsum(step <= noise_, axis=1), np.cumsum(step >= -noise_, axis=1)
    window = n_falls - np.pad(n_falls, ((0, 0), (TAIL - 1, 0)))[:, : n_falls.shape[1]]
    tail = window / np.maximum(1, np.minimum(p, TAIL - 1))

    o = np.where(apex >= 0, (near - apex) * side, 0)
    far = np.clip(o, 0, x.shape[1] - 1)
    value, way = s[row, near][:, None], np.abs(p - o[:, None])
    away, outward = np.abs(t - edge[:, None]), (t - edge[:, None]) * side[:, None] > 0
    over, gain, high = np.maximum(value - base[:, None], 0.0) / height[:, None], value - z, height[:, None]
    steps = np.where(outward, n_falls - n_falls[row, far][:, None], n_rises[row, far][:, None] - n_rises)
    smooth = np.where(way == 0, 1.0, steps / np.maximum(way, 1))
    minimum = (at >= 1) & (at <= n[:, None] - 2) & (z <= inner) & (z <= following) & (z <= (base + share * height)[:, None])
    turns = (following >= z - noise_) & (after >= z - noise_)
    meant = (smooth >= OUT_SHARE) & (over <= np.minimum(EDGE_MOST, share + 0.01)[:, None]) & (gain / high >= np.maximum(noise_ / high, 0.08 * np.maximum(over, 1e-12))) & (np.fmax(following, after) - z >= noise_)
    gained = np.where(outward, meant, (smooth >= IN_SHARE) & (gain > noise_))
    fits = there & (p > 0) & (away <= reach + 1e-12) & minimum & (tail >= TAIL_SHARE) & turns & gained

    ends = (near < 1) | (near > n - 2)
    slope = ((s[row, np.minimum(near + 1, len(places) - 1)] - s[row, np.maximum(near - 1, 0)]) * side)[:, None]  # outward
    best = fits & np.where(slope < -noise_, outward, np.where(slope > noise_, ~outward, True))
    for order in (away, z, at):  # the nearest; of those the least; of those the first
        some = np.where(best, order, np.inf)
        best &= some == some.min(axis=1, keepdims=True)
    k = best.argmax(axis=1)
    spacing = np.nan_to_num(_medians(np.where(real[:, 1:], np.diff(np.where(real, x, 0.0), axis=1), np.nan))) if x.shape[1] > 1 else np.zeros(len(n))
    with np.errstate(invalid="ignore"):
        cases = [(n < 5) | (apex < 0), o <= 0, ends, ~fits.any(axis=1), ~best.any(axis=1), away[row, k] <= np.maximum(0.25 * spacing, 1e-12), outward[row, k]]
    return t[row, k], np.select(cases, ["few_points", "past_apex", "at_end", "no_minimum", "against_slope", "already_there", "outward"], "inward")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def shape_edges(points: DataFrame, edges: DataFrame, seconds: float = 3.0) -> DataFrame:
    """trace, box, side, rt, moved, reason: each edge (trace, box, side, edge, apex) moved to the nearest place within
    `seconds` that the smoothed trace confirms as the end of its tail, or left where it is.

    Such a place is a local minimum near the baseline; the last steps to it from the apex mostly fall; the next two places
    outward do not fall under it. Outward, the edge must already be low, and the way to the place must mostly fall, by a
    meaningful amount, and turn; inward, the way back out must mostly rise. It lies on the side to which the trace falls
    at the edge. Reasons: outward, inward, few_points, past_apex, at_end, no_minimum, against_slope, already_there.
    """
    key, empty = ["trace", "box", "side", "edge", "apex"], F.array().cast("array<double>")
    s = _arrays(lightly_smoothed(points).withColumn("x", F.col("x").cast("double")), "x", "s")
    rows = edges.select("trace", "box", "side", F.col("edge").cast("double").alias("edge"), "apex").join(s, "trace", "left")
    rows = rows.select(*key, F.coalesce("p.x", empty).alias("xs"), F.coalesce("p.s", empty).alias("ss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ss = _lists(batch.column(5)), _lists(batch.column(6))
            edge, apex = batch.column(3).fill_null(np.nan).to_numpy(zero_copy_only=False), batch.column(4).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            side = np.array([-1 if v == "left" else 1 for v in batch.column(2).to_pylist()])
            x, reason = np.full(len(xs), np.nan), np.full(len(xs), "few_points", object)
            lengths = np.array([len(v) for v in xs], int)
            full = np.flatnonzero(lengths)
            for some in _together(lengths[full]) if len(full) else ():
                some = full[some]
                x[some], reason[some] = confirmed([(xs[k], ss[k]) for k in some], edge[some], apex[some], side[some], seconds / 60)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(x), pa.array(reason, pa.string())], ["trace", "box", "side", "edge", "x", "reason"])

    types = dict(rows.dtypes)
    r = rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in key[:4]) + ", x double, reason string")
    r = r.withColumn("moved", F.col("reason").isin("outward", "inward"))
    return r.select("trace", "box", "side", F.when(F.col("moved"), F.col("x")).otherwise(F.col("edge")).alias("rt"), "moved", "reason")


def _highest(points: DataFrame, boxes: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    """boxes with `name` (i, x, y of the first highest point from lo to hi, else null) and nearest (the point nearest their middle)."""
    p = _arrays(points.select("trace", "i", "x", F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y")), "x", "y")
    point = lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"), e["y"].alias("y"))
    within = F.filter("p", lambda e: (e["x"] >= F.col(lo)) & (e["x"] <= F.col(hi)))
    most = F.array_max(F.transform(within, lambda e: F.struct(e["y"].alias("y"), (-e["i"]).alias("k"), point(e).alias("point"))))["point"]
    near = F.array_min(F.transform("p", lambda e: F.struct(F.abs(e["x"] - (F.col(lo) + F.col(hi)) / 2).alias("away"), e["i"].alias("i"), point(e).alias("point"))))["point"]
    return boxes.join(p, "trace", "left").withColumns({name: most, "nearest": near}).drop("p")


def neighbour_valleys(points: DataFrame, boxes: DataFrame, seconds: float = 3.0) -> DataFrame:
    """trace, box, side, valley: the edges that two neighbouring boxes (trace, box, lo, hi, apex, top) share.

    Neighbours follow each other by apex. The least point between their apexes is their common edge if it is lower than
    both and within `seconds` of the edges they were drawn with.
    """
    order = Window.partitionBy("trace").orderBy("apex", "box")
    nxt = {c: F.lead(c).over(order) for c in ("box", "apex", "top", "lo")}
    pairs = boxes.select("trace", "box", "hi", "apex", "top", *(v.alias(f"next_{c}") for c, v in nxt.items())).filter("next_apex - apex > 1")
    p = _arrays(points.select("trace", "i", "x", _clean(F.col("y").cast("double")).alias("y")), "x", "y")
    between = F.filter("p", lambda e: (e["i"] > F.col("apex")) & (e["i"] < F.col("next_apex")))
    v = pairs.join(p, "trace").withColumn("v", F.array_min(F.transform(between, lambda e: F.struct(e["y"].alias("y"), e["i"].alias("i"), e["x"].alias("x"))))).drop("p")
    reach = seconds / 60 + 1e-12
    v = v.filter((F.col("v.y") < F.least("top", "next_top")) & (F.abs(F.col("v.x") - F.col("hi")) <= reach) & (F.abs(F.col("v.x") - F.col("next_lo")) <= reach))
    side = lambda box, name: F.struct(F.col(box).alias("box"), F.lit(name).alias("side"))
    return v.select("trace", F.explode(F.array(side("box", "right"), side("next_box", "left"))).alias("s"), F.col("v.x").alias("valley")).select("trace", "s.box", "s.side", "valley")


def standardised(points: DataFrame, boxes: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Final bounds of annotated boxes (trace, box, label, lo, hi, center).

    The apex is the highest point of the box, or the point nearest its middle. A box of label OUT_FIG is pinned to the
    nearer edge of the plot (a minute either side of center). Other edges go to the valley shared with a neighbour, else to a
    place confirmed by shape. Bounds that cross the apex, and bounds on which the highest point within comes to lie, are
    rolled back to those of the box. Columns: lo, hi, apex_rt, height, left_reason, right_reason, rolled_back
    (crosses_apex, apex_at_bound or null), review (why a person should look, sorted).
    """
    left_end, right_end = F.col("center") - PLOT, F.col("center") + PLOT
    drawn = boxes.select("trace", "box", "label", "center", F.col("lo").alias("raw_lo"), F.col("hi").alias("raw_hi"), F.greatest(left_end, F.col("lo")).alias("a"), F.least(right_end, F.col("hi")).alias("b"))
    drawn = drawn.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).drop("a", "b")
    drawn = _highest(points, drawn, "lo", "hi", "best").withColumn("peak", F.coalesce("best", "nearest")).drop("best", "nearest")
    out = F.col("label") == OUT_OF_PLOT
    pin = F.when(out, F.when(F.abs(F.col("raw_lo") - left_end) <= F.abs(right_end - F.col("raw_hi")), "left").otherwise("right"))
    drawn = written(drawn.withColumns({"pin": pin, "apex": F.col("peak.i"), "top": _clean(F.col("peak.y"))}), "drawn")

    valleys = neighbour_valleys(points, drawn, seconds)
    end = lambda name, c: F.struct(F.lit(name).alias("side"), F.col(c).alias("edge"), F.col("pin").eqNullSafe(F.lit(name)).alias("pinned"))
    edges = drawn.select("trace", "box", "apex", "center", F.explode(F.array(end("left", "lo"), end("right", "hi"))).alias("e")).select("trace", "box", "apex", "center", "e.*").join(valleys, ["trace", "box", "side"], "left")
    edges = written(edges, "edges")
    shaped = shape_edges(points, edges.filter("not pinned and valley is null"), seconds).select("trace", "box", "side", "rt", "reason")
    edges = edges.join(shaped, ["trace", "box", "side"], "left")
    plot_end = F.when(F.col("side") == "left", left_end).otherwise(right_end)
    rt = F.when(F.col("pinned"), plot_end).otherwise(F.coalesce("valley", "rt", "edge"))
    why = F.when(F.col("pinned"), "pinned").when(F.col("valley").isNotNull(), "shared_valley").otherwise(F.col("reason"))
    each = lambda side, value: F.max(F.when(F.col("side") == side, value))
    ends = edges.groupBy("trace", "box").agg(each("left", rt).alias("new_lo"), each("right", rt).alias("new_hi"), each("left", why).alias("left_reason"), each("right", why).alias("right_reason"))

    d = drawn.join(ends, ["trace", "box"])
    crosses = F.coalesce((F.col("new_lo") >= F.col("peak.x")) | (F.col("new_hi") <= F.col("peak.x")), F.lit(False))
    in_plot = lambda c: F.greatest(left_end, F.least(c, right_end))
    d = d.withColumn("crosses", crosses).withColumns({"new_lo": in_plot(F.when(F.col("crosses"), F.col("lo")).otherwise(F.col("new_lo"))), "new_hi": in_plot(F.when(F.col("crosses"), F.col("hi")).otherwise(F.col("new_hi")))})
    d = d.withColumns({"c": F.least("new_lo", "new_hi"), "e": F.greatest("new_lo", "new_hi")}).withColumns({"new_lo": F.col("c"), "new_hi": F.col("e")}).drop("c", "e")
    d = _highest(points, d, "new_lo", "new_hi", "found").drop("nearest")
    top = F.coalesce("found", "peak")
    at_bound = ~F.coalesce((F.col("new_lo") < top["x"]) & (top["x"] < F.col("new_hi")), F.lit(False))
    d = d.withColumn("at_bound", at_bound).withColumn("final", F.when(F.col("at_bound"), F.col("peak")).otherwise(top))  # the box's own highest point, or its nearest
    d = d.withColumns({"n_lo": F.when(F.col("at_bound"), F.col("lo")).otherwise(F.col("new_lo")), "n_hi": F.when(F.col("at_bound"), F.col("hi")).otherwise(F.col("new_hi"))})
    limit = seconds + 1e-6
    far = (~F.col("pin").eqNullSafe("left") & (F.abs(F.col("n_lo") - F.col("lo")) * 60 > limit)) | (~F.col("pin").eqNullSafe("right") & (F.abs(F.col("n_hi") - F.col("hi")) * 60 > limit))
    height = _clean(F.col("final.y"))
    faults = {"crosses_apex": F.col("crosses"), "no_scans": F.col("found").isNull(), "apex_at_bound": F.col("at_bound"), "moved_too_far": far, "no_height": height <= 0}
    review = F.array_join(F.array_sort(F.filter(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in faults.items())), lambda v: v.isNotNull())), ",")
    held = lambda c: F.when(F.col("at_bound"), "rolled_back").otherwise(F.col(c)).alias(c)
    return d.select(
        "trace", "box", "label", F.col("n_lo").alias("lo"), F.col("n_hi").alias("hi"), F.col("final.x").alias("apex_rt"), height.alias("height"), held("left_reason"), held("right_reason"),
        F.when(F.col("at_bound"), "apex_at_bound").when(F.col("crosses"), "crosses_apex").alias("rolled_back"), review.alias("review"),
    )


#: Of boxes that are too small to tell anything: pixels, seconds, scans. Labels that delete a sample or leave its label open. Fixed values.
TINY_PIXELS, TINY_SECONDS, TINY_SCANS = 4.5, 1.0, 3
DELETES, UNCERTAIN = ("D",), ("d",)
#: Of the walks from a box's edges: scans, minutes, rise, steps up, rebound, deviations over the baseline, share of the apex, quiet scans, times the core's width; fixed values.
WALK_SCANS, WALK_MINUTES, WALK_RISE, WALK_PATIENCE, WALK_REBOUND = 18, 0.35, 0.02, 2, 0.12
SIGMAS, LEAST_SHARE, CONFIRM, OVERSIZE = 3.0, 0.01, 2, 1.8

UPDATE = "new_RT double, new_RTmin double, new_RTmax double, box_apex_RT double, left_expand_scans int, right_expand_scans int, rollback_to_valley boolean, rollback_valley_RT double, bound_mode string, low_threshold double, oversized_shrink boolean"


def box_report(features: DataFrame, points: DataFrame, annotations: DataFrame, sources: DataFrame, window: float = 2.0) -> DataFrame:
    """What becomes of each feature (feature, source, RT, RTmin, RTmax) with an annotation (feature, labels, x_left, x_right
    in pixels, width of the plot): status, is_true_peak, and the box in scans (li, ri, box_RTmin, box_RTmax).

    The plot shows `window` minutes about RT. In turn: an annotation without feature is stale; a source that `sources`
    (source, n_scans) lacks, or that has no scans, and a feature without points are skipped; a label of DELETES deletes; a
    null box keeps the bounds; so does a tiny one; else the box decides. A label of UNCERTAIN leaves is_true_peak null.
    """
    a = annotations.select("feature", F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda v: F.trim(v)).alias("labels"), F.col("x_left").cast("double").alias("x_left"), F.col("x_right").cast("double").alias("x_right"), "width", F.lit(True).alias("annotated"))
    f = features.select("feature", "source", *(F.col(c).cast("double").alias(c) for c in ("RT", "RTmin", "RTmax")), F.lit(True).alias("known"))
    d = f.join(a, "feature", "full").filter("annotated").join(sources.select("source", F.col("n_scans").cast("long").alias("n_scans")), "source", "left")
    at = lambda px: F.least(F.col("RT") + window / 2, F.greatest(F.col("RT") - window / 2, F.col("RT") - window / 2 + px / F.col("width") * window))
    d = d.withColumns({"lo": at(F.least("x_left", "x_right")), "hi": at(F.greatest("x_left", "x_right")), "width_px": F.abs(F.col("x_right") - F.col("x_left"))})
    p = points.select(F.col("trace").alias("feature"), "i", "x").join(d.select("feature", "lo", "hi"), "feature")
    near = lambda c: F.min_by(F.struct("i", "x"), F.struct(F.abs(F.col("x") - F.col(c)), "i"))
    d = d.join(p.groupBy("feature").agg(near("lo").alias("l"), near("hi").alias("r"), F.count("*").alias("n")), "feature", "left")
    scans, seconds = F.col("r.i") - F.col("l.i") + 1, (F.col("r.x") - F.col("l.x")) * 60
    has = lambda names: F.arrays_overlap("labels", F.array(*map(F.lit, names)))
    boxed = F.col("x_left").isNotNull() & F.col("x_right").isNotNull()
    tiny = (F.col("width_px") <= TINY_PIXELS) | (seconds <= TINY_SECONDS) | (scans < TINY_SCANS)
    unsure = lambda yes, no: F.when(has(UNCERTAIN), yes).otherwise(no)
    status = (
        F.when(F.col("known").isNull(), "skip_stale_annotation_only").when(F.col("n_scans").isNull(), "skip_missing_source").when(F.col("n_scans") == 0, "skip_no_scans").when(F.col("n").isNull(), "skip_empty_trace")
        .when(has(DELETES), "deleted_delete_label").when(~boxed, unsure("uncertain_no_box_keep_original", "fallback_original_no_box")).when(tiny, unsure("uncertain_tiny_box_keep_original", "skip_tiny_box_keep_original"))
        .otherwise(unsure("uncertain_updated_from_box", "updated_from_box"))
    )
    d = d.withColumn("status", status).withColumn("judged", ~F.col("status").startswith("skip_") | F.col("status").startswith("skip_tiny"))
    label = F.when(F.col("judged") & ~has(UNCERTAIN) & (F.col("status") != "deleted_delete_label"), boxed.cast("int"))
    of_box = lambda v: F.when(F.col("status").contains("_box") & boxed & F.col("judged"), v)
    return d.select(
        "feature", "source", "status", label.alias("is_true_peak"), "RT", "RTmin", "RTmax", of_box(F.col("l.i")).cast("int").alias("li"), of_box(F.col("r.i")).cast("int").alias("ri"), of_box(F.col("l.x")).alias("box_RTmin"), of_box(F.col("r.x")).alias("box_RTmax"),
        of_box(F.col("width_px")).alias("box_width_px"), of_box(scans).cast("int").alias("box_scan_count"), of_box(seconds).alias("box_width_sec"),
    )


def _flat(y: np.ndarray, real: np.ndarray, scans: int) -> np.ndarray:
    """Rows smoothed by a plain mean of `scans` places; beyond a trace's ends lie zeros."""
    half = scans // 2
    wide = np.pad(np.where(real, y, 0.0), ((0, 0), (half, half)))
    return np.where(real, sum(wide[:, k : k + y.shape[1]] for k in range(scans)) / scans, 0.0)


def extended(traces: list[tuple[np.ndarray, np.ndarray]], rt: np.ndarray, li: np.ndarray, ri: np.ndarray) -> dict[str, np.ndarray]:
    """New bounds from boxes of scans li to ri, one trace (x, y) each: outward to the lows beside the box, or inward to the
    core about its apex if both lows are quiet and far apart. All traces take each step together."""
    n = np.array([len(x) for x, _ in traces])
    x, y = padded([t[0] for t in traces]), padded([t[1] for t in traces])
    places, row = np.arange(x.shape[1]), np.arange(len(n))
    real = places < n[:, None]
    s = np.maximum(np.nan_to_num(_flat(_flat(y, real, 3), real, 5), nan=0.0, posinf=0.0, neginf=0.0), 0.0)
    apex = np.where((places >= li[:, None]) & (places <= ri[:, None]), s, -1.0).argmax(axis=1)

    def walk(start: np.ndarray, direction: int, **rules):
        at, there = paths(start, direction, n, WALK_SCANS)
        t = x[row[:, None], at]
        return descend(s[row[:, None], at], np.logical_and.accumulate(there & (np.abs(t - t[:, :1]) <= WALK_MINUTES), axis=1), WALK_RISE, WALK_PATIENCE, **rules)

    out_left, out_right = walk(li, -1, from_least=True), walk(ri, 1, rebound=WALK_REBOUND)
    left, low = li - out_left.low, ri + out_right.low
    right = np.where(out_right.rebounded, low, ri + out_right.end)

    seen = np.where(real, s, np.nan)
    base = _medians(seen)
    sigma = 1.4826 * _medians(np.abs(seen - base[:, None]))
    limit = np.maximum(base + SIGMAS * sigma, s[row, apex] * LEAST_SHARE)
    core = [core_ends(real & (s <= limit[:, None]), apex, d, n, CONFIRM, max(20, 4 * WALK_SCANS)) for d in (-1, 1)]
    wide = (s[row, left] <= limit) & (s[row, right] <= limit) & (x[row, right] - x[row, left] > np.maximum(x[row, core[1]] - x[row, core[0]], 1e-12) * OVERSIZE)
    a, b = np.where(wide, core[0], left), np.where(wide, core[1], right)
    a, b = np.minimum(a, b), np.maximum(a, b)
    held = (x[row, li] <= rt) & (rt <= x[row, ri])
    return {
        "new_RT": np.where(held, rt, x[row, apex]), "new_RTmin": x[row, a], "new_RTmax": x[row, b], "box_apex_RT": x[row, apex], "left_expand_scans": li - left, "right_expand_scans": right - ri, "rollback_to_valley": out_right.rebounded,
        "rollback_valley_RT": x[row, low], "bound_mode": np.where(wide, "core_shrink", "box_extend"), "low_threshold": limit, "oversized_shrink": wide,
    }


def update_from_boxes(features: DataFrame, points: DataFrame, annotations: DataFrame, sources: DataFrame, window: float = 2.0) -> DataFrame:
    """box_report with the columns of UPDATE: new bounds of features that their box decides; those that keep theirs have the old ones, all others null."""
    report = box_report(features, points, annotations, sources, window)
    moved = F.col("status").endswith("updated_from_box")
    traces = points.groupBy(F.col("trace").alias("feature")).agg(F.sort_array(F.collect_list(F.struct(F.col("i"), F.col("x").cast("double").alias("x"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y")))).alias("p"))
    rows = report.filter(moved).select("feature", "RT", "li", "ri").join(traces, "feature").select("feature", "RT", "li", "ri", F.col("p.x").alias("x"), F.col("p.y").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in _together(pdf["x"].map(len).to_numpy()) if len(pdf) else ():
                part = pdf.iloc[some]
                found = extended([(np.array(x, float), np.array(y, float)) for x, y in zip(part["x"], part["y"], strict=True)], *(part[c].to_numpy() for c in ("RT", "li", "ri")))
                yield pd.DataFrame(found).assign(feature=part["feature"].to_numpy())

    new = rows.mapInPandas(run, f"feature {dict(features.dtypes)['feature']}, " + UPDATE)
    keeps = F.col("status").contains("keep_original") | (F.col("status") == "fallback_original_no_box")
    old = lambda c: F.coalesce(F.col(f"new_{c}"), F.when(keeps, F.col(c))).alias(f"new_{c}")
    d = report.join(new, "feature", "left")
    return d.select(*report.columns, old("RT"), old("RTmin"), old("RTmax"), *(c.split()[0] for c in UPDATE.split(", ")[3:]))
