"""Matching where order decides: folds over small ordered arrays of one sample; islands of sorted keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import box_pairs, ratio
from .shared import written


def assign_boxes(boxes: DataFrame, least: float = 0.1, exact: float = 0.5) -> DataFrame:
    """Greedy one-to-one pairs of targets and predictions of a sample: exact ones first, then by overlap and distance.

    The pairs of a sample are ordered once and folded with the sets of what is taken, on the JVM.
    """
    order = F.struct((F.col("far") > exact).alias("rough"), (-F.col("iou")).alias("i"), F.col("far").alias("f"), (-F.col("target")).alias("t"), (-F.col("prediction")).alias("p"), F.col("target"), F.col("prediction"), F.col("iou"))
    lists = box_pairs(boxes).filter((F.col("iou") >= least) | (F.col("far") <= exact)).groupBy("sample").agg(F.array_sort(F.collect_list(order)).alias("x"))
    start = F.struct(F.array().cast("array<double>").alias("t"), F.array().cast("array<double>").alias("p"), F.array().cast("array<struct<target:double,prediction:double,iou:double>>").alias("out"))

    def step(s, x):
        free = ~F.array_contains(s["t"], x["target"]) & ~F.array_contains(s["p"], x["prediction"])
        taken = F.struct(F.array_append(s["t"], x["target"]).alias("t"), F.array_append(s["p"], x["prediction"]).alias("p"), F.array_append(s["out"], F.struct(x["target"].alias("target"), x["prediction"].alias("prediction"), x["iou"].alias("iou"))).alias("out"))
        return F.when(free, taken).otherwise(s)

    return lists.select("sample", F.explode(F.aggregate("x", start, step)["out"]).alias("m")).select("sample", "m.target", "m.prediction", "m.iou")


def match_predictions(boxes: DataFrame, least: float = 0.5, score: float = 0.0) -> DataFrame:
    """Each prediction in order of score takes its best free target; under the least overlap it is a false positive, once and for all.

    sample, prediction, score, target and iou (null for false positives).
    """
    return _matched(boxes, [least], score).drop("level")


def _ordered(boxes: DataFrame, least: float, score: float = 0.0) -> DataFrame:
    """sample, x: its predictions in order of score, each with its targets from the greatest overlap down to `least`, or null."""
    pairs = box_pairs(boxes.filter(F.col("target") | (F.col("score") >= score))).filter(F.col("iou") >= least)
    per = pairs.groupBy("sample", "prediction", "score").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("i"), "target"))).alias("targets"))
    alone = boxes.filter(~F.col("target") & (F.col("score") >= score)).select("sample", F.col("ord").alias("prediction"), "score")
    every = alone.join(per.select("sample", "prediction", "targets"), ["sample", "prediction"], "left")
    return every.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "prediction", "targets"))).alias("x"))


def _best(x, taken):
    """The free target of greatest overlap."""
    return F.get(F.filter(F.coalesce(x["targets"], F.array().cast("array<struct<i:double,target:double>>")), lambda y: ~F.array_contains(taken, y["target"])), F.lit(0))


def _matched(boxes: DataFrame, levels: list[float], score: float = 0.0) -> DataFrame:
    """match_predictions at several least overlaps (level); the ordered lists of a sample are made once."""
    start = F.struct(F.array().cast("array<double>").alias("t"), F.array().cast("array<struct<prediction:double,score:double,target:double,iou:double>>").alias("out"))

    def step(s, x):
        best = _best(x, s["t"])
        hit = F.coalesce(-best["i"] >= F.col("level"), F.lit(False))
        row = F.struct(x["prediction"].alias("prediction"), (-x["s"]).alias("score"), F.when(hit, best["target"]).alias("target"), F.when(hit, -best["i"]).alias("iou"))
        return F.struct(F.when(hit, F.array_append(s["t"], best["target"])).otherwise(s["t"]).alias("t"), F.array_append(s["out"], row).alias("out"))

    lists = _ordered(boxes, min(levels), score).select("sample", "x", F.explode(F.array(*(F.lit(float(v)) for v in levels))).alias("level"))
    return lists.select("level", "sample", F.explode(F.aggregate("x", start, step)["out"]).alias("m")).select("level", "sample", "m.prediction", "m.score", "m.target", "m.iou")


def detection(boxes: DataFrame, thresholds: list[float], least: float = 0.5) -> DataFrame:
    """At each score threshold: counts, precision, recall, F1, mean and median overlap of matches, mean absolute errors of
    their left and right edges, width, centre and coordinates, and how well samples' counts are met; 0 where there is nothing.

    Predictions are matched in order of score, so the matches at a threshold are those of the lowest one from it upwards:
    samples are matched once, and thresholds only group the outcome.
    """
    spark, grid = boxes.sparkSession, F.array(*(F.lit(float(t)) for t in thresholds))
    m = _matched(boxes, [least], min(thresholds)).drop("level")
    box = F.min(F.struct("x1", "y1", "x2", "y2"))
    for side, of in (("target", "target"), ("prediction", "not target")):
        m = m.join(boxes.filter(of).groupBy("sample", F.col("ord").alias(side)).agg(box.alias(f"{side}_box")), ["sample", side], "left")
    hit, apart = F.col("target").isNotNull(), lambda c: F.abs(F.col(f"prediction_box.{c}") - F.col(f"target_box.{c}"))
    both = lambda f: F.when(hit, F.abs(f("prediction_box") - f("target_box")))
    m = m.select(
        F.explode(F.filter(grid, lambda t: F.col("score") >= t)).alias("threshold"), "target", "iou", F.when(hit, apart("x1")).alias("left"), F.when(hit, apart("x2")).alias("right"),
        both(lambda b: F.col(f"{b}.x2") - F.col(f"{b}.x1")).alias("width"), both(lambda b: (F.col(f"{b}.x1") + F.col(f"{b}.x2")) / 2).alias("centre"),
        F.when(hit, (apart("x1") + apart("y1") + apart("x2") + apart("y2")) / 4).alias("coordinates"),
    )
    errors = ("left", "right", "width", "centre", "coordinates")
    c = m.groupBy("threshold").agg(F.count("target").alias("tp"), F.count("*").alias("n_predicted"), F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), *(F.avg(e).alias(f"{e}_mae") for e in errors))
    # one row for each sample and threshold: how many boxes it has and how many are predicted
    per = boxes.groupBy("sample").agg(F.count_if("target").alias("n"), F.collect_list(F.when(~F.col("target"), F.col("score"))).alias("scores"))
    off = per.select("n", "scores", F.explode(grid).alias("threshold")).select("threshold", "n", F.abs(F.col("n") - F.size(F.filter("scores", lambda x: x >= F.col("threshold")))).alias("off"))
    n = off.groupBy("threshold").agg(F.sum("n").alias("n_targets"), F.count("*").alias("n_samples"), F.avg((F.col("off") == 0).cast("int")).alias("count_accuracy"), F.avg("off").alias("count_mae"))
    d = spark.range(1).select(F.explode(grid).alias("threshold")).join(n, "threshold", "left").join(c, "threshold", "left").fillna(0)
    return d.select(
        "threshold", "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_targets") - F.col("tp")).alias("fn"), ratio(F.col("tp"), F.col("n_predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("n_targets")).alias("recall"), ratio(2 * F.col("tp"), F.col("n_predicted") + F.col("n_targets")).alias("f1"), "mean_iou", "median_iou", *(f"{e}_mae" for e in errors),
        "count_accuracy", "count_mae", ratio(F.col("n_predicted"), F.col("n_samples")).alias("predictions_per_sample"),
    )


def detection_sweep(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """detection at 0.05, 0.10 ... 0.95, and best: greatest F1, then recall, then precision, then nearness to one half, then the lower."""
    d = detection(boxes, [round(k * 0.05, 2) for k in range(1, 20)], least)
    order = F.struct("f1", "recall", "precision", (-F.abs(F.col("threshold") - 0.5)).alias("near"), (-F.col("threshold")).alias("low"))
    return d.withColumn("best", order == F.max(order).over(Window.partitionBy(F.lit(0))))  # 19 rows


def _hits(boxes: DataFrame, levels: list[float]) -> DataFrame:
    """sample, prediction, score, hits: of each prediction, whether it has a target (1 or 0) at each of the least overlaps."""
    start = F.struct(F.array().cast("array<double>").alias("t"), F.array().cast("array<int>").alias("out"))

    def step(level):
        def run(s, x):
            best = _best(x, s["t"])
            hit = F.coalesce(-best["i"] >= level, F.lit(False))
            return F.struct(F.when(hit, F.array_append(s["t"], best["target"])).otherwise(s["t"]).alias("t"), F.array_append(s["out"], hit.cast("int")).alias("out"))

        return run

    folds = F.when(F.exists("x", lambda x: x["targets"].isNotNull()), F.array(*(F.aggregate("x", start, step(F.lit(float(v))))["out"] for v in levels)))
    d = _ordered(boxes, min(levels)).select("sample", folds.alias("folds"), F.posexplode("x").alias("k", "m"))
    return d.select("sample", "m.prediction", (-F.col("m.s")).alias("score"), F.coalesce(F.transform("folds", lambda f: F.get(f, F.col("k"))), F.array(*(F.lit(0) for _ in levels))).alias("hits"))


def average_precision(boxes: DataFrame, levels: list[float]) -> DataFrame:
    """101-point interpolated average precision at each overlap.

    Predictions are one row for all levels, as their order is the same. They are dealt by ranges of it, and written with their
    range; the sums of whole ranges are one small table, so ranks inside a range are a window of that range alone, however many
    scores are equal. Precision is greatest where a target is hit, so only hits are looked at.
    """
    n = boxes.agg(F.count_if("target").alias("n"))
    order, each = [F.col("score").desc(), F.col("sample"), F.col("prediction")], range(len(levels))
    m = written(_hits(boxes, levels), "hits")  # the ranges are found in a pass of their own
    m = written(m.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    hit = lambda k: F.get("hits", F.lit(k))
    sums = m.groupBy("range").agg(*(F.sum(hit(k)).alias(f"h{k}") for k in each), F.count("*").alias("c"))
    above = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select("range", *(F.coalesce(F.sum(f"h{k}").over(above), F.lit(0)).alias(f"a{k}") for k in each), F.coalesce(F.sum("c").over(above), F.lit(0)).alias("ac"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    p = m.select("range", "hits", F.count("*").over(inside).alias("c"), *(F.sum(hit(k)).over(inside).alias(f"t{k}") for k in each)).join(sums, "range").crossJoin(F.broadcast(n))
    at = F.array(*(F.when(hit(k) == 1, F.struct(F.lit(float(v)).alias("level"), (F.col(f"a{k}") + F.col(f"t{k}")).alias("tp"))) for k, v in enumerate(levels)))
    p = p.select("n", (F.col("ac") + F.col("c")).alias("k"), F.explode(F.array_compact(at)).alias("h")).select("h.level", "h.tp", "k", "n")
    reach = p.select("level", (F.col("tp") / F.col("k")).alias("precision"), F.floor(F.try_divide(F.col("tp") * 100, F.col("n")) + 1e-9).alias("step")).groupBy("level", "step").agg(F.max("precision").alias("p"))
    grid = boxes.sparkSession.range(101).select(F.col("id").alias("recall"), F.explode(F.array(*(F.lit(float(v)) for v in levels))).alias("level"))
    reach = reach.withColumnRenamed("level", "_level")
    at = grid.join(reach, (F.col("level") == F.col("_level")) & (F.col("step") >= F.col("recall")), "left").groupBy("level", "recall").agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("p"))  # 101 by 101 rows a level
    return at.groupBy(F.col("level").alias("iou")).agg(F.avg("p").alias("ap"))


def average_precisions(boxes: DataFrame, more: list[float]) -> DataFrame:
    """average_precision at 0.50, 0.55 ... 0.95 and at `more`; map is the mean over 0.50 to 0.95, on each row."""
    levels = [round(0.5 + 0.05 * k, 2) for k in range(10)]
    d = average_precision(boxes, sorted({*levels, *more}))
    return d.withColumn("map", F.avg(F.when(F.col("iou").isin(levels), F.col("ap"))).over(Window.partitionBy(F.lit(0))))  # a row a level


def islands(rows: DataFrame, tol: float, key: str = "mz") -> DataFrame:
    """Adds island: rows whose sorted keys are never further apart than tol share one. Ranges of the key as it is distributed, and one row each to stitch them."""
    d = written(rows.repartitionByRange(key).withColumn("_b", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_b").orderBy(key)
    d = d.withColumn("_cut", F.coalesce((F.col(key) - F.lag(key).over(inside) > tol).cast("int"), F.lit(0)))
    d = d.withColumn("_n", F.sum("_cut").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    edge = d.groupBy("_b").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.max("_n").alias("n"))
    line = Window.partitionBy(F.lit(0)).orderBy("_b")  # one row for each range
    gap = F.coalesce((F.col("lo") - F.lag("hi").over(line) > tol).cast("int"), F.lit(0))
    first = edge.withColumn("_g", gap).withColumn("_first", F.sum("_g").over(line) + F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(first.select("_b", "_first"), "_b").withColumn("island", F.col("_first") + F.col("_n")).drop("_b", "_cut", "_n", "_first")
