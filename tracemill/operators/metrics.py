"""Evaluation of scores and boxes: counts and prefix sums, never one global window over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn and the rates of score >= threshold against label; 0 where a rate has no rows."""
    hit = F.col("score") >= threshold
    c = rows.groupBy(*(by or [])).agg(
        F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"),
        F.count_if(~hit & (F.col("label") == 0)).alias("tn"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.select(
        *c.columns, precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((recall + specificity) / 2).alias("balanced_accuracy"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
    )


def ranked_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of positives and negatives at each distinct score and at all higher ones.

    Tied scores are one point. Points are dealt by ranges of the score as it is distributed, and written with their range;
    the sums of whole ranges are one small table, so the running sums inside a range are a window of that range alone.
    """
    by = by or []
    points = rows.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    points = written(points.repartitionByRange(*by, F.col("score").desc()).withColumn("range", F.spark_partition_id()), "points")
    sums = points.groupBy(*by, "range").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    total = Window.partitionBy(*(by or [F.lit(0)]))
    sums = sums.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("range").alias("_range"), F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.sum("bp").over(total).alias("n_pos"), F.sum("bn").over(total).alias("n_neg"))
    inside = Window.partitionBy(*by, "range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("range") == F.col("_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return points.join(sums, same).select(*by, "score", "pos", "neg", (F.col("ap") + F.sum("pos").over(inside)).alias("tp"), (F.col("an") + F.sum("neg").over(inside)).alias("fp"), "n_pos", "n_neg")


def ranking(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """auroc (trapezoids) and average precision (steps), tied scores together; null where one class is missing."""
    c = ranked_counts(rows, by)
    tp, fp, pos, neg = (F.col(x) for x in ("tp", "fp", "pos", "neg"))
    area = F.sum(neg * (tp - pos / 2.0)) / (F.max("n_pos") * F.max("n_neg"))
    ap = F.sum(pos * tp / (tp + fp)) / F.max("n_pos")
    both = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
    return c.groupBy(*(by or [])).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.when(both, area).alias("auroc"), F.when(both, ap).alias("average_precision"))


def threshold_sweep(rows: DataFrame, steps: int = 1000) -> DataFrame:
    """Confusion at thresholds 0, 1/steps ... 1, from one histogram of how many thresholds a score reaches."""
    reach = F.floor(F.col("score") * steps)
    reach = F.when((reach + 1) / F.lit(float(steps)) <= F.col("score"), reach + 1).when(reach / F.lit(float(steps)) > F.col("score"), reach - 1).otherwise(reach)
    h = rows.groupBy(reach.alias("k")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    grid = rows.sparkSession.range(steps + 1).withColumnRenamed("id", "k")
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)  # steps + 1 rows
    all_ = Window.partitionBy(F.lit(0))
    d = grid.join(h, "k", "left").select("k", F.sum(F.coalesce("pos", F.lit(0))).over(w).alias("tp"), F.sum(F.coalesce("neg", F.lit(0))).over(w).alias("fp"), F.sum(F.coalesce("pos", F.lit(0))).over(all_).alias("p"), F.sum(F.coalesce("neg", F.lit(0))).over(all_).alias("n"))
    tp, fp, p, n = (F.col(x) for x in ("tp", "fp", "p", "n"))
    return d.select((F.col("k") / F.lit(float(steps))).alias("threshold"), "tp", "fp", (n - fp).alias("tn"), (p - tp).alias("fn"), ((ratio(tp, p) + ratio(n - fp, n)) / 2).alias("balanced_accuracy"), ratio(2 * tp, p + tp + fp).alias("f1"))


def best_threshold(rows: DataFrame, steps: int = 1000) -> DataFrame:
    """The threshold of greatest balanced accuracy, then F1, then nearness to one half; the lower of equals."""
    order = F.struct(F.round("balanced_accuracy", 12), F.round("f1", 12), F.round(-F.abs(F.col("threshold") - 0.5), 12), -F.col("threshold"))
    s = threshold_sweep(rows, steps)
    return s.agg(F.max_by(F.struct(*s.columns), order).alias("x")).select("x.*")


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean score, share of positives and gap in equal bins of the score; the last bin is closed; empty bins stay."""
    c = rows.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("positive"))
    grid = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(c, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "positive", F.abs(F.col("mean_score") - F.col("positive")).alias("gap"))


def losses(rows: DataFrame, by: list[str] | None = None, clamp: float = 1e-7) -> DataFrame:
    """Log loss with clamped scores, and Brier score."""
    p = F.greatest(F.lit(clamp), F.least(F.lit(1 - clamp), F.col("score")))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(-F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"), F.avg((F.col("score") - F.col("label")) ** 2).alias("brier"))


def focal_loss(rows: DataFrame, alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """Mean and sum of the focal loss of probabilities."""
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("score")))
    pt = F.when(F.col("label") == 1, p).otherwise(1 - p)
    loss = F.when(F.col("label") == 1, F.lit(alpha)).otherwise(1 - alpha) * (1 - pt) ** gamma * -F.ln(pt)
    return rows.agg(F.avg(loss).alias("mean_loss"), F.sum(loss).alias("sum_loss"))


def errors(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that the threshold gets wrong, as FP or FN."""
    hit = F.col("score") >= threshold
    return rows.withColumn("error", F.when(hit & (F.col("label") == 0), "FP").when(~hit & (F.col("label") == 1), "FN")).filter("error is not null")


def multiclass(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy and macro F1 over the classes of either column."""
    c = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    per = (
        c.select(F.col("t").alias("class"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).alias("guessed"))
        .unionByName(c.select(F.col("g").alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("n").alias("guessed")))
        .groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("s"), F.sum("guessed").alias("g"))
    )
    return per.agg(ratio(F.sum("tp"), F.sum("s")).alias("accuracy"), F.avg(ratio(2 * F.col("tp"), F.col("s") + F.col("g"))).alias("macro_f1"), F.count("*").alias("n_classes"))


def iou(a: str = "a", b: str = "b") -> Column:
    """Overlap of two boxes with fields x1, y1, x2, y2 over their union; 0 if that is empty."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    area = lambda x: (F.col(f"{x}.x2") - F.col(f"{x}.x1")) * (F.col(f"{x}.y2") - F.col(f"{x}.y1"))
    both = side("x1", "x2") * side("y1", "y2")
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def box_pairs(boxes: DataFrame) -> DataFrame:
    """iou and greatest coordinate difference of each target and prediction of a sample."""
    box = F.struct("x1", "y1", "x2", "y2", "ord")
    t, p = boxes.filter("target").select("sample", box.alias("a")), boxes.filter("not target").select("sample", box.alias("b"), "score")
    far = F.greatest(*(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in ("x1", "y1", "x2", "y2")))
    return t.join(p, "sample").select("sample", F.col("a.ord").alias("target"), F.col("b.ord").alias("prediction"), "score", iou().alias("iou"), far.alias("far"))


def best_targets(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """For each prediction the target of greatest overlap, if that reaches `least`; of equals the lesser target."""
    x = box_pairs(boxes).groupBy("sample", "prediction").agg(F.max_by(F.struct("target", "iou"), F.struct("iou", -F.col("target"))).alias("x"))
    return x.select("sample", "prediction", "x.target", "x.iou").filter(F.col("iou") >= least)


def kept_by_threshold(boxes: DataFrame, thresholds: list[float]) -> DataFrame:
    """Predicted boxes and samples with any, at each threshold."""
    d = boxes.filter("not target").withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("score"))))
    return d.groupBy("threshold").agg(F.count("*").alias("n_boxes"), F.count_distinct("sample").alias("n_samples"))


def ablation(runs: DataFrame, thresholds: DataFrame, by: str = "model") -> DataFrame:
    """Of each model of runs (model, label, score) at its threshold (model, threshold): auroc, average precision, losses, confusion and its
    rates, and place by auroc, of equal ones by average precision, then name. A model without threshold is an error of the join's caller: it has no row."""
    at = runs.join(thresholds, by).withColumn("score", (F.col("score") >= F.col("threshold")).cast("double"))
    d = ranking(runs, [by]).join(losses(runs, [by]).drop("n"), by).join(confusion(at, [by]), by).join(thresholds, by)
    place = F.row_number().over(Window.orderBy(F.round("auroc", 9).desc_nulls_last(), F.round("average_precision", 9).desc_nulls_last(), by))  # a row for each model
    return d.withColumn("place", place.cast("int"))
