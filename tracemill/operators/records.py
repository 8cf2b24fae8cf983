"""Detector tables, pools, labels and manifest records as projections, and the relation of seeds to annotated peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Column names of one detector's export and what they are called here; fixed values.
MSDIAL = {
    "Precursor m/z": "mz", "RT left(min)": "RTmin", "RT (min)": "RT", "RT right (min)": "RTmax", "Height": "Height", "Area": "Area", "Estimated noise": "Estimated noise", "S/N": "S/N",
    "Sharpness": "Sharpness", "Gaussian similarity": "Gaussian similarity", "Ideal slope": "Ideal slope", "Symmetry": "Symmetry",
}
#: Columns that hold a detector's intensity; fixed values.
INTENSITY = {"asari": "peak_area", "pyopenms": "intensity", "msdial": "Area"}
SAMPLE = ".mzml"
#: Of shoulders: a height ratio that passes, one that passes if the top is not at an edge, fewest points; fixed values.
CLEAR, WEAK, FEWEST = 0.05, 0.02, 3


def samples(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.lower().endswith(SAMPLE)]


def msdial(rows: DataFrame) -> DataFrame:
    """Known columns under their names here, sample columns with 0 for null; all others go. Columns that are missing are an error."""
    missing = [c for c in MSDIAL if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return rows.select(*(F.col(f"`{c}`").alias(n) for c, n in MSDIAL.items()), *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in samples(rows)))


def view(rows: DataFrame, detector: str) -> DataFrame:
    """The table to show: with two samples or more id, m/z, RT and the samples; else id, m/z, RT with its bounds, and the peak area."""
    many, has = samples(rows), set(rows.columns)
    if len(many) >= 2:
        return rows.select(*(c for c in ("Feature_ID", "mz", "RT") if c in has), *(F.col(f"`{c}`") for c in many))
    area = INTENSITY.get(detector.strip().lower())
    if detector.strip().lower() == "xcms" and len(many) == 1:
        area = many[0]
    value = F.col(f"`{area}`").try_cast("double") if area in has else F.lit(None).cast("double")
    return rows.select(*(F.col(c) if c in has else F.lit(None).alias(c) for c in ("Feature_ID", "mz", "RT", "RTmin", "RTmax")), value.alias("PeakArea"))


def xcms_rows(rows: DataFrame, tie: str) -> DataFrame:
    """source_file, Feature_ID, mz, RTmin, RT, RTmax (minutes), maxo, area of single-file tables.

    Numbers that do not parse drop the row. The id is the number of the row's name, or its place in the order of area and
    maxo within the file; of equal ids the first in this order stays.
    """
    number = lambda c: F.col(c).try_cast("double")
    d = rows.select(
        "source_file", tie, F.col("`Row.names`").alias("name"), number("mzmed").alias("mz"), *((number(c) / 60).alias(n) for c, n in (("rtmin", "RTmin"), ("rtmed", "RT"), ("rtmax", "RTmax"))), number("maxo").alias("maxo"), number("into").alias("area")
    ).dropna(subset=["mz", "RT", "RTmin", "RTmax", "maxo", "area"])
    order = [F.desc("area"), F.desc("maxo"), F.asc(tie)]
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("source_file").orderBy(*order)))
    d = d.withColumn("Feature_ID", F.concat(F.replace("source_file", F.lit(".mzML"), F.lit("")), F.lit("__F"), F.coalesce(F.col("name").try_cast("double").cast("bigint"), F.col("place").cast("bigint")).cast("string")))
    first = F.row_number().over(Window.partitionBy("source_file", "Feature_ID").orderBy("place"))
    return d.withColumn("k", first).filter("k = 1").select("source_file", "Feature_ID", "mz", "RTmin", "RT", "RTmax", "maxo", "area")


def valid_pool(pool: DataFrame, scans: DataFrame) -> DataFrame:
    """Pool rows with all of id, source, mz, RT and bounds, whose RT lies strictly inside the scans (source, rt) of their source; a source without scans keeps its rows."""
    d = pool.withColumns({"Feature_ID": F.trim(F.col("Feature_ID").cast("string")), **{c: F.col(c).try_cast("double") for c in ("mz", "RT", "RTmin", "RTmax")}})
    d = d.dropna(subset=["Feature_ID", "source", "mz", "RT", "RTmin", "RTmax"]).filter("Feature_ID <> ''")
    ends = scans.groupBy("source").agg(F.min("rt").alias("_from"), F.max("rt").alias("_to"))
    return d.join(ends, "source", "left").filter(F.col("_from").isNull() | ((F.col("RT") > F.col("_from")) & (F.col("RT") < F.col("_to")))).select(*pool.columns)


def binary_label(labels: Column, known: list[str], positive: list[str], policy: str = "skip") -> Column:
    """1 with a positive label, 0 with known ones only or with none at all; with unknown ones only: null (skip), 0 (false) or an error."""
    unknown = {"skip": F.lit(None).cast("int"), "false": F.lit(0), "error": F.raise_error(F.lit("labels are all unknown")).cast("int")}[policy]
    some = F.filter(labels, lambda x: x.isin(*known))
    return F.when(F.size(labels) == 0, 0).when(F.size(some) == 0, unknown).otherwise(F.exists(some, lambda x: x.isin(*positive)).cast("int"))


def record(rows: DataFrame, shapes: DataFrame, metadata: list[str]) -> DataFrame:
    """Manifest records of rows (sample_id, image_path, seed_label, declared, source_file, study_id) and their annotated shapes
    (sample_id, label, box, place): boxes of true peaks in order, subset tags, metadata; a count that is not the declared one is an error."""
    true = F.lower("label") == "true_peak"
    boxes = shapes.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.when(true, F.struct("place", "box")))), lambda x: x["box"]).alias("boxes"))
    d = rows.join(boxes, "sample_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)))
    n = F.size("boxes")
    checked = F.when(n == F.col("declared"), F.col("boxes")).otherwise(F.raise_error(F.concat_ws(" ", F.col("sample_id").cast("string"), F.lit("has"), n.cast("string"), F.lit("boxes, not"), F.col("declared").cast("string"))).cast(boxes.schema["boxes"].dataType))
    tags = F.array(F.when(F.col("seed_label") == 1, "seed_positive").otherwise("seed_negative"), F.when(n == 0, "detection_empty").when(n == 1, "detection_single").otherwise("detection_multi"))
    return d.select("sample_id", "image_path", checked.alias("boxes"), "seed_label", "source_file", "study_id", F.lit("unknown").alias("instrument_id"), tags.alias("subsets"), F.create_map(*(x for c in metadata for x in (F.lit(c), F.col(c).cast("string")))).alias("metadata"))


def anchor_advice(boxes: DataFrame, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """sizes (quantiles of the root of the area to the nearest 4, 4 at least) and ratios (of height over width, two digits), each once, in order: one row."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    s = boxes.filter((w > 0) & (h > 0)).agg(F.percentile(F.sqrt(w * h), F.array(*map(F.lit, at))).alias("a"), F.percentile(h / w, F.array(*map(F.lit, at))).alias("r"))
    return s.select(F.array_distinct(F.transform("a", lambda v: F.greatest(F.lit(4), (F.bround(v / 4) * 4).cast("int")))).alias("sizes"), F.array_distinct(F.transform("r", lambda v: F.bround(v, 2))).alias("ratios"))


def seed_relation(seeds: DataFrame, peaks: DataFrame, tolerance: float = 0.05, review: float = 2 / 60) -> DataFrame:
    """One row per seed (seed, rt, lo, hi, height, points, at_edge): relation (false, single, shift, shoulder, split), n_matched, n_extra,
    primary (nearest apex), highest, review, and corrected rt, lo, hi with the union of the matched boxes.

    Peaks (seed, peak, apex, left, right, height, shared: has one valley with the next peak of the seed). A peak whose
    apex lies in the seed is core; peaks that overlap and reach out by the tolerance at most join it along a chain of shared
    valleys (islands of a window over the seed's peaks). Without core the nearest overlapping peak at the seed's own place
    counts as shifted, if it is at the seed's height, or as a composite with the seed as its shoulder.
    """
    d = peaks.join(seeds.select("seed", "rt", "lo", "hi", F.col("height").alias("own"), "points", "at_edge"), "seed")
    out = F.greatest(F.col("lo") - F.col("apex"), F.col("apex") - F.col("hi"), F.lit(0.0))
    overlap = (F.col("right") >= F.col("lo")) & (F.col("left") <= F.col("hi"))
    d = d.withColumns({"out": out, "overlap": overlap, "core": overlap & (out == 0), "anchor": (F.col("left") - tolerance <= F.col("rt")) & (F.col("rt") <= F.col("right") + tolerance)})
    by = Window.partitionBy("seed").orderBy("peak")
    d = d.withColumn("open", F.col("overlap") & (F.col("out") <= tolerance + 1e-9 / 60))
    joined = F.lag("shared").over(by) & F.lag("open").over(by) & F.col("open")
    d = d.withColumn("start", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    island, all_ = Window.partitionBy("seed", "island"), Window.partitionBy("seed")
    d = d.withColumns({"split": F.col("open") & F.max("core").over(island), "any_core": F.max("core").over(all_)})
    d = d.withColumn("near", F.row_number().over(all_.orderBy(F.when(F.col("anchor") & F.col("overlap"), 0).otherwise(1), F.abs(F.col("apex") - F.col("rt")), "peak")))
    ratio = F.col("own") / F.when(F.col("height") > 0, F.col("height"))
    shift = (F.col("out") <= tolerance) & (ratio >= 0.5)
    evidence = F.when((F.col("points") < FEWEST) | ratio.isNull() | (ratio < WEAK), "fail").when((ratio >= CLEAR) | ~F.col("at_edge"), "pass").otherwise("uncertain")
    alone = F.when(~F.col("any_core") & (F.col("near") == 1) & F.col("anchor") & F.col("overlap"), F.when(shift, "shift").when(evidence != "fail", F.concat(F.lit("shoulder "), evidence)))
    d = d.withColumn("kind", F.when(F.col("any_core"), F.when(F.col("core") | F.col("split"), "core")).otherwise(alone))
    hit = F.col("kind").isNotNull()
    pick = lambda c: F.when(hit, c)
    s = d.groupBy("seed").agg(
        F.count_if(hit).alias("n_matched"), F.count_if(~hit).alias("n_extra"), F.max("kind").alias("kind"), F.max(pick((F.col("out") > review).cast("int"))).alias("far"),
        F.min_by(F.struct("peak", "apex", "left", "right"), pick(F.struct(F.abs(F.col("apex") - F.col("rt")), "peak"))).alias("primary"), F.max_by("peak", pick(F.struct("height", -F.col("peak")))).alias("highest"),
        F.min(pick(F.col("left"))).alias("union_lo"), F.max(pick(F.col("right"))).alias("union_hi"),
    )
    j = seeds.select("seed", "rt", "lo", "hi").join(s, "seed", "left")
    shoulder = F.col("kind").startswith("shoulder")
    relation = F.when(F.coalesce(F.col("n_matched"), F.lit(0)) == 0, "false").when(shoulder, "shoulder").when(F.col("kind") == "shift", "shift").when(F.col("n_matched") == 1, "single").otherwise("split")
    bound = lambda own, other: F.when(F.col("n_matched") > 0, F.when(shoulder, F.col(own)).otherwise(F.col(f"primary.{other}")))
    return j.select(
        "seed", relation.alias("relation"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"), F.coalesce("n_extra", F.lit(0)).alias("n_extra"), F.col("primary.peak").alias("primary"), "highest",
        F.coalesce((F.col("kind") == "shoulder uncertain") | ((F.col("kind") == "core") & (F.col("far") == 1)), F.lit(False)).alias("review"),
        bound("rt", "apex").alias("seed_rt"), bound("lo", "left").alias("seed_lo"), bound("hi", "right").alias("seed_hi"), "union_lo", "union_hi",
    )


def relation_checks(relations: DataFrame, furthest: float) -> DataFrame:
    """name, value (rows that break it) and status of the contract checks on the rows of seed_relation."""
    matched, own = F.col("n_matched") > 0, F.col("relation").isin("false", "shoulder")
    faults = {
        "bound_order": ~((F.col("seed_lo") < F.col("seed_rt")) & (F.col("seed_rt") < F.col("seed_hi"))),
        "bound_move": ~own & ((F.col("seed_rt") - F.col("seed_lo") > furthest) | (F.col("seed_hi") - F.col("seed_rt") > furthest)),
        "label_is_match": (F.col("relation") == "false") == matched, "highest_of_matched": F.col("highest").isNull() == matched,
        "union_holds_seed": ~own & ((F.col("union_lo") > F.col("seed_lo")) | (F.col("union_hi") < F.col("seed_hi"))),
    }
    one = relations.agg(*(F.count_if(v).alias(c) for c, v in faults.items()))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in faults))).alias("x")).select("x.*")
    return rows.withColumn("status", F.when(F.col("value") == 0, "pass").otherwise("fail"))


def standardisation_checks(relations: DataFrame, links: DataFrame, drawn: DataFrame, final: DataFrame, seed_boxes: DataFrame, seconds: float, furthest: float) -> DataFrame:
    """relation_checks, and those on boxes: links (seed, peak) as many as a seed has matches; no drawn box (trace, box, lo, hi, center)
    without a final one (trace, box, lo, hi, apex_rt, left_reason, right_reason), nor the other way; ids of seeds and boxes once;
    edges that are not pinned moved by `seconds` at most from where they were drawn inside the plot; apex between the bounds;
    seed boxes (seed, xmin, ymin, xmax, ymax, width, height) of some size and inside their image."""
    key = ["trace", "box"]
    counted = relations.select("seed", "n_matched").join(links.groupBy("seed").agg(F.count("*").alias("linked")), "seed", "left")
    d = drawn.select(*key, *(F.least(F.col("center") + 1.0, F.greatest(F.col("center") - 1.0, F.col(c))).alias(f"old_{c}") for c in ("lo", "hi")), F.lit(1).alias("was")).join(final.withColumn("is", F.lit(1)), key, "full")
    limit = seconds + 1e-6
    far = lambda side, c: (F.col(f"{side}_reason") != "pinned") & (F.abs(F.col(c) - F.col(f"old_{c}")) * 60 > limit)
    box = seed_boxes.agg(F.count_if(~F.coalesce((F.col("xmin") >= 0) & (F.col("ymin") >= 0) & (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin")) & (F.col("xmax") <= F.col("width")) & (F.col("ymax") <= F.col("height")), F.lit(False))).alias("seed_box_in_image"))
    twice = lambda t, by, name: t.groupBy(*by).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias(name))
    ones = [
        counted.agg(F.count_if(~F.col("n_matched").eqNullSafe(F.coalesce("linked", F.lit(0)))).alias("linked_peaks")),
        d.agg(F.count_if(F.col("is").isNull()).alias("boxes_lost"), F.count_if(F.col("was").isNull()).alias("boxes_made"), F.count_if(F.coalesce(far("left", "lo") | far("right", "hi"), F.lit(False))).alias("moves_in_limit"),
              F.count_if(~F.coalesce((F.col("lo") < F.col("apex_rt")) & (F.col("apex_rt") < F.col("hi")), F.lit(False)) & F.col("is").isNotNull()).alias("apex_between_bounds")),
        twice(relations, ["seed"], "unique_seeds"), twice(final, key, "unique_boxes"), box,
    ]
    out = relation_checks(relations, furthest)
    for one in ones:
        rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns))).alias("x")).select("x.*")
        out = out.unionByName(rows.withColumn("status", F.when(F.col("value") == 0, "pass").otherwise("fail")))
    return out


def logistic_baseline(rows: DataFrame, label: str, columns: list[str], split: str = "split", key: str = "seed", permute: bool = False) -> DataFrame:
    """key, label, split, score of every row, from a logistic regression on columns with train medians for nulls and train scales.

    `permute` deals the train labels anew by a hash of the key: a control that should find nothing.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = rows.select(key, split, F.col(label).cast("double").alias("label"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)))
    train = d.filter(F.col(split) == "train")
    if permute:
        share = train.agg(F.avg("label").alias("share"))  # one row
        train = train.crossJoin(F.broadcast(share)).withColumn("label", (F.pmod(F.xxhash64(key), F.lit(10_007)) < F.col("share") * 10_007).cast("double"))
    names = [f"x{k}" for k in range(len(columns))]
    steps = [
        Imputer(strategy="median", inputCols=names, outputCols=[f"f{n}" for n in names], relativeError=0.0001), VectorAssembler(inputCols=[f"f{n}" for n in names], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=100, regParam=1e-3),
    ]
    return Pipeline(stages=steps).fit(train).transform(d).select(key, "label", split, vector_to_array("probability")[1].alias("score"))
