"""Registered queries of normalisation, ordered matching, grouped splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, matching, metrics, normalize, splits
from ..sources import proxies as P
from .queries import DIGITS, query, r  # noqa: F401

_PART = "SELECT p_partkey AS feature, p_retailprice AS mz, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 30.0 END AS RT, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 30.0 - p_partkey % 4 END AS RTmin, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size * 30.0 + 2 - p_partkey % 4 END AS RTmax FROM part"


def _parts(spark, sf):
    size, key = F.col("p_size") * 30.0, F.col("p_partkey") % 4
    return P.table(spark, sf, "part").select(
        F.col("p_partkey").alias("feature"), F.col("p_retailprice").alias("mz"), F.when(F.col("p_size") % 5 != 0, size).alias("RT"), F.when(F.col("p_size") % 3 != 0, size - key).alias("RTmin"), F.when(F.col("p_size") % 4 != 0, size + 2 - key).alias("RTmax")
    )


@query("P1_unify_columns", "SELECT o_orderkey AS feature, o_totalprice AS mz, CAST(o_custkey AS DOUBLE) AS RT FROM orders")
def p1(spark, sf):
    o = P.table(spark, sf, "orders")
    return normalize.unify_columns(o.select(F.col("o_orderkey").alias("feature"), F.col("o_totalprice").alias("mzmed"), F.col("o_custkey").cast("double").alias("rtime"), F.lit(0.0).alias("rt_apex")))


@query("P2_minutes", f"WITH p AS ({_PART}), t AS (SELECT max(greatest(RT, RTmin, RTmax)) > 200 AS s FROM p) SELECT feature, {r('mz')} AS mz, " + ", ".join(f"{r(f'round_even(CASE WHEN s THEN {c} / 60 ELSE {c} END, 3)')} AS {c}" for c in ("RT", "RTmin", "RTmax")) + " FROM p, t")
def p2(spark, sf):
    return normalize.minutes(_parts(spark, sf), ["RT", "RTmin", "RTmax"])


@query("P5_valid_bounds", f"WITH p AS ({_PART}), a AS (SELECT feature, mz, coalesce(RT, (RTmin + RTmax) / 2) AS RT, RTmin, RTmax FROM p), b AS (SELECT feature, mz, RT, coalesce(RTmin, RT - 0.1) AS RTmin, coalesce(RTmax, RT + 0.1) AS RTmax FROM a) SELECT feature, {r('mz')} AS mz, {r('RT')} AS RT, {r('RTmin')} AS RTmin, {r('RTmax')} AS RTmax FROM b WHERE mz IS NOT NULL AND RT IS NOT NULL AND RTmin <= RTmax")
def p5(spark, sf):
    return normalize.valid_bounds(_parts(spark, sf))


@query("P5_mask_huge", f"SELECT feature, {r('CASE WHEN mz <= 950 THEN mz END')} AS mz FROM ({_PART})")
def p5b(spark, sf):
    return normalize.mask_huge(_parts(spark, sf).select("feature", "mz"), ["mz"], 950)


@query("P6_feature_key", "SELECT name, coalesce(TRY_CAST(nullif(regexp_extract(name, '^[Ff][Tt]?([0-9]+)$', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(name, '^([0-9]+)$', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(name, '([0-9]+)$', 1), '') AS BIGINT)) AS key FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'F' || p_partkey WHEN 1 THEN 'FT' || p_partkey WHEN 2 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS name FROM part)")
def p6(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("F"), k)).when(k % 4 == 1, F.concat(F.lit("FT"), k)).when(k % 4 == 2, k.cast("string")).otherwise(F.col("p_name"))
    return P.table(spark, sf, "part").select(name.alias("name")).select("name", normalize.feature_key("name").alias("key"))


@query("P7_peak_intensity", f"SELECT feature, {r('mz')} AS mz, {r('RT')} AS RT, {r('RTmin')} AS RTmin, {r('RTmax')} AS RTmax, {r('coalesce(RTmin, 0) + coalesce(RTmax, 0)')} AS intensity FROM ({_PART}) WHERE mz IS NOT NULL AND RT IS NOT NULL")
def p7(spark, sf):
    return normalize.peak_intensity(_parts(spark, sf), ("maxo", "into"), ["RTmin", "RTmax"])


@query("P3_samples_to_zero", f"SELECT feature, {r('mz')} AS mz, {r('RT')} AS RT, {r('coalesce(RTmin, 0)')} AS RTmin, {r('coalesce(RTmax, 0)')} AS RTmax FROM ({_PART})")
def p3(spark, sf):
    return normalize.samples_to_zero(_parts(spark, sf), ["RTmin", "RTmax"])


@query("P12_label_value", "SELECT event_id, CASE WHEN lower(trim(w)) IN ('1', 'true', 'yes', 'y', 't', 'tp', 'positive', '是') THEN 1 WHEN lower(trim(w)) IN ('0', 'false', 'no', 'n', 'f', 'fp', 'negative', '否') THEN 0 END AS label FROM (SELECT event_id, CASE event_type WHEN 'click' THEN ' TRUE ' WHEN 'error' THEN 'fp' WHEN 'view' THEN '是' ELSE event_type END AS w FROM events)")
def p12(spark, sf):
    w = F.when(F.col("event_type") == "click", " TRUE ").when(F.col("event_type") == "error", "fp").when(F.col("event_type") == "view", "是").otherwise(F.col("event_type"))
    return P.table(spark, sf, "events").select("event_id", w.alias("w")).select("event_id", normalize.label_value("w").alias("label"))


_ROLES = "SELECT conv_id, list(CASE role WHEN 'user' THEN 'Peak' ELSE role END ORDER BY turn, role) AS labels FROM conversations GROUP BY conv_id"


@query("P13_mapped_labels", f"SELECT conv_id, array_to_string(labels, ',') AS labels FROM ({_ROLES})")
def p13(spark, sf):
    c = P.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return c.select("conv_id", F.transform("x", lambda s: s["role"]).alias("roles")).select("conv_id", F.array_join(normalize.mapped_labels("roles", {"user": "Peak"}), ",").alias("labels"))


@query("P15_annotation_state", "SELECT conv_id, CASE WHEN list_contains(l, 'user') AND list_contains(l, 'system') THEN 'conflict' WHEN list_contains(l, 'user') THEN 'true' WHEN list_contains(l, 'system') THEN 'false' ELSE 'unresolved' END AS state FROM (SELECT conv_id, list(role) AS l FROM conversations GROUP BY conv_id)")
def p15(spark, sf):
    c = P.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return c.select("conv_id", normalize.annotation_state("roles", "user", "system").alias("state"))


@query("G7_label_counts", "SELECT role, count(*) AS n_shapes, count(DISTINCT conv_id) AS n_documents FROM conversations GROUP BY role")
def g7(spark, sf):
    return P.table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n_shapes"), F.count_distinct("conv_id").alias("n_documents"))


@query("P16_rectangles", f"SELECT sample, {r('ord')} AS ord, CASE WHEN x2 > 20 AND x1 >= 3 THEN [{r('least(x1, 20)')}, 0.0, {r('x2')}, {r('y2')}] END AS box FROM ({P.BOXES})")
def p16(spark, sf):
    good = (F.col("x1") >= 3) & (F.col("x2") > 20)  # of the others, a corner is negative or both lie on one line
    points = F.array(F.array(F.col("x2"), F.lit(0.0)), F.array(F.when(good, F.least("x1", F.lit(20.0))).when(F.col("x1") < 3, F.lit(-1.0)).otherwise(F.col("x2")), F.col("y2")))
    return P.boxes(spark, sf).withColumn("points", points).select("sample", "ord", normalize.rectangle("points").alias("raw")).select("sample", "ord", F.transform("raw", lambda v: F.round(v, 6) + 0.0).alias("box"))


@query("P19_pixel_to_rt", f"SELECT sample, {r('ord')} AS ord, {r('greatest(x1 - 1, least(x1 + 1, x1 - 1 + x2 / 40 * 2))')} AS t FROM ({P.BOXES})")
def p19(spark, sf):
    return P.boxes(spark, sf).select("sample", "ord", normalize.pixel_to_rt("x2", "x1", 40).alias("t"))


@query("P21_tiny_boxes", f"SELECT sample, {r('ord')} AS ord, (x2 - x1 <= 7 OR y2 <= 12 OR x1 < 2) AS tiny FROM ({P.BOXES})")
def p21(spark, sf):
    return P.boxes(spark, sf).select("sample", "ord", normalize.tiny(F.col("x2") - F.col("x1"), F.col("y2"), F.col("x1"), 7, 12, 2).alias("tiny"))


@query("P27_scaled_boxes", f"SELECT sample, {r('ord')} AS ord, [{r('x1 * 0.5')}, 0.0, {r('x2 * 0.5')}, {r('y2 * 2.0')}] AS box FROM ({P.BOXES})")
def p27(spark, sf):
    b = P.boxes(spark, sf).withColumn("b", F.array("x1", "y1", "x2", "y2"))
    return b.select("sample", "ord", normalize.scaled_box("b", 0.5, 2.0).alias("raw")).select("sample", "ord", F.transform("raw", lambda v: F.round(v, 6) + 0.0).alias("box"))


@query("P20_portable_paths", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/' || p_partkey || '.png' WHEN 1 THEN NULL WHEN 2 THEN 'rel/' || p_partkey || '.png' END AS path FROM part")
def p20(spark, sf):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("/mnt/Images/old/IMAGES/a/"), k, F.lit(".png"))).when(k % 4 == 1, F.concat(F.lit("C:\\x\\"), k, F.lit(".png"))).when(k % 4 == 2, F.concat(F.lit("rel\\"), k, F.lit(".png"))).otherwise(F.lit("images/../x"))
    return P.table(spark, sf, "part").select("p_partkey", path.alias("p")).select("p_partkey", normalize.portable("p", "images").alias("path"))


@query("P26_all_missing", "SELECT p_partkey FROM part WHERE p_size % 5 = 0 AND p_size % 3 = 0")
def p26(spark, sf):
    d = P.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, 1).alias("a"), F.when(F.col("p_size") % 3 != 0, 1).alias("b"))
    return normalize.all_missing(d, ["a", "b"])[1].select("p_partkey")


@query("J14_assign_boxes")
def j14(spark, sf):
    return matching.assign_boxes(P.boxes(spark, sf))


@query("J15_match_predictions")
def j15(spark, sf):
    return matching.match_predictions(P.boxes(spark, sf), 0.3)


@query("E6_detection")
def e6(spark, sf):
    return matching.detection(P.boxes(spark, sf), [0.5], 0.5)


@query("E7_detection_sweep")
def e7(spark, sf):
    return matching.detection_sweep(P.boxes(spark, sf), 0.5)


@query("E8_average_precision")
def e8(spark, sf):
    return matching.average_precisions(P.boxes(spark, sf), [0.3])


def _detectors(spark, sf):
    return P.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("algo"), F.col("o_orderkey").alias("feature"), (F.col("o_totalprice") / 1000).alias("mz"), (F.unix_timestamp("o_orderdate") / 60.0).alias("rt"), F.col("o_totalprice").alias("intensity"))


@query("J10_align_islands", "WITH d AS (SELECT o_totalprice / 1000 AS mz FROM orders), g AS (SELECT mz, mz - lag(mz) OVER (ORDER BY mz) > 0.005 AS cut FROM d), c AS (SELECT mz, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (ORDER BY mz) AS island FROM g) SELECT count(*) AS n, round(min(mz), 6) + 0.0 AS lo, round(max(mz), 6) + 0.0 AS hi FROM c GROUP BY island")
def j10a(spark, sf):
    d = matching.islands(_detectors(spark, sf), 0.005)
    return d.groupBy("island").agg(F.count("*").alias("n"), F.min("mz").alias("lo"), F.max("mz").alias("hi")).drop("island")


@query("J10_align")
def j10(spark, sf):
    return alignment.align(_detectors(spark, sf), 0.005, 500000.0).withColumn("intensity", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("intensity")))))


@query("J18_missed_by")
def j18(spark, sf):
    return alignment.missed_by(alignment.align(_detectors(spark, sf), 0.005, 500000.0), "1-URGENT").select("aligned", "n", "mz", "rt")


@query("X1_grouped_split")
def x1(spark, sf):
    return splits.grouped_split(P.seeds(spark, sf), "source", {"train": 0.6, "val": 0.2, "test": 0.2})


@query("X2_stratified_group_split")
def x2(spark, sf):
    return splits.stratified_group_split(P.seeds(spark, sf), "label", "size", {"train": 0.8, "val": 0.1, "test": 0.1}, forbid=F.col("flag") == 1)


@query("X2_split_sizes", f"WITH s AS ({P.SEEDS}), n AS (SELECT count(*) AS n FROM s), k(split, share, place) AS (VALUES ('train', 0.8, 3), ('val', 0.1, 4), ('test', 0.1, 2)), f AS (SELECT split, place, floor(n * share) AS whole, n * share - floor(n * share) AS part, n FROM k, n), r AS (SELECT *, row_number() OVER (ORDER BY part DESC, split) AS o, n - sum(whole) OVER () AS lack FROM f) SELECT split, CAST(whole + CASE WHEN o <= lack THEN 1 ELSE 0 END AS BIGINT) AS n_rows, 0 AS barred, 0 AS split_groups FROM r")
def x2_sizes(spark, sf):
    d = x2(spark, sf)
    torn = d.groupBy("size").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("split_groups"))  # one row
    barred = d.groupBy("size", "split").agg(F.coalesce(F.max("flag"), F.lit(0)).alias("flag"), F.count("*").alias("n"))
    return barred.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count_if((F.col("flag") == 1) & (F.col("split") == "test")).alias("barred")).crossJoin(F.broadcast(torn))


def _folds(spark, sf):
    s = P.seeds(spark, sf)
    return splits.inner_folds(s.withColumn("grp", F.concat_ws("-", "domain", (F.col("size") % 97).cast("string"))), "domain", "grp", ["domain", "label"], "seed")


@query("X3_inner_folds")
def x3_inner(spark, sf):
    return _folds(spark, sf).select("seed", "domain", "grp", "label", "fold", "part", "inner_fold")


@query("X3_fold_check", f"WITH s AS ({P.SEEDS}) SELECT fold, count(*) FILTER (domain <> fold) AS development, count(*) FILTER (domain = fold) AS heldout, 0 AS leaking_groups, 0 AS leaking_keys FROM s CROSS JOIN (SELECT DISTINCT domain AS fold FROM s) GROUP BY fold")
def x3_check(spark, sf):
    return splits.fold_summary(_folds(spark, sf), "grp", "seed").select("fold", (F.col("train") + F.col("val")).alias("development"), "heldout", "leaking_groups", "leaking_keys")


@query("X5_held_out_sources", f"""WITH s AS ({P.SEEDS}), d AS (SELECT DISTINCT source FROM s), n AS (SELECT count(*) AS n FROM d), t AS (SELECT n, least(greatest(CAST(round_even(n * 0.25, 0) AS BIGINT), 1, 2), n - 2) AS test FROM n), v AS (SELECT n, test, least(greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)), greatest(1, n - test - 1)) AS val FROM t),
k AS (SELECT source, row_number() OVER (ORDER BY NOT (source = 'src3' OR contains(lower(source), 'rc17')), md5('0:' || source), source) AS k FROM d) SELECT seed, source, CASE WHEN k <= test THEN 'test' WHEN k <= test + val THEN 'val' ELSE 'train' END AS split FROM s JOIN k USING (source), v""")
def x5(spark, sf):
    return splits.held_out_sources(P.seeds(spark, sf).select("seed", "source"), "source", ["src3"], 0.25, 0.2, keyword="RC17").select("seed", "source", "split")


@query("T3_quota_sample", """WITH n AS (SELECT user_id AS part, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS s FROM n), q AS (SELECT part, n, s, CASE WHEN s <= 700 THEN n ELSE least(n, greatest(CAST(round_even(n * 700.0::DOUBLE / s, 0) AS BIGINT), 4)) END AS q FROM n, t), o AS (SELECT CASE WHEN any_value(s) <= 700 THEN 0 ELSE sum(q) - 700 END AS off FROM q),
u AS (SELECT part, unnest(range(1, CAST(CASE WHEN off > 0 THEN q - least(n, 4) ELSE n - q END AS BIGINT) + 1)) AS i, CASE WHEN off > 0 THEN q ELSE n - q END AS size FROM q, o), c AS (SELECT part, count(*) AS c FROM (SELECT part, row_number() OVER (ORDER BY i, size DESC, part) AS k FROM u), o WHERE k <= abs(off) GROUP BY part),
z AS (SELECT part, q - sign(off) * coalesce(c, 0) AS quota FROM q LEFT JOIN c USING (part), o), r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('9:' || CAST(event_id AS VARCHAR)), event_id) AS rank FROM events), w AS (SELECT event_id, user_id, rank FROM r JOIN z ON part = user_id WHERE rank <= quota)
SELECT event_id, user_id, rank FROM (SELECT *, row_number() OVER (ORDER BY md5('9:' || CAST(event_id AS VARCHAR)), event_id) AS place FROM w) WHERE place <= greatest(700, (SELECT CASE WHEN s <= 700 THEN s ELSE 0 END FROM t))""")
def t3(spark, sf):
    return splits.quota_sample(P.table(spark, sf, "events"), "user_id", "event_id", 700, 4, 9).select("event_id", "user_id", "rank")


@query("T5_fixed_strata", "SELECT p_partkey, stratum, rank FROM (SELECT p_partkey, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('2:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS rank FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_retailprice > 905 THEN 'dear' END AS stratum FROM part) WHERE stratum IS NOT NULL) WHERE rank <= CASE stratum WHEN 'large' THEN 10 ELSE 7 END")
def t5(spark, sf):
    return splits.fixed_strata(P.table(spark, sf, "part"), [("large", "p_size > 40", 10), ("dear", "p_retailprice > 905", 7)], "p_partkey", 2).select("p_partkey", "stratum", "rank")


@query("T7_first_rows", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_orderdate, o_orderkey LIMIT 25")
def t7(spark, sf):
    return P.table(spark, sf, "orders").dropna(subset=["o_totalprice"]).orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


@query("U1_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u1(spark, sf):
    c = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("E10_bootstrap")
def e10(spark, sf):
    s = P.scored(spark, sf).withColumn("other", F.lit(0.85))
    return splits.bootstrap_difference(s, "score", "other")


@query("E16_ablation", f"WITH s AS ({P.SCORED}), m AS (SELECT 'size' AS model, label, score FROM s UNION ALL SELECT 'constant', label, 0.85 FROM s UNION ALL SELECT 'flag', label, CAST(coalesce(flag, 0) AS DOUBLE) FROM s), b AS (SELECT model, avg((score - label) ** 2) AS brier FROM m GROUP BY model) SELECT model, {r('brier')} AS brier, rank() OVER (ORDER BY round(brier, 9)) AS place FROM b")
def e16(spark, sf):
    from pyspark.sql import Window

    s = P.scored(spark, sf)
    runs = s.select(F.lit("size").alias("model"), "label", "score").unionByName(s.select(F.lit("constant").alias("model"), "label", F.lit(0.85).alias("score"))).unionByName(s.select(F.lit("flag").alias("model"), "label", F.coalesce("flag", F.lit(0)).cast("double").alias("score")))
    return metrics.losses(runs, ["model"]).select("model", "brier", F.rank().over(Window.orderBy(F.round("brier", 9))).alias("place"))  # one row for each model
