"""Registered queries of peaks, contract checks and joins with checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, peaks, range_join, splits, tables
from ..operators.shared import written
from ..sources import proxies as P
from .queries import _APEX, _M, _NEAR, _SPLIT, _T, _accounts, _split, query, r

_MAX = "x AS (SELECT *, lag(y) OVER o AS p, lead(y) OVER o AS q FROM t WINDOW o AS (PARTITION BY trace ORDER BY i)), k AS (SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY i) AS peak, i, y FROM x WHERE y > 50 AND y > p AND y >= q)"


_PROMINENCE = """mm AS (SELECT m.trace, i, m, n, apex, lag(m) OVER (PARTITION BY m.trace ORDER BY i) AS p FROM m JOIN a USING (trace)),
rise AS (SELECT x.trace, x.i, x.m, x.apex, coalesce(min(z.i), any_value(x.n)) AS stop FROM mm x LEFT JOIN mm z ON z.trace = x.trace AND z.i > x.i AND z.m <> x.m WHERE x.p < x.m GROUP BY x.trace, x.i, x.m, x.apex),
peak AS (SELECT rise.* FROM rise JOIN mm z ON z.trace = rise.trace AND z.i = stop AND z.m < rise.m WHERE abs(floor((rise.i + stop - 1) / 2) - rise.apex) > 2),
sides AS (SELECT peak.trace, peak.i, peak.m, peak.stop, coalesce(max(z.i) FILTER (z.i < peak.i AND z.m > peak.m), -1) AS lb, coalesce(min(z.i) FILTER (z.i > peak.i AND z.m > peak.m), 1000000) AS rb FROM peak JOIN mm z ON z.trace = peak.trace GROUP BY peak.trace, peak.i, peak.m, peak.stop),
prom AS (SELECT sides.trace, sides.i, any_value(sides.m) - greatest(min(z.m) FILTER (z.i > lb AND z.i < sides.i), min(z.m) FILTER (z.i >= stop AND z.i < rb)) AS p FROM sides JOIN mm z ON z.trace = sides.trace GROUP BY sides.trace, sides.i)"""


@query("A15_secondary", f"""WITH {_T}, {_APEX}, m AS (SELECT trace, i, {_M} AS m FROM t WINDOW o AS (PARTITION BY trace ORDER BY i)), {_PROMINENCE}
SELECT trace, {r('least(1.0, coalesce(max(prom.p), 0) / (any_value(mm.m) + 1e-12))')} AS MOD FROM mm LEFT JOIN prom USING (trace) WHERE mm.i = mm.apex GROUP BY trace""")
def a15(spark, sf):
    return peaks.secondary(P.traces(spark, sf))


@query("A24_maxima", f"WITH {_T}, {_MAX} SELECT trace, peak, i, {r('y')} AS y FROM k")
def a24(spark, sf):
    return peaks.maxima(P.traces(spark, sf), 50)


@query("A25_core", f"""WITH {_T}, {_APEX}, d AS (SELECT trace, i, n, apex, CASE WHEN y <= 0.3 * top THEN 1 ELSE 0 END AS low FROM t JOIN a USING (trace)),
w AS (SELECT *, low + lead(low) OVER o = 2 AS f, low + lag(low) OVER o = 2 AS b FROM d WINDOW o AS (PARTITION BY trace ORDER BY i))
SELECT trace, n, apex, coalesce(max(i) FILTER (i < apex AND b), 0) AS lo, coalesce(min(i) FILTER (i > apex AND f), n - 1) AS hi FROM w GROUP BY trace, n, apex""")
def a25(spark, sf):
    return peaks.core(P.traces(spark, sf), 0.3)


@query("A26_valley_right")
def a26(spark, sf):
    return peaks.valley_right(P.traces(spark, sf))


@query("A30_shared_valleys", f"""WITH {_T}, {_MAX}, p AS (SELECT trace, peak, i AS a, y, lead(i) OVER w AS b, lead(y) OVER w AS yb FROM k WINDOW w AS (PARTITION BY trace ORDER BY peak))
SELECT p.trace, peak, arg_min(t.i, (t.y, t.i)) AS valley, {r('min(t.y)')} AS y FROM p JOIN t ON p.trace = t.trace AND t.i > a AND t.i < b GROUP BY p.trace, peak, p.y, yb HAVING min(t.y) < least(p.y, yb)""")
def a30(spark, sf):
    return peaks.shared_valleys(P.traces(spark, sf), 50)


@query("A31_gaussian", f"WITH {_T}, k AS (SELECT CAST(range AS INTEGER) - 3 AS d, exp(-0.5 * (range - 3) ** 2) AS w FROM range(7)) SELECT t.trace, t.i, {r('sum(w * u.y) / sum(w)')} AS y FROM t CROSS JOIN k JOIN t u ON u.trace = t.trace AND u.i = t.i + d GROUP BY t.trace, t.i")
def a31(spark, sf):
    return peaks.gaussian(P.traces(spark, sf))


@query("G19_window_diagnostics", f"""WITH {_T}, {_APEX}, d AS (SELECT trace, i, y, apex, top, (y + lead(y) OVER (PARTITION BY trace ORDER BY i)) / 2 AS area FROM t JOIN a USING (trace) WHERE abs(i - apex) <= 10),
s AS (SELECT trace, apex, top, count(*) AS n_points, quantile_cont(y, 0.2) AS base, sum(area) AS area, min(i) AS lo, max(i) AS hi FROM d GROUP BY trace, apex, top)
SELECT trace, n_points, {r('top - base')} AS height, {r('base')} AS baseline, {r('area - base * (hi - lo)')} AS net_area, (apex = lo OR apex = hi) AS at_edge FROM s""")
def g19(spark, sf):
    return peaks.window_diagnostics(P.traces(spark, sf))


@query("J11_interval_overlaps", f"""WITH {_T}, {_MAX}, a AS (SELECT trace, peak AS id, i - 3 AS lo, i + 3 AS hi FROM k), b AS (SELECT trace, peak AS id, i - 1 AS lo, i + 4 AS hi FROM k)
SELECT a.trace, a.id, b.id AS other, (b.lo + b.hi) / 2.0 BETWEEN a.lo AND a.hi AS core FROM a JOIN b ON a.trace = b.trace AND a.lo <= b.hi AND b.lo <= a.hi""")
def j11(spark, sf):
    k = peaks.maxima(P.traces(spark, sf), 50)
    span = lambda lo, hi: k.select("trace", F.col("peak").alias("id"), (F.col("i") - lo).alias("lo"), (F.col("i") + hi).alias("hi"))
    return peaks.interval_overlaps(span(3, 3), span(1, 4))


@query("J19_pairs_across_splits", f"""WITH n AS ({_NEAR}), c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer)
SELECT a, b, x.split AS split_a, y.split AS split_b FROM n JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE x.split <> y.split""")
def j19(spark, sf):
    split = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"))
    marked = written(_accounts(spark, sf).join(split.hint("merge"), "id"), "marked")
    return range_join.near_pairs(marked, "id", "mz", "rt", 400, 2, ("split",)).filter("split_a <> split_b").select("a", "b", "split_a", "split_b")


@query("J5_one_to_one", "SELECT d.doc_id AS seed, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j5(spark, sf):
    d, l = P.table(spark, sf, "documents"), P.table(spark, sf, "labels")
    twice = tables.require_unique(l, "doc_id").agg(F.count("*").alias("twice"))  # one row
    checked = l.crossJoin(F.broadcast(twice)).filter(F.when(F.col("twice") > 0, F.raise_error(F.lit("keys repeat")).cast("boolean")).otherwise(True)).drop("twice")
    return d.join(checked, "doc_id").select(F.col("doc_id").alias("seed"), "source", "quality", "toxic")


@query("G5_manifest_audit", "SELECT count(*) AS total, count(DISTINCT source) AS sources, count(DISTINCT lang) AS domains, count(*) FILTER (n_chars < 1000) AS short, count(*) FILTER (n_chars >= 1000) AS long, " + ", ".join(f"{r(f'quantile_cont(n_chars, {q})')} AS p{int(100 * q):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM documents")
def g5(spark, sf):
    q = (0.05, 0.25, 0.5, 0.75, 0.95)
    return P.table(spark, sf, "documents").agg(
        F.count("*").alias("total"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("domains"), F.count_if(F.col("n_chars") < 1000).alias("short"), F.count_if(F.col("n_chars") >= 1000).alias("long"),
        *(F.percentile("n_chars", F.lit(x)).alias(f"p{int(100 * x):02d}") for x in q),
    )


@query("G12_job_inventory", f"SELECT source, count(*) AS n_jobs, count(DISTINCT round(tol / mz, 9)) AS n_tolerances FROM ({P.FEATURES}) GROUP BY source")
def g12(spark, sf):
    return P.features(spark, sf).groupBy("source").agg(F.count("*").alias("n_jobs"), F.count_distinct(F.round(F.col("tol") / F.col("mz"), 9)).alias("n_tolerances"))


@query("P9_pool_rows", "SELECT 'part__F' || p_partkey AS feature, round(p_retailprice, 6) + 0.0 AS mz, p_brand AS stem FROM part WHERE p_size > 5")
def p9(spark, sf):
    return P.table(spark, sf, "part").filter("p_size > 5").select(F.concat_ws("__", F.lit("part"), F.concat(F.lit("F"), "p_partkey")).alias("feature"), F.col("p_retailprice").alias("mz"), F.col("p_brand").alias("stem"))


@query("P28_namespaced_ids", "SELECT 'OLD::' || p_name AS id, CASE WHEN len(string_split(p_name, ' ')) < 2 THEN 'UNPARSED' ELSE string_split(p_name, ' ')[2] END AS part FROM part")
def p28(spark, sf):
    parts = F.split("p_name", " ")
    return P.table(spark, sf, "part").select(F.concat(F.lit("OLD::"), "p_name").alias("id"), F.when(F.size(parts) < 2, "UNPARSED").otherwise(F.get(parts, F.lit(1))).alias("part"))


@query("P25_two_best_boxes", f"SELECT sample, count(*) AS n, round(max(score) FILTER (k = 1), 6) + 0.0 AS box1_score, round(max(score) FILTER (k = 2), 6) + 0.0 AS box2_score FROM (SELECT sample, score, row_number() OVER (PARTITION BY sample ORDER BY score DESC, ord) AS k FROM ({P.BOXES}) WHERE NOT target) GROUP BY sample")
def p25(spark, sf):
    b = P.boxes(spark, sf).filter("not target").groupBy("sample").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord"))).alias("x"))
    return b.select("sample", "n", (-F.get("x", F.lit(0))["s"]).alias("box1_score"), (-F.get("x", F.lit(1))["s"]).alias("box2_score"))


_CONDITIONS = ["label = 0", "label = 1", "label is null", "size < 400", "label = 1 and size > 5000"]
_CHOSEN = ", ".join(f"c{k} AS (SELECT seed FROM s WHERE {c}" + (f" AND seed NOT IN ({' UNION ALL '.join(f'SELECT seed FROM c{j}' for j in range(k))})" if k else "") + " ORDER BY h, seed LIMIT 1)" for k, c in enumerate(_CONDITIONS))


@query("T8_balanced_subset", f"WITH s AS (SELECT seed, label, size, md5('1:' || CAST(seed AS VARCHAR)) AS h FROM ({P.SEEDS})), {_CHOSEN}, f AS ({' UNION ALL '.join(f'SELECT seed, {k} AS f FROM c{k}' for k in range(len(_CONDITIONS)))}) SELECT seed, label, place FROM (SELECT s.seed, label, row_number() OVER (ORDER BY coalesce(f, 99), h, s.seed) AS place FROM s LEFT JOIN f USING (seed)) WHERE place <= 20")
def t8(spark, sf):
    return splits.balanced_subset(P.seeds(spark, sf), _CONDITIONS, "seed", 20, 1).select("seed", "label", "place")


@query("U6_annotation_tasks", "SELECT d.doc_id AS seed, source, url FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id WHERE l.doc_id IS NULL")
def u6(spark, sf):
    d, l, p = (P.table(spark, sf, t) for t in ("documents", "labels", "pages"))
    return d.join(l, "doc_id", "left_anti").join(p, F.col("page_id") == F.col("doc_id"), "left").select(F.col("doc_id").alias("seed"), "source", "url")


@query("E13_prediction_audit", f"WITH s AS ({P.SCORED}), p AS (SELECT seed, score FROM s WHERE seed % 10 <> 0) SELECT (SELECT count(*) FROM s) AS n_truth, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM s WHERE seed NOT IN (SELECT seed FROM p)) AS n_missing, {r('(SELECT min(score) FROM p)')} AS lowest, {r('(SELECT max(score) FROM p)')} AS highest")
def e13(spark, sf):
    s = P.scored(spark, sf)
    p = s.filter("seed % 10 <> 0").select("seed", F.col("score").alias("predicted"))
    return s.join(p, "seed", "left").agg(F.count("*").alias("n_truth"), F.count("predicted").alias("n_predicted"), F.count_if(F.col("predicted").isNull()).alias("n_missing"), F.min("predicted").alias("lowest"), F.max("predicted").alias("highest"))


@query("V1_verification", f"""WITH {_SPLIT}, c AS (SELECT 'unique_ids' AS name, count(*) - count(DISTINCT seed) AS value FROM p UNION ALL SELECT 'null_labels', count(*) FILTER (label IS NULL) FROM p UNION ALL SELECT 'bad_labels', count(*) FILTER (label NOT IN (0, 1)) FROM p
UNION ALL SELECT 'shared_sources', (SELECT count(*) FROM (SELECT source FROM p GROUP BY source HAVING count(DISTINCT split) > 1)))
SELECT name, value, CASE WHEN value = 0 THEN 'pass' ELSE 'fail' END AS status FROM c""")
def v1(spark, sf):
    p = _split(spark, sf)
    one = p.agg((F.count("*") - F.count_distinct("seed")).alias("unique_ids"), F.count_if(F.col("label").isNull()).alias("null_labels"), F.count_if(~F.col("label").isin(0, 1)).alias("bad_labels"))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns))).alias("x")).select("x.*")
    rows = rows.unionByName(audits.crossing(p, "source", "split").agg(F.count("*").alias("value")).withColumn("name", F.lit("shared_sources")))
    return rows.select("name", "value", F.when(F.col("value") == 0, "pass").otherwise("fail").alias("status"))
