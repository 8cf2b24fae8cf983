"""Registered queries of whole jobs: attributes of feature tables, boundaries, detector tables, records, relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import attributes, boundaries, normalize, peaks, range_join, records, tables, traces
from ..operators.shared import written
from ..sources import proxies as P
from .peaks import _MAX
from .queries import _DENSE, _NEAR, _T, SQL, _accounts, query, r

_E = "1e-12"
_CROSS = lambda x1, y1, x2, y2: f"CASE WHEN abs({y2} - {y1}) < {_E} THEN ({x1} + {x2}) / 2 ELSE {x1} + greatest(0.0, least(1.0, (h - {y1}) / ({y2} - {y1}))) * ({x2} - {x1}) END"
_ZIG = lambda s, a, b: f"log10(greatest({s} / (n * greatest(({a} - {b}) ** 2, {_E})), {_E}))"
_ATTRIBUTES = f"""b AS (SELECT feature, CAST(x AS DOUBLE) AS x, greatest(coalesce(y, 0), 0) AS y, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM pts),
c AS (SELECT *, (coalesce(lag(y) OVER o, 0) + y + coalesce(lead(y) OVER o, 0)) / 3 AS m, lag(y) OVER o AS p, lag(y, 2) OVER o AS pp, lead(y) OVER o AS q FROM b WINDOW o AS (PARTITION BY feature ORDER BY x)),
t AS (SELECT feature, max(y) AS top, min(y) AS least, min(x) AS x0, max(x) AS x9, arg_max(i, (y, -i)) AS apex FROM c GROUP BY feature),
u AS (SELECT feature, coalesce(max(i) FILTER (y < 0.5 * top AND i < apex), 0) AS l, coalesce(min(i) FILTER (y < 0.5 * top AND i > apex), any_value(n) - 1) AS r FROM c JOIN t USING (feature) GROUP BY feature),
v AS (SELECT feature, max(x) FILTER (i = l) AS xl1, max(y) FILTER (i = l) AS yl1, max(x) FILTER (i = l + 1) AS xl2, max(y) FILTER (i = l + 1) AS yl2, max(x) FILTER (i = r - 1) AS xr1, max(y) FILTER (i = r - 1) AS yr1,
  max(x) FILTER (i = r) AS xr2, max(y) FILTER (i = r) AS yr2, max(x) FILTER (i = apex) AS mu, 0.5 * any_value(top) AS h, any_value(n) AS n, any_value(apex) AS apex, any_value(x0) AS x0, any_value(x9) AS x9 FROM c JOIN t USING (feature) JOIN u USING (feature) GROUP BY feature),
w AS (SELECT feature, mu, greatest(coalesce(CASE WHEN apex > 0 AND apex < n - 1 THEN greatest(({_CROSS('xr1', 'yr1', 'xr2', 'yr2')}) - ({_CROSS('xl1', 'yl1', 'xl2', 'yl2')}), 0.0) END / 2.35482, (x9 - x0) / 6), 1e-6) AS sigma,
  (CASE WHEN apex = n - 1 OR yr2 >= h THEN x9 ELSE {_CROSS('xr1', 'yr1', 'xr2', 'yr2')} END) - (CASE WHEN apex = 0 OR yl1 >= h THEN x0 ELSE {_CROSS('xl1', 'yl1', 'xl2', 'yl2')} END) AS wide FROM v),
e AS (SELECT c.*, t.top, t.least, t.x0, t.x9, t.apex, w.wide, exp(-0.5 * ((x - mu) / sigma) ** 2) AS g, lag(m) OVER o AS mp, lead(m) OVER o AS mq, abs(i - apex) AS off,
  CASE WHEN top > least THEN least(floor((y - least) / (top - least) * 256), 255) ELSE 0 END AS bin, least(n, greatest(3, round_even(0.1 * n, 0))) AS edge FROM c JOIN t USING (feature) JOIN w USING (feature) WINDOW o AS (PARTITION BY feature ORDER BY x)),
f AS (SELECT *, count(*) OVER (PARTITION BY feature, bin) AS in_bin, count(*) OVER (PARTITION BY feature, off) AS k, max(y) OVER (PARTITION BY feature, off) - min(y) OVER (PARTITION BY feature, off) AS apart FROM e),
s AS (SELECT feature, any_value(n) AS n, any_value(top) AS top, any_value(least) AS least, any_value(wide) AS wide, any_value(x0) AS x0, any_value(x9) AS x9, avg(y) AS mean, stddev_pop(y) AS std, sum(y) AS total,
  sum((2 * y - p - q) ** 2) AS zz, max(m) AS m_top, min(m) AS m_least, sum((2 * m - mp - mq) ** 2) AS m_zz, corr(y, m) AS r_m, stddev_pop(m) AS m_std, corr(y, g) AS r_g, stddev_pop(g) AS g_std, skewness(y) AS sk,
  sum(CASE WHEN y > 0 THEN y * log2(y) ELSE 0 END) AS ylog, avg(abs(y - p)) AS move, sum(abs(sign(y - p) - sign(p - pp))) AS turns, sum(-log2(in_bin / n) / n) AS entropy,
  coalesce(sum(apart) FILTER (k = 2 AND off > 0), 0) / 2 AS apart, coalesce(sum(y) FILTER (k = 2 AND off > 0), 0) AS sides, median(y) FILTER (i < edge) AS first, median(y) FILTER (i >= n - edge) AS last, max(m) FILTER (i = apex) AS m_high FROM f GROUP BY feature),
rise AS (SELECT a.feature, a.i, a.m, a.apex, coalesce(min(z.i), any_value(a.n)) AS stop FROM e a LEFT JOIN e z ON z.feature = a.feature AND z.i > a.i AND z.m <> a.m WHERE a.mp < a.m GROUP BY a.feature, a.i, a.m, a.apex),
peak AS (SELECT rise.* FROM rise JOIN e z ON z.feature = rise.feature AND z.i = stop AND z.m < rise.m WHERE abs(floor((rise.i + stop - 1) / 2) - rise.apex) > 2),
sides AS (SELECT peak.feature, peak.i, peak.m, peak.stop, coalesce(max(z.i) FILTER (z.i < peak.i AND z.m > peak.m), -1) AS lb, coalesce(min(z.i) FILTER (z.i > peak.i AND z.m > peak.m), 1000000) AS rb FROM peak JOIN e z USING (feature) GROUP BY ALL),
prom AS (SELECT sides.feature, sides.i, any_value(sides.m) - greatest(min(z.m) FILTER (z.i > lb AND z.i < sides.i), min(z.m) FILTER (z.i >= stop AND z.i < rb)) AS p FROM sides JOIN e z ON z.feature = sides.feature GROUP BY sides.feature, sides.i),
best AS (SELECT feature, max(p) AS p FROM prom GROUP BY feature),
a AS (SELECT feature, CASE WHEN std > {_E} THEN (top - mean) / std ELSE top END AS SNR, CASE WHEN mean > {_E} THEN std / mean END AS CV,
  CASE WHEN std > {_E} AND g_std > {_E} THEN atanh(greatest(-0.999999, least(0.999999, r_g))) END AS GS, log10(greatest(0.5 * n * top / total, {_E})) AS TPAS, CASE WHEN x9 - x0 > {_E} THEN wide / (x9 - x0) END AS H2B,
  {_ZIG('zz', 'top', 'least')} AS ZZ, {_ZIG('zz', 'top', 'least')} - {_ZIG('m_zz', 'm_top', 'm_least')} AS DZZ, CASE WHEN std > {_E} AND m_std > {_E} THEN atanh(greatest(-0.999999, least(0.999999, r_m))) END AS PCC,
  sk AS SKEW, log2(total) - ylog / total AS DENT, CASE WHEN mean > {_E} THEN move / mean END AS DM, CASE WHEN top > least THEN abs(entropy) ELSE 0 END AS ENT, turns / n AS JAG,
  greatest(0.0, least(1.0, 1 - apart / (top + {_E}) / (sides / (top + {_E}) + {_E}))) AS SYM, least(1.0, coalesce(p, 0) / (m_high + {_E})) AS MOD, greatest(first, last) / (top + {_E}) AS EDGE, n
  FROM s LEFT JOIN best USING (feature) WHERE top > 0)"""
_NAMES = ", ".join(f"{r(f'CASE WHEN n >= 3 THEN {c} END') if c not in ('SYM', 'MOD', 'EDGE') else r(c)} AS {c}" for c in attributes.ATTRIBUTES)


@query("A18_peak_attributes", f"WITH pts AS (SELECT feature, scan AS x, intensity AS y FROM ({_DENSE})), {_ATTRIBUTES} SELECT f.feature, f.source, round(f.mz, 6) + 0.0 AS mz, {_NAMES} FROM ({P.FEATURES}) f LEFT JOIN a USING (feature)")
def a18(spark, sf):
    return attributes.peak_attributes(P.features(spark, sf), P.scan_peaks(spark, sf))


@query("A18_trace_attributes", f"WITH pts AS (SELECT trace AS feature, i AS x, y FROM ({P.TRACES})), {_ATTRIBUTES} SELECT feature, {_NAMES} FROM (SELECT DISTINCT feature FROM pts) LEFT JOIN a USING (feature)")
def a18_traces(spark, sf):
    return attributes.attributes(P.traces(spark, sf).select(F.col("trace").alias("feature"), F.col("i").alias("x"), "y"))


@query("J6_attach", f"WITH {_T}, s AS (SELECT trace AS id, max(y) AS top, count(*) AS n FROM t GROUP BY trace) SELECT c_custkey AS id, c_nationkey AS source, {r('top')} AS top, n FROM customer LEFT JOIN s ON c_custkey = id")
def j6(spark, sf):
    s = P.traces(spark, sf).groupBy(F.col("trace").alias("id")).agg(F.max("y").alias("top"), F.count("*").alias("n"))
    rows = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("source"), F.lit(0).alias("n"))
    return attributes.attach(rows, s, "id")


_HINTS = f"SELECT trace AS feature, CAST(count(*) // 2 AS DOUBLE) AS hint, CASE WHEN trace % 2 = 0 THEN count(*) // 2 - 5.0 ELSE 0.0 END AS rtmin, CASE WHEN trace % 2 = 0 THEN count(*) // 2 + 5.0 ELSE 1.0 END AS rtmax FROM ({P.TRACES}) GROUP BY trace"


def _hints(spark, sf):
    half = F.floor(F.count("*") / 2).cast("double")
    even = F.col("feature") % 2 == 0
    h = P.traces(spark, sf).groupBy(F.col("trace").alias("feature")).agg(half.alias("hint"))
    return h.select("feature", "hint", F.when(even, F.col("hint") - 5).otherwise(0.0).alias("rtmin"), F.when(even, F.col("hint") + 5).otherwise(1.0).alias("rtmax"))


def _points(spark, sf):
    return P.traces(spark, sf).select(F.col("trace").alias("feature"), F.col("i").cast("double").alias("x"), "y")


@query("A24_apex_search", f"""WITH h AS ({_HINTS}), t AS (SELECT trace AS feature, i, CAST(i AS DOUBLE) AS x, y FROM ({P.TRACES})), s AS (SELECT feature, CASE WHEN count(*) >= 3 THEN 1.0 ELSE 0.0 END AS step FROM t GROUP BY feature),
d AS (SELECT *, NOT (hint BETWEEN rtmin AND rtmax) AS free FROM t JOIN h USING (feature) JOIN s USING (feature))
SELECT feature, coalesce(arg_max(i, (y, -i)) FILTER (y > 0 AND abs(x - hint) <= least(20.0, greatest(0.05, 6 * step))), arg_max(i, (y, -i)) FILTER (y > 0 AND abs(x - hint) <= least(20.0, greatest(0.12, 12 * step))),
  arg_max(i, (y, -i)) FILTER (y > 0 AND free AND abs(x - hint) <= 20), arg_min(i, (abs(x - hint), i))) AS apex FROM d GROUP BY feature""")
def a24_apex(spark, sf):
    return boundaries.pick_apex(_points(spark, sf), _hints(spark, sf), 20.0)


@query("A27_refined_boundaries")
def a27(spark, sf):
    return boundaries.refined(_points(spark, sf), _hints(spark, sf), boundaries.Settings(search_half=20.0, local_half=60.0, expand_minutes=20.0))


@query("A32_label_box", f"""WITH h AS ({_HINTS}), b AS (SELECT feature, rtmin - 0.05 * (rtmax - rtmin) AS x1, rtmax + 0.05 * (rtmax - rtmin) AS x2 FROM h)
SELECT feature, {r('x1')} AS x1, {r('x2')} AS x2, 0.0 AS y1, {r('1.05 * greatest(0.0, coalesce(max(y) FILTER (i BETWEEN x1 AND x2), max(y)))')} AS y2 FROM b JOIN ({P.TRACES}) t ON t.trace = b.feature GROUP BY feature, x1, x2""")
def a32(spark, sf):
    return boundaries.label_box(_points(spark, sf), _hints(spark, sf))


_EXPORT = {"Precursor m/z": "p_retailprice", "RT left(min)": "p_size - 0.5", "RT (min)": "p_size * 1.0", "RT right (min)": "p_size + 0.5", "Height": "p_partkey", "Area": "p_partkey * 2", "Estimated noise": "p_size", "S/N": "p_size * 3", "Sharpness": "p_size", "Gaussian similarity": "p_size", "Ideal slope": "p_size", "Symmetry": "p_size"}
_SAMPLES = {"one.mzML": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey END", "two.mzML": "p_partkey + 1"}


@query("P4_msdial", "SELECT " + ", ".join(f'CAST({_EXPORT[c]} AS DOUBLE) AS "{n}"' for c, n in records.MSDIAL.items()) + ", " + ", ".join(f'CAST(coalesce({e}, 0) AS DOUBLE) AS "{c}"' for c, e in _SAMPLES.items()) + " FROM part")
def p4(spark, sf):
    named = {**_EXPORT, **_SAMPLES, "Comment": "p_name"}
    return records.msdial(P.table(spark, sf, "part").select(*(F.expr(e if c == "Comment" else f"CAST({e} AS DOUBLE)").alias(c) for c, e in named.items())))


@query("P8_view_single", "SELECT p_partkey AS Feature_ID, round(p_retailprice, 6) + 0.0 AS mz, p_size AS RT, NULL AS RTmin, p_size + 1 AS RTmax, TRY_CAST(CASE WHEN p_size % 4 = 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS DOUBLE) AS PeakArea FROM part")
def p8(spark, sf):
    d = P.table(spark, sf, "part").select(F.col("p_partkey").alias("Feature_ID"), F.col("p_retailprice").alias("mz"), F.col("p_size").alias("RT"), (F.col("p_size") + 1).alias("RTmax"), F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(F.col("p_partkey").cast("string")).alias("a.mzML"), F.lit(1).alias("other"))
    return records.view(d, "xcms")


@query("P8_view_multi", 'SELECT p_partkey AS Feature_ID, round(p_retailprice, 6) + 0.0 AS mz, p_size AS "a.mzML", p_size * 2 AS "b.mzML" FROM part')
def p8_multi(spark, sf):
    return records.view(P.table(spark, sf, "part").select(F.col("p_partkey").alias("Feature_ID"), F.col("p_retailprice").alias("mz"), F.lit(1).alias("RTmin"), F.col("p_size").alias("a.mzML"), (F.col("p_size") * 2).alias("b.mzML")), "asari")


@query("P10_single_file_rows", f"""WITH x AS (SELECT 'S' || l_suppkey || '.mzML' AS source_file, l_orderkey * 10 + l_linenumber AS tie, CASE WHEN l_partkey % 5 = 0 THEN 'row' ELSE CAST(l_partkey % 400 AS VARCHAR) END AS name, TRY_CAST(CASE WHEN l_linenumber = 7 THEN 'NA' ELSE CAST(l_extendedprice AS VARCHAR) END AS DOUBLE) AS mz,
  l_quantity AS rt, l_discount AS maxo, l_tax AS area FROM lineitem),
y AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY area DESC, maxo DESC, tie) AS place FROM x WHERE mz IS NOT NULL),
z AS (SELECT *, replace(source_file, '.mzML', '') || '__F' || coalesce(CAST(TRY_CAST(name AS DOUBLE) AS BIGINT), place) AS Feature_ID FROM y)
SELECT source_file, Feature_ID, {r('mz')} AS mz, {r('(rt - 1) / 60')} AS RTmin, {r('rt / 60')} AS RT, {r('(rt + 1) / 60')} AS RTmax, {r('maxo')} AS maxo, {r('area')} AS area FROM (SELECT *, row_number() OVER (PARTITION BY source_file, Feature_ID ORDER BY place) AS k FROM z) WHERE k = 1""")
def p10(spark, sf):
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    q = F.col("l_quantity")
    d = P.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit(".mzML")).alias("source_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"), F.when(F.col("l_partkey") % 5 == 0, "row").otherwise(text(F.col("l_partkey") % 400)).alias("Row.names"),
        F.when(F.col("l_linenumber") == 7, "NA").otherwise(text("l_extendedprice")).alias("mzmed"), text(q - 1).alias("rtmin"), text(q).alias("rtmed"), text(q + 1).alias("rtmax"), text("l_discount").alias("maxo"), text("l_tax").alias("into"),
    )
    return records.xcms_rows(d, "tie")


@query("P11_valid_pool", f"""WITH p AS (SELECT feature, source, mz, lo + 60 AS RT, CASE WHEN feature % 11 = 0 THEN ' ' ELSE ' F' || feature END AS name FROM ({P.FEATURES})), e AS (SELECT source, min(scan) AS a, max(scan) AS b FROM ({P.SCAN_PEAKS}) GROUP BY source)
SELECT trim(name) AS Feature_ID, p.source, round(mz, 6) + 0.0 AS mz, CAST(RT AS DOUBLE) AS RT FROM p LEFT JOIN e USING (source) WHERE trim(name) <> '' AND (a IS NULL OR (RT > a AND RT < b))""")
def p11(spark, sf):
    f = P.features(spark, sf)
    pool = f.select(F.when(F.col("feature") % 11 == 0, " ").otherwise(F.concat(F.lit(" F"), F.col("feature").cast("string"))).alias("Feature_ID"), "source", "mz", (F.col("lo") + 60).alias("RT"), F.col("lo").alias("RTmin"), F.col("hi").alias("RTmax"))
    return records.valid_pool(pool, P.scan_peaks(spark, sf).select("source", F.col("scan").alias("rt"))).select("Feature_ID", "source", "mz", "RT")


@query("P14_binary_label", """WITH o AS (SELECT l_orderkey AS image, list_distinct(list(CASE l_returnflag WHEN 'A' THEN 'true_peak' WHEN 'N' THEN 'false_peak' ELSE 'other' END)) AS labels FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey),
p AS (SELECT o_orderkey AS image, coalesce(labels, []) AS labels FROM orders LEFT JOIN o ON image = o_orderkey)
SELECT image, CASE WHEN len(labels) = 0 THEN 0 WHEN NOT list_has_any(labels, ['true_peak', 'false_peak']) THEN NULL WHEN list_contains(labels, 'true_peak') THEN 1 ELSE 0 END AS is_true_peak FROM p""")
def p14(spark, sf):
    l = P.table(spark, sf, "lineitem").filter("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("image")).agg(F.collect_set(F.when(F.col("l_returnflag") == "A", "true_peak").when(F.col("l_returnflag") == "N", "false_peak").otherwise("other")).alias("labels"))
    d = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image")).join(l, "image", "left")
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    return d.select("image", records.binary_label(labels, ["true_peak", "false_peak"], ["true_peak"]).alias("is_true_peak"))


@query("P17_records", f"""WITH b AS (SELECT sample, count(*) AS n, list([x1, y1, x2, y2] ORDER BY ord) AS boxes FROM ({P.BOXES}) WHERE target GROUP BY sample)
SELECT o_orderkey AS sample_id, 'images/' || o_orderkey || '.png' AS image_path, coalesce(n, 0) AS n_boxes, round(coalesce(list_sum(list_transform(boxes, lambda x: x[1])), 0), 6) + 0.0 AS left_sum, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS seed_label,
  (CASE WHEN o_orderstatus = 'F' THEN 'seed_positive' ELSE 'seed_negative' END) || ',' || (CASE WHEN n IS NULL THEN 'detection_empty' WHEN n = 1 THEN 'detection_single' ELSE 'detection_multi' END) AS subsets, o_orderpriority AS priority
FROM orders LEFT JOIN b ON sample = o_orderkey""")
def p17(spark, sf):
    b = P.boxes(spark, sf)
    shapes = b.select(F.col("sample").alias("sample_id"), F.when(F.col("target"), "True_Peak").otherwise("OUT_FIG").alias("label"), F.array("x1", "y1", "x2", "y2").alias("box"), F.col("ord").alias("place"))
    counts = b.filter("target").groupBy(F.col("sample").alias("sample_id")).agg(F.count("*").alias("declared"))
    rows = P.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("images/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("image_path"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("seed_label"), F.lit("s").alias("source_file"), F.lit("d").alias("study_id"), F.col("o_orderpriority").alias("priority")
    ).join(counts, "sample_id", "left").withColumn("declared", F.coalesce("declared", F.lit(0)))
    d = records.record(rows, shapes, ["priority"])
    return d.select("sample_id", "image_path", F.size("boxes").cast("long").alias("n_boxes"), F.aggregate("boxes", F.lit(0.0), lambda a, x: a + x[0]).alias("left_sum"), "seed_label", F.array_join("subsets", ",").alias("subsets"), F.col("metadata")["priority"].alias("priority"))


@query("G6_anchor_advice", f"""WITH b AS (SELECT x2 - x1 AS w, y2 - y1 AS h FROM ({P.BOXES})), q AS (SELECT quantile_cont(sqrt(w * h), [0.05, 0.25, 0.5, 0.75, 0.95]) AS a, quantile_cont(h / w, [0.05, 0.25, 0.5, 0.75, 0.95]) AS k FROM b WHERE w > 0 AND h > 0),
u AS (SELECT list_transform(a, lambda v: greatest(4, CAST(round_even(v / 4, 0) * 4 AS INTEGER))) AS a, list_transform(k, lambda v: round_even(v, 2)) AS k FROM q)
SELECT array_to_string(list_filter(a, lambda v, j: list_position(a, v) = j), ',') AS sizes, list_filter(k, lambda v, j: list_position(k, v) = j) AS ratios FROM u""")
def g6(spark, sf):
    return records.anchor_advice(P.boxes(spark, sf)).select(F.array_join(F.transform("sizes", lambda v: v.cast("string")), ",").alias("sizes"), "ratios")


_SEEDS = "sd AS (SELECT trace AS seed, count(*) / 2.0 + 0.25 AS rt, count(*) / 2.0 - 6 AS lo, count(*) / 2.0 + 6 AS hi, max(y) FILTER (i BETWEEN n2 - 6 AND n2 + 6) AS height, count(*) FILTER (i BETWEEN n2 - 6 AND n2 + 6) AS points, trace % 3 = 0 AS at_edge FROM (SELECT *, count(*) OVER (PARTITION BY trace) / 2.0 AS n2 FROM t) GROUP BY trace)"


@query("J12_seed_relation", f"""WITH {_T}, {_MAX}, {_SEEDS}, pk AS (SELECT trace AS seed, peak, CAST(i AS DOUBLE) AS apex, i - 3.0 AS l, i + 4.0 AS rr, y AS height, coalesce(lead(i) OVER (PARTITION BY trace ORDER BY peak) - i <= 4, FALSE) AS shared FROM k),
d AS (SELECT pk.*, rt, lo, hi, sd.height AS own, points, at_edge, greatest(lo - apex, apex - hi, 0) AS o, rr >= lo AND l <= hi AS ov, l - 2 <= rt AND rt <= rr + 2 AS anc FROM pk JOIN sd USING (seed)),
c AS (SELECT *, ov AND o = 0 AS core, ov AND o <= 2 AS op FROM d), g AS (SELECT *, CASE WHEN coalesce(lag(shared) OVER w AND lag(op) OVER w AND op, FALSE) THEN 0 ELSE 1 END AS st FROM c WINDOW w AS (PARTITION BY seed ORDER BY peak)),
h AS (SELECT *, sum(st) OVER (PARTITION BY seed ORDER BY peak) AS isl FROM g), m AS (SELECT *, op AND bool_or(core) OVER (PARTITION BY seed, isl) AS split, bool_or(core) OVER (PARTITION BY seed) AS ac, row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN anc AND ov THEN 0 ELSE 1 END, abs(apex - rt), peak) AS near, own / CASE WHEN height > 0 THEN height END AS ratio FROM h),
kd AS (SELECT *, CASE WHEN ac THEN CASE WHEN core OR split THEN 'core' END WHEN near = 1 AND anc AND ov THEN CASE WHEN o <= 2 AND ratio >= 0.5 THEN 'shift' WHEN points < 3 OR ratio IS NULL OR ratio < 0.02 THEN NULL WHEN ratio >= 0.05 OR NOT at_edge THEN 'shoulder pass' ELSE 'shoulder uncertain' END END AS kind FROM m),
s AS (SELECT seed, count(kind) AS nm, count(*) - count(kind) AS nx, max(kind) AS kind, bool_or(o > 1) FILTER (kind IS NOT NULL) AS far, arg_min((peak, apex, l, rr), (abs(apex - rt), peak)) FILTER (kind IS NOT NULL) AS pr, arg_max(peak, (height, -peak)) FILTER (kind IS NOT NULL) AS highest, min(l) FILTER (kind IS NOT NULL) AS ul, max(rr) FILTER (kind IS NOT NULL) AS uh FROM kd GROUP BY seed)
SELECT seed, CASE WHEN coalesce(nm, 0) = 0 THEN 'false' WHEN starts_with(kind, 'shoulder') THEN 'shoulder' WHEN kind = 'shift' THEN 'shift' WHEN nm = 1 THEN 'single' ELSE 'split' END AS relation, coalesce(nm, 0) AS n_matched, coalesce(nx, 0) AS n_extra, pr[1] AS primary, highest,
  coalesce(kind = 'shoulder uncertain' OR (kind = 'core' AND far), FALSE) AS review, {', '.join(f"round(CASE WHEN nm > 0 THEN CASE WHEN starts_with(kind, 'shoulder') THEN {a} ELSE pr[{b}] END END, 6) + 0.0 AS seed_{a}" for a, b in (('rt', 2), ('lo', 3), ('hi', 4)))}, round(ul, 6) + 0.0 AS union_lo, round(uh, 6) + 0.0 AS union_hi FROM sd LEFT JOIN s USING (seed)""")
def j12(spark, sf):
    t = P.traces(spark, sf)
    whole = Window.partitionBy("trace")
    t2 = t.withColumn("n2", F.count("*").over(whole) / 2)
    near = (F.col("i") >= F.col("n2") - 6) & (F.col("i") <= F.col("n2") + 6)
    s = t2.groupBy(F.col("trace").alias("seed"), "n2").agg(F.max(F.when(near, F.col("y"))).alias("height"), F.count_if(near).alias("points"))
    seeds = s.select("seed", (F.col("n2") + 0.25).alias("rt"), (F.col("n2") - 6).alias("lo"), (F.col("n2") + 6).alias("hi"), "height", "points", (F.col("seed") % 3 == 0).alias("at_edge"))
    k = peaks.maxima(t, 50)
    i = F.col("i").cast("double")
    shared = F.coalesce(F.lead("i").over(Window.partitionBy("trace").orderBy("peak")) - F.col("i") <= 4, F.lit(False))
    pk = k.select(F.col("trace").alias("seed"), "peak", i.alias("apex"), (i - 3).alias("left"), (i + 4).alias("right"), F.col("y").alias("height"), shared.alias("shared"))
    return records.seed_relation(seeds, pk, 2.0, 1.0)


@query("E11_logistic_baseline")
def e11(spark, sf):
    s = traces.shape(P.traces(spark, sf)).join(P.table(spark, sf, "customer").select(F.col("c_custkey").alias("trace"), (F.col("c_acctbal") > 4500).cast("int").alias("label")), "trace")
    d = s.withColumn("split", F.when(F.pmod(F.xxhash64("trace"), F.lit(5)) == 0, "test").otherwise("train"))
    return records.logistic_baseline(d, "label", ["SNR", "CV", "TPAS", "ZZ", "DZZ", "PCC", "SKEW", "DENT", "DM", "JAG"], key="trace")


@query("G12_one_tolerance", f"SELECT source, {r('any_value(ppm)')} AS ppm, count(*) AS n_rows FROM (SELECT source, round(tol / mz * 1e6, 3) AS ppm FROM ({P.FEATURES})) GROUP BY source")
def g12(spark, sf):
    return tables.single_value(P.features(spark, sf).select("source", F.round(F.col("tol") / F.col("mz") * 1e6, 3).alias("ppm")), "source", "ppm")


_MATRIX = "SELECT vec_id, label, list_concat(embedding, embedding[1:8]) AS m FROM embeddings"
_BITS = f"SELECT vec_id, label, list_transform(range(64), lambda k: CASE WHEN m[k + k // 8 + 1] > m[k + k // 8 + 2] THEN 1 ELSE 0 END) AS bits FROM ({_MATRIX})"


def _dhash(spark, sf):
    e = P.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", normalize.dhash(F.concat("embedding", F.slice("embedding", 1, 8))).alias("dhash"))


@query("A33_dhash_hex", f"SELECT vec_id, array_to_string(list_transform(range(16), lambda j: substr('0123456789abcdef', CAST(8 * bits[4 * j + 1] + 4 * bits[4 * j + 2] + 2 * bits[4 * j + 3] + bits[4 * j + 4] + 1 AS BIGINT), 1)), '') AS dhash FROM ({_BITS})")
def a33_hex(spark, sf):
    return _dhash(spark, sf).select("vec_id", "dhash")


@query("J9_near_duplicates", f"""WITH n AS ({_NEAR}), b AS ({_BITS})
SELECT a, n.b AS b, {r('ppm')} AS ppm, {r('gap')} AS gap, CAST(list_sum(list_transform(range(1, 65), lambda k: abs(x.bits[k] - y.bits[k]))) AS INTEGER) AS hamming,
  list_sum(list_transform(range(1, 65), lambda k: abs(x.bits[k] - y.bits[k]))) <= 30 AS high_similarity, x.label <> y.label AS label_conflict FROM n JOIN b x ON x.vec_id = a JOIN b y ON y.vec_id = n.b""")
def j9_duplicates(spark, sf):
    marks = range_join.halves(_dhash(spark, sf).select(F.col("vec_id").alias("id"), "dhash", "label"))
    marked = written(_accounts(spark, sf).join(marks.hint("merge"), "id"), "marked")  # only these can make pairs
    return range_join.near_duplicates(range_join.near_pairs(marked, "id", "mz", "rt", 400, 2, range_join.MARKS), most=30)


@query("V2_relation_checks", f"""WITH j AS ({SQL['J12_seed_relation']}), c AS (SELECT 'bound_order' AS name, count(*) FILTER (NOT (seed_lo < seed_rt AND seed_rt < seed_hi)) AS value FROM j UNION ALL SELECT 'bound_move', count(*) FILTER (relation IN ('single', 'split', 'shift') AND (seed_rt - seed_lo > 6 OR seed_hi - seed_rt > 6)) FROM j
UNION ALL SELECT 'label_is_match', count(*) FILTER ((relation = 'false') <> (n_matched = 0)) FROM j UNION ALL SELECT 'highest_of_matched', count(*) FILTER ((highest IS NULL) <> (n_matched = 0)) FROM j
UNION ALL SELECT 'union_holds_seed', count(*) FILTER (relation NOT IN ('false', 'shoulder') AND (union_lo > seed_lo OR union_hi < seed_hi)) FROM j) SELECT name, value, CASE WHEN value = 0 THEN 'pass' ELSE 'fail' END AS status FROM c""")
def v2(spark, sf):
    return records.relation_checks(j12(spark, sf), 6.0)
