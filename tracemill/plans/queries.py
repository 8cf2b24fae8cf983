"""Registered queries of the operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, components, metrics, range_join, tables, traces
from ..sources import proxies as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Doubles agree to this many digits in both engines.
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(F.col(f"`{c}`"), DIGITS) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def r(expr: str) -> str:
    return f"round({expr}, {DIGITS}) + 0.0"


# --- tolerance joins -------------------------------------------------------------------------------------------------

_HITS = f"SELECT f.feature, f.source, f.mz, p.scan, p.mz AS peak_mz, p.intensity, p.ord FROM ({P.FEATURES}) f JOIN ({P.SCAN_PEAKS}) p ON f.source = p.source AND p.mz BETWEEN f.mz - f.tol AND f.mz + f.tol"
_SUMS = f"SELECT feature, source, scan, sum(intensity) AS intensity, count(*) AS n_peaks FROM ({_HITS}) GROUP BY ALL"
_GRID = f"SELECT f.feature, f.source, s.scan FROM ({P.FEATURES}) f JOIN (SELECT DISTINCT source, scan FROM ({P.SCAN_PEAKS})) s ON f.source = s.source AND s.scan BETWEEN f.lo AND f.hi"
_DENSE = f"SELECT g.*, coalesce(s.intensity, 0) AS intensity FROM ({_GRID}) g LEFT JOIN ({_SUMS}) s USING (feature, source, scan)"


@query("J1_window_sum", f"SELECT feature, source, scan, {r('intensity')} AS intensity, n_peaks FROM ({_SUMS})")
def j1(spark, sf):
    return range_join.window_sum(P.features(spark, sf), P.scan_peaks(spark, sf))


@query("J2_nearest_peak", f"SELECT feature, source, scan, {r('x.peak_mz')} AS peak_mz, {r('x.intensity')} AS intensity FROM (SELECT feature, source, scan, arg_min(struct_pack(peak_mz := peak_mz, intensity := intensity), (abs(peak_mz - mz), peak_mz, ord)) AS x FROM ({_HITS}) GROUP BY ALL)")
def j2(spark, sf):
    return range_join.nearest(P.features(spark, sf), P.scan_peaks(spark, sf))


@query("J3_dense_grid", f"SELECT feature, source, scan, {r('intensity')} AS intensity FROM ({_DENSE})")
def j3(spark, sf):
    return range_join.dense(P.features(spark, sf), P.scan_peaks(spark, sf))


@query("J4_rt_interval_join", f"SELECT feature, f.source, count(s.scan) AS n_scans, min(s.scan) AS first_scan, max(s.scan) AS last_scan FROM ({P.FEATURES}) f LEFT JOIN (SELECT DISTINCT source, scan FROM ({P.SCAN_PEAKS})) s ON f.source = s.source AND s.scan BETWEEN f.lo AND f.hi GROUP BY ALL")
def j4(spark, sf):
    f = P.features(spark, sf)
    grid = range_join.scan_grid(f, P.scan_peaks(spark, sf)).groupBy("feature", "source").agg(F.count("*").alias("n"), F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"))
    return f.join(grid, ["feature", "source"], "left").select("feature", "source", F.coalesce("n", F.lit(0)).alias("n_scans"), "first_scan", "last_scan")


_CUSTOMER = "SELECT c_custkey AS id, c_nationkey AS source, c_acctbal + 2000 AS mz, (c_acctbal + 2000) % 60 AS rt FROM customer"


def _accounts(spark, sf):
    return P.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("source"), (F.col("c_acctbal") + 2000).alias("mz"), ((F.col("c_acctbal") + 2000) % 60).alias("rt"))


_NEAR = f"SELECT a.source, a.id AS a, b.id AS b, abs(a.mz - b.mz) / ((a.mz + b.mz) / 2) * 1e6 AS ppm, abs(a.rt - b.rt) AS gap FROM ({_CUSTOMER}) a JOIN ({_CUSTOMER}) b ON a.source = b.source AND a.id < b.id AND abs(a.rt - b.rt) <= 2 AND abs(a.mz - b.mz) / ((a.mz + b.mz) / 2) * 1e6 <= 400"


@query("J9_near_pairs", f"SELECT source, a, b, {r('ppm')} AS ppm, {r('gap')} AS gap FROM ({_NEAR})")
def j9(spark, sf):
    return range_join.near_pairs(_accounts(spark, sf), "id", "mz", "rt", 400, 2)


@query("C1_components", f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_NEAR}) UNION SELECT b, a FROM ({_NEAR})), reach(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id WHERE reach.root < e.b OR reach.root > e.b)
SELECT id, min(root) AS root FROM reach GROUP BY id""")
def c1(spark, sf):
    return range_join.near_components(_accounts(spark, sf), "id", "mz", "rt", 400, 2)


_HASHED = "SELECT vec_id, label, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > embedding[CASE WHEN i = 64 THEN 1 ELSE i + 1 END] THEN 1 ELSE 0 END) AS bits FROM embeddings"


@query("A33_dhash_bits", f"SELECT vec_id, array_to_string(bits, '') AS bits, CAST(list_sum(bits) AS BIGINT) AS n_set FROM ({_HASHED})")
def a33(spark, sf):
    e = P.table(spark, sf, "embeddings")
    follows = F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))
    bits = e.select("vec_id", F.zip_with("embedding", follows, lambda a, b: (a > b).cast("int")).alias("bits"))
    return bits.select("vec_id", F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits"), F.aggregate("bits", F.lit(0).cast("long"), lambda s, b: s + b).alias("n_set"))


# --- traces ----------------------------------------------------------------------------------------------------------

_T = f"t AS ({P.TRACES})"
_APEX = "a AS (SELECT trace, count(*) AS n, arg_max(i, (y, -i)) AS apex, max(y) AS top FROM t GROUP BY trace)"
_M = "(coalesce(lag(y) OVER o, 0.0) + y + coalesce(lead(y) OVER o, 0.0)) / 3"


@query("A1_A13_shape", f"""WITH {_T}, m AS (SELECT trace, i, y, {_M} AS m FROM t WINDOW o AS (PARTITION BY trace ORDER BY i)),
d AS (SELECT *, lag(y) OVER o AS p, lag(y, 2) OVER o AS pp, lead(y) OVER o AS q, lag(m) OVER o AS mp, lead(m) OVER o AS mq FROM m WINDOW o AS (PARTITION BY trace ORDER BY i)),
s AS (SELECT trace, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std, max(y) AS top, min(y) AS low, sum(y) AS total, sum((2 * y - p - q) ** 2) AS zz, max(m) AS m_top, min(m) AS m_low, sum((2 * m - mp - mq) ** 2) AS m_zz,
  corr(y, m) AS r, stddev_pop(m) AS m_std, skewness(y) AS g, sum(CASE WHEN y > 0 THEN y * log2(y) ELSE 0 END) AS ylog, avg(abs(y - p)) AS move, sum(abs(sign(y - p) - sign(p - pp))) AS turns FROM d GROUP BY trace)
SELECT trace, n, {r('CASE WHEN std <= 1e-12 THEN top ELSE (top - mean) / std END')} AS SNR, {r('std / mean')} AS CV, {r('log10(greatest(0.5 * n * top / total, 1e-12))')} AS TPAS,
  {r('log10(greatest(zz / (n * greatest((top - low) ** 2, 1e-12)), 1e-12))')} AS ZZ,
  {r('log10(greatest(zz / (n * greatest((top - low) ** 2, 1e-12)), 1e-12)) - log10(greatest(m_zz / (n * greatest((m_top - m_low) ** 2, 1e-12)), 1e-12))')} AS DZZ,
  {r('CASE WHEN std > 1e-12 AND m_std > 1e-12 THEN atanh(greatest(-0.999999, least(0.999999, r))) END')} AS PCC, {r('g')} AS SKEW, {r('log2(total) - ylog / total')} AS DENT, {r('move / mean')} AS DM, {r('turns / n')} AS JAG
FROM s WHERE n >= 3 AND top > 0""")
def shape(spark, sf):
    return traces.shape(P.traces(spark, sf))


@query("A12_histogram_entropy", f"""WITH {_T}, s AS (SELECT trace, min(y) AS low, max(y) AS top, count(*) AS n FROM t GROUP BY trace),
c AS (SELECT trace, n, CASE WHEN top > low THEN least(floor((y - low) / (top - low) * 256), 255) ELSE 0 END AS bin, count(*) AS c FROM t JOIN s USING (trace) GROUP BY ALL)
SELECT trace, {r('abs(sum(-(c / n) * log2(c / n)))')} AS ENT FROM c GROUP BY trace""")
def a12(spark, sf):
    return traces.histogram_entropy(P.traces(spark, sf))


@query("A14_symmetry", f"""WITH {_T}, {_APEX}, d AS (SELECT trace, abs(i - apex) AS off, y FROM t JOIN a USING (trace)),
p AS (SELECT trace, off, max(y) - min(y) AS diff, sum(y) AS s FROM d WHERE off > 0 GROUP BY trace, off HAVING count(*) = 2)
SELECT trace, {r('greatest(0.0, least(1.0, 1 - sum(diff) / sum(s)))')} AS SYM FROM p GROUP BY trace""")
def a14(spark, sf):
    return traces.symmetry(P.traces(spark, sf))


@query("A16_edges", f"""WITH {_T}, {_APEX}, d AS (SELECT trace, i, y, n, top, least(n, greatest(3, round_even(0.1 * n, 0))) AS k FROM t JOIN a USING (trace))
SELECT trace, {r('greatest(median(y) FILTER (i < k), median(y) FILTER (i >= n - k)) / any_value(top)')} AS EDGE FROM d WHERE top > 0 GROUP BY trace""")
def a16(spark, sf):
    return traces.edges(P.traces(spark, sf))


_WIDTH = f"""{_T}, {_APEX}, d AS (SELECT trace, i, y, lead(y) OVER o AS nx, lag(y) OVER o AS pv, n, apex, top, 0.5 * top AS level FROM t JOIN a USING (trace) WINDOW o AS (PARTITION BY trace ORDER BY i)),
s AS (SELECT trace, n, apex, top, level, arg_max((i, y, nx), i) FILTER (y < level AND i < apex) AS l, arg_min((i, y, pv), i) FILTER (y < level AND i > apex) AS r FROM d GROUP BY ALL),
w AS (SELECT trace, n, apex, top, l[1] + (level - l[2]) / (l[3] - l[2]) AS lx, r[1] - (level - r[2]) / (r[3] - r[2]) AS rx FROM s)"""


@query("A17_widths", f"WITH {_WIDTH} SELECT trace, n, apex, {r('top')} AS top, {r('rx - lx')} AS strict, {r('coalesce(rx, n - 1) - coalesce(lx, 0)')} AS width FROM w")
def a17(spark, sf):
    return traces.widths(P.traces(spark, sf))


@query("A5_half_to_base", f"WITH {_WIDTH} SELECT trace, {r('(coalesce(rx, n - 1) - coalesce(lx, 0)) / (n - 1)')} AS H2B FROM w WHERE n > 1")
def a5(spark, sf):
    return traces.half_to_base(P.traces(spark, sf))


@query("A3_gauss_similarity", f"""WITH {_WIDTH}, g AS (SELECT t.trace, y, exp(-0.5 * ((i - apex) / greatest(coalesce((rx - lx) / 2.35482, (n - 1) / 6.0), 1e-6)) ** 2) AS g FROM t JOIN w USING (trace))
SELECT trace, {r('CASE WHEN stddev_pop(y) > 1e-12 AND stddev_pop(g) > 1e-12 THEN atanh(greatest(-0.999999, least(0.999999, corr(y, g)))) END')} AS GS FROM g GROUP BY trace""")
def a3(spark, sf):
    return traces.gauss_similarity(P.traces(spark, sf))


@query("A19_robust_baseline", f"""WITH {_T}, b AS (SELECT trace, median(y) AS baseline FROM t GROUP BY trace)
SELECT trace, {r('baseline')} AS baseline, {r('1.4826 * median(abs(y - baseline))')} AS noise FROM t JOIN b USING (trace) GROUP BY trace, baseline""")
def a19(spark, sf):
    return traces.robust_baseline(P.traces(spark, sf))


@query("A20_local_maxima", f"""WITH {_T}, d AS (SELECT *, lag(y) OVER o AS p, lead(y) OVER o AS q FROM t WINDOW o AS (PARTITION BY trace ORDER BY i))
SELECT trace, count(*) FILTER (y > 50 AND y > p AND y >= q) AS n_maxima FROM d GROUP BY trace""")
def a20(spark, sf):
    return traces.local_maxima(P.traces(spark, sf), 50)


@query("A21_triangular", f"""WITH {_T} SELECT trace, i, {r('(coalesce(lag(y, 2) OVER o, 0) + 2 * coalesce(lag(y) OVER o, 0) + 3 * y + 2 * coalesce(lead(y) OVER o, 0) + coalesce(lead(y, 2) OVER o, 0)) / 9')} AS y
FROM t WINDOW o AS (PARTITION BY trace ORDER BY i)""")
def a21(spark, sf):
    return traces.triangular(P.traces(spark, sf))


@query("A22_trimmed_baseline", f"""WITH {_T}, d AS (SELECT trace, y, row_number() OVER (PARTITION BY trace ORDER BY y, i) AS k, count(*) OVER (PARTITION BY trace) AS n FROM t),
m AS (SELECT trace, any_value(n) AS n, avg(y) AS m, stddev_pop(y) AS s FROM d WHERE k > floor(0.05 * n) AND k <= n - floor(0.05 * n) GROUP BY trace), b AS (SELECT trace, median(y) AS base FROM t GROUP BY trace),
f AS (SELECT trace, base, 1.4826 * median(abs(y - base)) AS noise FROM t JOIN b USING (trace) GROUP BY trace, base)
SELECT trace, {r('CASE WHEN n < 8 THEN base ELSE m END')} AS baseline, {r('CASE WHEN n < 8 THEN noise ELSE s END')} AS noise FROM m JOIN f USING (trace)""")
def a22(spark, sf):
    return traces.trimmed_baseline(P.traces(spark, sf))


@query("A23_derivative", f"""WITH {_T} SELECT trace, i, {r('CASE WHEN lag(y) OVER o IS NULL THEN lead(y) OVER o - y WHEN lead(y) OVER o IS NULL THEN y - lag(y) OVER o ELSE (lead(y) OVER o - lag(y) OVER o) / 2 END')} AS dy
FROM t WINDOW o AS (PARTITION BY trace ORDER BY i)""")
def a23(spark, sf):
    return traces.derivatives(P.traces(spark, sf))


# --- evaluation ------------------------------------------------------------------------------------------------------

_S = f"s AS ({P.SCORED})"
_CONF = "count(*) FILTER (score >= 0.05 AND label = 1) AS tp, count(*) FILTER (score >= 0.05 AND label = 0) AS fp, count(*) FILTER (score < 0.05 AND label = 0) AS tn, count(*) FILTER (score < 0.05 AND label = 1) AS fn"


def _q(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


_RATES = f"tp, fp, tn, fn, {r(_q('tp', 'tp + fp'))} AS precision, {r(_q('tp', 'tp + fn'))} AS recall, {r(_q('tn', 'tn + fp'))} AS specificity, {r(_q('2 * tp', '2 * tp + fp + fn'))} AS f1, {r('(' + _q('tp', 'tp + fn') + ' + ' + _q('tn', 'tn + fp') + ') / 2')} AS balanced_accuracy, {r(_q('tp + tn', 'tp + fp + tn + fn'))} AS accuracy"


@query("E1_confusion", f"WITH {_S} SELECT {_RATES} FROM (SELECT {_CONF} FROM s)")
def e1(spark, sf):
    return metrics.confusion(P.scored(spark, sf), threshold=0.05)


@query("E9_confusion_by_source", f"WITH {_S} SELECT source, {_RATES} FROM (SELECT source, {_CONF} FROM s GROUP BY source)")
def e9(spark, sf):
    return metrics.confusion(P.scored(spark, sf), ["source"], 0.05)


def _rank_sql(by: str) -> str:
    part, group = (f"PARTITION BY {by} " if by else ""), (f"{by}, " if by else "")
    return f"""WITH {_S}, g AS (SELECT {group}score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY {group}score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({part}) AS np, sum(neg) OVER ({part}) AS nn FROM g WINDOW w AS ({part}ORDER BY score DESC))
SELECT {group}CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN {r('sum(neg * (tp - pos / 2.0)) / (max(np) * max(nn))')} END AS auroc,
CASE WHEN max(np) > 0 AND max(nn) > 0 THEN {r('sum(pos * tp / (tp + fp)) / max(np)')} END AS average_precision FROM c {f'GROUP BY {by}' if by else ''}"""


@query("E2_ranking", _rank_sql(""))
def e2(spark, sf):
    return metrics.ranking(P.scored(spark, sf))


@query("E12_ranking_by_source", _rank_sql("source"))
def e12(spark, sf):
    return metrics.ranking(P.scored(spark, sf), ["source"])


_SWEEP = f"""WITH {_S}, k AS (SELECT CAST(range AS DOUBLE) / 1000 AS threshold FROM range(1001)), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn FROM k CROSS JOIN s GROUP BY threshold),
x AS (SELECT *, ({_q('tp', 'tp + fn')} + {_q('tn', 'tn + fp')}) / 2 AS balanced_accuracy, {_q('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c)"""
_SWEPT = f"{r('threshold')} AS threshold, tp, fp, tn, fn, {r('balanced_accuracy')} AS balanced_accuracy, {r('f1')} AS f1 FROM x"


@query("E3_threshold_sweep", f"{_SWEEP} SELECT {_SWEPT}")
def e3(spark, sf):
    return metrics.threshold_sweep(P.scored(spark, sf))


@query("E3_best_threshold", f"{_SWEEP} SELECT {_SWEPT} ORDER BY round(balanced_accuracy, 12) DESC, round(f1, 12) DESC, round(abs(x.threshold - 0.5), 12), x.threshold LIMIT 1")
def e3_best(spark, sf):
    return metrics.best_threshold(P.scored(spark, sf))


@query("E4_calibration", f"""WITH {_S}, c AS (SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(score) AS ms, avg(label) AS p FROM s GROUP BY 1)
SELECT g.range AS bin, coalesce(n, 0) AS n, {r('ms')} AS mean_score, {r('p')} AS positive, {r('abs(ms - p)')} AS gap FROM range(10) g LEFT JOIN c ON g.range = c.bin""")
def e4(spark, sf):
    return metrics.calibration(P.scored(spark, sf))


@query("E5_losses", f"WITH {_S}, p AS (SELECT *, greatest(1e-7, least(1 - 1e-7, score)) AS q FROM s) SELECT source, count(*) AS n, {r('avg(-CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END)')} AS log_loss, {r('avg((score - label) ** 2)')} AS brier FROM p GROUP BY source")
def e5(spark, sf):
    return metrics.losses(P.scored(spark, sf), ["source"])


@query("P23_focal_loss", f"WITH {_S}, p AS (SELECT label, CASE WHEN label = 1 THEN greatest(1e-7, least(1 - 1e-7, score)) ELSE 1 - greatest(1e-7, least(1 - 1e-7, score)) END AS pt FROM s), l AS (SELECT CASE WHEN label = 1 THEN 0.25 ELSE 0.75 END * (1 - pt) ** 2.0 * -ln(pt) AS v FROM p) SELECT {r('avg(v)')} AS mean_loss, {r('sum(v)')} AS sum_loss FROM l")
def p23(spark, sf):
    return metrics.focal_loss(P.scored(spark, sf))


@query("P24_prediction_errors", f"WITH {_S} SELECT seed, source, {r('score')} AS score, label, flag, CASE WHEN score >= 0.05 THEN 'FP' ELSE 'FN' END AS error FROM s WHERE (score >= 0.05) <> (label = 1)")
def p24(spark, sf):
    return metrics.errors(P.scored(spark, sf), 0.05)


@query("E15_multiclass", f"""WITH o AS (SELECT o_orderpriority AS t, CASE WHEN o_totalprice > 100000 THEN o_orderpriority ELSE '1-URGENT' END AS g FROM orders), c AS (SELECT DISTINCT t AS class FROM o UNION SELECT g FROM o),
x AS (SELECT class, count(*) FILTER (t = class AND g = class) AS tp, count(*) FILTER (t = class) AS s, count(*) FILTER (g = class) AS g FROM c CROSS JOIN o GROUP BY class)
SELECT {r('sum(tp) / sum(s)')} AS accuracy, {r('avg(coalesce(2.0 * tp / nullif(s + g, 0), 0))')} AS macro_f1, count(*) AS n_classes FROM x""")
def e15(spark, sf):
    o = P.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("t"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).otherwise("1-URGENT").alias("g"))
    return metrics.multiclass(o, "t", "g")


_IOU = "(greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_PAIRS = f"""SELECT a.sample, a.ord AS target, b.ord AS prediction, b.score, coalesce({_IOU} / nullif((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IOU}, 0), 0) AS iou,
greatest(abs(a.x1 - b.x1), abs(a.y1 - b.y1), abs(a.x2 - b.x2), abs(a.y2 - b.y2)) AS far FROM ({P.BOXES}) a JOIN ({P.BOXES}) b ON a.sample = b.sample AND a.target AND NOT b.target"""


@query("J13_box_iou", f"SELECT sample, {r('target')} AS target, {r('prediction')} AS prediction, {r('score')} AS score, {r('iou')} AS iou, {r('far')} AS far FROM ({_PAIRS})")
def j13(spark, sf):
    return metrics.box_pairs(P.boxes(spark, sf))


@query("J15_best_targets", f"SELECT sample, {r('prediction')} AS prediction, {r('x[2]')} AS target, {r('x[1]')} AS iou FROM (SELECT sample, prediction, arg_max((iou, target), (iou, -target)) AS x FROM ({_PAIRS}) GROUP BY ALL) WHERE x[1] >= 0.3")
def j15(spark, sf):
    return metrics.best_targets(P.boxes(spark, sf))


@query("E14_kept_by_threshold", f"SELECT {r('t')} AS threshold, count(*) AS n_boxes, count(DISTINCT sample) AS n_samples FROM ({P.BOXES}) b JOIN (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.95]) AS t) ON score >= CAST(t AS DOUBLE) WHERE NOT target GROUP BY t")
def e14(spark, sf):
    return metrics.kept_by_threshold(P.boxes(spark, sf), [0.1, 0.25, 0.5, 0.75, 0.95])


# --- audits ----------------------------------------------------------------------------------------------------------

_SEEDS = f"s AS ({P.SEEDS})"
_COUNTS = "count(*) AS n_rows, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, count(*) FILTER (label IS NULL) AS unlabelled, count(*) FILTER (flag = 1) AS flagged"


@query("G1_distribution", f"WITH {_SEEDS} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, {_COUNTS} FROM s GROUP BY {d}" for d in ("source", "domain", "label")))
def g1(spark, sf):
    return audits.distribution(P.seeds(spark, sf), ["source", "domain", "label"])


_LONG = "l AS (SELECT c_mktsegment AS batch, 'c_acctbal' AS attribute, c_acctbal AS v FROM customer UNION ALL SELECT c_mktsegment, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer)"


@query("G2_attribute_quality", f"WITH {_LONG}, e AS (SELECT batch, attribute, v FROM l UNION ALL SELECT 'all', attribute, v FROM l) SELECT batch, attribute, count(*) AS n_rows, count(v) AS finite, count(*) - count(v) AS nan, CAST(0 AS BIGINT) AS inf, {r('min(v)')} AS least, {r('quantile_cont(v, 0.25)')} AS q1, {r('median(v)')} AS median, {r('avg(v)')} AS mean, {r('quantile_cont(v, 0.75)')} AS q3, {r('max(v)')} AS most FROM e GROUP BY ALL")
def g2(spark, sf):
    return audits.attribute_quality(P.table(spark, sf, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"])


def _split(spark, sf):
    return tables.stratified_split(P.seeds(spark, sf).filter("label is not null"), "label", "seed")


_SPLIT = f"p AS (SELECT seed, source, domain, size, label, flag, CASE WHEN k <= floor(0.8 * n) THEN 'train' WHEN k <= floor((0.8 + 0.1) * n) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || CAST(seed AS VARCHAR)), seed) AS k, count(*) OVER (PARTITION BY label) AS n FROM ({P.SEEDS}) WHERE label IS NOT NULL))"


@query("X4_stratified_split", f"WITH {_SPLIT} SELECT * FROM p")
def x4(spark, sf):
    return _split(spark, sf)


@query("G3_leaks", f"""WITH {_SPLIT}, l AS (SELECT DISTINCT split, 'source' AS field, source AS value FROM p UNION ALL SELECT DISTINCT split, 'domain', domain FROM p)
SELECT a.field, a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM l a JOIN l b ON a.field = b.field AND a.value = b.value AND a.split < b.split GROUP BY ALL""")
def g3(spark, sf):
    return audits.leaks(_split(spark, sf), "split", ["source", "domain"])


@query("G4_split_summary", f"WITH {_SPLIT} SELECT split, count(*) AS n_rows, count(DISTINCT source) AS n_sources, count(*) FILTER (label = 1) AS positive, {r('avg(label)')} AS positive_rate FROM p GROUP BY split")
def g4(spark, sf):
    return audits.split_summary(_split(spark, sf), "split")


@query("G9_by_label", f"WITH {_SEEDS} SELECT label, 'size' AS attribute, count(size) AS n, {r('avg(size)')} AS mean, {r('stddev_pop(size)')} AS std, {r('median(size)')} AS median FROM s GROUP BY label")
def g9(spark, sf):
    return audits.by_label(P.seeds(spark, sf), "label", ["size"])


_ATTRS = f"l AS (SELECT 'label' AS attribute, CAST(label AS DOUBLE) AS v FROM ({P.SEEDS}) UNION ALL SELECT 'size', CAST(size AS DOUBLE) FROM ({P.SEEDS}))"


def _fit_sql(middle: str, floor: str) -> str:
    return f"WITH {_ATTRS}, m AS (SELECT attribute, {middle} AS median, count(*) - count(v) AS missing FROM l GROUP BY attribute) SELECT attribute, {r('median')} AS median, missing, {r('avg(coalesce(v, median))')} AS mean, {r(f'CASE WHEN stddev_pop(coalesce(v, median)) < {floor} THEN 1 ELSE stddev_pop(coalesce(v, median)) END')} AS scale FROM l JOIN m USING (attribute) GROUP BY attribute, median, missing"


@query("G10_fit_lower_median", _fit_sql("quantile_disc(v, 0.5)", "1e-12"))
def g10(spark, sf):
    return audits.fit(P.seeds(spark, sf), ["label", "size"])


@query("G11_fit_mean_median", _fit_sql("median(v)", "1e-8"))
def g11(spark, sf):
    return audits.fit(P.seeds(spark, sf), ["label", "size"], lower=False, floor=1e-8)


@query("P22_transform", f"SELECT seed, source, domain, flag, {r('(coalesce(size, 1500.0) - 2000.0) / 500.0')} AS size, {r('(coalesce(label, 1.0) - 0.85) / 0.35')} AS label, size IS NULL AS size_missing, label IS NULL AS label_missing FROM ({P.SEEDS})")
def p22(spark, sf):
    return audits.transform(P.seeds(spark, sf), {"size": (1500.0, 2000.0, 500.0), "label": (1.0, 0.85, 0.35)})


@query("G13_target_mean", f"""WITH {_SPLIT}, m AS (SELECT source, avg(label) AS rate FROM p WHERE split = 'train' GROUP BY source)
SELECT seed, label, {r("coalesce(rate, (SELECT avg(label) FROM p WHERE split = 'train'))")} AS score, rate IS NOT NULL AS seen FROM p LEFT JOIN m USING (source) WHERE split = 'test'""")
def g13(spark, sf):
    p = _split(spark, sf)
    return audits.target_mean(p.filter("split = 'train'"), p.filter("split = 'test'"), "source")


@query("G14_fold_macro", f"WITH {_SEEDS}, f AS (SELECT domain, avg(label) AS rate, avg(size) AS size FROM s GROUP BY domain), l AS (SELECT 'rate' AS metric, rate AS v FROM f UNION ALL SELECT 'size', size FROM f) SELECT metric, {r('avg(v)')} AS mean, {r('coalesce(stddev_samp(v), 0)')} AS std, count(*) AS n_folds FROM l GROUP BY metric")
def g14(spark, sf):
    folds = P.seeds(spark, sf).groupBy("domain").agg(F.avg("label").alias("rate"), F.avg("size").alias("size"))
    return audits.fold_macro(folds, "domain", ["rate", "size"])


@query("G15_group_rollup", f"""WITH {_SEEDS} SELECT size AS grp, count(*) AS members, array_to_string(list_sort(list_distinct(list(CAST(seed AS VARCHAR)))), '|') AS seeds, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources,
coalesce(array_to_string(list_sort(list_distinct(list(CAST(label AS VARCHAR)) FILTER (label IS NOT NULL))), '|'), '') AS labels, count(DISTINCT label) > 1 AS conflict FROM s GROUP BY size HAVING count(*) > 1""")
def g15(spark, sf):
    return audits.group_rollup(P.seeds(spark, sf), "size")


@query("G16_counts_per_sample", f"SELECT sample, count(*) FILTER (target) AS n_target, count(*) FILTER (NOT target) AS n_predicted FROM ({P.BOXES}) GROUP BY sample")
def g16(spark, sf):
    return P.boxes(spark, sf).groupBy("sample").agg(F.count_if("target").alias("n_target"), F.count_if(~F.col("target")).alias("n_predicted"))


@query("G17_crossing_groups", f"WITH {_SEEDS} SELECT source AS grp, count(DISTINCT domain) AS n_domains FROM s GROUP BY source HAVING count(DISTINCT domain) > 1")
def g17(spark, sf):
    return audits.crossing(P.seeds(spark, sf), "source", "domain")


@query("G18_non_finite", f"SELECT count(*) FILTER (label IS NULL) AS label, count(*) FILTER (size IS NULL) AS size FROM ({P.SEEDS})")
def g18(spark, sf):
    return audits.non_finite(P.seeds(spark, sf), ["label", "size"])


@query("G8_class_balance", f"WITH {_SEEDS} SELECT source, label, count(*) AS n, {r('avg(flag)')} AS flag_rate FROM s GROUP BY source, label")
def g8(spark, sf):
    return P.seeds(spark, sf).groupBy("source", "label").agg(F.count("*").alias("n"), F.avg("flag").alias("flag_rate"))


@query("P18_violations", "SELECT o_orderkey AS key, unnest(list_filter([CASE WHEN o_totalprice < 400000 THEN NULL ELSE 'price' END, CASE WHEN o_orderstatus IN ('O', 'F') THEN NULL ELSE 'status' END], lambda x: x IS NOT NULL)) AS rule FROM orders")
def p18(spark, sf):
    rules: dict[str, Column] = {"price": F.col("o_totalprice") < 400000, "status": F.col("o_orderstatus").isin("O", "F")}
    return audits.violations(P.table(spark, sf, "orders"), rules, "o_orderkey")


_LINE = "sha256(concat_ws('|', coalesce(CAST(seed AS VARCHAR), '<NA>'), coalesce(source, '<NA>'), coalesce(CAST(label AS VARCHAR), '<NA>')))"


@query("S9_split_digest", f"WITH {_SPLIT} SELECT split, count(*) AS n_rows, " + ", ".join(f"CAST(sum(CAST('0x' || substr({_LINE}, {1 + 12 * k}, 12) AS BIGINT)) AS BIGINT) AS digest_{k}" for k in range(4)) + " FROM p GROUP BY split")
def s9(spark, sf):
    return audits.digest(_split(spark, sf), "split", ["seed", "source", "label"])


# --- tables ----------------------------------------------------------------------------------------------------------


@query("T1_top_per_source", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_quantity, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 20")
def t1(spark, sf):
    d = P.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    best = range_join.top_by(d, "l_suppkey", [F.col("l_extendedprice").desc(), F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 20)
    return tables.exactly(best, "l_suppkey", 20)


@query("T2_sample_per_source", "SELECT o_orderkey, o_orderpriority, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('17:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rank FROM orders) WHERE rank <= 50")
def t2(spark, sf):
    return tables.sample_per(P.table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", 50, 17).select("o_orderkey", "o_orderpriority", "rank")


@query("T4_sample_per_stratum", f"WITH {_SEEDS} SELECT seed, source, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5('3:' || CAST(seed AS VARCHAR)), seed) AS rank FROM s) WHERE rank <= 2")
def t4(spark, sf):
    return tables.sample_per(P.seeds(spark, sf), ["source", "label"], "seed", 2, 3).select("seed", "source", "label", "rank")


@query("T6_sequential_ids", "SELECT o_orderkey, 'PTL-' || lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 6, '0') AS number FROM orders")
def t6(spark, sf):
    return tables.numbered(P.table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "PTL-").select("o_orderkey", "number")


@query("U2_first_by_key", "SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem) WHERE k = 1")
def u2(spark, sf):
    return tables.first_of(P.table(spark, sf, "lineitem"), ["l_partkey"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]).select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("U3_replace_groups", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey NOT IN (1, 2, 3) UNION ALL SELECT c_custkey, c_nationkey, 0.0 FROM customer WHERE c_nationkey IN (1, 2, 3)")
def u3(spark, sf):
    c = P.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return tables.replace_groups(c, c.filter("c_nationkey in (1, 2, 3)").withColumn("c_acctbal", F.lit(0.0)), "c_nationkey")


@query("U4_append_batch", "SELECT s_suppkey AS id, s_acctbal AS v FROM supplier UNION ALL SELECT -1 - c_custkey, c_acctbal FROM customer")
def u4(spark, sf):
    return tables.append_new(P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")), P.table(spark, sf, "customer").select((-1 - F.col("c_custkey")).alias("id"), F.col("c_acctbal").alias("v")), "id")


@query("U5_keyed_update", "SELECT p_partkey, p_size, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_size <> 10")
def u5(spark, sf):
    p = P.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    changes = p.filter("p_size > 25").withColumn("p_retailprice", F.col("p_retailprice") * 2)
    return tables.update(p, changes, p.filter("p_size = 10"), "p_partkey", ["p_retailprice"])


@query("X3_leave_one_domain_out", f"WITH {_SEEDS} SELECT seed, domain, fold, CASE WHEN domain = fold THEN 'test' ELSE 'train' END AS part FROM s CROSS JOIN (SELECT DISTINCT domain AS fold FROM s)")
def x3(spark, sf):
    return tables.leave_one_out(P.seeds(spark, sf).select("seed", "domain"), "domain")


@query("X6_source_in_two_splits", f"WITH {_SPLIT} SELECT source AS grp, count(DISTINCT split) AS n_domains FROM p GROUP BY source HAVING count(DISTINCT split) > 1")
def x6(spark, sf):
    return audits.crossing(_split(spark, sf), "source", "split")


@query("J16_regression_compare", f"SELECT attribute, count(*) AS compared, count(*) FILTER (abs(a - b) > 1e-8 + 1e-6 * abs(b)) AS mismatches, count(*) FILTER (a <> b) AS inexact, {r('max(abs(a - b))')} AS greatest FROM (SELECT 'p_retailprice' AS attribute, p_retailprice AS a, CASE WHEN p_size % 7 = 0 THEN p_retailprice + 0.5 ELSE p_retailprice END AS b FROM part) GROUP BY attribute")
def j16(spark, sf):
    p = P.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    new = p.withColumn("p_retailprice", F.when(F.col("p_size") % 7 == 0, F.col("p_retailprice") + 0.5).otherwise(F.col("p_retailprice")))
    return tables.compare(p, new, "p_partkey", ["p_retailprice"])


@query("J17_missing_keys", "SELECT DISTINCT o_custkey AS key, 'left' AS only_in FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j17(spark, sf):
    return tables.missing_keys(P.table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), P.table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), "key")


@query("J7_dimension_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j7(spark, sf):
    c, n, g = (P.table(spark, sf, t) for t in ("customer", "nation", "region"))
    return tables.lookup(tables.lookup(c, n, "c_nationkey", "n_nationkey"), g, "n_regionkey", "r_regionkey").select("c_custkey", "n_name", "r_name")


@query("J8_label_merge", f"SELECT seed, source, coalesce(label, -1) AS label, label IS NOT NULL AS labelled FROM ({P.SEEDS})")
def j8(spark, sf):
    return P.seeds(spark, sf).select("seed", "source", F.coalesce("label", F.lit(-1)).alias("label"), F.col("label").isNotNull().alias("labelled"))


@query("S12_stale_sources", "SELECT o_custkey AS source, CAST(count(*) AS BIGINT) AS fingerprint FROM orders GROUP BY o_custkey HAVING count(*) <> count(*) FILTER (o_totalprice < 300000)")
def s12(spark, sf):
    o = P.table(spark, sf, "orders")
    now = o.groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("fingerprint"))
    before = o.groupBy(F.col("o_custkey").alias("source")).agg(F.count_if(F.col("o_totalprice") < 300000).alias("fingerprint"))
    return tables.stale(now, before, "source")


@query("S3_scan_source", "SELECT l_suppkey AS source, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS scan, count(*) AS n_peaks, list_sort(list(round(l_extendedprice / 100, 6))) AS mz FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL")
def s3(spark, sf):
    d = P.table(spark, sf, "lineitem").filter("l_returnflag = 'A'")
    return d.groupBy(F.col("l_suppkey").alias("source"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("scan")).agg(F.count("*").alias("n_peaks"), F.sort_array(F.collect_list(F.round(F.col("l_extendedprice") / 100, 6))).alias("mz"))
