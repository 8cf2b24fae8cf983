"""Registered queries of whole jobs on tables: attribute windows, label merges, detector tables, audits, stores and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attributes, audits, metrics, normalize, peaks, range_join, records, splits, standardize, tables, traces  # noqa: F401
from ..operators.shared import shared_folder
from ..sources import files
from ..sources import proxies as P
from .boxes import _DRAWN, _TOPS, SECONDS, _drawn
from .jobs import _ATTRIBUTES, _NAMES
from .queries import SQL, query, r

_WINDOWED = f"""fe AS (SELECT feature, source, CASE WHEN feature % 13 <> 0 THEN mz END AS mz, tol, lo + 60 AS RT, CASE feature % 4 WHEN 0 THEN NULL WHEN 1 THEN hi ELSE lo END AS RTmin, CASE feature % 4 WHEN 0 THEN NULL WHEN 1 THEN lo ELSE hi END AS RTmax FROM ({P.FEATURES})),
fw AS (SELECT feature, source, mz, tol, CASE WHEN RTmin IS NULL THEN RT - 80 ELSE least(RTmin, RTmax) END AS lo, CASE WHEN RTmin IS NULL THEN RT + 80 ELSE greatest(RTmin, RTmax) END AS hi FROM fe WHERE mz IS NOT NULL), sp AS ({P.SCAN_PEAKS}),
hit AS (SELECT feature, scan, arg_min(p.intensity, (abs(p.mz - f.mz), p.mz, ord)) AS y FROM fw f JOIN sp p ON f.source = p.source AND p.mz BETWEEN f.mz - f.tol AND f.mz + f.tol GROUP BY feature, scan),
gr AS (SELECT f.feature, s.scan FROM fw f JOIN (SELECT DISTINCT source, scan FROM sp) s ON f.source = s.source AND s.scan BETWEEN f.lo AND f.hi), pts AS (SELECT feature, scan AS x, coalesce(y, 0) AS y FROM gr LEFT JOIN hit USING (feature, scan))"""


@query("A18_feature_table", f"WITH {_WINDOWED}, {_ATTRIBUTES} SELECT f.feature, f.source, round(f.mz, 6) + 0.0 AS mz, {_NAMES} FROM fw f LEFT JOIN a USING (feature)")
def a18_table(spark, sf):
    k = F.col("feature") % 4
    f = P.features(spark, sf).select(
        "feature", "source", F.when(F.col("feature") % 13 != 0, F.col("mz")).alias("mz"), "tol", (F.col("lo") + 60).alias("RT"), F.when(k == 1, F.col("hi")).when(k != 0, F.col("lo")).alias("RTmin"), F.when(k == 1, F.col("lo")).when(k != 0, F.col("hi")).alias("RTmax")
    )
    return attributes.peak_attributes(attributes.windows(f, 80.0), P.scan_peaks(spark, sf), method="nearest")


_LONG = ", ".join(f"{{'attribute': '{c}', 'v': {c}}}" for c in attributes.ATTRIBUTES)


@query("E12_univariate", f"""WITH pts AS (SELECT trace AS feature, i AS x, y FROM ({P.TRACES})), {_ATTRIBUTES},
uw AS (SELECT f.feature, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS label, {_NAMES} FROM (SELECT DISTINCT feature FROM pts) f JOIN customer ON c_custkey = f.feature LEFT JOIN a USING (feature)),
ug AS (SELECT feature, label, u.attribute AS attribute, u.v AS v FROM (SELECT feature, label, unnest([{_LONG}]) AS u FROM uw)), md AS (SELECT attribute, coalesce(median(v) FILTER (feature % 5 <> 0), 0) AS m FROM ug GROUP BY attribute),
uz AS (SELECT attribute, label, round(coalesce(v, m), 6) AS s FROM ug JOIN md USING (attribute) WHERE feature % 5 = 0), uk AS (SELECT attribute, label, rank() OVER (PARTITION BY attribute ORDER BY s) + (count(*) OVER (PARTITION BY attribute, s) - 1) / 2.0 AS rk FROM uz),
un AS (SELECT attribute, sum(label) AS np, count(*) - sum(label) AS nn, sum(rk) FILTER (label = 1) AS sr FROM uk GROUP BY attribute), uq AS (SELECT attribute, (sr - np * (np + 1) / 2.0) / (np * nn) AS raw FROM un)
SELECT attribute, {r('raw')} AS raw_auc, {r('greatest(raw, 1 - raw)')} AS direction_free_auc, CAST(rank() OVER (ORDER BY round(greatest(raw, 1 - raw), 9) DESC) AS INTEGER) AS rank FROM uq""")
def e12_univariate(spark, sf):
    a = attributes.attributes(P.traces(spark, sf).select(F.col("trace").alias("feature"), F.col("i").alias("x"), "y"))
    a = a.select("feature", *(F.round(c, 6).alias(c) for c in attributes.ATTRIBUTES))
    c = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("feature"), (F.col("c_acctbal") > 4500).cast("int").alias("label"))
    d = a.join(c, "feature").withColumn("split", F.when(F.col("feature") % 5 == 0, "test").otherwise("train"))
    return attributes.univariate(d, "label", list(attributes.ATTRIBUTES))


# --- labels ----------------------------------------------------------------------------------------------------------

_WORD = "CASE event_type WHEN 'click' THEN ' TRUE ' WHEN 'error' THEN 'fp' WHEN 'view' THEN '是' WHEN 'signup' THEN '0' ELSE '?' END"
_NOTES = f"nt AS (SELECT CASE WHEN event_id % 17 = 0 THEN ' ' ELSE ' ' || user_id END AS id, {_WORD} AS word, event_id FROM events), nv AS (SELECT trim(id) AS id, event_id, CASE WHEN lower(trim(word)) IN ('true', '是') THEN 1 WHEN lower(trim(word)) IN ('fp', '0') THEN 0 END AS v FROM nt WHERE trim(id) <> ''), lb AS (SELECT id, arg_max(v, event_id) AS v FROM nv WHERE v IS NOT NULL GROUP BY id), mg AS (SELECT c_custkey, c_mktsegment, coalesce(v, CASE WHEN c_custkey % 3 = 0 THEN 1 END) AS label, v FROM customer LEFT JOIN lb ON id = CAST(c_custkey AS VARCHAR))"


def _merge(spark, sf):
    rows = P.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.concat(F.col("c_custkey").cast("string"), F.lit(" ")).alias("id"), F.when(F.col("c_custkey") % 3 == 0, 1).alias("label"))
    e = F.col("event_type")
    word = F.when(e == "click", " TRUE ").when(e == "error", "fp").when(e == "view", "是").when(e == "signup", "0").otherwise("?")
    notes = P.table(spark, sf, "events").select(F.when(F.col("event_id") % 17 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("id"), word.alias("word"), "event_id")
    return tables.label_merge(rows, notes, "id", "label", normalize.label_value("word"), order="event_id")


@query("J8_merged_labels", f"WITH {_NOTES} SELECT c_custkey, c_mktsegment, label FROM mg")
def j8_merged(spark, sf):
    return _merge(spark, sf)[0].select("c_custkey", "c_mktsegment", "label")


@query("J8_invalid_notes", f"WITH {_NOTES} SELECT event_id FROM nv WHERE v IS NULL")
def j8_invalid(spark, sf):
    return _merge(spark, sf)[1].select("event_id")


@query("J8_merge_counts", f"WITH {_NOTES} SELECT (SELECT count(*) FROM lb) AS annotation_valid, (SELECT count(*) FROM nv WHERE v IS NULL) AS annotation_invalid, count(v) AS rows_updated, count(*) FILTER (label IN (0, 1)) AS labelled_rows, count(*) FILTER (label = 1) AS true_rows, count(*) FILTER (label = 0) AS false_rows FROM mg")
def j8_counts(spark, sf):
    return _merge(spark, sf)[2]


@query("J8_folder_labels", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 1 WHEN p_size < 10 OR p_retailprice > 1500 THEN 0 ELSE NULL END AS label FROM part")
def j8_folders(spark, sf):
    p = P.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("id"), F.lit(None).cast("int").alias("label"))
    return tables.folder_labels(p, p.filter("p_size > 40"), p.filter("p_size < 10 or p_retailprice > 1500"), "id", "label").select("p_partkey", "label")


@query("P13_label_changes", "SELECT conv_id, count(*) FILTER (role IN ('user', 'system')) AS n_changed FROM conversations GROUP BY conv_id")
def p13_changes(spark, sf):
    c = P.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return c.select("conv_id", normalize.changed_labels("roles", {"user": "Peak", "system": "Other"}).alias("n_changed"))


_FLAGS = "fl AS (SELECT o_orderkey AS image, list(DISTINCT CASE l_returnflag WHEN 'A' THEN 'True_Peak' WHEN 'N' THEN 'OUT_FIG' ELSE 'd' END) FILTER (l_linenumber > 1) AS ls FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey), fx AS (SELECT image, coalesce(ls, []) AS ls FROM fl)"


@query("P15_states", f"""WITH {_FLAGS} SELECT image, CASE WHEN list_contains(ls, 'True_Peak') AND list_contains(ls, 'd') THEN 'conflict' WHEN list_contains(ls, 'True_Peak') THEN 'true' WHEN list_contains(ls, 'd') THEN 'false' WHEN len(ls) = 0 THEN 'false_empty' ELSE 'unresolved' END AS sorted,
CASE WHEN len(ls) = 0 THEN 'no_box' WHEN list_contains(ls, 'OUT_FIG') THEN 'delete' WHEN list_contains(ls, 'd') THEN 'uncertain' ELSE 'box' END AS boxed, CASE WHEN list_contains(ls, 'True_Peak') AND list_contains(ls, 'OUT_FIG') THEN 'positive_with_out_fig' WHEN list_contains(ls, 'True_Peak') THEN 'positive' WHEN list_contains(ls, 'OUT_FIG') THEN 'out_fig_only' ELSE 'negative' END AS plot FROM fx""")
def p15_states(spark, sf):
    l = P.table(spark, sf, "lineitem")
    name = F.when(F.col("l_returnflag") == "A", "True_Peak").when(F.col("l_returnflag") == "N", "OUT_FIG").otherwise("d")
    d = P.table(spark, sf, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_orderkey").alias("image")).agg(F.collect_set(F.when(F.col("l_linenumber") > 1, name)).alias("ls"))
    return d.select("image", normalize.sorted_state("ls", ("True_Peak",), ("d",), True).alias("sorted"), normalize.box_state("ls", ("OUT_FIG",), ("d",)).alias("boxed"), normalize.plot_state("ls").alias("plot"))


_SAMPLE_ID = "CASE WHEN p_size % 5 = 0 THEN 'file_' || p_partkey ELSE 'file__' || p_brand || '__' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '__P' || lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE '' END END"


@query("P28_id_parts", f"SELECT 'NEW::' || s AS id, CASE WHEN len(string_split(s, '__')) >= 3 THEN string_split(s, '__')[2] ELSE 'UNPARSED' END AS difficulty, TRY_CAST(nullif(regexp_extract(s, '__P([0-9]+)$', 1), '') AS INTEGER) AS box_index FROM (SELECT {_SAMPLE_ID} AS s FROM part)")
def p28_parts(spark, sf):
    box = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("__P"), F.lpad(F.col("p_size").cast("string"), 2, "0"))).otherwise("")
    s = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("file_"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("file__"), "p_brand", F.lit("__"), F.col("p_partkey").cast("string"), box))
    return P.table(spark, sf, "part").select(s.alias("s")).select(*normalize.id_parts("s", "NEW"))


# --- detector tables -------------------------------------------------------------------------------------------------


@query("P3_xcms_table", f"SELECT 'F' || p_partkey AS Feature_ID, {r('round_even(p_retailprice * 1.0000127, 4)')} AS mz, {r('round_even((p_size - 0.371) / 60, 3)')} AS RTmin, {r('round_even(p_size / 60, 3)')} AS RT, {r('round_even((p_size + 0.413) / 60, 3)')} AS RTmax, p_size AS npeaks, {r('p_retailprice')} AS maxo, coalesce(CASE WHEN p_size % 3 <> 0 THEN CAST(p_partkey AS DOUBLE) END, 0) AS \"a.mzML\" FROM part")
def p3_table(spark, sf):
    size = F.col("p_size")
    d = P.table(spark, sf, "part").select(
        F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("Feature_ID"), (F.col("p_retailprice") * 1.0000127).alias("mzmed"), (size - 0.371).alias("rtmin"), size.cast("double").alias("rtmed"), (size + 0.413).alias("rtmax"), size.alias("npeaks"),
        F.col("p_retailprice").alias("maxo"), F.when(size % 3 != 0, F.col("p_partkey").cast("double")).alias("a.mzML"), F.lit("x").alias("other"),
    )
    return normalize.xcms_table(d)


_OPENMS = "om AS (SELECT p_partkey AS Feature_ID, p_retailprice AS mz, p_size * 11.0::DOUBLE AS RT, CASE WHEN p_size % 7 = 0 THEN 1.7e308::DOUBLE ELSE p_size * 11.0::DOUBLE - p_partkey % 5 END AS a, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size * 11.0::DOUBLE + 3 - p_partkey % 6 END AS b, p_retailprice - 0.01 AS c, p_retailprice + 0.0101 AS d, p_brand FROM part), os AS (SELECT max(RT) > 200 AS s FROM om), ok AS (SELECT *, CASE WHEN s THEN 1.0::DOUBLE / 60 ELSE 60.0::DOUBLE END AS f, abs(a) <= 1e300 AND a <= b AS good FROM om, os)"


@query("P5_openms_table", f"WITH {_OPENMS} SELECT Feature_ID, {r('round_even(mz, 4)')} AS mz, {r('round_even(c, 4)')} AS mzmin, {r('round_even(d, 4)')} AS mzmax, {r('round_even(RT * f, 3)')} AS RT, {r('round_even(CASE WHEN good THEN a * f END, 3)')} AS RTmin, {r('round_even(CASE WHEN good THEN b * f END, 3)')} AS RTmax, p_brand FROM ok")
def p5_table(spark, sf):
    rt, k = F.col("p_size") * 11.0, F.col("p_partkey")
    d = P.table(spark, sf, "part").select(
        k.alias("Feature_ID"), F.col("p_retailprice").alias("mz"), rt.alias("RT"), F.when(F.col("p_size") % 7 == 0, 1.7e308).otherwise(rt - k % 5).alias("RTstart"), F.when(F.col("p_size") % 11 != 0, rt + 3 - k % 6).alias("RTend"),
        (F.col("p_retailprice") - 0.01).alias("MZstart"), (F.col("p_retailprice") + 0.0101).alias("MZend"), F.lit(1).alias("charge"), "p_brand",
    )
    return normalize.openms_table(d)


@query("P9_pool_table", f"SELECT 'run.v2.mzML' AS source_file, 'data/run.v2.mzML' AS source_path, 'run.v2__F' || p_partkey AS Feature_ID, {r('round_even(p_retailprice, 4)')} AS mz, {r('round_even(p_size / 7 - 0.1, 3)')} AS RTmin, {r('round_even(p_size / 7, 3)')} AS RT, {r('round_even(p_size / 7 + 0.1, 3)')} AS RTmax, NULL AS SNR, CASE WHEN p_size > 30 THEN 1 END AS is_true_peak FROM part WHERE p_size % 6 <> 0 AND p_size % 5 <> 0")
def p9_table(spark, sf):
    size = F.col("p_size")
    d = P.table(spark, sf, "part").select(
        F.lit("run.v2.mzML").alias("source_file"), F.lit("data/run.v2.mzML").alias("source_path"), F.when(size % 6 == 0, " ").otherwise(F.concat(F.lit(" F"), F.col("p_partkey").cast("string"))).alias("Feature_ID"),
        F.when(size % 5 != 0, F.col("p_retailprice").cast("string")).otherwise("NA").alias("mz"), (size / 7).alias("RT"), F.when(size > 30, 1).alias("is_true_peak"),
    )
    return normalize.pool_rows(d, ("SNR",))


# --- boxes and traces ------------------------------------------------------------------------------------------------


@query("P25_best_boxes", "SELECT sample, count(*) FILTER (k IS NOT NULL) AS num_boxes, CASE WHEN count(k) > 0 THEN 1 ELSE 0 END AS has_peak, " + ", ".join(f"round(max({c}) FILTER (k = {j}), 6) + 0.0 AS box{j}_{c}" for j in (1, 2) for c in ("x1", "y1", "x2", "y2", "score")) + f" FROM (SELECT *, CASE WHEN NOT target AND score >= 0.2 THEN row_number() OVER (PARTITION BY sample ORDER BY CASE WHEN NOT target AND score >= 0.2 THEN 0 ELSE 1 END, score DESC, ord) END AS k FROM ({P.BOXES})) GROUP BY sample")
def p25_boxes(spark, sf):
    return peaks.best_boxes(P.boxes(spark, sf), 0.2)


@query("A23_derivatives", f"""WITH e AS ({P.EICS}), a AS (SELECT *, x - lag(x) OVER w AS hs, lead(x) OVER w - x AS hd, y - lag(y) OVER w AS fs, lead(y) OVER w - y AS fd FROM e WINDOW w AS (PARTITION BY trace ORDER BY i)), b AS (SELECT trace, i, x, y, coalesce((fs / hs * hd + fd / hd * hs) / (hs + hd), fd / hd, fs / hs, 0) AS d1, hs, hd FROM a),
c AS (SELECT *, d1 - lag(d1) OVER w AS gs, lead(d1) OVER w - d1 AS gd FROM b WINDOW w AS (PARTITION BY trace ORDER BY i)) SELECT trace, i, {r('x')} AS x, {r('y')} AS y, {r('d1')} AS d1, {r('coalesce((gs / hs * hd + gd / hd * hs) / (hs + hd), gd / hd, gs / hs, 0)')} AS d2 FROM c""")
def a23_derivatives(spark, sf):
    return traces.slopes(P.eics(spark, sf))


_FILTER = lambda c: f"CASE WHEN count(*) < 5 OR max({c}) <= 1e-12 OR coalesce(median({c}) FILTER ({c} <= 0.05 * {c}_top), median({c})) <= 1e-12 THEN 1e-4 ELSE coalesce(median({c}) FILTER ({c} <= 0.05 * {c}_top), median({c})) END"


@query("A23_noise_filters", f"""WITH e AS ({P.EICS}), a AS (SELECT *, x - lag(x) OVER w AS hs, lead(x) OVER w - x AS hd, y - lag(y) OVER w AS fs, lead(y) OVER w - y AS fd FROM e WINDOW w AS (PARTITION BY trace ORDER BY i)), b AS (SELECT trace, i, hs, hd, abs(fd) AS af, abs(coalesce((fs / hs * hd + fd / hd * hs) / (hs + hd), fd / hd, fs / hs, 0)) AS ff FROM a),
c AS (SELECT *, ff - lag(ff) OVER w AS gs, lead(ff) OVER w - ff AS gd FROM b WINDOW w AS (PARTITION BY trace ORDER BY i)), d AS (SELECT trace, af, ff, abs(coalesce((gs / hs * hd + gd / hd * hs) / (hs + hd), gd / hd, gs / hs, 0)) AS sf FROM c), f AS (SELECT *, max(af) OVER t AS af_top, max(ff) OVER t AS ff_top, max(sf) OVER t AS sf_top FROM d WINDOW t AS (PARTITION BY trace))
SELECT trace, {r(_FILTER('af'))} AS af, {r(_FILTER('ff'))} AS ff, {r(_FILTER('sf'))} AS sf FROM f GROUP BY trace""")
def a23_noise(spark, sf):
    return traces.noise_filters(P.eics(spark, sf))


@query("A31_plot_windows", f"WITH {_TOPS}, z AS (SELECT trace, min(x) AS x0, max(x) AS x9 FROM e GROUP BY trace), f AS (SELECT trace * 1000 + box AS feature, trace, greatest(t.x + 0.1 - 0.3, x0) AS lo, least(t.x + 0.1 + 0.3, x9) AS hi FROM tops t JOIN z USING (trace)) SELECT feature, f.trace, i, {r('e.x')} AS x, {r('y')} AS y FROM f JOIN e ON e.trace = f.trace AND e.x >= lo AND e.x <= hi")
def a31_windows(spark, sf):
    e = P.eics(spark, sf)
    n = peaks.maxima(e.select("trace", "i", "y"), 30).join(e.select("trace", "i", "x"), ["trace", "i"])
    return peaks.plot_windows(e, n.select((F.col("trace") * 1000 + F.col("peak")).alias("feature"), "trace", (F.col("x") + 0.1).alias("RT")), 0.6)


_SEEDED = "sd AS (SELECT trace * 1000 + box AS seed, trace, x + 0.013 AS rt, x - (i % 7) * CAST(0.02 AS DOUBLE) - 0.005 AS lo, x + (trace % 5) * CAST(0.02 AS DOUBLE) - 0.005 AS hi FROM tops)"


def _seeded(spark, sf):
    e = P.eics(spark, sf)
    t = peaks.maxima(e.select("trace", "i", "y"), 30).join(e.select("trace", "i", "x"), ["trace", "i"])
    return t.select((F.col("trace") * 1000 + F.col("peak")).alias("seed"), "trace", (F.col("x") + 0.013).alias("rt"), (F.col("x") - (F.col("i") % 7) * 0.02 - 0.005).alias("lo"), (F.col("x") + (F.col("trace") % 5) * 0.02 - 0.005).alias("hi"))


@query("G19_seed_diagnostics", f"""WITH {_TOPS}, {_SEEDED}, d AS (SELECT seed, rt, lo, hi, i, x, y FROM sd JOIN e USING (trace)), s AS (SELECT seed, lo, hi, coalesce(quantile_cont(y, 0.2) FILTER (abs(x - rt) <= 1), quantile_cont(y, 0.2)) AS base, arg_min(y, (abs(x - rt), i)) AS own, count(*) FILTER (x BETWEEN lo AND hi) AS n, arg_max((i, x, y), (y, -i)) FILTER (x BETWEEN lo AND hi) AS top, min(i) FILTER (x BETWEEN lo AND hi) AS first FROM d GROUP BY seed, lo, hi),
t AS (SELECT seed, (greatest(y - base, 0) + lag(greatest(y - base, 0)) OVER w) / 2 * (x - lag(x) OVER w) * 60 AS strip FROM d JOIN s USING (seed) WHERE x BETWEEN d.lo AND d.hi WINDOW w AS (PARTITION BY seed ORDER BY i)), a AS (SELECT seed, sum(strip) AS area FROM t GROUP BY seed)
SELECT seed, {r('greatest(0, (hi - lo) * 60)')} AS width_sec, {r('top[3]')} AS height, {r('top[2]')} AS height_rt, {r('CASE WHEN n >= 2 THEN area WHEN n = 1 THEN 0 END')} AS area, {r('CASE WHEN n > 0 THEN own END')} AS seed_intensity,
CASE WHEN n = 0 THEN TRUE ELSE top[1] - first <= least(2, n // 5) OR top[1] - first >= n - 1 - least(2, n // 5) END AS max_at_edge, n AS point_count FROM s LEFT JOIN a USING (seed)""")
def g19_seeds(spark, sf):
    return peaks.seed_diagnostics(P.eics(spark, sf), _seeded(spark, sf))


@query("J11_seed_relations", f"WITH {_TOPS}, {_SEEDED}, p AS (SELECT trace, box AS peak, x AS apex, x - (2 + i % 4) * CAST(0.02 AS DOUBLE) AS l, x + (1 + i % 3) * CAST(0.02 AS DOUBLE) AS h FROM tops), j AS (SELECT seed, peak, h >= lo AND l <= hi AS overlap, h >= lo AND l <= hi AND apex BETWEEN lo AND hi AS core, rt >= l - 0.05 AND rt <= h + 0.05 AS anchor FROM sd JOIN p USING (trace)) SELECT * FROM j WHERE overlap OR anchor")
def j11_relations(spark, sf):
    e = P.eics(spark, sf)
    t = peaks.maxima(e.select("trace", "i", "y"), 30).join(e.select("trace", "i", "x"), ["trace", "i"])
    found = t.select("trace", "peak", F.col("x").alias("apex"), (F.col("x") - (2 + F.col("i") % 4) * 0.02).alias("lo"), (F.col("x") + (1 + F.col("i") % 3) * 0.02).alias("hi"))
    return peaks.seed_relations(_seeded(spark, sf), found, 0.05)


# --- audits ----------------------------------------------------------------------------------------------------------

_Q = {"min": 0, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "max": 1}
_quantiles = lambda table, c, section: " UNION ALL ".join(f"SELECT '{section}', '{k}', CAST(quantile_cont({c}, {q}) AS DOUBLE) FROM {table}" for k, q in _Q.items())
_counts = lambda pairs: " UNION ALL ".join(f"SELECT 'counts', '{k}', CAST({v} AS DOUBLE) FROM n" for k, v in pairs.items())


@query("G5_full_audit", f"""WITH s AS (SELECT o_orderkey AS sample, o_custkey AS source, o_orderpriority AS study, o_clerk_ AS instrument, label, a1, a2, sub FROM (SELECT *, o_custkey % 7 AS o_clerk_, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS label, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS a1, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS a2, CASE WHEN o_custkey % 2 = 0 THEN ['even', 'all', 'all'] ELSE ['all'] END AS sub FROM orders)),
b AS (SELECT sample, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, (y2 - y1) / (x2 - x1) AS ratio FROM ({P.BOXES}) WHERE target), n AS (SELECT s.*, coalesce(k, 0) AS boxes FROM s LEFT JOIN (SELECT sample, count(*) AS k FROM b GROUP BY sample) USING (sample)), out(section, name, value) AS (
{_counts({'total': 'count(*)', 'unique_source_files': 'count(DISTINCT source)', 'unique_studies': 'count(DISTINCT study)', 'unique_instruments': 'count(DISTINCT instrument)', 'empty_images': 'count(*) FILTER (boxes = 0)', 'single_box_images': 'count(*) FILTER (boxes = 1)', 'multi_box_images': 'count(*) FILTER (boxes >= 2)', 'total_boxes': 'sum(boxes)', 'positive': 'count(*) FILTER (label = 1)', 'negative': 'count(*) - count(*) FILTER (label = 1)', 'positive_fraction': 'round_even(count(*) FILTER (label = 1) / count(*), 6)'})}
UNION ALL SELECT 'missing', 'a1', CAST(count(*) - count(a1) AS DOUBLE) FROM n UNION ALL SELECT 'missing', 'a2', CAST(count(*) - count(a2) AS DOUBLE) FROM n UNION ALL SELECT 'attributes', 'total_missing', CAST(2 * count(*) - count(a1) - count(a2) AS DOUBLE) FROM n UNION ALL SELECT 'attributes', 'missing_fraction', round_even((2 * count(*) - count(a1) - count(a2)) / (2 * count(*)), 6) FROM n
UNION ALL SELECT 'subset', u, CAST(count(*) AS DOUBLE) FROM (SELECT unnest(list_distinct(sub)) AS u FROM n) GROUP BY u UNION ALL {_quantiles('n', 'boxes', 'boxes_per_image')} UNION ALL {_quantiles('b', 'width', 'width')} UNION ALL {_quantiles('b', 'height', 'height')} UNION ALL {_quantiles('b', 'area', 'area')} UNION ALL {_quantiles('b', 'ratio', 'height_over_width')}) SELECT section, name, {r('value')} AS value FROM out""")
def g5_full(spark, sf):
    o, k = P.table(spark, sf, "orders"), F.col("o_orderkey")
    s = o.select(k.alias("sample"), F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("study"), (F.col("o_custkey") % 7).alias("instrument"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("label"),
                 F.when(k % 5 != 0, F.col("o_totalprice")).alias("a1"), F.when(k % 9 != 0, F.col("o_totalprice")).alias("a2"), F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("even"), F.lit("all"), F.lit("all"))).otherwise(F.array(F.lit("all"))).alias("subsets"))
    return audits.manifest_audit(s, P.boxes(spark, sf).filter("target"), ["a1", "a2"])


@query("G7_label_inventory", "WITH s AS (SELECT l_orderkey AS document, CASE l_returnflag WHEN 'A' THEN ' peak ' WHEN 'N' THEN 'OUT_FIG' ELSE 'odd' END AS label FROM lineitem WHERE l_quantity > 20), n AS (SELECT CASE WHEN trim(label) = 'peak' THEN 'True_Peak' ELSE trim(label) END AS name FROM s), p AS (SELECT o_orderkey, count(document) AS k FROM orders LEFT JOIN s ON document = o_orderkey GROUP BY o_orderkey) SELECT CASE WHEN name IN ('True_Peak', 'OUT_FIG') THEN 'known' ELSE 'unknown' END AS kind, name, count(*) AS n FROM n GROUP BY name UNION ALL SELECT 'documents_with_shapes', CAST(k AS VARCHAR), count(*) FROM p GROUP BY k UNION ALL SELECT 'empty_documents', '', count(*) FILTER (k = 0) FROM p")
def g7_inventory(spark, sf):
    flag = F.col("l_returnflag")
    s = P.table(spark, sf, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("document"), F.when(flag == "A", " peak ").when(flag == "N", "OUT_FIG").otherwise("odd").alias("label"))
    return audits.label_inventory(s, P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("document")), ["True_Peak", "OUT_FIG"], {"peak": "True_Peak"})


@query("G15_group_members", f"WITH s AS ({P.SEEDS}) SELECT size AS grp, seed, source, label FROM s WHERE size IN (SELECT size FROM s GROUP BY size HAVING count(*) > 1)")
def g15_members(spark, sf):
    return audits.group_members(P.seeds(spark, sf), "size")


@query("U6_task_export", f"WITH s AS ({P.SEEDS}), c AS (SELECT seed, source FROM s WHERE label IS NULL ORDER BY md5('4:' || seed), CAST(seed AS VARCHAR) LIMIT 120) SELECT CAST(seed AS VARCHAR) AS Feature_ID, 'img/' || page_id || '.png' AS image, '' AS is_true_peak, '' AS annotator, '' AS comment, source AS source_file, NULL AS mz, NULL AS RT FROM c JOIN pages ON page_id = seed")
def u6_tasks(spark, sf):
    s = P.seeds(spark, sf).select(F.col("seed").cast("string").alias("id"), F.col("source").alias("source_file"), "label", F.lit(None).cast("double").alias("mz"), F.lit(None).cast("double").alias("RT"))
    images = P.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("stem"), F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".png")).alias("image"))
    return tables.annotation_tasks(s, images, "id", "label", most=120, seed=4, drop_missing=True)


_PREDICTED = f"s AS ({P.SCORED}), p AS (SELECT seed, CASE WHEN seed % 50 = 7 THEN 1 - label ELSE label END AS label, CASE WHEN seed % 31 = 3 THEN NULL ELSE score END AS score FROM s WHERE seed % 10 <> 0 UNION ALL SELECT seed, label, score FROM s WHERE seed % 40 = 1 UNION ALL SELECT -1 - seed, label, score FROM s WHERE seed % 25 = 2), k AS (SELECT seed, count(*) AS n, max(label) AS got, max(score) AS score FROM p GROUP BY seed), j AS (SELECT coalesce(s.seed, k.seed) AS seed, s.label AS want, k.got, k.score, k.n, s.seed IS NOT NULL AS t FROM s FULL JOIN k ON s.seed = k.seed)"


@query("E13_full_audit", f"""WITH {_PREDICTED}, g AS (SELECT want AS label, score FROM j WHERE t AND n > 0 AND score IS NOT NULL), a AS (SELECT (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM g)),
c("check", value) AS (SELECT 'repeated_ids', count(*) FILTER (n > 1) FROM j UNION ALL SELECT 'missing_ids', count(*) FILTER (t AND n IS NULL) FROM j UNION ALL SELECT 'unexpected_ids', count(*) FILTER (NOT t) FROM j UNION ALL SELECT 'non_finite_scores', count(*) FILTER (t AND n > 0 AND score IS NULL) FROM j UNION ALL SELECT 'label_disagreements', count(*) FILTER (t AND n > 0 AND want <> got) FROM j UNION ALL SELECT 'auroc_drift', abs(auc - 0.5) FROM a) SELECT "check", {r('CAST(value AS DOUBLE)')} AS value, CASE WHEN value <= 1e-12 THEN 'ok' ELSE 'fail' END AS status FROM c""")
def e13_full(spark, sf):
    s, k = P.scored(spark, sf), F.col("seed")
    p = s.filter("seed % 10 <> 0").select(k, F.when(k % 50 == 7, 1 - F.col("label")).otherwise(F.col("label")).alias("label"), F.when(k % 31 != 3, F.col("score")).alias("score"))
    p = p.unionByName(s.filter("seed % 40 = 1").select("seed", "label", "score")).unionByName(s.filter("seed % 25 = 2").select((-1 - k).alias("seed"), "label", "score"))
    return audits.prediction_audit(s, p, declared={"auroc": 0.5})


@query("E16_ablation_table", f"""WITH s AS ({P.SCORED}), m AS (SELECT 'size' AS model, label, score, 0.05 AS threshold FROM s UNION ALL SELECT 'constant', label, 0.85, 0.5 FROM s UNION ALL SELECT 'flag', label, CAST(coalesce(flag, 0) AS DOUBLE), 0.5 FROM s), g AS (SELECT model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM m GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC)), k AS (SELECT model, sum(neg * (tp - pos / 2.0)) / (max(np) * max(nn)) AS auroc, sum(pos * tp / (tp + fp)) / max(np) AS ap FROM c GROUP BY model),
b AS (SELECT model, avg((score - label) ** 2) AS brier, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM m GROUP BY model)
SELECT model, {r('auroc')} AS auroc, {r('ap')} AS average_precision, {r('brier')} AS brier, {r('coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0)')} AS f1, CAST(row_number() OVER (ORDER BY round(auroc, 9) DESC, round(ap, 9) DESC, model) AS INTEGER) AS place FROM k JOIN b USING (model)""")
def e16_table(spark, sf):
    s = P.scored(spark, sf)
    run = lambda name, score: s.select(F.lit(name).alias("model"), "label", score.alias("score"))
    runs = run("size", F.col("score")).unionByName(run("constant", F.lit(0.85))).unionByName(run("flag", F.coalesce("flag", F.lit(0)).cast("double")))
    t = spark.createDataFrame([("size", 0.05), ("constant", 0.5), ("flag", 0.5)], "model string, threshold double")
    return metrics.ablation(runs, t).select("model", "auroc", "average_precision", "brier", "f1", "place")


def _dataset(spark, sf):
    s, k = P.seeds(spark, sf).filter("label is not null"), F.col("seed")
    h = F.sha2(k.cast("string"), 256)
    seeds = s.select(
        F.concat(F.lit("OLD::"), k.cast("string")).alias("seed_id"), F.when(k % 70 == 5, "IMG-5").otherwise(F.concat(F.lit("IMG-"), k.cast("string"))).alias("image_id"), F.when(k % 90 == 4, F.concat(F.lit("/abs/"), k.cast("string"))).otherwise(F.concat(F.lit("images/"), k.cast("string"), F.lit(".png"))).alias("image"),
        F.concat(F.lit("images/"), k.cast("string"), F.lit(".json")).alias("annotation_json"), h.alias("image_sha256"), F.sha2(F.concat(F.lit("j"), k.cast("string")), 256).alias("annotation_sha256"), "label", (F.col("flag") == 1).alias("exclude_from_test"),
        "source", F.concat_ws("-", "domain", "size").alias("split_group_id"), F.when(k % 33 == 2, float("inf")).otherwise(F.col("size").cast("double")).alias("SNR"), "size",
    )
    peaks_ = s.filter("size > 800").select(F.concat(F.lit("P"), k.cast("string")).alias("peak_id"), F.when(k % 60 == 8, "OLD::none").otherwise(F.concat(F.lit("OLD::"), k.cast("string"))).alias("seed_id"), F.lit("True_Peak").alias("label"), F.lit(1.0).alias("SNR"))
    files_ = seeds.filter(F.crc32("seed_id") % 40 != 1).select(F.col("image").alias("path"), F.when(F.crc32("seed_id") % 50 == 2, "bad").otherwise(F.col("image_sha256")).alias("sha256")).unionByName(seeds.select(F.col("annotation_json").alias("path"), F.col("annotation_sha256").alias("sha256")))
    shapes = s.filter("size > 800").select(F.concat(F.lit("OLD::"), k.cast("string")).alias("seed_id"), F.lit("True_Peak").alias("label"))
    split = seeds.select("seed_id", F.when(F.crc32("seed_id") % 10 == 0, "test").when(F.crc32("seed_id") % 10 == 1, "val").otherwise("train").alias("split"))
    return seeds, peaks_, files_, shapes, split


@query("V1_dataset_checks")
def v1_dataset(spark, sf):
    seeds, peaks_, files_, shapes, split = _dataset(spark, sf)
    lock = audits.digest(split.join(seeds.select("seed_id", "label"), "seed_id"), "split", ["seed_id", "label"])
    return audits.verify(seeds, peaks_, files_, shapes, split, ["SNR"], ["seed_id", "image_id", "image", "image_sha256", "split_group_id"], {}, lock)


_V1 = f"""s AS (SELECT seed, label, size, flag, 'OLD::' || seed AS seed_id, CASE WHEN seed % 70 = 5 THEN 'IMG-5' ELSE 'IMG-' || seed END AS image_id, CASE WHEN seed % 90 = 4 THEN '/abs/' || seed ELSE 'images/' || seed || '.png' END AS image, domain || '-' || size AS grp, CASE WHEN seed % 4 = 0 THEN 'test' WHEN seed % 4 = 1 THEN 'val' ELSE 'train' END AS split FROM ({P.SEEDS}) WHERE label IS NOT NULL),
sl AS (SELECT image_id, grp, split FROM s UNION ALL SELECT image_id, grp, 'train' FROM s WHERE seed % 50 = 9), p AS (SELECT 'P' || seed AS peak_id, CASE WHEN seed % 60 = 8 THEN 'OLD::none' ELSE seed_id END AS seed_id FROM s WHERE size > 800)"""
_LEAK = lambda f, a, b: f"(SELECT count(*) FROM (SELECT {f} FROM sl GROUP BY {f} HAVING bool_or(split = '{a}') AND bool_or(split = '{b}')))"
_V1_CHECKS = {
    "seed_id_repeats": "0", "image_id_repeats": "(SELECT count(*) FROM (SELECT image_id FROM s GROUP BY image_id HAVING count(*) > 1))", "peak_id_repeats": "0", "peaks_of_unknown_seeds": "(SELECT count(DISTINCT seed_id) FROM p WHERE seed_id NOT IN (SELECT seed_id FROM s))",
    "seeds_not_in_one_split": "(SELECT count(*) FROM s WHERE seed % 50 = 9)", "splits_of_unknown_seeds": "0", "missing_files": "(SELECT count(*) FROM s WHERE seed % 40 = 1)", "orphan_files": "(SELECT count(*) FROM s WHERE seed % 45 = 3)",
    "hash_mismatches": "(SELECT count(*) FROM s WHERE seed % 50 = 2 AND seed % 40 <> 1)", "shapes_unlike_peaks": "(SELECT count(*) + least(count(*), 1) FROM s WHERE size > 800 AND seed % 60 = 8)",
    **{f"leak_{n}_{a}_{b}": _LEAK(f, a, b) for n, f in (("image_id", "image_id"), ("split_group_id", "grp")) for a, b in audits.PAIRS},
    "seed_rows": "(SELECT count(*) FROM s) + (SELECT count(*) FROM s WHERE seed % 50 = 9)", "seeds_of_label_1": "(SELECT count(*) FILTER (label = 1) + count(*) FILTER (label = 1 AND seed % 50 = 9) FROM s)", "seeds_of_label_0": "(SELECT count(*) FILTER (label = 0) + count(*) FILTER (label = 0 AND seed % 50 = 9) FROM s)", "bad_labels": "0",
    "non_portable_paths": "(SELECT count(*) FILTER (seed % 90 = 4) + count(*) FILTER (seed % 90 = 4 AND seed % 50 = 9) FROM s)", "barred_rows_in_test": "(SELECT count(*) FILTER (flag = 1 AND split = 'test') FROM s)", "train_rows": "(SELECT count(*) FILTER (split = 'train') + count(*) FILTER (seed % 50 = 9) FROM s)",
    "val_rows": "(SELECT count(*) FILTER (split = 'val') FROM s)", "test_rows": "(SELECT count(*) FILTER (split = 'test') FROM s)", "seed_infinite_values": "(SELECT count(*) FILTER (seed % 33 = 2) + count(*) FILTER (seed % 33 = 2 AND seed % 50 = 9) FROM s)",
    "peak_rows": "(SELECT count(*) FROM p)", "peak_infinite_values": "0", "shape_rows": "(SELECT count(*) FROM p)", "splits_unlike_lock": "1",
}


@query("V1_failing_checks", f"WITH {_V1}, c(\"check\", value) AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)}, {v}' for k, v in _V1_CHECKS.items())}) SELECT \"check\", CAST(value AS DOUBLE) + 0.0 AS value, 0.0 AS expected, CASE WHEN value = 0 THEN 'pass' ELSE 'fail' END AS status FROM c")
def v1_failing(spark, sf):
    """Every kind of fault is planted."""
    seeds, peaks_, _, shapes, _ = _dataset(spark, sf)
    k = F.regexp_extract("seed_id", "([0-9]+)$", 1).cast("long")
    images = seeds.filter(k % 40 != 1).select(F.col("image").alias("path"), F.when(k % 50 == 2, "bad").otherwise(F.col("image_sha256")).alias("sha256"))
    files_ = images.unionByName(seeds.select(F.col("annotation_json").alias("path"), F.col("annotation_sha256").alias("sha256"))).unionByName(seeds.filter(k % 45 == 3).select(F.concat(F.lit("old/"), "image_id").alias("path"), F.lit("x").alias("sha256")).withColumn("path", F.concat("path", F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    split = seeds.select("seed_id", F.when(k % 4 == 0, "test").when(k % 4 == 1, "val").otherwise("train").alias("split"))
    lock = audits.digest(split.join(seeds.select("seed_id", "label"), "seed_id"), "split", ["seed_id", "label"])
    split = split.unionByName(seeds.filter(k % 50 == 9).select("seed_id", F.lit("train").alias("split")))
    return audits.verify(seeds, peaks_, files_, shapes, split, ["SNR"], ["image_id", "split_group_id"], {}, lock)


@query("V2_standardisation_checks", f"""WITH j AS ({SQL['J12_seed_relation']}), f AS ({SQL['A34_standardised_boxes']}), d AS (WITH {_TOPS}, {_DRAWN} SELECT trace, box, greatest(c - 1, least(c + 1, rl)) AS lo, greatest(c - 1, least(c + 1, rh)) AS hi FROM dr), b AS (SELECT *, n_matched + CASE WHEN seed % 10 = 3 THEN 1 ELSE 0 END AS linked FROM j),
c AS (SELECT 'bound_order' AS name, count(*) FILTER (NOT (seed_lo < seed_rt AND seed_rt < seed_hi)) AS value FROM j UNION ALL SELECT 'bound_move', count(*) FILTER (relation IN ('single', 'split', 'shift') AND (seed_rt - seed_lo > 6 OR seed_hi - seed_rt > 6)) FROM j UNION ALL SELECT 'label_is_match', count(*) FILTER ((relation = 'false') <> (n_matched = 0)) FROM j
UNION ALL SELECT 'highest_of_matched', count(*) FILTER ((highest IS NULL) <> (n_matched = 0)) FROM j UNION ALL SELECT 'union_holds_seed', count(*) FILTER (relation NOT IN ('false', 'shoulder') AND (union_lo > seed_lo OR union_hi < seed_hi)) FROM j
UNION ALL SELECT 'linked_peaks', count(*) FILTER (linked <> n_matched) FROM b UNION ALL SELECT 'boxes_lost', count(*) FILTER (f.box % 6 = 1 AND f.trace % 9 = 2) FROM f UNION ALL SELECT 'boxes_made', 0 UNION ALL SELECT 'moves_in_limit', count(*) FILTER ((left_reason <> 'pinned' AND abs(f.lo - d.lo) * 60 > {SECONDS} + 1e-6) OR (right_reason <> 'pinned' AND abs(f.hi - d.hi) * 60 > {SECONDS} + 1e-6)) FROM f JOIN d USING (trace, box) WHERE NOT (box % 6 = 1 AND trace % 9 = 2)
UNION ALL SELECT 'apex_between_bounds', count(*) FILTER (NOT (lo < apex_rt AND apex_rt < hi)) FROM f WHERE NOT (box % 6 = 1 AND trace % 9 = 2) UNION ALL SELECT 'unique_seeds', 0 UNION ALL SELECT 'unique_boxes', 0 UNION ALL SELECT 'seed_box_in_image', count(*) FILTER (seed % 8 = 1) FROM j) SELECT name, value, CASE WHEN value = 0 THEN 'pass' ELSE 'fail' END AS status FROM c""")
def v2_checks(spark, sf):
    from .jobs import j12

    rel = j12(spark, sf)
    links = rel.select("seed", F.explode(F.expr("sequence(1, cast(n_matched as int) + if(seed % 10 = 3, 1, 0) + 1)")).alias("peak")).filter(F.expr("peak <= n_matched + if(seed % 10 = 3, 1, 0)"))
    final = standardize.standardised(P.eics(spark, sf), _drawn(spark, sf), SECONDS).filter("not (box % 6 = 1 and trace % 9 = 2)")
    boxes = rel.select("seed", F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.when(F.col("seed") % 8 == 1, 900).otherwise(50).alias("xmax"), F.lit(60).alias("ymax"), F.lit(800).alias("width"), F.lit(600).alias("height"))
    return records.standardisation_checks(rel, links, _drawn(spark, sf), final, boxes, SECONDS, 6.0)


# --- stores and files ------------------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _computed(jobs):
    return jobs.groupBy("source").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _jobs(spark, sf):
    return P.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("job"), F.col("l_quantity").alias("value"))


def _two_runs(spark, sf):
    """A store that has all sources as they were, and is asked for them as they are: some got another hash, some lost a job, one is gone."""
    jobs, k = _jobs(spark, sf), F.col("source")
    sources = jobs.select("source").distinct().withColumn("sha256", F.sha2(k.cast("string"), 256))
    store = tables.PartStore(spark, _folder(spark, "parts"))
    store.update(jobs, sources, "source", "job", _computed)
    later = jobs.filter("source <> 2").filter(~((k % 5 == 3) & F.col("job").endswith("-1")))
    return store.update(later, sources.withColumn("sha256", F.when(k % 7 == 0, "new").otherwise(F.col("sha256"))), "source", "job", _computed)


_LATER = "lt AS (SELECT l_suppkey AS source, l_quantity AS value FROM lineitem WHERE l_suppkey <> 2 AND NOT (l_suppkey % 5 = 3 AND l_linenumber = 1))"


@query("S12_part_store", f"WITH {_LATER} SELECT source, count(*) AS n, {r('sum(value)')} AS total FROM lt GROUP BY source")
def s12_store(spark, sf):
    return _two_runs(spark, sf)[0].select("source", "n", "total")


@query("S12_recomputed", f"WITH {_LATER}, o AS (SELECT l_suppkey AS source, count(*) AS n FROM lineitem GROUP BY 1) SELECT source, count(*) AS n_jobs FROM lt JOIN o USING (source) GROUP BY source, o.n HAVING source % 7 = 0 OR count(*) <> o.n")
def s12_recomputed(spark, sf):
    return _two_runs(spark, sf)[1]


@query("S1_feature_table", f"SELECT 'F' || lpad(CAST(row_number() OVER (ORDER BY round(p_retailprice, 3), p_partkey) AS VARCHAR), 6, '0') AS Feature_ID, p_partkey AS part, {r('round(p_retailprice, 3)')} AS mz FROM part")
def s1(spark, sf):
    path = _folder(spark, "features")
    P.table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.round("p_retailprice", 3).alias("mz")).write.option("header", "true").csv(path)
    return files.feature_table(spark, path, "part long, mz double", ["mz", "part"]).select("Feature_ID", "part", "mz")


@query("S2_located_tables", "SELECT detector, p_partkey AS part FROM part, (VALUES ('fixed'), ('preferred'), ('full'), ('newest')) d(detector) WHERE p_size % 4 = CASE detector WHEN 'fixed' THEN 0 WHEN 'preferred' THEN 1 WHEN 'full' THEN 2 ELSE 3 END")
def s2(spark, sf):
    top, p = _folder(spark, "detectors"), P.table(spark, sf, "part")
    save = lambda k, path: p.filter(F.col("p_size") % 4 == k).select(F.col("p_partkey").alias("part")).coalesce(1).write.option("header", "true").csv(f"{top}/{path}")
    for k, path in ((0, "fixed/table.csv"), (1, "preferred/processed.csv"), (2, "preferred/full.csv"), (2, "full/full.csv"), (3, "newest/run")):
        save(k, path)
    found = {"fixed": files.locate(spark, f"{top}/fixed", name="table.csv"), "preferred": files.locate(spark, f"{top}/preferred", preferred="processed.csv", full="full.csv"), "full": files.locate(spark, f"{top}/full", preferred="processed.csv", full="full.csv"), "newest": files.locate(spark, f"{top}/newest/run")}
    out = None
    for name, path in found.items():
        d = spark.read.option("header", "true").schema("part long").csv(path).select(F.lit(name).alias("detector"), "part")
        out = d if out is None else out.unionByName(d)
    return out


@query("S4_S5_manifest", f"SELECT 'S' || seed AS sample_id, 'img/' || seed || '.png' AS image_path, CASE WHEN label IS NULL THEN 0 ELSE label END AS seed_label, source AS source_file, {r('size / 7')} AS first_attribute, CASE WHEN seed % 3 = 0 THEN 0 ELSE 1 END AS n_boxes FROM ({P.SEEDS})")
def s4_s5(spark, sf):
    path = _folder(spark, "manifest")
    k, s = F.col("seed"), P.seeds(spark, sf)
    box = F.array(*(F.lit(float(v)) for v in (1, 2, 30, 40)))
    rows = s.select(
        F.concat(F.lit("S"), k.cast("string")).alias("sample_id"), F.concat(F.lit("img/"), k.cast("string"), F.lit(".png")).alias("image_path"), F.when(k % 3 == 0, F.array().cast("array<array<double>>")).otherwise(F.array(box)).alias("boxes"), box.alias("seed_box"),
        F.coalesce("label", F.lit(0)).alias("seed_label"), F.concat(F.array(F.col("size") / 7), F.array_repeat(F.lit(None).cast("double"), 15)).alias("attributes"), F.col("source").alias("source_file"), F.col("domain").alias("study_id"), F.lit("i").alias("instrument_id"), F.array(F.lit("a")).alias("subsets"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"),
    )
    files.save_manifest(rows, path)
    return files.manifest(spark, path).select("sample_id", "image_path", "seed_label", "source_file", F.col("attributes")[0].alias("first_attribute"), F.size("boxes").alias("n_boxes"))


@query("S7_split_output", SQL["X4_stratified_split"])
def s7(spark, sf):
    from .queries import _split

    path = _folder(spark, "splits")
    files.save_splits(_split(spark, sf), path)
    back = spark.read.option("partitionOverwriteMode", "static").parquet(path)
    return back.withColumn("split", F.col("split").cast("string"))


@query("S8_file_hashes", "SELECT s_suppkey, 'txt' AS kind, CAST(octet_length(encode(s_name)) + 1 AS BIGINT) AS size, sha256(s_name || chr(10)) AS sha256 FROM supplier")
def s8(spark, sf):
    path = _folder(spark, "texts")
    P.table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("value")).repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey").write.partitionBy("s_suppkey").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)  # a number keeps small rows that are many files in many tasks; these move their files themselves
    h = files.hashes(spark, path, "*.txt")
    return h.select(F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).cast("long").alias("s_suppkey"), "kind", "size", "sha256")


@query("S11_resolved_sources", """WITH w AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE lower(c_name) END AS name FROM customer), i AS (SELECT c_name AS name, '/data/' || c_name AS path, CAST(c_nationkey AS VARCHAR) AS sha256 FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT lower(c_name), '/other/roots/' || c_name, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END FROM customer WHERE c_custkey % 5 = 0),
k AS (SELECT lower(name) AS k, count(DISTINCT sha256) AS n, arg_min(path, (length(path), lower(path))) AS path FROM i GROUP BY 1) SELECT c_custkey, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' ELSE 'found' END AS status FROM w LEFT JOIN k ON lower(w.name) = k""")
def s11(spark, sf):
    c, k = P.table(spark, sf, "customer"), F.col("c_custkey")
    wanted = c.select("c_custkey", F.when(k % 3 == 0, F.upper("c_name")).otherwise(F.lower("c_name")).alias("name"))
    nation = F.col("c_nationkey").cast("string")
    inventory = c.filter("c_custkey % 7 <> 0").select(F.col("c_name").alias("name"), F.concat(F.lit("/data/"), "c_name").alias("path"), nation.alias("sha256"))
    inventory = inventory.unionByName(c.filter("c_custkey % 5 = 0").select(F.lower("c_name").alias("name"), F.concat(F.lit("/other/roots/"), "c_name").alias("path"), F.when(k % 11 == 0, "x").otherwise(nation).alias("sha256")))
    return wanted.join(files.resolve(wanted, inventory), "name").select("c_custkey", "path", "status")
