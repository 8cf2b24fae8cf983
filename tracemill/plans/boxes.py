"""Registered queries of edges confirmed by shape, standardised boxes and updates from boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peaks, standardize
from ..sources import proxies as P
from .queries import query, r

SECONDS = 6.0  # scans of the proxy are 1.2 seconds apart

#: Tops of chromatograms: trace, box, i, x, y, n.
_TOPS = f"""e AS ({P.EICS}), sz AS (SELECT trace, count(*) AS n FROM e GROUP BY trace), nb AS (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS q FROM e WINDOW w AS (PARTITION BY trace ORDER BY i)),
tops AS (SELECT trace, CAST(row_number() OVER (PARTITION BY trace ORDER BY i) AS INTEGER) AS box, i, x, y, n FROM nb JOIN sz USING (trace) WHERE y > 30 AND y > p AND y >= q)"""


def _tops(spark, sf):
    e = P.eics(spark, sf)
    n = e.groupBy("trace").agg(F.count("*").alias("n"))
    return peaks.maxima(e, 30, "x").join(n, "trace").select("trace", F.col("peak").alias("box"), "i", "x", "y", "n")


def _shape_sql(edges: str) -> str:
    """CTEs that judge the edges (trace, box, side, edge, apex) of a CTE by the chromatograms e and sz; the last is `shaped`."""
    reach, dir_ = SECONDS / 60, "CASE WHEN side = 'left' THEN -1 ELSE 1 END"
    return f"""sm AS (SELECT trace, i, x, n, CASE WHEN n < 5 THEN y ELSE (coalesce(lag(y, 2) OVER w, first_value(y) OVER a) + 2 * coalesce(lag(y) OVER w, first_value(y) OVER a) + 3 * y + 2 * coalesce(lead(y) OVER w, last_value(y) OVER a) + coalesce(lead(y, 2) OVER w, last_value(y) OVER a)) / 9 END AS s
  FROM e JOIN sz USING (trace) WINDOW w AS (PARTITION BY trace ORDER BY i), a AS (PARTITION BY trace ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
gap AS (SELECT trace, median(g) AS spacing FROM (SELECT trace, x - lag(x) OVER (PARTITION BY trace ORDER BY i) AS g FROM e) GROUP BY trace),
ex AS (SELECT {edges}.*, x AS xa, s AS top FROM {edges} JOIN sm ON sm.trace = {edges}.trace AND i = apex),
pt AS (SELECT ex.*, sm.i, sm.x, sm.s, sm.n, (sm.i - apex) * {dir_} AS p, abs(sm.x - edge) AS away, (sm.x - edge) * {dir_} > 0 AS outw FROM ex JOIN sm USING (trace)),
st AS (SELECT trace, box, side, quantile_cont(s, 0.2) FILTER (abs(x - xa) <= 1) AS base, median(s) FILTER (abs(x - xa) <= 1) AS mid, arg_min(p, (away, i)) AS po, arg_min(s, (away, i)) AS so FROM pt GROUP BY trace, box, side),
lo AS (SELECT trace, box, side, median(s) AS ml FROM pt JOIN st USING (trace, box, side) WHERE abs(x - xa) <= 1 AND s <= mid GROUP BY trace, box, side),
sg AS (SELECT trace, box, side, 1.4826 * median(abs(s - ml)) AS sigma FROM pt JOIN st USING (trace, box, side) JOIN lo USING (trace, box, side) WHERE abs(x - xa) <= 1 AND s <= mid GROUP BY trace, box, side),
cf AS (SELECT pt.*, base, po, so, greatest(top - base, 1e-12) AS h, least(0.05, greatest(0.01, 4 * sigma / greatest(top - base, 1e-12))) AS share, greatest(0.25 * sigma, 0.00025 * top, 1e-12) AS z, lag(s) OVER o AS inn, lead(s) OVER o AS nx, lead(s, 2) OVER o AS nx2
  FROM pt JOIN st USING (trace, box, side) JOIN sg USING (trace, box, side) WINDOW o AS (PARTITION BY trace, box, side ORDER BY p)),
cs AS (SELECT *, sum(CASE WHEN s - inn <= z THEN 1 ELSE 0 END) OVER w AS nf, sum(CASE WHEN s - inn >= -z THEN 1 ELSE 0 END) OVER w AS nr, avg(CASE WHEN s - inn <= z THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY trace, box, side ORDER BY p ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS tail
  FROM cf WHERE p > 0 WINDOW w AS (PARTITION BY trace, box, side ORDER BY p)),
og AS (SELECT trace, box, side, nf AS nfo, nr AS nro, nx - inn AS slope FROM cs WHERE p = po AND nx IS NOT NULL),
ft AS (SELECT cs.*, slope, CASE WHEN p = po THEN 1.0 WHEN outw THEN (nf - nfo) / CAST(abs(p - po) AS DOUBLE) ELSE (nro - nr) / CAST(abs(p - po) AS DOUBLE) END AS smooth, greatest(so - base, 0) / h AS zo, so - s AS gain FROM cs JOIN og USING (trace, box, side)),
ok AS (SELECT *, CASE WHEN slope < -z THEN outw WHEN slope > z THEN NOT outw ELSE TRUE END AS wanted FROM ft WHERE away <= {reach} + 1e-12 AND i BETWEEN 1 AND n - 2 AND s <= inn AND s <= nx AND s <= base + share * h AND tail >= 0.7 AND nx >= s - z AND coalesce(nx2, nx) >= s - z
  AND CASE WHEN outw THEN smooth >= 0.8 AND zo <= least(0.03, share + 0.01) AND gain / h >= greatest(z / h, 0.08 * greatest(zo, 1e-12)) AND greatest(nx, coalesce(nx2, nx)) - s >= z ELSE smooth >= 0.75 AND gain > z END),
bs AS (SELECT trace, box, side, arg_min((x, away, outw), (away, s, i)) FILTER (wanted) AS b FROM ok GROUP BY trace, box, side),
shaped AS (SELECT trace, box, side, edge, CASE WHEN n < 5 THEN 'few_points' WHEN po <= 0 THEN 'past_apex' WHEN og.slope IS NULL THEN 'at_end' WHEN bs.trace IS NULL THEN 'no_minimum' WHEN b IS NULL THEN 'against_slope' WHEN b[2] <= greatest(0.25 * coalesce(spacing, 0), 1e-12) THEN 'already_there' WHEN b[3] THEN 'outward' ELSE 'inward' END AS reason, b[1] AS bx
  FROM {edges} JOIN sz USING (trace) JOIN st USING (trace, box, side) LEFT JOIN og USING (trace, box, side) LEFT JOIN bs USING (trace, box, side) LEFT JOIN gap USING (trace))"""


@query("A29_shape_edges", f"""WITH {_TOPS}, ed AS (SELECT trace, box, 'left' AS side, x - (3 + (i + trace) % 9) * CAST(0.02 AS DOUBLE) + 0.003 AS edge, i AS apex FROM tops UNION ALL SELECT trace, box, 'right', x + (3 + (i * 2 + trace) % 9) * CAST(0.02 AS DOUBLE) - 0.004, i FROM tops), {_shape_sql('ed')}
SELECT trace, box, side, {r("CASE WHEN reason IN ('outward', 'inward') THEN bx ELSE edge END")} AS rt, reason IN ('outward', 'inward') AS moved, reason FROM shaped""")
def a29(spark, sf):
    t = _tops(spark, sf)
    end = lambda name, edge: F.struct(F.lit(name).alias("side"), edge.alias("edge"))
    left = F.col("x") - (3 + (F.col("i") + F.col("trace")) % 9) * 0.02 + 0.003
    right = F.col("x") + (3 + (F.col("i") * 2 + F.col("trace")) % 9) * 0.02 - 0.004
    edges = t.select("trace", "box", F.col("i").alias("apex"), F.explode(F.array(end("left", left), end("right", right))).alias("e")).select("trace", "box", "e.side", "e.edge", "apex")
    return standardize.shape_edges(P.eics(spark, sf), edges, SECONDS)


_DRAWN = f"dr AS (SELECT trace, box, CASE WHEN (trace + i) % 5 = 0 THEN 'OUT_FIG' ELSE 'True_Peak' END AS label, x - (2 + (i + trace) % 10) * CAST(0.02 AS DOUBLE) + 0.003 AS rl, x + (2 + (2 * i + trace) % 10) * CAST(0.02 AS DOUBLE) - 0.004 AS rh, n * CAST(0.01 AS DOUBLE) AS c FROM tops)"


def _drawn(spark, sf):
    i, t = F.col("i"), F.col("trace")
    return _tops(spark, sf).select(
        "trace", "box", F.when((t + i) % 5 == 0, "OUT_FIG").otherwise("True_Peak").alias("label"), (F.col("x") - (2 + (i + t) % 10) * 0.02 + 0.003).alias("lo"), (F.col("x") + (2 + (2 * i + t) % 10) * 0.02 - 0.004).alias("hi"), (F.col("n") * 0.01).alias("center")
    )


@query("A34_standardised_boxes", f"""WITH {_TOPS}, {_DRAWN},
bx AS (SELECT *, least(greatest(c - 1, rl), least(c + 1, rh)) AS lo, greatest(greatest(c - 1, rl), least(c + 1, rh)) AS hi, CASE WHEN label = 'OUT_FIG' THEN CASE WHEN abs(rl - (c - 1)) <= abs(c + 1 - rh) THEN 'left' ELSE 'right' END END AS pin FROM dr),
pk AS (SELECT trace, box, coalesce(arg_max((i, x, y), (y, -i)) FILTER (x BETWEEN lo AND hi), arg_min((i, x, y), (abs(x - (lo + hi) / 2), i))) AS pk FROM bx JOIN e USING (trace) GROUP BY trace, box),
b AS (SELECT bx.*, pk[1] AS apex, pk[2] AS px, pk[3] AS py FROM bx JOIN pk USING (trace, box)),
nbr AS (SELECT trace, box, hi, apex, py, lead(box) OVER w AS box2, lead(apex) OVER w AS apex2, lead(py) OVER w AS py2, lead(lo) OVER w AS lo2 FROM b WINDOW w AS (PARTITION BY trace ORDER BY apex, box)),
vl AS (SELECT nbr.trace, box, box2, any_value(hi) AS hi, any_value(lo2) AS lo2, least(any_value(py), any_value(py2)) AS under, min(y) AS vy, arg_min(x, (y, i)) AS vx FROM nbr JOIN e ON e.trace = nbr.trace AND i > apex AND i < apex2 WHERE apex2 - apex > 1 GROUP BY nbr.trace, box, box2),
v AS (SELECT * FROM vl WHERE vy < under AND abs(vx - hi) <= {SECONDS / 60} + 1e-12 AND abs(vx - lo2) <= {SECONDS / 60} + 1e-12), vs AS (SELECT trace, box, 'right' AS side, vx FROM v UNION ALL SELECT trace, box2, 'left', vx FROM v),
ae AS (SELECT trace, box, 'left' AS side, lo AS edge, apex, coalesce(pin = 'left', FALSE) AS pinned, c - 1 AS plot FROM b UNION ALL SELECT trace, box, 'right', hi, apex, coalesce(pin = 'right', FALSE), c + 1 FROM b),
av AS (SELECT ae.*, vx FROM ae LEFT JOIN vs USING (trace, box, side)), ed AS (SELECT trace, box, side, edge, apex FROM av WHERE NOT pinned AND vx IS NULL), {_shape_sql('ed')},
en AS (SELECT av.trace, av.box, av.side, CASE WHEN pinned THEN plot WHEN vx IS NOT NULL THEN vx WHEN reason IN ('outward', 'inward') THEN bx ELSE av.edge END AS rt, CASE WHEN pinned THEN 'pinned' WHEN vx IS NOT NULL THEN 'shared_valley' ELSE reason END AS why FROM av LEFT JOIN shaped USING (trace, box, side)),
nw AS (SELECT trace, box, max(rt) FILTER (side = 'left') AS nl, max(rt) FILTER (side = 'right') AS nh, max(why) FILTER (side = 'left') AS wl, max(why) FILTER (side = 'right') AS wh FROM en GROUP BY trace, box),
f1 AS (SELECT b.*, wl, wh, nl >= px OR nh <= px AS crosses, greatest(c - 1, least(c + 1, CASE WHEN nl >= px OR nh <= px THEN lo ELSE nl END)) AS q1, greatest(c - 1, least(c + 1, CASE WHEN nl >= px OR nh <= px THEN hi ELSE nh END)) AS q2 FROM b JOIN nw USING (trace, box)),
f2 AS (SELECT * EXCLUDE (q1, q2), least(q1, q2) AS nl, greatest(q1, q2) AS nh FROM f1),
ap AS (SELECT trace, box, arg_max((x, y), (y, -i)) FILTER (x BETWEEN nl AND nh) AS a FROM f2 JOIN e USING (trace) GROUP BY trace, box),
f3 AS (SELECT f2.*, a IS NULL AS none, coalesce(a[1], px) AS ax, coalesce(a[2], py) AS ay FROM f2 JOIN ap USING (trace, box)),
f4 AS (SELECT *, NOT (nl < ax AND ax < nh) AS bound FROM f3),
f5 AS (SELECT *, CASE WHEN bound THEN lo ELSE nl END AS l, CASE WHEN bound THEN hi ELSE nh END AS h, CASE WHEN bound THEN px ELSE ax END AS fx, CASE WHEN bound THEN py ELSE ay END AS fy FROM f4)
SELECT trace, box, label, {r('l')} AS lo, {r('h')} AS hi, {r('fx')} AS apex_rt, {r('fy')} AS height, CASE WHEN bound THEN 'rolled_back' ELSE wl END AS left_reason, CASE WHEN bound THEN 'rolled_back' ELSE wh END AS right_reason, CASE WHEN bound THEN 'apex_at_bound' WHEN crosses THEN 'crosses_apex' END AS rolled_back,
  array_to_string(list_filter([CASE WHEN bound THEN 'apex_at_bound' END, CASE WHEN crosses THEN 'crosses_apex' END, CASE WHEN (coalesce(pin, '') <> 'left' AND abs(l - lo) * 60 > {SECONDS} + 1e-6) OR (coalesce(pin, '') <> 'right' AND abs(h - hi) * 60 > {SECONDS} + 1e-6) THEN 'moved_too_far' END, CASE WHEN fy <= 0 THEN 'no_height' END, CASE WHEN none THEN 'no_scans' END], lambda k: k IS NOT NULL), ',') AS review FROM f5""")
def a34(spark, sf):
    return standardize.standardised(P.eics(spark, sf), _drawn(spark, sf), SECONDS)


_FEATURES = f"fe AS (SELECT trace AS feature, CASE trace % 11 WHEN 3 THEN 'b' WHEN 5 THEN 'gone' ELSE 'a' END AS source, count(*) * CAST(0.01 AS DOUBLE) + trace % 3 * 0.1 AS rt, trace % 7 AS k7, trace % 5 AS k5 FROM e GROUP BY trace)"


def _noted(spark, sf):
    """Features with bounds, annotations in pixels of a plot of 800, and sources."""
    t = F.col("feature")
    f = P.eics(spark, sf).groupBy(F.col("trace").alias("feature")).agg(F.count("*").alias("n"))
    rt = F.col("n") * 0.01 + t % 3 * 0.1
    features = f.select("feature", F.when(t % 11 == 3, "b").when(t % 11 == 5, "gone").otherwise("a").alias("source"), rt.alias("RT"), (rt - 0.1).alias("RTmin"), (rt + 0.1).alias("RTmax"))
    left = F.when(t % 5 != 0, 330 + t * 37 % 100)
    notes = f.select("feature", F.when(t % 7 == 1, F.array(F.lit("d"))).when(t % 7 == 2, F.array(F.lit("D"))).otherwise(F.array(F.lit("True_Peak"))).alias("labels"), left.alias("x_left"), (left + t * 13 % 120).alias("x_right"), F.lit(800).alias("width"))
    sources = spark.createDataFrame([("a", 10), ("b", 0)], "source string, n_scans int")
    return features, P.eics(spark, sf), notes, sources


@query("A28_box_report", f"""WITH e AS ({P.EICS}), {_FEATURES}, bb AS (SELECT *, CASE WHEN k5 <> 0 THEN 330 + feature * 37 % 100 END AS xl, CASE WHEN k5 <> 0 THEN 330 + feature * 37 % 100 + feature * 13 % 120 END AS xr FROM fe),
cc AS (SELECT *, greatest(rt - 1, least(rt + 1, rt - 1 + xl / CAST(800 AS DOUBLE) * 2)) AS lo, greatest(rt - 1, least(rt + 1, rt - 1 + xr / CAST(800 AS DOUBLE) * 2)) AS hi FROM bb),
nn AS (SELECT feature, arg_min((i, x), (abs(x - lo), i)) AS l, arg_min((i, x), (abs(x - hi), i)) AS h FROM cc JOIN e ON trace = feature GROUP BY feature),
ss AS (SELECT cc.*, l, h, CASE WHEN source = 'gone' THEN 'skip_missing_source' WHEN source = 'b' THEN 'skip_no_scans' WHEN k7 = 2 THEN 'deleted_delete_label' WHEN xl IS NULL THEN CASE WHEN k7 = 1 THEN 'uncertain_no_box_keep_original' ELSE 'fallback_original_no_box' END
  WHEN xr - xl <= 4.5 OR (h[2] - l[2]) * 60 <= 1 OR h[1] - l[1] + 1 < 3 THEN CASE WHEN k7 = 1 THEN 'uncertain_tiny_box_keep_original' ELSE 'skip_tiny_box_keep_original' END ELSE CASE WHEN k7 = 1 THEN 'uncertain_updated_from_box' ELSE 'updated_from_box' END END AS status FROM cc JOIN nn USING (feature))
SELECT feature, status, CASE WHEN k7 <> 1 AND (status NOT LIKE 'skip%' OR status LIKE 'skip_tiny%') AND status NOT LIKE 'deleted%' THEN CASE WHEN xl IS NULL THEN 0 ELSE 1 END END AS is_true_peak, CASE WHEN status LIKE '%\\_box%' ESCAPE '\\' AND xl IS NOT NULL THEN h[1] - l[1] + 1 END AS box_scan_count,
  {r("CASE WHEN status LIKE '%_box%' AND xl IS NOT NULL THEN l[2] END")} AS box_RTmin, {r("CASE WHEN status LIKE '%_box%' AND xl IS NOT NULL THEN h[2] END")} AS box_RTmax FROM ss""")
def a28_report(spark, sf):
    return standardize.box_report(*_noted(spark, sf)).select("feature", "status", "is_true_peak", "box_scan_count", "box_RTmin", "box_RTmax")


@query("A28_box_update")
def a28(spark, sf):
    return standardize.update_from_boxes(*_noted(spark, sf))
