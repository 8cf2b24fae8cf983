"""Attributes and boundaries: known answers, and plain Python on traces with plateaus, nulls and edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import attributes, boundaries, peaks, records

KNOWN = [
    ([0, 1, 4, 10, 4, 1, 0], 3, {"SYM": 1.0, "MOD": 0.0, "EDGE": 0.1}), ([0, 2, 12, 2, 0, 0, 8, 0, 0], 2, {"MOD": 0.375}), ([0, 0, 10, 0, 7, 0, 0], 2, {"MOD": 0.0}), ([20, 20, 20, 10, 20, 20, 20], 3, {"EDGE": 2.0}),
]


def rows_of(spark, traces):
    return spark.createDataFrame([(k, float(x), None if y is None else float(y)) for k, t in enumerate(traces) for x, y in t], "feature long, x double, y double").repartition(3)


def prominences(m):
    """Of each plateau that is a maximum inside: middle and height over the higher of its two bases."""
    out, k, n = [], 1, len(m)
    while k < n - 1:
        if m[k - 1] < m[k]:
            e = k
            while e + 1 < n and m[e + 1] == m[k]:
                e += 1
            if e + 1 < n and m[e + 1] < m[k]:
                left, right = k, e
                while left > 0 and m[left - 1] <= m[k]:
                    left -= 1
                while right + 1 < n and m[right + 1] <= m[k]:
                    right += 1
                out.append(((k + e) // 2, m[k] - max(min(m[left : k + 1]), min(m[k : right + 1]))))
            k = e
        k += 1
    return out


def brute(points):
    """SYM, MOD, EDGE, H2B, TPAS, JAG in plain Python."""
    x, y = [p[0] for p in points], [max(0.0, p[1] if p[1] is not None and not math.isnan(p[1]) else 0.0) for p in points]
    n, top = len(y), max(y)
    a, m = y.index(top), [(u + v + w) / 3 for u, v, w in zip([0.0, *y[:-1]], y, [*y[1:], 0.0])]
    k = min(a, n - 1 - a)
    left, right = [y[a - j] for j in range(1, k + 1)], [y[a + j] for j in range(1, k + 1)]
    both = sum(left) + sum(right)
    sym = 1 - sum(abs(u - v) for u, v in zip(left, right)) / both if both else 1.0
    far = [p for place, p in prominences(m) if abs(place - a) > 2]
    e = min(n, max(3, round(0.1 * n)))
    li = next((j for j in range(a - 1, -1, -1) if y[j] < top / 2), None)
    ri = next((j for j in range(a + 1, n) if y[j] < top / 2), None)
    cross = lambda i, j: x[i] + (top / 2 - y[i]) / (y[j] - y[i]) * (x[j] - x[i])
    width = (x[-1] if ri is None else cross(ri - 1, ri)) - (x[0] if li is None else cross(li, li + 1))
    s = np.sign(np.diff(y))
    return {"SYM": sym, "MOD": min(1.0, max(far, default=0.0) / m[a]), "EDGE": max(np.median(y[:e]), np.median(y[-e:])) / top, "H2B": width / (x[-1] - x[0]), "TPAS": math.log10(0.5 * n * top / sum(y)), "JAG": float(np.abs(np.diff(s)).sum()) / n}


def test_known_attributes(spark):
    for y, apex, want in KNOWN:
        got = attributes.attributes(rows_of(spark, [list(enumerate(y))]), F.lit(apex)).first()
        for c, v in want.items():
            assert got[c] == pytest.approx(v, abs=1e-9), (y, c)


def test_attributes_of_odd_traces(spark):
    rnd = random.Random(6)
    traces = [[(x * 0.5 + rnd.random() * 0.1, rnd.choice([0, 1, 1, 2, 5, 5, 9, None, -3, float("nan")])) for x in range(rnd.randint(3, 40))] for _ in range(60)]
    traces = [t for t in traces if any(y and y > 0 for _, y in t)] + [[(k, y) for k, y in enumerate(t)] for t in ([1, 1, 1], [5, 4, 3], [3, 4, 5], [0, 7, 0], [2, 2, 9, 9, 9, 2, 6, 6, 2, 6, 6, 1])]
    got = {r.feature: r for r in attributes.attributes(rows_of(spark, [*traces, [(0, 0), (1, None), (2, -1)], [(0, 5), (1, 4)]])).collect()}
    for k, t in enumerate(traces):
        for c, v in brute(t).items():
            assert got[k][c] == pytest.approx(v, abs=1e-6), (k, c, t)
    assert all(got[len(traces)][c] is None for c in attributes.ATTRIBUTES)  # no positive value
    assert got[len(traces) + 1]["SNR"] is None and got[len(traces) + 1]["EDGE"] is not None  # two points


def test_prominences(spark):
    rnd = random.Random(4)
    traces = [[(k, rnd.randint(0, 4)) for k in range(rnd.randint(1, 30))] for _ in range(50)]
    d = rows_of(spark, traces).select(F.col("feature").alias("trace"), F.col("x").cast("int").alias("i"), "y")
    got = {}
    for r in peaks.prominences(d).collect():
        got.setdefault(r.trace, []).append((r.place, r.prominence))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, t in enumerate(traces) if (w := sorted(prominences([y for _, y in t])))}


def gauss(x, mu, sigma, amp):
    return amp * np.exp(-0.5 * ((x - mu) / sigma) ** 2)


def cases():
    a, b, d, e = np.linspace(4.0, 4.4, 401), np.linspace(4.6, 5.3, 701), np.linspace(6, 8, 2001), np.linspace(3.8, 4.4, 601)
    tail = gauss(d, 7, 0.03, 260) + np.where(d > 7.03, 25 * np.exp(-(d - 7.03) / 0.25), 0)
    return {
        "local": (a, gauss(a, 4.10, 0.010, 120) + gauss(a, 4.24, 0.012, 320), 4.10, 4.08, 4.12, boundaries.Settings(search_half=0.20)),
        "recentre": (b, gauss(b, 5.0, 0.018, 240), 5.0, 4.70, 4.75, boundaries.Settings(search_half=0.30)),
        "shrink": (d, tail, 7.0, 6.95, 7.05, boundaries.Settings(search_half=0.30, expand_scans=300, expand_minutes=0.80, oversize=1.10)),
        "empty": (e, gauss(e, 4.40, 0.004, 300), 4.10, 4.08, 4.12, boundaries.Settings(search_half=0.25)),
    }


def test_known_boundaries(spark):
    found = {}
    for name, (x, y, hint, lo, hi, p) in cases().items():
        points = spark.createDataFrame([(name, float(u), float(v)) for u, v in zip(x, y)], "feature string, x double, y double").repartition(4)
        hints = spark.createDataFrame([(name, hint, lo, hi), ("none", hint, None, None)], "feature string, hint double, rtmin double, rtmax double")
        rows = {r.feature: r for r in boundaries.refined(points, hints, p).collect()}
        assert rows["none"].status == "empty_trace" and rows["none"].rtmin == hint
        found[name] = rows[name]
    local, moved, shrunk, empty = (found[k] for k in ("local", "recentre", "shrink", "empty"))
    assert local.status == "ok" and abs(local.apex_rt - 4.10) < 0.02 and local.rtmin <= 4.10 <= local.rtmax
    assert moved.status == "ok" and not moved.old_rt_in_bounds and abs(moved.apex_rt - 5.0) < 0.03 and moved.rtmin <= 5.0 <= moved.rtmax
    assert shrunk.bound_mode == "core_shrink" and shrunk.oversized_shrink and shrunk.width_sec < 80
    assert empty.status == "zero_apex" and empty.rtmin == empty.rtmax and abs(empty.apex_rt - 4.10) < 0.01


def test_walks():
    quiet = np.array([1, 1, 0, 0, 0, 0, 1, 0, 1, 1, 1], bool)
    assert boundaries.core_end(quiet, 4, 1, 2, 20) == 9 and boundaries.core_end(quiet, 4, -1, 2, 20) == 0 and boundaries.core_end(quiet, 4, 1, 2, 3) == 7
    x, p = np.arange(12.0), boundaries.Settings(expand_minutes=100)
    down = np.array([9, 7, 5, 3, 2, 1, 4, 8, 9, 9, 9, 9.0])
    assert boundaries.valley(x, down, 0, 1, 0.0, 1e-4, p) == (5, True)
    assert boundaries.valley(x, down[::-1], 11, -1, 0.0, 1e-4, p) == (6, True)
    assert boundaries.valley(x, np.array([3.0] * 12), 0, 1, 5.0, 1e-4, p) == (0, False)
    assert boundaries.valley(x, np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12.0]), 0, 1, 0.0, 1e-4, p) == (0, False)
    assert boundaries.valley(x, down, 0, 1, 0.0, 1e-4, boundaries.Settings(expand_scans=3, expand_minutes=100)) == (3, False)


def test_records(spark):
    rows = spark.createDataFrame([(1, "a.png", 1, 2, "s", "d"), (2, "b.png", 0, 0, "s", "d")], "sample_id int, image_path string, seed_label int, declared int, source_file string, study_id string")
    shapes = spark.createDataFrame([(1, "True_Peak", [3.0, 0.0, 4.0, 1.0], 2), (1, "OUT_FIG", [0.0] * 4, 1), (1, "true_peak", [1.0, 0.0, 2.0, 1.0], 0)], "sample_id int, label string, box array<double>, place int")
    got = {r.sample_id: r for r in records.record(rows, shapes, ["study_id"]).collect()}
    assert got[1].boxes == [[1.0, 0.0, 2.0, 1.0], [3.0, 0.0, 4.0, 1.0]] and got[1].subsets == ["seed_positive", "detection_multi"]
    assert got[2].boxes == [] and got[2].subsets == ["seed_negative", "detection_empty"] and got[2].metadata == {"study_id": "d"}
    with pytest.raises(Exception, match="boxes, not"):
        records.record(rows.withColumn("declared", F.lit(1)), shapes, ["study_id"]).collect()
    with pytest.raises(Exception, match="unknown"):
        rows.select(records.binary_label(F.array(F.lit("x")), ["a"], ["a"], "error")).collect()


def test_baseline_finds_what_is_there(spark):
    rnd = random.Random(1)
    rows = [(k, "test" if k % 4 == 0 else "train", k % 2, None if k % 11 == 0 else (k % 2) * 2.0 + rnd.gauss(0, 1), rnd.gauss(0, 1)) for k in range(400)]
    d = spark.createDataFrame(rows, "seed int, split string, y int, a double, b double")

    def auc(out):
        got = [(r.score, r.label) for r in out.filter("split = 'test'").collect()]
        pos, neg = [s for s, l in got if l == 1], [s for s, l in got if l == 0]
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))

    d = d.withColumn("y", F.when(F.pmod(F.xxhash64("seed"), F.lit(2)) == 0, 1 - F.col("y")).otherwise(F.col("y"))).withColumn("a", F.col("y") * 2.0 + F.col("b"))
    assert auc(records.logistic_baseline(d, "y", ["a", "b"])) > 0.9
    assert abs(auc(records.logistic_baseline(d, "y", ["a", "b"], permute=True)) - 0.5) < 0.45
