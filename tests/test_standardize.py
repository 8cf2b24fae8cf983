"""Edges confirmed by shape, shared valleys and standardised boxes against plain Python, one box at a time."""

import math
import random

import numpy as np
import pytest

from tracemill.operators import standardize as S


def traces(seed=3, many=24):
    rnd = random.Random(seed)
    out = {}
    for t in range(many):
        n, x, points = rnd.choice([3, 4, 30, 90, 140]), 0.0, []
        centres = [rnd.uniform(0, n) for _ in range(rnd.randint(1, 6))]
        for i in range(n):
            x += rnd.choice([0.012, 0.02, 0.03, 0.02, 0.003])
            y = sum(100 * math.exp(-(((i - c) / 4) ** 2)) for c in centres) + rnd.choice([0, 0, 0.2, 1]) * rnd.random()
            points.append((x, rnd.choice([y] * 40 + [None, math.inf, -2.0, math.nan]) if t % 4 == 0 else y))
        out[t] = points
    return out


def drawn(all_, seed=4):
    rnd, out = random.Random(seed), []
    for t, points in all_.items():
        middle = points[len(points) // 2][0]
        for b in range(rnd.randint(1, 5)):
            at = rnd.choice(points)[0]
            lo, hi = at - rnd.choice([0.0, 0.05, 0.1, 0.2]), at + rnd.choice([0.003, 0.06, 0.12, 0.3])
            out.append((t, b, rnd.choice(["True_Peak", "True_Peak", "OUT_FIG"]), lo, hi, rnd.choice([middle, at, middle + 1.2])))
    return out


def fine(y):
    return y if y is not None and math.isfinite(y) and y > 0 else 0.0


def smooth(points):
    c = [fine(y) for _, y in points]
    at = lambda k: c[min(max(k, 0), len(c) - 1)]
    return [(at(k - 2) + 2 * at(k - 1) + 3 * at(k) + 2 * at(k + 1) + at(k + 2)) / 9 for k in range(len(c))] if len(c) >= 5 else c


def move(points, edge, apex, side, seconds=3.0):
    n, x, s, d = len(points), [p[0] for p in points], smooth(points), -1 if side == "left" else 1
    if n < 5 or apex is None or apex < 0:
        return edge, "few_points"
    o = min(range(n), key=lambda k: (abs(x[k] - edge), k))
    if (o - apex) * d <= 0:
        return edge, "past_apex"
    local = sorted(v for u, v in zip(x, s) if abs(u - x[apex]) <= 1)
    base, low = np.quantile(local, 0.2), [v for v in local if v <= np.median(local)]
    sigma = 1.4826 * np.median(np.abs(np.array(low) - np.median(low)))
    height = max(s[apex] - base, 1e-12)
    share, noise = min(0.05, max(0.01, 4 * sigma / height)), max(0.25 * sigma, 0.00025 * s[apex], 1e-12)
    if not (0 <= o - 1 and o + 1 < n):
        return edge, "at_end"
    slope = s[o + d] - s[o - d]
    mean = lambda flags: sum(flags) / len(flags) if flags else 1.0
    fitting = []
    for k in range(1, n - 1):
        if abs(x[k] - edge) > seconds / 60 + 1e-12 or (k - apex) * d <= 0 or s[k] > min(s[k - 1], s[k + 1]) or s[k] > base + share * height:
            continue
        way = list(range(apex, k + d, d))[-8:]
        if mean([s[b] - s[a] <= noise for a, b in zip(way, way[1:])]) < 0.7:
            continue
        after = [s[j] for j in (k + d, k + 2 * d) if 0 <= j < n]
        if min(after) < s[k] - noise:
            continue
        out = (x[k] - edge) * d > 0
        gain, z = s[o] - s[k], max(s[o] - base, 0) / height
        if out:
            way = range(o, k + d, d)
            good = mean([s[b] - s[a] <= noise for a, b in zip(way, way[1:])]) >= 0.8 and z <= min(0.03, share + 0.01) and gain / height >= max(noise / height, 0.08 * max(z, 1e-12)) and max(after) - s[k] >= noise
        else:
            way = range(k, o + d, d)
            good = mean([s[b] - s[a] >= -noise for a, b in zip(way, way[1:])]) >= 0.75 and gain > noise
        if good:
            fitting.append((k, out))
    if not fitting:
        return edge, "no_minimum"
    right_way = [f for f in fitting if abs(slope) <= noise or f[1] == (slope < 0)]
    if not right_way:
        return edge, "against_slope"
    k, out = min(right_way, key=lambda f: (abs(x[f[0]] - edge), s[f[0]], f[0]))
    if abs(x[k] - edge) <= max(0.25 * float(np.median(np.diff(x))), 1e-12):
        return edge, "already_there"
    return x[k], "outward" if out else "inward"


def top_of(points, lo, hi):
    inside = [k for k, (x, _) in enumerate(points) if lo <= x <= hi]
    return max(inside, key=lambda k: (points[k][1], -k)) if inside else None


def plain(points, boxes, seconds=3.0):
    x, y = [p[0] for p in points], [fine(p[1]) for p in points]
    rows = []
    for b, label, raw_lo, raw_hi, c in boxes:
        lo, hi = sorted((max(c - 1, raw_lo), min(c + 1, raw_hi)))
        k = top_of(list(zip(x, y)), lo, hi)
        pin = None if label != "OUT_FIG" else "left" if abs(raw_lo - (c - 1)) <= abs(c + 1 - raw_hi) else "right"
        rows.append({"b": b, "label": label, "c": c, "lo": lo, "hi": hi, "pin": pin, "apex": k if k is not None else min(range(len(x)), key=lambda j: (abs(x[j] - (lo + hi) / 2), j))})
    shared = {}
    rows.sort(key=lambda r: (r["apex"], r["b"]))
    for u, v in zip(rows, rows[1:]):
        between = range(u["apex"] + 1, v["apex"])
        if between:
            k = min(between, key=lambda j: (y[j], j))
            if y[k] < min(y[u["apex"]], y[v["apex"]]) and abs(x[k] - u["hi"]) <= seconds / 60 + 1e-12 and abs(x[k] - v["lo"]) <= seconds / 60 + 1e-12:
                shared[u["b"], "right"] = shared[v["b"], "left"] = x[k]
    out = {}
    for r in rows:
        ends, why = [], []
        for side, edge, plot in (("left", r["lo"], r["c"] - 1), ("right", r["hi"], r["c"] + 1)):
            if r["pin"] == side:
                ends.append(plot), why.append("pinned")
            elif (r["b"], side) in shared:
                ends.append(shared[r["b"], side]), why.append("shared_valley")
            else:
                e, w = move(points, edge, r["apex"], side, seconds)
                ends.append(e), why.append(w)
        review, back = set(), None
        if ends[0] >= x[r["apex"]] or ends[1] <= x[r["apex"]]:
            ends, back = [r["lo"], r["hi"]], "crosses_apex"
            review.add(back)
        lo, hi = sorted(max(r["c"] - 1, min(e, r["c"] + 1)) for e in ends)
        k = top_of(list(zip(x, y)), lo, hi)
        if k is None:
            k = r["apex"]
            review.add("no_scans")
        if not lo < x[k] < hi:
            lo, hi, back, why = r["lo"], r["hi"], "apex_at_bound", ["rolled_back"] * 2
            review.add(back)
            k = top_of(list(zip(x, y)), lo, hi)
            k = r["apex"] if k is None else k
        if (r["pin"] != "left" and abs(lo - r["lo"]) * 60 > seconds + 1e-6) or (r["pin"] != "right" and abs(hi - r["hi"]) * 60 > seconds + 1e-6):
            review.add("moved_too_far")
        if y[k] <= 0:
            review.add("no_height")
        out[r["b"]] = (lo, hi, x[k], y[k], *why, back, ",".join(sorted(review)))
    return out


@pytest.fixture(scope="module")
def clean():
    """Traces whose values are finite: which of several odd values is the highest is not a question of boxes."""
    return {t: [(x, fine(y)) for x, y in p] for t, p in traces().items()}


def points_of(spark, all_):
    return spark.createDataFrame([(t, i, x, y) for t, p in all_.items() for i, (x, y) in enumerate(p)], "trace long, i int, x double, y double").repartition(3)


def test_edges(spark):
    all_, rnd = traces(), random.Random(8)
    rows = []
    for t, p in all_.items():
        for b in range(150):
            apex = rnd.choice([None, -1, *range(len(p))])
            if b % 3 and len(p) > 4:  # a real apex, an edge on its tail
                apex = max(range(len(p)), key=lambda k: (fine(p[k][1]) if abs(k - rnd.randrange(len(p))) < 12 else -1, -k))
            at = p[min(max((apex or 0) + rnd.randint(-14, 14), 0), len(p) - 1)][0] + rnd.choice([0, 0.004, -0.006])
            rows.append((t, b, "left" if apex is not None and at < p[max(apex, 0)][0] else rnd.choice(["left", "right"]), at, apex))
    rows.append((999, 0, "left", 1.0, 3))  # no points
    got = {(r.trace, r.box): r for r in S.shape_edges(points_of(spark, all_), spark.createDataFrame(rows, "trace long, box int, side string, edge double, apex int")).collect()}
    assert len(got) == len(rows)
    seen = set()
    for t, b, side, edge, apex in rows:
        rt, reason = move(all_.get(t, []), edge, apex, side)
        seen.add(reason)
        assert (got[t, b].reason, got[t, b].moved) == (reason, reason in ("outward", "inward")), (t, b)
        assert got[t, b].rt == pytest.approx(rt, abs=1e-12) and abs(got[t, b].rt - edge) <= 3.0 / 60 + 1e-9
    assert seen == {"outward", "inward", "few_points", "past_apex", "at_end", "no_minimum", "against_slope", "already_there"}


@pytest.mark.parametrize("seconds", [3.0, 9.0])
def test_boxes(spark, clean, seconds):
    boxes = drawn(clean)
    got = {(r.trace, r.box): r for r in S.standardised(points_of(spark, clean), spark.createDataFrame(boxes, "trace long, box int, label string, lo double, hi double, center double"), seconds).collect()}
    assert len(got) == len(boxes)
    seen = set()
    for t, p in clean.items():
        for b, want in plain(p, [x[1:] for x in boxes if x[0] == t], seconds).items():
            r = got[t, b]
            assert [r.lo, r.hi, r.apex_rt, r.height] == pytest.approx(want[:4], abs=1e-9), (t, b, r, want)
            assert (r.left_reason, r.right_reason, r.rolled_back, r.review) == want[4:], (t, b)
            seen |= {want[4], want[5], want[6], *want[7].split(",")}
    assert {"pinned", "shared_valley", "crosses_apex", "apex_at_bound", "no_scans"} <= seen, seen


def test_no_boxes(spark, clean):
    none = spark.createDataFrame([], "trace long, box int, label string, lo double, hi double, center double")
    assert S.standardised(points_of(spark, clean), none).count() == 0


def mean_of(v, k, half):
    return sum(v[j] for j in range(k - half, k + half + 1) if 0 <= j < len(v)) / (2 * half + 1)


def go(x, s, start, d, by_least, rebound):
    """Every prefix of the way judged from scratch: the first that must not be walked ends it."""
    way = [k for k in range(start, len(x) if d > 0 else -1, d)][: S.WALK_SCANS + 1]
    way = [k for j, k in enumerate(way) if all(abs(x[w] - x[start]) <= S.WALK_MINUTES for w in way[: j + 1])]
    up = [s[way[j]] > (min(s[w] for w in way[:j]) if by_least else s[way[j - 1]]) * (1 + S.WALK_RISE) if j else False for j in range(len(way))]
    end = len(way) - 1
    for j in range(1, len(way)):
        lowest = min(s[w] for w in way[:j])
        if rebound and up[j] and not all(up[1:j]) and s[way[j]] >= lowest * (1 + S.WALK_REBOUND):
            return min(way[:j], key=lambda w: (s[w], way.index(w))), None, True
        if j > S.WALK_PATIENCE and all(up[j - S.WALK_PATIENCE : j + 1]):
            end = j - 1
            break
    return min(way[: end + 1], key=lambda w: (s[w], way.index(w))), way[end], False


def plain_update(points, rt, li, ri):
    x = [p[0] for p in points]
    first = [mean_of([p[1] for p in points], k, 1) for k in range(len(x))]
    s = [max(mean_of(first, k, 2), 0.0) for k in range(len(x))]
    apex = max(range(li, ri + 1), key=lambda k: (s[k], -k))
    left = go(x, s, li, -1, True, False)[0]
    low, end, back = go(x, s, ri, 1, False, True)
    right = low if back else end
    limit = max(np.median(s) + 3 * 1.4826 * np.median(np.abs(np.array(s) - np.median(s))), 0.01 * s[apex])

    def core(d):
        k = apex
        for step in range(1, 73):
            if not 0 <= k + d < len(x):
                return k
            k += d
            if step >= 2 and s[k] <= limit and s[k - d] <= limit:
                return k
        return k

    cores = core(-1), core(1)
    wide = s[left] <= limit and s[right] <= limit and x[right] - x[left] > max(x[cores[1]] - x[cores[0]], 1e-12) * 1.8
    a, b = sorted(cores if wide else (left, right))
    return rt if x[li] <= rt <= x[ri] else x[apex], x[a], x[b], li - left, right - ri, back, x[low], "core_shrink" if wide else "box_extend"


def test_updates_from_boxes(spark, clean):
    rnd = random.Random(12)
    features, notes, sources = [], [], [("a", 10), ("b", 0)]
    for t, p in list(clean.items()) + [(500 + k, []) for k in range(4)] + [(600 + k, list(clean.values())[-1]) for k in range(120)]:
        rt = p[len(p) // 2][0] + rnd.choice([0, 0.3, -0.4]) if p else 1.0
        features.append((t, rnd.choice(["a"] * 9 + ["b", "gone"]), rt, rt - 0.1, rt + 0.1))
        left = rnd.choice([None, 10.0, 150.0, 300.0, 360.0, 395.0])
        right = None if left is None else left + rnd.choice([-2.0, 4.0, 5.0, 30.0, 60.0, 120.0])
        notes.append((t, rnd.choice([["x"], [" d "], ["D", "d"], [], None, ["x"], ["True_Peak"]]), left, right, 800))
    features.append((9000, "a", 1.0, 0.9, 1.1))  # no annotation: no row
    notes.append((9001, ["x"], 1.0, 50.0, 800))  # no feature
    points = {t: p for t, p in clean.items()} | {600 + k: list(clean.values())[-1] for k in range(120)}
    f = spark.createDataFrame(features, "feature long, source string, RT double, RTmin double, RTmax double")
    a = spark.createDataFrame(notes, "feature long, labels array<string>, x_left double, x_right double, width int")
    got = {r.feature: r for r in S.update_from_boxes(f, points_of(spark, points), a, spark.createDataFrame(sources, "source string, n_scans int")).collect()}
    assert set(got) == {n[0] for n in notes}
    known, seen = {r[0]: r for r in features}, set()
    for t, labels, left, right, width in notes:
        r, names = got[t], {x.strip() for x in labels or []}
        if t not in known:
            want = "skip_stale_annotation_only"
        else:
            _, source, rt, lo, hi = known[t]
            p = points.get(t, [])
            near = lambda v, p=p: min(range(len(p)), key=lambda k: (abs(p[k][0] - v), k))
            at = lambda px, rt=rt: max(rt - 1, min(rt + 1, rt - 1 + px / 800 * 2))
            unsure = lambda yes, no, names=names: yes if "d" in names else no
            if source == "gone":
                want = "skip_missing_source"
            elif source == "b":
                want = "skip_no_scans"
            elif not p:
                want = "skip_empty_trace"
            elif "D" in names:
                want = "deleted_delete_label"
            elif left is None:
                want = unsure("uncertain_no_box_keep_original", "fallback_original_no_box")
            else:
                li, ri = near(at(min(left, right))), near(at(max(left, right)))
                tiny = abs(right - left) <= 4.5 or (p[ri][0] - p[li][0]) * 60 <= 1.0 or ri - li + 1 < 3
                assert (r.li, r.ri) == (li, ri)
                if tiny:
                    want = unsure("uncertain_tiny_box_keep_original", "skip_tiny_box_keep_original")
                else:
                    want = unsure("uncertain_updated_from_box", "updated_from_box")
                    w = plain_update(p, rt, li, ri)
                    assert [r.new_RT, r.new_RTmin, r.new_RTmax] == pytest.approx(w[:3], abs=1e-12), (t, r, w)
                    assert (r.left_expand_scans, r.right_expand_scans, r.rollback_to_valley, r.rollback_valley_RT, r.bound_mode) == w[3:], t
                    seen |= {w[5], w[7]}
            keeps = "keep_original" in want or "fallback" in want
            if keeps:
                assert (r.new_RT, r.new_RTmin, r.new_RTmax) == (rt, lo, hi)
            elif "updated" not in want:
                assert (r.new_RT, r.new_RTmin, r.new_RTmax) == (None,) * 3
            judged = keeps or "updated" in want
            assert r.is_true_peak == (int(left is not None) if judged and "d" not in names else None), want
        assert r.status == want, t
        seen.add(want)
    assert len(seen) == 11 + 1 + 2, seen


def test_no_row_for_an_edge_and_a_point(spark):
    """Without broadcasts, as with large tables, what is shuffled grows with the points and the edges, not with their product."""
    all_ = {t: [(0.02 * i, 50 * math.exp(-(((i % 20 - 10) / 4) ** 2))) for i in range(140)] for t in range(4)}
    points = points_of(spark, all_).localCheckpoint()
    rows = [(t, b, "left" if b % 2 else "right", 0.02 * (b % 7 * 20 + 10) + (-0.1 if b % 2 else 0.1), b % 7 * 20 + 10) for t in all_ for b in range(40)]
    edges = spark.createDataFrame(rows, "trace long, box int, side string, edge double, apex int").localCheckpoint()
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sc.setJobGroup("edges", "")
        assert len(S.shape_edges(points, edges).collect()) == len(rows)
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup("edges") for s in tracker.getJobInfo(j).stageIds}
        shuffled = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        sc._jsc.sc().clearJobGroup()
    assert shuffled <= 3 * (4 * 140 + len(rows))  # 160 edges and 140 points each would be 22,400
