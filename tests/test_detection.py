"""Detection metrics, average precision and the bootstrap against plain Python."""

import random
from statistics import mean, median

import pytest
from test_matching import boxes, iou

from tracemill.operators import matching, splits


def matched(rows, least, score=0.0):
    """(prediction, target or None) of all samples, best scores first within each."""
    out = []
    for s in {r[0] for r in rows}:
        taken = set()
        for p in sorted((r for r in rows if r[0] == s and not r[1] and r[6] >= score), key=lambda r: (-r[6], r[7])):
            free = sorted((t for t in rows if t[0] == s and t[1] and t[7] not in taken), key=lambda t: (-iou(t, p), t[7]))
            hit = free[0] if free and iou(free[0], p) >= least else None
            taken |= {hit[7]} if hit else set()
            out.append((p, hit))
    return out


def figures(rows, t, least):
    m, targets, samples = matched(rows, least, t), sum(r[1] for r in rows), {r[0] for r in rows}
    hits = [(p, x) for p, x in m if x]
    off = [abs(sum(r[1] for r in rows if r[0] == s) - sum(p[0] == s for p, _ in m)) for s in samples]
    of = lambda f, g=mean: g([f(p, x) for p, x in hits]) if hits else 0.0
    return {
        "tp": len(hits), "fp": len(m) - len(hits), "fn": targets - len(hits), "precision": len(hits) / len(m) if m else 0.0, "recall": len(hits) / targets, "f1": 2 * len(hits) / (len(m) + targets),
        "mean_iou": of(iou), "median_iou": of(iou, median), "left_mae": of(lambda p, x: abs(p[2] - x[2])), "right_mae": of(lambda p, x: abs(p[4] - x[4])), "width_mae": of(lambda p, x: abs(p[4] - p[2] - x[4] + x[2])),
        "centre_mae": of(lambda p, x: abs(p[2] + p[4] - x[2] - x[4]) / 2), "coordinates_mae": of(lambda p, x: mean(abs(p[k] - x[k]) for k in (2, 3, 4, 5))),
        "count_accuracy": mean(float(x == 0) for x in off), "count_mae": mean(off), "predictions_per_sample": len(m) / len(samples),
    }


def test_detection_sweep(spark):
    rows, df = boxes(spark)
    found = {r.threshold: r.asDict() for r in matching.detection_sweep(df, 0.3).collect()}
    want = {t: figures(rows, t, 0.3) for t in (round(k * 0.05, 2) for k in range(1, 20))}
    assert sorted(found) == sorted(want)
    for t, w in want.items():
        assert {c: found[t][c] for c in w} == pytest.approx(w)
    assert [t for t, r in found.items() if r["best"]] == [max(want, key=lambda t: (want[t]["f1"], want[t]["recall"], want[t]["precision"], -abs(t - 0.5)))]


def test_detection_with_nothing_predicted(spark):
    df = boxes(spark)[1].filter("target")
    r = matching.detection(df, [0.5], 0.3).collect()
    assert len(r) == 1 and (r[0].tp, r[0].fp, r[0].fn, r[0].f1, r[0].median_iou) == (0, 0, df.count(), 0.0, 0.0)


def test_average_precisions(spark):
    rows, df = boxes(spark)
    found, n = {r.iou: r for r in matching.average_precisions(df, [0.3]).collect()}, sum(r[1] for r in rows)
    levels, want = [round(0.5 + 0.05 * k, 2) for k in range(10)], {}
    for level in [0.3, *levels]:
        curve, tp = [], 0
        for k, (_, hit) in enumerate(sorted(matched(rows, level), key=lambda m: -m[0][6]), 1):
            tp += hit is not None
            curve.append((tp / n, tp / k))
        want[level] = mean(max((p for r, p in curve if r + 1e-12 >= q / 100), default=0.0) for q in range(101))
    assert {k: r.ap for k, r in found.items()} == pytest.approx(want)
    assert found[0.5].map == pytest.approx(mean(want[k] for k in levels))


def auc(rows, c):
    return mean((p[c] > q[c]) + (p[c] == q[c]) / 2 for p in rows if p[1] for q in rows if not q[1])


def test_bootstrap_of_areas(spark):
    rnd = random.Random(8)
    rows = [(k, y := int(rnd.random() < 0.4), round(rnd.gauss(y, 1), 1), round(rnd.gauss(0.3 * y, 1), 1)) for k in range(80)]
    r = splits.bootstrap_difference(spark.createDataFrame(rows, "seed long, label int, a double, b double"), "a", "b").first()
    assert r.observed == pytest.approx(auc(rows, 2) - auc(rows, 3))
    drawn = []
    for _ in range(400):
        some = [rows[rnd.randrange(80)] for _ in rows]
        drawn.append(auc(some, 2) - auc(some, 3))
    drawn.sort()
    assert r.rounds == 2000 and abs(r.mean - mean(drawn)) < 0.02 and abs(r.low - drawn[10]) < 0.04 and abs(r.high - drawn[390]) < 0.04
    assert r.p == pytest.approx(min(1.0, 2 * min(r.above, 1 - r.above)))
