"""Ordered matching and folds against plain Python."""

import random

from tracemill.operators import alignment, matching, peaks


def boxes(spark, n=40):
    rnd = random.Random(3)
    rows = []
    for s in range(n):
        for k in range(rnd.randint(0, 4)):
            x, y = rnd.randint(0, 8), rnd.randint(0, 4)
            rows.append((s, k % 2 == 0, float(x), float(y), float(x + rnd.randint(2, 8)), float(y + rnd.randint(2, 6)), rnd.random(), float(len(rows))))
    return rows, spark.createDataFrame(rows, "sample long, target boolean, x1 double, y1 double, x2 double, y2 double, score double, ord double")


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    both = max(0, w) * max(0, h)
    return both / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - both)


def test_match_predictions(spark):
    rows, df = boxes(spark)
    want = set()
    for s in {r[0] for r in rows}:
        targets, taken = [r for r in rows if r[0] == s and r[1]], set()
        for p in sorted((r for r in rows if r[0] == s and not r[1]), key=lambda r: (-r[6], r[7])):
            free = sorted((-iou(t, p), t[7]) for t in targets if t[7] not in taken)
            hit = free and -free[0][0] >= 0.3
            if hit:
                taken.add(free[0][1])
            want.add((s, p[7], free[0][1] if hit else None))
    assert {(r.sample, r.prediction, r.target) for r in matching.match_predictions(df, 0.3).collect()} == want


def test_assign_boxes_is_one_to_one(spark):
    _, df = boxes(spark)
    found = matching.assign_boxes(df, 0.1).collect()
    assert found and len({(r.sample, r.target) for r in found}) == len(found) == len({(r.sample, r.prediction) for r in found})


def test_islands_and_alignment(spark):
    rnd = random.Random(1)
    rows = [("ab"[k % 2], k, round(rnd.uniform(100, 103), 3), rnd.uniform(0, 20), 1.0 + k) for k in range(120)]
    df = spark.createDataFrame(rows, "algo string, feature long, mz double, rt double, intensity double").repartition(3)
    centres = []
    for a, _, mz, rt, v in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
        c = next((c for c in centres if abs(c[0] - mz) <= 0.01 and abs(c[1] - rt) <= 5), None)
        if c is None:
            c = [mz, rt, 0, {}]
            centres.append(c)
        c[0], c[1], c[2] = (c[0] * c[2] + mz) / (c[2] + 1), (c[1] * c[2] + rt) / (c[2] + 1), c[2] + 1
        c[3][a] = max(c[3].get(a, 0), v)
    found = alignment.align(df, 0.01, 5).collect()
    key = lambda n, mz, rt, by: (n, round(mz, 9), round(rt, 9), tuple(sorted(by.items())))
    assert sorted(key(r.n, r.mz, r.rt, r.intensity) for r in found) == sorted(key(c[2], c[0], c[1], c[3]) for c in centres)


def test_valley(spark):
    values = [0, 3, 10, 6, 4, 4.2, 2, 7, 1]
    p = spark.createDataFrame([(1, i, float(y)) for i, y in enumerate(values)], "trace long, i int, y double")
    assert peaks.valley_right(p).first().valley == 6


def test_one_row_a_prediction_for_all_levels(spark, monkeypatch):
    """What is dealt by ranges and sorted has a row for each prediction, whatever the number of levels."""
    kept, plain = {}, matching.written
    monkeypatch.setattr(matching, "written", lambda rows, name: kept.setdefault(name, plain(rows, name)))
    rows = [(k, t, 0.0, 0.0, 10.0, 10.0 + (k + j) % 4, 0.1 * (k % 9), float(j)) for k in range(30) for j, t in enumerate([True, False, True, False])]
    boxes = spark.createDataFrame(rows, "sample long, target boolean, x1 double, y1 double, x2 double, y2 double, score double, ord double")
    assert matching.average_precision(boxes, [0.3, 0.5, 0.7, 0.9]).count() == 4
    assert kept["ranges"].count() == 60
