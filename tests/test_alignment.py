"""Alignment by cells against the greedy order, one row after the other."""

import random

import pytest

from tracemill.operators import alignment


def greedy(rows, mz_tol, rt_tol):
    centres = []
    for algo, mz, rt, v in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: r[:3]):
        c = next((c for c in centres if abs(c[0] - mz) <= mz_tol and abs(c[1] - rt) <= rt_tol), None)
        if c is None:
            c = [mz, rt, 0, {}]
            centres.append(c)
        c[0], c[1], c[2] = (c[0] * c[2] + mz) / (c[2] + 1), (c[1] * c[2] + rt) / (c[2] + 1), c[2] + 1
        c[3][algo] = max(c[3].get(algo, 0.0), v or 0.0)
    return sorted((round(c[0], 8), round(c[1], 8), c[2], sorted(c[3].items())) for c in centres)


def found(df):
    return sorted((round(r.mz, 8), round(r.rt, 8), r.n, sorted(r.intensity.items())) for r in df.collect())


SCHEMA = "algo string, mz double, rt double, intensity double"


@pytest.mark.parametrize("span, height, n, size", [(0.4, 3.0, 500, 12), (1.5, 40.0, 600, 25), (0.05, 60.0, 300, 10), (3.0, 0.1, 400, 15)])
def test_many_cells(spark, span, height, n, size):
    """Dense in m/z, in RT, in both: each is one island, cut into many cells."""
    rnd = random.Random(n)
    rows = [(rnd.choice("xyz"), 100 + rnd.random() * span, rnd.random() * height, rnd.choice([1.0, 2.5, None])) for _ in range(n)]
    rows += [rows[k] for k in range(0, n, 7)] + [("x", None, 1.0, 1.0), ("x", 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(alignment.align(df, 0.005, 0.5, size)) == greedy(rows, 0.005, 0.5)
    placed, readers = alignment.cells(df.dropna().selectExpr("*", "monotonically_increasing_id() AS id"), 0.005, 0.5, size)
    assert placed.select("cell").distinct().count() > 3 and readers.count() > 0


def test_a_chain_through_all_cells(spark):
    """Each row hangs on the one before it, from the first cell to the last."""
    rows = [("a", 100 + 0.0049 * k, 1.0, 1.0) for k in range(120)] + [("b", 100 + 0.0049 * k + 0.002, 1.0, 2.0) for k in range(120)]
    d = alignment.align(spark.createDataFrame(rows, SCHEMA), 0.005, 0.5, 8)
    assert found(d) == greedy(rows, 0.005, 0.5)
    order = sorted(d.collect(), key=lambda r: (r.mz, r.rt))
    assert [r.aligned for r in order] == [f"A{k}" for k in range(1, len(order) + 1)]


def test_missed_and_empty(spark):
    rows = [("a", 100.0, 1.0, 5.0), ("b", 100.001, 1.0, 2.0), ("b", 200.0, 1.0, 2.0), ("a", 300.0, 1.0, 0.0), ("b", 300.0, 1.0, 1.0), ("c", 400.0, 1.0, None)]
    d = alignment.align(spark.createDataFrame(rows, SCHEMA), 0.01, 0.2)
    assert sorted(r.mz for r in alignment.missed_by(d, "a").collect()) == [200.0, 300.0]
    assert sorted(r.mz for r in alignment.missed_by(d, "c").collect()) == [pytest.approx(100.0005), 200.0, 300.0]
    assert alignment.align(spark.createDataFrame([], SCHEMA), 0.01, 0.2).count() == 0


def test_margins_spare_rounds(spark, monkeypatch):
    """Cells whose margins foretell their neighbours' rows are taken once, and the answer is the greedy one."""
    rnd, rounds, plain = random.Random(5), [], alignment.written
    monkeypatch.setattr(alignment, "written", lambda rows, name: rounds.append(name) or plain(rows, name))
    rows = [(rnd.choice("xyz"), 100 + rnd.random() * 6, rnd.random() * 2, 1.0) for _ in range(2000)]
    d = alignment.align(spark.createDataFrame(rows, SCHEMA), 0.005, 0.5, 400)
    assert found(d) == greedy(rows, 0.005, 0.5)
    assert rounds.count("events") == 1
