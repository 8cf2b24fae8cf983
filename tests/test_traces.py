import pytest

from tracemill.operators import range_join, traces


def trace(spark, values):
    return spark.createDataFrame([(1, i, float(y)) for i, y in enumerate(values)], "trace long, i int, y double")


@pytest.mark.parametrize("values, sym", [([0, 1, 4, 10, 4, 1, 0], 1.0)])
def test_symmetric_peak(spark, values, sym):
    p = trace(spark, values)
    assert traces.symmetry(p).first().SYM == pytest.approx(sym)
    assert traces.edges(p).first().EDGE == pytest.approx(0.1)


def test_asymmetric_peak_is_less_symmetric(spark):
    assert 0 <= traces.symmetry(trace(spark, [0, 1, 4, 10, 8, 7, 6])).first().SYM < 1


def test_edge_is_not_clipped(spark):
    p = spark.createDataFrame([(1, i, y) for i, y in enumerate([20.0, 20.0, 20.0, 21.0, 20.0, 20.0, 20.0])], "trace long, i int, y double")
    assert traces.edges(p).first().EDGE == pytest.approx(20 / 21)


def test_short_and_flat_traces(spark):
    assert traces.shape(trace(spark, [1, 2])).count() == 0
    assert traces.histogram_entropy(trace(spark, [3, 3, 3])).first().ENT == 0


def test_bucketed_join_is_the_plain_join(spark):
    f = spark.createDataFrame([(1, 1, 100.0, 0.05), (2, 1, 104.99, 0.05), (3, 2, 0.01, 0.05)], "feature int, source int, mz double, tol double")
    p = spark.createDataFrame([(1, 5, m, 1.0, 0) for m in (99.95, 100.05, 100.06, 104.95, 105.03)] + [(2, 5, -0.02, 2.0, 0)], "source int, scan int, mz double, intensity double, ord int")
    plain = f.join(p.withColumnRenamed("mz", "peak_mz"), "source").filter("peak_mz between mz - tol and mz + tol")
    key = lambda d: sorted((r.feature, r.peak_mz) for r in d.collect())
    assert key(range_join.in_window(f, p)) == key(plain)
    assert range_join.in_window(f, p)._jdf.queryExecution().executedPlan().toString().count("Cartesian") == 0
