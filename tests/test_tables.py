"""Ids, splits and pairs at sizes where Spark deals rows over many partitions and merges them again."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import components, peaks, range_join, tables


@pytest.mark.parametrize("size", ["64m", "1m"])
def test_every_row_has_its_number(spark, size):
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    try:
        n = 400_000 if size == "64m" else 100_000
        d = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("h"), "id", F.repeat(F.lit("wide "), 60).alias("text"))
        out = tables.numbered(d, ["h", "id"], "X", "_at").select("h", "id", F.substring("_at", 2, 20).cast("long").alias("k"))
        r = out.agg(F.count("*").alias("n"), F.count_distinct("k").alias("d"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
        assert (r.n, r.d, r.lo, r.hi) == (n, n, 1, n)
        some = out.filter(F.col("k") % 997 == 0).orderBy("k").collect()
        assert [(r.h, r.id) for r in some] == sorted((r.h, r.id) for r in some)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)


def test_stratified_split_is_exact(spark):
    rows = [(k, "a" if k % 3 else None if k % 2 else "b") for k in range(3000)]
    got = tables.stratified_split(spark.createDataFrame(rows, "seed int, label string").repartition(5), "label", "seed").groupBy("label", "split").count().collect()
    n = {x: sum(1 for _, l in rows if l == x) for x in ("a", "b", None)}
    assert {(r.label, r.split): r["count"] for r in got} == {(x, s): k for x, m in n.items() for s, k in (("train", int(0.8 * m)), ("val", int(0.9 * m) - int(0.8 * m)), ("test", m - int(0.9 * m)))}


def test_near_pairs_are_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.randrange(3), 500 + rnd.random() * 3, rnd.random() * 40) for k in range(500)]
    d = spark.createDataFrame(rows, "id int, source int, mz double, rt double")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[3] - b[3]) <= 2 and abs(a[2] - b[2]) / ((a[2] + b[2]) / 2) * 1e6 <= 400}
    got = [(r.a, r.b) for r in range_join.near_pairs(d, "id", "mz", "rt", 400, 2).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_intervals_meet_once(spark):
    rnd = random.Random(7)
    make = lambda n: [(rnd.randrange(3), k, lo := rnd.randrange(-50, 400), lo + rnd.randrange(200)) for k in range(n)]
    a, b = make(60), make(60)
    ddl = "trace int, id int, lo int, hi int"
    got = sorted((r.trace, r.id, r.other) for r in peaks.interval_overlaps(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl)).collect())
    assert got == sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])


def test_groups_are_numbered_and_single_rows_stay(spark):
    ids, pairs = spark.createDataFrame([(k,) for k in range(8)], "id long"), spark.createDataFrame([(5, 6), (2, 3), (3, 7)], "a long, b long")
    got = {r.id: (r.root, r.members, r.group) for r in components.grouped(ids, pairs).collect()}
    assert got == {0: (0, 1, None), 1: (1, 1, None), 2: (2, 3, "G000001"), 3: (2, 3, "G000001"), 7: (2, 3, "G000001"), 4: (4, 1, None), 5: (5, 2, "G000002"), 6: (5, 2, "G000002")}


@pytest.mark.parametrize("seed", range(3))
def test_components_without_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["a", "b", None]), rnd.choice([100, 1000]) * round(1 + rnd.random() * 0.01, 5), round(rnd.random() * 30 - 10, 1)) for k in range(700)]
    rows += [(700 + k, "a", rows[k][2], rows[k][3]) for k in range(200)] + [(990, "a", None, 1.0), (991, "a", 100.0, None)]
    d = spark.createDataFrame(rows, "id long, source string, mz double, rt double")
    want = components.connected(range_join.near_pairs(d, "id", "mz", "rt", 400, 2))
    got = range_join.near_components(d, "id", "mz", "rt", 400, 2)
    assert len({r.root for r in want.collect()}) > 5 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dense_rows_make_few_links(spark, monkeypatch):
    seen, plain = [], range_join.connected
    monkeypatch.setattr(range_join, "connected", lambda links: plain(seen.append(links.count()) or links))
    d = spark.range(4000).selectExpr("id", "1 AS source", "1000 + id * 0.0005 AS mz", "cast(id % 3 AS double) AS rt")
    assert {r.root for r in range_join.near_components(d, "id", "mz", "rt", 400, 2).collect()} == {0} and seen[0] < 200


def test_components_send_no_table_through_the_driver(spark, monkeypatch):
    """Written tables look as small as their packed files, so Spark would broadcast a million cells or labels."""
    seen, plain = [], range_join.written
    for module in (range_join, components):
        monkeypatch.setattr(module, "written", lambda rows, name: plain(seen.append(rows) or rows, name))
    d = spark.range(400).selectExpr("id", "id % 5 AS source", "1000 + id * 0.01 AS mz", "cast(id % 7 AS double) AS rt")
    seen.append(range_join.near_components(d, "id", "mz", "rt", 400, 2))
    assert seen[-1].count() > 0
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in seen]
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("BroadcastHashJoin" in p for p in plans)
