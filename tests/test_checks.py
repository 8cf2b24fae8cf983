"""Joins and tables that must refuse what breaks their contract."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import alignment, audits, normalize, range_join, splits, tables


def fails(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def test_unknown_keys_are_an_error(spark):
    rows, dim = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string"), spark.createDataFrame([("a", 5), ("b", 6)], "name string, v int")
    assert sorted(map(tuple, tables.lookup(rows, dim, "k", "name").collect())) == [(1, "a", 5), (2, "b", 6)]
    fails(tables.lookup(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), dim, "k", "name"), "unknown k: 1")
    fails(tables.lookup(rows.union(spark.createDataFrame([(3, None)], rows.schema)), dim, "k", "name"), "unknown k: 1")


def test_short_parts_are_an_error(spark):
    d = spark.createDataFrame([(k, "x" if k < 3 else "y") for k in range(5)], "seed int, part string")
    assert tables.exactly(d.filter("part = 'x'"), "part", 3).count() == 3
    fails(tables.exactly(d, "part", 3), "parts without 3 rows")
    assert splits.fixed_strata(d, [("one", "part = 'x'", 2), ("two", "seed > 0", 2)], "seed").count() == 4
    fails(splits.fixed_strata(d, [("one", "part = 'x'", 4)], "seed"), "short strata")


def test_two_values_are_an_error(spark):
    d = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", 7.0)], "source string, ppm double")
    assert sorted(map(tuple, tables.single_value(d, "source", "ppm").collect())) == [("a", 5.0, 2), ("b", 7.0, 1)]
    fails(tables.single_value(d.union(d.withColumn("ppm", F.lit(1.0))), "source", "ppm"), "without one ppm")


def test_lock_holds(spark, tmp_path):
    d = spark.createDataFrame([(k, "s", k % 2, "test" if k < 3 else "train") for k in range(9)], "seed long, source string, label int, split string")
    mark = lambda rows: audits.digest(rows, "split", ["seed", "source", "label"])
    path = f"file://{tmp_path}/lock"
    assert audits.lock(mark(d), path).count() == 2 and audits.lock(mark(d.repartition(3)), path).count() == 2
    with pytest.raises(ValueError, match="test"):
        audits.lock(mark(d.withColumn("label", F.when(F.col("seed") == 1, 0).otherwise(F.col("label")))), path)


def test_hash_of_differences(spark):
    rising, falling = [float(k) for k in range(72)], [float(-k) for k in range(72)]
    one = [0.0] * 72
    one[0] = 1.0
    d = spark.createDataFrame([(1, rising, "a"), (2, falling, "a"), (3, one, "b")], "id int, m array<double>, label string").select("id", normalize.dhash(F.col("m")).alias("dhash"), "label")
    assert {r.id: r.dhash for r in d.collect()} == {1: "0" * 16, 2: "f" * 16, 3: "8" + "0" * 15}
    pairs = spark.createDataFrame([(1, 2, 0.0, 0.0), (1, 3, 0.0, 0.0), (2, 3, 0.0, 0.0)], "a int, b int, ppm double, gap double")
    got = {(r.a, r.b): (r.hamming, r.high_similarity, r.label_conflict) for r in range_join.near_duplicates(pairs, d).collect()}
    assert got == {(1, 2): (64, False, False), (1, 3): (1, True, True), (2, 3): (63, False, True)}


def test_alignment_is_the_greedy_one(spark):
    import random

    rnd = random.Random(3)
    rows = [(rnd.choice("xyz"), k, round(100 + rnd.random() * 0.2, 4), round(rnd.random() * 3, 2), rnd.choice([1.0, 2.0, None])) for k in range(300)]
    centres = []
    for a, _, mz, rt, v in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
        c = next((c for c in centres if abs(c[0] - mz) <= 0.005 and abs(c[1] - rt) <= 0.5), None)
        if c is None:
            c = [mz, rt, 0, {}]
            centres.append(c)
        c[0], c[1], c[2] = (c[0] * c[2] + mz) / (c[2] + 1), (c[1] * c[2] + rt) / (c[2] + 1), c[2] + 1
        c[3][a] = max(c[3].get(a, 0.0), v or 0.0)
    d = spark.createDataFrame(rows, "algo string, feature int, mz double, rt double, intensity double")
    got = sorted((round(r.mz, 9), round(r.rt, 9), r.n, sorted(r.intensity.items())) for r in alignment.align(d, 0.005, 0.5).collect())
    assert got == sorted((round(c[0], 9), round(c[1], 9), c[2], sorted(c[3].items())) for c in centres)

def test_digests_of_many_rows(spark):
    from decimal import Decimal

    d = spark.range(150_000).select(F.col("id").alias("seed"), (F.col("id") % 2).alias("label"), F.lit("train").alias("split"))
    line = F.sha2(F.concat_ws("|", F.col("seed").cast("string"), F.col("label").cast("string")), 256)
    sums = d.agg(*(F.sum(F.conv(F.substring(line, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).alias(f"d{k}") for k in range(4))).first()
    got = audits.digest(d, "split", ["seed", "label"]).first()
    assert min(sums) > Decimal(2**63) and [got[f"digest_{k}"] for k in range(4)] == [int(s) % 2**63 for s in sums]
    few = audits.digest(d.limit(1000), "split", ["seed", "label"]).first()
    small = d.limit(1000).agg(*(F.sum(F.conv(F.substring(line, 1 + 12 * k, 12), 16, 10).cast("bigint")).alias(f"d{k}") for k in range(4))).first()
    assert [few[f"digest_{k}"] for k in range(4)] == list(small)


def test_part_store_of_many_jobs(spark, tmp_path):
    jobs = spark.range(150_000).select(F.lit("a").alias("source"), F.col("id").cast("string").alias("job"))
    sources = spark.createDataFrame([("a", "1")], "source string, sha256 string")
    mark = lambda j: tables.PartStore(spark, f"file://{tmp_path}").fingerprints(j, sources, "source", "job").first()
    assert mark(jobs).n_jobs == 150_000 and mark(jobs).fingerprint == mark(jobs.repartition(5)).fingerprint != mark(jobs.filter("job <> '7'")).fingerprint


def test_hashes_cost_little(spark):
    import time

    d = spark.range(3000).select("id", F.transform(F.sequence(F.lit(0), F.lit(71)), lambda k: F.sin(k * (F.col("id") + 1))).alias("m"))
    start = time.time()
    assert d.select(F.max(F.length(normalize.dhash(F.col("m"))))).first()[0] == 16
    assert time.time() - start < 15  # it was some 40 with the comparisons made anew for each digit
