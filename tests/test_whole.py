"""Whole jobs: part store, label merges, verification with a failing fixture for each check, windows, infinite values, walks and pairs against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import attributes, audits, boundaries, matching, normalize, peaks, range_join, tables, traces
from tracemill.sources import files

# --- part store ------------------------------------------------------------------------------------------------------


def test_part_store_computes_what_changed(spark, tmp_path):
    asked = []

    def compute(jobs):
        asked.append({r.source for r in jobs.select("source").distinct().collect()})
        return jobs.groupBy("source").agg(F.sum("value").alias("total"))

    rows = [(s, f"{s}-{k}", float(k)) for s in "abcd" for k in range(5)]
    jobs = lambda some: spark.createDataFrame(some, "source string, job string, value double").repartition(3)
    hashes = lambda **h: spark.createDataFrame([(s, h.get(s, "1")) for s in "abcd"], "source string, sha256 string")
    store = tables.PartStore(spark, f"file://{tmp_path}/parts")
    run = lambda some, h: store.update(jobs(some), h, "source", "job", compute)
    first, now = run(rows, hashes())
    assert asked == [set("abcd")] and {r.source: r.total for r in first.collect()} == dict.fromkeys("abcd", 10.0) and now.count() == 4
    same, none = run(rows[::-1], hashes())
    assert len(asked) == 1 and none.count() == 0 and sorted(same.collect()) == sorted(first.collect())  # nothing changed: nothing computed
    (tmp_path / "parts" / "run-killed").mkdir()  # a run that was killed before its commit
    (tmp_path / "parts" / "run-killed" / "part-0.parquet").write_bytes(b"half")
    less = [r for r in rows if r[1] not in ("b-4", "d-0")]
    later, some = run(less, hashes(c="2"))
    assert asked[1] == {"b", "c", "d"} and {(r.source, r.n_jobs) for r in some.collect()} == {("b", 4), ("c", 5), ("d", 4)}
    assert {r.source: r.total for r in later.collect()} == {"a": 10.0, "b": 6.0, "c": 10.0, "d": 10.0}
    back, gone = run([r for r in rows if r[0] != "a"], hashes())  # as it was at first, without a source
    assert len(asked) == 2 and gone.count() == 0 and {r.source for r in back.collect()} == set("bcd")


def test_part_store_has_few_files(spark, tmp_path):
    jobs = spark.range(900).selectExpr("id % 300 AS source", "cast(id AS string) AS job", "1.0D AS value")
    sources = spark.range(300).selectExpr("id AS source", "'x' AS sha256")
    done, _ = tables.PartStore(spark, f"file://{tmp_path}/parts").update(jobs, sources, "source", "job", lambda d: d.groupBy("source").agg(F.sum("value").alias("total")))
    assert done.count() == 300 and len(list((tmp_path / "parts").rglob("*.parquet"))) < 50


# --- labels ----------------------------------------------------------------------------------------------------------


def test_label_merge(spark):
    rows = spark.createDataFrame([("F1 ", None), ("F2", 1), ("F3", 0), (None, 1)], "Feature_ID string, is_true_peak int")
    notes = [(" F1", "true", 1), ("F2", "no", 2), ("F2", "?", 3), (" ", "yes", 4), (None, "yes", 5), ("F9", "1", 6)]
    d = lambda some: spark.createDataFrame(some, "Feature_ID string, word string, at int")
    merge = lambda some, **k: tables.label_merge(rows, d(some), "Feature_ID", "is_true_peak", normalize.label_value("word"), **k)
    out, invalid, counts = merge(notes)
    assert sorted(map(tuple, out.collect()), key=str) == [("F1 ", 1), ("F2", 0), ("F3", 0), (None, 1)] and [r["at"] for r in invalid.collect()] == [3]
    assert tuple(counts.first()) == (3, 1, 2, 4, 2, 2)
    twice = [*notes, ("F1", "false", 7), ("F1", "?", 8)]
    with pytest.raises(Exception, match="ids with several labels: 1"):
        merge(twice)[0].collect()
    assert dict(map(tuple, merge(twice, order="at")[0].filter("Feature_ID is not null").collect())) == {"F1 ": 0, "F2": 0, "F3": 0}
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "Feature_ID string")
    both = tables.folder_labels(rows, ids("F1", "F2"), ids("F2", "F3"), "Feature_ID", "is_true_peak")
    assert dict(map(tuple, both.filter("Feature_ID is not null").collect())) == {"F1 ": 1, "F2": 1, "F3": 0}
    with pytest.raises(Exception, match="ids in both folders: 1"):
        tables.folder_labels(rows, ids("F1", "F2"), ids("F2", "F3"), "Feature_ID", "is_true_peak", strict=True).collect()


# --- verification ----------------------------------------------------------------------------------------------------

SEED = "seed_id string, image_id string, image string, annotation_json string, image_sha256 string, annotation_sha256 string, label int, exclude_from_test boolean, grp string, SNR double"


def dataset():
    seeds = [[f"s{k}", f"i{k}", f"images/{k}.png", f"images/{k}.json", f"h{k}", f"j{k}", k % 2, False, f"g{k}", 1.0] for k in range(6)]
    return {
        "seeds": seeds, "peaks": [["p0", "s1", "True_Peak", 1.0], ["p1", "s1", "OUT_FIG", 2.0], ["p2", "s3", "True_Peak", 1.0]],
        "files": [[s[c], s[c + 2]] for s in seeds for c in (2, 3)], "shapes": [["s1", "True_Peak"], ["s1", "OUT_FIG"], ["s3", "True_Peak"]], "splits": [[f"s{k}", ("train", "train", "train", "train", "val", "test")[k]] for k in range(6)],
    }


def change(what, row=None, column=None, value=None, add=None, drop=None):
    def work(d):
        if row is not None:
            d[what][row][column] = value
        if add is not None:
            d[what].append(add)
        if drop is not None:
            d[what].pop(drop)

    return work


FAULTS = {
    "seed_id_repeats": change("seeds", add=["s1", "i9", "images/1.png", "images/1.json", "h1", "j1", 1, False, "g1", 1.0]), "image_id_repeats": change("seeds", 0, 1, "i1"), "peak_id_repeats": change("peaks", 1, 0, "p0"), "peaks_of_unknown_seeds": change("peaks", 2, 1, "s99"),
    "seeds_not_in_one_split": change("splits", drop=0), "splits_of_unknown_seeds": change("splits", add=["s77", "train"]), "missing_files": change("files", drop=3), "orphan_files": change("files", add=["images/old.png", "x"]), "hash_mismatches": change("files", 0, 1, "other"),
    "shapes_unlike_peaks": change("shapes", drop=0), "leak_grp_train_val": change("seeds", 4, 8, "g0"), "leak_grp_train_test": change("seeds", 5, 8, "g0"), "leak_grp_val_test": change("seeds", 5, 8, "g4"), "leak_image_id_val_test": change("seeds", 5, 1, "i4"),
    "bad_labels": change("seeds", 2, 6, 7), "non_portable_paths": change("seeds", 2, 2, "C:\\x\\2.png"), "barred_rows_in_test": change("seeds", 5, 7, True), "seed_infinite_values": change("seeds", 0, 9, float("-inf")), "peak_infinite_values": change("peaks", 0, 3, float("inf")),
    "splits_unlike_lock": change("splits", 3, 1, "val"), "seed_rows": change("seeds", drop=5), "peak_rows": change("peaks", drop=2), "shape_rows": change("shapes", drop=2), "train_rows": change("splits", 0, 1, "test"), "seeds_of_label_1": change("seeds", 1, 6, 0),
}
EXPECTED = {"seed_rows": 6, "peak_rows": 3, "shape_rows": 3, "seeds_of_label_1": 3, "seeds_of_label_0": 3, "train_rows": 4, "val_rows": 1, "test_rows": 1}


def verified(spark, d, lock=None):
    df = lambda rows, schema: spark.createDataFrame([tuple(r) for r in rows], schema)
    seeds, split = df(d["seeds"], SEED), df(d["splits"], "seed_id string, split string")
    now = audits.digest(split.join(seeds.select("seed_id", "label"), "seed_id"), "split", ["seed_id", "label"])
    out = audits.verify(seeds, df(d["peaks"], "peak_id string, seed_id string, label string, SNR double"), df(d["files"], "path string, sha256 string"), df(d["shapes"], "seed_id string, label string"), split, ["SNR"], ["image_id", "grp"], EXPECTED, now if lock is None else lock)
    return {r.check: r for r in out.collect()}, now


def test_a_sound_dataset_passes(spark):
    found, _ = verified(spark, dataset())
    assert len(found) >= 25 and {k for k, r in found.items() if r.status != "pass"} == set()
    assert set(FAULTS) <= set(found)


@pytest.mark.parametrize("name", sorted(FAULTS))
def test_each_check_fails(spark, name):
    d = dataset()
    _, lock = verified(spark, d)
    lock = spark.createDataFrame(lock.collect(), lock.schema)
    FAULTS[name](d)
    found, _ = verified(spark, d, lock)
    assert found[name].status == "fail" and found[name].value != found[name].expected


# --- attributes and windows ------------------------------------------------------------------------------------------


def test_values_that_are_not_finite_count_as_none(spark):
    nan, inf = float("nan"), float("inf")
    odd, plain = [0.0, 1.0, 5.0, inf, 5.0, 1.0, nan, -inf, None], [0.0, 1.0, 5.0, 0.0, 5.0, 1.0, 0.0, 0.0, 0.0]
    rows = [(k, i, float(i), y) for k, t in enumerate((odd, plain)) for i, y in enumerate(t)]
    d = spark.createDataFrame(rows, "feature int, i int, x double, y double")
    a, b = attributes.attributes(d).orderBy("feature").collect()
    assert a[1:] == b[1:] and a.SNR is not None and math.isfinite(a.SNR)
    a, b = traces.shape(d.withColumnRenamed("feature", "trace")).orderBy("trace").collect()
    assert a[1:] == b[1:] and math.isfinite(a.SNR) and math.isfinite(a.CV)


def test_windows_of_bounds_or_of_time(spark):
    nan = float("nan")
    rows = [(1, 100.0, 5.0, 4.0, 6.0), (2, 100.0, 5.0, 6.0, 4.0), (3, 100.0, 5.0, None, 6.0), (4, 100.0, 5.0, nan, 6.0), (5, 100.0, 5.0, 4.0, float("inf")), (6, None, 5.0, 4.0, 6.0), (7, 100.0, None, 4.0, 6.0), (8, nan, 5.0, 4.0, 6.0)]
    d = spark.createDataFrame(rows, "feature int, mz double, RT double, RTmin double, RTmax double")
    assert {r.feature: (r.lo, r.hi) for r in attributes.windows(d, 0.5).collect()} == {1: (4.0, 6.0), 2: (4.0, 6.0), 3: (4.5, 5.5), 4: (4.5, 5.5), 5: (4.5, 5.5)}


def test_pairs_need_positive_values(spark):
    d = spark.createDataFrame([(1, "a", 100.0, 1.0), (2, "a", 100.0001, 1.0), (3, None, 100.0, 1.0), (4, "a", None, 1.0)], "id int, source string, mz double, rt double")
    assert [(r.a, r.b) for r in range_join.near_pairs(d, "id", "mz", "rt", 5, 2).collect()] == [(1, 2)]
    with pytest.raises(Exception, match="mz must be positive"):
        range_join.near_pairs(d.withColumn("mz", -F.col("mz")), "id", "mz", "rt", 5, 2).collect()


# --- walks -----------------------------------------------------------------------------------------------------------


def plain_valley(x, y, start, d, threshold, noise, p):
    """The way judged prefix by prefix."""
    way = [start]
    for k in range(start + d, len(x) if d > 0 else -1, d):
        if len(way) > p.expand_scans or abs(x[k] - x[start]) > p.expand_minutes:
            break
        steps = list(zip(way, [*way[1:], k]))
        ups = [y[b] > y[a] * (1 + p.rise) for a, b in steps]
        lowest = min(y[w] for w in way)
        if ups[-1] and not all(ups[:-1]) and len(ups) > 1 and y[k] >= lowest * (1 + p.rebound):
            return min(way, key=lambda w: (y[w], way.index(w))), True
        if len(ups) > p.patience and all(ups[-p.patience - 1 :]):
            break
        way.append(k)
        level = [not u and max(y[a], y[b]) <= threshold and abs(y[b] - y[a]) <= max(noise, 1e-9) for u, (a, b) in zip(ups, steps)]
        if len(level) >= p.flat_patience and all(level[-p.flat_patience :]):
            break
    return min(way, key=lambda w: (y[w], way.index(w))), False


def test_valleys_of_random_traces():
    rnd = np.random.default_rng(7)
    for _ in range(600):
        n = int(rnd.integers(1, 40))
        x, y = np.cumsum(rnd.uniform(0.01, 0.1, n)), np.abs(rnd.choice([0, 1, 1.01, 2, 3, 9, 9.1], n) + rnd.choice([0, 0.001], n))
        p = boundaries.Settings(expand_scans=int(rnd.integers(1, 20)), expand_minutes=float(rnd.uniform(0.1, 2)), rise=float(rnd.choice([0.0, 0.02, 0.5])), rebound=float(rnd.choice([0.05, 0.12, 2])), patience=int(rnd.integers(0, 4)), flat_patience=int(rnd.integers(1, 4)))
        start, d, threshold, noise = int(rnd.integers(0, n)), int(rnd.choice([-1, 1])), float(rnd.choice([0.5, 1.5, 10])), float(rnd.choice([1e-4, 0.02]))
        assert boundaries.valley(x, y, start, d, threshold, noise, p) == plain_valley(x, y, start, d, threshold, noise, p)


def test_short_and_empty_traces_are_refined():
    rows = [(np.zeros(0), np.zeros(0)), (np.array([1.0]), np.array([5.0])), (np.array([1.0, 2.0]), np.array([5.0, 1.0])), (np.array([1.0, np.nan]), np.array([np.inf, 1.0])), (np.arange(6.0), np.zeros(6))]
    out = boundaries.refine(rows, np.full(5, 1.0), np.full(5, np.nan), np.full(5, 2.0))
    assert out["status"].tolist() == ["empty_trace", "ok", "ok", "empty_trace", "zero_apex"] and out["left_idx"].tolist() == [-1, 0, 0, -1, 1]


# --- pairs of boxes, groups, files -----------------------------------------------------------------------------------


def test_assigned_boxes_are_the_greedy_ones(spark):
    from test_matching import boxes, iou

    rows, df = boxes(spark, 80)
    want = set()
    for s in {r[0] for r in rows}:
        pairs = []
        for t in (r for r in rows if r[0] == s and r[1]):
            for p in (r for r in rows if r[0] == s and not r[1]):
                far, over = max(abs(t[k] - p[k]) for k in range(2, 6)), iou(t, p)
                if over >= 0.1 or far <= 0.5:
                    pairs.append((far > 0.5, -over, far, -t[7], -p[7], t, p))
        used = set()
        for *_, t, p in sorted(pairs, key=lambda x: x[:5]):
            if not {("t", t[7]), ("p", p[7])} & used:
                used |= {("t", t[7]), ("p", p[7])}
                want.add((s, t[7], p[7]))
    assert {(r["sample"], r.target, r.prediction) for r in matching.assign_boxes(df, 0.1).collect()} == want


def test_large_groups_are_rows_not_strings(spark):
    d = spark.createDataFrame([(k, "s", k % 2 if k < 5 else None, "big" if k < 5 else "small" if k < 7 else "one") for k in range(8)], "seed int, source string, label int, g string")
    got = {r.grp: r for r in audits.group_rollup(d, "g", most=3).collect()}
    assert set(got) == {"big", "small"} and got["big"].seeds is None and got["big"].members == 5 and got["big"].conflict and got["small"].seeds == "5|6" and not got["small"].conflict
    assert audits.group_members(d, "g").count() == 7


def test_strings_of_large_groups(spark):
    n = 2500
    d = spark.range(n).selectExpr("id AS seed", "concat('s', id % 3) AS source", "if(id % 5 = 0, null, id % 2) AS label", "if(id < 2200, 'big', null) AS g").unionByName(spark.createDataFrame([(9000, None, None, "bare"), (9001, None, None, "bare")], "seed long, source string, label long, g string"))
    got = {r.grp: r for r in audits.group_rollup(d, "g").collect()}
    assert set(got) == {"big", None, "bare"} and got["big"].members == 2200 and got["big"].conflict and not got["bare"].conflict
    assert got["big"].seeds == "|".join(sorted(map(str, range(2200)))) and got["big"].sources == "s0|s1|s2" and got["big"].labels == "0|1"
    assert got[None].seeds == "|".join(sorted(map(str, range(2200, n)))) and got["bare"].sources == got["bare"].labels == "" and got["bare"].seeds == "9000|9001"


def test_located_tables(spark, tmp_path):
    import os

    for k, name in enumerate(("a.csv", "b.csv", "processed.csv", "c.txt")):
        (tmp_path / name).write_text("x\n1\n")
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    top = f"file://{tmp_path}"
    assert files.locate(spark, top, name="a.csv") == f"{top}/a.csv" and files.locate(spark, top, name="none.csv") is None
    assert files.locate(spark, top, preferred="b.csv", full="a.csv") == f"{top}/b.csv" and files.locate(spark, top, preferred="q.csv", full="a.csv") == f"{top}/a.csv"
    assert files.locate(spark, top).endswith("/processed.csv") and files.locate(spark, f"{top}/none") is None


def test_seed_diagnostics_of_odd_windows(spark):
    points = spark.createDataFrame([(1, i, i * 0.02, float(y)) for i, y in enumerate([0, 1, 4, 9, 4, 1, 0, 0, 0, 0])] + [(2, 0, 0.0, float("inf"))], "trace int, i int, x double, y double")
    seeds = spark.createDataFrame([(1, 1, 0.06, 0.02, 0.1), (2, 1, 0.06, 0.065, 0.075), (3, 1, 0.06, 0.06, 0.06), (4, 2, 0.0, -1.0, 1.0)], "seed int, trace int, rt double, lo double, hi double")
    got = {r.seed: r for r in peaks.seed_diagnostics(points, seeds).collect()}
    assert got[1].height == 9 and got[1].height_rt == pytest.approx(0.06) and got[1].point_count == 5 and not got[1].max_at_edge and got[1].width_sec == pytest.approx(4.8) and got[1].area == pytest.approx((1 + 2 * 4 + 2 * 9 + 2 * 4 + 1) / 2 * 1.2)
    assert got[2].point_count == 0 and got[2].height is None and got[2].max_at_edge and got[2].area is None and got[2].seed_intensity is None
    assert got[3].point_count == 1 and got[3].area == 0 and got[3].max_at_edge and got[4].height == 0
