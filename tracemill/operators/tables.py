"""Keyed maintenance of tables, sampling by hash order, ids in a total order, splits and joins with checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audits import hash_sums
from .shared import written


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in an explicit total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that `new` has are replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append_new(old: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """old with batch behind it; keys twice in the batch, or already there, are an error."""
    twice = batch.groupBy(key).agg(F.count("*").alias("n"))
    seen = batch.select(key).distinct().join(old.select(key).distinct().withColumn("old", F.lit(True)), key, "left").join(twice, key)
    bad = seen.agg(F.count_if((F.col("n") > 1) | F.col("old")).alias("bad"))
    checked = batch.crossJoin(F.broadcast(bad)).filter(F.when(F.col("bad") > 0, F.raise_error(F.lit("keys of the batch repeat or exist")).cast("boolean")).otherwise(True)).drop("bad")  # one row
    return old.unionByName(checked)


def update(rows: DataFrame, changes: DataFrame, deletes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Changed columns of keyed rows, and rows to delete; null changes leave a value."""
    c = changes.select(key, *(F.col(x).alias(f"_{x}") for x in columns))
    d = rows.join(deletes.select(key), key, "left_anti").join(c, key, "left")
    return d.select(*(F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in rows.columns))


def hash_order(key: str, seed: int = 0) -> Column:
    """A position that is random to the eye and the same in every run and engine: hex digits of a digest."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sample_per(rows: DataFrame, part: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each part, by hash order."""
    w = Window.partitionBy(*part).orderBy(hash_order(key, seed), key)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def hash_ranks(rows: DataFrame, part: list[str], key: str, seed: int = 0, limit: Column | None = None, name: str = "rank") -> DataFrame:
    """rows with their rank in the hash order of `key` within each part (null is a part); with `limit`, the first ones only.

    A part of any size is dealt by the first digits of the hash: counts of these give each piece its first rank, so no
    task sorts a whole part, and pieces beyond the limit are not sorted at all.
    """
    d = rows.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    by = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))  # 4,096 rows a part
    before = F.coalesce(F.sum("_k").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = d.groupBy(*part, "_b").agg(F.count("*").alias("_k")).select(*(F.col(c).alias(f"_p{k}") for k, c in enumerate(part)), F.col("_b").alias("_piece"), before.alias("_before"))
    same = F.col("_b") == F.col("_piece")
    for k, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_p{k}"))
    d = d.join(starts, same)
    if limit is not None:
        d = d.filter(F.col("_before") < limit)
    d = d.withColumn(name, (F.row_number().over(Window.partitionBy(*part, "_b").orderBy("_h", key)) + F.col("_before")).cast("long"))
    if limit is not None:
        d = d.filter(F.col(name) <= limit)
    return d.drop("_h", "_b", "_piece", "_before", *(f"_p{k}" for k in range(len(part))))


def numbered(rows: DataFrame, order: list[str], prefix: str, name: str = "number", digits: int = 6) -> DataFrame:
    """Dense ids prefix-000001 ... in a total order, without one task for all rows.

    Rows are dealt by ranges of the order, sorted, and written once with their range and their place in it, so that all
    later steps see the same ranges. Counts of the ranges give each its first number: one row for each range.
    """
    at = "_at"
    while at in (*rows.columns, name):
        at += "_"
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    d = written(ranged.withColumn(at, F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    counts = d.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    first = F.map_from_entries(F.collect_list(F.struct("_part", "_before")))
    starts = before.agg(first.alias("_starts"))  # one row: a number for each range
    return d.crossJoin(F.broadcast(starts)).withColumn(name, F.concat(F.lit(prefix), F.format_string(f"%0{digits}d", F.col("_starts")[part] + place + 1))).drop(at, "_starts")


def stratified_split(rows: DataFrame, label: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 0) -> DataFrame:
    """split of each row: cut-offs by rank in hash order within its label.

    A label of any size is dealt by the first digits of the hash: counts of these give each part its first rank, so no
    task sorts a whole label.
    """
    d = rows.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = d.groupBy(label, "_b").agg(F.count("*").alias("_k"))
    by = Window.partitionBy(label)  # 4,096 rows a label
    parts = counts.select(
        F.col(label).alias("_label"), F.col("_b").alias("_part"), F.sum("_k").over(by).alias("_n"), F.coalesce(F.sum("_k").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)))
    d = d.join(parts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_part"))).withColumn("_r", F.col("_r") + F.col("_before"))
    split = F.when(F.col("_r") <= F.floor(train * F.col("_n")), "train").when(F.col("_r") <= F.floor((train + val) * F.col("_n")), "val").otherwise("test")
    return d.withColumn("split", split).drop("_r", "_n", "_h", "_b", "_label", "_part", "_before")


def leave_one_out(rows: DataFrame, domain: str) -> DataFrame:
    """Each row in each fold: test where its domain is the fold's, else train. As many folds as domains."""
    folds = rows.agg(F.collect_set(domain).alias("_folds"))  # one row of a few domain names
    return rows.crossJoin(F.broadcast(folds)).withColumn("fold", F.explode("_folds")).drop("_folds").withColumn("part", F.when(F.col(domain).eqNullSafe(F.col("fold")), "test").otherwise("train"))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    one = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("only_in", F.lit("left"))
    return one.unionByName(right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("only_in", F.lit("right")))


def compare(old: DataFrame, new: DataFrame, key: str, columns: list[str], rtol: float = 1e-6, atol: float = 1e-8) -> DataFrame:
    """For each column: compared, mismatching and exactly different values and the greatest difference."""
    j = old.join(new.select(key, *(F.col(c).alias(f"_{c}") for c in columns)), key)
    long = j.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("double").alias("a"), F.col(f"_{c}").cast("double").alias("b")) for c in columns))).alias("x")).select("x.*")
    diff = F.abs(F.col("a") - F.col("b"))
    far = (F.col("a").isNull() != F.col("b").isNull()) | F.coalesce(diff > atol + rtol * F.abs("b"), F.lit(False))
    return long.groupBy("attribute").agg(F.count("*").alias("compared"), F.count_if(far).alias("mismatches"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("inexact"), F.max(diff).alias("greatest"))


def stale(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Sources whose fingerprint is new or changed: what an incremental run computes again."""
    return now.join(before, [key, "fingerprint"], "left_anti")


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def require(rows: DataFrame, faults: DataFrame, message: str) -> DataFrame:
    """rows, or an error if `faults` has any row; checked where the rows are read, by one row of a count."""
    bad = faults.agg(F.count("*").alias("_bad"))  # one row
    ok = F.when(F.col("_bad") > 0, F.raise_error(F.concat(F.lit(message + ": "), F.col("_bad").cast("string"))).cast("boolean")).otherwise(True)
    return rows.crossJoin(F.broadcast(bad)).filter(ok).drop("_bad")


def lookup(rows: DataFrame, dimension: DataFrame, key: str, other: str) -> DataFrame:
    """rows with the columns of a dimension by key; a key that is null or that the dimension lacks is an error."""
    unknown = rows.select(key).join(dimension, F.col(key) == F.col(other), "left_anti")
    return require(rows.join(dimension, F.col(key) == F.col(other)).drop(other), unknown, f"unknown {key}")


def exactly(rows: DataFrame, part: str, n: int) -> DataFrame:
    """rows, or an error if a part has not n of them."""
    return require(rows, rows.groupBy(part).agg(F.count("*").alias("_n")).filter(F.col("_n") != n), f"parts without {n} rows")


def single_value(rows: DataFrame, part: str, value: str) -> DataFrame:
    """part, value and n_rows of each part; a part with two values or none is an error."""
    s = rows.groupBy(part).agg(F.min(value).alias(value), F.count_distinct(value).alias("_k"), F.count("*").alias("n_rows"))
    return require(s.drop("_k"), s.filter("_k <> 1"), f"parts without one {value}")


def label_merge(rows: DataFrame, notes: DataFrame, key: str, label: str, value: Column, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows with the labels of notes by trimmed id, the notes whose `value` (1, 0 or null) is null, and one row of counts.

    Notes without id do not count. With `order`, of several valid notes of one id the last is taken; without, they are an
    error. A row without a note keeps its label. Counts: annotation_valid, annotation_invalid, rows_updated, labelled, true, false rows.
    """
    d = notes.withColumns({"_k": F.trim(F.col(key).cast("string")), "_v": value}).filter("_k <> ''")
    invalid, valid = d.filter("_v is null").drop("_k", "_v"), d.filter("_v is not null")
    if order:
        valid = valid.groupBy("_k").agg(F.max_by("_v", order).alias("_v"))
    else:
        valid = require(valid.select("_k", "_v"), valid.groupBy("_k").agg(F.count("*").alias("n")).filter("n > 1"), "ids with several labels")
    out = rows.withColumn("_id", F.trim(F.col(key).cast("string"))).join(valid.select("_k", "_v"), F.col("_id") == F.col("_k"), "left")
    updated = out.agg(F.count("_v").alias("rows_updated"), F.count_if(F.coalesce("_v", label).isin(0, 1)).alias("labelled_rows"), F.count_if(F.coalesce("_v", label) == 1).alias("true_rows"), F.count_if(F.coalesce("_v", label) == 0).alias("false_rows"))
    n = valid.agg(F.count("*").alias("annotation_valid")).crossJoin(invalid.agg(F.count("*").alias("annotation_invalid"))).crossJoin(updated)  # one row each
    return out.withColumn(label, F.coalesce("_v", label)).drop("_id", "_k", "_v"), invalid, n


def folder_labels(rows: DataFrame, true_ids: DataFrame, false_ids: DataFrame, key: str, label: str, strict: bool = False) -> DataFrame:
    """rows with the labels of two sets of ids: 1 where both have it, or an error if `strict`; rows in neither keep theirs."""
    each = lambda d, v: d.select(F.trim(F.col(key).cast("string")).alias("_k"), F.lit(v).alias("_v"))
    by = each(true_ids, 1).unionByName(each(false_ids, 0)).groupBy("_k").agg(F.max("_v").alias("_v"), F.count_distinct("_v").alias("_n"))
    d = rows.withColumn("_id", F.trim(F.col(key).cast("string"))).join(by.drop("_n"), F.col("_id") == F.col("_k"), "left").withColumn(label, F.coalesce("_v", label)).drop("_id", "_k", "_v")
    return require(d, by.filter("_n > 1"), "ids in both folders") if strict else d


def annotation_tasks(rows: DataFrame, images: DataFrame, key: str, label: str, only_unlabelled: bool = True, most: int = 0, seed: int = 0, drop_missing: bool = False) -> DataFrame:
    """Rows to annotate: id, image (of images: stem, image; empty if there is none), empty fields to fill in, source, m/z and RT.

    Unlabelled ones only, `most` of them in hash order (all for 0), those with an image only if `drop_missing`; rows without id go.
    """
    d = rows.withColumn("Feature_ID", F.trim(F.col(key).cast("string")))
    d = d.filter(F.col(label).isNull() | (F.trim(F.col(label).cast("string")) == "")) if only_unlabelled else d
    d = hash_ranks(d, [], "Feature_ID", seed, F.lit(most)).drop("rank") if most else d
    first = images.groupBy(F.col("stem").alias("_stem")).agg(F.min("image").alias("image"))
    d = d.filter("Feature_ID <> ''").join(first, F.col("Feature_ID") == F.col("_stem"), "left")
    d = d.filter(F.trim("image") != "") if drop_missing else d
    empty = F.lit("")
    return d.select("Feature_ID", F.coalesce("image", empty).alias("image"), empty.alias("is_true_peak"), empty.alias("annotator"), empty.alias("comment"), "source_file", "mz", "RT")


class PartStore:
    """Computed parts, one for each source, that are computed again only if the source or its jobs changed.

    A folder holds run folders, whose rows name the fingerprint of their part; a part exists when its run's commit marker
    does, which Spark writes last, so a lost executor or a killed run leaves no half part. What a source's part is named after is a
    digest of all its job ids and of its own hash, so an unchanged source finds its part, and a changed one does not.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def fingerprints(self, jobs: DataFrame, sources: DataFrame, source: str, job: str) -> DataFrame:
        """source, fingerprint, n_jobs: from (source, job) and (source, sha256); sums of job digests combine in the map tasks."""
        d = jobs.groupBy(source).agg(F.count("*").alias("n_jobs"), F.concat_ws(":", *(s.cast("string") for s in hash_sums(F.col(job).cast("string")))).alias("digest"))
        return d.join(sources, source).select(source, F.concat(F.lit("p"), F.sha2(F.concat_ws("|", F.col(source).cast("string"), "digest", "n_jobs", "sha256"), 256)).alias("fingerprint"), "n_jobs")

    def parts(self) -> DataFrame | None:
        """All committed parts, with fingerprint and _run; null before the first run. What a killed run left has no marker."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        path = hadoop(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().toString() for s in fs.listStatus(path)] if fs.exists(path) else []  # a folder for each run
        out = None
        for run in found:
            if fs.exists(hadoop(f"{run}/_SUCCESS")):
                d = self.spark.read.parquet(run).withColumn("_run", F.lit(run))
                out = d if out is None else out.unionByName(d, allowMissingColumns=True)
        return out

    def update(self, jobs: DataFrame, sources: DataFrame, source: str, job: str, compute) -> tuple[DataFrame, DataFrame]:
        """compute(jobs) for all sources; and the sources that were computed now. Parts of unchanged ones are read back.

        New parts are one run folder, sorted by fingerprint: a run has as many files as tasks, however many sources it has.
        """
        import uuid

        now = written(self.fingerprints(jobs, sources, source, job), "fingerprints")
        have = self.parts()
        todo = written(now.join(have.select("fingerprint").distinct(), "fingerprint", "left_anti") if have is not None else now, "stale")
        if not todo.isEmpty():
            asked = jobs.join(todo.select(source, "fingerprint"), source)
            done = compute(asked.drop("fingerprint")).join(todo.select(source, "fingerprint"), source)
            done.repartition("fingerprint").sortWithinPartitions("fingerprint").write.parquet(f"{self.folder}/run-{uuid.uuid4().hex}")
        parts = self.parts()  # of parts that two runs made at once, one is read
        first = parts.groupBy("fingerprint").agg(F.min("_run").alias("_run"))
        return parts.join(first, ["fingerprint", "_run"], "left_semi").join(now.select("fingerprint"), "fingerprint", "left_semi").drop("fingerprint", "_run"), todo.select(source, "n_jobs")
