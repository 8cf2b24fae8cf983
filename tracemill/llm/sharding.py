"""Size-tiered sharding with a versioned manifest, in DataFrame functions only.

`append` writes an arrival as small immutable shards where it stands (no shuffle) and commits a manifest that adds
them. `compact` takes shards of one size tier, packs them in order into target-sized files (one job, one shuffle by
target file), checks rows and checksums of what it wrote against what it read, and commits a manifest that swaps them.
Readers see whole versions only: a manifest is a Parquet table of its own, and a version exists once its pointer file
has been renamed into place, a rename that fails if the version is already there. A lost executor only repeats tasks;
a lost driver leaves files that no manifest names, which `expire` removes.

Row keys play no part in the placement, so a hot source or a group of copies cannot overload a file. Merged files are
numbered, and each is one partition of the merge's shuffle: no task has two of them.

Edge cases: an empty arrival commits a version without new shards, and a store of empty arrivals reads as an empty table
of their columns; null columns, repeated rows and very long texts are stored as they are; arrivals may bring new columns
of any names: the version's schema has all columns in the order they came, and rows of older shards have nulls there;
two writers of one version: the second fails and can try again on the new version.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of a merged file; shards of at least half of it are left alone.
TARGET_BYTES = 64 << 20
#: A tier holds shards of sizes within this factor; it is merged once it has this many shards.
TIER_FACTOR, FAN_IN = 4, 4
SMALLEST_TIER = 1 << 18
CODEC = "zstd"

MANIFEST = "path string, n_rows bigint, n_bytes bigint, checksum bigint"


class ShardStore:
    """Shards of one table under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, top = self._fs(), self._path(f"{self.root}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(top) if s.getPath().getName().isdigit()) if fs.exists(top) else []

    def _write_text(self, path: str, text: str) -> None:
        out = self._fs().create(self._path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _pointer(self, version: int | None) -> list[str] | None:
        """Name of the manifest and schema (JSON) of a version, or of the last one; None while nothing has been committed."""
        known = self.versions()
        if not known:
            return None
        at = known[-1] if version is None else version
        return [r.value for r in self.spark.read.text(f"{self.root}/versions/{at:012d}", wholetext=True).collect()][0].split("\n", 1)

    def manifest(self, version: int | None = None) -> DataFrame:
        found = self._pointer(version)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{found[0]}") if found else self.spark.createDataFrame([], MANIFEST)

    def schema(self, version: int | None = None) -> T.StructType:
        found = self._pointer(version)
        return T.StructType.fromJson(json.loads(found[1])) if found else T.StructType()

    def commit(self, rows: DataFrame, base: int, schema: T.StructType | None = None) -> int:
        """Publish a manifest as the version after `base`; fails if another writer has published that version."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/manifests/{name}")
        fs, version = self._fs(), base + 1
        staged = f"{self.root}/staged/{name}"
        self._write_text(staged, f"{name}\n{(schema or self.schema()).json()}")
        fs.mkdirs(self._path(f"{self.root}/versions"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(option, 1)
        none[0] = option.NONE
        context.rename(self._path(staged), self._path(f"{self.root}/versions/{version:012d}"), none)
        return version

    def _stats(self, path: str, schema: T.StructType) -> DataFrame:
        """Rows of the manifest for the files of a folder; the checksum does not depend on the order of rows, nor on null columns."""
        row = F.struct("*").alias("row")
        d = self.spark.read.schema(schema).parquet(path).select(row, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        return d.groupBy("path").agg(
            F.count("*").alias("n_rows"), F.max("size").alias("n_bytes"), F.sum(F.shiftrightunsigned(F.xxhash64(*(f"row.`{c}`" for c in schema.names)), 32)).alias("checksum")
        )

    def _writing(self, folder: str) -> str:
        """Mark a data folder as being written; `expire` leaves it alone until the mark goes or is old."""
        self._write_text(f"{self.root}/writing/{folder}", "")
        return f"{self.root}/data/{folder}"

    def _written(self, folder: str) -> None:
        self._fs().delete(self._path(f"{self.root}/writing/{folder}"), False)

    def append(self, docs: DataFrame) -> int:
        known = self.versions()
        base, folder = known[-1] if known else 0, uuid.uuid4().hex
        path, schema = self._writing(folder), self.schema()
        for field in docs.schema:
            if field.name not in schema.names:
                schema = schema.add(field.name, field.dataType, True)
        docs.write.option("compression", CODEC).parquet(path)
        version = self.commit(self.manifest().unionByName(self._stats(path, schema)).coalesce(1), base, schema)
        self._written(folder)
        return version

    def plan(self, target_bytes: int = TARGET_BYTES) -> DataFrame:
        """path, target: which merged file takes each shard; tiers with too few shards are not in it."""
        small = self.manifest().filter((F.col("n_bytes") < target_bytes // 2) & (F.col("n_rows") > 0))
        tier = F.floor(F.log(F.greatest(F.lit(1.0), F.col("n_bytes") / SMALLEST_TIER)) / F.log(F.lit(float(TIER_FACTOR))))
        by_tier = Window.partitionBy("tier")
        before = F.sum("n_bytes").over(by_tier.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
        return (
            small.withColumn("tier", tier).withColumn("n", F.count("*").over(by_tier)).filter(F.col("n") >= FAN_IN)
            .select("path", F.concat_ws("-", "tier", F.floor(F.coalesce(before, F.lit(0)) / target_bytes)).alias("target"))
        )

    def compact(self, target_bytes: int = TARGET_BYTES) -> int | None:
        """Merge one round of tiers; the new version, or None when no tier is full."""
        base, old, schema, folder = (self.versions() or [0])[-1], self.manifest(), self.schema(), uuid.uuid4().hex
        plan = self.plan(target_bytes)
        paths = [r.path for r in plan.select("path").collect()]  # file names only, as many as the reader itself lists
        if not paths:
            return None
        # a number for each merged file; the list of files comes from a written table, so Spark knows its size for the join
        dealt = plan.select("path", (F.dense_rank().over(Window.orderBy("target")) - 1).alias("number"))
        n = plan.select("target").distinct().count()
        merged = self._writing(folder)
        rows = self.spark.read.schema(schema).parquet(*paths).select(F.struct("*").alias("row"), F.col("_metadata.file_path").alias("path"))
        rows.join(dealt, "path").repartitionById(n, "number").select("row.*").write.option("compression", CODEC).parquet(merged)
        fresh = self._stats(merged, schema)
        total = [F.sum("n_rows").alias("r"), F.sum(F.col("checksum").cast("decimal(38,0)")).alias("c")]
        was, now = old.join(plan, "path", "left_semi").agg(*total).first(), fresh.agg(*total).first()
        if was != now:
            raise RuntimeError(f"compaction lost or changed rows: {was} became {now}")
        version = self.commit(old.join(plan, "path", "left_anti").unionByName(fresh).coalesce(1), base, schema)
        self._written(folder)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with all columns of its schema."""
        schema = self.schema(version)
        if not schema.names:
            raise ValueError("nothing has been appended to the store yet")
        paths = [r.path for r in self.manifest(version).select("path").collect()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def expire(self, keep: int = 1, hours: float = 24.0) -> int:
        """Remove data files that none of the last `keep` versions names; returns how many.

        Folders that are being written stay, unless the writer's mark is more than `hours` old: then it was lost.
        """
        live = {r.path.rpartition("/")[2] for v in self.versions()[-keep:] for r in self.manifest(v).select("path").collect()}
        fs, gone, writing = self._fs(), 0, set()
        if fs.exists(marks := self._path(f"{self.root}/writing")):
            writing = {s.getPath().getName() for s in fs.listStatus(marks) if time.time() - s.getModificationTime() / 1000 < 3600 * hours}
        files = fs.listFiles(self._path(f"{self.root}/data"), True)
        while files.hasNext():
            p = files.next().getPath()
            if p.getName().endswith(".parquet") and p.getName() not in live and p.getParent().getName() not in writing:
                gone += bool(fs.delete(p, False))
        return gone
