"""Files as tables: feature tables, manifests, annotation documents, hashes, inventories and split outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import numbered

MANIFEST = "sample_id string, image_path string, boxes array<array<double>>, seed_box array<double>, seed_label int, attributes array<double>, source_file string, study_id string, instrument_id string, subsets array<string>, metadata map<string,string>"
ANNOTATION = "shapes array<struct<label:string,points:array<array<double>>,shape_type:string>>, imageWidth int, imageHeight int"


def feature_table(spark: SparkSession, path: str, schema: str | None = None, order: list[str] | None = None) -> DataFrame:
    """A detector's CSV; rows without Feature_ID column get F000001 ... in the given order."""
    reader = spark.read.option("header", "true")
    rows = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)
    return rows if "Feature_ID" in rows.columns else numbered(rows, order or rows.columns, "F", "Feature_ID")


def newest(spark: SparkSession, pattern: str) -> str | None:
    """Path of the file of a glob that was changed last; of equals the greater path."""
    found = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    row = found.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row.path


def locate(spark: SparkSession, folder: str, name: str | None = None, preferred: str | None = None, full: str | None = None, pattern: str = "*.csv") -> str | None:
    """Path of a detector's table in a folder: the fixed name; else the preferred one, if it is there, else the full one; else the
    newest file of the pattern. Null if there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for one in ((name,) if name else (preferred, full)):
        if one and fs.exists(fs_path(f"{folder}/{one}")):
            return f"{folder}/{one}"
    if name or not fs.exists(fs_path(folder)) or not fs.globStatus(fs_path(f"{folder}/{pattern}")):
        return None
    return newest(spark, f"{folder}/{pattern}")


def manifest(spark: SparkSession, path: str, n_attributes: int = 16) -> DataFrame:
    """Records of a JSON-lines manifest; blank lines are skipped, a line that does not fit the schema is an error that shows it."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    rows = raw.select("value", F.from_json("value", MANIFEST + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    ok = F.col("r._bad").isNull() & F.col("r.sample_id").isNotNull() & (F.coalesce(F.size("r.attributes"), F.lit(n_attributes)) == n_attributes)
    return rows.filter(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("bad manifest line: "), F.substring("value", 1, 200))).cast("boolean"))).select("r.*").drop("_bad")


def save_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines; NaN is an error."""
    checked = rows.withColumn("attributes", F.transform("attributes", lambda v: F.when(F.isnan(v), F.raise_error(F.lit("NaN in attributes")).cast("double")).otherwise(v)))
    checked.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def annotations(spark: SparkSession, pattern: str, labels: list[str] | None = None) -> DataFrame:
    """stem, label, points of each shape of annotation documents, one file a document."""
    d = spark.read.option("wholetext", "true").text(pattern).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), F.from_json("value", ANNOTATION).alias("d"))
    s = d.select("stem", F.explode("d.shapes").alias("s")).select("stem", "s.label", "s.points")
    return s.filter(F.col("label").isin(*labels)) if labels else s


def hashes(spark: SparkSession, pattern: str, names: str | None = None) -> DataFrame:
    """path, kind, size and SHA-256 of files: those of a glob; or, with a glob of their names, those of a folder and all
    folders in it, which tasks list and not the driver."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", names) if names else reader
    return reader.load(pattern).select("path", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def pairs(spark: SparkSession, images: str, documents: str) -> DataFrame:
    """stem, image, document, aligned: files of two globs by stem; the first path of a stem wins, hidden folders do not count."""
    def by_stem(pattern: str, name: str) -> DataFrame:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path").filter(~F.col("path").rlike(r"/\.[^/]+/"))
        return f.groupBy(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem")).agg(F.min("path").alias(name))

    return by_stem(images, "image").join(by_stem(documents, "document"), "stem", "full").withColumn("aligned", F.col("image").isNotNull() & F.col("document").isNotNull())


def resolve(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """name, path, status (found, missing, conflict): names matched in any case; several files must have one hash, the shortest path is taken."""
    by_name = inventory.groupBy(F.lower("name").alias("k")).agg(F.count_distinct("sha256").alias("n"), F.min_by("path", F.struct(F.length("path"), F.lower("path"))).alias("path"))
    j = wanted.join(by_name, F.lower("name") == F.col("k"), "left")
    return j.select("name", F.when(F.col("n") == 1, F.col("path")).alias("path"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "conflict").otherwise("found").alias("status"))


def save_splits(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder for each split."""
    rows.write.partitionBy("split").format(kind).save(path)
