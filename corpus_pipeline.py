"""The corpus pipeline: documents through quality rules, three deduplications and packing.

Each stage reads what the stage before wrote. The last returns packed pieces, all others the columns of documents:

1. quality rules: documents that fail go; failing lines of the others are removed.
2. exact dedup: of equal texts one row stays, the one with the smallest doc_id.
3. near duplicates: of documents that links of Jaccard similarity 0.8 or more on five-word shingles join, the one with
   the smallest doc_id stays, as one row.
4. repeated substrings: bytes of strings that stand in several places are removed (a character cut by that goes whole);
   documents of which nothing is left go.
5. packing: token ids in sequences of 4096.

Stages 2 and 3 tell rows apart by a key of their own, not by doc_id: rows with null or repeated ids are rows like all
others, null ids come last, and of equal rows one stays.

Edge cases, in every stage: an empty table gives an empty table of the same columns; a null text counts as empty and
comes out empty (stages 1 and 4 remove empty documents, 2 and 3 keep one of them and all of them, 5 packs the end id);
a text of any length is one row; nulls in other columns pass; further columns pass whatever their names (n_chars follows
the text), as they travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import exact_dedup, jaccard_join, packing, quality_rules, suffix_dedup
from tracemill.llm.common import shared_dir, table, unique_ids, written
from tracemill.llm.queries import tokenizer


#: Words of a shingle and least similarity in percent of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80
#: Pieces and parts that a worker remembers in packing: executors are still full of the stages before.
REMEMBERED = 120_000, 80_000


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, a unique key _id in the order of both, and all other columns in the struct keep."""
    return unique_ids(docs, tuple(c for c in docs.columns if c not in ("doc_id", "text")))


def _columns(names: list[str]) -> list[Column]:
    """The columns of documents, from keyed rows."""
    return [F.col(c) if c in ("doc_id", "text") else F.col(f"keep.`{c}`") for c in names]


def _by_key(keyed: DataFrame) -> DataFrame:
    """What an operator reads to name rows by their key."""
    return keyed.select(F.col("_id").alias("doc_id"), "text")


def _without(keyed: DataFrame, gone: DataFrame, names: list[str], name: str) -> DataFrame:
    """The dropped keys are written first: Spark sees their size, and moves the texts only if they are many."""
    return keyed.join(written(gone.select(F.col("doc_id").alias("_id")), name), "_id", "left_anti").select(*_columns(names))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    return _without(keyed, exact_dedup.groups(_by_key(keyed)).filter("not kept"), docs.columns, "copies")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    links = jaccard_join.components(_by_key(keyed), PERCENT, SHINGLE)
    return _without(keyed, links.filter("doc_id != component_id"), docs.columns, "near-copies")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")), packed=True)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return left.filter("kept_text != ''").select(*(new[c].alias(c) if c in new else x for c, x in zip(docs.columns, _columns(docs.columns), strict=True)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("suffix-array dedup", substrings),
    ("packing", pack),
]

#: Suffix-array removal and packing are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
