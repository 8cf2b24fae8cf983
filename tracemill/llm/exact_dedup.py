"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its content says so (after a sentence mark, between a least and a greatest length), so
equal texts have equal chunks wherever they stand. Each chunk's bytes are shuffled once, into the chunk dictionary,
where an identifier is verified: it must name one chunk text only. A document is then its ordered list of identifiers
(the recipe), a fiftieth of its text, and only recipes are grouped and joined. If two chunk texts ever share an
identifier, all recipes are made of whole SHA-256 digests instead, so the result stays exact.

Hot groups: grouping recipes combines in the map tasks first, so a group of any size sends one row per task; the join
back has one row per group on its small side, and adaptive execution can split the large one.

Edge cases: an empty table gives no rows; null texts count as empty, and all empty texts are one group; a very long text
is one row with a recipe of a fiftieth of its length; of rows with the same id and the same text each counts in
group_size and each is marked kept if the id is the group's smallest; null ids never win over others; further columns
are ignored, or pass through `keep` in a struct, so their names cannot clash (result columns win over kept ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, struct_of, text_or_empty

#: Least and greatest chunk length in UTF-16 units; a chunk ends after the first sentence mark between them.
MIN_CHUNK, MAX_CHUNK = 256, 2048
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[.!?,;:|] )|.{{1,{MAX_CHUNK}}}"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), WS, " ")


def chunks(text: Column) -> Column:
    """Content-defined chunks, in order; joined they give the text. None for an empty text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def collisions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Identifiers of more than one chunk text. Each distinct chunk is moved once, after combining in the map tasks."""
    rows = docs.select(F.explode(chunks(normalised(text))).alias("chunk")).select(identifier(F.col("chunk")).alias("id"), "chunk")
    return rows.groupBy("id", "chunk").agg(F.lit(1).alias("one")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def _recipes(docs: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """keep (a struct), doc_id, recipe and text_sha256 of each row."""
    d = docs.select(struct_of(keep, "keep"), "doc_id", normalised(text).alias("norm")).select("keep", "doc_id", "norm", chunks(F.col("norm")).alias("chunks"))
    verified = collisions(docs, text).isEmpty()
    name = identifier if verified else lambda c: F.sha2(c, 256)
    return d.select("keep", "doc_id", F.transform("chunks", lambda c: name(c)).alias("recipe"), F.sha2("norm", 256).alias("text_sha256"))


def recipes(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, recipe (verified chunk identifiers in order) and text_sha256 of each row."""
    return _recipes(docs, keep, text).select(*(F.col(f"keep.`{c}`") for c in keep if c not in ("recipe", "text_sha256")), "recipe", "text_sha256")


def groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per input row: keep columns, keep_id, group_size, kept, text_sha256."""
    rows = _recipes(docs, keep, text)
    result = {
        "keep_id": F.col("keep_id"), "group_size": F.col("group_size"), "kept": F.col("doc_id").eqNullSafe(F.col("keep_id")), "text_sha256": F.col("text_sha256")
    }
    best = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(best, "recipe").select(*(F.col(f"keep.`{c}`") for c in keep if c not in result), *(v.alias(c) for c, v in result.items()))
