"""Runs of windows that share an anchor: the common first half of the two substring deduplications.

A window is a fixed number of units (words or bytes). Winnowing gives each window an anchor, its least gram; equal
windows have equal anchors, so only windows under an anchor that occurs twice can be repeated. Consecutive windows
with one anchor form a run, and a run is one row: an eighth of the words, an eighty-fifth of the bytes. A run's content
is told apart by a 128-bit BLAKE2 digest of its words or bytes, so runs of equal digests are the same text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .textnum import anchored_runs, buffer_of, byte_grams, gram_hashes, pieces, word_hashes, word_spans

#: What names the content of a run: its anchor and the two halves of its digest.
CONTENT = ["a", "s", "z"]
#: A key with more than this part of all rows is hot; parts that its rows are dealt over.
HOT, SALTS = 1000, 64


class Words:
    """The words of some texts, and their bytes with one space behind each word, whatever stood between them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.at = word_spans(data, offsets)
        size = self.ends - self.starts
        self.place = np.concatenate(([0], np.cumsum(size + 1)))
        plain = np.full(int(self.place[-1]), 32, np.uint8)
        shift = np.repeat(self.place[:-1] - self.starts, size)
        solid = np.arange(int(size.sum())) + np.repeat(self.starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(size) else np.zeros(0, np.int64)
        plain[solid + shift] = data[solid]
        self.plain = plain.tobytes()

    def text(self, first: int, end: int) -> bytes:
        """Words first to end - 1, joined by one space."""
        return self.plain[self.place[first] : self.place[end] - 1] if end > first else b""


class Unit:
    """How a text is read as units."""

    def __init__(self, window: int, gram: int, by_word: bool):
        self.window, self.gram, self.by_word = window, gram, by_word

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """The runs of some texts, n + 1 offsets of each text's units, and the 16-byte digest of each run."""
        if self.by_word:
            w = Words(data, offsets)
            at, raw, place = w.at, w.plain, w.place
            grams = gram_hashes(word_hashes(data, w.starts, w.ends), self.gram)
        else:
            at, raw, place = offsets, data.tobytes(), None
            grams = byte_grams(data, self.gram)
        r = anchored_runs(grams, at, self.gram, self.window)
        lo, hi = r["first"], r["last"] + self.window
        if place is not None:
            lo, hi = place[lo], place[hi]
        blake = hashlib.blake2b
        digests = b"".join([blake(raw[x:y], digest_size=16).digest() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
        return r, at, np.frombuffer(digests, np.int64).reshape(-1, 2)


def ordinals(keys: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... of each row among the rows of equal keys before it; keys is two-dimensional."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.lexsort(keys.T)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(1)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys)) - np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return rank


def parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """An Arrow array of texts in pieces that fit the caches: first and last row, bytes, offsets."""
    data, offsets = buffer_of(texts)
    for lo, hi in pieces(offsets, 1 << 17):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def anchored(docs: DataFrame, unit: Unit) -> DataFrame:
    """_id, first (unit where the first window starts), n (windows), k (ordinal among equal runs of the document), and
    the content of each run."""
    names = ["_id", "first", "n", "k", *CONTENT]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for lo, hi, data, offsets in parts(batch.column(1)):
                r, at, digest = unit.runs(data, offsets)
                text = r["text"]
                k = ordinals(np.column_stack((text, r["anchor"].view(np.int64), digest)))
                out.append((ids[lo:hi][text], r["first"] - at[text], r["last"] - r["first"] + 1, k, r["anchor"].view(np.int64), digest[:, 0], digest[:, 1]))
            if out:
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if n in ("first", "n", "k") else c) for n, c in zip(names, cols, strict=True)], names)

    return docs.select("_id", "text").mapInArrow(emit, "_id long, first int, n int, k int, a long, s long, z long")


def is_hot(count: str, total: int) -> Column:
    return F.col(count) > total // HOT


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, total: int, hint: str | None = None, how: str = "inner") -> DataFrame:
    """Join (inner, or left) of many rows with one row for each key, which has the number of its rows in the column `count`.

    A key with more than a HOT-th of all rows is dealt over SALTS parts, its one row to each of them. There are fewer than
    HOT such keys, whatever the data, so they are sent to all tasks.
    """
    hot = is_hot(count, total)
    few = keys.filter(hot).select(*on, F.lit(True).alias("_hot"))
    many = rows.join(F.broadcast(few), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", "first"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    one = keys.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return many.join(one.hint(hint) if hint else one, [*on, "_salt"], how).drop("_salt")


def repeated(docs: DataFrame, unit: Unit) -> DataFrame:
    """The runs whose anchor occurs twice or more, with source and other (least and greatest _id), copies (of the
    content) and contents (of the anchor).

    All runs are written once. The counts combine in the map tasks, so a hot anchor sends one row per task; in the joins
    back each key has one row on the small side, and hot keys are salted.
    """
    runs = written(anchored(docs, unit), "runs")
    total = runs.count()
    twice = written(runs.groupBy("a").agg(F.count("*").alias("m")).filter("m > 1"), "anchors")
    found = written(salted_join(runs, twice, ["a"], "m", total, "shuffle_hash").drop("m"), "anchored")
    discard(runs)
    contents = written(found.groupBy(*CONTENT).agg(F.min("_id").alias("source"), F.max("_id").alias("other"), F.count("*").alias("copies"), F.min("first").alias("first")), "contents")
    several = written(contents.groupBy("a").agg(F.count("*").alias("contents")), "several")
    named = written(salted_join(contents.withColumn("_id", F.col("source")), several, ["a"], "contents", total).drop("_id", "first"), "named")
    discard(twice, contents, several)
    paths = written(salted_join(found, named, CONTENT, "copies", total), "paths")
    discard(found, named)
    return paths


def per_text(docs: DataFrame, lists: DataFrame, names: list[str], work: Callable, schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """Join all documents with lists of spans by _id, and call work(batch) for each Arrow batch (doc columns first).

    Two such joins in one plan share the one shuffle of the texts, as both are left joins of the same columns.
    """
    joined = docs.select("_id", "doc_id", "text", *keep).join(lists, "_id", "left").select("_id", "doc_id", "text", *names, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return joined.mapInArrow(run, schema)


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row index and value of each element of an Arrow list array; null lists have none."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    row = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), row), lists.flatten()


def numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n units lie in at least one of the spans."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1) if len(starts) else np.zeros(n + 1, np.int64)
    return np.cumsum(change[:n]) > 0
