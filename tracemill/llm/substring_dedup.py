"""Substring deduplication over words: De Bruijn compaction.

Windows of WINDOW words are the edges of a De Bruijn graph over the corpus, its nodes the WINDOW - 1 words that two
neighbouring windows share. The whole graph is never built: only windows under an anchor that occurs twice can be
repeated (runs.py), and consecutive windows under one anchor are a short path, one row from the start.

1. Paths of equal words are one path; those that stand somewhere twice are the graph.
2. Where an anchor has several paths the graph may branch inside them: one occurrence of each of these paths is expanded to
   edges, and edges that stand in several of them are the graph there.
3. Compaction: one path (or edge) follows another without branching if each occurrence of the one is followed by the
   other, and each of the other follows the one, which counts of neighbours tell. A join marks all occurrences of paths that
   follow so, and what is marked is one with what it stands behind, across anchors, whatever the length: a passage that two
   documents share is one unitig, however many words it has.
4. The removal is read off the unitigs: each has a number of occurrences and a source, the first of them (least document,
   then least place), and every other occurrence of its head, as long as the whole unitig, goes. What is inside a unitig
   moves no further, so a document gets a row for each unitig, not for each path.
5. Source coordinates verify: paths and edges are told apart by 128-bit BLAKE2 digests of the words at the coordinates of
   each occurrence, never by anchor or node hashes alone. In every document the spans are laid over the words again.

Edge cases: an empty table gives no rows; null and empty texts have no words; texts shorter than a window lose nothing;
long texts are read as numpy arrays in one task; of rows with the same id the one that sorts first by text counts as
earlier; null ids come last, and ids must be numbers; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, unique_ids, written
from .runs import CONTENT, Unit, Words, cover, flat, numbers, parts, per_text, repeated, salted_join

WINDOW, GRAM = 20, 5
#: What names an edge: its anchor and the two halves of the digest of its words.
EDGE = ["a", "e", "f"]


def _edges(docs: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """_id, p (start of the edge in its document, in words), a, e and f (digest) for the edges of the paths."""
    lists = paths.groupBy("_id").agg(F.collect_list(F.struct("first", "n", "a")).alias("runs"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        row, runs = flat(batch.column(3))
        first, n, a = (numbers(x) for x in runs.flatten())
        for lo, hi, data, offsets in parts(batch.column(2)):
            own = (row >= lo) & (row < hi)
            if not own.any():
                continue
            w = Words(data, offsets)
            size = n[own]
            which = np.repeat(np.arange(len(size)), size)
            p = first[own][which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            text = row[own][which]
            at = w.at[text - lo] + p
            blake, plain = hashlib.blake2b, w.plain
            spans = zip(w.place[at].tolist(), (w.place[at + window] - 1).tolist(), strict=True)
            digest = np.frombuffer(b"".join([blake(plain[x:y], digest_size=16).digest() for x, y in spans]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[text], pa.int64()), pa.array(p.astype(np.int32)), pa.array(a[own][which]), pa.array(digest[:, 0]), pa.array(digest[:, 1])], ["_id", "p", *EDGE])

    return per_text(docs, lists, ["runs"], work, "_id long, p int, a long, e long, f long")


def unitigs(occurrences: DataFrame, key: list[str], apart: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of unitigs: _id, first (edge), length (edges), source (whether it is the first one), copies.

    From occurrences of paths: _id, first, n (edges), `key`, copies (occurrences of the path), source. A unitig is a chain of
    paths each of which always follows the one before it; its occurrences are those of its head. Paths that differ in columns `apart` of the key follow
    only their like.
    """
    line = Window.partitionBy("_id", *apart).orderBy("first")
    head, tail = [f"h_{c}" for c in key], [f"t_{c}" for c in key]
    after = F.when(F.lead("first").over(line) == F.col("first") + F.col("n"), F.struct(*(F.lead(c).over(line).alias(t) for c, t in zip(key, tail, strict=True)), F.lead("copies").over(line).alias("t_copies")))
    pairs = occurrences.select(*(F.col(c).alias(h) for c, h in zip(key, head, strict=True)), "copies", after.alias("after")).filter("after is not null and copies = after.t_copies")
    links = pairs.groupBy(*head, "copies", *(f"after.{t}" for t in tail)).agg(F.count("*").alias("m")).filter("m = copies")
    follows = written(links.select(*(F.col(t).alias(c) for c, t in zip(key, tail, strict=True)), "copies"), "links")
    d = salted_join(occurrences, follows.select(*key, F.col("copies").alias("_copies"), F.lit(1).alias("follows")), key, "_copies", occurrences.count(), how="left").drop("_copies")
    # a path that always follows another stands behind it wherever it stands: each place that does not begins a unitig
    begins = F.sum(F.when(F.col("follows") == 1, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = d.withColumn("_unitig", begins).groupBy("_id", *apart, "_unitig")
    return rows.agg(F.min("first").alias("first"), F.sum("n").alias("length"), F.max("source").alias("source"), F.max("copies").alias("copies")).drop(*apart, "_unitig")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_spans, and kept_text (null unless `texts`)."""
    d = unique_ids(docs)
    paths = repeated(d, Unit(window, gram, True))
    first = (F.col("_id") == F.col("source")) & (F.col("k") == 0)
    whole = paths.filter("copies > 1").select("_id", "first", "n", *CONTENT, F.lit(0).alias("kind"), "copies", first.alias("source"))
    edges = written(_edges(d, paths.filter(first & (F.col("contents") > 1)).select("_id", "first", "n", "a"), window).withColumnRenamed("p", "first"), "edges")
    twice = edges.groupBy(*EDGE).agg(F.min("_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1")
    several = salted_join(edges, written(twice, "twice", small=True), EDGE, "copies", edges.count())
    inside = Window.partitionBy(*EDGE, "_id").orderBy("first")
    source = (F.col("_id") == F.col("least")) & (F.row_number().over(inside) == 1)
    several = several.select("_id", "first", F.lit(1).alias("n"), *(F.col(e).alias(c) for e, c in zip(EDGE, CONTENT, strict=True)), F.lit(1).alias("kind"), "copies", source.alias("source"))
    occurrences = written(whole.unionByName(several), "occurrences")
    discard(edges, paths)
    gone = written(unitigs(occurrences, ["kind", *CONTENT], ("kind",)).filter("not source").select("_id", "first", "length"), "gone")
    discard(occurrences)
    spans = gone.groupBy("_id").agg(F.collect_list(F.struct(F.col("first").alias("lo"), (F.col("first") + F.col("length") - 1).alias("hi"))).alias("spans"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, found = flat(batch.column(3))
        first, last = (numbers(x) for x in found.flatten())
        for lo, hi, data, offsets in parts(batch.column(2)):
            w = Words(data, offsets)
            own = (row >= lo) & (row < hi)
            base = w.at[row[own] - lo]
            gone = cover(len(w.starts), base + first[own], base + last[own] + window)
            removed, kept, n_spans = [], [], []
            for j in range(hi - lo):
                a, b = int(w.at[j]), int(w.at[j + 1])
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False])).view(np.int8)))
                stays = np.concatenate(([a], a + edge, [b])).reshape(-1, 2).tolist()
                kept.append(b" ".join([w.text(x, y) for x, y in stays if y > x]))
                removed.append(int(gone[a:b].sum()))
                n_spans.append(len(edge) // 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(lo, hi - lo), pa.array(np.diff(w.at), pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(n_spans, pa.int64()), pa.array([x.decode("utf-8", "replace") if texts else None for x in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans", "kept_text"],
            )

    return per_text(d, spans, ["spans"], work, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long, kept_text string")
