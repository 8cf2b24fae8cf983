"""Ranked lexical search by bags: documents that no item can tell apart are scored once.

1. The distinct terms of all items are the vocabulary. Each document is counted over it: terms and occurrences.
2. Documents of equal length norm m and equal counts are one class: grouped by a hash of both, told apart by both
   themselves. A class keeps its ten smallest doc_ids, as no item can show more; these are cut in the map tasks first, so
   a class of any size moves ten rows a task.
3. Items go in blocks of bounded size, stated to all tasks. A task adds up the scores of its classes, and keeps the ten
   best classes of each item; the best of all tasks are expanded to their members by ascending doc_id.

The vocabulary is broadcast if it has at most VOCABULARY terms, checked before; else all terms of the documents meet it
in a join, which Spark splits where a term is frequent. Both give the same rows.

Edge cases: null and empty texts have no terms and are in no list; a text of any length is one row, counted in one task;
rows of one item_id are one item with the terms of all of them, null being an id like others, and an item without terms
has no rows; documents of equal doc_id are documents of their own, and null doc_ids come last among equal scores; empty
tables give no rows; ids of documents must be numbers; further columns, whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Documents of an item's list; most terms of a broadcast vocabulary; most terms and items of a block (a longer item is one of its own).
TOP, VOCABULARY, BLOCK, ITEMS = 10, 500_000, 1 << 18, 4096
#: Sums made at a time when scores are added up.
STEP = 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes of UTF-8: all bytes of other characters belong to terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def _counted(docs: DataFrame, vocabulary: DataFrame, most: int) -> DataFrame:
    """doc_id, n (terms with repeats), terms (ascending numbers of the vocabulary), tfs of documents that have a term."""
    source = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    spark, schema = docs.sparkSession, "doc_id long, n long, terms array<long>, tfs array<long>"
    if len(rows := vocabulary.limit(most + 1).collect()) <= most:
        known = spark.sparkContext.broadcast({r.term.encode(): r.number for r in rows})

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = known.value
            for batch in batches:
                ids, ns, found, times = [], [], [], []
                for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                    words = text.as_py().translate(FOLD).split()
                    if words:
                        t, k = np.unique(np.array([numbers[w] for w in words if w in numbers], np.int64), return_counts=True)
                        ids.append(doc_id.as_py())
                        ns.append(len(words))
                        found.append(t)
                        times.append(k)
                cuts = np.concatenate(([0], np.cumsum([len(t) for t in found]))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cuts, np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in (found, times)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

        return source.mapInArrow(count, schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words, times = np.unique(np.array(text.as_py().translate(FOLD).split(), object), return_counts=True)
                k = len(words)
                if k:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * k), pa.array([doc_id.as_py()] * k, pa.int64()), pa.array([int(times.sum())] * k), pa.array([w.decode() for w in words]), pa.array(times, pa.int64())], ["row", "doc_id", "n", "term", "tf"]
                    )
                row += 1

    each = written(source.mapInArrow(spread, "row long, doc_id long, n long, term string, tf long"), "terms")
    met = each.join(vocabulary.hint("merge"), "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("number", "tf"))).alias("x"))  # a document's terms
    whole = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"))  # equal in all rows of a document
    x = F.coalesce("x", F.array().cast("array<struct<number:long,tf:long>>"))
    return whole.join(met, "row", "left").select("doc_id", "n", F.transform(x, lambda s: s["number"]).alias("terms"), F.transform(x, lambda s: s["tf"]).alias("tfs"))


def _blocks(items: DataFrame, block: int, most: int) -> Iterator[list]:
    """Items in blocks of bounded size; the driver holds one at a time."""
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and (size + len(r.terms) > block or len(held) == most):
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r.terms)
    if held:
        yield held


class _Best:
    """The best classes of each item: score, smallest doc_id, members."""

    def __init__(self, n: int, top: int):
        self.top, self.least = top, np.ones(n, np.int64)
        self.item, self.score, self.first, self.members = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, scores: np.ndarray, first: np.ndarray, members: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        all_item, all_score = np.concatenate((self.item, item)), np.concatenate((self.score, scores[row, item]))
        all_first, all_members = np.concatenate((self.first, first[row])), np.concatenate((self.members, members[row]))
        order = np.lexsort((all_first, -all_score, all_item))
        sorted_items = all_item[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items)
        order = order[place < self.top]
        last = order[place[place < self.top] == self.top - 1]
        self.item, self.score, self.first, self.members = all_item[order], all_score[order], all_first[order], all_members[order]
        self.least[all_item[last]] = all_score[last]  # an equal score may have a smaller doc_id


def _score(batches: Iterator[pa.RecordBatch], stated: tuple, top: int) -> Iterator[pa.RecordBatch]:
    ids, numbers, weights, starts, postings = stated
    best = _Best(len(ids), top)
    for batch in batches:
        lists = batch.column(1)
        cuts = lists.offsets.to_numpy()
        term, tf = lists.values.to_numpy()[cuts[0] : cuts[-1]], batch.column(2).flatten().to_numpy()
        row, m = np.repeat(np.arange(batch.num_rows), np.diff(cuts)), batch.column(0).to_numpy()
        at = np.minimum(np.searchsorted(numbers, term), len(numbers) - 1)
        of_block = numbers[at] == term
        at, tf, row = at[of_block], tf[of_block], row[of_block]
        value = weights[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
        sizes = starts[at + 1] - starts[at]
        work = np.concatenate(([0], np.cumsum(np.bincount(row, sizes, batch.num_rows).astype(np.int64) + len(ids))))
        members = np.empty(batch.num_rows, object)
        members[:] = batch.column(3).to_pylist()
        first = np.array([np.iinfo(np.int64).max if x[0] is None else x[0] for x in members], np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(work, work[lo] + STEP, "right")) - 1)
            a, b = np.searchsorted(row, (lo, hi))
            n = sizes[a:b]
            where = np.repeat(starts[at[a:b]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if b > a else np.zeros(0, np.int64)
            scores = np.zeros((hi - lo) * len(ids), np.int64)
            np.add.at(scores, np.repeat((row[a:b] - lo) * len(ids), n) + postings[where], np.repeat(value[a:b], n))
            best.add(scores.reshape(hi - lo, len(ids)), first[lo:hi], members[lo:hi])
            lo = hi
    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.item], pa.int64()), pa.array(best.score), pa.array(list(best.members), pa.list_(pa.int64()))], ["item_id", "score", "members"])


def search(docs: DataFrame, items: DataFrame, top: int = TOP, vocabulary: int = VOCABULARY, block: int = BLOCK, most: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` documents of each item with a score above 0."""
    spark = docs.sparkSession
    wanted = written(items.select(F.col("item_id").cast("long"), F.explode(terms(text_or_empty())).alias("term")).distinct(), "item-terms")
    words = written(wanted.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "vocabulary")
    counted = written(_counted(docs, words, vocabulary), "counted")
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not total.docs:
        return result
    df = counted.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total.docs + 2) / (2 * F.col("df") + 1))).cast("long")
    by_item = written(
        wanted.join(words, "term").join(df, "number").groupBy("item_id").agg(F.collect_list(F.struct("number", weight.alias("weight"))).alias("terms")).orderBy("item_id"), "items"
    )  # an item's terms

    m = F.expr(f"10 + (90 * n * {total.docs}L) div {total.terms}L")
    kind = ["h", "m", "terms", "tfs"]
    bags = counted.filter(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs").withColumn("h", F.xxhash64("m", "terms", "tfs"))
    rank = lambda key, *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    few = bags.withColumn("place", rank(kind, F.col("doc_id").asc_nulls_last())).filter(F.col("place") <= top)
    members = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda s: s["doc_id"])  # `top` at most
    classes = written(few.groupBy(*kind).agg(members.alias("members")).select("m", "terms", "tfs", "members"), "classes")

    for held in _blocks(by_item, block, most):
        weights = {t.number: t.weight for r in held for t in r.terms}
        numbers = np.array(sorted(weights), np.int64)
        place = np.concatenate([np.searchsorted(numbers, [t.number for t in r.terms]) for r in held])
        owner = np.repeat(np.arange(len(held)), [len(r.terms) for r in held])
        starts = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(numbers)))))
        stated = spark.sparkContext.broadcast(([r.item_id for r in held], numbers, np.array([weights[t] for t in numbers.tolist()], np.int64), starts, owner[np.argsort(place, kind="stable")]))

        def score(batches: Iterator[pa.RecordBatch], stated=stated) -> Iterator[pa.RecordBatch]:
            return _score(batches, stated.value, top)

        found = classes.mapInArrow(score, "item_id long, score long, members array<long>")
        best = found.withColumn("place", rank(["item_id"], F.desc("score"), F.col("members")[0].asc_nulls_last())).filter(F.col("place") <= top)
        each = best.select("item_id", "score", F.explode("members").alias("doc_id"))
        ranked = each.withColumn("rank", rank(["item_id"], F.desc("score"), F.col("doc_id").asc_nulls_last())).filter(F.col("rank") <= top)
        result = result.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return result
