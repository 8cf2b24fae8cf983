"""Bounded-space online best-fit packing of whole documents.

A task reads its documents once, in the order they come, and keeps OPEN bins. The open bins' free spaces are the bits of
one number, so the bin that a piece fills best is the lowest set bit at or above the piece's length, and the fullest is
the lowest of all. A piece goes into the bin that it fills best. When none can take it and OPEN bins are open, the
fullest closes. A bin with no space left closes at once.

Documents longer than a bin are cut into pieces of a whole bin each, the first one having what is left over; all others stay
whole. What is open at the end of a task has room left: these pieces (no ids, five numbers each) meet those of up to
MERGE - 1 other tasks and are packed again, the longest first, with as many bins open as they need; the OPEN emptiest bins
stay open for the next round, until one group is left.

Documents are not shuffled. No task takes more than MERGE * OPEN bins of leftovers, whatever the size of the input.

Edge cases: an empty table gives no pieces; null and empty texts are the end id alone; equal and null ids in several rows
are several documents; a text of any length is encoded by one task; ids must be numbers; further columns, whatever their
names, are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .pieces import library_tokens

LENGTH, OPEN, MERGE, END = 1024, 512, 32, 2
#: Pieces and parts that a worker remembers; words are pieces, so few parts are needed.
REMEMBERED = 700_000, 50_000
#: Sequence ids: the round in the high bits, then the task or group, a running number in the low ones.
SHIFT, ROUND = 32, 56

NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "left"]
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, left long"
_ARROW = pa.schema([(c, pa.int32() if c == "piece" else pa.int64()) for c in NAMES])


class Bins:
    """Open bins by free space. A bin is a list of (doc_id, piece, start, length, crc)."""

    def __init__(self, length: int = LENGTH, n_open: int = OPEN):
        self.length, self.n_open = length, n_open
        self.free, self.count = 0, 0
        self.by_space: list[list[list[tuple]]] = [[] for _ in range(length + 1)]

    def _take(self, space: int) -> list[tuple]:
        found = self.by_space[space].pop()
        if not self.by_space[space]:
            self.free &= ~(1 << space)
        self.count -= 1
        return found

    @staticmethod
    def _lowest(bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def add(self, piece: tuple) -> list[tuple] | None:
        """Place a piece; the bin that closes, if one does."""
        size, closed = piece[3], None
        if size == self.length:
            return [piece]
        if fits := self.free >> size << size:
            space = self._lowest(fits)
            target = self._take(space)
        else:
            if self.count == self.n_open:
                closed = self._take(self._lowest(self.free))
            space, target = self.length, []
        target.append(piece)
        if space == size:
            return target  # found a bin, so nothing else has closed
        self.by_space[space - size].append(target)
        self.free |= 1 << (space - size)
        self.count += 1
        return closed

    def rest(self) -> list[list[tuple]]:
        """The bins that are open, the fullest first."""
        return [b for bins in self.by_space for b in bins]


def cuts(n: int, length: int = LENGTH) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces."""
    first = (n - 1) % length + 1
    yield 0, first
    for start in range(first, n, length):
        yield start, length


def _rows(closed: list[tuple], sequence: int | None, left: int | None = None) -> Iterator[tuple]:
    at = 0
    for piece in closed:
        yield (*piece, sequence, None if sequence is None else at, left)
        at += piece[3]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _again(length: int, n_open: int, level: int, last: bool):
    """Packs the leftovers of a group of tasks, longest first; all bins but the emptiest close."""

    def run(key: tuple, found: pa.Table) -> pa.Table:
        group, bins, n, rows = key[0].as_py(), Bins(length, found.num_rows), 0, []
        first = level << ROUND | group << SHIFT
        pieces = zip(*(found[c].to_pylist() for c in NAMES[:5]), strict=True)
        for piece in sorted(pieces, key=lambda p: (-p[3], p[0] is None, p[0] or 0, p[2], p[4])):
            if closed := bins.add(piece):
                rows += _rows(closed, first + n)
                n += 1
        rest = bins.rest()
        done = len(rest) if last else max(0, len(rest) - n_open)
        for k, closed in enumerate(rest):
            rows += _rows(closed, first + n + k) if k < done else _rows(closed, None, group)
        return pa.Table.from_batches([_batch(rows)])

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, n_open: int = OPEN, merge: int = MERGE) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tokens, bins, n = TaskContext.get().partitionId(), library_tokens(path, False, *REMEMBERED), Bins(length, n_open), 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(np.frombuffer(tokens.encode(text.as_py()), np.uint16), END).astype("<u4")
                for k, (start, size) in enumerate(cuts(len(ids), length)):
                    if closed := bins.add((doc_id, k, start, size, zlib.crc32(ids[start : start + size]))):
                        rows += _rows(closed, task << SHIFT | n)
                        n += 1
            if rows:
                yield _batch(rows)
        if rows := [r for b in bins.rest() for r in _rows(b, None, task)]:
            yield _batch(rows)

    source = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    tasks = source.rdd.getNumPartitions()
    done = written(source.mapInArrow(run, SCHEMA), "best-fit")
    placed, open_, level = done.filter("left is null"), done.filter("left is not null"), 0
    while True:
        level += 1
        last = tasks <= merge
        groups = open_.withColumn("group", F.floor(F.col("left") / merge)).groupBy("group")
        merged = written(groups.applyInArrow(_again(length, n_open, level, last), SCHEMA), "merged")
        placed = placed.unionByName(merged.filter("left is null"))
        if last:
            return placed.drop("left")
        open_, tasks = merged.filter("left is not null"), -(-tasks // merge)
