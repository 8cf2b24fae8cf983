"""Bounded-space online packing of token sequences.

Each task reads its documents once, in the order they come, and keeps OPEN windows. A document goes whole into the
window that it fills best. When none can take it, the fullest window is topped up with the document's first ids and
emitted, so windows leave a task without padding. What is still open at the end of a task (OPEN windows at most) is
merged: rounds of MERGE tasks' leftovers each, until one window is left, the only one with padding.

Documents are not shuffled; only leftovers move, and no task takes more than MERGE * OPEN windows of them.

Edge cases: an empty table gives no pieces; null and empty texts are the end id alone; equal and null ids in several rows
are several documents; a text of any length is encoded by one task and cut over as many windows as it needs; ids must be
numbers; further columns, whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .pieces import library_tokens

LENGTH, OPEN, MERGE, END = 4096, 16, 64, 2
#: Sequence ids: the task (or merge group) in the high bits, a running number in the low ones.
SHIFT = 32

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left", "ids"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left long, ids binary"


class Packer:
    """Windows of `length` ids; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int = LENGTH, n_open: int = OPEN):
        self.length, self.n_open = length, n_open
        self.fills: list[int] = []
        self.windows: list[list[tuple]] = []

    def _put(self, k: int, piece: tuple) -> list[list[tuple]]:
        self.windows[k].append(piece)
        self.fills[k] += len(piece[2])
        if self.fills[k] < self.length:
            return []
        self.fills.pop(k)
        return [self.windows.pop(k)]

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> list[list[tuple]]:
        """Place ids; the windows that this fills."""
        full: list[list[tuple]] = []
        while len(ids):
            if len(ids) >= self.length:
                full.append([(doc_id, start, ids[: self.length], doc_tokens)])
                start, ids = start + self.length, ids[self.length :]
                continue
            fits = [(f, k) for k, f in enumerate(self.fills) if f + len(ids) <= self.length]
            if fits:
                return full + self._put(max(fits)[1], (doc_id, start, ids, doc_tokens))
            if len(self.fills) < self.n_open:
                self.fills.append(0)
                self.windows.append([])
                return full + self._put(len(self.fills) - 1, (doc_id, start, ids, doc_tokens))
            most = max(range(len(self.fills)), key=self.fills.__getitem__)
            room = self.length - self.fills[most]
            full += self._put(most, (doc_id, start, ids[:room], doc_tokens))
            start, ids = start + room, ids[room:]
        return full


def _crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _rows(window: list[tuple], sequence: int | None, left: int | None = None) -> Iterator[tuple]:
    at = 0
    for doc_id, start, ids, total in window:
        if left is None:
            yield doc_id, start, len(ids), _crc(ids), total, sequence, at, None, None
        else:  # not placed yet: the ids stay, as a later cut needs them
            yield doc_id, start, len(ids), None, total, None, None, left, np.ascontiguousarray(ids, "<u4").tobytes()
        at += len(ids)


def _merger(length: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs the leftovers of a group of tasks; one window stays open, and is emitted as it is in the last round."""

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        group, packer, n, rows = int(pdf["group"].iloc[0]), Packer(length, 1), 0, []
        first = (level << 56) | (group << SHIFT)
        for r in pdf.sort_values(["left", "doc_id", "start"]).itertuples(index=False):
            for window in packer.add(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), np.frombuffer(r.ids, "<u4"), int(r.doc_tokens)):
                rows += _rows(window, first + n)
                n += 1
        for window in packer.windows:
            rows += _rows(window, first + n if last else None, None if last else group)
        columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
        # whole numbers throughout: a float between would lose the low digits of sequence ids
        return pd.DataFrame({c: list(v) if c == "ids" else pd.array(list(v), dtype="Int64") for c, v in zip(NAMES, columns, strict=True)})

    return again


def pack(docs: DataFrame, path: str, length: int = LENGTH, n_open: int = OPEN, merge: int = MERGE, remembered: tuple[int, ...] = ()) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `remembered`: pieces and parts that a worker keeps, for less memory at more time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tokens, packer, n = TaskContext.get().partitionId(), library_tokens(path, True, *remembered), Packer(length, n_open), 0
        end = np.array([END], np.uint16)
        schema = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in NAMES])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate((np.frombuffer(tokens.encode(text.as_py()), np.uint16), end))
                for window in packer.add(doc_id, 0, ids, len(ids)):
                    rows += _rows(window, task << SHIFT | n)
                    n += 1
            if rows:
                yield batch_of(rows)
        if rows := [r for w in packer.windows for r in _rows(w, None, task)]:
            yield batch_of(rows)

    source = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    tasks = source.rdd.getNumPartitions()
    done = written(source.mapInArrow(run, SCHEMA), "packed")
    placed, open_, level = done.filter("left is null"), done.filter("left is not null"), 0
    while True:
        level += 1
        last = tasks <= merge
        groups = open_.withColumn("group", F.floor(F.col("left") / merge)).groupBy("group")
        merged = written(groups.applyInPandas(_merger(length, level, last), SCHEMA), "merged")
        placed = placed.unionByName(merged.filter("left is null"))
        if last:
            return placed.drop("left", "ids")
        open_, tasks = merged.filter("left is not null"), -(-tasks // merge)
