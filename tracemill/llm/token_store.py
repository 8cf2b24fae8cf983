"""Token ids in files of independent zstandard frames.

A file holds the documents of one range of ids, in order: frames of FRAME ids each, a frame with the directory (the
documents' ids and where each starts), and a skippable frame with the seek table: the compressed and the uncompressed
size of every frame and a checksum of its content, then the number of frames and a magic number. A reader seeks to the
end, reads the table and the directory, and decompresses only the frames that hold what it wants.

Writing: one shuffle by ranges of doc_id (and a hash of the text, so that rows of one id or of none can be dealt too), so
that files follow each other in order; there are as many ranges as shuffle partitions, and more where a file would have over TARGET bytes of text. Each
task streams its documents to one file under a name of its own attempt, and only names that successful tasks report enter
the manifest, so lost executors and repeated tasks leave nothing in it. Memory: one frame, one batch of documents, and two
numbers for each document of the file (its directory, which a reader loads as well).

Edge cases: null and empty texts have the end id alone; null doc_ids come last; rows of one id stand in the order of a hash
of their texts; ids must be numbers; a text of any length is encoded by one task and cut over as many frames as it needs;
an empty table makes no file; further columns, whatever their names, are dropped.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_or_empty, written
from .pieces import library_tokens

#: Ids in a frame; zstandard level; the id behind each document.
FRAME, LEVEL, END = 1 << 16, 1, 2
#: Bytes of text of a file, as a rule.
TARGET = 1 << 30
#: Of the public seekable format: skippable frame, seek table footer. Fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


class Writer:
    """Ids in, frames out to an open file."""

    def __init__(self, sink):
        self.sink, self.codec, self.table = sink, zstandard.ZstdCompressor(level=LEVEL), []
        self.held, self.size, self.total = [], 0, 0
        self.docs: list[tuple[int | None, int]] = []

    def _frame(self, raw: bytes) -> None:
        packed = self.codec.compress(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 16-bit integers."""
        self.docs.append((doc_id, self.total))
        self.total += len(ids) // 2
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 2 * FRAME:
            raw, at = b"".join(self.held), 0
            while len(raw) - at >= 2 * FRAME:
                self._frame(raw[at : at + 2 * FRAME])
                at += 2 * FRAME
            self.held, self.size = [raw[at:]], len(raw) - at

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.held))
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8")
        known = np.array([d is not None for d, _ in self.docs], np.uint8)
        self._frame(struct.pack("<Q", len(ids)) + ids.tobytes() + known.tobytes() + np.array([s for _, s in self.docs] + [self.total], "<i8").tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class Reader:
    """Random access to the documents of a file that can seek."""

    def __init__(self, source):
        self.source, self.codec = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(end - 9 - 12 * n)
        self.table = [struct.unpack("<III", source.read(12)) for _ in range(n)]
        self.at = np.concatenate(([0], np.cumsum([c for c, _, _ in self.table])))
        raw = self.frame(n - 1)
        (k,) = struct.unpack_from("<Q", raw)
        known = np.frombuffer(raw, np.uint8, k, 8 + 8 * k)
        self.doc_ids = [int(d) if ok else None for d, ok in zip(np.frombuffer(raw, "<i8", k, 8), known, strict=True)]
        self.starts = np.frombuffer(raw, "<i8", k + 1, 8 + 9 * k)
        self._last = (-1, b"")

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        packed, size, check = self.table[k]
        raw = self.codec.decompress(self.source.read(packed), max_output_size=size)
        if packed != self.table[k][0] or len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def ids(self, doc: int) -> np.ndarray:
        """Ids of the doc-th document; reads the frames that hold it, and keeps the last."""
        lo, hi = int(self.starts[doc]), int(self.starts[doc + 1])
        out = []
        for k in range(lo // FRAME, -(-hi // FRAME)):
            if self._last[0] != k:
                self._last = (k, self.frame(k))
            out.append(self._last[1][2 * max(0, lo - k * FRAME) : 2 * (hi - k * FRAME)])
        return np.frombuffer(b"".join(out), "<u2")


def write(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write all documents; the manifest: part, file, n_docs, n_tokens, start (ids in the files before)."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens, end = TaskContext.get().partitionId(), library_tokens(path, False), np.array([END], "<u2").tobytes()
        fs, top = pafs.FileSystem.from_uri(folder)
        sink = writer = name = None
        for batch in batches:
            if sink is None:
                fs.create_dir(top, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
                sink = fs.open_output_stream(f"{top}/{name}", compression=None)
                writer = Writer(sink)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(doc_id, tokens.encode(text.as_py()) + end)
        if sink is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([len(writer.docs)]), pa.array([writer.total])], ["part", "file", "n_docs", "n_tokens"])

    mark = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_last(), mark.asc()]
    source = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    size = source.agg(F.sum(F.octet_length("text").cast("long")).alias("size")).first().size or 0
    many = -(-size // TARGET)
    ranged = source.repartitionByRange(*([many] if many > int(spark.conf.get("spark.sql.shuffle.partitions")) else []), *order).sortWithinPartitions(*order, "text")
    manifest = written(ranged.mapInArrow(run, "part long, file string, n_docs long, n_tokens long"), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(at) as source:
                    r = Reader(source)
                    for lo in range(0, len(r.doc_ids), 10_000):
                        some = range(lo, min(lo + 10_000, len(r.doc_ids)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r.doc_ids[k] for k in some], pa.int64()), pa.array(r.starts[lo : some.stop] + base, pa.int64()), pa.array(np.diff(r.starts[lo : some.stop + 1]), pa.int64()),
                             pa.array([zlib.crc32(r.ids(k).astype("<u4")) for k in some], pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    files = manifest.select("file", "start")
    return files.repartition(max(1, files.count()), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
