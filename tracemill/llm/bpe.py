"""BPE encoding and decoding as streaming transducers with bounded lookahead.

The encoder reads bytes and emits tokens as soon as no byte that may still come can change them. How far it must look
is computed from the merge list: a boundary is changed from the right only through a chain of merges, each of which
takes the left part of what the merge before it needed, at a lower rank; the longest such chain, in bytes, is the
sufficient lookahead. Beyond it tokens are final, so the encoder holds a block and the lookahead, whatever the length
of its input. The decoder turns token bytes to text with an incremental UTF-8 state machine.

A text is read in stretches of about BLOCK characters that end where a pre-token must end (a space behind something
else); a stretch without such a place is read pre-token by pre-token, and a long pre-token in blocks. Every pre-token
goes through the encoder; what it emits for short ones is remembered, in bounded space. Digests are fed stretch by
stretch, so beside the text itself the memory is constant.

Encoding is a projection of one row: no shuffle.

Edge cases: an empty table gives no rows; null and empty texts have no tokens; texts of any length take the memory of a
stretch; the strings of added tokens in a text become those tokens, as in the tokenizers library; ids must be numbers,
null and repeated ones are rows like others; further columns, whatever their names, are dropped.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .pieces import BYTE_PATTERN, Memory, byte_alphabet, cut, piece_text, simple_parts, stands_alone

BLOCK = 4096
#: A place where a pre-token ends whatever follows.
SAFE = regex.compile(r"(?<=[^\s\x00-\x1f]) ")


class Merges:
    """The merge list of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.bytes_of = [known.get(i, b"") for i in range(max(known) + 1)]
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        #: Rank and merged token of a pair, in one integer: rank * 2 ** 20 + token.
        self.rules: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(back[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rules[vocab[a], vocab[b]] = rank << 20 | vocab[a + b]
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        made = {r & 0xFFFFF: (r >> 20, pair) for pair, r in self.rules.items()}
        size = [len(b) for b in self.bytes_of]
        ranks: dict[int, list[int]] = {}  # of the rules whose left side is a token, ascending, with the greatest reach so far
        reach: dict[int, list[int]] = {}

        def beyond(token: int, rank: int) -> int:
            """Bytes behind a token that can still decide whether it forms, and is not taken from the right, before a rank."""
            most = 0
            while True:
                if k := bisect_left(ranks.get(token, ()), rank):
                    most = max(most, reach[token][k - 1])
                if token not in made:
                    return most
                rank, (_, token) = min(rank, made[token][0]), made[token][1]

        for (left, right), rule in sorted(self.rules.items(), key=lambda x: x[1]):
            rank = rule >> 20
            value = size[right] + beyond(right, rank)
            ranks.setdefault(left, []).append(rank)
            reach.setdefault(left, []).append(max(value, reach[left][-1] if reach.get(left) else 0))
        return max((x[-1] for x in reach.values()), default=0)

    def merged(self, data: bytes) -> list[int]:
        """Tokens of some bytes, by rank, leftmost first."""
        ids, rules = [self.byte_ids[b] for b in data], self.rules
        if len(ids) > 48:
            return self._merged_long(ids)
        none = 1 << 62
        get = rules.get
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n, rules = len(ids), self.rules
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r & 0xFFFFF, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rules.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]


class Encoder:
    """Bytes of one pre-token in, stable tokens out."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block, self.held = merges, block, b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), self.block):
            self.held += data[i : i + self.block]
            stable = len(self.held) - self.merges.lookahead
            if stable <= 0:
                continue
            ids = self.merges.merged(self.held)
            ends = list(accumulate(len(self.merges.bytes_of[t]) for t in ids))
            k = bisect_left(ends, stable + 1)
            if k:
                out += ids[:k]
                self.held = self.held[ends[k - 1] :]
        return out

    def flush(self) -> list[int]:
        ids, self.held = self.merges.merged(self.held), b""
        return ids


class Decoder:
    """Tokens in, text out; a character that is not complete waits for its bytes."""

    def __init__(self, merges: Merges):
        self.bytes_of, self.machine = merges.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


class Transducer:
    """Encodes and decodes texts in stretches; remembers pre-tokens and pieces in bounded space."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.encoder = Encoder(self.merges)
        self.pattern = regex.compile(BYTE_PATTERN)
        self.added = regex.compile("|".join(map(regex.escape, sorted(self.merges.added, key=len, reverse=True))) or r"(?!)")
        self.parts, self.memory = Memory(self._part, 250_000), Memory(self._piece, 250_000)

    def _emitted(self, ids: list[int]) -> tuple[str, bytes]:
        return ",".join(map(str, ids)), array("H", ids).tobytes()

    def _part(self, part: str) -> tuple[str, bytes]:
        return self._emitted(self.encoder.feed(part.encode()) + self.encoder.flush())

    def _tokens(self, text: str, start: int, end: int) -> Iterator[tuple[str, bytes]]:
        """Pre-token by pre-token, with added tokens between; long ones in blocks, as their tokens become stable."""

        def between(a: int, b: int) -> Iterator[tuple[str, bytes]]:
            for m in self.pattern.finditer(text, a, b):
                lo, hi = m.span()
                if hi - lo <= BLOCK:
                    yield self.parts[text[lo:hi]]
                    continue
                for at in range(lo, hi, BLOCK):
                    if ids := self.encoder.feed(text[at : min(at + BLOCK, hi)].encode()):
                        yield self._emitted(ids)
                yield self._emitted(self.encoder.flush())

        at = start
        for m in self.added.finditer(text, start, end):
            yield from between(at, m.start())
            yield self._emitted([self.merges.added[m[0]]])
            at = m.end()
        yield from between(at, end)

    def _joined(self, found: list[tuple[str, bytes]]) -> tuple[str, bytes]:
        return found[0] if len(found) == 1 else (",".join([x[0] for x in found]), b"".join([x[1] for x in found]))

    def _piece(self, piece: str) -> tuple[str, bytes] | None:
        if simple := simple_parts(piece):
            return self._joined([self.parts[p] for p in simple])
        if not stands_alone(piece):
            return None
        text = piece_text(piece)
        return self._joined(list(self._tokens(text, 0, len(text))))

    def stream(self, text: str) -> Iterator[tuple[str, bytes]]:
        """Decimal ids joined by commas, and ids as bytes, of one stretch after the other."""
        at, n, memory = 0, len(text), self.memory
        while at < n:
            place = SAFE.search(text, at + BLOCK)
            end = place.start() if place else n
            if end - at <= 4 * BLOCK:
                part = text[at:end]
                # a stretch after the first starts with a space, which belongs to its first piece
                found = [memory[p] for p in (part[1:].replace("\n", " \n").split(" ") if at else cut(part))]
                yield self._joined(list(self._tokens(text, at, end)) if None in found else found)
            else:
                held: list[tuple[str, bytes]] = []
                for x in self._tokens(text, at, end):
                    held.append(x)
                    if len(held) >= BLOCK or len(x[1]) > BLOCK:
                        yield self._joined(held)
                        held = []
                if held:
                    yield self._joined(held)
            at = end

    def encode(self, text: str) -> tuple[str, array]:
        """The whole text at once: decimal ids joined by commas, and the ids."""
        found = list(self.stream(text))
        return ",".join([x[0] for x in found]), array("H", b"".join([x[1] for x in found]))


@functools.cache
def transducer(path: str) -> Transducer:
    """One for each worker process and file."""
    return Transducer(path)


def round_trip(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and the ids themselves if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            rows, kept = [], []
            for text in batch.column(1):
                one, two, decoder, n, comma, found = hashlib.sha256(), hashlib.sha256(), Decoder(t.merges), 0, b"", []
                for line, part in t.stream(text.as_py()):
                    stretch = array("H", part)
                    n += len(stretch)
                    one.update(comma + line.encode())
                    two.update(decoder.feed(stretch).encode())
                    comma = b","
                    if ids:
                        found += stretch
                two.update(decoder.feed((), True).encode())
                rows.append((n, one.hexdigest(), two.hexdigest()))
                kept.append(found if ids else None)
            n, one, two = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(kept, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    out = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
    return out if ids else out.drop("ids")
