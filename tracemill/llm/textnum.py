"""Vectorised helpers over the bytes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Keeps the first k bytes of a little-endian 64-bit load, k up to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def fold(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbours; not linear in them, so that no text makes it fail for every seed as polynomials do."""
    x = left * U(0x9E3779B97F4A7C15) + right
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def loads(data: np.ndarray) -> np.ndarray:
    """The 64 bits that start at each byte, and zeros behind the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the length is part of it, and salts give independent hashes."""
    size = ends - starts
    at = loads(data)
    out = mix(size.astype(U) + U(salt * 0x5851F42D4C957F2D + 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))
    out = mix(out ^ (at[starts] & _FIRST[np.minimum(size, 8)]))
    done, more = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(more):
        out[more] = mix(fold(out[more], at[starts[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed=salt)
    return out


def gram_hashes(units: np.ndarray, width: int, have: int = 1) -> np.ndarray:
    """Hash of each `width` consecutive units, by doubling; `units` are hashes of `have` units each already."""
    while have < width:
        step = min(have, width - have)
        if len(units) <= step:
            return np.zeros(0, U)
        units = fold(units[:-step], units[step:])
        have += step
    return mix(units)


def byte_grams(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` (8 or more) consecutive bytes."""
    return gram_hashes(loads(data)[: max(0, len(data) - 7)], width, 8)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array one after the other, and n + 1 offsets. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def pieces(offsets: np.ndarray, size: int = 1 << 18) -> list[tuple[int, int]]:
    """Ranges of whole texts of about `size` bytes each: small arrays stay in the processor's caches."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 offsets of each text's words. Words never cross texts."""
    solid = ~_WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in each window of `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        at = np.where(take, at[step:], at[: len(at) - step])
        best = np.where(take, right, left)
        span += step
    return at.astype(np.int64)


def anchored_runs(grams: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> dict[str, np.ndarray]:
    """Cut the windows of `window` units of each text into runs that share their least gram, as winnowing does.

    Equal windows choose the same gram at the same place in them, so equal windows are always in runs of equal anchors.
    Returns, for each run: text (index), first and last (starts of its first and last window, in units of all texts)
    and anchor (hash of the gram).
    """
    lengths = np.diff(offsets)
    if not (lengths >= window).any():
        return {k: np.zeros(0, U if k == "anchor" else np.int64) for k in ("text", "first", "last", "anchor")}
    at = window_argmin(grams, window - gram + 1)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    inside = np.arange(len(at)) + window <= offsets[text + 1]
    starts = np.flatnonzero(inside)
    text, at = text[starts], at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return {"text": text[first], "first": starts[first], "last": starts[last], "anchor": grams[at[first]]}
