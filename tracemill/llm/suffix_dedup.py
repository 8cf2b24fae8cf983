"""Substring deduplication over bytes: suffix arrays in shards.

Only windows under an anchor that occurs twice can be repeated (see runs.py), so the anchors deal the text over shards.
Of each content under such an anchor two copies at most go to a shard, with all other contents of the anchor; further
copies of the same bytes (by a 128-bit digest) go to none, so a group of copies of any size moves two. Where an anchor has
one content only, its two copies meet in the shard of their two documents, as parts of longer stretches of text. A shard builds the suffix array of its contents by Larsson-Sadakane refinement (numpy; only groups that are not yet
sorted are sorted again), takes common prefixes by Kasai's argument in its vectorised form, and marks windows that share
WINDOW bytes with a neighbour in suffix order. Every removed byte is one that a suffix array or the merge has found.

Where an anchor has more than SPLIT contents they are dealt over several shards. Each of those sorts the keys (two
64-bit hashes) of its distinct windows and sends them as arrays, one row for each bucket of keys; a merge task holds the
sorted arrays of all shards for one bucket, and finds the windows that a shard could not settle alone (no neighbour in
its own suffix array) in the arrays of the others by binary search.

A shard's size is bounded: there are as many shards as the contents need at SHARD_ROWS each, and no anchor has more than
SPLIT of them in one shard.

Edge cases: an empty table gives no rows; null and empty texts have no bytes; texts shorter than a window lose nothing;
long texts are read as numpy arrays in one task; repeated rows count as other places; null and repeated ids are allowed,
ids must be numbers; further columns are ignored, or pass through in a struct, so their names cannot clash.
Removal may cut a character: kept_text drops what is left of it, kept_sha256 has the bytes as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unique_ids
from .runs import CONTENT, SALTS, Unit, cover, flat, is_hot, numbers, parts, per_text, repeated
from .textnum import byte_grams, loads, mix

WINDOW, GRAM = 200, 48
#: Contents of an anchor for which it takes one more shard, and contents that a shard takes on average.
SPLIT, SHARD_ROWS = 4096, 512
#: Bytes of a suffix array, as a rule, and at most for one set of texts.
BLOCK, LONGEST = 30_000, 1 << 20


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of a byte array in order, by Larsson-Sadakane refinement.

    Suffixes are in groups of equal first h bytes, and only those in groups of two and more are sorted again, by the ranks
    of the suffixes h, 2 h ... bytes on. As many ranks as fit a 64-bit key are taken at once: for a small array h grows
    fourfold in a round, not twofold.
    """
    n = len(data)
    bits = max(1, (2 * n).bit_length())
    ranks = max(2, min(4, 64 // bits))
    key = loads(data)[:n].byteswap()  # the first byte weighs most
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    slots = np.arange(n)
    group = np.maximum.accumulate(np.where(new, slots, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    h = 8
    while True:
        open_slots = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(open_slots):
            return order
        at = order[open_slots]
        key = group[open_slots].astype(np.uint64)
        for k in range(1, ranks):
            on = at + k * h
            # where a suffix has ended it is less than all that go on, and the shorter the less
            then = np.where(on < n, rank[np.minimum(on, n - 1)] + n + 1, n - at)
            key = key << np.uint64(bits) | then.astype(np.uint64)
        again = np.argsort(key)
        at, key = at[again], key[again]
        order[open_slots] = at
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        new[open_slots] = first
        group = np.maximum.accumulate(np.where(new, slots, 0))
        rank[at] = group[open_slots]
        h *= ranks


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in the array and the one before it.

    Kasai: if the bytes before two neighbours are equal, the value at a position is one less than at the position
    before. So only the other positions are compared, all at once and eight bytes at a time, and the rest follow from the
    nearest of them.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    follows = (place > 0) & (before > 0)
    follows[follows] = data[place[follows] - 1] == data[before[follows] - 1]
    start = np.flatnonzero(~follows)
    length, at = np.zeros(len(start), np.int64), loads(data)
    active = np.flatnonzero(before[start] >= 0)
    most = n - np.maximum(start, before[start])  # the end of the longer of the two
    lanes = 1  # eight bytes each; after the first look the few that go on take long strides
    while len(active):
        a, b = start[active] + length[active], before[start[active]] + length[active]
        step = np.arange(0, 8 * lanes, 8)
        differ = at[np.minimum(a[:, None] + step, n)] ^ at[np.minimum(b[:, None] + step, n)]
        some = (differ != 0).any(1)
        lane = np.where(some, (differ != 0).argmax(1), lanes)
        last = differ[np.flatnonzero(some), lane[some]]
        same = 8 * lane
        same[some] += np.log2((last & (~last + np.uint64(1))).astype(np.float64)).astype(np.int64) // 8  # the lowest bit that differs
        length[active] = np.minimum(length[active] + same, most[active])
        active = active[~some & (length[active] < most[active])]
        lanes = 32
    nearest = np.cumsum(~follows) - 1
    by_place = np.maximum(length[nearest] - (place - start[nearest]), 0)
    return by_place[order]


def shared_windows(contents: list[bytes], window: int) -> list[np.ndarray]:
    """For each content, which of its windows occur elsewhere in the contents."""
    gap = 5  # 0xFF is in no UTF-8 text; the ordinal behind it ends every common prefix
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(c + b"\xff" + i.to_bytes(4, "big") for i, c in enumerate(contents)), np.uint8)
    order = suffix_array(data)
    lcp = common_prefixes(data, order)
    hit = np.zeros(len(data), bool)
    long = lcp >= window
    hit[order[long]] = True
    hit[order[np.flatnonzero(long) - 1]] = True
    starts = np.concatenate(([0], np.cumsum(sizes + gap)[:-1]))
    return [hit[s : s + max(0, k - window + 1)] for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]


RESULT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


#: A run that goes to a shard: windows, copies of its content, and the content's name.
MEMBER = ["n", "copies", *CONTENT]


def _contents(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """shard, set_id, spread, members (rows of MEMBER) and bytes of the given runs.

    Neighbouring runs of a document that go to the same shard for the same pair of documents go as one stretch of text:
    a long passage is moved once, not once for each window that overlaps it.
    """
    fields = ["first", "shard", "set_id", "spread", "pure", *MEMBER]
    lists = runs.groupBy("_id").agg(F.collect_list(F.struct(*fields)).alias("runs"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, found = flat(batch.column(3))
        if not len(row):
            return
        first, shard, of, spread, pure, *member = (numbers(x) for x in found.flatten())
        order = np.lexsort((first, row))
        row, first, shard, of, spread, pure = row[order], first[order], shard[order], of[order], spread[order], pure[order]
        member = np.stack(member, 1)[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (of[1:] != of[:-1]) | (first[1:] != first[:-1] + member[:-1, 0]) | (pure[1:] == 0) | (pure[:-1] == 0)
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(row))
        size = np.add.reduceat(member[:, 0], start)
        for lo, hi, data, offsets in parts(batch.column(2)):
            own = slice(*np.searchsorted(row[start], (lo, hi)))
            if own.start == own.stop:
                continue
            raw, begin = data.tobytes(), offsets[row[start[own]] - lo] + first[start[own]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[start[own]]), pa.array(of[start[own]]), pa.array(spread[start[own]].astype(np.int32)), pa.array([member[x:y].tobytes() for x, y in zip(start[own].tolist(), stop[own].tolist(), strict=True)], pa.binary()),
                 pa.array([raw[x:y] for x, y in zip(begin.tolist(), (begin + size[own] - 1 + window).tolist(), strict=True)], pa.binary())],
                ["shard", "set_id", "spread", "members", "content"],
            )

    return per_text(docs, lists, ["runs"], work, "shard long, set_id long, spread int, members binary, content binary")


#: What shards and merges find: stretches (lo to hi - 1) of repeated windows of a content; and on the way, sorted keys.
FOUND = "a long, s long, z long, lo array<int>, hi array<int>"
_PASSED = pa.schema([("bucket", pa.int64()), *((c, pa.int64()) for c in CONTENT), *((c, pa.list_(pa.int32())) for c in ("lo", "hi")), *((c, pa.binary()) for c in ("keys", "asks"))])
_KEYS = np.dtype([("one", "<u8"), ("two", "<u8")])
_OPEN = np.dtype([("key", "<i4"), ("s", "<i8"), ("z", "<i8"), ("at", "<i4")])


def _found(member: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Names of the contents with repeated windows, each once, and their stretches; `hits` has the windows of all members in order."""
    bound = np.concatenate(([0], np.cumsum(member[:, 0])))
    edge = np.zeros(len(hits) + 1, bool)
    edge[bound] = True
    before, after = np.concatenate(([False], hits[:-1])), np.concatenate((hits[1:], [False]))
    lo, hi = np.flatnonzero(hits & (~before | edge[:-1])), np.flatnonzero(hits & (~after | edge[1:])) + 1
    of = np.searchsorted(bound, lo, "right") - 1
    once = np.zeros(len(member), bool)
    once[np.unique(member[:, 2:], axis=0, return_index=True)[1]] = True  # copies of one content are found alike
    lo, hi, of = lo[once[of]], hi[once[of]], of[once[of]]
    kinds, start = np.unique(of, return_index=True)
    at = pa.array(np.append(start, len(of)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array((x - bound[of]).astype(np.int32))) for x in (lo, hi)]
    return member[kinds, 2:], *lists


def _sorted_keys(contents: list[bytes], member: np.ndarray, hits: list[np.ndarray], window: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each bucket: the sorted distinct keys of a shard's windows, and the windows that are alone in the shard."""
    one = np.concatenate([byte_grams(np.frombuffer(c, np.uint8), window) for c in contents])
    two = np.concatenate([mix(byte_grams(np.frombuffer(c, np.uint8)[::-1], window)[::-1]) for c in contents])
    of = np.repeat(np.arange(len(member)), member[:, 0])
    at = np.concatenate([np.arange(n) for n in member[:, 0]])
    single = ~np.concatenate(hits) & (member[of, 1] == 1)
    order = np.lexsort((~single, two, one))
    one, two, single, of, at = one[order], two[order], single[order], of[order], at[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    one, two, single, of, at = one[new], two[new], single[new], of[new], at[new]
    bucket = one % np.uint64(buckets)
    for b in np.unique(bucket):
        own = np.flatnonzero(bucket == b)
        keys = np.empty(len(own), _KEYS)
        keys["one"], keys["two"] = one[own], two[own]
        open_ = np.flatnonzero(single[own])
        asks = np.empty(len(open_), _OPEN)
        asks["key"], asks["at"], asks["s"], asks["z"] = open_, at[own][open_], member[of[own][open_], 3], member[of[own][open_], 4]
        yield int(b), keys.tobytes(), asks.tobytes()


def _found_elsewhere(keys: list[np.ndarray], asks: list[np.ndarray]) -> list[np.ndarray]:
    """For each shard, which of its open windows another shard has: binary search in the merged keys of all shards.

    A shard sends each key once, so a key that stands twice in the merged order is one that two shards have.
    """
    merged = np.sort(np.concatenate(keys), order=["one", "two"])
    out = []
    for own, ask in zip(keys, asks, strict=True):
        wanted, count = own[ask["key"]], np.zeros(len(ask), np.int64)
        lo, hi = np.searchsorted(merged["one"], wanted["one"], "left"), np.searchsorted(merged["one"], wanted["one"], "right")
        for step in range(int((hi - lo).max(initial=0))):
            at = np.minimum(lo + step, len(merged) - 1)
            count += (lo + step < hi) & (merged["two"][at] == wanted["two"])
        out.append(count > 1)
    return out


def _in_blocks(sets: np.ndarray, contents: list[bytes], members: list[np.ndarray], window: int) -> Iterator[tuple[list[bytes], np.ndarray, list[np.ndarray]]]:
    """The texts of a shard with their members and repeated windows, in blocks of whole sets, as sets share no window.

    Blocks are small, so that the arrays stay in the caches and keys hold four ranks. A set of more than LONGEST bytes (of
    two very long documents) goes run by run, dealt by anchor: runs of unlike anchors share no window either.
    """
    size = np.array([len(c) for c in contents])
    order = np.argsort(sets, kind="stable")
    block: list[int] = []
    for some in np.split(order, np.flatnonzero(np.diff(sets[order])) + 1):
        if size[some].sum() > LONGEST:
            runs = [(contents[k][at : at + m[0] - 1 + window], m) for k in some for at, m in zip(np.cumsum(members[k][:, 0]) - members[k][:, 0], members[k], strict=True)]
            n = -(-sum(len(c) for c, _ in runs) // LONGEST)
            for j in range(n):
                part = [(c, m) for c, m in runs if m[2] % n == j]
                if part:
                    yield [c for c, _ in part], np.stack([m for _, m in part]), shared_windows([c for c, _ in part], window)
            continue
        if block and size[block].sum() + size[some].sum() > BLOCK:
            yield [contents[k] for k in block], np.concatenate([members[k] for k in block]), shared_windows([contents[k] for k in block], window)
            block = []
        block += some.tolist()
    if block:
        yield [contents[k] for k in block], np.concatenate([members[k] for k in block]), shared_windows([contents[k] for k in block], window)


def _in_shards(contents: DataFrame, window: int, shards: int) -> DataFrame:
    """Stretches of repeated windows that the shards find, and for anchors in several shards the merge."""

    def table(bucket: np.ndarray, names: np.ndarray, lists: list, keys: list | None = None, asks: list | None = None) -> pa.Table:
        n = len(bucket)
        cols = [pa.array(bucket, pa.int64()), *(pa.array(np.ascontiguousarray(names[:, k]), pa.int64()) for k in range(3)), *(lists or [pa.nulls(n, pa.list_(pa.int32()))] * 2)]
        return pa.Table.from_arrays([*cols, *(pa.array(x, pa.binary()) if x else pa.nulls(n, pa.binary()) for x in (keys, asks))], schema=_PASSED)

    def shard(t: pa.Table) -> pa.Table:
        own, out = t["shard"][0].as_py(), []
        members = [np.frombuffer(m, np.int64).reshape(-1, len(MEMBER)) for m in t["members"].to_pylist()]
        content, spread, sets = t["content"].to_pylist(), numbers(t["spread"].combine_chunks()), numbers(t["set_id"].combine_chunks())
        hot = {int(m[0, 2]): int(k) for m, k in zip(members, spread, strict=True) if k > 1}  # anchors in several shards
        for texts, member, hits in _in_blocks(sets, content, members, window):
            names, *lists = _found(member, np.concatenate(hits))
            out.append(table(np.full(len(names), own), names, lists))
            for a in hot.keys() & set(member[:, 2].tolist()):
                rows = np.flatnonzero(member[:, 2] == a)  # a run of a hot anchor is a text of its own
                text_of = np.searchsorted(np.cumsum([len(h) for h in hits]), np.cumsum(member[:, 0])[rows])
                for bucket, keys, asks in _sorted_keys([texts[k] for k in text_of], member[rows], [hits[k] for k in text_of], window, hot[a]):
                    out.append(table(np.array([hash((int(a), bucket)) % shards]), np.array([[a, bucket, 0]]), [], [keys], [asks]))
        return pa.concat_tables(out)

    def merge(t: pa.Table) -> pa.Table:
        passed = pc.is_null(t["keys"])
        done, keyed = t.filter(passed).select([*CONTENT, "lo", "hi"]), t.filter(pc.invert(passed))
        out = [done]
        anchors = np.stack([numbers(keyed[c].combine_chunks()) for c in ("a", "s")], 1) if keyed.num_rows else np.zeros((0, 2), np.int64)
        for a, bucket in np.unique(anchors, axis=0):
            rows = np.flatnonzero((anchors == (a, bucket)).all(1))
            keys, asks = ([np.frombuffer(keyed[c][int(k)].as_py(), d) for k in rows] for c, d in (("keys", _KEYS), ("asks", _OPEN)))
            hit = np.sort(np.concatenate([ask[h] for ask, h in zip(asks, _found_elsewhere(keys, asks), strict=True)]), order=["s", "z", "at"])
            if len(hit):
                new = np.flatnonzero(np.concatenate(([True], (hit["s"][1:] != hit["s"][:-1]) | (hit["z"][1:] != hit["z"][:-1]))))
                at = pa.array(np.append(new, len(hit)).astype(np.int32))
                names = [pa.array(np.full(len(new), a)), *(pa.array(np.ascontiguousarray(hit[c][new]), pa.int64()) for c in ("s", "z"))]
                lists = [pa.ListArray.from_arrays(at, pa.array((hit["at"] + k).astype(np.int32))) for k in (0, 1)]
                out.append(pa.table([*names, *lists], names=done.schema.names).cast(done.schema))
        return pa.concat_tables(out)

    sharded = contents.groupBy("shard").applyInArrow(shard, "bucket long, a long, s long, z long, lo array<int>, hi array<int>, keys binary, asks binary")
    return sharded.groupBy("bucket").applyInArrow(merge, FOUND)


RESULT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = True, split: int = SPLIT, keep: tuple[str, ...] = (), packed: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (null unless `texts`), and the columns `keep`.

    Kept columns come under their own names, those of result columns left out; if `packed`, all in one struct `keep`.
    """
    d = unique_ids(docs, keep)
    runs = repeated(d, Unit(window, gram, False))
    # two copies of each content: the first two of its first document, or one of this and one of the last
    two = runs.filter(((F.col("_id") == F.col("source")) & (F.col("k") < 2)) | ((F.col("_id") == F.col("other")) & (F.col("k") == 0)))
    shards = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), two.count() // SHARD_ROWS)
    # a content that is the only one of its anchor needs no other text than its copy, so it goes by the two documents
    pure, spread = F.col("contents") == 1, (F.floor(F.col("contents") / split) + 1).cast("int")
    key = F.when(pure, F.xxhash64("source", "other")).otherwise(F.xxhash64("a", F.pmod(F.col("s"), spread)))
    dealt = two.select("_id", "first", F.pmod(key, F.lit(shards)).alias("shard"), key.alias("set_id"), spread.alias("spread"), pure.alias("pure"), *MEMBER)
    found = _in_shards(_contents(d, dealt, window), window, shards)
    # copies of a hot content are dealt over parts, what was found of it goes to each part
    hot = is_hot("copies", runs.count())
    few = runs.filter(hot).select(*CONTENT).distinct().withColumn("_hot", F.lit(True))  # fewer than HOT
    found = found.join(F.broadcast(few), CONTENT, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    salted = runs.select("_id", "first", *CONTENT, F.when(hot, F.pmod(F.xxhash64("_id", "first"), F.lit(SALTS)).cast("int")).otherwise(0).alias("_salt"))
    spans = salted.join(found, [*CONTENT, "_salt"]).groupBy("_id").agg(F.collect_list(F.struct("first", "lo", "hi")).alias("runs"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, runs = flat(batch.column(3))
        first, lows, highs = runs.flatten()
        which, lows = flat(lows)
        at, row = numbers(first)[which], row[which]
        start, end = at + numbers(lows), at + numbers(flat(highs)[1]) - 1 + window
        for lo, hi, data, offsets in parts(batch.column(2)):
            own = (row >= lo) & (row < hi)
            base = offsets[row[own] - lo]
            gone = cover(len(data), base + start[own], base + end[own])
            kept, removed, n_spans = [], [], []
            for j in range(hi - lo):
                a, b = offsets[j], offsets[j + 1]
                g = gone[a:b]
                kept.append(data[a:b][~g].tobytes())
                removed.append(int(g.sum()))
                n_spans.append(int((g[1:] & ~g[:-1]).sum() + g[0]) if b > a else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(lo, hi - lo), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode("utf-8", "ignore") if texts else None for x in kept], pa.string()), *([batch.column(4).slice(lo, hi - lo)] if keep else [])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *(["keep"] if keep else [])],
            )

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])
    if keep:
        schema = schema.add(d.schema["keep"])
    out = per_text(d, spans, ["runs"], work, schema, ("keep",) if keep else ())
    return out if packed or not keep else out.select(*RESULT, *(F.col(f"keep.`{c}`") for c in keep if c not in RESULT))
