"""N-gram Jaccard join: a grouped prefix join over distinct word shingles.

Two documents link when the Jaccard similarity of their sets of `size`-word shingles is at least `percent`. The join is exact:

1. A document's extract is its q shingles of least hash, q a little over the prefix length p = n - ceil(t n) + 1. If two
   documents link, the extract with the lower greatest hash shares all but p - 1 of its shingles with the other one's.
   So extracts can be joined by prefixes too, under any order of the shingles.
2. The order is by how many documents have a shingle in their extracts, rarest first; counts cover all documents. A
   document whose prefix has only shingles of its own cannot link, and is done: almost all documents end here, and very
   common passages stay at the end of the order, out of the prefixes.
3. Equal sets are one class from the start. Classes of identical prefix and size are one group; only group
   representatives enter the posting lists. Pairs are filtered by size, by class of links known so far, and by parity
   sketches (a lower bound of the difference), before sets are compared.
4. First each group is held against one head of its lists, the one with the most common extract, which ties large
   groups of near copies together with no more pairs than rows; then, with groups expanded to members, lists that still hold
   different components go to the shelf of their head, where sketches of all pairs of different components are compared
   block by block as arrays, and only pairs that may link are made. No link between components is left unchecked.

Hot keys: counts combine in the map tasks, joins back have one row for a key on the small side.

Shingles are 64-bit hashes that are not linear in their words (textnum.fold), so no text makes them agree for every
seed; sets are compared as sets of hashes. By chance a pair of sets of a thousand shingles agrees in one wrong hash once
in ten trillion pairs.

Edge cases: an empty table gives no rows; null and empty texts have no shingles and link with nothing; texts of fewer
words than a shingle have one; a very long text is one set in one task; repeated rows link through their equal sets; null
ids come last, and ids must be numbers; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, unique_ids, written
from .components import connected
from .runs import parts
from .textnum import U, gram_hashes, mix, word_hashes, word_spans

#: Least similarity in percent and words of a shingle of the registered query; callers can ask for others.
PERCENT, SHINGLE = 90, 3
#: Bits of the least parity sketch; documents in a block of a shelf.
SKETCH, BLOCK = 512, 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and n + 1 offsets."""
    data = _LOWER[data]
    starts, ends, words = word_spans(data, offsets)
    units = word_hashes(data, starts, ends)
    counts = np.diff(words)
    of = np.repeat(np.arange(len(counts)), counts)
    h = gram_hashes(units, size)
    whole = of[: len(h)] == of[size - 1 :]
    found = [(of[: len(h)][whole], h[whole])]
    for few in range(1, size):
        short = np.flatnonzero(counts == few)
        if len(short):
            found.append((short, mix(gram_hashes(units, few)[words[short]] + U(few))))
    text, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def _least(n, percent: int):
    """ceil(percent n / 100), for numbers, arrays and columns alike."""
    return (percent * n + 99) // 100 if not isinstance(n, Column) else F.floor((percent * n + 99) / 100).cast("int")


def _prefix(n, percent: int):
    return n - _least(n, percent) + 1


def _extract(n: np.ndarray, percent: int) -> np.ndarray:
    p = _prefix(n, percent)
    return np.minimum(n, p + p // 4 + 8)


def parity_sketches(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A parity sketch of each set: SKETCH bits times the power of two that reaches half as many bits as shingles, so that it
    tells long texts apart as well as short ones. Halves of a sketch laid over each other are the sketch of half the bits."""
    n = np.diff(at)
    bits = SKETCH << np.ceil(np.log2(np.maximum(n / (2 * SKETCH), 1))).astype(np.int64)
    ends = np.cumsum(bits)
    place = np.repeat(ends - bits, n) + (h & np.repeat(bits - 1, n).astype(U)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
    return [packed[(e - b) // 8 : e // 8] for e, b in zip(ends.tolist(), bits.tolist(), strict=True)]


def folded(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches of at least so many bits, folded to them: a row of 64-bit words each."""
    out = np.empty((len(sketches), bits // 64), np.uint64)
    sizes = np.array([len(s) for s in sketches], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join([sketches[k] for k in at.tolist()]), np.uint64).reshape(len(at), -1, bits // 64), axis=1)
    return out


def _may_link(a: list[bytes], b: list[bytes], total: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches differ in no more bits than sets of `total` shingles in all that link: the least intersection
    is percent total / (100 + percent), and no sketch differs in more bits than the sets in shingles."""
    ok = np.ones(len(a), bool)
    level = np.minimum([len(s) for s in a], [len(s) for s in b]) * 8 if len(a) else np.zeros(0, np.int64)
    for bits in np.unique(level).tolist():
        some = np.flatnonzero(level == bits)
        for at in range(0, len(some), 4096):
            k = some[at : at + 4096].tolist()
            differ = np.bitwise_count(folded([a[i] for i in k], bits) ^ folded([b[i] for i in k], bits)).sum(1, dtype=np.int64)
            ok[k] = (100 + percent) * (total[k] - differ) >= 2 * percent * total[k]
    return ok


def summaries(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """_id, n, two keys of the whole set, parity sketch, extract, reach (prefix length within the extract)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for lo, hi, data, offsets in parts(batch.column(1)):
                h, at = shingles(data, offsets, size)
                n = np.diff(at)
                sums = [np.concatenate(([U(0)], np.cumsum(mix(h ^ U(salt))))) for salt in (0x5EED, 0xFACE)]
                q = _extract(n, percent)
                fewest = _least(n, percent)
                reach = q - (_extract(fewest, percent) - _prefix(fewest, percent))
                out[0].append(n)
                out[1].append((sums[0][at[1:]] - sums[0][at[:-1]]).view(np.int64))
                out[2].append((sums[1][at[1:]] - sums[1][at[:-1]]).view(np.int64))
                out[3] += parity_sketches(h, at)
                out[4] += [h[a : a + k].view(np.int64) for a, k in zip(at[:-1], q, strict=True)]
                out[5].append(np.minimum(reach, q))
            if out[0]:
                one = [np.concatenate(out[k]) for k in (0, 1, 2, 5)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(one[0].astype(np.int32)), pa.array(one[1]), pa.array(one[2]), pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int64())), pa.array(one[3].astype(np.int32))],
                    ["_id", "n", "k1", "k2", "sketch", "extract", "reach"],
                )

    return docs.select("_id", "text").mapInArrow(run, "_id long, n int, k1 long, k2 long, sketch binary, extract array<long>, reach int")


def _sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """_id and the whole shingle set, as bytes, of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for _, _, data, offsets in parts(batch.column(1)):
                h, at = shingles(data, offsets, size)
                sets += [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["_id", "shingles"])

    return docs.select("_id", "text").join(wanted, "_id", "left_semi").mapInArrow(run, "_id long, shingles binary")


def _linked(pairs: DataFrame, members: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) that link, written: sketches first, then whole sets, which only the documents of pairs that are left get."""
    own = members.select("_id", "n", "sketch")
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = pairs.filter((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            yield batch.filter(pa.array(_may_link(*(batch.column(k).to_pylist() for k in (4, 5)), n, percent), pa.bool_())).select(["a", "b"])

    near = written(pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(close, "a long, b long"), "near")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    wanted = written(near.select(F.col("a").alias("_id")).unionByName(near.select(F.col("b").alias("_id"))).distinct(), "wanted")
    sets = written(_sets(docs, wanted, size), "sets")
    both = near
    for side in ("a", "b"):
        both = both.join(sets.select(F.col("_id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    links = written(both.select("a", "b", "set_a", "set_b").mapInArrow(same, "a long, b long"), "linked")
    discard(near, wanted, sets)
    return links


def _across(shelves: DataFrame, rows: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of different components on one shelf (head, _id) that sizes and parity sketches leave.

    A shelf is dealt into blocks; each pair of blocks is compared as arrays in one place, so the rows that move are the
    blocks, and only the pairs that may link are made. Shelves and blocks stream through a task in order.
    """
    counts = shelves.groupBy("head").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    d = shelves.join(counts, "head").withColumn("own", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(rows, "_id")
    d = d.select("head", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "_id", "n", "component", "sketch")
    key = ["head", "lo", "hi"]

    def compare(parts_: list[pd.DataFrame]) -> pd.DataFrame:
        g = pd.concat(parts_) if len(parts_) > 1 else parts_[0]
        ids, n, of, own = (g[c].to_numpy() for c in ("_id", "n", "component", "own"))
        whole = g["sketch"].tolist()
        sketch, long = folded(whole, SKETCH), np.array([len(s) * 8 > SKETCH for s in whole])
        same, out = g["lo"].iloc[0] == g["hi"].iloc[0], []
        for at in range(0, len(g), 128):
            s = slice(at, at + 128)
            total = n[s, None].astype(np.int64) + n[None, :]
            ok = (of[s, None] != of[None, :]) & (ids[s, None] < ids[None, :]) & (100 * np.minimum(n[s, None], n[None, :]) >= percent * np.maximum(n[s, None], n[None, :]))
            if not same:
                ok &= own[s, None] != own[None, :]
            i, j = np.nonzero(ok)
            differ = np.bitwise_count(sketch[at + i] ^ sketch[j]).sum(1, dtype=np.int64)
            left = (100 + percent) * (total[i, j] - differ) >= 2 * percent * total[i, j]
            more = np.flatnonzero(left & long[at + i] & long[j])  # few of the least sketches tell long texts apart
            left[more] = _may_link([whole[k] for k in (at + i[more]).tolist()], [whole[k] for k in j[more].tolist()], total[i[more], j[more]], percent)
            out.append(np.stack((ids[at + i[left]], ids[j[left]]), 1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            k = pdf[key].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                part = pdf.iloc[lo:hi]
                if held and tuple(held[0][key].iloc[0]) != tuple(k[lo]):
                    yield compare(held)
                    held = []
                held.append(part)
        if held:
            yield compare(held)

    return d.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "a long, b long")


def _labelled(ids: DataFrame, components: DataFrame | None) -> DataFrame:
    """Adds component; what has no link yet is its own."""
    if components is None:
        return ids.withColumn("component", F.col("_id"))
    return ids.join(components, "_id", "left").withColumn("component", F.coalesce("component", "_id"))


def components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id that links reach)."""
    d = unique_ids(docs)
    known = written(summaries(d, percent, size), "summaries")
    keys = ["n", "k1", "k2"]
    classes = written(known.filter("n > 0").groupBy(*keys).agg(F.min("_id").alias("rep")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("_id")), "_id", "left_semi")

    # shingles that stand in several extracts, with their number; all others are a document's own
    rows = reps.select("_id", F.explode("extract").alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    found = written(rows.join(often.hint("shuffle_hash"), "token"), "tokens")
    prefix = found.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    own = F.col("width") - F.size("shared")
    members = (
        known.select("_id", "n", "sketch", "reach", F.size("extract").alias("width")).join(prefix, "_id").withColumn("left", F.col("reach") - own).filter("left > 0")
        .select("_id", "n", "sketch", F.transform(F.slice("shared", 1, F.col("left")), lambda x: x["token"]).alias("tokens"), (own == 0).alias("alike"),
                F.aggregate("shared", F.lit(0).cast("long"), lambda a, x: a + x["df"]).alias("weight"))
    )
    members = written(members, "members")
    keyed = written(known.select("_id", *keys), "keyed")
    discard(found, known)
    # groups of identical prefixes and sizes
    group = members.filter("alike").groupBy("n", "tokens").agg(F.min("_id").alias("g"), F.count("*").alias("m")).filter("m > 1")
    grouped = written(
        members.join(group.select("n", "tokens", "g"), ["n", "tokens"], "left").select("_id", F.coalesce("g", "_id").alias("g")), "groups"
    )
    lists = written(members.join(grouped.filter("_id = g").select("_id"), "_id", "left_semi").select(F.col("_id").alias("g"), "weight", F.explode("tokens").alias("token")), "lists")

    # members against their group, and every group against the best of the heads of its lists (a list's head is the one
    # whose extract is the most common, so the text that near copies have been made from): one pair for each document
    head = F.max(F.struct("weight", (-F.col("_id")).alias("first"), F.col("_id").alias("head"))).alias("x")
    tops = lists.withColumnRenamed("g", "_id").groupBy("token").agg(head, F.count("*").alias("m")).filter("m > 1").select("token", "x.head", F.col("x.weight").alias("top"))
    best = lists.join(tops, "token").filter("g != head").groupBy("g").agg(F.max(F.struct("top", (-F.col("head")).alias("first"), "head")).alias("x"))
    stars = best.select(F.least("g", "x.head").alias("a"), F.greatest("g", "x.head").alias("b"))
    pairs = grouped.filter("_id != g").select(F.col("g").alias("a"), F.col("_id").alias("b")).unionByName(stars).distinct()
    links = _linked(pairs, members, d, percent, size)
    # what is left: lists that hold different components, groups expanded to their members
    tied = connected(links)
    everyone = _labelled(grouped, tied).join(members.select("_id", "weight"), "_id")
    full = lists.drop("weight").join(everyone, "g").select("token", "_id", "component", "weight").unionByName(
        everyone.join(grouped.filter("_id != g").select("g").distinct(), "g", "left_semi").select(F.col("g").alias("token"), "_id", "component", "weight")
    )
    mixed = full.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), head).filter("lo != hi")
    shelves = full.join(mixed.select("token", "x.head"), "token").select("head", "_id").distinct()
    shelves = written(shelves, "shelves")
    pairs = _across(shelves, _labelled(members.select("_id", "n", "sketch"), tied), percent).distinct()
    more = _linked(pairs, members, d, percent, size)
    discard(shelves, lists, grouped, members)
    tied = connected(written(links.unionByName(more), "linked"))

    ids = d.select("_id", "doc_id")
    named = _labelled(classes.withColumnRenamed("rep", "_id"), tied).select(*keys, "component")
    out = keyed.join(named, keys, "left").select("_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "_id").alias("component"))
    return out.join(ids, "_id").join(ids.select(F.col("_id").alias("component"), F.col("doc_id").alias("component_id")), "component").select("doc_id", "n_shingles", "component_id")
