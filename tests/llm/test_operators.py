"""Operators against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import bpe, classifier, components, exact_dedup, jaccard_join, packing, quality_rules, sharding, substring_dedup, suffix_dedup, token_store
from tracemill.llm.common import shared_dir
from tracemill.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, a string, component string, n int"


def texts():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, long = say(60), say(3000)
    base = say(120)
    near = base.split()
    near[60] = "changed"
    out = [None, "", " \n ", "one", "One TWO", base, base, " ".join(near), base.upper(), "x " + base, say(40) + " " + passage + " " + say(40), passage + "\n" + say(90), long, long[:9000] + " end",
           "spam " * 300, "ab" * 400, "a" * 700, "Line one here.\nLine one here.\n| Home | About |\nBuy!! NOW!! ###", "é " * 120 + "日本語 テキスト " * 30, say(20), say(19)]
    return out + [say(rnd.randint(1, 200)) for _ in range(20)]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "clash", "clash", 3) for i, t in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def got(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_substring_dedup(docs, rows, none):
    first, words = {}, {i: WORD.findall(t or "") for i, t in rows}
    for i, w in words.items():
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    found = got(substring_dedup.remove_repeats(docs))
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (i, p):
                gone[p : p + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept_text"]) == (len(w), sum(gone), kept)
        assert found[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("split", [4096, 2])
def test_suffix_dedup(docs, rows, none, split):
    count = collections.Counter()
    data = {i: (t or "").encode() for i, t in rows}
    for b in data.values():
        count.update(b[p : p + 200] for p in range(len(b) - 199))
    found = got(suffix_dedup.remove_repeats(docs, split=split, keep=("lang", "a")))
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (found[i]["n_bytes"], found[i]["n_removed"], found[i]["n_spans"], found[i]["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        assert found[i]["a"] == "clash"
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_array_and_prefixes():
    rnd = random.Random(2)
    for _ in range(60):
        d = bytes(rnd.choice(rnd.choice([b"ab", b"\0a", b"abc\xff"])) for _ in range(rnd.randint(1, 90))) + rnd.choice([b"", b"\0\0\0", b"aaa"])
        a = np.frombuffer(d, np.uint8)
        order = suffix_dedup.suffix_array(a)
        want = sorted(range(len(d)), key=lambda i: d[i:])
        assert order.tolist() == want

        def common(x, y, d=d):
            n = 0
            while max(x, y) + n < len(d) and d[x + n] == d[y + n]:
                n += 1
            return n

        assert suffix_dedup.common_prefixes(a, order).tolist() == [0] + [common(x, y) for x, y in zip(want, want[1:])]


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, text), (1, text), (None, text), (0, "short")], "doc_id long, text string")
    words = sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(d).collect())
    assert [x[2] for x in words] == [0, 0, 60, 60]
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(d).collect()) == [0] + [len(text)] * 3
    assert sorted(r.group_size for r in exact_dedup.groups(d).collect()) == [1, 3, 3, 3]
    assert {(r.doc_id, r.component_id) for r in jaccard_join.components(d).collect()} == {(0, 0), (1, 1), (None, 1)}


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(docs, rows, none):
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got(jaccard_join.components(docs)).items()} == brute_components(rows)
    assert jaccard_join.components(none).count() == 0


def test_long_texts_have_sketches_that_tell_them_apart(spark, monkeypatch):
    """Long texts that share half of their words: no pair of them needs its sets; of two that link, both are fetched."""
    rnd = random.Random(5)
    say = lambda n: " ".join(f"w{rnd.randrange(10**7)}" for _ in range(n))
    half = say(3000)
    rows = [(i, f"{half} {say(3000)}") for i in range(8)]
    rows.append((8, rows[2][1] + " and some words more"))
    fetched, sets_of = [], jaccard_join._sets

    def fetch(docs, wanted, size):
        fetched.append({r._id for r in wanted.collect()})
        return sets_of(docs, wanted, size)

    monkeypatch.setattr(jaccard_join, "_sets", fetch)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got(jaccard_join.components(d)).items()} == brute_components(rows)
    assert set().union(*fetched) == {2, 8}


def test_parity_sketches():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 500, 1024, 1025, 5000, 20000)]
    sets += [np.unique(np.concatenate((s[len(s) // 20 :], rnd.integers(0, 2**63, len(s) // 20).astype(np.uint64)))) for s in sets]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    sketches = jaccard_join.parity_sketches(np.concatenate(sets), at)
    for s, k in zip(sets, sketches, strict=True):
        assert len(k) * 8 >= max(512, len(s) / 2) and (len(k) * 8 == 512 or len(k) * 8 < len(s))
        for bits in {512, len(k) * 8}:
            plain = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
            assert np.packbits(plain.astype(np.uint8)).tobytes() == jaccard_join.folded([k], bits).tobytes()
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    total = np.array([len(sets[i]) + len(sets[j]) for i, j in pairs])
    may = jaccard_join._may_link([sketches[i] for i, _ in pairs], [sketches[j] for _, j in pairs], total, 90)
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in pairs])
    alike = np.array([10 * min(len(sets[i]), len(sets[j])) >= 9 * max(len(sets[i]), len(sets[j])) for i, j in pairs])  # as joins see to
    assert may[(total > 0) & (100 * both >= 90 * (total - both))].all() and not may[alike & (2 * both < total - both) & (total > 100)].any()


def test_jaccard_join_fetches_the_sets_of_near_pairs_only(spark, monkeypatch):
    """Documents that share half of their text with others are compared by sketches; only what may link has its set written, and it goes again."""
    rnd = random.Random(12)
    half = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(31)]
    rows = [(i, f"{half[i]} {half[i + 1]}") for i in range(30)] + [(30, f"{half[3]} {half[4]} last")]
    made, write = {}, jaccard_join.written

    def written(df, name):
        out = write(df, name)
        made.setdefault(name, []).append((out.count(), {f.rpartition("/")[0].removeprefix("file://") for f in out.inputFiles()}))
        return out

    monkeypatch.setattr(jaccard_join, "written", written)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got(jaccard_join.components(d)).items()} == brute_components(rows)
    assert sum(n for n, _ in made["sets"]) == 2
    assert not any(os.path.exists(f) for name in ("summaries", "tokens", "members", "lists", "sets") for _, folders in made[name] for f in folders)


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_join_chains_and_borders(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join._across, "__defaults__", (block,))
    rnd = random.Random(4)
    base, rows = [f"t{i}" for i in range(90)], []
    for k in range(60):  # a slow drift: neighbours link, ends do not
        base = list(base)
        base[rnd.randrange(90)] = f"n{k}"
        rows.append((k, " ".join(base)))
    rows += [(100 + n, " ".join(f"s{i}" for i in range(n))) for n in range(1, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got(jaccard_join.components(d)).items()} == brute_components(rows)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    found = {r._id: r.component for r in components.connected(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_exact_dedup(docs, rows, none):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    found = got(exact_dedup.groups(docs))
    for i, t in norm.items():
        same = [j for j in norm if norm[j] == t]
        assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"]) == (min(same), len(same), i == min(same))
        assert found[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.groups(none).count() == 0


def test_chunks_join_to_the_text(docs):
    d = docs.select(exact_dedup.normalised().alias("t")).select("t", exact_dedup.chunks(F.col("t")).alias("c"))
    assert d.filter(F.array_join("c", "") != F.col("t")).count() == 0
    assert d.filter(F.exists("c", lambda x: F.length(x) > exact_dedup.MAX_CHUNK)).count() == 0


def test_quality_rules(docs, rows, none):
    found = got(quality_rules.judge(docs))
    for i, t in rows:
        w = WORD.findall(t or "")
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {q for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for q in (p, p + 1, p + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = found[i]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(map(len, w)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w))
    assert quality_rules.judge(none).count() == 0 and quality_rules.clean(none).count() == 0


def test_cleaning_removes_lines(spark):
    rnd = random.Random(5)
    good = "\n".join(" ".join(f"word{rnd.randrange(500)}" for _ in range(9)) + "." for _ in range(12))
    d = spark.createDataFrame([(1, good + "\nHome | News | About\nAll rights reserved 2020.", "x"), (2, "A | B | C\n" * 60, "y")], "doc_id long, text string, extra string")
    assert [(r.doc_id, r.text, r.extra) for r in quality_rules.clean(d).collect()] == [(1, good, "x")]


def test_bpe_is_the_library(docs, rows, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library, found = Tokenizer.from_file(path), got(bpe.round_trip(docs, path, ids=True))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[i]["ids"] == ids and found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(none, path).count() == 0


def test_odd_texts_and_tiny_blocks():
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "!!", "1", "\t", " th", "'s", "x\x1c", "<|endoftext|>", "<|startoftext|>", "日", "İ", "ﬁ", "́", "\xa0", "\0"]
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    for name, by_word in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        from tracemill.llm.pieces import LibraryTokens

        library, ours = Tokenizer.from_file(tokenizer(name)), LibraryTokens(tokenizer(name), by_word)
        for t in odd:
            assert np.frombuffer(ours.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    t = bpe.Transducer(tokenizer("byte_bpe_50k.json"))
    for x in odd:
        assert t.encode(x)[1].tolist() == Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode(x, add_special_tokens=False).ids if len(x) < 6 else True
    for _ in range(200):
        data = "".join(rnd.choice(rnd.choice(["ab", "theing", "aeinrst", "=-_"])) for _ in range(rnd.randint(1, 300))).encode()
        e = bpe.Encoder(t.merges, 3)
        assert e.feed(data) + e.flush() == t.merges.merged(data)


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    p = packing.pack(docs, path, length=256, n_open=2, merge=2).toPandas()
    for i, t in rows:
        ids, at = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for q in p[p.doc_id == i].sort_values("start").itertuples():
            assert q.start == at and q.doc_tokens == len(ids) and q.ids_crc32 == zlib.crc32(ids[at : at + q.length])
            at += q.length
        assert at == len(ids)
    fills = []
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()]
        fills.append(int(g.length.sum()))
    assert max(fills) <= 256 and sum(f < 256 for f in fills) <= 1
    assert packing.pack(none, path).count() == 0


def test_token_store(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path, at = tokenizer("byte_bpe_50k.json"), 0
    library, found = Tokenizer.from_file(path), got(token_store.read(token_store.write(docs, path)))
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert token_store.read(token_store.write(none, path)).count() == 0


def test_frames_are_independent_and_checked():
    import io

    sink = io.BytesIO()
    w, want = token_store.Writer(sink), [np.random.default_rng(k).integers(0, 50000, n).astype("<u2") for k, n in enumerate((5, 200_000, 0, 70_000))]
    for k, ids in enumerate(want):
        w.add(k, ids.tobytes())
    w.close()
    r = token_store.Reader(io.BytesIO(sink.getvalue()))
    assert all((r.ids(k) == want[k]).all() for k in (3, 0, 2, 1))
    broken = bytearray(sink.getvalue())
    broken[int(r.at[1]) + 40] ^= 1
    with pytest.raises(Exception):
        token_store.Reader(io.BytesIO(bytes(broken))).ids(1)


def test_sharding(spark, docs, none):
    store = sharding.ShardStore(spark, shared_dir(spark, "store"))
    for k in range(5):
        assert store.append(docs.filter(F.col("doc_id") % 5 == k).coalesce(1)) == k + 1
    before = store.manifest().count()
    assert store.compact(target_bytes=1 << 20) == 6
    assert store.manifest().count() < before and store.manifest(5).count() == before
    rows = lambda d: sorted(map(str, d.select(*docs.columns).collect()))
    assert rows(store.read()) == rows(docs) == rows(store.read(5))
    with pytest.raises(Exception):
        store.commit(store.manifest(), 2)  # version 3 exists
    assert store.compact() is None and store.expire() == before
    store.append(none)
    assert rows(store.read()) == rows(docs)


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = classifier.score(docs, classifier.train(docs, labels))
    r = scores.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.right > 0.95
    assert scores.filter("score < 0 or score > 1 or score is null").count() == 0


def test_classifier_edges(spark, docs, none, rows):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    w = classifier.train(docs, empty)
    assert {r.score for r in classifier.score(docs, w).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, None) for i, _ in rows] + [(None, 1, 0), (3, None, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert classifier.score(docs, classifier.train(docs, some)).count() == len(rows)
    assert classifier.score(none, w).count() == 0
