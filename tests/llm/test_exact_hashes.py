"""Texts that make polynomial hashes agree for every base and seed, and joins by anchors of every kind."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import exact_dedup, jaccard_join, runs, substring_dedup, suffix_dedup, textnum
from test_operators import got


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


ONE, OTHER = thue_morse(2048), thue_morse(2048, True)


def test_words_of_every_length_have_their_own_hash():
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abcé0-") for _ in range(rnd.randint(1, 90))) for _ in range(5000)} | {ONE, OTHER, "a", "a\0", "a" * 8, "a" * 9, "a" * 64, "a" * 65}
    words = sorted(words)
    data, offsets = textnum.buffer_of(__import__("pyarrow").array([" ".join(words)]))
    starts, ends, _ = textnum.word_spans(data, offsets)
    for salt in (0, 1):
        assert len(set(textnum.word_hashes(data, starts, ends, salt).tolist())) == len(words)
    grams = textnum.gram_hashes(textnum.word_hashes(data, starts, ends), 5)
    assert len(grams) == len(words) - 4 == len(set(grams.tolist()))
    assert (textnum.gram_hashes(textnum.word_hashes(data, starts, ends), 3)[7] == textnum.gram_hashes(textnum.word_hashes(data, starts[7:10], ends[7:10]), 3)[0]).all()


def test_words_with_the_same_polynomial_hash_are_different_words(spark):
    common = " ".join(f"w{i}" for i in range(19))
    d = spark.createDataFrame([(1, f"{common} {ONE}"), (2, f"{common} {OTHER}"), (3, ONE), (4, OTHER)], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.remove_repeats(d).collect()} == {0}
    assert {r.doc_id: r.component_id for r in jaccard_join.components(d).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_words_are_compared_whatever_stands_between_them(spark):
    words = [f"w{i}" for i in range(25)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, "\n\t ".join(words) + "\n")], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(d).collect()} == {1: (0, " ".join(words)), 2: (25, "")}


def branching():
    """Texts that share an anchor and go on in different ways, repeats inside a text, and periodic texts."""
    rnd = random.Random(8)
    core, say = [f"c{i}" for i in range(24)], lambda n: [f"v{rnd.randrange(40)}" for _ in range(n)]
    rows = []
    for k in range(40):
        cut = rnd.randrange(0, 24)
        rows.append(say(rnd.randrange(12)) + core[:cut] + say(rnd.randrange(3)) + core[cut:] + say(rnd.randrange(12)))
    rows += [core[a:b] for a, b in ((0, 20), (0, 21), (2, 24), (4, 24), (3, 23))] + [core + core, ["x"] * 60, ["x", "y"] * 40, ["x", "y", "z"] * 9, core * 4]
    return [" ".join(r) for r in rows]


@pytest.mark.parametrize("gram, hot", [(5, 1000), (2, 1000), (5, 10**9)])
def test_branching_paths(spark, gram, hot, monkeypatch):
    monkeypatch.setattr(runs, "HOT", hot)  # the greatest makes every key a hot one
    rows = list(enumerate(branching()))
    first, words = {}, {i: t.split() for i, t in rows}
    for i, w in words.items():
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    found = got(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), gram=gram))
    for i, w in words.items():
        gone = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] != (i, p) for q in range(p, p + 20)}
        assert (found[i]["n_removed"], found[i]["kept_text"]) == (len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)), i


@pytest.mark.parametrize("split, hot", [(4096, 1000), (3, 10**9)])
def test_hot_anchor_over_several_shards(spark, split, hot, monkeypatch):
    monkeypatch.setattr(runs, "HOT", hot)
    """One passage between texts of their own in most documents: one anchor with many contents, pairs of which share more."""
    rnd = random.Random(12)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, rows = say(180), []
    for k in range(60):
        left, right = say(90), say(90)
        rows.append(left + passage + right)
        if k % 6 == 0:  # one more that shares a window over the border, left or right
            rows.append((say(60) + left[-25:] + passage + say(90)) if k % 4 else (say(90) + passage + right[:30] + say(50)))
    rows += [say(20) + passage + "é" * 20, passage + passage]
    data, count = dict(enumerate(t.encode() for t in rows)), Counter()
    for b in data.values():
        count.update(b[p : p + 200] for p in range(len(b) - 199))
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = got(suffix_dedup.remove_repeats(d, split=split))
    assert sum(r["n_removed"] for r in found.values()) > 0
    for i, b in data.items():
        gone = {q for p in range(len(b) - 199) if count[b[p : p + 200]] > 1 for q in range(p, p + 200)}
        kept = bytes(c for q, c in enumerate(b) if q not in gone)
        assert (found[i]["n_removed"], found[i]["kept_sha256"]) == (len(gone), hashlib.sha256(kept).hexdigest()), i


def test_runs_of_equal_digest_are_equal_text():
    text = " ".join(f"w{i % 7}" for i in range(200)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    r, _, digest = runs.Unit(20, 5, True).runs(data, offsets)
    words, seen = text.split(), {}
    for lo, hi, d in zip(r["first"].tolist(), r["last"].tolist(), digest.tolist(), strict=True):
        seen.setdefault(tuple(d), set()).add(tuple(words[lo : hi + 20]))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_identifiers_that_collide_fall_back_to_digests(spark, monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc. ") for _ in range(3000)) for _ in range(12)]
    rows = list(enumerate(texts + texts[:4] + ["", None]))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.groups(d).collect()}
    whole = exact_dedup.identifier
    monkeypatch.setattr(exact_dedup, "identifier", lambda c: whole(c).bitwiseAND(3))
    assert not exact_dedup.collisions(d).isEmpty()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.groups(d).collect()} == want
    assert want == {(i, min(j for j, u in rows if " ".join((u or "").split(" ")) == " ".join((t or "").split(" "))), k) for i, t in rows for k in [sum((u or "") == (t or "") for _, u in rows)]}


@pytest.mark.parametrize("hot", [1000, 10**9])
def test_a_long_passage_is_one_unitig(spark, hot, monkeypatch):
    """Three documents share 2,000 words in different surroundings, one of them twice; another passage branches off it half way."""
    monkeypatch.setattr(runs, "HOT", hot)
    rnd = random.Random(9)
    say = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage, half = say(2000), say(500)
    texts = [say(70) + passage + say(40), say(30) + passage + say(90), say(55) + passage + say(60) + passage[:900] + half, say(33) + half]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "_id long, text string")
    paths = runs.repeated(docs, runs.Unit(20, 5, True))
    whole = paths.filter("copies > 1").select("_id", "first", "n", *runs.CONTENT, "copies", ((F.col("_id") == F.col("source")) & (F.col("k") == 0)).alias("source"))
    found = sorted(substring_dedup.unitigs(whole, runs.CONTENT).collect())
    assert len(found) < 20 < whole.count() / 20
    longest = [r for r in found if r.length > 800]
    assert {(r._id, r.copies, r.source) for r in longest} >= {(0, 4, True), (0, 3, True), (1, 4, False), (1, 3, False), (2, 3, False)}
    by_place = {(r._id, p) for r in found for p in range(r.first, r.first + r.length)}
    assert by_place == {(r._id, p) for r in whole.collect() for p in range(r.first, r.first + r.n)}  # unitigs hold what paths held
