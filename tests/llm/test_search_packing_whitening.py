"""Ranked search, best-fit packing and whitening against plain Python and numpy, and on nulls, long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm import best_fit, lexical_search, whitening
from tracemill.llm.queries import tokenizer

CLASHES = "row n terms tfs h m members place number term weight rank score item_id left group piece start length x v w0 e component keep".split()
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)


def texts():
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice("the of stone River light PAPER house under seven quiet Ünder 日本語 x2".split()) for _ in range(n))
    same, long = say(30), say(30_000)
    out = [(1, same), (2, same), (3, same.upper()), (3, same), (None, same), (None, None), (4, None), (5, ""), (6, " \n\0,;"), (7, long), (8, "stone"), (9, "stone"), (10, "STONE stone"), (11, "é" * 50_000), (12, "!" * 50_000)]
    return out + [(20 + k, say(rnd.randrange(1, 60))) for k in range(60)] + [(100 + k, "paper house") for k in range(40)]


ITEMS = [(1, "The stone, the RIVER"), (2, "paper house"), (2, "Quiet"), (None, "seven seven ünder"), (3, None), (4, " ?"), (5, "nowhere"), (6, "日本語 stone paper of under")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def plain_search(top=10):
    bags = [(i, collections.Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in texts()]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    wanted = collections.defaultdict(set)
    for i, t in ITEMS:
        wanted[i].update(TERM.findall((t or "").translate(FOLD)))
    out = []
    for item, words in wanted.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in b for _, b in bags) + 1))) for t in words}
        found = []
        for i, b in bags:
            m = 100 - 90 + 90 * sum(b.values()) * n // total
            if (s := sum(w[t] * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in words if t in b)) > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"vocabulary": 0}, {"block": 3, "most": 2}, {"top": 3}])
def test_search(docs, items, limits):
    assert rows_of(lexical_search.search(docs, items, **limits)) == plain_search(limits.get("top", 10))


def test_search_in_steps(docs, items, monkeypatch):
    monkeypatch.setattr(lexical_search, "STEP", 1)
    assert rows_of(lexical_search.search(docs, items)) == plain_search()


def test_search_edges(docs, items):
    other = {c: F.lit(f"own {c}") for c in CLASHES}
    assert rows_of(lexical_search.search(docs.withColumns(other), items.withColumns({c: v for c, v in other.items() if c != "item_id"}))) == plain_search()
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text is null"), items)):
        found = lexical_search.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def packed(spark, docs, **limits):
    d = best_fit.pack(docs, tokenizer("byte_bpe_50k.json"), **limits)
    assert d.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return [r.asDict() for r in d.collect()]


def check_packed(rows, expected, length):
    """rows hold each document (id, ids) once, pieces as the contract says; the number of sequences."""
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at and n > 0
            at += n
        assert at <= length
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    wanted = collections.Counter()
    for i, ids in expected:
        first = (len(ids) - 1) % length + 1
        cuts = [0, *range(first, len(ids), length)]
        for k, start in enumerate(cuts):
            piece = ids[start : first if not k else start + length]
            wanted[i, k, start, len(piece), crc(piece)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    return len(bins)


@pytest.mark.parametrize("limits", [{}, {"length": 64, "n_open": 2, "merge": 2}, {"length": 7, "n_open": 1, "merge": 2}])
def test_best_fit(spark, docs, limits):
    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    expected = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts()]
    n = check_packed(packed(spark, docs, **limits), expected, limits.get("length", 1024))
    assert n <= 1.15 * -(-sum(len(ids) for _, ids in expected) // limits.get("length", 1024)) + 1
    check_packed(packed(spark, docs.withColumns({c: F.lit("own") for c in CLASHES}), **limits), expected, limits.get("length", 1024))
    assert packed(spark, docs.limit(0), **limits) == []


@pytest.mark.parametrize("limits", [{}, {"n_open": 8, "merge": 3}])
def test_many_tasks_waste_little(spark, limits):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice("one two three four".split()) for _ in range(rnd.choice([5, 40, 300, 700, 1500])))) for k in range(900)]
    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    expected = [(i, [*tok.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows]
    n = check_packed(packed(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(20), **limits), expected, 1024)
    assert n <= 1.02 * sum(len(ids) for _, ids in expected) / 1024 + 1


def test_bins_are_best_fit():
    bins = best_fit.Bins(10, 3)
    put = lambda n: bins.add((n, 0, 0, n, 0))
    assert put(6) is None and put(7) is None and put(10) == [(10, 0, 0, 10, 0)]
    assert [p[0] for p in put(3)] == [7, 3]  # into the fuller of two, which is full then
    assert put(5) is None and put(5 + 3) is None
    assert [p[0] for p in put(9)] == [8]  # three are open: the fullest closes
    assert put(1) is not None and [len(b) for b in bins.rest()] == [1, 1]


def test_best_fit_wastes_little(spark):
    rnd = random.Random(3)
    lengths = [rnd.randrange(1, 1025) for _ in range(20_000)]
    bins, closed = best_fit.Bins(), 0
    for k, n in enumerate(lengths):
        closed += bins.add((k, 0, 0, n, 0)) is not None
    assert closed + len(bins.rest()) <= 1.03 * sum(lengths) / 1024


def plain_whiten(vectors, components=4):
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in good)
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (d - len(v)) for _, v in good], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(axis=0)
    cov = (n * fit.T @ fit - np.outer(s, s)).astype(float) / n**2
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    some = [k for k in range(min(components, d)) if e[k] > 1e-9 * e[0]]
    w = ((x * n - s).astype(float) / n) @ u[:, some] / np.sqrt(e[some])
    return [i for i, _ in good], n, [int(v) for v in ((n * x - s) ** 2).sum(axis=1)], w, e[some] / np.trace(cov), e


def check_whitened(found, vectors, vectors_differ=True):
    ids, n, deviation, w, share, _ = plain_whiten(vectors)
    by = collections.defaultdict(list)
    for r in found:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, len(share) + 1))
    order = lambda rs: sorted(rs, key=lambda r: (str(r["vec_id"]), r["deviation"], abs(r["whitened"])))
    for k, rs in by.items():
        assert sorted((str(r["vec_id"]), r["deviation"]) for r in rs) == sorted(zip(map(str, ids), deviation, strict=True))
        assert {r["n"] for r in rs} == {n} and all(math.isclose(r["explained"], share[k - 1], rel_tol=1e-9) for r in rs)
        assert len({r["identity_error"] for r in rs}) == 1 and rs[0]["identity_error"] < 1e-9
        if vectors_differ:
            ours = np.array([r["whitened"] for r in order(rs)])
            theirs = np.array([r["whitened"] for r in order([{"vec_id": i, "deviation": v, "whitened": float(a)} for i, v, a in zip(ids, deviation, w[:, k - 1], strict=True)])])
            assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-7


def vectors(seed=1, d=9, n=200):
    rnd = np.random.default_rng(seed)
    base = (rnd.normal(size=(n, d)) * np.linspace(0.2, 3, d)).round(3).tolist()
    return [(k, v) for k, v in enumerate(base)] + [(0, base[0]), (None, base[1]), (None, None), (1000, base[2]), (1001, [None] * d), (1002, [float("nan")] * d), (1003, [0.0] * (d - 1) + [float("-inf")])]


SCHEMA = "vec_id long, embedding array<double>"


def test_whitening(spark):
    v = [*vectors(), (7, [1.0, 2.0]), (8, [])]
    df = spark.createDataFrame(v, SCHEMA)
    check_whitened([r.asDict() for r in whitening.whiten(df.repartition(4)).collect()], v)
    check_whitened([r.asDict() for r in whitening.whiten(df.withColumns({c: F.lit("own") for c in CLASHES if c != "v"}).withColumn("v", F.lit(3))).collect()], v)


def test_whitening_of_few_dimensions_and_equal_roots(spark):
    cross = [(k, [float(a), float(b), float(c)]) for k, (a, b, c) in enumerate([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 2), (0, 0, -2)])]
    found = [r.asDict() for r in whitening.whiten(spark.createDataFrame(cross, SCHEMA)).collect()]
    check_whitened(found, cross, vectors_differ=False)  # two roots are equal: any basis of their plane
    line = [(k, [k * 0.5, k * 1.0, -k * 0.25, 3.0]) for k in range(12)]
    found = [r.asDict() for r in whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()]
    assert {r["component"] for r in found} == {1} and len(found) == 12
    check_whitened(found, line)


def test_whitening_edges(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        found = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert found.count() == 0 and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    huge = [(k, [math.ldexp(k % 7 - 3, 40), math.ldexp(k % 5, 30), float(k)]) for k in range(40)] + [(41, [1e300, 0.0, -1e300])]
    found = [r.asDict() for r in whitening.whiten(spark.createDataFrame(huge, SCHEMA)).collect()]
    assert len(found) == 3 * 41 and all(r["deviation"] is None for r in found if r["vec_id"] == 41) and all(math.isfinite(r["whitened"]) for r in found)
    floats = spark.createDataFrame([(k, [0.1 * k, -0.3 * k * k]) for k in range(9)], "vec_id int, embedding array<float>")
    assert whitening.whiten(floats).count() == 18


@pytest.mark.parametrize("d", [1, 2, 5, 12])
def test_characteristic_polynomial_and_roots(spark, d):
    rnd = np.random.default_rng(d)
    a = rnd.integers(-50, 50, (d + 2, d)).astype(object)
    a[:, d // 2] = a[:, 0]
    m = a.T @ a
    c = whitening.characteristic(spark, m)
    assert np.allclose(np.array(c, float), np.poly(m.astype(float)), rtol=1e-8, atol=1e-3 * abs(float(c[1])) ** d)
    assert c[0] == 1 and c[1] == -sum(m.diagonal())
    roots = whitening.greatest_roots(c, d, 100)
    wanted = np.linalg.eigvalsh(m.astype(float))[::-1]
    assert np.allclose([r / 2**100 for r in roots], wanted[: len(roots)], rtol=1e-9) and (wanted[len(roots) :] < 1e-6 * wanted[0]).all()


def test_hessenberg_swaps_where_a_pivot_is_zero():
    m = np.array([[2, 0, 1, 0], [0, 3, 0, 5], [1, 0, 4, 0], [0, 5, 0, 1]], object)
    p = np.array(whitening.primes(100))
    assert (whitening.residues(m, p) == np.array([[int(round(c)) % int(q) for c in np.poly(m.astype(float))] for q in p])).all()
