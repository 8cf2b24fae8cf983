import random

import corpus_pipeline
from conftest import SMALL
from test_operators import WORD

from tracemill.llm import jaccard_join


def shingles(text, size):
    w = WORD.findall(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def similarity(a, b, size):
    x, y = shingles(a, size), shingles(b, size)
    return len(x & y) / len(x | y)


def brute_components(rows, size, percent):
    sets, least = {i: shingles(t, size) for i, t in rows}, {i: i for i, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i]) for i in sets}


def copies():
    """A text of 500 words, copies of it with a block of new words each, and texts of their own."""
    rnd = random.Random(21)
    say = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    rows = []
    for block in (20, 60, 75, 90, 110, 119, 125, 140):
        base = say(500)
        cut = rnd.randrange(100, 400)
        rows += [" ".join(base), " ".join(base[:cut] + say(block) + base[cut:])]
    for _ in range(30):  # words changed here and there, similarities on both sides of the threshold
        base = say(200)
        near = [w if rnd.random() > 0.025 else "changed" for w in base]
        rows += [" ".join(base), " ".join(near)]
    rows += [" ".join(say(n)) for n in (1, 2, 3, 4, 5, 6, 40)]
    return list(enumerate(rows))


def test_links_from_four_fifths_on_five_words(spark):
    rows = copies()
    between = [(a, b) for a, b in zip(rows[:-7:2], rows[1:-7:2], strict=True) if 0.8 <= similarity(a[1], b[1], 5) < 0.9]
    assert len(between) > 10
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(d, 80, 5).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.near(spark, d, SMALL).collect()} == {i for i, (_, c) in want.items() if c == i}
