"""The five stages and run() against plain Python, and the transducer on texts of any length."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_operators import WORD
from test_pipeline_near import brute_components

from tracemill.llm import bpe, quality_rules
from tracemill.llm.common import shared_dir
from tracemill.llm.queries import tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rnd = random.Random(31)
    say = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    line = lambda n: " ".join(say(n))
    base, passage = say(400), line(60)
    near = base[:200] + say(70) + base[200:]
    body = "\n".join(line(12) for _ in range(8))
    return [
        None, "", line(10), body + "\nHome | News | About\nBuy!!!! now!!!!\nread our Privacy Policy today", "A | B | C\n" * 60, "spam " * 200, " ".join(base), " ".join(base), " ".join(base).replace(" ", "\n ", 3),
        " ".join(near), line(50) + " " + passage + " é日本 " + line(50), line(70) + " " + passage, line(49), line(50), line(900), passage + " " + line(60), *(line(rnd.randint(50, 300)) for _ in range(10)),
    ]


def solid(t):
    return len(re.sub(r"[\x20\x09-\x0D]", "", t))


def broken(x):
    """The first rule that a line with a word breaks, in plain Python; bounds and lists as they are written, not taken from the operator."""
    n, w, low, end = solid(x), len(WORD.findall(x)), x.lower(), re.sub(r"[\x20\x09-\x0D]+$", "", x)
    furniture = (
        "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "forgot your password", "log in to", "lorem ipsum",
        "privacy policy", "read more", "share on", "sign up for", "skip to content", "subscribe to our", "terms of service", "terms of use", "view all comments",
    )
    if x.count("|") >= 2 or sum(c in "»›•·→" for c in x) >= 2:
        return "navigation"
    if 100 * sum(c in "#*$%&|<>" for c in x) > 10 * n:
        return "symbols"
    if 100 * x.count("!") > 10 * n or (not re.search("[a-zß-öø-ÿ]", x) and len(re.findall("[A-ZÀ-ÖØ-Þ]", x)) >= 12):
        return "shouting"
    if any(p in low for p in furniture):
        return "boilerplate"
    if any(p in low for p in ("http://", "https://", "www.")) and w < 8:
        return "link"
    if not any(c.isalpha() for c in x):
        return "no_letters"
    if end.endswith(("...", "…")) and w < 8:
        return "teaser"
    return "unfinished" if w < 4 and end[-1] not in ".!?;:…\"'”’)]" else None


def quality(rows):
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        seen, covered = {}, set()
        for p in range(len(w) - 2):
            seen.setdefault(tuple(w[p : p + 3]), []).append(p)
        for at in seen.values():
            covered |= {q for p in at if len(at) > 1 for q in (p, p + 1, p + 2)}

        seen_lines, left = set(), []
        for x in (t or "").split("\n"):
            if not WORD.search(x):
                left.append(x)
            elif broken(x) is None and x not in seen_lines:
                seen_lines.add(x)
                left.append(x)
        left = "\n".join(left)
        if len(w) >= 50 and 2 * len(covered) <= len(w) and 2 * solid(left) >= solid(t):
            out.append((i, left))
    return out


def exact(rows):
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    return sorted(first.values())


def near(rows):
    found = brute_components(rows, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    return [(i, t) for i, t in rows if found[i][1] == i]


def substrings(rows):
    seen, out = {}, []
    data = {i: t.encode() for i, t in rows}
    for b in data.values():
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] = seen.get(b[p : p + 200], 0) + 1
    for i, b in data.items():
        gone = {q for p in range(len(b) - 199) if seen[b[p : p + 200]] > 1 for q in range(p, p + 200)}
        left = bytes(c for q, c in enumerate(b) if q not in gone).decode("utf-8", "ignore")
        if left:
            out.append((i, left))
    return out


def held(pieces, rows):
    """Each document's ids stand in order in its pieces, and windows are full but for one."""
    from tokenizers import Tokenizer

    library, got, fills = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), {}, {}
    for r in sorted(pieces, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).append(r)
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(got) == [i for i, _ in rows]
    for i, t in rows:
        ids, at = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4"), 0
        for r in got[i]:
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for spans in fills.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
    sizes = [sum(n for _, n in s) for s in fills.values()]
    assert max(sizes) <= 4096 and sum(n < 4096 for n in sizes) <= 1


def test_stages_and_run(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS).repartition(3)
    folder = shared_dir(spark, "pipeline-input")
    docs.write.parquet(f"{folder}/documents.parquet")
    for (_, stage), brute in zip(corpus_pipeline.STAGES, (quality, exact, near, substrings), strict=False):
        before, rows = len(rows), brute(rows)
        assert 5 < len(rows) and (len(rows) < before or brute is substrings)
        docs = stage(spark, docs, folder).cache()
        assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()) == [(i, t, "en", "s", len(t)) for i, t in rows]
    held(corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect(), rows)
    held(corpus_pipeline.run(spark, folder).collect(), rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_transducer_on_odd_texts_of_any_length(name):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "!!", "1", "\t", " th", "'s", "x\x1c", "<|endoftext|>", "<|startoftext|>", "日", "İ", "ﬁ", "́", "\xa0", "\0"]
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    library, ours = Tokenizer.from_file(tokenizer(name)), bpe.Transducer(tokenizer(name))
    assert sum(len(x) >= 6 for x in odd) > 200
    wrong = [x for x in odd if ours.encode(x)[1].tolist() != library.encode(x, add_special_tokens=False).ids]
    assert not wrong, (len(wrong), wrong[:3])


LINES = {
    "Home | News | About us today": "navigation", "Start » Shop » Cart": "navigation", "one ### two ### three": "symbols", "A line with 5 % in it and more words.": None, "BUY NOW WHILE STOCKS LAST.": "shouting", "WOW!!! so much!!!": "shouting",
    "GO ON.": None, "All Rights Reserved by the people who wrote this.": "boilerplate", "See https://example.org/a?b for it.": "link", "We put the whole report at https://example.org for everyone to read.": None, "12 / 34 - 56": "no_letters",
    "And so it goes on...": "teaser", "And so it goes on … ": "teaser", "It went on and on and on, as these things always do...": None, "Contact": "unfinished", "Sign in here": "unfinished", "It is done.": None, "A heading of some four words": None, "«Ja»": "unfinished",
    "É » é » è": "navigation", "ÀÉÈÙÀÉÈÙÀÉÈÙ": "shouting",
}


def test_rules_of_lines(spark):
    d = spark.createDataFrame([(k, x) for k, x in enumerate(LINES)], "doc_id int, text string")
    got = {r.doc_id: r.reasons for r in quality_rules.judge(d).collect()}
    assert {x: got[k] or None for k, x in enumerate(LINES)} == LINES == {x: broken(x) for x in LINES}


def test_cleaned_text_of_random_documents(spark):
    rnd = random.Random(9)
    words = [f"word{k}" for k in range(60)] + ["Über", "»", "|", "!!!", "###", "http://x.y", "ABC", "a.", "...", "42"]
    lines = ["", " ", *LINES, *(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) for _ in range(60))]
    rows = [(k, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 25)))) for k in range(150)]
    found = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(quality(rows))
    assert {i for i, r in found.items() if r.kept} == set(want) and 10 < len(want) < 140
    for i, t in rows:
        left, seen, rules = [], set(), set()
        for x in t.split("\n"):
            if WORD.search(x):
                rule = broken(x) or ("repeated" if x in seen else None)
                rules.add(rule)
                seen |= {x} if broken(x) is None else set()
            else:
                rule = None
            left += [x] if rule is None else []
        assert found[i].clean_text == "\n".join(left) and set(filter(None, found[i].reasons.split(","))) == rules - {None}
        assert found[i].clean_chars == solid("\n".join(left)) and found[i].n_failed_lines == len(t.split("\n")) - len(left)


def test_a_clean_document_is_left_alone(spark):
    text = "A first line that ends as it should.\n\nIt has seven blank lines, \"quotes\" and 3 % of marks; nothing else to see.\n" + " ".join(f"w{k}" for k in range(60)) + "."
    assert [r.text for r in quality_rules.clean(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()] == [text]
