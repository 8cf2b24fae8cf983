import random

import corpus_pipeline
import pytest
from conftest import SMALL


def text(seed, n=300):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


A, B, C, D, E = (text(k) for k in range(5))
NEAR = B + " " + text(9, 30)
COLUMNS = "doc_id long, text string, lang string, n_chars long"
ROWS = [(3, A), (5, A), (5, B), (7, C), (7, C), (8, D), (None, D), (None, E), (None, NEAR), (9, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", len(t)) for i, t in ROWS], COLUMNS).repartition(4)


def rows(d):
    return sorted(((r.doc_id, r.text) for r in d.collect()), key=str)


def test_one_row_of_equal_texts_stays(spark, docs):
    out = corpus_pipeline.exact(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert rows(out) == sorted([(3, A), (5, B), (7, C), (8, D), (None, E), (None, NEAR), (9, "")], key=str)


def test_one_row_of_near_copies_stays(spark, docs):
    out = corpus_pipeline.near(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert rows(out) == sorted([(3, A), (5, B), (7, C), (8, D), (None, E), (9, "")], key=str)


def test_texts_are_whole_after_the_substring_stage(spark, docs):
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.substrings):
        docs = stage(spark, docs, SMALL)
    assert rows(docs) == sorted([(3, A), (5, B), (7, C), (8, D), (None, E)], key=str)


def test_rows_with_null_ids_alone(spark):
    d = spark.createDataFrame([(None, t, "en", len(t)) for t in (A, A, B, NEAR)], COLUMNS)
    assert rows(corpus_pipeline.exact(spark, d, SMALL)) == sorted([(None, A), (None, B), (None, NEAR)], key=str)
    assert rows(corpus_pipeline.near(spark, d, SMALL)) == sorted([(None, A), (None, B)], key=str)


def test_other_columns_and_empty_tables(spark, docs):
    none = docs.filter("doc_id > 100")
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.substrings):
        assert stage(spark, none, SMALL).count() == 0
    assert {r.lang for r in corpus_pipeline.near(spark, docs, SMALL).collect()} == {"en"}


def test_packing_remembers_little():
    from tracemill.llm.pieces import LibraryTokens
    from tracemill.llm.queries import tokenizer

    few, many = (LibraryTokens(tokenizer("word_bpe_49k.json"), True, *n) for n in ((50, 40), ()))
    text = " ".join(f"word{k} Other-{k % 7}" for k in range(500))
    assert few.encode(text) == many.encode(text) and max(len(few.memory), len(few.memory.old)) <= 50 and max(len(few.parts), len(few.parts.old)) <= 40


def test_words_are_remembered_once():
    """A word's tokens are those of a piece; they are not kept again as those of a part."""
    from tokenizers import Tokenizer

    from tracemill.llm.pieces import LibraryTokens
    from tracemill.llm.queries import tokenizer

    path, text = tokenizer("byte_bpe_50k.json"), "one word, other word!! and\nline, " + "long" * 40 + ", word"
    tokens = LibraryTokens(path, False, 50, 40)
    assert list(memoryview(tokens.encode(text)).cast("H")) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert "word" in tokens.memory and " word" not in tokens.parts
