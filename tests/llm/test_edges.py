"""Every operator and every pipeline stage on nulls in any column, empty and very long texts, ties, repeated rows, empty
tables and further columns whose names are those that operators use inside."""

import random
import re
import zlib

import corpus_pipeline
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tracemill.llm import bpe, classifier, exact_dedup, jaccard_join, packing, quality_rules, sharding, substring_dedup, suffix_dedup, token_store
from tracemill.llm.common import shared_dir
from tracemill.llm.queries import tokenizer

CLASHES = (
    "_id keep n_words kept recipe _row row path text_sha256 a s z n k first source_ other copies contents component g token tokens weight sketch "
    "score held_out label _doc part file start left ids n_bytes n_removed kept_text clean_text w lines at h rules word_chars _text _w"
).split()
BASE = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rnd = random.Random(41)
    say = lambda n: " ".join(rnd.choice("the of stone river light paper house under seven quiet".split()) + str(rnd.randrange(90)) for _ in range(n))
    long, a, b = say(40_000), say(130) + ".", say(90) + "."
    out = [(1, a), (1, a), (2, a), (None, a), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, b), (6, b + " more of it here."), (None, say(80)), (7, long), (8, long + " end"), (9, "x" * 300_000), (10, "!" * 50_000), (11, "one")]
    return [(i, t, None if k % 3 else "en", None if k % 4 else "s", None if k % 2 else len(t or "")) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), BASE).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def train(spark, d):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    return classifier.score(d, classifier.train(d, labels, sample=50))


def store(spark, d):
    s = sharding.ShardStore(spark, shared_dir(spark, "edges"))
    for k in range(4):
        s.append(d.filter(F.pmod(F.xxhash64("text"), F.lit(4)) == k))
    while s.compact() is not None:
        pass
    return s.read()


WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
OPERATORS = {
    "op1": (store, "doc_id text"),
    "op2": (train, "doc_id held_out predicted"),
    "op3": (lambda s, d: substring_dedup.remove_repeats(d), "doc_id n_words n_removed kept_sha256"),
    "op4": (lambda s, d: quality_rules.judge(d), "doc_id n_words base_failed kept reasons"),
    "op5": (lambda s, d: suffix_dedup.remove_repeats(d), "doc_id n_bytes n_removed n_spans kept_sha256"),
    "op6": (lambda s, d: bpe.round_trip(d, tokenizer(BYTE)), "doc_id n_tokens ids_sha256 decoded_sha256"),
    "op7": (lambda s, d: jaccard_join.components(d), "doc_id n_shingles component_id"),
    "op8": (lambda s, d: packing.pack(d, tokenizer(WORD)).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")), "doc_id doc_tokens n"),
    "op9": (lambda s, d: token_store.read(token_store.write(d, tokenizer(BYTE))), "doc_id n_tokens ids_crc32"),
    "op10": (lambda s, d: exact_dedup.groups(d), "doc_id keep_id group_size kept text_sha256"),
}


def seen(d, names):
    return sorted((tuple(r) for r in d.select(*names.split()).collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, docs, clashing, name):
    run, names = OPERATORS[name]
    plain = seen(run(spark, docs), names)
    if name != "op8":
        assert len(plain) == len(rows())
    assert seen(run(spark, clashing), names) == plain
    assert seen(run(spark, clashing.limit(0)), names) == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    names = "doc_id length doc_tokens ids_crc32" if name == "packing" else "doc_id text"
    plain, full = stage(spark, docs, SMALL), stage(spark, clashing, SMALL)
    if name == "packing":
        total = lambda d: d.agg(F.sum("length")).first()[0]
        assert total(plain) == total(full) > 0
    else:
        assert full.columns == clashing.columns and plain.columns == docs.columns
        found = full.collect()
        assert found and all(r[c] == f"own {c}" for r in found for c in CLASHES)
        assert seen(full, names) == seen(plain, names)
    empty = stage(spark, clashing.limit(0), SMALL)
    assert empty.columns == full.columns and empty.count() == 0


def test_kept_columns_of_any_name(spark, clashing):
    keep = ("doc_id", "recipe", "keep", "group_size_", "_row")
    d = clashing.withColumn("group_size_", F.lit(1))
    assert exact_dedup.groups(d, keep).columns == [*keep, "keep_id", "group_size", "kept", "text_sha256"]
    found = suffix_dedup.remove_repeats(d, keep=("n_bytes", "a", "keep"))
    assert found.columns == [*suffix_dedup.RESULT, "a", "keep"] and {r.a for r in found.collect()} == {"own a"}
    packed = suffix_dedup.remove_repeats(d, keep=("n_bytes", "a"), packed=True).select("keep.n_bytes").distinct().collect()
    assert [r.n_bytes for r in packed] == ["own n_bytes"]


def test_arrivals_of_different_columns(spark, docs):
    s = sharding.ShardStore(spark, shared_dir(spark, "drift"))
    s.append(docs.select("doc_id", "text"))
    s.append(docs.select("doc_id", "text").withColumn("_target", F.lit(7)))
    s.append(docs.select(F.lit("x").alias("_from"), "text", "doc_id"))
    s.append(docs.select("text"))
    assert s.read().columns == ["doc_id", "text", "_target", "_from"] and s.read(1).columns == ["doc_id", "text"]
    before = sorted(map(str, s.read().collect()))
    assert s.compact() == 5 and sorted(map(str, s.read().collect())) == before and len(before) == 4 * len(rows())
    assert s.read().filter("_target = 7").count() == s.read().filter("_from = 'x'").count() == len(rows())


def test_files_that_are_being_written_stay(spark, docs):
    s = sharding.ShardStore(spark, shared_dir(spark, "expire"))
    s.append(docs)
    path = s._writing("unfinished")
    docs.coalesce(1).write.parquet(path)
    assert s.expire() == 0 and spark.read.parquet(path).count() == len(rows())
    assert s.expire(hours=0) == 1


def test_a_line_of_many_millions_of_marks(spark):
    d = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("!"), 22_000_000).alias("text"))
    r = quality_rules.judge(d).first()
    assert (r.n_words, r.word_chars, r.base_failed, r.reasons) == (1, 22_000_000, True, "shouting")


def test_no_shared_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster, "x")


def test_long_runs_of_white_space(spark):
    """Runs of a megabyte inside a line, at its end, and of all six characters: judged in the time of a text, not of its square."""
    import time

    n = 1_000_000
    texts = ["word" + " " * n + "b", "word word word word." + "\t" * n, " \t\x0b\x0c\r" * (n // 5), "word" + " \u2028" * 1000 + "\x85", "A line that ends well. \u2028", "Read on" + " " * n + "..." + " " * n]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    quality_rules.judge(d.limit(1)).collect()
    began = time.time()
    found = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert time.time() - began < 10
    assert [found[k].n_words for k in range(6)] == [len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]) for t in texts]
    assert found[0].reasons == "unfinished" and found[1].reasons == "" and found[2].word_chars == 0 and found[5].reasons == "teaser"


def test_furniture_of_four_languages(spark):
    lines = ["Bitte lesen Sie die Datenschutzerklärung genau durch.", "Tous droits réservés par les auteurs de ce site.", "Lea la Política de Privacidad antes de entrar aquí.", "Please read the Privacy Policy before you go on."]
    found = quality_rules.judge(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.reasons for r in found} == {"boilerplate"}


def test_many_documents_of_one_id_are_fitted_within_the_sample(spark):
    d = spark.range(600).select(F.lit(1).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).repartition(3)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert zlib.crc32(b"1") % 4 != 2  # the id is not held out
    seen = classifier.vectors(d, ["doc_id"]).count()
    weights = classifier.train(d, labels, sample=20)
    assert seen == 600 and 0 < (weights != 0).sum() <= 20 * 8
    assert (classifier.train(d.repartition(5), labels, sample=20) == weights).all()


def test_files_of_a_target_size(spark, docs, monkeypatch):
    monkeypatch.setattr(token_store, "TARGET", 50_000)
    manifest = token_store.write(docs, tokenizer(BYTE))
    assert manifest.count() > 4
    plain = seen(token_store.read(token_store.write(docs, tokenizer(BYTE))), "doc_id start n_tokens ids_crc32")
    monkeypatch.undo()
    assert plain == seen(token_store.read(token_store.write(docs, tokenizer(BYTE))), "doc_id start n_tokens ids_crc32")
