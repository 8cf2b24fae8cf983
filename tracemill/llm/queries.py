"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, bpe, classifier, exact_dedup, jaccard_join, lexical_search, packing, quality_rules, sharding, substring_dedup, suffix_dedup, token_store, whitening
from .common import shared_dir, table, text_or_empty


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file, in the place where each machine has the package installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four batches of falling size, are sharded and compacted, and are read through the manifest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, shared_dir(spark, "shards"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    for lo, hi in ((0, 8), (8, 12), (12, 14), (14, 16)):
        store.append(docs.filter((part >= lo) & (part < hi)))
    while store.compact() is not None:
        pass
    text = text_or_empty()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("clean_text")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(token_store.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_QUERIES = (
    op1_sharding, op2_quality_classifier, op3_substring_dedup, op4_quality_rules, op5_suffix_dedup, op6_bpe, op7_jaccard_join, op8_packing, op9_token_store, op10_exact_dedup,
    op11_lexical_search, op12_best_fit_packing, op13_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SOLID = "length(regexp_replace({t}, '[\\x20\\x09-\\x0D]', '', 'g'))"

OP1 = """
SELECT doc_id, lang, source, n_chars, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP3 = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 19) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
bad AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN bad USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _judge_sql() -> str:
    q = quality_rules
    count = lambda t, c: f"len(regexp_extract_all({t}, '{c}'))"
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    any_of = lambda xs: "(" + " OR ".join(f"contains(lower(l), {quoted([x])})" for x in xs) + ")"
    n, n_words, trimmed = _SOLID.format(t="l"), f"len({_WORDS.format(t='l')})", r"regexp_replace(l, '[\x20\x09-\x0D]+$', '')"
    tests = (
        f"{count('l', '[|]')} >= {q.MIN_BARS} OR {count('l', '[' + q.MENU_MARKS + ']')} >= {q.MIN_BARS}",
        f"100 * {count('l', '[' + q.SYMBOLS + ']')} > {q.MAX_MARKS} * {n}",
        f"100 * {count('l', '!')} > {q.MAX_MARKS} * {n} OR (NOT regexp_matches(l, '[a-zß-öø-ÿ]') AND {count('l', '[A-ZÀ-ÖØ-Þ]')} >= {q.MIN_CAPITALS})",
        any_of(q.BOILERPLATE), f"{any_of(q.LINKS)} AND {n_words} < {q.MIN_SENTENCE}", r"NOT regexp_matches(l, '\pL')",
        f"(ends_with({trimmed}, '...') OR ends_with({trimmed}, '…')) AND {n_words} < {q.MIN_SENTENCE}", f"{n_words} < {q.MIN_PHRASE} AND right({trimmed}, 1) NOT IN ({quoted(q.SENTENCE_END)})",
    )
    rule = f"CASE WHEN {n} = 0 THEN NULL " + " ".join(f"WHEN {t} THEN '{name}'" for name, t in zip(q.RULES, tests, strict=True)) + " END"
    base = f"n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format(t="t")} AS ws, string_split(t, chr(10)) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, i, l, {n} AS solid, {rule} AS rule FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM w)),
seen AS (SELECT *, rule IS NULL AND (solid = 0 OR row_number() OVER (PARTITION BY doc_id, l, rule IS NULL ORDER BY i) = 1) AS stays FROM line),
c AS (SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (stays), '') AS clean_text, count(*) FILTER (NOT stays) AS n_failed_lines,
    count(*) FILTER (solid > 0) - count(DISTINCT l) FILTER (solid > 0) AS n_dup_lines,
    array_to_string(list_concat(list_sort(list_distinct(coalesce(list(rule) FILTER (rule IS NOT NULL), []))), CASE WHEN count(*) FILTER (NOT stays AND rule IS NULL) > 0 THEN ['repeated'] ELSE [] END), ',') AS reasons
  FROM seen GROUP BY doc_id),
f AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST({_SOLID.format(t='t')} AS BIGINT) AS word_chars, CAST({count('t', '[' + q.SYMBOLS + ']')} AS BIGINT) AS n_symbols,
    n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, n_failed_lines, reasons, clean_text
  FROM w JOIN c USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
  (NOT ({base}) AND 100 * {_SOLID.format(t='clean_text')} >= {q.MIN_KEPT} * word_chars) AS kept, n_failed_lines, reasons, CAST({_SOLID.format(t='clean_text')} AS BIGINT) AS clean_chars
FROM f
"""


OP4 = _judge_sql()

OP10 = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH d AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_TERMS} AS ws FROM documents) WHERE len(ws) > 0),
g AS (SELECT count(*) AS nd, sum(n) AS nt FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
m AS (SELECT doc_id, 100 - 90 + CAST((90 * n * nd) // nt AS BIGINT) AS m FROM d, g),
s AS (SELECT item_id, doc_id, CAST(sum(w * (CAST(1000000000 * tf AS BIGINT) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": OP11, "op1_sharding": OP1, "op3_substring_dedup": OP3, "op4_quality_rules": OP4, "op10_exact_dedup": OP10}
