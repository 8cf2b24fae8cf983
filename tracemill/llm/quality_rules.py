"""Line-first quality rules, in DataFrame functions only.

Every line of a document with a word in it is judged on its own, by the first of these rules that it breaks:

* navigation: MIN_BARS or more bars, or as many of the other menu marks;
* symbols: more than MAX_MARKS percent of its solid characters are symbols (the set of the base figures);
* shouting: more than MAX_MARKS percent are exclamation marks, or MIN_CAPITALS capitals and no small letter;
* boilerplate: one of the phrases of page furniture, in any case of letters;
* link: an address in a line of fewer than MIN_SENTENCE words;
* no_letters: no letter at all (numbers, rules, prices alone);
* teaser: fewer than MIN_SENTENCE words that end in three dots or more;
* unfinished: fewer than MIN_PHRASE words without a mark that ends a sentence (headings of menus, buttons, bullets);
* repeated: equal to an earlier line of the document that has passed the other rules.

Failing lines are removed, and a document is rejected when less than MIN_KEPT percent of its solid characters are left.
Document-level base checks (too short, too many words in repeated 3-word windows) reject as well. Everything is a
projection of one row: no shuffle at any size, no hot key. Each line is measured once, and the rules read the measures.

Edge cases: an empty table gives no rows; null and empty texts have no words and fail the base check; lines without a
word pass and weigh nothing; a text of any length is one row, all counts are 64-bit; rows with null ids and repeated rows
are judged as they come; `clean` returns all columns of the input whatever their names, `judge` those of `keep` that are
not names of result columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, struct_of, text_or_empty, words

#: Phrases of page furniture by language; fixed values.
FURNITURE = {
    "en": ("accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "forgot your password", "log in to", "lorem ipsum",
           "privacy policy", "read more", "share on", "sign up for", "skip to content", "subscribe to our", "terms of service", "terms of use", "view all comments"),
    "de": ("alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "jetzt anmelden", "nach oben scrollen", "passwort vergessen", "zum inhalt springen"),
    "fr": ("aller au contenu", "conditions d'utilisation", "cliquez ici", "mot de passe oublié", "politique de confidentialité", "retour en haut", "tous droits réservés", "accepter les cookies"),
    "es": ("aceptar cookies", "haga clic aquí", "política de privacidad", "olvidó su contraseña", "saltar al contenido", "términos de uso", "todos los derechos reservados", "volver arriba"),
}
BOILERPLATE = tuple(p for phrases in FURNITURE.values() for p in phrases)
SYMBOLS = "#*$%&|<>"
#: Marks between the entries of menus, marks that end a sentence, beginnings of addresses; fixed values.
MENU_MARKS, SENTENCE_END, LINKS = "»›•·→", ".!?;:…\"'”’)]", ("http://", "https://", "www.")
MIN_WORDS = 50
#: Percent of words in repeated 3-word windows above which a document fails.
MAX_REPEATED = 50
#: Least percent of the solid characters that must remain after the failing lines went.
MIN_KEPT = 50
MIN_BARS, MAX_MARKS, MIN_CAPITALS = 2, 10, 12
MIN_SENTENCE, MIN_PHRASE = 8, 4
RULES = ("navigation", "symbols", "shouting", "boilerplate", "link", "no_letters", "teaser", "unfinished")
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "reasons", "clean_chars", "clean_text")


def _count(text: Column, chars: str) -> Column:
    """Characters of a set; what is built on the way is no longer than the text."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def measured(line: Column) -> Column:
    """What the rules need of a line, each measure taken once: its words and its marks, first as they are."""
    return F.struct(line.alias("line"), words(line).alias("w"), F.regexp_replace(line, f"[^{SYMBOLS}{MENU_MARKS}!]+", "").alias("marks"))


def counted(m: Column) -> Column:
    trimmed = F.rtrim(m["line"], F.lit(WS_CHARS))  # a pattern would start anew at each space of a long run
    return F.struct(
        m["line"].alias("line"), m["w"].alias("w"), F.char_length(F.array_join(m["w"], "")).cast("long").alias("n"), F.size(m["w"]).alias("words"), F.lower(m["line"]).alias("low"),
        _count(m["marks"], SYMBOLS).alias("symbols"), _count(m["marks"], r"\|").alias("bars"), _count(m["marks"], MENU_MARKS).alias("menu"), _count(m["marks"], "!").alias("calls"),
        F.substring(trimmed, -1, 1).alias("end"), (trimmed.endswith("...") | trimmed.endswith("…")).alias("dots"),
    )


def broken_rule(m: Column) -> Column:
    """Name of the first rule that a measured line breaks, or null. Lines without a word break none."""
    phrase, link = F.lit(False), F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | m["low"].contains(p)
    for p in LINKS:
        link = link | m["low"].contains(p)
    tests = (
        (m["bars"] >= MIN_BARS) | (m["menu"] >= MIN_BARS),
        100 * m["symbols"] > MAX_MARKS * m["n"],
        (100 * m["calls"] > MAX_MARKS * m["n"]) | (~m["line"].rlike("[a-zß-öø-ÿ]") & m["line"].rlike(f"(?:[A-ZÀ-ÖØ-Þ][^A-ZÀ-ÖØ-Þ]*){{{MIN_CAPITALS}}}")),
        phrase,
        link & (m["words"] < MIN_SENTENCE),
        ~m["line"].rlike(r"\p{L}"),
        m["dots"] & (m["words"] < MIN_SENTENCE),
        (m["words"] < MIN_PHRASE) & ~m["end"].isin(*SENTENCE_END),
    )
    out = F.when(m["n"] == 0, F.lit(None).cast("string"))
    for name, test in zip(RULES, tests, strict=True):
        out = out.when(test, F.lit(name))
    return out


def repeated_window_words(trigrams: str) -> Column:
    """Words covered by 3-word windows that occur twice or more; `trigrams` names an array column of their hashes, sorted with positions."""
    hits = F.filter(
        F.col(trigrams),
        lambda x, i: ((F.get(F.col(trigrams), i - 1)["h"] == x["h"]) & (i > 0)) | F.coalesce(F.get(F.col(trigrams), i + 1)["h"] == x["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(hits, lambda x: x["i"]))


def _judged(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns of RESULT, and `keep` in a struct of this name."""
    d = docs.select(struct_of(keep, "keep") if keep else F.lit(None).alias("keep"), F.transform(F.split(text_or_empty(), "\n"), measured).alias("lines"))
    d = d.select("keep", F.transform("lines", counted).alias("lines"))
    total = lambda field: F.aggregate("lines", F.lit(0).cast("long"), lambda a, m: a + m[field])
    d = d.select(
        "keep", total("n").alias("word_chars"), total("symbols").alias("n_symbols"), F.transform(F.flatten(F.transform("lines", lambda m: m["w"])), lambda x: F.xxhash64(x)).alias("w"),
        F.transform("lines", lambda m: F.struct(m["line"].alias("line"), m["n"].alias("n"), (m["n"] > 0).alias("full"), broken_rule(m).alias("rule"))).alias("lines"),
    )
    d = d.select(
        "keep", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "lines",
        F.when(F.size("w") < 4, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("h"),
        F.transform(F.filter("lines", lambda m: m["full"]), lambda m: m["line"]).alias("whole"),
        F.filter("lines", lambda m: m["rule"].isNull()).alias("good"),
    )
    # of equal lines with words the first stays; lines without a word stay wherever they are, told apart by their place
    d = d.select(
        "keep", "n_words", "word_chars", "n_symbols",
        (F.size("whole") - F.size(F.array_distinct("whole"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.array().cast("array<struct<h:bigint,i:int>>"))
        .otherwise(F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("grams"),
        F.array_distinct(F.transform("good", lambda m, i: F.when(m["full"], m["line"]).otherwise(F.concat(m["line"], F.lit("\n"), i.cast("string"))))).alias("left"),
        F.aggregate("good", F.lit(0).cast("long"), lambda a, m: a + m["n"]).alias("good_chars"),
        F.size("lines").alias("n_lines"), F.size("good").alias("n_good"),
        F.array_sort(F.array_distinct(F.transform(F.filter("lines", lambda m: m["rule"].isNotNull()), lambda m: m["rule"]))).alias("rules"),
    )
    d = d.select(*(c for c in d.columns if c not in ("grams", "left")), F.size("left").alias("n_left"), F.array_join(F.transform("left", lambda x: F.substring_index(x, "\n", 1)), "\n").alias("clean_text"), repeated_window_words("grams").alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    repeats = F.when(F.col("n_left") < F.col("n_good"), F.array(F.lit("repeated"))).otherwise(F.array().cast("array<string>"))
    d = d.select(
        "keep", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), (F.col("n_lines") - F.col("n_left")).cast("long").alias("n_failed_lines"),
        F.array_join(F.concat("rules", repeats), ",").alias("reasons"),
        F.when(F.col("n_left") == F.col("n_good"), F.col("good_chars")).otherwise(F.char_length(F.regexp_replace("clean_text", WS, "")).cast("long")).alias("clean_chars"), "clean_text",
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    d = d.withColumn("base_failed", base)
    return d.withColumn("kept", ~F.col("base_failed") & (100 * F.col("clean_chars") >= MIN_KEPT * F.col("word_chars"))).select("keep", *RESULT)


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: base figures, base_failed, kept, the rules that its lines broke, what line cleaning leaves."""
    return _judged(docs, keep).select(*(F.col(f"keep.`{c}`") for c in keep if c not in RESULT), *RESULT)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines, in the columns of the input (n_chars follows the text)."""
    # a filter on `kept` alone would be pushed through the projections and judge every text several times over
    judged = _judged(docs, tuple(c for c in docs.columns if c != "text")).withColumn("_row", F.monotonically_increasing_id()).filter("kept and _row >= 0")
    new = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return judged.select(*(new[c].alias(c) if c in new else F.col(f"keep.`{c}`") for c in docs.columns))
