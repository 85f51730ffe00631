"""Line-first cleaning with built-in functions only.

Every line with a word is tested by rules for punctuation, navigation and boilerplate; failing lines go, and a
document that loses too much of its text goes with them. Word statistics of the whole text are kept beside that.

Defined results: a null text has no words or lines (all counts 0, base failed); repeated rows are rated each; an
empty table gives no rows; columns of the input are kept apart from those computed here by their prefix ``_q_``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsieve.llm.common import written

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = "[|»›•·]"
#: Marks with which a sentence or a quotation may end, in Latin, Devanagari, Arabic, Armenian, Ethiopic, Khmer,
#: Burmese, Tibetan and East Asian text (fixed values), and the pattern of a line that ends in one.
MARKS = """.!?…:;"”’')»]।॥؟۔؛։።៕။།。．！？｡」』）】》〉］"""
FINAL = "[" + MARKS.replace("]", "\\]") + """][\\x20\\x09-\\x0D]*\\z"""
SHOUTS = "!!"
#: Phrases of page furniture, in lower case.
BOILERPLATE = ("all rights reserved", "click here", "cookie policy", "enable javascript", "follow us on",
               "lorem ipsum", "privacy policy", "read more", "share this", "sign up for", "skip to content",
               "subscribe to", "terms of service", "terms of use", "this site uses cookies", "use of cookies")

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line needs a final mark from so many words on, and fails above these shares of its words.
SENTENCE_WORDS = 3
MAX_SYMBOL_PERCENT = 30
MAX_SHOUT_PERCENT = 30
MIN_SEPARATORS = 3
SEPARATOR_PERCENT = 20
#: Percent of the words' characters that may be lost.
MAX_LOST_PERCENT = 50


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _share(n: Column, percent: int, of: Column) -> Column:
    return n * 100 > of * percent


def findings(text: Column) -> Column:
    """What the rules look for and a whole text has at all; most texts have none, and their lines skip those tests."""
    return F.struct(
        text.rlike(SEPARATORS).alias("separators"), text.rlike(SYMBOLS).alias("symbols"), text.contains(SHOUTS).alias("shouts"),
        F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [t.contains(p) for p in BOILERPLATE])).alias("furniture"))


def line_fails(line: Column, has: Column | None = None) -> Column:
    """Which rule a line with a word fails: punctuation, navigation, boilerplate; null if none.

    ``has``: the findings of the whole text, if they are known. The cheap test of the last mark goes first, words are
    counted only where a rule depends on their number.
    """
    there = lambda name: F.lit(True) if has is None else has[name]
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    count = lambda name, pattern: F.when(there(name), F.regexp_count(line, F.lit(pattern))).otherwise(F.lit(0))
    separators = count("separators", SEPARATORS)
    navigation = (separators >= MIN_SEPARATORS) & (separators * 100 >= n * SEPARATOR_PERCENT)
    last = F.substring(F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    share = lambda name, pattern, percent: there(name) & _share(F.regexp_count(line, F.lit(pattern)), percent, n)
    punctuation = (((F.instr(F.lit(MARKS), last) == 0) & (n >= SENTENCE_WORDS))
                   | share("symbols", SYMBOLS, MAX_SYMBOL_PERCENT) | share("shouts", SHOUTS, MAX_SHOUT_PERCENT))
    boilerplate = there("furniture") & F.lower(line).rlike("|".join(BOILERPLATE))
    return F.when(navigation, "navigation").when(punctuation, "punctuation").when(boilerplate, "boilerplate")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def rate(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_q_`` columns: word statistics, failed lines, the text that is left, and the verdicts.

    Words in windows of five found twice: hashes tell the texts without any repeat, which are nearly all; only
    the others compare the windows' words.
    """
    w, n, win = F.col("_q_words"), F.col("_q_n_words"), F.col("_q_windows")
    starts = F.sequence(F.lit(0), n.cast("int") - WINDOW)
    d = (docs.withColumn("_q_text", F.coalesce("text", F.lit("")))
         .withColumns({"_q_words": words(F.col("_q_text")), "_q_has": findings(F.col("_q_text")), "_q_split": F.split("_q_text", "\n"),
                       "_q_n_symbols": F.regexp_count("_q_text", F.lit(SYMBOLS)).cast("long")})
         .withColumns({"_q_n_words": F.size("_q_words").cast("long"),
                       "_q_word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
                       "_q_hashes": F.transform("_q_words", lambda x: F.xxhash64(x)),
                       "_q_lines": F.transform("_q_split", lambda x: F.struct(
                           x.alias("line"), x.rlike(r"[^\x20\x09-\x0D]").alias("has_word")))}))
    h = F.col("_q_hashes")
    d = d.withColumns({
        "_q_windows": F.when(n >= WINDOW, F.transform(starts, lambda i: F.xxhash64(
            *[F.get(h, i + k) for k in range(WINDOW)]))),
        "_q_worded": F.transform(F.filter("_q_lines", lambda x: x["has_word"]), lambda x: x["line"])})
    repeats = F.size(F.array_distinct(win)) < F.size(win)
    d = d.withColumn("_q_keyed", F.when(repeats, F.array_sort(F.transform(starts, lambda i: F.struct(
        F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("key"), i.alias("at"))))))
    keyed = F.col("_q_keyed")
    same = lambda p, k: F.coalesce(F.get(keyed, k)["key"] == p["key"], F.lit(False))
    d = d.withColumn("_q_at", F.array_sort(F.transform(
        F.filter(keyed, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["at"])))
    at = F.col("_q_at")
    covered = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
    d = d.withColumns({
        "_q_n_repeat_words": F.coalesce(_sum(covered), F.lit(0).cast("long")),
        "_q_n_dup_lines": (F.size("_q_worded") - F.size(F.array_distinct("_q_worded"))).cast("long"),
        "_q_rated": F.transform("_q_worded", lambda x: F.struct(
            x.alias("line"), line_fails(x, F.col("_q_has")).alias("rule")))})
    d = d.withColumns({
        "_q_lost_chars": _sum(F.transform(F.filter("_q_rated", lambda x: x["rule"].isNotNull()),
                                          lambda x: F.length(F.regexp_replace(x["line"], BLANK, "")))),
        "_q_base_failed": (n < MIN_WORDS) | _share(F.col("_q_n_repeat_words"), MAX_REPEAT_PERCENT, n),
        "_q_clean": F.array_join(F.transform(F.filter("_q_rated", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")})
    return d.withColumn("_q_kept", ~F.col("_q_base_failed") & ~_share(
        F.col("_q_lost_chars"), MAX_LOST_PERCENT, F.col("_q_word_chars")))


def clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, with the lines that pass; n_chars, where there is one, follows the text.

    The verdicts are written first: a filter pushed through them would repeat their expressions many times over.
    """
    others = [c for c in docs.columns if c != "text"]
    kept = written(rate(docs).select(*others, "_q_clean", "_q_kept"), "rated").filter("_q_kept")
    changed = {"text": F.col("_q_clean")} | ({"n_chars": F.length("_q_clean").cast(docs.schema["n_chars"].dataType)}
                                             if "n_chars" in docs.columns else {})
    return kept.withColumns(changed).select(*docs.columns)


def verdicts(docs: DataFrame) -> DataFrame:
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept"]
    rated = rate(docs.select("doc_id", "text"))
    return rated.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in cols])
