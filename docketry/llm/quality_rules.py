"""Line-first quality rules: clean lines, then judge the document by what it lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import SPACES, let, stripped, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_LOST = 0.5

# --- fixed values of the line rules ------------------------------------------------------------------
LINE_SYMBOLS = "#*$%&|<>{}[]\\^~=+_@"
MAX_SYMBOL_SHARE = 0.1
MAX_SHOUT_SHARE = 0.25
SHORT_WORDS = 4
NOTICE_WORDS = 30
LINE_END = "[.!?:;…。！？\"'”’»)\\]]$"
NAVIGATION = (
    "(?i)^(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|read more|share|contact|about us|"
    "skip to content|site map|sitemap|archive|categories|tags)\\b")
BOILERPLATE = (
    "(?i)(all rights reserved|licensed under|copyright|©|privacy policy|terms of (use|service)|cookies?\\b|javascript|"
    "newsletter|powered by|subscribe now|click here)")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def line_fails(line: Column) -> Column:
    """Whether a line, stripped and not blank, fails a punctuation, navigation or boilerplate rule."""
    chars = _without(line, SPACES)
    n_words = F.length(line) - chars + 1
    symbols = F.length(line) - _without(line, LINE_SYMBOLS)
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    return (
        (symbols > chars * MAX_SYMBOL_SHARE) | (shouts > n_words * MAX_SHOUT_SHARE)
        | ((n_words <= SHORT_WORDS) & (~line.rlike(LINE_END) | line.rlike(NAVIGATION)))
        | ((n_words <= NOTICE_WORDS) & line.rlike(BOILERPLATE)))


def repeated_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more, first occurrences included.

    Window hashes are sorted with their positions, so equal neighbours show repeats; the words covered are then summed
    over the sorted positions.  Time grows as n log n with the length of the text.
    """
    n = F.size(w) - 2
    hashed = F.transform(F.slice(w, 1, F.greatest(n, F.lit(0))), lambda x, i: F.struct(
        F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def positions(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(n < 2, 0).otherwise(let(let(F.sort_array(hashed), positions), covered))


def judge(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_lost: float = MAX_LOST) -> DataFrame:
    """Word and line counts, the text without failing lines, and the verdict.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``cleaned``, ``lost``
    (share of the word characters in failing lines) and ``kept``.  Everything is computed inside a row, without a shuffle.

    Edge cases: null and empty texts have no words, fail the base rule and are cleaned to null and ''; an empty table gives
    an empty result; other columns pass through, and ones with the names above are replaced.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "lost", "kept")
    names = [c for c in docs.columns if c not in new]
    own = F.col(f"row.{text}")
    filled = F.coalesce(own, F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    lines = F.split(filled, "\n", -1)
    good = F.filter(lines, lambda x: let(stripped(x), lambda s: (s == "") | ~line_fails(s)))
    parts = let(lines, lambda a: F.struct(
        let(F.filter(a, lambda x: stripped(x) != ""), lambda b: F.size(b) - F.size(F.array_distinct(b))).alias("dup")))
    out = rows.select(
        "row", F.array_join(good, "\n").alias("cleaned"), parts["dup"].alias("dup"),
        let(words(own), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeat"))).alias("w"))
    chars = _without(filled, SPACES)
    out = out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names],
        F.col("w.n").cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        (F.length(filled) - _without(filled, SYMBOLS)).cast("long").alias("n_symbols"),
        F.col("dup").cast("long").alias("n_dup_lines"), F.col("w.repeat").cast("long").alias("n_repeat_words"),
        F.when(own.isNotNull(), F.col("cleaned")).alias("cleaned"),
        F.when(chars > 0, 1 - _without(F.col("cleaned"), SPACES) / chars).otherwise(0.0).alias("lost"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))


