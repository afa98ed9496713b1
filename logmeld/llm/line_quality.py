"""Quality rules, lines first: failing lines are removed, then documents that lose too much text are rejected.

A line with no word is kept and counts for nothing. A line fails as

* navigation: two or more separators (``NAVIGATION``) in it;
* symbols: more than one of ``SYMBOLS`` for every three words;
* shouting: five words or more, letters all upper case;
* boilerplate: it contains one of ``PHRASES``, or curly brackets;
* punctuation: five words or more and no end mark (``END_MARKS``, perhaps in quotes or brackets) at its end.

Base counts of the whole text come before the lines: words, their code points, symbol characters, repeated lines, and
words inside 5-word windows found twice or more.

Defined cases: null text is empty: no words, rejected. Ties cannot arise; repeated rows are judged alike, each on its own.
Extra columns pass through; columns named like the new ones are replaced by them. Every row is judged in its own scan
task: no shuffle, whatever is hot.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from logmeld.llm.common import WHITE, fresh

SYMBOLS = "#*$%&|<>"
NAVIGATION = ("|", "»", "›", "•", "·")
END_MARKS = ".!?:;…。！？"
PHRASES = (
    "lorem ipsum", "javascript", "cookie", "terms of use", "privacy policy", "all rights reserved", "sign in", "click here",
)
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


_END = rf"[{END_MARKS}][\"'”’»)\]]*$"
_SEPARATOR = "[" + "".join(NAVIGATION) + "]"
_SYMBOL = r"[#*$%&|<>]"
_PHRASE = "(?i)[{}]|" + "|".join(PHRASES)
_FIVE_WORDS = r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){4}[^\x20\x09-\x0D]"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(x)) for x in words])


def line_fails(line: Column, separators: Column, symbols: Column, phrases: Column) -> Column:
    """True where a line with at least one word breaks a rule; the flags say which rules the text can break."""
    n = F.size(F.array_remove(F.split(line, WHITE), ""))
    tail = F.substring(F.rtrim(line, F.lit("\t\n\u000b\f\r ")), -8, 8)
    return (
        (~F.rlike(tail, F.lit(_END)) & F.rlike(line, F.lit(_FIVE_WORDS)))
        | (~F.rlike(line, F.lit(r"\p{Ll}")) & F.rlike(line, F.lit(r"\p{Lu}")) & F.rlike(line, F.lit(_FIVE_WORDS)))
        | (separators & F.rlike(line, F.lit(f"{_SEPARATOR}.*{_SEPARATOR}")))
        | (symbols & (3 * F.regexp_count(line, F.lit(_SYMBOL)) > n))
        | (phrases & F.rlike(line, F.lit(_PHRASE)))
    )


def _repeated_words(order: Column) -> Column:
    """Words covered by windows that occur twice or more; ``order`` holds (hash of the window, start), sorted."""
    near = lambda x, j: F.coalesce(x["g"] == F.get(order, j)["g"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(order, lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, at: F.struct(
            (s["n"] + at + WINDOW - F.greatest(at, s["end"])).alias("n"), (at + WINDOW).alias("end")))
    return covered["n"]


def quality(df: DataFrame, text: str = "text", clean: str = "clean_text", keep_share: float = 0.5) -> DataFrame:
    """``df`` with the counts of COUNTS, base_failed, kept and the text without its failing lines.

    Kept: the base did not fail, and the lines left hold at least ``keep_share`` of the word characters. Windows are
    compared by 64-bit hashes within their text, and looked up one by one only in texts where hashes repeat.
    """
    new = [*COUNTS, "base_failed", "kept", clean]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new or c == text])
    given = [c for c in df.columns if c.lower() not in new]
    t, words, pieces, grams, order, lines, good, low, symbols, flags = fresh(
        df, "t", "words", "pieces", "grams", "order", "lines", "good", "low", "symbols", "flags")
    w = F.col(words)
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    has_word = lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn(pieces, F.split(t, WHITE[:-1])).withColumn(lines, F.split(t, "\n")).withColumn(low, F.lower(t))
    df = df.withColumn(words, F.array_remove(pieces, "")).withColumn(symbols, F.regexp_count(t, F.lit(_SYMBOL)))
    df = df.withColumn(flags, F.struct(
        _any(F.col(t), NAVIGATION).alias("separators"), (F.col(symbols) > 0).alias("symbols"),
        (_any(F.col(low), PHRASES) | _any(F.col(t), ("{", "}"))).alias("phrases")))
    df = df.withColumn(grams, F.when(F.size(w) > WINDOW, F.transform(
        starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))))
    df = df.withColumn(order, F.when(
        F.size(F.array_distinct(grams)) < F.size(grams),
        F.sort_array(F.transform(F.col(grams), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    flag = F.col(flags)
    df = df.withColumn(good, F.filter(
        lines, lambda line: ~line_fails(line, flag["separators"], flag["symbols"], flag["phrases"]) | ~has_word(line)))
    worded = F.filter(lines, has_word)
    solid = F.col(t)
    for white in " \n\t\u000b\f\r":
        solid = F.replace(solid, F.lit(white), F.lit(""))
    n = F.size(w).cast("long")
    df = df.select(
        *[F.col(f"`{c}`") for c in given], t,
        n.alias("n_words"),
        (F.length(t) - F.size(pieces) + 1).cast("long").alias("word_chars"),  # a piece more than there is white space
        F.col(symbols).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeated_words(F.col(order)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.size(good) == F.size(lines), F.col(t)).otherwise(F.array_join(good, "\n")).alias(clean),
    )
    left = F.when(F.col(clean) == F.col(t), F.col("word_chars")).otherwise(F.length(F.regexp_replace(clean, WHITE, "")))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (left >= keep_share * F.col("word_chars")))
    return df.select(*[F.col(f"`{c}`") for c in given], *COUNTS, "base_failed", "kept", clean)
