"""Text helpers: Unicode-aware strip, literal counting and word tests."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything Unicode calls white space; Spark's plain trim removes the space character only.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# The same set as a regular expression class, and its complement. A bare "space" class is ASCII
# in Java; here ASCII text, nearly all there is, is decided by the first range.
SPACE = r"[\x00-\x20\x7f-\x{10ffff}&&[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_OTHER_TEXT = r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\xa1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}]"


def text_class(exclude: str = "") -> str:
    """A class of every character that is neither white space nor one of ``exclude``."""
    ranges, low = "", 0x21
    for code in [*sorted(map(ord, exclude)), 0x7F]:
        if code > low:
            ranges += rf"\x{low:02x}-\x{code - 1:02x}"
        low = code + 1
    return f"[{ranges}{_OTHER_TEXT}]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def non_blank(text: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def occurrences(text: Column, char: str) -> Column:
    """How often one character occurs in the text."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def has_any(text: Column, *words: str) -> Column:
    """True where the text contains any of the words."""
    return reduce(or_, [text.contains(w) for w in words])


def after(text: Column, marker: str) -> Column:
    """The text from the first occurrence of the marker on; the whole text if there is none."""
    return F.substr(text, F.greatest(F.instr(text, marker), F.lit(1)))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]
