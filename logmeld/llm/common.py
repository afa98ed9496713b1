"""Column expressions and table helpers that the operators of this folder share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from logmeld.session import written

#: White space that separates words: space, tab, LF, VT, FF, CR.
WHITE = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is. Texts without other letters take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def white_words(text: Column) -> Column:
    """The runs of characters between white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores added until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def blocks_for(total_bytes: int, block_bytes: int) -> int:
    """How many passes keep what one pass broadcasts within block_bytes."""
    return max(1, math.ceil((total_bytes or 0) / block_bytes))


__all__ = ["LOWER", "UPPER", "WHITE", "blocks_for", "fresh", "lower_ascii", "white_words", "written"]
