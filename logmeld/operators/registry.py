"""A caller's own parsers, beside the six that are built in.

A parser is two column expressions over a stripped line: its confidence and its fields. They are woven into the same plan as the built-in ones: after these, in
the order given, a parser takes a line if its confidence is higher than the best so far, and none is asked where that is 0.99 or more. So ties go to the earlier.

Defined cases: a null confidence is none. A line whose parser gives no fields fails, with ``error``'s text where that is not null. The expressions run on every
line, so they must not raise: use the ``try_`` functions.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmeld import vocab

CERTAIN = 0.99
Expression = Callable[[Column], Column]


@dataclass(frozen=True)
class Parser:
    """``confidence``: 0 to 1. ``fields``: map<string,string>, names in lower case. The others are optional: text, or an expression over the line."""

    name: str
    format: str
    confidence: Expression
    fields: Expression
    vendor: str | Expression | None = None
    device_type: str | Expression | None = None
    error: Expression | None = None


def checked(parsers: Sequence[Parser]) -> tuple[Parser, ...]:
    """The parsers, if names and formats are their own."""
    names = [p.name for p in parsers]
    taken = {name for name, *_ in vocab.PARSERS} & set(names) | {n for n in names if names.count(n) > 1}
    formats = set(vocab.FORMATS) & {p.format for p in parsers}
    if taken or formats:
        raise ValueError(f"parser names or formats that are taken: {sorted(taken | formats)}")
    return tuple(parsers)


def detection_steps(parsers: tuple[Parser, ...], line: Column) -> list[dict[str, Column]]:
    """What follows the built-in detection: for each parser its confidence, then what the line is if it takes it."""
    best, steps = F.col("confidence"), []
    for p in parsers:
        steps.append({"_own": F.coalesce(p.confidence(line).cast("double"), F.lit(0.0))})
        takes = (best < CERTAIN) & (F.col("_own") > best)
        forced = F.col("parser") == p.name
        steps.append({
            "format": F.when(takes | forced, p.format).otherwise(F.col("format")),
            "parser": F.when(takes, p.name).otherwise(F.col("parser")),
            "confidence": F.when(takes, F.col("_own")).otherwise(best),
            "shape": F.when(~takes, F.col("shape")),
        })
    return steps


def _value(given: str | Expression | None, line: Column) -> Column:
    return F.lit(given).cast("string") if given is None or isinstance(given, str) else given(line)


def extraction_steps(parsers: tuple[Parser, ...]) -> list[dict[str, Column]]:
    """What follows the built-in extraction: the columns of the lines that a caller's parser took."""
    line, steps = F.col("line"), []
    for p in parsers:
        mine = F.col("parser") == p.name
        steps.append({
            "fields": F.when(mine, p.fields(line)).otherwise(F.col("fields")),
            "vendor": F.when(mine, _value(p.vendor, line)).otherwise(F.col("vendor")),
            "device_type": F.when(mine, _value(p.device_type, line)).otherwise(F.col("device_type")),
        })
        missing = F.when(F.col("fields").isNull(), "ValueError: no fields")
        error = missing if p.error is None else F.coalesce(p.error(line), missing)
        steps.append({
            "error": F.when(mine, error).otherwise(F.col("error")),
            "fields": F.when(~mine | error.isNull(), F.col("fields")),
        })
    return steps
