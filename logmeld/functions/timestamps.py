"""Timestamp text to timestamp, always read in UTC.

Each accepted shape is rewritten to ISO text and cast once. No datetime pattern is used: a
pattern mismatch costs an exception per row, a cast does not, and neither the session's time
zone nor its parser policy can change the result.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmeld.functions.text import SPACE, let, strip

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_ZONE = r"(?:Z|z|[+-]\d{2}(?::?\d{2})?)"
_MAX_SECONDS = 253_402_300_799  # end of year 9999


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS, 1) for x in (m, f"{i:02d}")])
    return table[F.lower(name)]


def _epoch(text: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds, told apart by magnitude."""
    n = text.try_cast("decimal(38,9)")
    size = F.abs(n)
    micros = (
        F.when(size < F.lit(10**11), n * 1_000_000)
        .when(size < F.lit(10**14), n * 1_000)
        .when(size < F.lit(10**17), n * 1)
        .otherwise(n / 1_000)
    )
    in_range = F.abs(micros) <= F.lit(_MAX_SECONDS * 1_000_000)
    return F.when(in_range, F.timestamp_micros(F.floor(micros).cast("bigint")))


def _iso(v: Column) -> Column:
    body = F.replace(v, F.lit(","), F.lit("."))
    no_seconds = v.rlike(rf"^.{{11}}\d{{2}}:\d{{2}}{_ZONE}?$")
    full = F.when(
        no_seconds, F.concat(F.substring(body, 1, 16), F.lit(":00"), F.substr(body, F.lit(17), F.length(body)))
    ).otherwise(body)
    zoned = F.when(F.length(v) == 10, F.concat(v, F.lit(" 00:00:00Z"))).when(
        F.substr(v, F.lit(12), F.length(v)).rlike(rf"{_ZONE}$"), full
    ).otherwise(F.concat(full, F.lit("Z")))
    return zoned.try_cast("timestamp")


def _bsd(v: Column, ref_year: Column) -> Column:
    p = F.split(v, " ")
    year = F.coalesce(F.try_element_at(p, F.lit(4)), ref_year.cast("string"))
    text = F.concat(
        year, F.lit("-"), _month(F.get(p, F.lit(0))), F.lit("-"), F.lpad(F.get(p, F.lit(1)), 2, "0"), F.lit(" "), F.get(p, F.lit(2)), F.lit("Z")
    )
    return text.try_cast("timestamp")


def _slashed(v: Column) -> Column:
    return F.concat(F.replace(v, F.lit("/"), F.lit("-")), F.lit("Z")).try_cast("timestamp")


def _web_log(v: Column) -> Column:
    p = F.split(v, "[/: ]", 7)
    text = F.concat(
        F.get(p, F.lit(2)), F.lit("-"), _month(F.get(p, F.lit(1))), F.lit("-"), F.lpad(F.get(p, F.lit(0)), 2, "0"), F.lit(" "),
        F.get(p, F.lit(3)), F.lit(":"), F.get(p, F.lit(4)), F.lit(":"), F.get(p, F.lit(5)), F.get(p, F.lit(6)),
    )
    return text.try_cast("timestamp")


def parse_timestamp(text: Column, ref_year: Column) -> Column:
    """Timestamp, or null where the text has none of the accepted shapes.

    Digits only are an epoch; then ISO 8601; then ``Mon d H:M:S [Y]`` (year-less text takes
    ``ref_year``), ``Y/m/d H:M:S`` and ``d/Mon/Y:H:M:S zone``.
    """
    shaped = F.regexp_replace(strip(text), f"{SPACE}+", " ")
    return let(
        shaped,
        lambda v: F.when(v.rlike(r"^-?\d{1,19}(?:\.\d+)?$"), _epoch(v))
        .when(
            v.rlike(
                r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?" + _ZONE + r"?)?$"
            ),
            _iso(v),
        )
        .when(v.rlike(r"^[A-Za-z]{3} \d{1,2} \d{1,2}:\d{2}:\d{2}(?: \d{4})?$"), _bsd(v, ref_year))
        .when(v.rlike(r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$"), _slashed(v))
        .when(
            v.rlike(r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} (?:Z|[+-]\d{2}:?\d{2})$"),
            _web_log(v),
        ),
    )


def iso_text(ts: Column) -> Column:
    """ISO 8601 text in UTC; the fraction appears only where it is not zero.

    Cut from the epoch, so the session's time zone has no say.
    """
    def div(a, b):
        return F.call_function("div", a, F.lit(b).cast("bigint"))

    def two(n):
        return F.lpad(n.cast("string"), 2, "0")

    day_micros = 86_400_000_000
    micros = F.unix_micros(ts)
    in_day = F.pmod(micros, F.lit(day_micros).cast("bigint"))
    secs = div(in_day, 1_000_000)
    fraction = F.pmod(in_day, F.lit(1_000_000).cast("bigint"))
    return F.concat(
        F.date_from_unix_date(div(micros - in_day, day_micros).cast("int")).cast("string"),
        F.lit("T"), two(div(secs, 3600)), F.lit(":"), two(div(secs, 60) % 60), F.lit(":"), two(secs % 60),
        F.when(fraction == 0, F.lit("")).otherwise(
            F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))
        ),
        F.lit("+00:00"),
    )
