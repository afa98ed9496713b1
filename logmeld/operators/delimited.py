"""Delimited lines: delimiter, quoted cells, in-band header rows and positional layouts.

A header row names the cells of the rows after it, up to the next header row of the same file.
Carrying it forward is an as-of join, done in one of two exact ways:

* few header rows in all (the usual case, checked by counting them first): they are broadcast,
  one sorted array per file, and every row looks up its own; rows are not moved;
* otherwise the delimited rows are shuffled by (file, block of line numbers). A block is bounded,
  so a file that holds a third of all rows is spread over many tasks; the last header of each
  block is carried over block summaries only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logmeld import vocab
from logmeld.functions.entries import entry, last_wins, no_entries
from logmeld.functions.text import has_any, occurrences, strip
from logmeld.session import written

BLOCK_LINES = 65_536
BROADCAST_HEADERS = 20_000  # header rows in all, over every file
BROADCAST_HEADERS_PER_FILE = 64


# ---- cells ------------------------------------------------------------------------------

def delimiter(line: Column) -> Column:
    """The most frequent candidate if it occurs twice or more, else a comma."""
    counts = [(d, occurrences(line, d)) for d in vocab.DELIMITERS]
    most = F.greatest(*[n for _, n in counts])
    chain = F.lit(",")
    for d, n in reversed(counts):
        chain = F.when((n == most) & (most >= 2), F.lit(d)).otherwise(chain)
    return chain


def _cells_by(line: Column, d: str) -> Column:
    # Every cell is preceded by a delimiter, so no match is empty; all loops are possessive.
    x = "\\" + d
    cell = rf'(?s){x}((?:"[^"]*+(?:""[^"]*+)*+(?:"|$))?+[^{x}]*+)'
    return F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(cell), F.lit(1))


def _unquote(cell: Column) -> Column:
    quoted = r'(?s)^"([^"]*+(?:""[^"]*+)*+)(?:"|$)(.*)$'
    inner = F.replace(F.regexp_extract(cell, quoted, 1), F.lit('""'), F.lit('"'))
    return F.when(
        cell.startswith('"'), F.concat(inner, F.regexp_extract(cell, quoted, 2))
    ).otherwise(cell)


def cells(line: Column, by: Column) -> Column:
    """Quote-aware cells; empty cells are empty text, and there is no limit on their number."""
    chain = _cells_by(line, ",")
    for d in vocab.DELIMITERS[1:]:
        chain = F.when(by == d, _cells_by(line, d)).otherwise(chain)
    return F.when(line.contains('"'), F.transform(chain, _unquote)).otherwise(chain)


def stripped(row: Column) -> Column:
    return F.transform(row, strip)


def is_header(row: Column) -> Column:
    """Three cells or more, over 60 % of them not numbers, and two or more known names."""
    named = F.size(F.filter(row, lambda c: F.lower(strip(c)).isin(vocab.HEADER_WORDS))) >= 2

    def is_word(c):
        bare = F.translate(strip(c), "_-", "")
        return (bare != "") & ~bare.rlike(r"^(?=.*\d)[\d.]+$")

    words = F.size(F.filter(row, is_word))
    return (F.size(row) >= 3) & named & (words > F.size(row) * 0.6)


def header_names(row: Column) -> Column:
    return F.transform(row, lambda c: F.lower(strip(c)))


def positional_entries(row: Column) -> Column:
    return F.transform(
        row, lambda c, i: entry(F.concat(F.lit("col_"), i.cast("string")), strip(c))
    )


def named_entries(row: Column, header: Column) -> Column:
    """Cells under the header's names if the counts agree, else under ``col_0`` and so on."""
    named = F.transform(F.arrays_zip(header.alias("h"), row.alias("c")),
                        lambda z: entry(z["h"], strip(z["c"])))
    return F.when(F.size(header) == F.size(row), named).otherwise(positional_entries(row))


# ---- layouts and vendor rules -----------------------------------------------------------

def is_paloalto(row: Column, lower: Column) -> Column:
    return (F.size(row) > 20) & has_any(lower, "allow", "deny", "drop")


def paloalto_entries(row: Column) -> Column:
    at = lambda i: strip(F.try_element_at(row, F.lit(i + 1)))
    digits = lambda i: F.when(at(i).rlike(r"^\d+$"), at(i))
    named = F.array(
        entry("src_ip", at(7)), entry("dst_ip", at(8)), entry("src_port", digits(24)),
        entry("dst_port", digits(25)), entry("proto", at(29)), entry("action", at(30)),
    )
    return F.filter(named, lambda e: e["value"].isNotNull())


def vendor(row: Column, lower: Column) -> Column:
    vpn = F.when(lower.contains("pulse"), "PulseSecure").when(
        has_any(lower, "anyconnect", "cisco"), "Cisco"
    )
    return (
        F.when(is_paloalto(row, lower), "PaloAlto-CSV")
        .when(has_any(lower, "checkpoint", "smartlog"), "CheckPoint")
        .when(has_any(lower, "vpn", "tunnel", "pulse"), vpn)
    )


def device_type(row: Column, lower: Column) -> Column:
    return (
        F.when(is_paloalto(row, lower) | has_any(lower, "checkpoint", "smartlog"), "firewall")
        .when(has_any(lower, "vpn", "tunnel", "pulse"), "vpn")
        .when(has_any(lower, "proxy", "bluecoat", "squid"), "proxy")
    )


def fields(row: Column, header: Column, lower: Column) -> Column:
    extra = F.when(is_paloalto(row, lower), paloalto_entries(row)).otherwise(no_entries())
    return F.when(row.isNotNull(), last_wins(F.concat(named_entries(row, header), extra)))


# ---- carrying headers forward -----------------------------------------------------------

def header_rows(df: DataFrame, row: str = "cells") -> DataFrame:
    """The header rows as (file_path, line_no, header).

    Exploding a null drops the row. Unlike a filter, that is not moved below the projections the
    cells come from, so they are split once.
    """
    c = F.col(row)
    names = F.when(is_header(c), F.array(header_names(c)))
    return df.select("file_path", "line_no", F.explode(names).alias("header"))


def few_enough(headers: DataFrame) -> bool:
    """Whether the header rows are provably small enough to send to every task."""
    per_file = headers.groupBy("file_path").count()
    total, most = per_file.agg(F.sum("count"), F.max("count")).first()
    return (total or 0) <= BROADCAST_HEADERS and (most or 0) <= BROADCAST_HEADERS_PER_FILE


def with_headers_broadcast(df: DataFrame, headers: DataFrame) -> DataFrame:
    """Last earlier header of the same file, from a broadcast array per file."""
    per_file = headers.groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "header"))).alias("_headers")
    )
    earlier = F.filter(F.col("_headers"), lambda h: h["line_no"] < F.col("line_no"))
    return (
        df.join(F.broadcast(per_file), "file_path", "left")
        .withColumn("header", F.try_element_at(earlier, F.lit(-1))["header"])
        .drop("_headers")
    )


def with_headers_shuffled(df: DataFrame, row: str = "cells", block: int = BLOCK_LINES) -> DataFrame:
    """Last earlier header of the same file, by bounded blocks of line numbers."""
    c = F.col(row)
    staged = df.withColumns({
        "_block": F.floor(F.col("line_no") / block),
        "_own": F.when(is_header(c), header_names(c)),
    })
    keys = ["file_path", "_block"]
    blocks = staged.groupBy(*keys).agg(
        F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("line_no"))).alias("_last")
    )
    before = W.partitionBy("file_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(*keys, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return (
        staged.join(carried, keys, "left")
        .withColumn("header", F.coalesce(F.last("_own", ignorenulls=True).over(within), "_carried"))
        .drop("_block", "_own", "_carried")
    )


def with_headers(
    df: DataFrame, headers: list[str] | None = None, row: str = "cells",
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Cells -> cells + header. ``headers`` given: the same names for every row.

    ``candidates`` may be any subset of the rows that is sure to hold every header row; looking
    for headers there spares a pass over the rest.
    """
    if headers is not None:
        names = F.array(*[F.lit(h.strip().lower()) for h in headers])
        return df.withColumn("header", names)
    found = written(header_rows(candidates if candidates is not None else df, row), "headers")
    if few_enough(found):
        return with_headers_broadcast(df, found)
    return with_headers_shuffled(df, row)


# ---- operators --------------------------------------------------------------------------

def sniff_delimiter(df: DataFrame, col: str = "line") -> DataFrame:
    return df.withColumn("delim", delimiter(F.col(col)))


def split_delimited(df: DataFrame, col: str = "line", delim: str = "delim") -> DataFrame:
    return df.withColumn("cells", cells(F.col(col), F.col(delim)))


def is_header_row(df: DataFrame, row: str = "cells") -> DataFrame:
    return df.withColumn("is_header", is_header(F.col(row)))


def apply_headers(
    df: DataFrame, headers: list[str] | None = None, row: str = "cells"
) -> DataFrame:
    """L with cells, file_path and line_no -> F; header rows are left out."""
    c = F.col(row)
    return (
        with_headers(df, headers, row)
        .filter(~is_header(c))
        .withColumn("fields", last_wins(named_entries(c, F.col("header"))))
        .drop("header")
    )


def paloalto_positional(df: DataFrame, row: str = "cells", col: str = "line") -> DataFrame:
    """F -> F with the fields of the long positional firewall layout."""
    c, f = F.col(row), F.col("fields")
    hit = is_paloalto(c, F.lower(F.col(col)))
    return df.withColumn(
        "fields",
        F.when(hit, last_wins(F.concat(F.map_entries(f), paloalto_entries(c)))).otherwise(f),
    )


def csv_vendor(df: DataFrame, row: str = "cells", col: str = "line") -> DataFrame:
    lower = F.lower(F.col(col))
    return df.withColumns({
        "vendor": vendor(F.col(row), lower), "device_type": device_type(F.col(row), lower)
    })
