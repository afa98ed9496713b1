"""LEEF: pipe-separated header, an optional delimiter field, then delimited attributes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeld.functions.entries import entries, entry, last_wins
from logmeld.functions.text import after, has_any, let, strip

_HEX_DELIMITER = r"^(?:0?[xX])([0-9a-fA-F]{2})$"


def header_parts(line: Column) -> Column:
    """Five header fields, then attributes, or delimiter and attributes."""
    return F.split(after(line, "LEEF:"), r"\|", 7)


def is_well_formed(parts: Column) -> Column:
    return (F.size(parts) >= 6) & F.coalesce(F.get(parts, F.lit(0)), F.lit("")).isin("LEEF:1.0", "LEEF:2.0")


def error(line: Column, parts: Column) -> Column:
    text = F.concat(
        F.lit("ValueError: Line does not conform to LEEF format: "),
        F.substring(after(line, "LEEF:"), 1, 50),
    )
    return F.when(~is_well_formed(parts), text)


def _delimiter(given: Column, attributes: Column) -> Column:
    """The given delimiter (``x09`` style is decoded), else TAB, else a caret."""
    decoded = F.when(
        given.rlike(_HEX_DELIMITER),
        F.char(F.conv(F.regexp_extract(given, _HEX_DELIMITER, 1), 16, 10).cast("int")),
    ).otherwise(given)
    return (
        F.when(strip(given) != "", decoded)
        .when(attributes.contains("\t") | ~attributes.contains("^"), F.lit("\t"))
        .otherwise(F.lit("^"))
    )


def _split_by(text: Column, delimiter: Column) -> Column:
    quoted = F.concat(
        F.lit("\\Q"), F.replace(delimiter, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
    )
    return (
        F.when(delimiter == "\t", F.split(text, "\t"))
        .when(delimiter == "^", F.split(text, r"\^"))
        .otherwise(F.split(text, quoted))
    )


def attribute_entries(parts: Column) -> Column:
    has_delimiter = F.size(parts) == 7
    attributes = F.when(has_delimiter, F.try_element_at(parts, F.lit(7))).otherwise(F.get(parts, F.lit(5)))
    given = F.when(has_delimiter, F.get(parts, F.lit(5)))

    def take(piece):
        at = F.instr(piece, "=")
        return entry(
            F.lower(strip(F.substr(piece, F.lit(1), at - 1))), strip(F.substr(piece, at + 1))
        )

    pieces = let(
        F.struct(attributes.alias("text"), _delimiter(given, attributes).alias("by")),
        lambda s: _split_by(s["text"], s["by"]),
    )
    return F.transform(F.filter(pieces, lambda p: p.contains("=")), take)


def header_entries(parts: Column) -> Column:
    return entries({
        "leef_version": F.substring(F.get(parts, F.lit(0)), 6, 3),
        "vendor": F.get(parts, F.lit(1)),
        "product": F.get(parts, F.lit(2)),
        "device_version": F.get(parts, F.lit(3)),
        "event_name": F.get(parts, F.lit(4)),
    })


def fields(parts: Column) -> Column:
    return F.when(
        is_well_formed(parts),
        last_wins(F.concat(header_entries(parts), attribute_entries(parts))),
    )


def device_type(product: Column) -> Column:
    p = F.lower(F.coalesce(product, F.lit("")))
    return (
        F.when(p.contains("firewall"), "firewall")
        .when(p.contains("vpn"), "vpn")
        .when(has_any(p, "ids", "ips"), "ids")
        .otherwise("network_device")
    )


def parse_leef(df: DataFrame, col: str = "line") -> DataFrame:
    """L -> L + fields and error."""
    staged = df.withColumn("_parts", header_parts(F.col(col)))
    parts = F.col("_parts")
    return staged.withColumns(
        {"fields": fields(parts), "error": error(F.col(col), parts)}
    ).drop("_parts")


def leef_device_type(df: DataFrame, product: str = "product") -> DataFrame:
    return df.withColumn("device_type", device_type(F.col(product)))
