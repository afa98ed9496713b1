"""CEF: pipe-separated header, then ``key=value`` pairs whose values may hold spaces."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeld.functions.entries import entries, entry, last_wins
from logmeld.functions.text import SPACE, after, has_any, occurrences, strip

# White space before a key; the whole run counts, so it is only tried where a run starts.
_GAP = rf"{SPACE}(?<!{SPACE}{SPACE}){SPACE}*+(?=[a-zA-Z0-9_.]+=)"
_KEY = r"([a-zA-Z0-9_.]+)="
# Possessive throughout: a match runs in a loop, whatever the length of the value.
_PAIR = r"(?s)([a-zA-Z0-9_.]+)=([^=\\]*+(?:\\=?[^=\\]*+)*+)$"
_CUT = "\ue000"  # a private-use character
_HEADER = ["vendor", "product", "device_version", "signature_id", "event_name", "cef_severity"]


def header_parts(line: Column) -> Column:
    """Seven header fields and the extension; fewer elements mean a malformed header."""
    return F.split(after(line, "CEF:"), r"\|", 8)


def is_well_formed(parts: Column) -> Column:
    return (F.size(parts) == 8) & F.coalesce(F.get(parts, F.lit(0)), F.lit("")).rlike(r"^CEF:\d+$")


def version(parts: Column) -> Column:
    """What follows ``CEF:`` in the first part."""
    first = F.get(parts, F.lit(0))
    return F.substr(first, F.lit(5), F.length(first))


def error(line: Column, parts: Column) -> Column:
    text = F.concat(
        F.lit("ValueError: Line does not conform to CEF format: "),
        F.substring(after(line, "CEF:"), 1, 50),
    )
    return F.when(~is_well_formed(parts), text)


def prefix(line: Column) -> Column:
    at = F.instr(line, "CEF:")
    return F.when(at > 1, strip(F.substr(line, F.lit(1), at - 1))).otherwise(F.lit(""))


def _pieces(extension: Column) -> Column:
    """Split before every ``key=``. The gaps are cut by a compiled pattern, then by one character;
    splitting by the pattern itself would compile it for every row."""
    cut = F.split(F.regexp_replace(extension, _GAP, _CUT), _CUT)
    return F.when(extension.contains(_CUT), F.split(extension, _GAP)).otherwise(cut)


def pair_entries(extension: Column) -> Column:
    """Every ``key=value`` of the extension; blank values are dropped."""

    def take(piece):
        plain = (occurrences(piece, "=") == 1) & ~piece.contains("\\")
        value = strip(F.regexp_extract(piece, _PAIR, 2))
        value = F.replace(F.replace(value, F.lit("\\="), F.lit("=")), F.lit("\\\\"), F.lit("\\"))
        return F.when(
            plain,
            entry(
                F.lower(F.regexp_extract(piece, _KEY, 1)),
                strip(F.substr(piece, F.instr(piece, "=") + 1)),
            ),
        ).otherwise(entry(F.lower(F.regexp_extract(piece, _PAIR, 1)), value))

    pieces = F.transform(F.filter(_pieces(extension), lambda p: p.contains("=")), take)
    return F.filter(pieces, lambda e: (e["key"] != "") & (e["value"] != ""))


def header_entries(line: Column, parts: Column) -> Column:
    return entries({
        "cef_version": version(parts),
        **{name: F.get(parts, F.lit(i)) for i, name in enumerate(_HEADER, 1)},
        "prefix": prefix(line),
    })


def fields(line: Column, parts: Column) -> Column:
    return F.when(
        is_well_formed(parts),
        last_wins(F.concat(header_entries(line, parts), pair_entries(F.get(parts, F.lit(7))))),
    )


def device_type(product: Column, name: Column) -> Column:
    p, n = F.lower(F.coalesce(product, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(has_any(p, "firewall", "asa", "palo", "forti") | n.contains("firewall"), "firewall")
        .when(has_any(p, "ids", "ips", "snort", "suricata"), "ids")
        .when(p.contains("vpn") | n.contains("vpn"), "vpn")
        .when(has_any(p, "proxy", "bluecoat"), "proxy")
        .otherwise("network_device")
    )


def parse_cef(df: DataFrame, col: str = "line") -> DataFrame:
    """L -> L + header columns, extension and error."""
    staged = df.withColumn("_parts", header_parts(F.col(col)))
    parts, line = F.col("_parts"), F.col(col)
    ok = is_well_formed(parts)
    return staged.withColumns({
        "cef_version": F.when(ok, version(parts)),
        **{n: F.when(ok, F.get(parts, F.lit(i))) for i, n in enumerate([*_HEADER, "extension"], 1)},
        "prefix": F.when(ok, prefix(line)),
        "error": error(line, parts),
    }).drop("_parts")


def cef_pairs(df: DataFrame, ext_col: str = "extension") -> DataFrame:
    """L -> L + fields, the extension's pairs."""
    return df.withColumn("fields", last_wins(pair_entries(F.col(ext_col))))


def cef_device_type(df: DataFrame, product: str = "product", name: str = "event_name") -> DataFrame:
    return df.withColumn("device_type", device_type(F.col(product), F.col(name)))
