"""Syslog: RFC 5424, RFC 3164, and lines with nothing but a priority."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeld.functions.entries import entries, entry, last_wins, no_entries
from logmeld.functions.text import SPACE, WHITESPACE, has_any, let, strip, text_class
from logmeld.operators.detect import (
    KEY,
    RFC3164,
    RFC3164_RUNG,
    RFC5424_RUNG,
    has_priority_mark,
    is_rfc3164,
    is_rfc5424,
)

# Message pairs, structured data and vendor marks.
_MESSAGE_PAIR = rf'{KEY}=(?:{text_class(chr(34) + ",")}+|"[^"]*")'
_SD_ELEMENT = rf"\[({text_class(']')}+){SPACE}+([^\]]*)\]"
_SD_PARAM = r'(\w+)="([^"]*)"'
_CISCO_MARK = r"(?i)%(?:ASA|PIX|FWSM|FTD)-(\d)-(\d+)"
_FORTI_MARK = r"""(?:devname|devid)=["']?(?:fg|fw)"""
_PALO_MARK = r"(?:traffic|threat|system),\d{4}/\d{2}/\d{2}"
_CHECKPOINT_MARK = rf"(?:product|fw)=.*(?:smartdefense|check{SPACE}*point|vpn-1)"
_JUNIPER_MARKS = ["rt_flow", "rt_utm", "kern", "ui_", "juniper", "srx"]
_RFC3164_FULL = rf"(?s){RFC3164}(?:([a-zA-Z0-9_\-./]+)(?:\[(\d+)\])?:{SPACE}*)?(.*)$"
_SINGLE_SPACED = rf"^<\d{{1,3}}>\d+(?: {text_class()}+){{5}}(?: {text_class()}|$)"


def _priority(pri: Column) -> dict[str, Column]:
    return {"pri": pri, "facility": F.shiftright(pri, 3), "severity_code": pri.bitwiseAND(7)}


# ---- RFC 5424 ---------------------------------------------------------------------------

def rfc5424_parts(line: Column) -> Column:
    """``<pri>version``, timestamp, host, application, process id, message id and the rest.

    A single space is split by without a regular expression; other spacing is rare.
    """
    return F.when(line.rlike(_SINGLE_SPACED), F.split(line, " ", 7)).otherwise(
        F.split(line, rf"{SPACE}+", 7)
    )


def _rest(parts: Column) -> Column:
    return F.coalesce(F.try_element_at(parts, F.lit(7)), F.lit(""))


def structured_part(rest: Column) -> Column:
    """The first bracketed element, or the ``-`` that stands for none; '' where absent."""
    return (
        F.when(rest.startswith("[") & rest.contains("]"), F.concat(F.substring_index(rest, "]", 1), F.lit("]")))
        .when(rest.startswith("-"), F.lit("-"))
        .otherwise(F.lit(""))
    )


def _message(rest: Column) -> Column:
    return F.ltrim(F.substr(rest, F.length(structured_part(rest)) + 1), F.lit(WHITESPACE))


def sd_entries(sd: Column) -> Column:
    """Every parameter of every element twice: as ``id.key`` and as ``key``."""

    def params(element):
        sd_id = F.regexp_extract(element, _SD_ELEMENT, 1)
        body = F.regexp_extract(element, _SD_ELEMENT, 2)

        def both(param):
            key = F.lower(F.regexp_extract(param, _SD_PARAM, 1))
            value = F.regexp_extract(param, _SD_PARAM, 2)
            return F.array(entry(F.concat(sd_id, F.lit("."), key), value), entry(key, value))

        return F.flatten(F.transform(F.regexp_extract_all(body, F.lit(_SD_PARAM), F.lit(0)), both))

    elements = F.regexp_extract_all(sd, F.lit(_SD_ELEMENT), F.lit(0))
    return F.flatten(F.transform(elements, params))


def message_entries(message: Column) -> Column:
    def take(pair):
        at = F.instr(pair, "=")
        return entry(
            F.lower(F.substr(pair, F.lit(1), at - 1)), F.btrim(F.substr(pair, at + 1), F.lit('"'))
        )

    found = F.transform(F.regexp_extract_all(message, F.lit(_MESSAGE_PAIR), F.lit(0)), take)
    return F.when(message.contains("="), found).otherwise(no_entries())


def rfc5424_entries(parts: Column) -> Column:
    head = F.get(parts, F.lit(0))
    pri = F.substring_index(F.substring(head, 2, 9), ">", 1).try_cast("int")
    dash_is_null = lambda c: F.nullif(c, F.lit("-"))
    rest = _rest(parts)
    sd = structured_part(rest)
    named = entries({
        **_priority(pri),
        "timestamp": F.get(parts, F.lit(1)),
        "hostname": dash_is_null(F.get(parts, F.lit(2))),
        "app_name": dash_is_null(F.get(parts, F.lit(3))),
        "proc_id": F.get(parts, F.lit(4)),
        "msg_id": F.get(parts, F.lit(5)),
        "message": _message(rest),
    })
    return F.concat(
        named, F.when(sd.startswith("["), sd_entries(sd)).otherwise(no_entries())
    )


# ---- RFC 3164 ---------------------------------------------------------------------------

def _group(line: Column, i: int) -> Column:
    return F.regexp_extract(line, _RFC3164_FULL, i)


def rfc3164_entries(line: Column) -> Column:
    given = lambda i: F.nullif(_group(line, i), F.lit(""))
    return entries({
        **_priority(given(1).try_cast("int")),
        "timestamp": _group(line, 2),
        "hostname": _group(line, 3),
        "app_name": given(4),
        "pid": given(5),
        "message": _group(line, 6),
    })


# ---- priority only ----------------------------------------------------------------------

def pri_only_entries(line: Column) -> Column:
    marked = has_priority_mark(line)
    end = F.instr(line, ">")
    pri = F.when(marked, F.substr(line, F.lit(2), end - 2).try_cast("int"))
    return entries({
        **_priority(pri),
        "message": F.when(marked, strip(F.substr(line, end + 1))).otherwise(line),
    })


def _message_of(named: Column) -> Column:
    # The header's own message comes before any structured-data parameter of that name.
    return F.filter(named, lambda e: e["key"] == "message")[0]["value"]


def line_entries(line: Column, shape: Column) -> Column:
    """Header fields by the first shape that fits, without the message's own pairs.

    ``shape`` is the rung detection stopped at; where it is null the line is tested here.
    """
    untested = shape.isNull()
    return (
        F.when((shape == RFC5424_RUNG) | (untested & is_rfc5424(line)),
               let(rfc5424_parts(line), rfc5424_entries))
        .when((shape == RFC3164_RUNG) | (untested & is_rfc3164(line)), rfc3164_entries(line))
        .otherwise(pri_only_entries(line))
    )


def with_message_pairs(named: Column, message: Column) -> Column:
    """Header fields overridden by ``k=v`` pairs found in the message body."""
    return last_wins(F.concat(named, message_entries(message)))


def fields(line: Column, shape: Column) -> Column:
    return let(
        line_entries(line, shape),
        lambda named: let(_message_of(named), lambda m: with_message_pairs(named, m)),
    )


# ---- vendor rules -----------------------------------------------------------------------

def _cisco(line: Column) -> Column:
    return line.contains("%") & line.rlike(_CISCO_MARK)


def vendor(line: Column, lower: Column) -> Column:
    forti = has_any(lower, "devname=", "devid=") & lower.rlike(_FORTI_MARK)
    palo = lower.contains(",") & lower.rlike(_PALO_MARK)
    checkpoint = has_any(lower, "product=", "fw=") & lower.rlike(_CHECKPOINT_MARK)
    return (
        F.when(_cisco(line) | lower.contains("cisco"), "Cisco")
        .when(forti | has_any(lower, "fortigate", "fortinet"), "Fortinet")
        .when(has_any(lower, "paloalto", "pan-os") | palo, "PaloAlto")
        .when(checkpoint | lower.contains("checkpoint"), "CheckPoint")
        .when(has_any(lower, *_JUNIPER_MARKS), "Juniper")
        .when(has_any(lower, "suricata", "snort"), "OpenSource")
        .when(has_any(lower, "f5", "big-ip", "bigip"), "F5")
        .when(has_any(lower, "sophos", "xg firewall"), "Sophos")
    )


def device_type(line: Column, lower: Column, found: Column) -> Column:
    """``found`` is the vendor rule's result for the same line."""
    cisco = (
        F.when(_cisco(line) | has_any(lower, "asa", "ftd"), "firewall")
        .when(has_any(lower, "ios", "router"), "router")
        .when(has_any(lower, "switch", "catalyst"), "switch")
    )
    return (
        F.when(found == "Cisco", cisco)
        .when(found.isin("Fortinet", "PaloAlto", "CheckPoint", "Sophos"), "firewall")
        .when(found == "Juniper", F.when(lower.contains("srx"), "firewall").otherwise("router"))
        .when(found == "OpenSource", "ids")
        .when(found == "F5", "load_balancer")
        .when(lower.contains("vpn"), "vpn")
    )


# ---- operators --------------------------------------------------------------------------

def parse_rfc5424(df: DataFrame, col: str = "line") -> DataFrame:
    """L -> F: header fields and structured data, null where the line has another shape."""
    line = F.col(col)
    return df.withColumn(
        "fields", F.when(is_rfc5424(line), last_wins(rfc5424_entries(rfc5424_parts(line))))
    )


def structured_data(df: DataFrame, sd_col: str) -> DataFrame:
    return df.withColumn("fields", last_wins(sd_entries(F.col(sd_col))))


def parse_rfc3164(df: DataFrame, col: str = "line") -> DataFrame:
    line = F.col(col)
    return df.withColumn("fields", F.when(is_rfc3164(line), last_wins(rfc3164_entries(line))))


def parse_pri_only(df: DataFrame, col: str = "line") -> DataFrame:
    return df.withColumn("fields", last_wins(pri_only_entries(F.col(col))))


def message_pairs(df: DataFrame, fields_col: str = "fields") -> DataFrame:
    """F -> F: pairs in the ``message`` field override the other fields."""
    f = F.col(fields_col)
    return df.withColumn(
        fields_col, with_message_pairs(F.map_entries(f), F.coalesce(f["message"], F.lit("")))
    )


def syslog_vendor(df: DataFrame, col: str = "line") -> DataFrame:
    """F -> F + vendor, device_type (null where no rule fires)."""
    staged = df.withColumn("_lower", F.lower(F.col(col)))
    line, lower = F.col(col), F.col("_lower")
    return (
        staged.withColumn("vendor", vendor(line, lower))
        .withColumn("device_type", device_type(line, lower, F.col("vendor")))
        .drop("_lower")
    )
