"""Validation rules, each a reason or null, and the first failing one.

Every rule works on any table: ``cols`` maps the standard names below to the table's own columns
(struct members included). ``EVENT`` is the mapping for nested events.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeld import vocab
from logmeld.functions.network import is_ip
from logmeld.functions.text import strip

FLAT = {n: n for n in [
    "event_id", "raw_event", "timestamp", "source_port", "destination_port", "source_ip",
    "destination_ip", "severity", "confidence", "schema_version", "risk_score", "bytes_sent",
    "bytes_received",
]}
EVENT = {
    **FLAT,
    **{n: f"network.{n}" for n in [
        "source_port", "destination_port", "source_ip", "destination_ip", "bytes_sent",
        "bytes_received"]},
    "severity": "event.severity",
    "confidence": "metadata.confidence",
    "schema_version": "metadata.schema_version",
    "risk_score": "threat_intel.risk_score",
}


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def _says(condition: Column, *parts) -> Column:
    text = F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.when(condition, text)


def _required(c) -> list[Column]:
    return [
        _says(F.coalesce(c("event_id"), F.lit("")) == "", "Missing event_id"),
        _says(_blank(c("raw_event")), "Lossless violation: raw_event must never be empty"),
        _says(c("timestamp").isNull(), "Missing timestamp"),
    ]


def _ports(c) -> list[Column]:
    bad = lambda p: ~p.between(0, 65535)
    return [
        _says(bad(c("source_port")), "Invalid source port: ", c("source_port")),
        _says(bad(c("destination_port")), "Invalid destination port: ", c("destination_port")),
    ]


def _ips(c) -> list[Column]:
    bad = lambda ip: (ip != "") & ~is_ip(ip)
    return [
        _says(bad(c("source_ip")), "Malformed source IP: ", c("source_ip")),
        _says(bad(c("destination_ip")), "Malformed destination IP: ", c("destination_ip")),
    ]


def _severity(c) -> list[Column]:
    s = c("severity")
    allowed = ", ".join(vocab.SEVERITIES)
    return [_says((s != "") & ~s.isin(vocab.SEVERITIES),
                  "Invalid severity '", s, f"'; must be one of {allowed}")]


def _confidence(c) -> list[Column]:
    v = c("confidence")
    return [_says(~v.between(0.0, 1.0), "Confidence ", v, " out of range [0.0, 1.0]")]


def _schema_version(c) -> list[Column]:
    return [_says(F.coalesce(c("schema_version"), F.lit("")) == "",
                  "Missing schema_version in metadata")]


def _risk(c) -> list[Column]:
    v = c("risk_score")
    return [_says(~v.between(0, 100), "Risk score ", v, " out of range [0, 100]")]


def _bytes(c) -> list[Column]:
    return [
        _says(c(n) < 0, f"Negative {n}: ", c(n)) for n in ("bytes_sent", "bytes_received")
    ]


RULES = [_required, _ports, _ips, _severity, _confidence, _schema_version, _risk, _bytes]


def _check(df: DataFrame, rules, cols: dict[str, str] | None, out: str) -> DataFrame:
    names = {**FLAT, **(cols or {})}
    column = lambda n: F.col(names[n])
    return df.withColumn(out, F.coalesce(*[r for rule in rules for r in rule(column)]))


def check_required(df: DataFrame, cols=None, out: str = "reason") -> DataFrame:
    return _check(df, [_required], cols, out)


def check_ports(df: DataFrame, cols=None, out: str = "reason") -> DataFrame:
    return _check(df, [_ports], cols, out)


def check_ips(df: DataFrame, cols=None, out: str = "reason") -> DataFrame:
    return _check(df, [_ips], cols, out)


def check_severity(df: DataFrame, cols=None, out: str = "reason") -> DataFrame:
    return _check(df, [_severity], cols, out)


def check_confidence(df: DataFrame, cols=None, out: str = "reason") -> DataFrame:
    return _check(df, [_confidence], cols, out)


def check_schema_version(df: DataFrame, cols=None, out: str = "reason") -> DataFrame:
    return _check(df, [_schema_version], cols, out)


def check_risk(df: DataFrame, cols=None, out: str = "reason") -> DataFrame:
    return _check(df, [_risk], cols, out)


def check_bytes(df: DataFrame, cols=None, out: str = "reason") -> DataFrame:
    return _check(df, [_bytes], cols, out)


def validate(df: DataFrame, cols=None, out: str = "reason") -> DataFrame:
    """The first failing rule's reason, null where the row is valid."""
    return _check(df, RULES, cols, out)
