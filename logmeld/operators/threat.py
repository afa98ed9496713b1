"""Threat scoring: plain column arithmetic over normalised labels."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeld import vocab
from logmeld.functions.network import is_private
from logmeld.functions.text import has_any

def _score(label: Column, table: dict[str, int]) -> Column:
    chain = F.lit(0)
    for key, points in table.items():
        chain = F.when(label == key, F.lit(points)).otherwise(chain)
    return chain


def action_points(action: Column) -> Column:
    return _score(action, vocab.ACTION_SCORES)


def severity_points(severity: Column) -> Column:
    return _score(severity, vocab.SEVERITY_SCORES)


def port_type(port: Column, action: Column) -> Column:
    return (
        F.when(port.isin(vocab.C2_PORTS), "C2Beaconing")
        .when(port.isin(vocab.RECON_PORTS), "Reconnaissance")
        .when(port.isin(vocab.HIGH_RISK_PORTS) & (action == "deny"), "BruteForce")
    )


def port_points(port: Column, action: Column) -> Column:
    return _score(port_type(port, action), vocab.PORT_SCORES)


def large_egress(sent: Column) -> Column:
    return F.coalesce(sent > vocab.LARGE_EGRESS_BYTES, F.lit(False))


def egress_points(sent: Column) -> Column:
    return F.when(large_egress(sent), vocab.LARGE_EGRESS_SCORE).otherwise(0)


def _hit(text: Column, kind: str) -> Column:
    return F.coalesce(has_any(text, *vocab.THREAT_WORDS[kind][0]), F.lit(False))


def keyword_hits(text: Column) -> dict[str, Column]:
    return {kind: _hit(text, kind) for kind in vocab.THREAT_WORDS}


def keyword_type(hits: dict[str, Column]) -> Column:
    """Brute-force words name the type whatever else was found; the others in order."""
    chain = F.when(hits["BruteForce"], "BruteForce")
    for kind in ("PortScan", "LateralMovement", "PrivilegeEsc"):
        chain = chain.when(hits[kind], kind)
    return chain


def keyword_points(hits: dict[str, Column]) -> Column:
    return reduce(
        lambda a, b: a + b,
        [F.when(hits[k], F.lit(p)).otherwise(F.lit(0)) for k, (_, p) in vocab.THREAT_WORDS.items()],
    )


def _geo(private: Column) -> Column:
    return F.when(private, "Internal LAN").otherwise("External")


def _inbound_denied(source_private: Column, destination_private: Column, action: Column) -> Column:
    inbound = ~source_private & destination_private & (action == "deny")
    return F.when(inbound, vocab.INBOUND_DENIED_SCORE).otherwise(0)


def technique(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.TECHNIQUES.items() for x in kv])
    return table[kind]


def threat_kind(port_kind: Column, egress: Column, word_kind: Column) -> Column:
    return (
        F.when(word_kind == "BruteForce", word_kind)
        .otherwise(F.coalesce(port_kind, F.when(egress, F.lit("DataExfiltration")), word_kind))
    )


def indicator_list(action, port, port_kind, sent, inbound) -> Column:
    port_text = port.cast("string")
    return F.array_compact(F.array(
        F.when(action == "deny", "denied_traffic").when(action == "alert", "alert_triggered"),
        F.when(port_kind == "C2Beaconing", F.concat(F.lit("c2_port:"), port_text))
        .when(port_kind == "Reconnaissance", "port_zero_scan")
        .when(port_kind == "BruteForce", F.concat(F.lit("denied_high_risk_port:"), port_text)),
        F.when(large_egress(sent), F.concat(F.lit("large_egress:"), sent.cast("string"))),
        F.when(inbound > 0, "external_to_internal_denied"),
    ))


_HIT = {kind: f"_hit_{kind}" for kind in vocab.THREAT_WORDS}


def text_and_address_findings(text: Column, source_ip: Column, destination_ip: Column) -> dict[str, Column]:
    """The findings several rules share, to be columns of a projection of their own.

    ``text`` is lower-cased message text.
    """
    return {
        **{_HIT[kind]: hit for kind, hit in keyword_hits(text).items()},
        "_source_private": is_private(source_ip),
        "_destination_private": is_private(destination_ip),
    }


def intel_of_findings(action: Column, severity: Column, port: Column, sent: Column) -> Column:
    """All rules in one struct, over the finding columns and ``_port_kind``."""
    hits = {kind: F.col(name) for kind, name in _HIT.items()}
    port_kind = F.col("_port_kind")
    source, destination = F.col("_source_private"), F.col("_destination_private")
    inbound = _inbound_denied(source, destination, action)
    kind = threat_kind(port_kind, large_egress(sent), keyword_type(hits))
    total = (
        action_points(action) + severity_points(severity) + _score(port_kind, vocab.PORT_SCORES)
        + egress_points(sent) + keyword_points(hits) + inbound
    )
    risk = F.greatest(F.lit(0), F.least(F.lit(100), total))
    return F.struct(
        ((risk >= vocab.DETECTION_SCORE) | kind.isNotNull()).alias("threat_detected"),
        kind.alias("threat_type"),
        technique(kind).alias("mitre_technique_id"),
        risk.alias("risk_score"),
        _geo(source).alias("geo_source"),
        _geo(destination).alias("geo_destination"),
        indicator_list(action, port, port_kind, sent, inbound).alias("indicators"),
    )


# ---- operators over any table with the named columns ------------------------------------

def action_score(df: DataFrame, action: str = "action") -> DataFrame:
    return df.withColumn("action_score", action_points(F.col(action)))


def severity_score(df: DataFrame, severity: str = "severity") -> DataFrame:
    return df.withColumn("severity_score", severity_points(F.col(severity)))


def port_score(df: DataFrame, port: str = "destination_port", action: str = "action") -> DataFrame:
    p, a = F.col(port), F.col(action)
    return df.withColumns({"port_type": port_type(p, a), "port_score": port_points(p, a)})


def egress_score(df: DataFrame, sent: str = "bytes_sent") -> DataFrame:
    s = F.col(sent)
    return df.withColumns({
        "egress_type": F.when(large_egress(s), "DataExfiltration"),
        "egress_score": egress_points(s),
    })


def keyword_score(df: DataFrame, text: str = "message") -> DataFrame:
    hits = keyword_hits(F.lower(F.col(text)))
    return df.withColumns({"keyword_type": keyword_type(hits), "keyword_score": keyword_points(hits)})


def is_private_ip(df: DataFrame, col: str, out: str = "is_private") -> DataFrame:
    return df.withColumn(out, is_private(F.col(col)))


def geo_labels(
    df: DataFrame, source_ip: str = "source_ip", destination_ip: str = "destination_ip"
) -> DataFrame:
    return df.withColumns({
        "geo_source": _geo(is_private(F.col(source_ip))),
        "geo_destination": _geo(is_private(F.col(destination_ip))),
    })


def inbound_denied_score(
    df: DataFrame, source_ip: str = "source_ip", destination_ip: str = "destination_ip",
    action: str = "action",
) -> DataFrame:
    return df.withColumn(
        "inbound_denied_score",
        _inbound_denied(
            is_private(F.col(source_ip)), is_private(F.col(destination_ip)), F.col(action)
        ),
    )


def score_threats(
    df: DataFrame, action: str = "action", severity: str = "severity",
    source_ip: str = "source_ip", destination_ip: str = "destination_ip",
    destination_port: str = "destination_port", bytes_sent: str = "bytes_sent",
    text: str = "message",
) -> DataFrame:
    """E -> E + threat_intel."""
    c = F.col
    found = df.withColumns({
        **text_and_address_findings(F.lower(c(text)), c(source_ip), c(destination_ip)),
        "_port_kind": port_type(c(destination_port), c(action)),
    })
    scored = found.withColumn("threat_intel", intel_of_findings(
        c(action), c(severity), c(destination_port), c(bytes_sent)))
    return scored.drop("_port_kind", "_source_private", "_destination_private", *_HIT.values())


def technique_id(df: DataFrame, type_col: str = "threat_type") -> DataFrame:
    return df.withColumn("mitre_technique_id", technique(F.col(type_col)))
