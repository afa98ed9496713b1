"""Key-value lines and the Cisco ASA message shape."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeld.functions.entries import entries, entry, last_wins
from logmeld.functions.text import SPACE, has_any
from logmeld.operators.detect import PAIR

# The ASA connection message.
# Groups: 1 facility, 2 severity, 3 code, 4 action, 5 protocol, 6 source interface, 7 source ip,
# 8 source port, 9 destination interface, 10 destination ip, 11 destination port.
CISCO_ASA = (
    rf"(?i)%(ASA|PIX|FWSM)-(\d)-(\d+):{SPACE}+"
    rf"(Deny|Built|Teardown|Permit|Drop){SPACE}+"
    rf"(?:(\w+){SPACE}+)?"
    rf"src{SPACE}+(?:([\w\-]+):)?([\d.]+)(?:/(\d+))?{SPACE}+"
    rf"dst{SPACE}+(?:([\w\-]+):)?([\d.]+)(?:/(\d+))?"
)
_FORTINET = ["fortigate", "devname=fg", "fortinet"]
_PALOALTO = ["pan-os", "paloalto"]


def pair_entries(line: Column) -> Column:
    """``k=v`` and ``k="v"`` pairs in line order; the value ends at white space or a comma."""

    def take(pair):
        at = F.instr(pair, "=")
        value = F.substr(pair, at + 1)
        quoted = value.startswith('"') & value.endswith('"') & (F.length(value) > 1)
        inner = F.substr(value, F.lit(2), F.length(value) - 2)
        return entry(
            F.lower(F.substr(pair, F.lit(1), at - 1)), F.when(quoted, inner).otherwise(value)
        )

    return F.transform(F.regexp_extract_all(line, F.lit(PAIR), F.lit(0)), take)


def is_asa(line: Column) -> Column:
    return line.contains("%") & line.rlike(CISCO_ASA)


def _asa(line: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, CISCO_ASA, group), F.lit(""))


def asa_entries(line: Column) -> Column:
    return entries({
        "product": F.concat(F.lit("ASA-"), _asa(line, 1)),
        "action": _asa(line, 4),
        "protocol": _asa(line, 5),
        "src_ip": _asa(line, 7),
        "src_port": _asa(line, 8),
        "dst_ip": _asa(line, 10),
        "dst_port": _asa(line, 11),
        "severity_code": _asa(line, 2),
        "cisco_message_id": _asa(line, 3),
    })


def fields(line: Column) -> Column:
    return F.when(is_asa(line), F.map_from_entries(asa_entries(line))).otherwise(
        last_wins(pair_entries(line))
    )


def vendor(lower: Column, asa: Column) -> Column:
    return (
        F.when(asa, "Cisco")
        .when(has_any(lower, *_FORTINET), "Fortinet")
        .when(has_any(lower, *_PALOALTO), "PaloAlto")
        .when(lower.contains("checkpoint"), "CheckPoint")
    )


def device_type(lower: Column, asa: Column) -> Column:
    return (
        F.when(asa | has_any(lower, *_FORTINET, *_PALOALTO, "checkpoint"), "firewall")
        .when(lower.contains("router"), "router")
        .when(lower.contains("vpn"), "vpn")
    )


def parse_key_value(df: DataFrame, col: str = "line") -> DataFrame:
    """L -> F: the pairs of the line."""
    return df.withColumn("fields", last_wins(pair_entries(F.col(col))))


def parse_cisco_asa(df: DataFrame, col: str = "line") -> DataFrame:
    """L -> F: the ASA message, null where the line is none."""
    line = F.col(col)
    return df.withColumn("fields", F.when(is_asa(line), F.map_from_entries(
        F.concat(F.array(entry("vendor", F.lit("Cisco")), entry("device_type", F.lit("firewall"))),
                 asa_entries(line)))))


def kv_vendor(df: DataFrame, col: str = "line") -> DataFrame:
    """F -> F + vendor, device_type (null where no rule fires)."""
    lower, asa = F.lower(F.col(col)), is_asa(F.col(col))
    return df.withColumns({"vendor": vendor(lower, asa), "device_type": device_type(lower, asa)})
