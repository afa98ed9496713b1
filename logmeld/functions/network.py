"""Address, port and number expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted address shapes.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_HEX = r"[0-9a-fA-F]{1,4}"
IP_PATTERN = (
    rf"^(?:(?:{_OCTET}\.){{3}}{_OCTET}"
    rf"|(?:{_HEX}:){{7}}{_HEX}"
    rf"|(?:{_HEX}:){{1,7}}:"
    rf"|::(?:{_HEX}:){{0,5}}{_HEX}"
    rf"|(?:{_HEX}:){{1,6}}:{_HEX})$"
)


def is_ip(text: Column) -> Column:
    return text.rlike(IP_PATTERN)


def is_private(ip: Column) -> Column:
    """Private IPv4 ranges; an absent address counts as internal, other shapes as external."""
    parts = F.split(ip, r"\.")
    a = F.try_element_at(parts, F.lit(1)).try_cast("int")
    b = F.try_element_at(parts, F.lit(2)).try_cast("int")
    ranges = (
        (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127)
    )
    return F.when(F.coalesce(ip, F.lit("")) == "", F.lit(True)).otherwise(
        F.coalesce((F.size(parts) == 4) & b.isNotNull() & ranges, F.lit(False))
    )
