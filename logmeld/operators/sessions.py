"""Sessions per address over whole tables: runs of events with less than ``gap`` between them.

No address is one task. Events of an address in one cell of time as wide as the gap belong together whatever lies between, so cells
are counted before the shuffle: a busy address becomes one row per cell. Cells are joined to sessions within blocks of cells. Only the
first and the last session of each block may go on in another; these alone are brought together per address and stitched.

Defined cases: events without an address or time belong to no session. Events exactly a gap apart are in two sessions. Repeated rows count
as often as they occur. Empty input gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 4096


def _joined(parts: DataFrame, by: list[str], gap: int) -> DataFrame:
    """``session``: number of the session within ``by``, from 1, of rows (first, last, n) in order of time."""
    ordered = W.partitionBy(*by).orderBy("first")
    breaks = F.coalesce(F.col("first") - F.lag("last").over(ordered) >= gap, F.lit(True)).cast("int")
    return parts.withColumn("breaks", breaks).withColumn("session", F.sum("breaks").over(ordered))


def _merged(parts: DataFrame, by: list[str], *more: Column) -> DataFrame:
    return parts.groupBy(*by, "session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), *more)


def sessions(
    events: DataFrame, gap_seconds: int = 1800, key: str = "network.source_ip", timestamp: str = "timestamp", cells: int = CELLS,
) -> DataFrame:
    """(session_start, session_end, source_ip, n); a session ends a gap after its last event. ``cells``: cells of time in a block."""
    gap, c = gap_seconds * 1_000_000, F.col
    given = events.select(c(key).alias("key"), F.unix_micros(timestamp).alias("at")).filter("key <> '' and at is not null")
    cell = F.expr(f"(at - pmod(at, {gap}L)) div {gap}L")
    counted = given.groupBy("key", cell.alias("cell")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    block = F.expr(f"(cell - pmod(cell, {cells}L)) div {cells}L")
    inside = _joined(counted.withColumn("block", block), ["key", "block"], gap)
    inside = inside.withColumn("n_sessions", F.sum("breaks").over(W.partitionBy("key", "block")))
    pieces = _merged(inside, ["key", "block"], F.max("n_sessions").alias("n_sessions"))
    # pieces at a block's edges meet per address; all others are whole, each on its own
    whole = (c("session") > 1) & (c("session") < c("n_sessions"))
    pieces = pieces.select("key", F.when(whole, c("block")).alias("block"), F.when(whole, c("session")).alias("piece"), "first", "last", "n")
    stitched = _merged(_joined(pieces, ["key", "block", "piece"], gap), ["key", "block", "piece"])
    return stitched.select(
        F.timestamp_micros("first").alias("session_start"), F.timestamp_micros(c("last") + gap).alias("session_end"),
        c("key").alias("source_ip"), "n")
