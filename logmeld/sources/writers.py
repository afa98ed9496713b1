"""Sinks: tables, upserts, exports and schema evolution. All writes are distributed."""

import math
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logmeld import vocab
from logmeld.functions.timestamps import iso_text
from logmeld.operators.analytics import summary_of_counts
from logmeld.operators.normalize import EVENT_COLUMNS
from logmeld.operators.search import latest_events, latest_failed
from logmeld.plans.process import events_of, process, quarantine_reason
from logmeld.sources import key_index
from logmeld.sources.tables import flatten_events


def write_outcomes(processed: DataFrame, path: str, mode: str = "append") -> None:
    """Processed lines -> one table partitioned by outcome, in a single pass."""
    processed.write.mode(mode).partitionBy("outcome").parquet(path)


def read_outcomes(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(E, Q) of a table written by ``write_outcomes``; each reads its own partition only."""
    table = spark.read.parquet(path)
    return events_of(table), quarantine_reason(table)


def write_events(
    e: DataFrame, path: str, mode: str = "append", created_at=None, compact: bool = False
) -> None:
    """E -> flat parquet by event date.

    ``compact`` evens out file sizes per date before writing; a date with a large share of all
    rows is spread over many tasks.
    """
    flat = flatten_events(e, created_at).withColumn("event_date", F.to_date("timestamp"))
    if compact:
        flat = flat.hint("rebalance", "event_date")
    flat.write.mode(mode).partitionBy("event_date").parquet(path)


LOOKUP_COLUMNS = ("event_id", "source_ip", "destination_ip")
# A row group holds this many rows of some hundred bytes; bloom filters are sized for as many values.
LOOKUP_ROWS = 500_000


def write_lookup(e: DataFrame, path: str, mode: str = "append", created_at=None, rows: int = LOOKUP_ROWS, group_bytes: int = 128 << 20) -> None:
    """E -> flat parquet by event date, laid out for look-ups of single values.

    Rows of a date are dealt and sorted by source address, so that an address lies in few row groups and their least and greatest values tell which. Ids and
    addresses have bloom filters besides: a row group without the value looked for is not read. A filter is as large as its row group's values need, up to
    what ``rows`` of them need; more only make it less selective. Busy addresses are spread: the deal is by ranges of address and id.
    """
    flat = flatten_events(e, created_at).withColumn("event_date", F.to_date("timestamp"))
    order = ["event_date", "source_ip", "event_id"]
    writer = flat.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("parquet.block.size", group_bytes).option("compression", "zstd")
    # 9.7 bits a value at one false positive in 100, as a power of two; the smallest of the halved sizes that fits is written
    most = 1 << max(10, math.ceil(math.log2(rows * 9.7 / 8)))
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", most)
    for name in LOOKUP_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.candidates.number#{name}", 16)
    writer.partitionBy("event_date").parquet(path)


def latest_by_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The newest row per key: what an upsert leaves behind.

    An aggregate, so that a key with many copies is reduced before the shuffle. Equal order values
    are told apart by the rest of the row.
    """
    rest = [c for c in df.columns if c not in (key, order_col)]
    row = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(F.col(order_col), F.xxhash64(*[F.col(c) for c in rest]))
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def upsert(new: DataFrame, path: str, key: str, order_col: str, date_col: str | None = None) -> None:
    """Merge rows into a table by key: of equal keys the newest stays, so that a run repeated leaves no second copy.

    Where the table is partitioned by ``date_col``, a key is found in whatever date it lies (``key_index``), and only the dates that hold
    one of the keys or get one are read and rewritten. Other tables are small; they are written anew beside and swapped.
    """
    if date_col:
        key_index.upsert_dated(new, path, key, date_col, order_col)
    else:
        key_index.upsert_whole(new, path, lambda rows: latest_by_key(rows, key, order_col).select(*new.columns))


def upsert_events(e: DataFrame, path: str, created_at=None) -> None:
    """E into the flat events table, by event id."""
    flat = flatten_events(e, created_at).withColumn("event_date", F.to_date("timestamp"))
    upsert(flat, path, "event_id", "created_at", "event_date")


def upsert_quarantine(q: DataFrame, path: str) -> None:
    """Q into its table, by event id; it is kept by the date of its ingest time."""
    upsert(q.withColumn("failed_date", F.to_date("timestamp")), path, "event_id", "timestamp", "failed_date")


def upsert_batch(summary: DataFrame, path: str, created_at=None) -> None:
    """A batch summary into its table, by batch id: one row a batch."""
    upsert(batch_rows(summary, created_at), path, "batch_id", "created_at")


def write_quarantine(q: DataFrame, path: str, mode: str = "append") -> None:
    q.write.mode(mode).parquet(path)


def batch_rows(summary: DataFrame, created_at=None) -> DataFrame:
    """A batch summary with its own JSON text and time, ready to append."""
    created = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    return summary.select(
        "batch_id", "total_events", "normalized_count", "failed_count", "processing_time_seconds",
        "events_per_second",
        F.to_json(F.struct(*summary.columns)).alias("summary_json"),
        created.alias("created_at"),
    )


def record_batch(summary: DataFrame, path: str, created_at=None) -> None:
    batch_rows(summary, created_at).write.mode("append").parquet(path)


def ingest(lines: DataFrame, path: str, batches: str, batch_id: str | None = None, created_at=None, mode: str = "append", **options) -> dict:
    """Lines -> the table of outcomes, and a row of ``batches`` with what the writing run has counted: the lines are read once.

    Returns the counts. With a ``batch_id`` of the caller's, a batch that runs again replaces its row.
    """
    seen, began = Observation(f"batch-{uuid.uuid4().hex}"), time.monotonic()
    write_outcomes(process(lines, observation=seen, **options), path, mode)
    summary = summary_of_counts(lines.sparkSession, seen.get, time.monotonic() - began, batch_id or f"batch_{uuid.uuid4().hex[:16]}")
    if batch_id is None:
        record_batch(summary, batches, created_at)
    else:
        upsert_batch(summary, batches, created_at)
    return seen.get


# ---- exports ----------------------------------------------------------------------------

def export_rows(e: DataFrame, limit: int | None = None) -> DataFrame:
    """All events, or the newest ``limit`` of them, with timestamps as ISO text."""
    metadata = F.col("metadata").withField("processed_at", iso_text(F.col("metadata.processed_at")))
    return latest_events(e.select(*EVENT_COLUMNS), limit).withColumns(
        {"timestamp": iso_text(F.col("timestamp")), "metadata": metadata}
    )


def jsonl_rows(e: DataFrame, limit: int | None = None) -> DataFrame:
    """One JSON text per event."""
    return export_rows(e, limit).select(
        F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false"}).alias("value")
    )


def export_jsonl(e: DataFrame, path: str, limit: int | None = None) -> None:
    jsonl_rows(e, limit).write.text(path)


def export_json(e: DataFrame, path: str, limit: int | None = None) -> None:
    export_rows(e, limit).write.option("ignoreNullFields", "false").json(path)


def flatten_for_csv(e: DataFrame) -> DataFrame:
    """E -> the flat 28-column layout."""
    c = F.col
    return e.select(
        "event_id", iso_text(c("timestamp")).alias("timestamp"),
        c("source.vendor").alias("vendor"), "source.device_type", "source.hostname",
        "event.category", c("event.type").alias("event_type"), "event.action", "event.severity",
        "network.source_ip", "network.destination_ip", "network.source_port",
        "network.destination_port", "network.protocol", "network.bytes_sent",
        "network.bytes_received",
        F.coalesce("threat_intel.threat_detected", F.lit(False)).alias("threat_detected"),
        "threat_intel.threat_type", "threat_intel.mitre_technique_id",
        F.coalesce("threat_intel.risk_score", F.lit(0)).alias("risk_score"),
        "threat_intel.geo_source", "threat_intel.geo_destination",
        F.coalesce("user.name", F.lit("")).alias("user"),
        F.coalesce("process.name", F.lit("")).alias("process"),
        "metadata.parser", "metadata.source_format", "metadata.confidence", "raw_event",
    ).select(*vocab.CSV_EXPORT_COLUMNS)


def export_csv(e: DataFrame, path: str, limit: int | None = None) -> None:
    flatten_for_csv(latest_events(e, limit)).write.option("escape", '"').csv(path, header=True)


def failed_csv_rows(q: DataFrame, limit: int | None = None) -> DataFrame:
    rows = latest_failed(q, limit)
    return rows.withColumn("timestamp", iso_text(F.col("timestamp"))).select(*vocab.FAILED_CSV_COLUMNS)


def export_failed_csv(q: DataFrame, path: str, limit: int | None = None) -> None:
    failed_csv_rows(q, limit).write.option("escape", '"').csv(path, header=True)


def export_parquet(e: DataFrame, path: str, mode: str = "append") -> None:
    """Every event, nested, by date."""
    e.withColumn("event_date", F.to_date("timestamp")).write.mode(mode).partitionBy(
        "event_date"
    ).parquet(path)


# ---- schema evolution -------------------------------------------------------------------

EVENT_TABLE_DEFAULTS = {"category": "network", "threat_detected": False, "risk_score": 0}


def align_schema(old: DataFrame, new: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Rows of both tables; columns the old one lacks are added, with a default where one is known."""
    given = EVENT_TABLE_DEFAULTS if defaults is None else defaults

    def filled(name: str) -> Column:
        value = F.lit(given.get(name))
        return value.cast(new.schema[name].dataType)

    added = [c for c in new.columns if c not in old.columns]
    widened = old.withColumns({c: filled(c) for c in added}) if added else old
    return widened.unionByName(new, allowMissingColumns=True)
