"""Filters, free-text search, paging and top-k over the flat events table."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeld import vocab

# Labels whose stored form is not the folded one.
STORED_LABELS = {("protocol", v.upper()): v for v in vocab.PROTOCOL_NUMBERS.values() if v != v.upper()}

SEARCH_COLUMNS = [
    "event_id", "source_ip", "destination_ip", "protocol", "action", "source_vendor",
    "raw_event", "threat_type",
]


def _search(term: str) -> Column:
    # % and _ in the term stay wildcards; a backslash is an ordinary character.
    pattern = "%" + term.strip().replace("\\", "\\\\") + "%"
    return reduce(or_, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in SEARCH_COLUMNS])


def search(t: DataFrame, term: str) -> DataFrame:
    """Rows with the term, in any case, in any of eight columns."""
    return t.filter(_search(term))


def by_ip(t: DataFrame, source_ip: str | None = None, destination_ip: str | None = None) -> DataFrame:
    return filter_events(t, source_ip=source_ip, destination_ip=destination_ip)


def by_label(
    t: DataFrame, protocol: str | None = None, action: str | None = None,
    severity: str | None = None, device_type: str | None = None, vendor: str | None = None,
) -> DataFrame:
    return filter_events(
        t, protocol=protocol, action=action, severity=severity, device_type=device_type, vendor=vendor
    )


def filter_events(
    t: DataFrame, search: str | None = None, source_ip: str | None = None,
    destination_ip: str | None = None, protocol: str | None = None, action: str | None = None,
    severity: str | None = None, device_type: str | None = None, vendor: str | None = None,
    since=None, until=None, canonical: bool = False,
) -> DataFrame:
    """Rows that meet every given condition; an absent one adds no predicate.

    Labels are compared without regard to case. In tables written by this package protocol, action
    and severity are stored in one case already: ``canonical`` compares them as they are, and the
    comparison reaches the file scan.
    """
    conditions = []
    if search:
        conditions.append(_search(search))
    for name, value in (("source_ip", source_ip), ("destination_ip", destination_ip)):
        if value:
            conditions.append(F.col(name) == value.strip())
    folds = [
        ("protocol", protocol, F.upper, str.upper, True),
        ("action", action, F.lower, str.lower, True),
        ("severity", severity, F.lower, str.lower, True),
        ("source_device_type", device_type, F.lower, str.lower, False),
        ("source_vendor", vendor, F.lower, str.lower, False),
    ]
    for name, value, fold, fold_value, stored_folded in folds:
        if value:
            if canonical and stored_folded:
                folded = fold_value(value.strip())
                conditions.append(F.col(name) == STORED_LABELS.get((name, folded), folded))
            else:
                conditions.append(fold(F.col(name)) == fold_value(value.strip()))
    if since is not None:
        conditions.append(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        conditions.append(F.col("timestamp") < F.lit(until).cast("timestamp"))
    return t.filter(reduce(and_, conditions)) if conditions else t


def event_by_id(t: DataFrame, event_id: str) -> DataFrame:
    return t.filter(F.col("event_id") == event_id)


def non_empty(t: DataFrame, col: str) -> DataFrame:
    return t.filter(F.col(col).isNotNull() & (F.col(col) != ""))


# ---- pages ------------------------------------------------------------------------------

def _newest(t: DataFrame, order_by: str, descending: bool) -> list[Column]:
    first = F.col(order_by).desc() if descending else F.col(order_by).asc()
    return [first, F.col("event_id")]


def page(
    t: DataFrame, page: int = 1, page_size: int = 50, order_by: str = "timestamp",
    descending: bool = True,
) -> DataFrame:
    """One page, newest first. Every task keeps its own first rows; nothing is sorted in full."""
    ordered = t.orderBy(*_newest(t, order_by, descending))
    skip = (page - 1) * page_size
    return (ordered.offset(skip) if skip else ordered).limit(page_size)


def page_after(t: DataFrame, timestamp, event_id: str, page_size: int = 50) -> DataFrame:
    """The page after a given row: for deep paging, where an offset would have to be counted off."""
    ts = F.lit(timestamp).cast("timestamp")
    later = (F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("event_id") > event_id))
    return page(t.filter(later), 1, page_size)


def page_info(t: DataFrame, page_size: int = 50) -> DataFrame:
    """(total, total_pages) of a filtered table."""
    total = t.agg(F.count("*").alias("total"))
    return total.select(
        "total", F.ceil(F.col("total") / F.lit(page_size)).cast("bigint").alias("total_pages")
    )


def top_k(t: DataFrame, col: str, k: int) -> DataFrame:
    """(key, count) of the k most frequent non-empty values; ties by key."""
    return (
        non_empty(t, col).groupBy(F.col(col).alias("key")).agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "key").limit(k)
    )


def latest_failed(q: DataFrame, limit: int | None = 100) -> DataFrame:
    return q if limit is None else q.orderBy(F.desc("timestamp"), "event_id").limit(limit)


def latest_batches(b: DataFrame, limit: int = 5) -> DataFrame:
    return (
        b.select("batch_id", "total_events", "normalized_count", "failed_count",
                 "events_per_second", "processing_time_seconds", "created_at")
        .orderBy(F.desc("created_at"), "batch_id").limit(limit)
    )


def latest_events(t: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest ``limit`` events in order; without a limit all of them, unsorted."""
    return t if limit is None else t.orderBy(F.desc("timestamp"), "event_id").limit(limit)
