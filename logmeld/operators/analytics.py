"""Breakdowns, totals, the analytics bundle and batch summaries."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logmeld.operators.search import latest_batches, top_k


def totals(t: DataFrame, q: DataFrame) -> DataFrame:
    """(total_events, failed_events)."""
    failed = q.agg(F.count("*")).scalar()
    return t.agg(F.count("*").alias("total_events")).withColumn("failed_events", failed)


def _breakdown(t: DataFrame, key: Column, k: int | None = None) -> DataFrame:
    counts = t.groupBy(key.alias("key")).agg(F.count("*").alias("count"))
    return counts if k is None else counts.orderBy(F.desc("count"), "key").limit(k)


def protocol_key() -> Column:
    return F.upper(F.coalesce("protocol", F.lit("OTHER")))


def action_key() -> Column:
    return F.lower(F.coalesce("action", F.lit("unknown")))


def severity_key() -> Column:
    return F.lower(F.coalesce("severity", F.lit("informational")))


def device_key() -> Column:
    return F.coalesce("source_device_type", F.lit("other"))


def category_key() -> Column:
    return F.lower(F.coalesce("category", F.lit("network")))


def vendor_key() -> Column:
    return F.coalesce("source_vendor", F.lit("Unknown"))


def protocol_breakdown(t: DataFrame, k: int = 6) -> DataFrame:
    return _breakdown(t, protocol_key(), k)


def action_breakdown(t: DataFrame) -> DataFrame:
    return _breakdown(t, action_key())


def severity_breakdown(t: DataFrame) -> DataFrame:
    return _breakdown(t, severity_key())


def device_breakdown(t: DataFrame) -> DataFrame:
    return _breakdown(t, device_key())


def category_breakdown(t: DataFrame) -> DataFrame:
    return _breakdown(t, category_key())


def vendor_breakdown(t: DataFrame, k: int = 10) -> DataFrame:
    return _breakdown(t, vendor_key(), k)


def active_sources(t: DataFrame) -> DataFrame:
    return t.agg(F.count_distinct(device_key()).alias("n"))


def threat_count(t: DataFrame) -> DataFrame:
    return t.agg(F.count_if("threat_detected").alias("n"))


def threat_types(t: DataFrame, k: int = 10) -> DataFrame:
    return top_k(t, "threat_type", k)


def mean_threat_risk(t: DataFrame) -> DataFrame:
    risk = F.avg(F.when(F.col("threat_detected"), F.col("risk_score")))
    return t.agg(F.round(F.coalesce(risk, F.lit(0.0)), 1).alias("avg_risk"))


def with_share(counts: DataFrame) -> DataFrame:
    """(key, count) -> + pct, the whole-number share of the total, halves rounded up."""
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn(
        "pct", F.floor(F.col("count") * 100 / total + 0.5).cast("int")
    )


# ---- the bundle -------------------------------------------------------------------------

# Rows kept per metric; metrics not listed are kept whole.
TOP = {"source_ip": 7, "destination_ip": 7, "protocol": 6, "threat_type": 10, "vendor": 10}


def analytics(t: DataFrame, q: DataFrame) -> DataFrame:
    """Every dashboard figure as (metric, key, count), from one scan of the events.

    The labels have few values, so their combinations are counted once, together, and the small
    result is taken apart afterwards; only the two address columns need grouping sets of their own.
    The scan expands to three rows per event instead of one per metric. The mean risk is carried
    as two counts (``risk_total`` over ``threats``).
    """
    return ranked(_counted(t, [])).unionByName(_failed(q, []))


def daily_figures(t: DataFrame, q: DataFrame) -> DataFrame:
    """The counts behind ``analytics`` as (day, metric, key, count): all of them, unranked, so that days and batches add up.

    Rows without a time have no day. Addresses are counted exactly, one row per day and address.
    """
    day = F.to_date("timestamp").alias("day")
    return _counted(t.withColumn("day", day), ["day"]).unionByName(_failed(q.withColumn("day", day), ["day"]))


def analytics_of(figures: DataFrame) -> DataFrame:
    """``analytics`` from daily figures of any days and batches."""
    summed = figures.groupBy("metric", "key").agg(F.sum("count").alias("count"))
    # ranked for themselves: failed lines are a figure even where there are none
    failed = summed.filter(F.col("metric") == "failed_events").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    return ranked(summed.filter(F.col("metric") != "failed_events")).unionByName(failed.select(
        F.lit("failed_events").alias("metric"), F.lit(None).cast("string").alias("key"), "count"))


def _failed(q: DataFrame, by: list[str]) -> DataFrame:
    counts = q.groupBy(*by).agg(F.count("*").alias("count")) if by else q.agg(F.count("*").alias("count"))
    return counts.select(*by, F.lit("failed_events").alias("metric"), F.lit(None).cast("string").alias("key"), "count")


def _counted(t: DataFrame, by: list[str]) -> DataFrame:
    """(metric, key, count) for each value of the columns ``by``."""
    labels = {
        "protocol": protocol_key(), "action": action_key(), "severity": severity_key(),
        "device_type": device_key(), "category": category_key(), "vendor": vendor_key(),
        "threat_type": F.nullif("threat_type", F.lit("")),
        "threat": F.coalesce(F.col("threat_detected"), F.lit(False)),
    }
    ips = ["source_ip", "destination_ip"]
    base = t.select(
        *by, *[c.alias(n) for n, c in labels.items()],
        *[F.nullif(c, F.lit("")).alias(c) for c in ips],
        F.coalesce("risk_score", F.lit(0)).alias("risk"),
    )
    names = list(labels)
    c = F.col
    sets = [[c(n) for n in [*by, *some]] for some in (names, ips[:1], ips[1:])]
    cube = base.groupingSets(sets, *[c(n) for n in [*by, *names, *ips]]).agg(
        F.count("*").alias("n"),
        F.sum(F.when(c("threat"), c("risk")).otherwise(0)).alias("risk"),
        F.grouping(ips[0]).alias("not_source"),
        F.grouping(ips[1]).alias("not_destination"),
    )
    row = lambda metric, key, n: F.struct(
        F.lit(metric).alias("metric"), key.alias("key"), n.alias("count")
    )
    none = F.lit(None).cast("string")
    of_labels = F.array(
        row("total_events", none, c("n")),
        *[row(m, c(m), c("n")) for m in names if m != "threat"],
        row("threats", none, F.when(c("threat"), c("n")).otherwise(0)),
        row("risk_total", none, c("risk")),
    )
    rows = cube.select(*by, F.inline(
        F.when(c("not_source") == 0, F.array(row("source_ip", c("source_ip"), c("n"))))
        .when(c("not_destination") == 0, F.array(row("destination_ip", c("destination_ip"), c("n"))))
        .otherwise(of_labels)
    ))
    figures = ["total_events", "threats", "risk_total"]
    named = rows.filter(c("key").isNotNull() | c("metric").isin(figures))
    return named.groupBy(*by, "metric", "key").agg(F.sum("count").alias("count"))


def ranked(counted: DataFrame) -> DataFrame:
    """The first rows of each metric that has a ``TOP``, and all of the others."""
    c = F.col
    # Metrics kept whole get one partition per key, so their rank is always 1; the literal bound
    # lets every task drop all but its own first rows before the shuffle.
    whole = F.when(~c("metric").isin(list(TOP)), c("key"))
    rank = F.row_number().over(W.partitionBy("metric", whole).orderBy(F.desc("count"), "key"))
    limit = F.coalesce(
        *[F.when(c("metric") == m, F.lit(k)) for m, k in TOP.items()], F.lit(max(TOP.values()))
    )
    kept = counted.withColumn("rank", rank).filter(
        (c("rank") <= max(TOP.values())) & (c("rank") <= limit)
    )
    return kept.select("metric", "key", "count")


def dashboard(t: DataFrame, q: DataFrame, batches: DataFrame | None = None, recent: int = 5) -> DataFrame:
    """The whole answer as (metric, key, value): ``analytics``, active sources, mean threat risk, and the latest batches."""
    return dashboard_of(analytics(t, q), batches, recent)


def dashboard_of(answer: DataFrame, batches: DataFrame | None = None, recent: int = 5) -> DataFrame:
    """The same from what ``analytics`` or ``analytics_of`` has answered."""
    none = F.lit(None).cast("string")
    rows = answer.select("metric", "key", F.col("count").cast("double").alias("value"))
    counts = rows.filter(F.col("metric").isin("threats", "risk_total", "device_type"))
    of = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value")))
    risk = F.coalesce(F.try_divide(of("risk_total"), of("threats")), F.lit(0.0))
    figures = counts.agg(
        F.count_if(F.col("metric") == "device_type").cast("double").alias("active_sources"), F.round(risk, 1).alias("average_risk_score"),
    ).select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), none.alias("key"), F.col(m).alias("value")) for m in ("active_sources", "average_risk_score")])))
    out = rows.unionByName(figures)
    if batches is not None:
        out = out.unionByName(latest_batches(batches, recent).select(
            F.lit("recent_batch").alias("metric"), F.col("batch_id").alias("key"), F.col("total_events").cast("double").alias("value")))
    return out


# ---- batch summaries --------------------------------------------------------------------

def batch_breakdowns(e: DataFrame) -> DataFrame:
    """One row of three maps: events by device type, by format and by action. For a batch whose labels fit one row; see ``breakdown_rows``.

    The label combinations are counted in one pass; the maps are built from those counts.
    """
    return _label_maps(e, {
        "sources_breakdown": F.coalesce("source.device_type", F.lit("unknown")),
        "formats_breakdown": F.coalesce("metadata.source_format", F.lit("unknown")),
        "actions_breakdown": F.coalesce("event.action", F.lit("unknown")),
    })


def breakdown_rows(e: DataFrame) -> DataFrame:
    """(name, key, n): the same counts as rows, for any number of labels."""
    return _label_counts(e, {
        "sources_breakdown": F.coalesce("source.device_type", F.lit("unknown")),
        "formats_breakdown": F.coalesce("metadata.source_format", F.lit("unknown")),
        "actions_breakdown": F.coalesce("event.action", F.lit("unknown")),
    })


def _label_counts(e: DataFrame, keys: dict[str, Column]) -> DataFrame:
    counted = e.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count("*").alias("n"))
    pairs = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("key"), F.col("n")) for n in keys
    ])
    return counted.select(F.inline(pairs)).groupBy("name", "key").agg(F.sum("n").alias("n"))


def _label_maps(e: DataFrame, keys: dict[str, Column]) -> DataFrame:
    long = _label_counts(e, keys)
    maps = [
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("name") == n, F.struct("key", "n"))
        ))).alias(n)
        for n in keys
    ]
    return long.agg(*maps)


def batch_risk(e: DataFrame) -> DataFrame:
    """One row: events by severity, and the number of detected threats."""
    counted = e.groupBy(F.coalesce("event.severity", F.lit("informational")).alias("key")).agg(
        F.count("*").alias("n"), F.count_if("threat_intel.threat_detected").alias("threats")
    )
    return counted.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("severity_breakdown"),
        F.coalesce(F.sum("threats"), F.lit(0)).alias("threat_count"),
    )


def outcome_counts(processed: DataFrame) -> DataFrame:
    """One row of counts over processed lines: total, normalised, failed, skipped."""
    of = lambda name: F.count_if(F.col("outcome") == name)
    return processed.agg(
        (of("event") + of("failed")).alias("total_events"),
        of("event").alias("normalized_count"),
        of("failed").alias("failed_count"),
        of("skipped").alias("skipped_count"),
    )


def batch_summary(e: DataFrame, q: DataFrame, seconds: float) -> DataFrame:
    """One row for a finished batch; ``seconds`` is measured around the action that ran it."""
    failed = q.agg(F.count("*")).scalar()
    total = F.col("normalized_count") + F.col("failed_count")
    return (
        e.agg(F.count("*").alias("normalized_count"))
        .withColumn("failed_count", failed)
        .select(
            F.concat(F.lit("batch_"), F.substring(F.sha2(F.uuid(), 256), 1, 8)).alias("batch_id"),
            total.alias("total_events"), "normalized_count", "failed_count",
            F.round(F.lit(float(seconds)), 4).alias("processing_time_seconds"),
            F.when(F.lit(seconds > 0), F.round(total / F.lit(float(seconds or 1)), 2))
            .otherwise(0.0).alias("events_per_second"),
        )
    )


def summary_of_counts(spark: SparkSession, counts: dict, seconds: float, batch_id: str) -> DataFrame:
    """The same row from the counts that a run has observed (event, failed), without reading anything again."""
    done, failed = int(counts.get("event") or 0), int(counts.get("failed") or 0)
    rate = round((done + failed) / seconds, 2) if seconds > 0 else 0.0
    return spark.createDataFrame(
        [(batch_id, done + failed, done, failed, round(float(seconds), 4), rate)],
        "batch_id string, total_events long, normalized_count long, failed_count long, processing_time_seconds double, events_per_second double")


# ---- time series and reports ------------------------------------------------------------

def event_frequency(t: DataFrame, every: str = "1 hour") -> DataFrame:
    return (
        t.groupBy(F.window("timestamp", every).alias("w")).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "n")
    )


def error_rate(processed: DataFrame, by: str = "detected_format") -> DataFrame:
    """(key, total, failed, error_rate) over processed lines that were not skipped."""
    kept = processed.filter(F.col("outcome") != "skipped")
    return kept.groupBy(F.col(by).alias("key")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        (F.count_if(F.col("outcome") == "failed") / F.count("*")).alias("error_rate"),
    )


def parser_performance(processed: DataFrame) -> DataFrame:
    """(parser, total, failed, mean_confidence) per parser that was tried."""
    tried = processed.filter((F.col("outcome") != "skipped") & F.col("parser_attempted").isNotNull())
    return tried.groupBy(F.col("parser_attempted").alias("parser")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.round(F.avg("metadata.confidence"), 4).alias("mean_confidence"),
    )


def audit_trail(e: DataFrame) -> DataFrame:
    """Per event: which parser made it, how sure it was, and the untouched line."""
    return e.select(
        "event_id", F.col("metadata.parser").alias("parser"),
        F.col("metadata.source_format").alias("source_format"),
        F.col("metadata.confidence").alias("confidence"),
        F.col("metadata.schema_version").alias("schema_version"),
        F.col("metadata.processed_at").alias("processed_at"), "raw_event",
    )


def processing_report(b: DataFrame) -> DataFrame:
    """Totals over all recorded batches."""
    return b.agg(
        F.count("*").alias("batches"), F.sum("total_events").alias("total_events"),
        F.sum("normalized_count").alias("normalized_count"),
        F.sum("failed_count").alias("failed_count"),
        F.round(F.sum("processing_time_seconds"), 4).alias("processing_time_seconds"),
    )
