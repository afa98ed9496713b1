"""Streams of lines to events: the batch operators, run per micro-batch or on the stream itself."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeld.operators.normalize import EVENT_COLUMNS
from logmeld.plans.process import process
from logmeld.sources.text_lines import number_lines
from logmeld.sources.writers import ingest, write_outcomes


def stream_events(lines: DataFrame, ingest_ts=None, **options) -> DataFrame:
    """A stream of lines -> a stream of processed rows, without state.

    Header rows cannot be carried forward on a stream; name the cells with ``headers=[...]``, or
    use ``stream_process``, which carries them within each micro-batch.
    """
    options.setdefault("headers", None)
    return process(lines, ingest_ts=ingest_ts, **options)


def stream_process(lines: DataFrame, out: str, checkpoint: str, ingest_ts=None, trigger=None, batches: str | None = None, **options):
    """Run lines through ``process`` batch by batch into one table by outcome; returns the query.

    Every batch overwrites its own folder, so that a batch run again after a failure leaves no
    second copy. A file arrives whole in one batch, so lines of ``stream_log_lines`` get their numbers here,
    and with them ids of their own and the headers of their file. ``batches``: a table that gets a row for each batch, with the counts its
    writing has observed; a batch that runs again replaces its row.
    """

    def write(batch: DataFrame, number: int) -> None:
        if "_start" in batch.columns:
            batch = number_lines(batch.drop("line_no"))
        folder = f"{out}/batch={number}"
        if batches is None:
            write_outcomes(process(batch, ingest_ts=ingest_ts, **options), folder, "overwrite")
        else:
            ingest(batch, folder, batches, batch_id=f"stream_{number}", mode="overwrite", ingest_ts=ingest_ts, **options)

    return (
        lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_counts(
    events: DataFrame, every: str = "1 hour", watermark: str = "10 minutes",
    slide: str | None = None, key: str | None = None,
) -> DataFrame:
    """Events per window (tumbling, or sliding with ``slide``), optionally by a column."""
    window = F.window("timestamp", every, slide) if slide else F.window("timestamp", every)
    keys = [window.alias("w")] + ([F.col(key).alias("key")] if key else [])
    counts = events.withWatermark("timestamp", watermark).groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.select(
        F.col("w.start").alias("window_start"), *(["key"] if key else []), "n"
    )


def stream_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Events per source address and session. Events without an address belong to no session."""
    return (
        events.filter("network.source_ip is not null and network.source_ip <> ''").withWatermark("timestamp", watermark)
        .groupBy(F.session_window("timestamp", gap).alias("w"), F.col("network.source_ip").alias("source_ip"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "source_ip", "n")
    )


def stream_dedup(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The first copy of each event id; state is dropped once the watermark has passed."""
    return events.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["event_id"])


def only_events(processed: DataFrame) -> DataFrame:
    return processed.filter(F.col("outcome") == "event").select(*EVENT_COLUMNS)
