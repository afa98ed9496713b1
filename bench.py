"""Headline timings, one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.

Lines are rendered from ``events`` once and stored; timed work starts at that table. ``ingest``
is the whole of ``process`` (detect, parse, normalise, score, validate) into one parquet table by
outcome. The first pass over the lines warms the JVM and is reported as ``cold``; ``x10`` runs
over ten copies of every line under ten file names.
"""

import json
import os
import time

from pyspark.sql import functions as F

from logmeld.operators import analytics, search
from logmeld.plans import fixture_lines as fx
from logmeld.plans.process import process
from logmeld.session import build_session, scratch_path
from logmeld.sources import writers
from logmeld.sources.tables import flatten_events

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
COPIES = 10


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(CPUS), "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")

    def stored(df, name):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    lines = stored(fx.log_lines(spark, SF_DIR).repartition(CPUS), "lines")
    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    many = stored(
        lines.withColumn("copy", copies).repartition(CPUS)
        .select("line", F.concat_ws("-", "file_path", "copy").alias("file_path"), "line_no"), "many")
    n, m = lines.count(), many.count()

    outcomes = []

    def ingest(source):
        path = scratch_path(spark, "outcomes")
        writers.write_outcomes(process(source, ingest_ts=fx.INGEST_TS, ref_year=fx.REF_YEAR), path)
        outcomes.append(path)

    seconds = {"ingest_cold": timed(lambda: ingest(lines)), "ingest": timed(lambda: ingest(lines))}
    seconds["ingest_x10"] = timed(lambda: ingest(many))
    one_format = process(many, ingest_ts=fx.INGEST_TS, ref_year=fx.REF_YEAR, headers=None)
    seconds["ingest_x10_no_sink"] = timed(lambda: one_format.write.format("noop").mode("overwrite").save())

    events, failed = writers.read_outcomes(spark, outcomes[-1])
    flat_path = scratch_path(spark, "flat")
    seconds["write_events_x10"] = timed(lambda: flatten_events(events).write.parquet(flat_path))
    t = spark.read.parquet(flat_path)
    for name, df in {
        "analytics_x10": lambda: analytics.analytics(t, failed),
        "top_source_ips_x10": lambda: search.top_k(t, "source_ip", 7),
        "search_page_x10": lambda: search.page(search.filter_events(t, search="scan", action="deny"), 1, 50),
        "filter_page_x10": lambda: search.page(search.filter_events(t, protocol="UDP", severity="high", canonical=True), 2, 50),
        "event_frequency_x10": lambda: analytics.event_frequency(t),
        "threat_types_x10": lambda: analytics.threat_types(t),
    }.items():
        df().collect()
        seconds[name] = timed(lambda: df().collect())

    print(json.dumps({
        "metric": f"ingest {m} raw lines end to end, warm, {CPUS} cores", "value": seconds["ingest_x10"], "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "lines": n, "lines_x10": m, "lines_per_second": round(n / seconds["ingest"]),
        "lines_per_second_x10": round(m / seconds["ingest_x10"]),
    }))


if __name__ == "__main__":
    main()
