"""Daily figures kept beside a table of events: the dashboard reads them in place of the events.

Each batch writes the counts of its own rows once, in a folder of its own; counts of days and batches add up, so the answer is
exact, top addresses too. A batch that runs again replaces its folder. Events that an upsert changes need the figures of their batch anew.

Defined cases: an empty batch adds nothing. Rows without a time count in every answer that names no days. Before the first batch there are no figures.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeld.operators.analytics import daily_figures

SCHEMA = "day date, metric string, key string, count bigint, batch string"


def write_batch(t: DataFrame, q: DataFrame, path: str, batch: str) -> None:
    """Adds the figures of a batch's events and failed lines under the batch's name."""
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", batch):
        raise ValueError("a batch is named by letters, digits, dots, dashes and underscores, no dot first")
    daily_figures(t, q).select("day", "metric", "key", "count").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_figures(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """(day, metric, key, count, batch) of all batches, or of the days from ``since`` to before ``until``."""
    figures = spark.read.schema(SCHEMA).parquet(path)
    if since is not None:
        figures = figures.filter(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        figures = figures.filter(F.col("day") < F.lit(until).cast("date"))
    return figures
