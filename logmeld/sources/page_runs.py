"""A table kept in page order, so that any page opens only the runs it lies in.

``<path>/rows`` holds the rows dealt by ranges of (order column, event_id) into parts, a file each, and cut there into runs by their place; ``<path>/runs``
has one row per run: how many rows it holds and how many stand before it; ``<path>/columns`` has none, but tells the columns where there are no rows either.
A page finds its runs by those counts, and sorts and reads no more than them: the number of the run is kept with each row, and a data page of the file ends
where a run does. Runs may be as short as wanted: tasks and files follow the parts. The order is the one of ``search.page``.

Defined cases: rows without an order value come last where it descends and first where it ascends. Equal ids keep together, in any
order among themselves. An empty table has no runs; pages beyond the last are empty.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN, PART = "page_run", "page_part"
RUN_ROWS = 1_000_000
#: Rows of a part, where runs are shorter.
PART_ROWS = 100_000
#: Rows of a data page, where runs are longer.
PAGE_ROWS = 20_000
_PLACES = 33  # bits of a row's place in monotonically_increasing_id


def _order(order_by: str, descending: bool) -> list[Column]:
    return [F.desc(order_by) if descending else F.asc(order_by), F.asc("event_id")]


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def write_runs(t: DataFrame, path: str, rows: int = RUN_ROWS, order_by: str = "timestamp", descending: bool = True) -> None:
    """Writes ``t`` in runs of ``rows`` rows, the last one of a part shorter; the parts' bounds are drawn by Spark's range partitioning."""
    parts = max(1, -(-t.count() // max(rows, PART_ROWS)))
    order = _order(order_by, descending)
    dealt = t.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACES) - 1))
    dealt = dealt.withColumn(RUN, F.shiftleft(F.col(PART).cast("bigint"), _PLACES) + F.floor(place / rows))
    dealt.write.mode("overwrite").option("parquet.page.row.count.limit", min(rows, PAGE_ROWS)).partitionBy(PART).parquet(f"{path}/rows")
    dealt.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    counts = _rows(t.sparkSession, path).groupBy(PART, RUN).agg(F.count("*").alias("n"))
    # one row a part
    whole = counts.groupBy(PART).agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(whole.select(PART, before.alias("start")))
    inside = F.col(RUN).bitwiseAND(F.lit((1 << _PLACES) - 1)) * rows
    counts.join(starts, PART).select(
        RUN, "n", (F.col("start") + inside).alias("before"), F.lit(order_by).alias("order_by"), F.lit(descending).alias("descending"),
    ).write.mode("overwrite").parquet(f"{path}/runs")


def page_of_runs(spark: SparkSession, path: str, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of a table that ``write_runs`` wrote."""
    skip = (page - 1) * page_size
    touches = (F.col("before") < skip + page_size) & (F.col("before") + F.col("n") > skip)
    named = spark.read.parquet(f"{path}/runs").filter(touches).orderBy("before").collect()  # no more runs than a page has rows
    rows = _rows(spark, path)
    if not named:
        return rows.drop(RUN, PART).filter(F.lit(False))
    first, last = named[0], named[-1]
    opened = rows.filter(F.col(PART).between(first[RUN] >> _PLACES, last[RUN] >> _PLACES) & F.col(RUN).between(first[RUN], last[RUN]))
    return opened.orderBy(*_order(first["order_by"], first["descending"])).offset(skip - first["before"]).limit(page_size).drop(RUN, PART)


def page_info_of_runs(spark: SparkSession, path: str, page_size: int = 50) -> DataFrame:
    """(total, total_pages), from the counts of the runs."""
    total = spark.read.parquet(f"{path}/runs").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return total.select("total", F.ceil(F.col("total") / F.lit(page_size)).cast("bigint").alias("total_pages"))
