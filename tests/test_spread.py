"""Rows of one row group are worked on by many tasks."""

from pyspark.sql import functions as F

from logmeld import session
from logmeld.plans import fixture_lines as fx


def test_a_row_group_is_dealt_over_tasks(spark, tmp_path):
    n = 4 * session.TASK_ROWS
    spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.5).alias("value"),
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    lines = fx.log_lines(spark, str(tmp_path))
    sizes = [r["n"] for r in lines.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n + 4 and max(sizes) <= 1.1 * session.TASK_ROWS


def test_spread_keeps_every_row(spark):
    rows = spark.range(1000).select((F.col("id") % 10).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"))
    dealt = session.spread(rows, 30)
    assert dealt.rdd.getNumPartitions() >= 34
    assert dealt.exceptAll(rows).count() == 0 and dealt.count() == 1000
    assert session.spread(rows.limit(0)).count() == 0
