"""Pages of a table in runs are the pages of the whole table, and read no more than their runs."""

import pytest
from pyspark.sql import functions as F

from logmeld.operators import search
from logmeld.sources import page_runs
from tests.test_lookup import rows_read


@pytest.fixture(scope="module")
def t(spark):
    rows = spark.range(1003).select(
        F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("event_id"),
        F.when(F.col("id") % 50 != 0, F.timestamp_seconds(1_700_000_000 + F.col("id") * 37 % 90)).alias("timestamp"))  # ties and nulls
    return rows


@pytest.mark.parametrize("descending", [True, False])
def test_every_page(spark, t, tmp_path, descending):
    path = str(tmp_path / "runs")
    page_runs.write_runs(t, path, rows=150, descending=descending)
    ids = lambda df: [r.event_id for r in df.collect()]
    for number, size in ((1, 50), (2, 50), (11, 50), (21, 50), (22, 50), (1, 400), (3, 1), (1, 5000)):
        assert ids(page_runs.page_of_runs(spark, path, number, size)) == ids(search.page(t, number, size, descending=descending)), (number, size)
    assert page_runs.page_info_of_runs(spark, path, 50).first() == search.page_info(t, 50).first()


def test_a_page_opens_its_runs_only(spark, t, tmp_path):
    path = str(tmp_path / "runs")
    page_runs.write_runs(t, path, rows=100)
    runs = {r.page_run: r for r in spark.read.parquet(f"{path}/runs").collect()}
    assert sum(r.n for r in runs.values()) == 1003 and len(runs) > 5
    for number in (1, 10, 20):
        low, high = (number - 1) * 50, number * 50
        touched = sum(r.n for r in runs.values() if r.before < high and r.before + r.n > low)
        assert rows_read(page_runs.page_of_runs(spark, path, number, 50)) <= touched < 600


def test_empty(spark, t, tmp_path):
    path = str(tmp_path / "runs")
    page_runs.write_runs(t.limit(0), path)
    assert page_runs.page_info_of_runs(spark, path).first() == (0, 0)
    assert page_runs.page_of_runs(spark, path, 1, 50).collect() == [] and page_runs.page_of_runs(spark, path).columns == t.columns


def test_short_runs_make_no_tasks_of_their_own(spark, t, tmp_path):
    path = str(tmp_path / "runs")
    page_runs.write_runs(t, path, rows=5)
    assert len([*(tmp_path / "runs" / "rows").rglob("*.parquet")]) <= 2
    assert spark.read.parquet(f"{path}/runs").count() == 201
    assert [r.event_id for r in page_runs.page_of_runs(spark, path, 7, 20).collect()] == [r.event_id for r in search.page(t, 7, 20).collect()]


def test_pages_across_parts(spark, t, tmp_path, monkeypatch):
    monkeypatch.setattr(page_runs, "PART_ROWS", 200)
    path = str(tmp_path / "runs")
    page_runs.write_runs(t, path, rows=30)
    assert len([*(tmp_path / "runs" / "rows").glob("page_part=*")]) > 3
    for number, size in ((1, 50), (5, 50), (21, 50), (2, 300), (1, 2000), (40, 50)):
        assert [r.event_id for r in page_runs.page_of_runs(spark, path, number, size).collect()] == [r.event_id for r in search.page(t, number, size).collect()]
