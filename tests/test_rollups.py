"""The dashboard from daily figures is the dashboard from the events."""

import pytest
from pyspark.sql import functions as F

from logmeld.operators import analytics as an
from logmeld.plans import inputs as src
from logmeld.sources import rollups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tq(spark):
    return src.flat(spark, SF), src.quarantine(spark, SF)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_appended_batches_add_up(spark, tq, tmp_path):
    t, q = tq
    path, part = str(tmp_path / "r"), F.pmod(F.xxhash64("event_id"), F.lit(2))
    for number in (0, 1, 0):  # the first runs twice
        rollups.write_batch(t.filter(part == number), q.filter(part == number), path, str(number))
        if number == 1:
            assert rows(an.analytics_of(rollups.read_figures(spark, path))) == rows(an.analytics(t, q))
    rollups.write_batch(t.limit(0), q.limit(0), path, "empty")
    assert rows(an.dashboard_of(an.analytics_of(rollups.read_figures(spark, path)))) == rows(an.dashboard(t, q))


def test_days_are_chosen(spark, tq, tmp_path):
    t, q = tq
    path = str(tmp_path / "r")
    timeless = t.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp"))
    rollups.write_batch(t.unionByName(timeless), q, path, "all")
    first, last = t.agg(F.min(F.to_date("timestamp")), F.max(F.to_date("timestamp"))).first()
    middle = first + (last - first) / 2
    within = lambda df: df.filter((F.to_date("timestamp") >= F.lit(first)) & (F.to_date("timestamp") < F.lit(middle)))
    some = within(t)
    assert 0 < some.count() < t.count()
    assert rows(an.analytics_of(rollups.read_figures(spark, path, first, middle))) == rows(an.analytics(some, within(q)))
    assert rows(an.analytics_of(rollups.read_figures(spark, path))) == rows(an.analytics(t.unionByName(timeless), q))


def test_names_stay_in_the_folder(spark, tq, tmp_path):
    with pytest.raises(ValueError):
        rollups.write_batch(*tq, str(tmp_path), "../x")
