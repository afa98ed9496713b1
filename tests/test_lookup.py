"""Look-ups of single values read the row groups that may hold them, and no others."""

import pytest

from logmeld.operators import search
from logmeld.plans import inputs
from logmeld.sources import tables, writers

SF = "/root/testdata/sf0.001"


def rows_read(df) -> int:
    """Rows that the scans of a query put out: those of the row groups that were read."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        total += leaves.apply(i).metrics().apply("numOutputRows").value()
    return total


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookup") / "t")
    writers.write_lookup(inputs.events(spark, SF), path, rows=2_000, group_bytes=1 << 16)
    return tables.read_events(spark, path)


def test_an_absent_value_reads_nothing(table):
    n = table.count()
    assert n > 900 and rows_read(table.filter("event_id is not null")) == n
    # within the least and greatest id, so that only the bloom filters tell
    absent = [f"evt_{k}x" for k in range(100, 110)]
    assert sum(rows_read(search.event_by_id(table, i)) for i in absent) < n / 20
    assert rows_read(search.by_ip(table, source_ip="10.5.5.999")) == 0
    assert rows_read(search.by_ip(table, destination_ip="192.168.300.1")) == 0


def test_a_present_value_reads_its_row_groups(table):
    n, found = table.count(), search.event_by_id(table, "evt_42")
    assert rows_read(found) < n / 2 and found.count() == 1
    address = table.filter("source_ip is not null").first().source_ip
    assert search.by_ip(table, source_ip=address).count() == table.filter(table.source_ip == address).count() > 0


def test_filters_are_as_large_as_their_values_need(spark, tmp_path):
    path = tmp_path / "t"
    writers.write_lookup(inputs.events(spark, SF), str(path))  # some hundred rows a file; filters for 500,000 take 0.5 MB a column
    files = [f.stat().st_size for f in path.rglob("*.parquet")]
    assert files and max(files) < 400_000
