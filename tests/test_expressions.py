"""Helpers, hostile sizes, and operators against brute force on small inputs."""

import csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from logmeld.functions.entries import entry, last_wins
from logmeld.functions.network import is_ip, is_private
from logmeld.functions.text import WHITESPACE, strip, text_class
from logmeld.functions.timestamps import iso_text, parse_timestamp
from logmeld.operators import cef, delimited
from logmeld.sources import text_lines, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_strip_agrees_with_python(spark):
    for text in ["  a b ", " x　", "\x1cy\x85", "", "\t\n", "z"]:
        assert one(spark, strip(F.lit(text))) == text.strip()
    assert all(ch.isspace() for ch in WHITESPACE)


def test_text_class_leaves_out_space_and_exclusions(spark):
    for ch, hit in [("a", True), (",", False), (" ", False), (" ", False), ("\xa0", False), ("中", True), ("\U0001f600", True)]:
        assert one(spark, F.lit(ch).rlike(f"^{text_class(',')}$")) is hit


def test_last_wins(spark):
    pairs = F.array(*[entry(k, F.lit(v)) for k, v in [("a", "1"), ("b", "2"), ("a", "3"), ("a", "4")]])
    assert one(spark, last_wins(pairs)) == {"a": "4", "b": "2"}


@pytest.mark.parametrize("text, expected", [
    ("2026-09-28T14:00:00Z", "2026-09-28T14:00:00"), ("2026-09-28 14:00", "2026-09-28T14:00:00"), ("2026-09-28", "2026-09-28T00:00:00"),
    ("2026-09-28T14:00:00.25+05:30", "2026-09-28T08:30:00.250000"), ("Sep  8 01:02:03", "2024-09-08T01:02:03"),
    ("Sep 8 01:02:03 2020", "2020-09-08T01:02:03"), ("2026/09/28 14:00:00", "2026-09-28T14:00:00"),
    ("28/Sep/2026:14:00:00 +0200", "2026-09-28T12:00:00"), ("1700000000", "2023-11-14T22:13:20"), ("1700000000123", "2023-11-14T22:13:20.123000"),
    ("1700000000123456", "2023-11-14T22:13:20.123456"), ("1700000000.5", "2023-11-14T22:13:20.500000"), ("14:00:00", None), ("2026", "1970-01-01T00:33:46"),
    ("Sep 31 01:02:03", None), ("Foo 3 01:02:03", None), ("", None),
])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps(spark, text, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        micros = one(spark, F.unix_micros(parse_timestamp(F.lit(text), F.lit(2024))))
        iso = one(spark, iso_text(F.timestamp_micros(F.lit(micros)))) if micros is not None else None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = None if micros is None else (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)).isoformat()
    assert got == expected
    assert iso is None or iso == expected + "+00:00"


def test_addresses(spark):
    good = ["1.2.3.4", "255.255.255.255", "::1", "fe80::", "2001:db8:0:0:0:0:0:1"]
    for text in good:
        assert one(spark, is_ip(F.lit(text)))
    for text in ["1.2.3", "256.1.1.1", "a::b:c", "x", "1.2.3.4.5"]:
        assert not one(spark, is_ip(F.lit(text)))
    private = {"10.1.1.1": True, "172.16.0.1": True, "172.32.0.1": False, "192.168.9.9": True, "127.0.0.1": True, "8.8.8.8": False, "::1": False, "": True}
    for text, expected in private.items():
        assert one(spark, is_private(F.lit(text))) is expected
    assert one(spark, is_private(F.lit(None).cast("string"))) is True


def test_very_long_values(spark):
    long = "CEF:0|a|b|c|d|e|1|msg=" + "word " * 40_000 + "act=deny"
    df = spark.createDataFrame([(long,)], "line string")
    row = cef.cef_pairs(cef.parse_cef(df)).first()
    assert row.fields["act"] == "deny" and len(row.fields["msg"]) == 199_999
    wide = ",".join(f'"{i}""{i}"' for i in range(20_000))
    cells = one(spark, delimited.cells(F.lit(wide), F.lit(",")))
    assert len(cells) == 20_000 and cells[7] == '7"7'


def test_cells_agree_with_python_csv(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choice('ab ,;"|\t1') for _ in range(rng.randint(1, 25))) for _ in range(400)]
    lines = [x.strip() for x in lines if x.strip()]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for d in [",", ";", "\t", "|"]:
        got = df.select("line", delimited.cells(F.col("line"), F.lit(d)).alias("c")).collect()
        for r in got:
            assert r.c == next(csv.reader(io.StringIO(r.line), delimiter=d)), r.line


def test_header_paths_agree_with_brute_force(spark):
    rng = random.Random(3)
    data, expected, head = [], [], {}
    for i in range(600):
        f = rng.choice(["hot", "hot", "hot", "a", "b"])
        if rng.random() < 0.03:
            names = rng.choice([["time", "user", "x"], ["user", "time", "x"]])
            data.append((f, i, names))
            head[f] = names
        else:
            data.append((f, i, [f"v{i}", "w", "z"]))
            expected.append((i, head.get(f)))
    df = spark.createDataFrame(data, "file_path string, line_no long, cells array<string>")
    for carried in (delimited.with_headers(df), delimited.with_headers_shuffled(df, block=50)):
        got = {r.line_no: r.header for r in carried.collect()}
        assert all(got[i] == h for i, h in expected)


def test_line_numbers_across_splits(spark, tmp_path):
    text = [f"line {i} {'x' * (i % 50)}" for i in range(3000)]
    (tmp_path / "a.log").write_bytes("\r\n".join(text).encode() + b"\n\xff\xfe bad\n")
    (tmp_path / "b.log").write_text("only\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = text_lines.read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    numbered = {r.line_no: r.line for r in rows if r.file_path.endswith("a.log")}
    assert [numbered[i + 1] for i in range(3000)] == [t.strip() for t in text] and len(rows) == 3002
    assert [r.line_no for r in rows if r.file_path.endswith("b.log")] == [1]


def test_explode_lines(spark):
    df = spark.createDataFrame([(1, " a \r\n\n b\x85c"), (2, "  ")], "id int, t string")
    got = [(r.id, r.line_no, r.line) for r in text_lines.explode_lines(df, "t").orderBy("id", "line_no").collect()]
    assert got == [(1, 1, "a"), (1, 3, "b"), (1, 4, "c")]
    with pytest.raises(ValueError):
        text_lines.require_lines(text_lines.explode_lines(df.filter("id = 2"), "t"))


def test_latest_by_key_and_align(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "event_id string, created_at int, v string")
    assert sorted((r.event_id, r.v) for r in writers.latest_by_key(df, "event_id", "created_at").collect()) == [("a", "y"), ("b", "z")]
    new = spark.createDataFrame([("c", 1, "w", "system", 5)], "event_id string, created_at int, v string, category string, risk_score int")
    rows = {r.event_id: (r.category, r.risk_score) for r in writers.align_schema(df, new).collect()}
    assert rows == {"a": ("network", 0), "b": ("network", 0), "c": ("system", 5)}
