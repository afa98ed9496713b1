"""Sessions against a plain loop, most rows on one address, sessions over many blocks."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logmeld.operators.sessions import sessions

BEGIN = datetime(2024, 1, 1)


def plain(rows, gap):
    out = {}
    for key, at in sorted((k, t) for k, t in rows if k and t is not None):
        runs = out.setdefault(key, [])
        if runs and at - runs[-1][1] < timedelta(seconds=gap):
            runs[-1][1:] = [at, runs[-1][2] + 1]
        else:
            runs.append([at, at, 1])
    return {(s, e + timedelta(seconds=gap), k, n) for k, runs in out.items() for s, e, n in runs}


def table(spark, rows):
    return spark.createDataFrame(
        [(None if t is None else int(t.replace(tzinfo=timezone.utc).timestamp() * 1_000_000), k) for k, t in rows], "at long, source_ip string"
    ).select(F.timestamp_micros("at").alias("timestamp"), "source_ip")


def found(df):
    rows = df.select(F.unix_micros("session_start"), F.unix_micros("session_end"), "source_ip", "n").collect()
    when = lambda us: datetime(1970, 1, 1) + timedelta(microseconds=us)
    assert len(rows) == len(set(rows))
    return {(when(a), when(b), k, n) for a, b, k, n in rows}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    at = lambda spread: BEGIN + timedelta(seconds=draw.randrange(spread))
    given = [("hot", at(40_000)) for _ in range(2_700)] + [(f"k{draw.randrange(9)}", at(40_000)) for _ in range(300)]
    given += [("even", BEGIN + timedelta(seconds=60 * k)) for k in range(20)]  # exactly a gap apart
    given += [("chain", BEGIN + timedelta(seconds=59 * k)) for k in range(200)]  # one session over many blocks
    given += [("old", datetime(1969, 12, 31, 23, 59, 50)), ("old", datetime(1970, 1, 1, 0, 0, 10))]
    return given + given[:50] + [(None, BEGIN), ("", BEGIN), ("k1", None)]


@pytest.mark.parametrize("cells", [1, 2, 7, 4096])
def test_sessions_agree_with_a_loop(spark, rows, cells):
    assert found(sessions(table(spark, rows), 60, "source_ip", cells=cells)) == plain(rows, 60)


def test_empty_and_nested(spark, rows):
    df = table(spark, rows)
    assert sessions(df.limit(0), 60, "source_ip").count() == 0
    nested = df.select("timestamp", F.struct("source_ip").alias("network"))
    assert found(sessions(nested, 60)) == plain(rows, 60)
