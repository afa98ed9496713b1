"""Sharding: a keyed permutation of global row numbers deals rows into shards and slots.

Every row gets a global number in 0..N-1, a Feistel network with cycle walking permutes the numbers, and the shard
and the place in it follow by division. Any row's place can be computed from its number, and the shuffle is the same
in every run, on every layout of the input files.

Law ``rows``: shard sizes differ by one at most; slots of a shard run from 0 without gaps.

Defined cases: rows equal in all columns are interchangeable and get consecutive numbers before the permutation; null
values are values like any other; an empty table gives an empty table. Extra columns pass through; columns named like the
new ones are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logmeld.llm.common import fresh

ROUNDS = 8
WALK = 16


def row_numbers(df: DataFrame, name: str = "row_number", total: str = "row_total", buckets: int = 4096, run: int = 100_000) -> DataFrame:
    """Numbers from 0 in the order (hash bucket, columns), and their count, as two more columns.

    Equal rows are counted before the shuffle, so a row repeated any number of times costs one row there; its run of
    numbers is dealt out afterwards in pieces of ``run``. Only the counts of the buckets are broadcast.
    """
    keys = [c for c in df.columns if c.lower() not in (name.lower(), total.lower())]
    bucket, copies, first, start, piece = fresh(df, "bucket", "copies", "first", "start", "piece")
    q = [F.col(f"`{k}`") for k in keys]
    groups = (
        df.groupBy(*q).agg(F.count(F.lit(1)).alias(copies))
        .withColumn(bucket, F.pmod(F.xxhash64(*q), F.lit(buckets)))
    )
    sizes = groups.groupBy(bucket).agg(F.sum(copies).alias(start))
    ahead = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select(
        bucket, F.coalesce(F.sum(start).over(ahead), F.lit(0)).alias(first), F.sum(start).over(whole).alias(total))
    inside = Window.partitionBy(bucket).orderBy(*q).rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        groups.withColumn(start, F.coalesce(F.sum(copies).over(inside), F.lit(0)))
        .join(F.broadcast(starts), bucket)  # one row a bucket: `buckets` bounds it
        .withColumn(start, F.col(first) + F.col(start))
    )
    single = numbered.filter(F.col(copies) == 1).withColumn(name, F.col(start))
    pieces = (
        numbered.filter(F.col(copies) > 1)
        .withColumn(piece, F.explode(F.sequence(F.lit(0), F.col(copies) - 1, F.lit(run))))
        .repartition(F.col(start), F.col(piece))
        .withColumn(name, F.explode(F.sequence(
            F.col(start) + F.col(piece), F.col(start) + F.least(F.col(piece) + run, F.col(copies)) - 1)))
    )
    out = [*q, F.col(name), F.col(total)]
    return single.select(*out).unionByName(pieces.select(*out))


def permute(df: DataFrame, number: str, total: str, name: str, seed: int = 0) -> DataFrame:
    """``df`` with the number's place under the permutation of 0..total-1 that ``seed`` picks, up to 2**52 rows.

    The halves live in Z_a and Z_b with a = ceil(sqrt(total)) and a*b >= total, so fewer than a numbers lie outside and
    a walk is rarely longer than one step. At most a*b - total steps can stay outside, which bounds the last fold.
    """
    at, dom_a, dom_b = fresh(df, "at", "dom_a", "dom_b")
    n = F.col(total)
    df = df.withColumn(dom_a, F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long")))
    df = df.withColumn(dom_b, F.greatest(F.expr(f"(`{total}` + `{dom_a}` - 1) div `{dom_a}`"), F.lit(1).cast("long")))

    def rounds(x: Column) -> Column:
        """One pass through the network, as one expression: the halves are kept in a struct folded over the rounds."""
        right = F.pmod(x, F.col(dom_b))
        start = F.struct(((x - right) / F.col(dom_b)).cast("long").alias("l"), right.alias("r"))
        done = F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start,
            lambda s, k: F.when(
                k % 2 == 0,
                F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, F.lit(seed)), F.col(dom_a)), F.col(dom_a)).alias("l"), s["r"].alias("r")),
            ).otherwise(
                F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], k, F.lit(seed)), F.col(dom_b)), F.col(dom_b)).alias("r"))))
        return done["l"] * F.col(dom_b) + done["r"]

    def walk(x: Column, steps: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), x, lambda at_, _: F.when(at_ < n, at_).otherwise(rounds(at_)))

    df = df.withColumn(at, rounds(F.col(number)))
    df = df.withColumn(at, F.when(F.col(at) < n, F.col(at)).otherwise(walk(F.col(at), F.lit(WALK).cast("long"))))
    outside = F.greatest(F.col(dom_a) * F.col(dom_b) - n, F.lit(1).cast("long"))
    df = df.withColumn(at, F.when(F.col(at) < n, F.col(at)).otherwise(walk(F.col(at), outside)))
    return df.withColumn(name, F.col(at)).drop(at, dom_a, dom_b)


def shard(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with columns shard (0..shards-1) and slot (from 0 in each shard)."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    number, total, place = fresh(df, "row_number", "row_total", "place")
    return (
        permute(row_numbers(df, number, total), number, total, place, seed)
        .withColumn("shard", F.pmod(F.col(place), F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"`{place}` div {shards}"))
        .drop(number, total, place)
    )
