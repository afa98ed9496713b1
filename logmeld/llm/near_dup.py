"""MinHash near-duplicates: bands of minima find candidates, packed low bits estimate them, full sets confirm them.

A document's set holds its distinct 5-word shingles, as 64-bit hashes. Documents with equal sets form a class, named by 64
bits of the set's digest. Classes are linked where intersection / union is THRESHOLD per cent or more.

1. One pass over the texts gives each document its class, the hashes of BANDS bands of ROWS minima, and BITS low bits of all
   minima, packed plane by plane.
2. Buckets with two classes or more are kept, and of buckets with equal members one.
3. Each bucket's most met class (its pivot) is compared with the others: pairs grow with the memberships, not with their square.
   The low bits, corrected for chance collisions, drop pairs far below the threshold; the full sets decide.
4. Buckets whose classes are not all connected by then are searched inside tasks, in blocks of bounded size: what lies outside a
   bucket's main component is compared with its other members, and one link between two components is enough. No pair leaves the
   task but confirmed links.
5. Components by alternating stars, whose edges are written after each step.

A pair at the threshold shares no band with a chance below 3 in 10 million.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing. Repeated rows and equal texts share a
class. Documents without an id take part, but do not name a component while another document can. Extra columns do not matter
to ``near_duplicates``; ``keep_one`` passes them through. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logmeld.llm.common import fresh, written
from logmeld.llm.word_hash import WordHashes, shingle_set

THRESHOLD = 75
ROWS, BANDS, BITS = 4, 40, 2
MINIMA = ROWS * BANDS
WORDS = -(-MINIMA // 64)
PAD = 64 * WORDS - MINIMA
#: Estimates are this far off, or more, once in a thousand million pairs.
SLACK = 0.25
#: Members of a bucket in one block of step 4, on either side, and the shingles they hold (8 bytes each).
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Ids that may be broadcast: 8 bytes each.
BROADCAST_IDS = 1_000_000

_random = np.random.default_rng(20240)
_A = _random.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, MINIMA, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 256):
        np.minimum(low, (shingles[a : a + 256, None] * _A + _B).min(0), out=low)
    return low >> np.uint64(32)


def planes(low: np.ndarray) -> np.ndarray:
    """BITS x WORDS longs: bit j of plane p is bit p of minimum j."""
    bits = np.zeros((BITS, 64 * WORDS), np.uint8)
    for p in range(BITS):
        bits[p, :MINIMA] = (low >> np.uint64(p)) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def band_keys(low: np.ndarray) -> list[int]:
    rows = low.astype("<u4").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[b].tobytes(), seed=b) for b in range(BANDS)]


def class_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


_LONGS = pa.list_(pa.int64())


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        n, cid, bands, packed, key = [], [], [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            s = shingle_set(text, hashes)
            n.append(len(s))
            key.append(hashlib.md5(text or b"").digest())
            cid.append(class_id(s) if len(s) else None)
            low = minima(s) if len(s) else None
            bands.append(None if low is None else _signed(band_keys(low)))
            packed.append(None if low is None else _signed(planes(low)))
        ids = [None if c is None else c - 2**64 if c >= 2**63 else c for c in cid]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(ids, pa.int64()),
             pa.array(bands, _LONGS), pa.array(packed, _LONGS)], ["id", "text_key", "n", "cid", "bands", "planes"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(text, hashes) for text in batch.column("text").cast(pa.binary()).to_pylist()]
        sets = [s for s in sets if len(s)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(_signed([class_id(s) for s in sets]), pa.int64()), pa.array([s.view(np.int64) for s in sets], _LONGS)], ["cid", "s"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: equal minima less those that agree by chance."""
    equal = F.lit(-PAD)
    for w in range(WORDS):
        differ = F.lit(0).cast("long")
        for p in range(BITS):
            differ = differ.bitwiseOR(F.get(a, F.lit(p * WORDS + w)).bitwiseXOR(F.get(b, F.lit(p * WORDS + w))))
        equal = equal + 64 - F.bit_count(differ)
    chance = 2.0**-BITS
    return (equal / MINIMA - chance) / (1 - chance)


def linked(shared: Column, n_a: Column, n_b: Column) -> Column:
    return 100 * shared >= THRESHOLD * (n_a + n_b - shared)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for nodes of edges (a, b) of longs: root is the least node reachable. Alternating large and small stars."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "stars")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "stars")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the members of smaller components in a block and the block's others, until nothing is left to connect."""
    group = group.drop_duplicates(["cid", "rest"]).reset_index(drop=True)
    cid, root, rest = (group[c].to_numpy() for c in ("cid", "root", "rest"))
    sig = np.stack(group["planes"].to_list()).view(np.uint64).reshape(len(group), BITS, WORDS)
    n, sets = group["n"].to_numpy(), [np.asarray(s) for s in group["s"]]
    parent = {r: r for r in root}

    def find(r):
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    out, whole = [], np.flatnonzero(~rest)
    for x in np.flatnonzero(rest):
        others = whole[(4 * n[whole] >= 3 * n[x]) & (4 * n[x] >= 3 * n[whole]) & (root[whole] != root[x])]
        differ = np.bitwise_or.reduce(sig[others] ^ sig[x], axis=1)
        equal = 64 * WORDS - PAD - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        guess = (equal / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)
        likely = guess >= THRESHOLD / 100 - SLACK
        for y in others[likely][np.argsort(-guess[likely], kind="stable")]:
            a, b = find(root[x]), find(root[y])
            if a != b:
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * shared >= THRESHOLD * (n[x] + n[y] - shared):
                    parent[a] = b
                    out.append((cid[x], cid[y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _one_of_each(rows: DataFrame) -> DataFrame:
    """Distinct rows (bkey, cid) of one bucket among those with equal members. Members are told by two 64-bit hashes, which no size overflows."""
    prints = rows.groupBy("bkey").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y"))
    chosen = written(prints.groupBy("size", "x", "y").agg(F.min("bkey").alias("bkey")).select("bkey", "size"), "near-buckets")
    return rows.join(chosen, "bkey")


def class_links(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes: enough to connect each component."""
    rows = signed.filter("n > 0").select("cid", "n", F.explode("bands").alias("bkey"))
    shared = rows.groupBy("bkey").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo <> hi").select("bkey")
    shared = written(shared, "near-shared")
    rows = written(rows.join(shared, "bkey", "left_semi").distinct(), "near-rows")
    rows = written(_one_of_each(rows), "near-rows")

    # full sets of the classes in these buckets, each from one of its documents
    met = written(rows.groupBy("cid").agg(F.sum("size").alias("met"), F.first("n").alias("n"), F.collect_list("bkey").alias("bkeys")), "near-met")  # BANDS keys at most
    few = met.count() <= BROADCAST_IDS
    bound = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    chosen = signed.join(bound(met.select("cid")), "cid", "left_semi").groupBy("cid").agg(
        F.min(F.xxhash64("id")).alias("kid"), F.first("n").alias("n"), F.first("planes").alias("planes"))
    chosen = written(chosen, "near-chosen")
    texts = docs.withColumn("kid", F.xxhash64("id")).join(bound(chosen.select("kid").distinct()), "kid", "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "cid long, s array<long>").join(bound(chosen.select("cid")), "cid", "left_semi")
    sets = written(sets.dropDuplicates(["cid"]), "near-sets")

    # the pivot of each bucket with the others
    rows = met.select("cid", "n", "met", F.explode("bkeys").alias("bkey"))
    pivots = written(rows.groupBy("bkey").agg(F.max_by("cid", F.struct("met", "cid")).alias("pivot")), "near-pivots")
    rows = rows.join(pivots, "bkey").filter("cid <> pivot").select("bkey", "cid", "n", "pivot")
    pairs = rows.select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    side = lambda c: chosen.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("planes").alias(f"p_{c}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        "4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a").filter(estimate(F.col("p_a"), F.col("p_b")) >= THRESHOLD / 100 - SLACK)
    likely = written(likely.select("a", "b", "n_a", "n_b"), "near-likely")
    full = lambda c: sets.select(F.col("cid").alias(c), F.col("s").alias(f"s_{c}"))
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    edges = likely.join(full("a"), "a").join(full("b"), "b").filter(linked(shared, F.col("n_a"), F.col("n_b"))).select("a", "b")
    edges = written(edges, "near-edges")

    # what is left in buckets of several components
    roots = written(components(edges), "near-roots")
    rows = rows.join(roots, F.col("cid") == F.col("node"), "left").select("bkey", "cid", "n", F.coalesce("root", "cid").alias("root"))
    rows = written(rows, "near-open")
    tally = rows.groupBy("bkey", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    most = F.max_by(F.struct("root", "k", "n"), F.struct("k", "root"))
    still = tally.groupBy("bkey").agg(most.alias("most"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"))
    parts = lambda k, n: F.greatest(F.ceil(k / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    still = written(still.filter("roots > 1").select(
        "bkey", F.col("most.root").alias("main"), parts(F.col("k"), F.col("n")).alias("i_parts"),
        parts(F.col("k") - F.col("most.k"), F.col("n") - F.col("most.n")).alias("j_parts")), "near-open")
    rows = written(rows.join(still, "bkey"), "near-open")
    # each member once for each block of the smaller components' members, these once for each block of all
    opened = _one_of_each(rows.select("bkey", "cid")).join(rows, ["bkey", "cid"])
    own = lambda parts: F.pmod(F.xxhash64("cid", "bkey"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    whole = opened.select("bkey", "cid", "root", F.lit(False).alias("rest"), own("i_parts").alias("i"), every("j_parts").alias("j"))
    smaller = opened.filter("root <> main").select(
        "bkey", "cid", "root", F.lit(True).alias("rest"), own("j_parts").alias("j"), every("i_parts").alias("i"))
    opened = whole.unionByName(smaller).join(written(chosen.select("cid", "n", "planes").join(sets, "cid"), "near-members"), "cid")
    more = opened.groupBy("bkey", "i", "j").applyInPandas(_block_links, "a long, b long")
    return edges.unionByName(written(more, "near-more"))


def _table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, text_key (MD5 of the text), n_shingles, component_id, kept."""
    docs = _table(docs, doc_id, text)
    kind = docs.schema["id"].dataType.simpleString()
    signed = docs.mapInArrow(_signatures, f"id {kind}, text_key binary, n long, cid long, bands array<long>, planes array<long>")
    signed = written(signed, "near-signed")
    roots = written(components(class_links(signed, docs)), "near-roots")
    least = signed.filter("n > 0").groupBy("cid").agg(F.min("id").alias("least"))
    named = least.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    named = written(named, "near-named")
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(firsts, "root").select("cid", "component_id"), "near-named")
    out = signed.select("id", "text_key", "n", "cid").join(named, "cid", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(doc_id), "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, and of each repeated row."""
    kept = near_duplicates(docs, doc_id, text).filter("kept").select(F.xxhash64(doc_id, "text_key").alias("row_key")).distinct()
    key, = fresh(docs, "row_key")
    kept = written(kept, "near-kept").withColumnRenamed("row_key", key)
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{doc_id}`"), F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
