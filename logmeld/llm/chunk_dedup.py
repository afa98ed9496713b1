"""Substring dedup: content-defined chunks, deduplicated by digest.

A gear hash rolls over the bytes (16 of them count); a chunk ends where the hash is the greatest within REACH bytes on
either side. Chunks are therefore REACH + 1 bytes or longer, about twice that as a rule, and an inserted byte moves the ends near it only.

The unit that is looked up is a pair of neighbouring chunks. A pair met before (in the order of document id, then place) is a
repeat. Repeats in a row that hold ``min_words`` whole words or more are removed, from the first word that begins in
them to the last that ends in them; the first occurrence stays. Shorter repeats, such as licence lines, stay.

Digests are counted alone; only pairs that occur twice are shuffled again, with their places. What is found is joined to the texts
by document.

Defined cases: null texts stay null, empty ones empty. Rows equal in id and text are one document and lose the same. Rows
without an id come first in the order. Periodic text has no chunk ends and is one chunk. Extra columns pass through; columns
named like the new ones are replaced. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logmeld.llm.common import fresh, written

REACH = 16
#: A passage of over 50 words keeps this many, and more, in whole pairs of chunks.
MIN_WORDS = 25
NEW = ("n_repeats", "removed_words")

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _back(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[by:] = x[:-by] if by < len(x) else 0
    return out


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: h = 4 h + G[byte] in 32 bits, so that 16 bytes count."""
    h = _GEAR[data]
    for by in (1, 2, 4, 8):
        if by < len(h):
            h = h + (_back(h, by) << np.uint32(2 * by))
    return h


def chunk_ends(text: bytes) -> np.ndarray:
    """Ends of the chunks, the end of the text included."""
    n = len(text)
    if n <= 2 * REACH:
        return np.array([n] if n else [], np.int64)
    h = gear(np.frombuffer(text, np.uint8))
    far = np.zeros(n + 2 * REACH, np.uint32)
    far[REACH : REACH + n] = h
    for by in (1, 2, 4, 8):  # far[i] becomes the greatest of REACH values from i on
        np.maximum(far[:-by], far[by:], out=far[:-by])
    ends = np.flatnonzero((h > far[:n]) & (h >= far[REACH + 1 : REACH + 1 + n])) + 1
    return ends if len(ends) and ends[-1] == n else np.append(ends, n)


def pair_digests(text: bytes, ends: np.ndarray) -> np.ndarray:
    """A digest for each pair of neighbouring chunks."""
    if len(ends) < 2:
        return np.zeros(0, np.int64)
    cuts = [0, *ends.tolist()]
    d = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(cuts, cuts[1:])), np.uint64, len(ends))
    x = (d[:-1] * _P) ^ (d[1:] >> np.uint64(7)) ^ (d[1:] * _Q)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [pair_digests(t, chunk_ends(t)) if t else None for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("id"), pa.array(digests, pa.list_(pa.int64()))], ["key", "id", "digests"])


def removed(text: bytes, repeats: list[int], min_words: int) -> tuple[bytes, int]:
    """The text without its runs of repeated pairs, and the words taken out."""
    cuts = [0, *chunk_ends(text).tolist()]
    runs, out, done, words = [], [], 0, 0
    for at in sorted(repeats):
        if runs and at <= runs[-1][1]:
            runs[-1][1] = at + 2
        else:
            runs.append([at, at + 2])
    data = np.frombuffer(text, np.uint8)
    for first, last in runs:
        a, b = cuts[first], cuts[last]
        white = np.flatnonzero(_WHITE[data[a:b]])
        if a > 0 and not _WHITE[data[a - 1]]:
            a = b if not len(white) else a + int(white[0])
        if b < len(data) and not _WHITE[data[b]]:
            b = a if not len(white) else max(a, cuts[first] + int(white[-1]))
        n = len(text[a:b].split())
        if n >= min_words:
            out.append(text[done:a])
            done, words = b, words + n
    return b"".join([*out, text[done:]]), words


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeats taken out of the text, and n_repeats (repeated pairs) and removed_words."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW])
    key, at_name = fresh(docs, "key", "repeats")
    t, i = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    keyed = docs.withColumn(key, F.xxhash64(i, F.md5(t.cast("binary"))))
    kind = docs.schema[doc_id].dataType.simpleString()
    digested = keyed.select(F.col(key).alias("key"), i.alias("id"), t.alias("text")).mapInArrow(
        _digested, f"key long, id {kind}, digests array<long>")
    digested = written(digested, "chunk-digests")
    twice = written(
        digested.select(F.explode("digests").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d"), "chunk-twice")
    places = digested.select("key", "id", F.posexplode("digests").alias("at", "d")).join(twice, "d", "left_semi")
    places = written(places, "chunk-places")
    firsts = written(places.groupBy("d").agg(F.min(F.struct("id", "key", "at")).alias("f")).select("d", "f.key", "f.at").toDF("d", "f_key", "f_at"), "chunk-firsts")
    repeats = places.join(firsts, "d").filter("key <> f_key or at <> f_at").select("key", "at").distinct()
    repeats = written(repeats.groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("at")), "chunk-repeats")
    found = keyed.join(repeats.toDF(key, at_name), key, "left").drop(key)
    schema = StructType([*docs.schema.fields, *[StructField(name, LongType()) for name in NEW]])
    names = [f.name for f in docs.schema.fields]

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name) for name in names]
            given, marks = batch.column(text), batch.column(at_name).to_pylist()
            raw, texts, counts, words = given.cast(pa.binary()).to_pylist(), [], [], []
            for x, marked in zip(raw, marks):
                new, n = removed(x, marked, min_words) if marked and x else (x, 0)
                texts.append(new)
                words.append(n)
                counts.append(len(marked or ()))
            columns[names.index(text)] = pa.array(texts, pa.binary()).cast(given.type)
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.int64()) for c in (counts, words)]], [*names, *NEW])

    return found.mapInArrow(taken, schema)
