"""Token counts of documents in flat token files without an index.

A token file is a run of ids, documents parted by an end id. It is held as blocks of a fixed number of ids, in files of any
length. Blocks are scanned on their own: one vectorised search for the end id gives the places of all ends. A prefix scan over blocks stitches
what blocks cut: the number of ends before a block, and the place of the last one, give each document its number and start.

The scan goes in two levels, so that a file with a third of all blocks is not one task: spans of SPAN blocks are
summed up first, then the spans of a file, then the blocks within their span.

``write_files`` writes such files from texts, ``blocks_of_files`` reads any: a task reads ranges of RUN blocks at their place in the file, so
no file's length bounds anything. Stores that pyarrow cannot open have ``pack`` (blocks as table rows), and files there are read whole.

Defined cases: null and empty texts are documents of no token. Files that do not end with an end id have an open last document, which
counts if it has a token. Empty tables give empty tables. Equal rows are documents of their own. Extra columns of texts are left out by
the writers; only their ids are kept, beside the files, in file order.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logmeld.llm.packed_ids import slices
from logmeld.session import scratch_path, written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The words a tokenizer of these ranks merges within: contractions, letters, digits, other signs, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
BLOCK = 1 << 15
SPAN = 256
#: Blocks that are read one after the other, and of these so many at once.
RUN, HELD = 128, 16
#: Bytes of texts that are encoded at once, or one text.
SLICE = 1_000_000
_IDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def tokenizer(ranks: str = RANKS):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _encoded(texts: pa.Array, encode, end: int) -> Iterator[np.ndarray]:
    """Ids of the texts with their ends, by SLICE bytes of text: a list of Python's numbers takes many times the room of what it holds."""
    for a, b in slices(texts, SLICE):
        ids: list[int] = []
        for t in texts.slice(a, b - a).to_pylist():
            ids.extend(encode(t) if t else ())
            ids.append(end)
        yield np.array(ids, "<u2")


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS, end: int = END, block: int = BLOCK) -> None:
    """Writes a token file for each partition of ``docs``: rows (file, block, ids as little-endian uint16) and (file, first, doc_ids)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks).encode_ordinary
        left, number, first = np.zeros(0, "<u2"), 0, 0
        file = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file = batch.column("file")[0].as_py()
            left = np.concatenate([left, *_encoded(batch.column("text"), encode, end)])
            cut = len(left) // block
            rows = [(file, number + k, left[k * block : (k + 1) * block].tobytes()) for k in range(cut)]
            left, number = left[cut * block :], number + cut
            yield out(rows, file, first, batch.column("id"))
            first += batch.num_rows
        if len(left):
            yield out([(file, number, left.tobytes())], file, None, None)

    def out(rows, file, first, names) -> pa.RecordBatch:
        n = len(rows)
        named = names is not None
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows] + [file] * named, pa.int64()),
            pa.array([r[1] for r in rows] + [None] * named, pa.int64()),
            pa.array([r[2] for r in rows] + [None] * named, pa.binary()),
            pa.array([None] * n + [first] * named, pa.int64()),
            pa.array([None] * n + ([names.to_pylist()] if named else []), ids_type),
        ], ["file", "block", "ids", "first", "doc_ids"])

    ids_type = pa.list_(_IDS[kind])
    named = docs.select(
        F.spark_partition_id().cast("long").alias("file"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    named.mapInArrow(packed, f"file long, block long, ids binary, first long, doc_ids array<{kind}>").write.option(
        "compression", "zstd").parquet(path)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    local = re.match(r"(?:file:/*(?=/))?(/.*)", path, re.S)
    if local:
        return pyarrow.fs.LocalFileSystem(), local[1]
    return pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@?=&%"))


def _opens(path: str) -> bool:
    try:
        _store(path)
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def write_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS, end: int = END) -> DataFrame:
    """Writes a flat file of little-endian uint16 ids into ``path`` for each partition of ``docs``: rows (file, path, length) and (file, first, doc_ids).

    Files of failed tasks stay in the folder; no row names them.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = pa.schema([("file", pa.int64()), ("path", pa.string()), ("length", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(_IDS[kind]))])

    def row(**values) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([values], schema)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, first, length = None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encode, file = tokenizer(ranks).encode_ordinary, batch.column("file")[0].as_py()
                store, root = _store(path)
                store.create_dir(root, recursive=True)
                name = f"{file:06d}-{uuid.uuid4().hex}.bin"
                out = store.open_output_stream(f"{root}/{name}")
            for ids in _encoded(batch.column("text"), encode, end):
                length += out.write(ids.tobytes())
            yield row(file=file, first=first, doc_ids=batch.column("id").to_pylist())
            first += batch.num_rows
        if out is not None:
            out.close()
            yield row(file=file, path=f"{path}/{name}", length=length)

    named = docs.select(
        F.spark_partition_id().cast("long").alias("file"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return written(named.mapInArrow(flat, f"file long, path string, length long, first long, doc_ids array<{kind}>"), "token-names")


def blocks_of_ranges(files: DataFrame, block: int = BLOCK, id_bytes: int = 2) -> DataFrame:
    """(file, block, ids) of files (file, path, length), by runs of RUN blocks: each is read where it lies, by whatever task has it."""
    size, run = block * id_bytes, RUN
    runs = files.filter("length > 0").select(
        "file", "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size * run}L"))).alias("run"))
    tasks = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / (size * run))), F.lit(1))).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, name = _store(r["path"])
                last = -(-r["length"] // size)
                with store.open_input_file(name) as f:
                    for a in range(r["run"] * run, min((r["run"] + 1) * run, last), HELD):
                        some = range(a, min(a + HELD, (r["run"] + 1) * run, last))
                        ids = [f.read_at(min(size, r["length"] - k * size), k * size) for k in some]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["file"]] * len(ids), pa.int64()), pa.array(list(some), pa.int64()), pa.array(ids, pa.binary())],
                            ["file", "block", "ids"])

    return runs.repartition(max(1, min(int(tasks), 20_000)), "file", "run").mapInArrow(read, "file long, block long, ids binary")


def blocks_of_files(spark: SparkSession, path: str, block: int = BLOCK, id_bytes: int = 2) -> DataFrame:
    """(file, block, ids) of flat files of uint16 or uint32 ids, of any length; in stores that pyarrow cannot open each is read whole."""
    size = block * id_bytes
    files = spark.read.format("binaryFile").load(path)
    if _opens(path):
        return blocks_of_ranges(files.select(F.xxhash64("path").alias("file"), "path", "length"), block, id_bytes)
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(greatest(length, 1) - 1) div {size}"))).alias("block")
    cut = files.select(F.xxhash64("path").alias("file"), cuts, "content").select(
        "file", "block", F.substring("content", F.col("block").cast("int") * size + 1, F.lit(size)).alias("ids"))
    return cut.filter(F.length("ids") > 0)


def _ends(end: int, dtype: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, places = [], []
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), dtype)
                size.append(len(ids))
                places.append(np.flatnonzero(ids == end).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(size, pa.int64()), pa.array(places, pa.list_(pa.int32()))],
                ["file", "block", "size", "ends"])

    return scan


def count_tokens(blocks: DataFrame, end: int = END, dtype: str = "<u2") -> DataFrame:
    """(file, doc, start, n_tokens): documents of each file by number, their place in the file and their tokens without the end."""
    scanned = blocks.select("file", "block", "ids").mapInArrow(_ends(end, dtype), "file long, block long, size long, ends array<int>")
    scanned = scanned.withColumn("span", F.expr(f"block div {SPAN}"))
    span_of = Window.partitionBy("file", "span").orderBy("block")
    ahead = span_of.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))  # place in its block
    inside = (
        scanned.withColumn("at", F.coalesce(F.sum("size").over(ahead), zero))
        .withColumn("before", F.coalesce(F.sum(F.size("ends")).over(ahead), zero))
        .withColumn("last", F.max(F.col("at") + last).over(ahead))
    )
    # one row a span; the running totals of a file go over SPAN times fewer rows than it has blocks
    spans = inside.groupBy("file", "span").agg(
        F.sum("size").alias("s_size"), F.sum(F.size("ends")).alias("s_ends"), F.max(F.col("at") + last).alias("s_last"))
    file_of = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("s_at", F.coalesce(F.sum("s_size").over(file_of), zero))
    spans = spans.select(
        "file", "span", "s_at", F.coalesce(F.sum("s_ends").over(file_of), zero).alias("s_before"),
        F.max(F.col("s_at") + F.col("s_last")).over(file_of).alias("s_prev"),
        (F.lead("span").over(Window.partitionBy("file").orderBy("span"))).isNull().alias("s_final"))
    placed = inside.join(spans, ["file", "span"]).select(
        "file", "block", "size", (F.col("at") + F.col("s_at")).alias("at"), (F.col("before") + F.col("s_before")).alias("before"),
        F.coalesce(F.col("last") + F.col("s_at"), F.col("s_prev"), F.lit(-1)).alias("last"), "ends")
    closed = placed.select("file", "at", "before", "last", "ends", F.posexplode("ends").alias("k", "end")).select(
        "file", (F.col("before") + F.col("k")).alias("doc"),
        F.when(F.col("k") == 0, F.col("last")).otherwise(F.col("at") + F.get("ends", F.col("k") - 1)).alias("prev"),
        (F.col("at") + F.col("end")).alias("stop"))
    tail = placed.groupBy("file").agg(
        F.max(F.col("at") + F.col("size")).alias("stop"), F.sum(F.size("ends")).alias("doc"),
        F.max(F.coalesce(F.col("at") + F.when(F.size("ends") > 0, F.element_at("ends", -1)), F.lit(-1))).alias("prev"))
    tail = tail.filter("stop - prev > 1").select("file", "doc", "prev", "stop")
    return closed.unionByName(tail).select(
        "file", "doc", (F.col("prev") + 1).alias("start"), (F.col("stop") - F.col("prev") - 1).alias("n_tokens"))


def count_document_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """doc_id, file, doc, start, n_tokens: writes the texts as flat files into the shared folder, counts by scanning, and names the documents."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    if _opens(path):
        stored = write_files(docs, path, doc_id, text, ranks)
        blocks = blocks_of_ranges(stored.filter("path is not null").select("file", "path", "length"))
    else:
        pack(docs, path, doc_id, text, ranks)
        stored = spark.read.parquet(path)
        blocks = stored.filter("ids is not null")
    counts = count_tokens(blocks)
    names = stored.filter("doc_ids is not null").select("file", "first", F.posexplode("doc_ids").alias("k", doc_id)).select(
        "file", (F.col("first") + F.col("k")).alias("doc"), doc_id)
    return names.join(counts, ["file", "doc"]).select(doc_id, "file", "doc", "start", "n_tokens")
