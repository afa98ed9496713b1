"""Token-id files in Simple-8b words: selectors pack varying counts of ids per 64-bit word, with escapes and per-block offsets.

A word holds a selector in its high 4 bits and up to 60 bits of ids, all of the selector's width. From each place the widest count
that fits is taken. Ids of more than 60 bits leave an escape word; their values stand behind the words of their block, in order.
A block of BLOCK ids decodes without any other: one vectorised shift for each selector.

File: magic; blocks (four uint32: ids, words, escapes, zero; then words, then escapes, all little-endian uint64); the lengths of the
documents, run by run, as blocks of the same kind; a directory (offsets of blocks, offsets of runs, first id of each run, then one past the
last id); and four uint64: number of blocks, of runs, offset of the directory, magic. Runs of documents hold RUN ids or one longer document, so that any run can be
read in a task of its own, from the blocks that cover it.

``write_ids`` encodes texts in order of their ids, one file a task, and returns the runs with their documents' names;
``read_ids`` reads runs wherever they lie and gives each document its ids and its place among all ids of all files.

Defined cases: null and empty texts have the end id alone. Equal document ids are ordered by a hash of their text and may lie in two files; rows equal in both are
interchangeable; null ids come first. Empty tables give empty tables. Other columns are left out. Files of failed tasks stay in the folder; no row names
them. Names may be of any type that Arrow knows. Where Spark writes to a store that pyarrow cannot open, ``write_ids`` fails at once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from logmeld.session import scratch_path, written

WORDS = "/opt/tokenizers/word_bpe_49k.json"
END = 2
BLOCK = 1 << 16
RUN = 1 << 20
#: Runs that a task reads, one after the other.
RUNS = 8
#: Texts that are encoded at once hold so many bytes, or are one text: each distinct word of them is looked up once.
SLICE = 12_000_000
#: Words, and parts of words, that a worker remembers, and the longest of them.
KNOWN, LONGEST = 700_000, 64

MAGIC = int.from_bytes(b"ids-s8b1", "little")
#: Bits of an id for selectors 0 to 14; 60 divided by them is the count of ids, 120 for zeros. Selector 15 is the escape.
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = np.array([120, *[60 // b for b in BITS[1:]], 1], np.int64)
ESCAPE = 15


_BIT_LENGTH = np.array([k.bit_length() for k in range(1 << 16)], np.int8)


# ---- the code ---------------------------------------------------------------------------

def _widths(ids: np.ndarray) -> np.ndarray:
    """Bit lengths of uint64 numbers."""
    if ids.max() < 1 << 16:
        return _BIT_LENGTH[ids.astype(np.int64)]
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = (ids >> np.uint64(32)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], low) if high.any() else low


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned ids. The last word may be filled up with zeros: the number of ids is kept elsewhere."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    widths = _widths(ids).astype(np.int8)
    # the narrowest width that holds all ids, then narrower ones where they hold what follows
    widest = int(np.searchsorted(BITS, widths.max()))
    chosen = np.full(n, widest, np.uint8)
    narrow = np.arange(n, dtype=np.int32)
    if widest == ESCAPE:
        widest -= 1
        narrow = np.flatnonzero(widths <= BITS[widest]).astype(np.int32)
        chosen[narrow] = widest
    for selector in range(widest - 1, -1, -1):
        narrow = narrow[widths[narrow] <= BITS[selector]]
        if not len(narrow):
            break
        # the end of the run of such ids from each of them on
        last = np.flatnonzero(np.append(narrow[1:] - narrow[:-1] != 1, True))
        until = np.repeat(narrow[last] + 1, np.diff(last, prepend=-1))
        chosen[narrow[(until - narrow >= COUNTS[selector]) | (until == n)]] = selector
    # the widest of all may hold fewer ids than its count only at the end
    count, select, starts, at = COUNTS.tolist(), chosen.tobytes(), [], 0
    while at < n:
        starts.append(at)
        at += count[select[at]]
    starts = np.array(starts, np.int64)
    selectors = chosen[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(int(COUNTS.max()), np.uint64)])
    for selector in np.unique(selectors):
        if 0 < selector < ESCAPE:
            mine = np.flatnonzero(selectors == selector)
            first, packed = starts[mine], words[mine]
            for k in range(COUNTS[selector]):
                packed |= padded[first + k] << np.uint64(k * BITS[selector])
            words[mine] = packed
    return words, ids[starts[selectors == ESCAPE]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    out = np.zeros(max(n, int(ends[-1]) if len(ends) else 0), np.uint64)
    for selector in np.unique(selectors):
        mine = np.flatnonzero(selectors == selector)
        first = ends[mine] - counts[mine]
        if selector == ESCAPE:
            out[first] = escapes
        elif selector:
            bits, mask = BITS[selector], np.uint64((1 << BITS[selector]) - 1)
            for k in range(COUNTS[selector]):
                out[first + k] = (words[mine] >> np.uint64(k * bits)) & mask
    return out[:n]


def block_bytes(ids: np.ndarray) -> bytes:
    words, escapes = encode(ids)
    return np.array([len(ids), len(words), len(escapes), 0], "<u4").tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def block_ids(raw: bytes, at: int = 0) -> np.ndarray:
    n, words, escapes, _ = np.frombuffer(raw, "<u4", 4, at).tolist()
    return decode(np.frombuffer(raw, "<u8", words, at + 16), np.frombuffer(raw, "<u8", escapes, at + 16 + 8 * words), n)


# ---- files ------------------------------------------------------------------------------

def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    local = re.match(r"(?:file:/*(?=/))?(/.*)", path, re.S)
    if local:
        return pyarrow.fs.LocalFileSystem(), local[1]
    return pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@?=&%"))


class Writer:
    """One file. Documents are added in runs."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block = out, block
        self.at = out.write(np.uint64(MAGIC).astype("<u8").tobytes())
        self.blocks, self.lengths, self.firsts = [], [], []
        self.left, self.held, self.n = [], 0, 0

    def _put(self, raw: bytes) -> int:
        at, self.at = self.at, self.at + len(raw)
        self.out.write(raw)
        return at

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.left) if self.left else np.zeros(0, np.uint32)
        cut = 0
        while len(ids) - cut >= least and cut < len(ids):
            self.blocks.append(self._put(block_bytes(ids[cut : cut + self.block])))
            cut += self.block
        self.left = [ids[cut:]]
        self.held = len(self.left[0])

    def add(self, ids: np.ndarray) -> None:
        self.left.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= self.block:
            self._flush(self.block)

    def close_run(self, lengths: list[int]) -> int:
        """The number of the run that ends here."""
        self.lengths.append(block_bytes(np.array(lengths, np.uint64)))
        self.firsts.append(self.n - sum(lengths))
        return len(self.firsts) - 1

    def close(self) -> None:
        self._flush(1)
        runs = [self._put(raw) for raw in self.lengths]
        at = self._put(np.array([*self.blocks, *runs, *self.firsts, self.n], "<u8").tobytes())
        self._put(np.array([len(self.blocks), len(runs), at, MAGIC], "<u8").tobytes())
        self.out.close()


class Reader:
    """A file's runs, each read on its own."""

    def __init__(self, path: str):
        store, name = open_store(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        blocks, runs, at, magic = np.frombuffer(self.file.read_at(32, size - 32), "<u8").tolist()
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        table = np.frombuffer(self.file.read_at(8 * (blocks + 2 * runs + 1), at), "<u8").astype(np.int64)
        self.blocks = np.append(table[:blocks], table[blocks] if runs else at)
        self.runs = np.append(table[blocks : blocks + runs], at)
        self.firsts = table[blocks + runs :]
        #: Ids of a block; the last may have fewer.
        self.each = int(np.frombuffer(self.file.read_at(4, int(self.blocks[0])), "<u4")[0]) if blocks else 0

    def _raw(self, offsets: np.ndarray, k: int) -> bytes:
        return self.file.read_at(int(offsets[k + 1] - offsets[k]), int(offsets[k]))

    def lengths(self, run: int) -> np.ndarray:
        return block_ids(self._raw(self.runs, run)).astype(np.int64)

    def documents(self, run: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, length, ids) of the run's documents; of the blocks, only what the document at hand needs is held."""
        first, held, ahead = int(self.firsts[run]), np.zeros(0, np.uint64), None
        for length in self.lengths(run).tolist():
            parts = [held]
            have = len(held)
            while have < length:
                if ahead is None:
                    ahead, skip = first // self.each, first % self.each
                else:
                    skip = 0
                part = block_ids(self._raw(self.blocks, ahead))[skip:]
                ahead += 1
                parts.append(part)
                have += len(part)
            whole = np.concatenate(parts) if len(parts) > 1 else held
            yield first, length, whole[:length]
            held, first = whole[length:], first + length

    def close(self) -> None:
        self.file.close()


# ---- texts to ids -----------------------------------------------------------------------

class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases and drops white space: each distinct word is encoded once, as long as it is remembered.

    White space becomes one space by the tokenizer's own rules and is taken out, so that words between ASCII white space are independent of each
    other. Within a word the tokenizer cuts between letters and an ASCII sign that is none, so words with the same letters share their ids.
    """

    #: Letters, if an ASCII sign or the end follows; then the rest of a word.
    PARTS = re.compile("(?:([A-Za-zÀ-ÖØ-öø-ɏ]++)(?=[\x01-@\\[-`{-\x7f]))?([^\n]*)\n")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        #: A sign that stands for itself, to tell words of one text apart.
        self.mark = self.tokenizer.encode("\0", add_special_tokens=False).ids

    def _ids(self, words: list[str]) -> list[bytes]:
        """Many words as a few texts with marks between them; words with marks of their own one by one."""
        if len(self.mark) != 1 or any("\0" in w for w in words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        out, groups = [], [words[k : k + 200] for k in range(0, len(words), 200)]
        for e in self.tokenizer.encode_batch_fast([" \0 ".join(g) for g in groups], add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            raw, at = ids.tobytes(), 0
            for end in [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]:
                out.append(raw[4 * at : 4 * end])
                at = end + 1
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without ASCII white space, by the ids of their letters and of the rest."""
        cut = self.PARTS.findall(("\n".join(words) + "\n").encode().lower().decode())
        asked = set(chain.from_iterable(cut))
        if len(self.parts) + len(asked) > KNOWN:
            self.parts = {"": b""}
        new = [*(asked - self.parts.keys())]
        self.parts.update(zip(new, self._ids(new)))
        parts = self.parts
        out = [parts[first] + parts[rest] for first, rest in cut]
        for part in new:
            if len(part) > LONGEST:
                del parts[part]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        words = pa.compute.ascii_split_whitespace(texts.fill_null(""))
        flat = words.flatten().dictionary_encode()
        own = flat.dictionary.to_pylist()
        found = [*map(self.known.get, own)]
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self._words([own[k] for k in new]) if new else ()):
            found[k] = ids
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
        self.known.update((own[k], found[k]) for k in new if len(own[k]) <= LONGEST)
        pool = np.frombuffer(b"".join(found), "<u4")
        size = np.array([len(ids) // 4 for ids in found], np.int64)
        place = flat.indices.to_numpy()
        each = size[place]
        ends = np.cumsum(each)
        start = np.cumsum(size) - size
        ids = pool[np.repeat(start[place] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.append(0, ends)[words.offsets.to_numpy()])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    return WordEncoder(path)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with so many bytes at most, or one text."""
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()], np.int64)
    at, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > at and held + size > most:
            yield at, k
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


def write_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = WORDS, end: int = END) -> DataFrame:
    """Files of ids in ascending order of ``doc_id``: a row (file, path, run, names) for each run of documents in them."""
    open_store(path)
    kind = docs.schema[doc_id].dataType
    schema = StructType([
        StructField("file", LongType()), StructField("path", StringType()), StructField("run", LongType()), StructField("names", ArrayType(kind))])
    out_schema = pa.schema([
        ("file", pa.int64()), ("path", pa.string()), ("run", pa.int64()), ("names", pa.list_(to_arrow_type(kind)))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, names, lengths, ids_in_run = None, [], [], 0

        def run_row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([name]), pa.array([out.close_run(lengths)], pa.int64()), pa.array([names], out_schema.field("names").type)],
                schema=out_schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder, file = encoder_of(tokenizer), batch.column("file")[0].as_py()
                store, root = open_store(path)
                store.create_dir(root, recursive=True)
                name = f"{path}/{file:06d}-{uuid.uuid4().hex}.s8b"
                out = Writer(store.open_output_stream(open_store(name)[1], compression=None))
            for a, b in slices(batch.column("text")):
                ids, sizes = encoder.encode(batch.column("text").slice(a, b - a))
                flat = []
                for doc, doc_ids in zip(batch.column("id").slice(a, b - a).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1])):
                    if lengths and ids_in_run + len(doc_ids) >= RUN:
                        out.add(np.concatenate(flat) if flat else np.zeros(0, "<u4"))
                        flat = []
                        yield run_row()
                        names, lengths, ids_in_run = [], [], 0
                    flat += [doc_ids, np.array([end], "<u4")]
                    names.append(doc)
                    lengths.append(len(doc_ids) + 1)
                    ids_in_run += len(doc_ids) + 1
                out.add(np.concatenate(flat) if flat else np.zeros(0, "<u4"))
        if out is not None:
            yield run_row()
            out.close()

    key = [F.col("id"), F.xxhash64("text")]
    ordered = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).repartitionByRange(*key).sortWithinPartitions(*key)
    return written(ordered.withColumn("file", F.spark_partition_id().cast("long")).mapInArrow(write, schema), "id-runs")


def read_ids(runs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, file, start, n_tokens, ids): from the files, each document's ids as little-endian uint32 and its place among all ids of all files."""
    kind = runs.schema["names"].dataType.elementType
    ddl = StructType([StructField(doc_id, kind)]).add("file", "long").add("start", "long").add("n_tokens", "long").add("ids", "binary")
    arrow_kind = to_arrow_type(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                reader = Reader(batch.column("path")[row].as_py())
                number, before = batch.column("file")[row].as_py(), batch.column("_before")[row].as_py()
                found = [(before + f, n, i.astype("<u4").tobytes()) for f, n, i in reader.documents(batch.column("run")[row].as_py())]
                reader.close()
                names = batch.column("names")[row].values
                yield pa.RecordBatch.from_arrays([
                    names.cast(arrow_kind) if names.type != arrow_kind else names, pa.array([number] * len(found), pa.int64()),
                    pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
                    pa.array([x[2] for x in found], pa.binary())], names=ddl.names)

    tasks = max(1, min(runs.count() // RUNS, 20_000))
    # one row a file: as many as tasks have written
    ends = runs.groupBy("file").agg(F.max(F.struct("run", "path")).alias("last")).select("file", "last.path")
    sizes = ends.mapInArrow(_sizes, "file long, size long")
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("file").alias("_file"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).cast("long").alias("_before"))
    placed = runs.join(before, F.col("file") == F.col("_file")).drop("_file")
    return placed.repartition(tasks, "file", "run").mapInArrow(read, ddl)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = []
        for path in batch.column("path").to_pylist():
            reader = Reader(path)
            sizes.append(int(reader.firsts[-1]))
            reader.close()
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], names=["file", "size"])


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = WORDS, end: int = END) -> DataFrame:
    """Writes the texts' ids as files into the shared folder and reads them back."""
    return read_ids(write_ids(docs, scratch_path(docs.sparkSession, "packed-ids"), doc_id, text, tokenizer, end), doc_id)
