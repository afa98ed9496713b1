"""Cross-tokenizer alignment: two tokenizers' tokens of one text, cut into groups where both end, and the tokens that overlap.

Each tokenizer's cumulative byte ends go into a dictionary from end to index. The ends that both dictionaries have, sorted, slice both id
lists into groups; within a slice each pair of overlapping tokens is a link. Spaces between two other characters start a token in both
tokenizers, so a text falls into units there: a distinct unit is encoded and aligned once, as long as a worker remembers it. Texts with other
white space beside spaces are encoded whole.

Corpus counts take three steps. Blocks of documents list their distinct links with the number of documents that hold each, so a link is
shuffled once a block, not once a document. Sums by pair, and their maximum by first id, are one row a pair. These rows come back to
the blocks that asked for them, and each block's documents add them up.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty text of
groups. Each row is a document of its own, also where ids or texts repeat. Empty tables give empty tables. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from logmeld.session import written

BYTES = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units that a worker remembers, and the longest of them.
KNOWN, LONGEST = 700_000, 64
#: Bytes of text whose links are counted together before they are shuffled, and of texts that leave a task at once.
BLOCK_BYTES, PUT_BYTES = 8_000_000, 2_000_000


def align(a_ends: list[int], b_ends: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """(groups as from and to in A, from and to in B; links as pairs of places) of two lists of cumulative ends over the same bytes."""
    a_at = {end: k for k, end in enumerate(a_ends, 1)}
    b_at = {end: k for k, end in enumerate(b_ends, 1)}
    groups, links, i, j = [], [], 0, 0
    for end in sorted(a_at.keys() & b_at.keys()):
        p, q = a_at[end], b_at[end]
        groups.append((i, p, j, q))
        while i < p and j < q:
            links.append((i, j))
            a, b = a_ends[i], b_ends[j]
            i += a <= b
            j += b <= a
        i, j = p, q
    return groups, links


_WHITE = r"[ \t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Of a text without tokens.
_NONE = (0, 0, "", b"")


class Aligner:
    """Tokens, groups and links of texts. ``unit`` results are (number of A, of B, groups as text, links as int64: A in the high half)."""

    #: Spaces at an end or beside other white space, and characters that only one of the rules takes for white space.
    ODD = rf"^ | $| {_WHITE}|{_WHITE} |{SPACE}|[\x1c-\x1f]"

    def __init__(self, a_path: str = BYTES, b_path: str = PIECES):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        n = self.b.vocab_size()
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace(SPACE, " ").encode() for k in range(n)]
        self.a_size, self.b_size = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        #: Ids as text, and what stands after them within and at the end of their part of a group.
        self.a_said, self.b_said = (
            np.array([f"{k}{end}" for k in range(len(x)) for end in (",", last)], object) for x, last in ((self.a_bytes, "|"), (self.b_bytes, ";")))
        #: No piece goes on over a space, so units are independent.
        self.cuts = all(SPACE not in self.b.id_to_piece(k).lstrip(SPACE) for k in range(n))
        self.known: dict[str, tuple | None] = {}

    def whole(self, texts: list[str]) -> list[tuple | None]:
        """Each text on its own; None where the bytes do not come back."""
        spaced = [" " + t for t in texts]
        out = []
        for text, e, b in zip(spaced, self.a.encode_batch_fast(spaced, add_special_tokens=False), self.b.encode(texts, num_threads=1)):
            a, raw = e.ids, text.encode()
            if b"".join([self.a_bytes[k] for k in a]) != raw or b"".join([self.b_bytes[k] for k in b]) != raw:
                out.append(None)
                continue
            groups, links = align([*accumulate([self.a_size[k] for k in a])], [*accumulate([self.b_size[k] for k in b])])
            said = ";".join([f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}" for i, p, j, q in groups])
            out.append((len(a), len(b), said, np.array([a[i] << 32 | b[j] for i, j in links], "<i8").tobytes()))
        return out

    def joined(self, units: list[str]) -> list[tuple | None]:
        """The same for units that are independent: encoded and aligned as one text, cut where units end."""
        text = " ".join(units)
        raw, a, b = f" {text}".encode(), self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1)
        if b"".join([self.a_bytes[k] for k in a]) != raw or b"".join([self.b_bytes[k] for k in b]) != raw:
            return self.whole(units)
        a_ends = [*accumulate([self.a_size[k] for k in a])]
        groups, links = (np.array(x, np.int64) for x in align(a_ends, [*accumulate([self.b_size[k] for k in b])]))
        common = np.array(a_ends)[groups[:, 1] - 1]
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        cut = np.searchsorted(common, ends)
        if (common[cut] != ends).any():
            return self.whole(units)
        a, b, (a_from, a_to, b_from, b_to) = np.array(a), np.array(b), groups.T
        of_a, of_b = (np.repeat(np.arange(len(groups)), n) for n in (a_to - a_from, b_to - b_from))
        said = np.empty(len(a) + len(b), object)
        said[np.arange(len(a)) + b_from[of_a]] = self.a_said[2 * a + (np.arange(len(a)) + 1 == a_to[of_a])]
        said[np.arange(len(b)) + a_to[of_b]] = self.b_said[2 * b + (np.arange(len(b)) + 1 == b_to[of_b])]
        pairs, said = (a[links[:, 0]] << 32 | b[links[:, 1]]).astype("<i8").tobytes(), said.tolist()
        n_a, n_b = a_to[cut], b_to[cut]
        n_links = 8 * (n_a + n_b - cut - 1)  # each common end is one link less than tokens
        bounds = zip(*[[0, *x.tolist()] for x in (n_a, n_b, n_links)])
        out, before = [], next(bounds)
        for now in bounds:
            out.append((now[0] - before[0], now[1] - before[1], "".join(said[before[0] + before[1] : now[0] + now[1]])[:-1], pairs[before[2] : now[2]]))
            before = now
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(numbers of A, B and links by text, groups of each text, links of all texts); nothing for null and empty texts and what does not come back."""
        given = texts.fill_null("")
        odd = pa.compute.match_substring_regex(given, self.ODD).to_pylist() if self.cuts else [True] * len(given)
        given = given.to_pylist()
        if any(odd):
            units = pa.array([[t] if own else t.split(" ") for t, own in zip(given, odd)], pa.list_(pa.string()))
        else:
            units = pa.compute.split_pattern(texts.fill_null(""), " ")
        flat = units.flatten().dictionary_encode()
        own = flat.dictionary.to_pylist()
        found = [self.known.get(u, 0) if u else _NONE for u in own]
        new = [k for k, x in enumerate(found) if x == 0]
        alone = {t for t, own_text in zip(given, odd) if own_text}
        for some, method in (([k for k in new if own[k] in alone], self.whole), ([k for k in new if own[k] not in alone], self.joined)):
            for at in range(0, len(some), 1000):
                part = some[at : at + 1000]
                for k, x in zip(part, method([own[k] for k in part])):
                    found[k] = x
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
        self.known.update((own[k], found[k]) for k in new if len(own[k]) <= LONGEST)

        place, offsets = flat.indices.to_numpy(), units.offsets.to_numpy()
        lost = np.array([x is None for x in found], bool)
        bad = {int(k) for k in np.searchsorted(offsets, np.flatnonzero(lost[place]), "right") - 1} if lost.any() else set()
        found = [x or _NONE for x in found]
        numbers = np.array([(a, b, len(links) // 8) for a, b, _, links in found], np.int64).reshape(-1, 3)
        said, at = [x[2] for x in found], place.tolist()
        groups = [";".join([said[k] for k in at[i:j]]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        totals = np.diff(np.append(np.zeros((1, 3), np.int64), np.cumsum(numbers[place], 0), 0)[offsets], axis=0)
        pool = np.frombuffer(b"".join([x[3] for x in found]), "<i8")
        each = numbers[place, 2]
        ends = np.cumsum(each)
        links = pool[np.repeat((np.cumsum(numbers[:, 2]) - numbers[:, 2])[place] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        if bad:
            parts = np.split(links, np.cumsum(totals[:, 2])[:-1])
            for k in bad:
                a, b, groups[k], raw = (self.whole([given[k]])[0] if offsets[k + 1] - offsets[k] > 1 else None) or _NONE
                parts[k] = np.frombuffer(raw, "<i8")
                totals[k] = a, b, len(parts[k])
            links = np.concatenate(parts)
        return totals, groups, links


@lru_cache(maxsize=2)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    return Aligner(a_path, b_path)


def align_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str = BYTES, b_path: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``) and, for ``rate_links``, block, links, and rows (block, pairs, holders).

    ``links`` packs a document's distinct links as places in its block's list ``pairs`` and how often each occurs. ``holders`` says how many documents of
    the block hold each pair. Rows of blocks have no document.
    """
    out = StructType([StructField("is_block", BooleanType()), StructField("id", docs.schema[doc_id].dataType)])
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        out = out.add(name, "long")
    out = out.add("groups", "string").add("block", "long").add("links", "binary")
    out = out.add("pairs", ArrayType(LongType())).add("holders", ArrayType(IntegerType()))

    def batch_of(ids, numbers, groups, block, links, pairs=None, holders=None) -> pa.RecordBatch:
        n = len(groups)
        return pa.RecordBatch.from_arrays([
            pa.array([pairs is not None] * n), ids, *[pa.array(x, pa.int64()) for x in numbers], pa.array(groups, pa.string()),
            pa.array([block] * n, pa.int64()), pa.array(links, pa.binary()), pa.array([pairs] * n, pa.list_(pa.int64())),
            pa.array([holders] * n, pa.list_(pa.int32()))], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, held, size, kind_of = aligner_of(a_path, b_path), 0, [], 0, None

        def close() -> Iterator[pa.RecordBatch]:
            """The block's documents by portions, then the block."""
            totals = np.concatenate([t for _, t, _, _ in held])
            docs, groups = [d for x, _, _, _ in held for d in x], [g for _, _, x, _ in held for g in x]
            pairs, place = np.unique(np.concatenate([x for _, _, _, x in held]), return_inverse=True)
            ends = np.cumsum(totals[:, 2])
            block, at, weight, links = partition << 24 | number, 0, 0, []
            holders = np.zeros(len(pairs), np.int32)
            for k, (size, end) in enumerate(zip(totals[:, 2].tolist(), ends.tolist())):
                mine, times = np.unique(place[end - size : end], return_counts=True)
                holders[mine] += 1
                links.append(zlib.compress(np.diff(mine, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes(), 1))
                weight += len(groups[k])
                if weight >= PUT_BYTES or k == len(docs) - 1:
                    own = groups[at : k + 1]
                    yield batch_of(
                        pa.array(docs[at : k + 1], kind_of), [*totals[at : k + 1, :2].T, [g.count(";") + 1 if g else 0 for g in own], totals[at : k + 1, 2]],
                        own, block, links)
                    at, weight, links = k + 1, 0, []
            yield batch_of(pa.nulls(1, kind_of), [[0]] * 4, [None], block, [None], pairs, holders)

        for batch in batches:
            if not batch.num_rows:
                continue
            kind_of, partition = batch.column("id").type, batch.column("partition")[0].as_py()
            sizes = [x or 0 for x in pa.compute.binary_length(batch.column("text")).to_pylist()]
            at = 0
            while at < batch.num_rows:
                stop, some = at, 0
                while stop < batch.num_rows and (stop == at or some + sizes[stop] <= PUT_BYTES):
                    some += sizes[stop]
                    stop += 1
                got = aligner.texts(batch.column("text").slice(at, stop - at))
                held.append((batch.column("id").slice(at, stop - at).to_pylist(), *got))
                size, at = size + some, stop
                if size >= BLOCK_BYTES:
                    yield from close()
                    number, held, size = number + 1, [], 0
        if held:
            yield from close()

    named = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.spark_partition_id().cast("long").alias("partition"))
    return named.mapInArrow(run, out).withColumnRenamed("id", doc_id)


def count_links(aligned: DataFrame) -> DataFrame:
    """(pair, n, is_best): how many documents hold each link, and whether no link of its A id has more. Reads stored ``align_texts``."""
    asked = aligned.filter("is_block").select(F.inline(F.arrays_zip("pairs", "holders")))
    counts = asked.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("is_best"))


def rate_links(aligned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Stored ``align_texts`` -> its documents with n_best and count_sum in place of links."""
    kept = [c for c in aligned.columns if c not in ("is_block", "block", "links", "pairs", "holders")]
    docs = aligned.filter("not is_block").select(*[f"`{c}`" for c in kept], "block", "links")
    asked = aligned.filter("is_block").select("block", F.inline(F.arrays_zip("pairs", "holders"))).select("block", F.col("pairs").alias("pair"))
    told = asked.join(written(count_links(aligned), "link-counts"), "pair").select(F.col("block").alias("of"), "pair", "n", "is_best")
    out = StructType([aligned.schema[c] for c in kept]).add("n_best", "long").add("count_sum", "long")

    def finish(docs: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("pair").to_numpy())
        n = told.column("n").to_numpy()[order].astype(np.int64)
        best = told.column("is_best").to_numpy()[order]
        best_of, sum_of = [], []
        for packed in docs.column("links").to_pylist():
            steps, times = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64).reshape(2, -1)
            place = np.cumsum(steps)
            best_of.append(int(times[best[place]].sum()))
            sum_of.append(int((times * n[place]).sum()))
        return docs.select(kept).append_column("n_best", pa.array(best_of, pa.int64())).append_column("count_sum", pa.array(sum_of, pa.int64()))

    return docs.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(finish, out)
