"""SentencePiece encoding and decoding: segmentations sampled from the piece lattice, reproducible by row key.

The lattice of a text has a node between any two characters and an edge for each vocabulary piece between its ends. An
edge weighs ``(2 - score) ** -theta``: scores of a BPE model are negative ranks, so frequent pieces weigh more. The forward
pass sums the weights of all paths to each node; the backward pass draws pieces from the end by those sums. Draws come from
a hash of seed, row key, unit and step: the same row gives the same pieces in every run, batch and partition. Draws and cumulated
chances are whole numbers, compared within a node, so that nothing which a worker has seen before can move them.

No piece of the vocabulary has a space after another character, or a line feed, so every path passes there and the lattice falls
into units; each distinct unit is prepared once in a task, and all units of a batch are drawn side by side.

Lossless: characters that are no piece become byte pieces, and so does a literal U+2581, which stands for the space in
pieces. Encoding puts a space before the text, decoding takes one away.

Defined cases: null gives null, empty text an empty list. Ids beyond the vocabulary, unknown and control pieces decode to nothing;
bytes that are no UTF-8 decode to U+FFFD. Rows with equal key and text get equal pieces. Extra columns pass through; columns named like the new ones are
replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from logmeld.llm.common import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Edges that a worker remembers; later units are prepared for their batch only, as are those longer than SHORT characters.
EDGES = 3_000_000
SHORT = 48


_ODD = 0x5851F42D4C957F2D
_HIGH = np.uint64(44)


class Vocabulary:
    """Pieces of a model, and their weights as logarithms."""

    def __init__(self, model: str = MODEL, theta: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.text: list[str] = [sp.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if sp.is_byte(i)]
        if len(byte) != 256:
            raise ValueError("the model has no byte pieces: decoding would lose characters")
        skip = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte = {int(self.text[i][1:-1], 16): i for i in byte}
        self.id = {t.replace(SPACE, " "): i for i, t in enumerate(self.text) if i not in skip}
        self.weight = [-theta * math.log(2.0 - sp.get_score(i)) for i in range(n)]
        self.chance = [math.exp(w) for w in self.weight]
        self.longest = max(map(len, self.id))
        # pieces by length, as sorted hashes, for many look-ups at once; `maybe` has a mark for each, which most other strings miss
        self.powers = np.array([pow(_ODD, k, 2**64) for k in range(self.longest)], np.uint64)
        self.maybe, self.by_length = np.zeros(1 << 20, bool), []
        for size in range(1, self.longest + 1):
            some = [(self.hash(t), i) for t, i in self.id.items() if len(t) == size and SPACE not in t]
            some.sort()
            hashes = np.array([h for h, _ in some], np.uint64)
            self.by_length.append((hashes, np.array([i for _, i in some], np.int64)))
            self.maybe[(hashes >> _HIGH).astype(np.int64)] = True
        self.raw: list[bytes] = [b"" if i in skip else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        feed, crossing = any("\n" in t for t in self.id), any(" " in t.lstrip(" ") for t in self.id)
        self.chances = np.array(self.chance)
        self.unit = re.compile(r"(?s).+" if crossing else r" *[^ ]+| +" if feed else r"\n| *[^ \n]+| +")

    @staticmethod
    def hash(text: str) -> int:
        """Characters times powers of an odd number, from the last one on, in 64 bits."""
        return sum(ord(c) * pow(_ODD, k, 2**64) for k, c in enumerate(reversed(text))) % 2**64


def lattice(unit: str, v: Vocabulary) -> tuple[list[list[int]], list[list[int]], list[list[float]]]:
    """For each node but the first: edges' earlier nodes, pieces, and chances given all paths to the node. Last node: the end."""
    nodes, alpha = [0], [0.0]
    prev, pieces, chance = [], [], []

    exp, log = math.exp, math.log
    ids, weight, longest, plain = v.id, v.weight, v.longest, SPACE not in unit

    def add(before, found, weights):
        top = max(weights)
        parts = [exp(w - top) for w in weights]
        whole = sum(parts)
        alpha.append(top + log(whole))
        prev.append(before)
        pieces.append(found)
        chance.append([x / whole for x in parts])
        return len(alpha) - 1

    for j in range(1, len(unit) + 1):
        before, found, weights = [], [], []
        for i in range(max(0, j - longest), j):
            piece = ids.get(unit[i:j])
            if piece is not None and (plain or SPACE not in unit[i:j]):
                before.append(nodes[i])
                found.append(piece)
                weights.append(alpha[nodes[i]] + weight[piece])
        if unit[j - 1] not in ids or unit[j - 1] == SPACE:
            at, raw = nodes[j - 1], unit[j - 1].encode()
            for value in raw[:-1]:
                at = add([at], [v.byte[value]], [alpha[at]])
            before.append(at)
            found.append(v.byte[raw[-1]])
            weights.append(alpha[at] + weight[v.byte[raw[-1]]])
        nodes.append(add(before, found, weights))
    return prev, pieces, chance


def many_lattices(units: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lattices of many short units at once; characters of all units, one after the other, are the nodes.

    Returns for each edge, sorted by node, long pieces first: node, length, piece, chance; and for each unit whether all its characters are pieces.
    Products of weights do for short units; they stay far above the smallest number.
    """
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(len(codes)) - np.repeat(starts, sizes)
    nodes, lengths, pieces = [], [], []
    h = np.zeros(len(codes), np.uint64)
    single = np.zeros(len(codes), bool)
    for size in range(1, min(v.longest, int(sizes.max(initial=0))) + 1):
        h[size - 1 :] += codes[: len(codes) - size + 1] * v.powers[size - 1]
        at = np.flatnonzero(v.maybe[(h >> _HIGH).astype(np.int64)] & (inside >= size - 1))
        hashes, ids = v.by_length[size - 1]
        if not len(hashes):
            continue
        k = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
        hit = hashes[k] == h[at]
        nodes.append(at[hit])
        lengths.append(np.full(len(nodes[-1]), size))
        pieces.append(ids[k[hit]])
        if size == 1:
            single[nodes[0]] = True
    node, length, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, lengths, pieces))
    whole = np.add.reduceat(single, starts) == sizes if len(units) else np.zeros(0, bool)
    order = np.lexsort((length, inside[node]))
    node, length, piece = node[order], length[order], piece[order]
    weight, sums, paths = v.chances[piece], np.zeros(len(codes)), np.zeros(len(node))
    ends = np.searchsorted(inside[node], np.arange(int(sizes.max(initial=0)) + 1))
    for a, b in zip(ends, ends[1:]):  # by place in the unit: what comes before is summed up
        before = np.where(length[a:b] > inside[node[a:b]], 1.0, sums[node[a:b] - length[a:b]])
        paths[a:b] = before * weight[a:b]
        np.add.at(sums, node[a:b], paths[a:b])
    order = np.argsort(node * (v.longest + 1) - length)
    node, length, piece, paths = node[order], length[order], piece[order], paths[order]
    return node, length, piece, paths / np.maximum(sums[node], 1e-300), whole


_G, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Chances and draws are whole numbers of this many parts of 1, so that a draw means the same edge whatever was prepared before.
PARTS = 1 << 53


def draws(key: np.ndarray, unit: np.ndarray, step: int) -> np.ndarray:
    """Whole numbers from 0 to below PARTS, of row key, place of the unit in the row, and step."""
    x = key + unit.astype(np.uint64) * _G + np.uint64(step * 0xD1342543DE82EF95 & 2**64 - 1)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.int64)


def bounds_of(chance: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each edge the sum of chances up to it within its node, in PARTS; ``first`` are the places where nodes begin. The last has PARTS.

    Sums are of whole numbers: what stands before a node cancels exactly, wrapped around or not.
    """
    sums = np.cumsum(np.floor(chance * float(PARTS)).astype(np.int64))
    before = np.concatenate([np.zeros(1, np.int64), sums])[first]
    bounds = np.minimum(sums - np.repeat(before, np.diff(np.append(first, len(sums)))), PARTS)
    bounds[np.append(first[1:], len(sums)) - 1] = PARTS
    return bounds


class Sampler:
    """Draws segmentations of many units at once. Nodes of all units share one numbering; a node's edges follow each other."""

    def __init__(self, vocabulary: Vocabulary, edges: int = EDGES):
        self.v, self.limit = vocabulary, edges
        self.end: dict[str, int] = {}
        self.passing: list[str] = []
        self.kept: tuple[int, int] | None = None
        self.nodes, self.size = 0, 0
        self.first = np.zeros(1024, np.int64)  # of each node
        self.bounds, self.back, self.piece = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int32)

    def _learn(self, units: list[str]):
        """Numbers the nodes of new units; -1 as an earlier node stands for the start."""
        simple, rest = [u for u in units if SPACE not in u], [u for u in units if SPACE in u]
        if simple:
            node, length, piece, chance, whole = many_lattices(simple, self.v)
            sizes = np.fromiter(map(len, simple), np.int64, len(simple))
            start = np.repeat(np.cumsum(sizes) - sizes, sizes)
            back = np.where(node - length < start[node], -1, self.nodes + node - length)
            ends = self.nodes + np.cumsum(sizes) - 1
            first = np.searchsorted(node, np.arange(int(sizes.sum())))
            self._store(first, bounds_of(chance, np.flatnonzero(np.diff(node, prepend=-1))), back, piece)
            for unit, end, good in zip(simple, ends.tolist(), whole.tolist()):
                if good:
                    self.end[unit] = end
                else:
                    rest.append(unit)
        for unit in rest:
            base, rows = self.nodes, [list(zip(*row)) for row in zip(*lattice(unit, self.v))]
            first = np.cumsum([0, *map(len, rows[:-1])])
            edges = list(chain.from_iterable(rows))
            back = np.array([base + a - 1 if a else -1 for a, _, _ in edges], np.int64)
            self._store(first, bounds_of(np.array([c for _, _, c in edges]), first), back, np.array([p for _, p, _ in edges], np.int32))
            self.end[unit] = self.nodes - 1

    def _store(self, first: np.ndarray, *values: np.ndarray):
        n = len(values[0])
        if self.nodes + len(first) > len(self.first):
            self.first = np.concatenate([self.first[: self.nodes], np.zeros((self.nodes + len(first)) // 4 + len(first), np.int64)])
        self.first[self.nodes : self.nodes + len(first)] = self.size + first
        if self.size + n > len(self.bounds):
            more = (self.size + n) // 4 + n
            self.bounds, self.back, self.piece = (
                np.concatenate([x[: self.size], np.zeros(more, x.dtype)]) for x in (self.bounds, self.back, self.piece))
        for store, value in zip((self.bounds, self.back, self.piece), values):
            store[self.size : self.size + n] = value
        self.nodes, self.size = self.nodes + len(first), self.size + n

    def _prepare(self, units: list[str]):
        """Units beyond the limit are dropped after the batch, from the end of the store; the rest stays."""
        for a in range(0, len(units), 4096):
            some = units[a : a + 4096]
            if self.size >= self.limit and self.kept is None:
                self.kept = self.nodes, self.size
            if self.kept is not None:
                self.passing.extend(some)
            self._learn(some)

    def _forget(self):
        if self.kept is not None:
            for unit in self.passing:
                del self.end[unit]
            self.nodes, self.size = self.kept
            self.passing, self.kept = [], None

    def _long(self, unit: str, key: np.uint64, place: int) -> list[int]:
        prev, pieces, chance = lattice(unit, self.v)
        out, at, step, one, places = [], len(prev), 0, np.array([key], np.uint64), np.array([place])
        while at:
            u, k = int(draws(one, places, step)[0]), 0
            row = bounds_of(np.array(chance[at - 1]), np.zeros(1, np.int64)).tolist()
            while u >= row[k]:
                k += 1
            out.append(pieces[at - 1][k])
            at, step = prev[at - 1][k], step + 1
        return out[::-1]

    def encode_flat(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the places where each text's begin and end."""
        cut = [self.v.unit.findall(" " + text) if text else [] for text in texts]
        flat = list(chain.from_iterable(cut))
        self._prepare([u for u in dict.fromkeys(flat) if u not in self.end and len(u) <= SHORT])
        at = np.fromiter(map(self.end.get, flat, repeat(-1)), np.int64, len(flat))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        key = np.repeat(np.array(keys, np.uint64), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        long = {i: self._long(flat[i], key[i], int(place[i])) for i in np.flatnonzero(at < 0).tolist()}
        live, steps = np.flatnonzero(at >= 0), []
        count = np.zeros(len(at), np.int64)
        for i, ids in long.items():
            count[i] = len(ids)
        step, now, key, place = 0, at[live], key[live], place[live]
        while len(live):
            edge, u = self.first[now], draws(key, place, step)
            beyond = np.flatnonzero(u >= self.bounds[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[u[beyond] >= self.bounds[edge[beyond]]]
            steps.append((live, self.piece[edge]))
            count[live] += 1
            now = self.back[edge]
            going = np.flatnonzero(now >= 0)
            live, now, key, place, step = live[going], now[going], key[going], place[going], step + 1
        stop = np.cumsum(count)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.int32)
        for k, (units, ids) in enumerate(steps):
            out[stop[units] - 1 - k] = ids
        for i, ids in long.items():
            out[stop[i] - len(ids) : stop[i]] = ids
        self._forget()
        return out, np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(sizes)])]

    def encode(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray | None]:
        out, bounds = self.encode_flat(texts, keys)
        return [None if t is None else out[bounds[r] : bounds[r + 1]] for r, t in enumerate(texts)]


def gives_back(ids: np.ndarray, bounds: np.ndarray, texts: list[str | None], table: pa.Array) -> list[bool | None]:
    """Whether decoding gives each text: bytes of all ids by one look-up in ``table``, compared with the text's own."""
    joined = table.take(pa.array(ids, pa.int32()))
    at = np.frombuffer(joined.buffers()[1], np.int64, len(ids) + 1)[bounds].tolist() if len(ids) else [0] * len(bounds)
    found = memoryview(joined.buffers()[2] or b"").cast("B") if len(ids) else memoryview(b"")  # unsigned, as the text's bytes
    return [None if t is None else found[a:b] == (b" " + t.encode() if t else b"") for t, a, b in zip(texts, at, at[1:])]


def decode(ids, v: Vocabulary) -> str | None:
    if ids is None:
        return None
    n = len(v.raw)
    text = b"".join([v.raw[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_SAMPLERS: dict[tuple[str, float], Sampler] = {}


def sampler_of(model: str, theta: float) -> Sampler:
    """One for a worker process: what it remembers changes its speed only."""
    if (model, theta) not in _SAMPLERS:
        _SAMPLERS.clear()
        _SAMPLERS[model, theta] = Sampler(Vocabulary(model, theta))
    return _SAMPLERS[model, theta]


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0, model: str = MODEL, theta: float = 1.0,
                     drop_text: bool = False) -> DataFrame:
    """``docs`` with piece_ids (array of int), n_pieces and lossless (decoding the ids gave the text)."""
    new = ("piece_ids", "n_pieces", "lossless")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    row, = fresh(docs, "row_key")
    keep = [f for f in docs.schema.fields if not (drop_text and f.name == text)]
    schema = StructType([*keep, StructField("piece_ids", ArrayType(IntegerType())), StructField("n_pieces", LongType()), StructField("lossless", BooleanType())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_of(model, theta)
        table = pa.array(sampler.v.raw, pa.large_binary())
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                texts = batch.column(text).to_pylist()
                keys = [xxhash.xxh64_intdigest((k or "").encode(), seed=seed) for k in batch.column(row).to_pylist()]
                ids, bounds = sampler.encode_flat(texts, keys)
                null = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32(), mask=np.append(null, False)), pa.array(ids, pa.int32()))
                count, same = pa.array(np.diff(bounds), pa.int64(), mask=null), pa.array(gives_back(ids, bounds, texts, table), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f.name) for f in keep], lists, count, same], [*[f.name for f in keep], *new])

    return docs.withColumn(row, F.col(f"`{key}`").cast("string")).mapInArrow(encoded, schema)


def decode_documents(docs: DataFrame, ids: str = "piece_ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with the text of its ids."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != text.lower()])
    names = docs.columns

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model)
        for batch in batches:
            texts = [decode(x, v) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text])

    return docs.mapInArrow(decoded, StructType([*docs.schema.fields, StructField(text, StringType())]))
