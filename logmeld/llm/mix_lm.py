"""Language-model scores by online logistic context mixing, beside an add-one unigram base.

A text is cut into segments: a word and the white-space byte after it, the last one with byte 0xFF, which no UTF-8 text holds, for the end.
Segments end themselves, so the text's probability is the product of theirs, each given what stands before it: the three bytes and the last
word. Equal segments after equal ones (units) are learned and scored once within FLUSH bytes of texts: most units of a corpus are rare, and
tables of them, counted and joined by Spark, were larger than the texts. Tasks learn from texts and score texts; only finished sums leave them.

A segment's bytes are coded bit by bit. Predictors look the bit up under hashed contexts: the last byte, two, three (of the text, also
across words), the segment so far, and the segment so far after the word before it. Each keeps counts of zeros and ones in slots of a table; their logits are added up under weights that a gate picks (bit of
the byte, longest context met before), and a last table, by gate and probability, refines the sum.

Learning is online: each task runs over its part of the texts, predicts before it counts, and moves weights along the
error, once for an occurrence. Counts are summed up over all tasks block by block, in a tree of bounded groups; weights are averaged. What reaches the driver
and the tasks is the finished table, of a size fixed by TABLES; collisions, not dropped contexts, are what its bound costs.

Base: words in lower case (A-Z), then one end; sum of log10((c + 1) / (N + V + 1)). Words met most are looked up in a broadcast table of HOT
rows; the rest are joined with all words by hash.

Defined cases: null texts are empty: an end alone. A null id counts as the empty string. Equal rows are rows of their own.
Without training documents all counts are 0. Empty tables give empty tables. Extra columns pass through ``score_documents``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from logmeld.llm.common import written
from logmeld.llm.packed_ids import slices

#: log2 of the slots of each predictor: one byte, two, three, the segment so far, the same after the word before.
TABLES = (16, 20, 21, 22, 22)
ORDERS = len(TABLES)
BASES = np.concatenate([[0], np.cumsum([1 << b for b in TABLES])])
SLOTS = int(BASES[-1])
BLOCK = 1 << 16
#: Gates: bit of the byte, longest context met.
LONGEST = ORDERS + 1
GATES = 8 * LONGEST
BUCKETS = 33
RATE = 0.5
#: Units between two steps of the weights, and between two of the counts at most: the first block has BATCH, each next one twice as many.
BATCH, BLOCKED = 2048, 16_384
HOT = 100_000
FOLDS, HELD_OUT = 7, 2
#: Bytes of texts that a task cuts at once, or one text, and how many distinct units of them make a batch.
FLUSH, HANDED = 2_000_000, 8_192
#: Bytes whose bits are mixed at once: what they need stays in a core's cache.
ROWS = 4_096
#: Partial tables that one task of the tree adds up.
FAN = 32
END = b"\xff"
#: Bytes before a segment that its first bits see; a text begins after bytes that no UTF-8 text holds.
TAIL = 3
START = b"\xff" * TAIL
#: What stands before a segment: a hash of the last word, and the last bytes.
BEFORE = 8 + TAIL

#: A logit of 1 as the model keeps it; 0 is a context never met.
SCALE = 1000

_WHITE, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_WHITE[list(b" \t\n\x0b\x0c\r")] = True
_LOWER[65:91] += 32
#: Arrays of bits have a row for each of a byte's eight, which numpy runs along.
_SHIFT = np.arange(7, -1, -1)[:, None]
#: Gates of the eight bits after the longest context.
_FULL = np.arange(8) * LONGEST + ORDERS
_MUL, _STEP, _SIZE, _LAST = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB))
_29, _32 = np.uint64(29), np.uint64(32)


def _bit(data: np.ndarray) -> np.ndarray:
    return (data >> _SHIFT.astype(np.uint8)) & np.uint8(1)


def _sums(data: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Running sums of hashed bytes, each by its place in its segment: a difference of two is the hash of what lies between them."""
    turn = np.arange(1, int(within.max(initial=0)) + 2).astype(np.uint64) * _STEP
    x = ((turn ^ (turn >> _32)) | np.uint64(1))[within]
    x *= data.astype(np.uint64) + np.uint64(1)
    x ^= x >> _32
    x *= _MUL
    x ^= x >> _29
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def _hashed(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    x = (sums + sizes.astype(np.uint64) * _SIZE) * _STEP
    x ^= x >> _32
    x *= _MUL
    return x ^ (x >> _29)


class Cut:
    """Units of some texts: ``data`` from ``starts`` on, ``sizes`` bytes each, the text they are ``of``, and what is ``known`` before them."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self.data = data = np.frombuffer(END.join([*texts, b""]), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begin = np.cumsum(lengths) - lengths
        cut = _WHITE[data]
        cut[begin + lengths - 1] = True
        ends = np.flatnonzero(cut) + 1
        self.starts = starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        self.sizes = sizes = ends - starts
        self.begin, self.first = begin, np.searchsorted(starts, begin)
        self.of = np.repeat(np.arange(len(texts)), np.diff(np.append(self.first, len(starts))))
        self.within = np.arange(len(data)) - np.repeat(starts, sizes)

    @cached_property
    def _before(self) -> tuple[np.ndarray, np.ndarray]:
        data, starts, sizes, of, begin, first = self.data, self.starts, self.sizes, self.of, self.begin, self.first
        ends = starts + sizes
        sums = _sums(data, self.within)
        word = _hashed(sums[ends - 1] - sums[starts], sizes - 1)
        met = np.maximum.accumulate(np.where(sizes > 1, np.arange(len(starts)), -1))
        met = np.concatenate([[-1], met[:-1]])[: len(starts)]
        last = np.where(met >= first[of], word[np.maximum(met, 0)], np.uint64(0)) if len(starts) else word
        known = np.full((len(starts), BEFORE), 0xFF, np.uint8)
        known[:, :8] = np.ascontiguousarray(last, "<u8").view(np.uint8).reshape(-1, 8)
        for k in range(1, TAIL + 1):
            here = np.flatnonzero(starts - k >= begin[of])
            known[here, BEFORE - k] = data[starts[here] - k]
        tail = known[:, 8:].astype(np.uint64) @ np.array([1, 256, 65536], np.uint64)
        return known, _hashed(_hashed(sums[ends] - sums[starts], sizes) ^ (last * _LAST), tail)

    @property
    def known(self) -> np.ndarray:
        return self._before[0]

    @property
    def keys(self) -> np.ndarray:
        return self._before[1]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(units with a word, hash of the word in lower case)."""
        here = np.flatnonzero(self.sizes > 1)
        sums = _sums(_LOWER[self.data], self.within)
        begin, sizes = self.starts[here], self.sizes[here] - 1
        return here, _hashed(sums[begin + sizes] - sums[begin], sizes).view(np.int64)

    def bytes_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of some units, their sizes)."""
        sizes = self.sizes[some]
        return self.data[np.repeat(self.starts[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes


def units(text: bytes | None) -> list[bytes]:
    """Each segment of the text after BEFORE bytes on what stands before it."""
    cut = Cut([text])
    raw = cut.data.tobytes()
    return [k.tobytes() + raw[a : a + n] for k, a, n in zip(cut.known, cut.starts.tolist(), cut.sizes.tolist())]


def segments(text: bytes | None) -> list[bytes]:
    return [u[BEFORE:] for u in units(text)]


def _binary(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of a column without nulls."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], np.diff(at)


def _cuts(column: pa.Array) -> Iterator[tuple[int, int, Cut]]:
    """Texts from, to, and their units."""
    column = column.cast(pa.binary())
    for a, b in slices(column, FLUSH):
        yield a, b, Cut(column.slice(a, b - a).to_pylist())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct units of each FLUSH bytes of texts, with their training occurrences and all."""
    for batch in batches:
        held = np.array(batch.column("held_out").to_pylist(), bool)
        for a, b, cut in _cuts(batch.column("text")):
            _, one, which = np.unique(cut.keys, return_index=True, return_inverse=True)
            every = np.bincount(which, minlength=len(one))
            train = np.bincount(which[~held[a:b][cut.of]], minlength=len(one))
            for k in range(0, len(one), HANDED):
                some = one[k : k + HANDED]
                yield pa.RecordBatch.from_arrays([
                    _binary(cut.known[some], np.full(len(some), BEFORE)), _binary(*cut.bytes_of(some)),
                    pa.array(train[k : k + HANDED], pa.int64()), pa.array(every[k : k + HANDED], pa.int64())], ["before", "segment", "n_train", "n_all"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each FLUSH bytes of texts, by the hash of their lower case, and their occurrences."""
    for batch in batches:
        for _, _, cut in _cuts(batch.column("text")):
            w, times = np.unique(cut.words()[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(times, pa.int64())], ["w", "c"])


class Bits:
    """Slots of the bits of some segments' bytes. What several bytes share is looked up once: orders 0 to 2 for distinct last bytes with the byte, order 3
    for distinct segments so far with it; ``place`` finds them for each byte, and ``own`` is the byte. Order 4 is looked up for each byte."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, known: np.ndarray):
        self.data = data
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        within = np.arange(len(data)) - start
        self.of = of = np.repeat(np.arange(len(sizes)), sizes)
        near = data.astype(np.uint32)
        for k in range(1, TAIL + 1):
            x = np.zeros(len(data), np.uint8)
            x[k:] = data[:-k]
            early = np.flatnonzero(within < k)
            x[early] = known[of[early], BEFORE + within[early] - k]
            near |= x.astype(np.uint32) << np.uint32(8 * k)
        sums = _sums(data, within)
        prefix = sums[:-1] - sums[start] + within.astype(np.uint64) * _SIZE
        last = np.ascontiguousarray(known[:, :8]).view("<u8").reshape(-1).astype(np.uint64)[of]
        at_near, near = pd.factorize(near)
        at_far, far = pd.factorize((prefix + data.astype(np.uint64) * _LAST) * _MUL)
        one = np.zeros(len(far), np.int64)
        one[at_far] = np.arange(len(data))
        self.place = [at_near, at_far]
        self.own = [(near & np.uint32(255)).astype(np.uint8)] * 3 + [data[one], data]
        before = (near >> np.uint32(8)).astype(np.uint64)
        self.begins = [
            self._of(0, before & np.uint64(0xFF)), self._of(1, before & np.uint64(0xFFFF)), self._of(2, before), self._of(3, prefix[one]),
            self._of(4, (prefix ^ (last * _MUL)) * _LAST)]

    def slots(self, order: int, a: int = 0, b: int | None = None) -> np.ndarray:
        x = (self.own[order][a:b].astype(np.int64) | 256) >> (_SHIFT + 1)  # 1, then the bits before each
        x += self.begins[order][a:b]
        x &= (1 << TABLES[order]) - 1
        x += BASES[order]
        return x

    def times(self, order: int, each: np.ndarray) -> np.ndarray:
        """How often each of ``own`` comes, from the times of each byte."""
        if order == ORDERS - 1:
            return each
        return np.bincount(self.place[order == 3], each, len(self.own[order]))

    @staticmethod
    def _of(order: int, context: np.ndarray) -> np.ndarray:
        """Where the nodes of a context begin; the shortest contexts fill their table without collisions."""
        if order == 0:
            return (context << np.uint64(8)).astype(np.int64)
        x = (context + np.uint64(1)) * _MUL
        x ^= x >> _32
        x *= _STEP
        return (x >> np.uint64(64 - TABLES[order])).astype(np.int64)

    def shared(self, logits) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Logits of the first four orders, and the longest of them met by ``place``; ``logits`` gives those of slots, and which of them were met."""
        inputs, met = zip(*[logits(self.slots(k)) for k in range(ORDERS - 1)])
        most = [m.view(np.uint8) * np.uint8(k + 1) for k, m in enumerate(met)]
        return list(inputs), [np.maximum(np.maximum(most[0], most[1]), most[2]), most[3]]

    def looked_up(self, a: int, b: int, most: list[np.ndarray], logits) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """For bytes a to b: their places, logits of the last order, the bits where that was not met (counted through), and these bits' gates."""
        at = [p[a:b] for p in self.place]
        x, met = logits(self.slots(ORDERS - 1, a, b))
        rare = np.flatnonzero(~met.reshape(-1))
        col, row = np.divmod(rare, b - a)
        longest = np.maximum(*[m[col, p[row]] for m, p in zip(most, at)])
        return at, x, rare, col * LONGEST + longest


def _bits(parts: list[bytes], before: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bit of the segments: slots (bits x ORDERS), the bit, and the segment's number. Without ``before`` they begin a text."""
    bits = Bits(*_listed(parts, before))
    near, far = bits.place
    slots = [bits.slots(k).T[near if k < 3 else far if k == 3 else slice(None)] for k in range(ORDERS)]
    return np.stack(slots, -1).reshape(-1, ORDERS), _bit(bits.data).T.reshape(-1), np.repeat(bits.of, 8)


def _listed(parts: list[bytes], before: list[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = np.frombuffer(b"".join(before or [bytes(8) + START] * len(parts)), np.uint8).reshape(-1, BEFORE)
    return np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts)), known


def _stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logit of a slot's next bit being one."""
    tenth = np.float32(0.1)
    return np.log((ones.astype(np.float32) + tenth) / (zeros.astype(np.float32) + tenth))


def _squash(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -20, 20)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _cells(x: np.ndarray, rare: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Where the last table has the bits of logits ``x``; the ``rare`` ones have a ``gate`` of their own."""
    x = x * 2
    x += BUCKETS // 2 + 0.5
    place = np.clip(x, 0, BUCKETS - 1, out=x).astype(np.int64)
    flat = place.reshape(-1)
    of_rare = flat[rare]
    place += _FULL[:, None] * BUCKETS
    flat[rare] = gate * BUCKETS + of_rare
    return place


_PART = "part long, block int, zeros binary, ones binary, weights array<double>, maps array<double>"


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Online over a part of the segments: counts by block, and once the weights and the sums of the last table."""
    from pyspark import TaskContext

    counts = np.zeros((SLOTS, 2), np.int32)
    both, single = counts.reshape(-1).view(np.int64), counts.reshape(-1)
    weights = np.full((ORDERS, GATES), 0.3)
    maps, weight = np.zeros((GATES, BUCKETS, 2)), 0.0

    def logits(slots):
        pairs = both.take(slots)
        each = pairs.view(np.int32).reshape(*slots.shape, 2)
        return _stretch(each[..., 0], each[..., 1]), pairs != 0

    def step(bits, begin, end, shared, share=None):
        """Weights and the last table by some bytes, each ``share`` times."""
        w = weights.astype(np.float32)
        full = w[:, _FULL, None]
        moved, among = np.zeros(weights.shape), np.zeros(GATES)
        for a in range(begin, end, ROWS):
            b = min(a + ROWS, end)
            at, last, rare, gate = bits.looked_up(a, b, shared[1], logits)
            inputs = [*[x.take(at[k == 3], 1) for k, x in enumerate(shared[0])], last]
            x = inputs[0] * full[0]
            for k in range(1, ORDERS):
                x += inputs[k] * full[k]
            bit, each, shares, few = _bit(bits.data[a:b]), float(b - a), None, None
            seldom = [y.reshape(-1)[rare] for y in inputs]
            x.reshape(-1)[rare] = sum(y * w[k, gate] for k, y in enumerate(seldom))
            error = bit.astype(float)
            error -= _squash(x)
            if share is not None:
                some = share[a - begin : b - begin].astype(float)
                error *= some
                each, shares = some.sum(), np.tile(some, 8)
                few = shares[rare]
            among[_FULL] += each - np.bincount(rare // (b - a), few, 8)
            errors = error.reshape(-1)[rare]
            error.reshape(-1)[rare] = 0
            for k in range(ORDERS):
                moved[k, _FULL] += (error * inputs[k]).sum(1)
            if len(rare):
                among += np.bincount(gate, few, GATES)
                for k in range(ORDERS):
                    moved[k] += np.bincount(gate, errors * seldom[k], GATES)
            place = _cells(x, rare, gate)
            place *= 2
            place += bit
            maps.reshape(-1)[:] += np.bincount(place.reshape(-1), shares, maps.size)
        weights[:] += RATE * moved / np.maximum(1.0, among)

    size = BATCH
    for batch in batches:
        data, sizes = _raw(batch.column("segment"))
        known, times = _raw(batch.column("before"))[0].reshape(-1, BEFORE), batch.column("n_train").to_numpy()
        ends, a = np.cumsum(sizes), 0
        while a < len(sizes):
            own, n = sizes[a : a + size], times[a : a + size]
            bits = Bits(data[ends[a] - sizes[a] : ends[a] - sizes[a] + own.sum()], own, known[a : a + size])
            each, until = np.repeat(n, own), np.append(0, np.cumsum(own))
            shared = bits.shared(logits)
            for k in range(0, len(own), BATCH):
                step(bits, until[k], until[min(k + BATCH, len(own))], shared)
            for order in range(ORDERS):
                met = np.tile(bits.times(order, each).astype(np.int32), 8)
                place = bits.slots(order)
                place *= 2
                place += _bit(bits.own[order])
                np.add.at(single, place.reshape(-1), met)
            again = np.flatnonzero(n > 1)
            if len(again):  # what later occurrences meet
                more = Bits(bits.data[np.repeat(n > 1, own)], own[again], known[a : a + size][again])
                step(more, 0, len(more.data), more.shared(logits), np.repeat(n[again] - 1, own[again]).astype(np.float32))
            weight += float(n.sum())
            a, size = a + size, min(2 * size, BLOCKED)
    if not weight:
        return
    part = TaskContext.get().partitionId()
    for k in range(0, SLOTS, BLOCK):
        zeros, ones = counts[k : k + BLOCK, 0], counts[k : k + BLOCK, 1]
        if zeros.any() or ones.any():
            yield _part(part, k // BLOCK, zeros, ones)
    yield pa.RecordBatch.from_pylist(
        [{"part": part, "block": -1, "zeros": None, "ones": None, "weights": [weight, *(weights * weight).reshape(-1)], "maps": maps.reshape(-1).tolist()}],
        pa.schema([("part", pa.int64()), ("block", pa.int32()), ("zeros", pa.binary()), ("ones", pa.binary()),
                   ("weights", pa.list_(pa.float64())), ("maps", pa.list_(pa.float64()))]))


def _part(part, block, zeros, ones) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([block], pa.int32()), pa.array([_pack(zeros)], pa.binary()), pa.array([_pack(ones)], pa.binary()),
         pa.array([None], pa.list_(pa.float64())), pa.array([None], pa.list_(pa.float64()))],
        ["part", "block", "zeros", "ones", "weights", "maps"])


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs: 1, 2, 4 or 8, which the first byte tells."""
    kind = np.min_scalar_type(int(x.max()))
    return bytes([kind.itemsize]) + zlib.compress(x.astype(kind.newbyteorder("<")).tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x[1:]), f"<u{x[0]}").astype(np.int64)


def _added(group: pd.DataFrame) -> pd.DataFrame:
    """FAN partial tables of a block, or weights, as one."""
    part, block = int(group["part"].iloc[0]), int(group["block"].iloc[0])
    if block < 0:
        row = [part, block, None, None, sum(np.asarray(x) for x in group["weights"]), sum(np.asarray(x) for x in group["maps"])]
    else:
        zeros, ones = (_pack(sum(map(_unpack, group[c]))) for c in ("zeros", "ones"))
        row = [part, block, zeros, ones, None, None]
    return pd.DataFrame([row], columns=["part", "block", "zeros", "ones", "weights", "maps"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a block as the logits that a model keeps."""
    for batch in batches:
        logits = []
        for zeros, ones in zip(batch.column("zeros").to_pylist(), batch.column("ones").to_pylist()):
            if zeros is None:
                logits.append(None)
                continue
            zeros, ones = _unpack(zeros), _unpack(ones)
            kept = np.clip(np.rint(_stretch(zeros, ones) * SCALE), -32767, 32767).astype("<i2")
            kept[(kept == 0) & (zeros + ones > 0)] = 1
            logits.append(zlib.compress(kept.tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("block"), pa.array(logits, pa.binary()), batch.column("weights"), batch.column("maps")], ["block", "logits", "weights", "maps"])


class Model:
    """A finished model: logits by slot in 1/SCALE, weights by gate, and the last table."""

    def __init__(self, logits: np.ndarray, weights: np.ndarray, maps: np.ndarray):
        self.logits, self.weights, self.maps = logits, (weights / SCALE).astype(np.float32), maps.astype(np.float32)

    def scores(self, data: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """log10 of each segment's probability after what stands before it."""
        bits = Bits(data, sizes, known)

        def logits(slots):
            x = self.logits.take(slots)
            return x.astype(np.float32), x != 0

        inputs, most = bits.shared(logits)
        w, full, maps = self.weights, self.weights[:, _FULL, None], self.maps.reshape(-1)
        near = inputs[0] * full[0]
        for k in (1, 2):
            near += inputs[k] * full[k]
        far, each = inputs[3] * full[3], np.empty(len(data))
        for a in range(0, len(data), ROWS):
            some = data[a : a + ROWS]
            at, last, rare, gate = bits.looked_up(a, a + len(some), most, logits)
            x = near.take(at[0], 1)
            x += far.take(at[1], 1)
            x += last * full[4]
            if len(rare):
                col, row = np.divmod(rare, len(some))
                seldom = [*[y[col, at[k == 3][row]] for k, y in enumerate(inputs)], last.reshape(-1)[rare]]
                x.reshape(-1)[rare] = sum(y * w[k, gate] for k, y in enumerate(seldom))
            p = maps.take(_cells(x, rare, gate))
            p += _squash(x)
            p /= 2
            p = (1.0 - _bit(some)) - np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p)  # in doubles: both chances of a bit add up to 1
            np.abs(p, out=p)
            for k in (4, 2, 1):
                p = p[:k] * p[k:]
            np.log10(p[0], out=each[a : a + len(some)])
        return np.bincount(bits.of, each, len(sizes))

    def log10(self, parts: list[bytes], before: list[bytes] | None = None) -> np.ndarray:
        return self.scores(*_listed(parts, before))


def train(table: DataFrame) -> Model:
    """From (segment, n_train), and what stands ``before`` where it is known, with n_train > 0."""
    before = "before" if "before" in table.columns else F.lit(bytearray(bytes(8) + START)).alias("before")
    return _model(table.filter("n_train > 0").select(before, "segment", "n_train").mapInArrow(_learned, _PART))


def train_texts(texts: DataFrame) -> Model:
    """From the rows of (text, held_out) that are not held out. What a task counts it learns from itself."""
    return _model(texts.filter("not held_out").mapInArrow(lambda batches: _learned(_counted(batches)), _PART))


def _model(parts: DataFrame) -> Model:
    parts = written(parts, "lm-parts")
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts = parts.withColumn("part", F.expr(f"part div {FAN}"))
        parts = written(parts.groupBy("block", "part").applyInPandas(_added, _PART), "lm-parts")
        most //= FAN
    logits = np.zeros(SLOTS, np.int16)
    weights, maps = np.full((ORDERS, GATES), 0.3), np.zeros((GATES, BUCKETS, 2))
    finished = parts.mapInArrow(_finished, "block int, logits binary, weights array<double>, maps array<double>")
    for row in finished.toLocalIterator():  # one row a block: SLOTS bounds it
        if row["block"] < 0:
            weights = np.array(row["weights"][1:]).reshape(weights.shape) / row["weights"][0]
            maps = np.array(row["maps"]).reshape(maps.shape)
        else:
            some = np.frombuffer(zlib.decompress(row["logits"]), "<i2")
            a = row["block"] * BLOCK
            logits[a : a + len(some)] = some
    middle = _squash((np.arange(BUCKETS) - BUCKETS // 2) / 2)
    return Model(logits, weights, (maps[..., 1] + 20 * middle) / (maps.sum(-1) + 20))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: the columns but the text, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    new = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    kept = [c for c in docs.columns if c != text]
    fold = F.pmod(F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    held = fold == HELD_OUT

    # words and their counts
    texts = docs.select(F.col(f"`{text}`").alias("text"), held.alias("held_out"))
    words = texts.filter("not held_out").mapInArrow(_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    words = written(words.select("w", "c", F.log10(F.col("c") + 1).alias("lc")), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = docs.filter(~held).count()
    n, v = n + ends, v + (ends > 0)
    # the most frequent, by steps of c: the HOT first of each task would meet in the driver
    step, cut, sizes = F.floor(F.log2("c") * 8), 8 * 64, 0
    for at, size in sorted(words.groupBy(step).count().collect(), reverse=True):
        sizes += size
        if sizes > HOT:
            break
        cut = at
    top = words.filter(step >= cut).select("w", "lc").toPandas().sort_values("w")
    hot = spark.sparkContext.broadcast({c: top[c].to_numpy() for c in top.columns})
    model = spark.sparkContext.broadcast(train_texts(texts))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_w, hot_lc = hot.value["w"], hot.value["lc"]
        for batch in batches:
            for a, b, cut in _cuts(batch.column("text")):
                size = b - a
                _, one, which = np.unique(cut.keys, return_index=True, return_inverse=True)
                scores = [model.value.scores(*cut.bytes_of(one[k : k + HANDED]), cut.known[one[k : k + HANDED]]) for k in range(0, len(one), HANDED)]
                ls = np.bincount(cut.of, np.concatenate(scores)[which], size)
                here, w = cut.words()
                of = cut.of[here]
                at = np.minimum(np.searchsorted(hot_w, w), max(len(hot_w) - 1, 0))
                there = hot_w[at] == w if len(hot_w) else np.zeros(len(w), bool)
                known = np.bincount(of[there], minlength=size)
                lc = np.bincount(of[there], hot_lc[at[there]], size).astype(np.float64)  # without words they are whole
                # the rest, once for a text
                of_rest, w = of[~there], w[~there]
                order = np.lexsort((w, of_rest))
                of_rest, w = of_rest[order], w[order]
                new = np.flatnonzero(np.append(True, (of_rest[1:] != of_rest[:-1]) | (w[1:] != w[:-1]))[: len(w)])
                times, offsets = np.diff(np.append(new, len(w))), np.concatenate([[0], np.cumsum(np.bincount(of_rest[new], minlength=size))])
                offsets = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(a, size), pa.array(np.bincount(cut.of, cut.sizes, size).astype(np.int64) - 1),
                    pa.array(np.bincount(of, minlength=size) + 1), pa.array(known), pa.array(lc, pa.float64()), pa.array(ls, pa.float64()),
                    pa.ListArray.from_arrays(offsets, pa.array(w[new])), pa.ListArray.from_arrays(offsets, pa.array(times))],
                    ["row", "n_bytes", "n_tokens", "known", "lc", "ls", "rest", "times"])

    # rows are numbered once, as they are written: numbers and the rest stay the same afterwards
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept], held.alias("held_out")).alias("row"), F.col(f"`{text}`").alias("text"))
    longs, reals, lists = ("n_bytes", "n_tokens", "known"), ("lc", "ls"), ("rest", "times")
    schema = StructType([numbered.schema["row"], *[StructField(c, LongType()) for c in longs], *[StructField(c, DoubleType()) for c in reals],
                         *[StructField(c, ArrayType(LongType())) for c in lists]])
    parts = numbered.mapInArrow(summed, schema)
    parts = written(parts.withColumn("uid", F.monotonically_increasing_id()), "lm-rows")
    rest = parts.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("uid", F.col("r.rest").alias("w"), F.col("r.times").alias("n"))
    sums = rest.join(words.select("w", "lc"), "w").groupBy("uid").agg(
        F.sum("n").alias("k2"), F.sum(F.col("n") * F.col("lc")).alias("c2"))
    out = parts.drop("rest", "times").join(sums, "uid", "left")
    zero = F.lit(0.0)
    end_known, end_log = int(ends > 0), float(np.log10(ends + 1))
    score = F.col("ls")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in kept], F.col("row.held_out").alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("k2", F.lit(0)) + end_known).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("lc") + F.coalesce("c2", zero) + end_log - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        score.alias("score"), F.when(F.col("n_bytes") > 0, -score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
