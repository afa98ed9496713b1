"""Hard-negative mining over an inverted multi-index.

Vectors are cut into two halves; each half has a codebook, and a pair of codewords is a cell. Against an anchor, a cell's score is
at most the sum of two half bounds: the codeword's inner product plus the anchor's half length times the radius of the codeword. A heap visits
cells by that sum, largest first (multi-sequence), and stops once the windows asked for are certified: no cell ahead can hold a
row that belongs into them. So results are exact, whatever the codebooks.

The index is a stored table of all rows with their cell. A task takes its rows in segments, each a small multi-index with radii of its own; what
segments find is merged by Spark, five rows a window and segment. Anchors go to the tasks in passes of PASS_BYTES.

Two searches: the first ``top`` rows of the anchor's label; then, for each score of these, the first ``top`` rows of other labels within the window
that the score sets.

Defined cases: rows with a null id, label, vector or component, or a component that is not finite, take no part. Vectors of different
lengths never meet. Equal anchors (id, label, vector) are one. Rows of the anchor's own id are no positives; other rows with equal ids are rows of
their own, so a positive that is there twice has its negatives twice. Components are whole numbers after ``scale``; scores
are exact up to 2^53 by doubles, beyond by Python's integers, and end at the limits of a long. Empty tables give empty tables. Other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logmeld.session import written

#: Rows that the codebooks are fitted on, codewords of a half, and rounds of fitting.
SAMPLE, CODEWORDS, ROUNDS = 4_096, 16, 8
#: Rows of a segment, and bytes of anchors that go to the tasks at once.
SEGMENT, PASS_BYTES = 10_000, 32_000_000
#: Rows that a search reads before it looks again whether its windows are certified.
READ = 1_000
SEED = 7
_LONG = (-(2**63), 2**63 - 1)


# ---- codebooks --------------------------------------------------------------------------

def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1) - 2.0 * (x @ words.T), axis=1)


def fit_codebook(x: np.ndarray, k: int = CODEWORDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k-means over the rows of x; fewer codewords where x has fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    words = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(x, words)
        for c in range(len(words)):
            if (own == c).any():
                words[c] = x[own == c].mean(0)
    return words


def fit_codebooks(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Two codebooks for each length of vectors among ``sample`` rows, chosen by a hash of their id."""
    chosen = vectors.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample).select("vector").toArrow().column("vector").to_pylist()
    out = {}
    for size in {len(v) for v in chosen if len(v) > 1}:
        x = np.array([v for v in chosen if len(v) == size], np.float64)
        out[size] = fit_codebook(x[:, : size // 2]), fit_codebook(x[:, size // 2 :])
    return out


# ---- a segment --------------------------------------------------------------------------

class Segment:
    """The rows of one label set and length, sorted by cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, cells: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        order = np.lexsort((ids, cells[:, 1], cells[:, 0]))
        self.ids, self.labels, self.whole, cells = ids[order], labels[order], x[order], cells[order]
        self.x = self.whole.astype(np.float64)
        half = self.half = x.shape[1] // 2
        self.words, self.radii, self.names = [], [], []
        for part, book, own in ((self.x[:, :half], books[0], cells[:, 0]), (self.x[:, half:], books[1], cells[:, 1])):
            names, place = np.unique(own, return_inverse=True)
            far = np.zeros(len(names))
            np.maximum.at(far, place, np.sqrt(((part - book[own]) ** 2).sum(1)))
            self.words.append(book[names])
            self.radii.append(far)
            self.names.append(names)
        at = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(1))) if len(ids) else np.zeros(0, np.int64)
        self.cell = {tuple(cells[a]): (a, b) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)])}
        self.longest = float(np.sqrt((self.x**2).sum(1)).max()) if len(ids) else 0.0

    def scores(self, rows: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
        if small:
            return (self.x[rows] @ q.astype(np.float64)).astype(np.int64)
        exact = self.whole[rows].astype(object) @ q.astype(object)
        return np.array([min(max(s, _LONG[0]), _LONG[1]) for s in exact.tolist()], np.int64)

    def same(self, label: int, number: int):
        """Rows of the label, without those of the anchor's own id."""
        return lambda rows: (self.labels[rows] == label) & (self.ids[rows] != number)

    def other(self, label: int):
        return lambda rows: self.labels[rows] != label

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, slice]]:
        """(bound, rows) of each cell, largest bound first. A bound holds for all cells from there on."""
        sides = []
        for part, words, radii in ((q[: self.half], self.words[0], self.radii[0]), (q[self.half :], self.words[1], self.radii[1])):
            reach = words @ part + np.sqrt((part**2).sum()) * radii
            order = np.argsort(-reach)
            sides.append((reach[order].tolist(), order.tolist()))
        (u, first), (v, second) = sides
        slack = 1e-9 * (1.0 + float(np.sqrt((q**2).sum())) * self.longest)
        heap, seen = [(-(u[0] + v[0]), 0, 0)] if u and v else [], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            rows = self.cell.get((self.names[0][first[i]], self.names[1][second[j]]))
            if rows:
                yield -bound + slack, slice(*rows)
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(u) and b < len(v) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (-(u[a] + v[b]), a, b))

    def search(self, q: np.ndarray, windows: list[tuple[int | None, int | None]], top: int, wanted) -> list[list[tuple[int, int]]]:
        """For each window (least, most; None: open), the first ``top`` (score, id) of rows that ``wanted`` lets through."""
        small = float(np.sqrt((q.astype(np.float64) ** 2).sum())) * self.longest < 2.0**52
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        open_ = set(range(len(windows)))
        cells = self.visit(q.astype(np.float64))
        for bound, rows in cells:
            open_ = {k for k in open_ if not (
                (windows[k][0] is not None and bound < windows[k][0]) or (len(found[k]) == top and found[k][-1][0] > bound))}
            if not open_:
                break
            # cells ahead are read together, in their order, up to READ rows
            parts, n = [np.arange(rows.start, rows.stop)], rows.stop - rows.start
            while n < READ and (ahead := next(cells, None)) is not None:
                parts.append(np.arange(ahead[1].start, ahead[1].stop))
                n += len(parts[-1])
            rows = np.concatenate(parts)
            scores = self.scores(rows, q, small)
            floor = min(_LONG[0] if windows[k][0] is None else windows[k][0] for k in open_)
            floor = max(floor, min(found[k][-1][0] if len(found[k]) == top else _LONG[0] for k in open_))
            ceiling = max(_LONG[1] if windows[k][1] is None else windows[k][1] for k in open_)
            some = np.flatnonzero((scores >= floor) & (scores <= ceiling))
            some = some[wanted(rows[some])]
            if not len(some):
                continue
            ids, scores = self.ids[rows[some]], scores[some]
            for k in open_:
                least, most = windows[k]
                inside = np.ones(len(ids), bool) if least is None else scores >= least
                if most is not None:
                    inside &= scores <= most
                s, i = scores[inside], ids[inside]
                if len(s) > 4 * top:  # all that tie with the last of the first ``top`` stay
                    cut = np.partition(s, len(s) - top)[len(s) - top]
                    s, i = s[s >= cut], i[s >= cut]
                if len(s):
                    found[k] = sorted([*found[k], *zip(s.tolist(), i.tolist())], key=lambda r: (-r[0], r[1]))[:top]
        return found


# ---- tables -----------------------------------------------------------------------------

def usable(df: DataFrame, vec_id: Column, label: Column, vector: Column, scale: float = 256.0) -> DataFrame:
    """(id, label, vector): the rows that take part, with components floor(scale * x)."""
    rows = df.select(vec_id.cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("id is not null and label is not null and vector is not null").filter(fine)
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(scale) * x)))


def _by_length(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(length, vectors, the named columns) for each length of vectors in a batch."""
    sizes = np.diff(batch.column("vector").offsets.to_numpy())
    flat = batch.column("vector").flatten().to_numpy()
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        whole = flat if len(rows) == len(sizes) else flat[np.repeat(sizes == size, sizes)]
        yield size, whole.reshape(len(rows), size), [batch.column(c).to_numpy()[rows] for c in columns]


def build_index(vectors: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, label, vector, c1, c2): every row of ``usable`` with its cell. Vectors of a length that the sample has not share a cell around zero."""
    books = fit_codebooks(vectors, sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, x, (ids, labels) in _by_length(batch, "id", "label"):
                first, second = _books(books, size)
                y, half = x.astype(np.float64), size // 2
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), pa.array(labels), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(x.ravel())),
                    pa.array(_nearest(y[:, :half], first)), pa.array(_nearest(y[:, half:], second))], names=["id", "label", "vector", "c1", "c2"])

    index = written(vectors.mapInArrow(assign, "id long, label long, vector array<long>, c1 long, c2 long"), "multi-index")
    index.books = books
    return index


def _books(books: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    return books.get(size) or (np.zeros((1, size // 2)), np.zeros((1, size - size // 2)))


def _passes(anchors: DataFrame, pass_bytes: int) -> int:
    size = anchors.agg(F.sum(F.size("vector") * 8 + 100)).first()[0] or 0
    return max(1, -(-size // pass_bytes))


def _search(index: DataFrame, anchors: DataFrame, books: dict, top: int, same_label: bool, pass_bytes: int) -> DataFrame:
    """The first rows of each segment for each anchor (id, label, h, vector, scores, least): (anchor_id, anchor_label, h, window, id, score)."""
    spark, n = index.sparkSession, _passes(anchors, pass_bytes)
    segments = index.repartition(max(1, -(-index.count() // SEGMENT)), F.xxhash64("id", "vector"))

    def task(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, SEGMENT):
                    out = []
                    for size, x, (ids, labels, c1, c2) in _by_length(batch.slice(at, SEGMENT), "id", "label", "c1", "c2"):
                        segment = Segment(ids, labels, x, np.stack([c1, c2], 1), _books(books, size))
                        for number, label, h, q, scores, least in asked.get(size, ()):
                            wanted = segment.same(label, number) if same_label else segment.other(label)
                            windows = [(None, None)] if same_label else [*zip(least, scores)]
                            for window, rows in zip([0] if same_label else scores, segment.search(q, windows, top, wanted)):
                                out += [(number, label, h, window, i, s) for s, i in rows]
                    columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "anchor_label", "h", "window", "id", "score"])

        return run

    found = None
    for k in range(n):
        mine = anchors.filter(F.pmod(F.col("h"), F.lit(n)) == k).toArrow()
        asked: dict[int, list] = {}
        for r in mine.to_pylist():
            asked.setdefault(len(r["vector"]), []).append((r["id"], r["label"], r["h"], np.array(r["vector"], np.int64), r["scores"], r["least"]))
        part = segments.mapInArrow(task(spark.sparkContext.broadcast(asked)), "anchor_id long, anchor_label long, h long, window long, id long, score long")
        found = part if found is None else found.unionByName(part)
    return found


def _first(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of what the segments found, with their rank."""
    order = Window.partitionBy("anchor_id", "anchor_label", "h", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def mine_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: tuple[int, int] = (80, 100),
                   sample: int = SAMPLE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from ``usable`` vectors.

    A negative's score is at most the positive's, and at least ``low[0] / low[1]`` of it.
    """
    index = build_index(vectors, sample)
    books = index.books
    anchors = written(
        index.filter(is_anchor).select("id", "label", "vector").distinct().withColumn("h", F.xxhash64("vector")), "anchors")
    none = F.array().cast("array<long>")
    positives = written(_first(_search(
        index, anchors.withColumns({"scores": none, "least": none}), books, n_positives, True, pass_bytes), n_positives), "positives")
    positives = positives.select("anchor_id", "anchor_label", "h", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # the window of a negative score is empty
    windows = positives.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("id"), F.col("anchor_label").alias("label"), "h").agg(
        F.sort_array(F.collect_set("positive_score")).alias("scores"))
    least = F.transform("scores", lambda s: F.ceil(s.cast("decimal(38,0)") * low[0] / low[1]).cast("long"))
    asked = written(anchors.join(windows.withColumn("least", least), ["id", "label", "h"]), "windows")
    negatives = _first(_search(index, asked, books, n_negatives, False, pass_bytes), n_negatives)
    negatives = negatives.select(
        "anchor_id", "anchor_label", "h", F.col("window").alias("positive_score"), "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor_id", "anchor_label", "h", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
