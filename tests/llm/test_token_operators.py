"""Hard negatives, id files and cross-tokenizer alignment against plain versions."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logmeld.llm import multi_index, packed_ids, queries, token_align
from tests.llm import fixtures as fx

ODD_TEXTS = [
    " leading", "trailing ", "two  spaces", "three   spaces and\n\n\nlines \n x", "tab\tand\x0bmore\x1codd", "don't we'll I'M '", "x" * 5000,
    "a <|endoftext|> b", "▁ literal", "日本語 テキスト　全角", "é ́x ﬁ Å", " no break  space", "\x00\x01", "😀😀 12345 3.14", "\u0085next line",
]


def test_simple8b_gives_ids_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 59, 60, 61, 119, 121, 1000, 70_000):
        for high in (1, 2, 50, 5000, 49_408, 2**33, 2**60, 2**63):
            ids = rng.integers(0, high, n, dtype=np.uint64)
            if n > 10:
                ids[3:7], ids[n // 2] = 0, 2**64 - 1
            assert (packed_ids.block_ids(packed_ids.block_bytes(ids)) == ids).all()
    zeros, narrow = np.zeros(1200, np.uint64), np.full(6000, 3, np.uint64)
    assert len(packed_ids.encode(zeros)[0]) == 10 and len(packed_ids.encode(narrow)[0]) == 200


def test_runs_read_alone_and_across_blocks(tmp_path):
    lengths = [1, 7, 300, 1, 1, 64, 129]
    ids = [np.arange(n, dtype=np.uint32) * (k + 3) for k, n in enumerate(lengths)]
    writer = packed_ids.Writer(open(tmp_path / "a.s8b", "wb"), block=64)
    for at in (slice(0, 3), slice(3, 5), slice(5, 7)):
        for own in ids[at]:
            writer.add(own)
        writer.close_run(lengths[at])
    writer.close()
    for run, at in ((2, 5), (0, 0), (1, 3)):
        reader = packed_ids.Reader(str(tmp_path / "a.s8b"))
        for first, n, got in reader.documents(run):
            assert first == sum(lengths[:at]) and n == lengths[at] and (got == ids[at]).all()
            at += 1


def _tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    words, a = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return words, a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts(spark):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    mixed = ["".join(rng.choice("ab zÉ,.'1\n\t  ́日😀▁s") for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    return [*fx.texts(), *ODD_TEXTS, *mixed, *given[:60]]


def test_words_are_encoded_as_whole_texts_are(texts):
    words, _, _ = _tokenizers()
    texts = [*texts, "DON'T A\u030a word\u0301s ÉCOLE x² ½a ΟΔΟΣ ΣΑΣ İ ǅ a.b'll"]
    encoder = packed_ids.WordEncoder(packed_ids.WORDS)
    for _ in range(2):
        ids, sizes = encoder.encode(pa.array(texts, pa.string()))
        assert len(sizes) == len(texts) and sizes.sum() == len(ids)
        for t, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            assert own.tolist() == (words.encode(t, add_special_tokens=False).ids if t else [])
    assert len(encoder.encode(pa.array([], pa.string()))[0]) == 0


def test_units_are_aligned_as_whole_texts_are(texts):
    aligner = token_align.Aligner()
    whole = token_align.Aligner()
    whole.cuts = False
    assert aligner.cuts
    for _ in range(2):
        for got in (texts, texts[-60:], [None], []):
            got = pa.array(got, pa.string())
            one, other = aligner.texts(got), whole.texts(got)
            assert (one[0] == other[0]).all() and one[1] == other[1] and (one[2] == other[2]).all()


def test_id_files_against_the_tokenizer(spark, monkeypatch):
    monkeypatch.setattr(packed_ids, "RUN", 900)
    rows = fx.documents(spark).unionByName(fx.documents(spark, [(100 + k, t) for k, t in enumerate(ODD_TEXTS)]))
    words, _, _ = _tokenizers()
    plain = sorted(((r.doc_id is not None, r.doc_id or 0, [*(words.encode(r.text, add_special_tokens=False).ids if r.text else []), 2]) for r in rows.collect()),
                   key=lambda r: r[:2])
    got = packed_ids.pack_documents(rows.repartition(5)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [i if known else None for known, i, _ in plain]
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    ids = lambda rs: Counter((i, tuple(x)) for i, x in rs)
    assert ids((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == ids((i if known else None, x) for known, i, x in plain)
    assert packed_ids.pack_documents(fx.documents(spark, [])).count() == 0


def test_tasks_read_several_runs(spark, monkeypatch):
    monkeypatch.setattr(packed_ids, "RUN", 2)
    rows = spark.createDataFrame([(k, f"word {k}") for k in range(200)], "doc_id long, text string").coalesce(1)
    runs = packed_ids.write_ids(rows, packed_ids.scratch_path(spark, "packed-ids"))
    got = packed_ids.read_ids(runs)
    assert runs.count() > 50 and got.rdd.getNumPartitions() <= runs.count() // 4
    assert [r.doc_id for r in got.orderBy("start").collect()] == list(range(200))


def test_words_of_a_batch_are_looked_up_once():
    texts = pa.array([" ".join(f"w{k}" for k in range(40_000))] * 40, pa.string())  # 9 MB
    assert len([*packed_ids.slices(texts)]) == 1


def test_string_names_and_remote_ids(spark):
    rows = spark.createDataFrame([("b", "one two"), ("a", "three"), (None, None)], "doc_id string, text string")
    got = packed_ids.pack_documents(rows).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), ("a", 1), ("b", 3)]


def _aligned_plainly(texts):
    """n_a, n_b, groups, links of each text, from byte ranges of all pairs of tokens."""
    _, a, b = _tokenizers()
    letters, known = token_align.Aligner().a_bytes, {}
    out = []
    for t in texts:
        if t is not None and t in known:
            out.append(known[t])
            continue
        a_ids = a.encode(" " + t, add_special_tokens=False).ids if t else []
        b_ids = b.encode(t) if t else []
        a_parts = [letters[k] for k in a_ids]
        b_parts = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in b_ids]
        if not t or b"".join(a_parts) != (" " + t).encode() or b"".join(b_parts) != (" " + t).encode():
            out.append((0, 0, [], []))
            continue
        spans = [[], []]
        for side, parts in zip(spans, (a_parts, b_parts)):
            at = 0
            for part in parts:
                side.append((at, at + len(part)))
                at += len(part)
        cut = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [[[], []] for _ in cut]
        for which, (ids, side) in enumerate(zip((a_ids, b_ids), spans)):
            for k, (_, e) in zip(ids, side):
                groups[bisect.bisect_left(cut, e)][which].append(k)
        links, j0 = [], 0
        for i, (s, e) in zip(a_ids, spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b_ids) and spans[1][j][0] < e:
                links.append((i, b_ids[j]))
                j += 1
        out.append((len(a_ids), len(b_ids), groups, links))
        known[t] = out[-1]
    return out


def test_alignment_against_byte_ranges(spark, texts, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(token_align, "PUT_BYTES", 5_000)
    data = [(i, t) for i, t in enumerate(texts)] + [(3, "One two three four"), (None, "no name"), (3, "One two three four")]
    plain = _aligned_plainly([t for _, t in data])
    held = Counter(p for _, _, _, links in plain for p in set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    want = Counter()
    for (i, _), (n_a, n_b, groups, links) in zip(data, plain):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[i, n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), text] += 1
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, block string, pairs int").repartition(3)
    stored = packed_ids.written(token_align.align_texts(docs), "aligned")
    assert stored.filter("is_block").count() > 3
    got = token_align.rate_links(stored)
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got.collect()) == want


def test_alignment_query(spark, tmp_path):
    fx.documents(spark).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_token_alignment(spark, str(tmp_path)).collect()
    assert len(got) == len(fx.texts()) + 2
    for r, (n_a, n_b, groups, links) in zip(got, _aligned_plainly([dict(fx.documents(spark).select("doc_id", "text").collect())[r.doc_id] for r in got])):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, len(groups), len(links))
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
    (tmp_path / "none").mkdir()
    fx.documents(spark, []).select("doc_id", "text").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op13_token_alignment(spark, str(tmp_path / "none")).count() == 0
    assert queries.op12_token_files(spark, str(tmp_path / "none")).count() == 0


def test_id_file_query(spark, tmp_path):
    words, _, _ = _tokenizers()
    fx.documents(spark, [(k, t) for k, t in enumerate(ODD_TEXTS)]).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op12_token_files(spark, str(tmp_path)).collect() if r.doc_id not in (None, 5)}
    for k, r in rows.items():
        ids = [*words.encode(ODD_TEXTS[k], add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


# ---- hard negatives ---------------------------------------------------------------------

def _mined_plainly(rows, is_anchor, top=5):
    """rows: (id, label, whole vector)."""
    out = Counter()
    anchors = {(i, lab, tuple(v)) for i, lab, v in rows if is_anchor(i)}
    for i, lab, v in anchors:
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in rows if len(w) == len(v)]
        positives = sorted([(-s, j) for s, j, other in scored if other == lab and j != i])[:top]
        for s, j in positives:
            p = -s
            fits = sorted([(-n, k) for n, k, other in scored if other != lab and 80 * p <= 100 * n <= 100 * p])[:top]
            for rank, (n, k) in enumerate(fits, 1):
                out[i, j, rank, k, p, -n] += 1
    return out


def _mined(df, is_anchor, **more):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r[c] for c in cols) for r in multi_index.mine_negatives(df, is_anchor, **more).collect())


@pytest.mark.parametrize("size", [1, 2, 7, 16])
def test_hard_negatives_against_all_pairs(spark, size, monkeypatch):
    rng = np.random.default_rng(size)
    monkeypatch.setattr(multi_index, "SEGMENT", 70)
    monkeypatch.setattr(multi_index, "READ", 9)
    rows = [(k, int(rng.integers(0, 3)), rng.integers(-9, 10, size).tolist()) for k in range(300)]
    rows += [(k, 1, rows[5][2]) for k in range(300, 340)] + rows[:3] + [(400, 0, [0] * size), (410, 9, [3] * size), (420, 0, [2] * (size + 1)), (421, 1, [2] * (size + 1))]
    df = spark.createDataFrame(rows, "id long, label long, vector array<long>").repartition(3)
    want = _mined_plainly(rows, lambda i: i % 10 == 0)
    assert want and _mined(df, F.col("id") % 10 == 0, sample=100) == want
    assert _mined(df, F.col("id") % 10 == 0, sample=3, pass_bytes=500) == want


def test_scores_beyond_doubles_are_exact(spark):
    big = 2**29 + 1
    rows = [(0, 0, [big, big]), (1, 0, [big, big]), (2, 1, [big, big - 1]), (3, 1, [big, big]), (4, 1, [big - 1, big])]
    df = spark.createDataFrame(rows, "id long, label long, vector array<long>")
    assert _mined(df, F.col("id") == 0) == _mined_plainly(rows, lambda i: i == 0)


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, 1, [0.5, 0.1]), (None, 1, [0.5, 0.1]), (2, None, [0.5, 0.1]), (3, 1, None), (4, 1, [0.5, None]), (5, 1, [0.5, nan]), (6, 1, [inf, 0.0]), (7, 1, []), (8, 2, [-0.001, 1e30])]
    df = spark.createDataFrame(data, "id long, label int, v array<double>")
    got = multi_index.usable(df, F.col("id"), F.col("label"), F.col("v"), 256.0).orderBy("id").collect()
    assert [(r.id, r.vector) for r in got] == [(1, [128, 25]), (7, []), (8, [-1, 2**63 - 1])]
    none = multi_index.mine_negatives(multi_index.usable(df.limit(0), F.col("id"), F.col("label"), F.col("v")), F.col("id") % 2 == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    multi_index.mine_negatives(multi_index.usable(df, F.col("id"), F.col("label"), F.col("v")), F.col("id") > 0).collect()
    with_clash = df.select("id", "label", F.col("v").alias("vector"), F.lit(1).alias("h"), F.lit(2).alias("scores"))
    assert multi_index.usable(with_clash, F.col("id"), F.col("label"), F.col("vector")).count() == 3


def test_heap_skips_cells_that_cannot_matter(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (40, 8))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-2, 3, (4000, 8))).astype(np.int64)
    books = multi_index.fit_codebook(x[:, :4]), multi_index.fit_codebook(x[:, 4:])
    cells = np.stack([multi_index._nearest(x[:, :4].astype(float), books[0]), multi_index._nearest(x[:, 4:].astype(float), books[1])], 1)
    segment = multi_index.Segment(np.arange(4000), np.zeros(4000, np.int64), x, cells, books)
    read, plain = [], segment.scores
    segment.scores = lambda rows, q, small: read.append(len(rows)) or plain(rows, q, small)
    monkeypatch.setattr(multi_index, "READ", 100)
    found = segment.search(x[0], [(None, None)], 5, lambda rows: np.ones(len(rows), bool))
    scores = x @ x[0]
    assert [s for s, _ in found[0]] == sorted(scores.tolist(), reverse=True)[:5] and sum(read) < 2000
