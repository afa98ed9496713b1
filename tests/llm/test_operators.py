"""Every operator against a plain version, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logmeld.llm import chunk_dedup, decontaminate, line_quality, mix_lm, near_dup, page_text, piece_lattice, sharding, token_scan, url_rules
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return fx.documents(spark, [])


def test_shards_are_gapless_even_and_reproducible(spark, docs, none):
    rows = docs.unionByName(docs.limit(3))
    out = sharding.shard(rows, 4, seed=3)
    got = out.collect()
    assert len(got) == rows.count()
    for s, n in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(4)) <= 1
    key = lambda rs: Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rs)
    assert key(got) == key(sharding.shard(rows.repartition(3), 4, seed=3).collect())
    assert sharding.shard(none, 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 17, 1000])
def test_permutation_is_a_bijection(spark, n):
    df = spark.range(n).select(F.col("id").alias("i"), F.lit(n).cast("long").alias("t"))
    assert sorted(r["p"] for r in sharding.permute(df, "i", "t", "p", seed=9).collect()) == list(range(n))


def test_runs_of_equal_rows_are_dealt_in_pieces(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"))
    got = sharding.row_numbers(df, run=64).collect()
    assert sorted(r["row_number"] for r in got) == list(range(1000))


def test_token_counts_across_blocks(spark, docs, none, tmp_path):
    path = str(tmp_path / "flat")
    token_scan.pack(docs.repartition(3), path, block=50)
    stored = spark.read.parquet(path)
    counts = token_scan.count_tokens(stored.filter("ids is not null"))
    encode = token_scan.tokenizer().encode_ordinary
    want = Counter(len(encode(r["text"] or "")) for r in docs.collect())
    assert Counter(r["n_tokens"] for r in counts.collect()) == want
    got = token_scan.count_document_tokens(docs)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter(
        (r["doc_id"], len(encode(r["text"] or ""))) for r in docs.collect())
    assert token_scan.count_document_tokens(none).count() == 0


def test_open_last_document_of_a_raw_file(spark, tmp_path):
    import numpy as np

    end = token_scan.END
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, end, end, 3, end, 4, 5], "<u2").tobytes())
    blocks = token_scan.blocks_of_files(spark, str(tmp_path), block=3)
    got = token_scan.count_tokens(blocks).orderBy("doc").collect()
    assert [(r["doc"], r["start"], r["n_tokens"]) for r in got] == [(0, 0, 2), (1, 3, 0), (2, 4, 1), (3, 6, 2)]


def test_flat_files_are_read_in_ranges(spark, docs, tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_scan, "RUN", 2)
    ids = np.arange(1003, dtype="<u2")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a b.bin").write_bytes(ids.tobytes())
    got = token_scan.blocks_of_files(spark, str(tmp_path / "one"), block=50).select("*", F.spark_partition_id().alias("task")).orderBy("block").collect()
    assert [r["block"] for r in got] == list(range(21)) and b"".join(r["ids"] for r in got) == ids.tobytes()
    assert len({r["task"] for r in got}) > 2
    stored = token_scan.write_files(docs.repartition(2), (tmp_path / "two").as_uri())
    files = stored.filter("path is not null").collect()
    flat = np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / "two").iterdir())])
    assert 2 * len(flat) == sum(r["length"] for r in files) and (flat == token_scan.END).sum() == docs.count()


def test_passages_go_and_clean_texts_stay(docs, none):
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_substrings(docs).collect()}
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got[9]["text"] == given[9] and got[10]["removed_words"] > 30 and got[10]["text"].startswith(fx.prose(91, 150)[:900])
    assert "shared30" in got[9]["text"] and "shared30" not in got[10]["text"]
    for i in (0, 1, 2, 3, 4, 5, 14, None):
        assert got[i]["text"] == given[i] and got[i]["removed_words"] == 0
    assert chunk_dedup.dedup_substrings(none).count() == 0


def test_chunk_ends_are_the_greatest_hashes():
    text = fx.prose(3, 400).encode()
    h = [0] * len(text)
    for k in range(len(text)):
        for j in range(16):
            if k >= j:
                h[k] = (h[k] + (int(chunk_dedup._GEAR[text[k - j]]) << 2 * j)) % 2**32
    r = chunk_dedup.REACH
    want = [k + 1 for k in range(len(h)) if h[k] > max(h[max(0, k - r) : k], default=0) and h[k] >= max(h[k + 1 : k + 1 + r], default=0)]
    assert [e for e in chunk_dedup.chunk_ends(text).tolist() if e < len(text)] == [e for e in want if e < len(text)]
    moved = chunk_dedup.chunk_ends(b"inserted " + text).tolist()
    assert len({e - 9 for e in moved} & set(want)) >= len(want) - 2


def test_url_rules(spark):
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("example.com", "/en/", "block"), ("example.com", "/en", "allow"), ("a.b", "/xy", "block"), ("b", "/xy", "allow"), ("b", "/xyab", "block"), (None, None, None)],
        "host string, path string, verdict string")
    urls = ["http://WWW.Example.com/en/1?x=/de/", "https://example.com/english", "ftp://com", "http://com/", None, "nothing", "http://x.a.b/xyab#en",
            "http://a.b/xy", "http://..b/xya", "http://" + "s." * 500 + "example.com" + "/en" * 900, "http://examplecom/en/"]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, Host string, digest string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules).collect()}
    table = [r for r in rules.collect() if r["verdict"]]

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = fx.lower(host)
        fits = [r for r in table if (host == r["host"] or host.endswith("." + r["host"])) and path.startswith(r["path"])]
        best = max(fits, key=lambda r: (len(r["host"] + r["path"]), len(r["host"]), r["verdict"] == "block"), default=None)
        return (best["host"] + best["path"], best["verdict"]) if best else (None, "allow")

    assert got == {k: judge(u) for k, u in enumerate([*urls, urls[0]])}
    assert url_rules.judge_urls(pages, rules.limit(0)).filter("verdict <> 'allow'").count() == 0
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_decontamination(spark, docs, none, block_bytes):
    words = fx.prose(40, 200).replace(".", "").split()
    items = [(1, " ".join(words[20:60])), (2, " ".join(words[20:60]).upper()), (10, "four"), (3, "word5x9 word8x4"), (4, None), (5, "..."), (None, " ".join(words[:14])),
             (6, " ".join([*words[100:112], "elsewhere", *words[113:140]]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_hit string")
    got = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes).collect()
    named = [("null" if i is None else i, t) for i, t in items]
    for r in got:
        n, hit, ids = fx.contamination(r["text"], named)
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(ids), sha, hit > 0 and 20 * hit >= n)
    assert len(got) == docs.count()
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_near_duplicates(spark, docs, none):
    import random

    rnd, base = random.Random(1), [f"t{k}" for k in range(120)]
    family = []
    for k in range(60):  # copies of one text with a few words changed: linked through it, not all with each other
        words = list(base)
        for _ in range(k % 5):
            words[rnd.randrange(120)] = f"new{k}"
        family.append((100 + k, " ".join(words)))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None] + family
    df = fx.documents(spark, rows)
    sets = {i: fx.shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = fx.groups(pairs, sets)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(df).collect()}
    assert {i: r["component_id"] for i, r in got.items() if i is not None} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items() if i is not None)
    kept = near_dup.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i in want if want[i] == i)
    assert kept.columns == df.columns
    assert near_dup.near_duplicates(none).count() == 0


def test_large_buckets_do_not_overflow(spark):
    # hashes of one sign: their sum leaves 64 bits after some hundred members
    members = spark.range(4000).filter("xxhash64(id) > 0").select(F.explode(F.expr("array(5L, 6L)")).alias("bkey"), F.col("id").alias("cid"))
    other = members.filter("bkey = 5 and cid > 10").select(F.lit(7).cast("long").alias("bkey"), "cid")
    got = {r["bkey"]: (r["size"], r["n"]) for r in near_dup._one_of_each(members.unionByName(other)).groupBy("bkey", "size").agg(F.count("cid").alias("n")).collect()}
    n, m = members.count() // 2, other.count()
    assert got == {5: (n, n), 7: (m, m)} and m < n


def test_low_bits_estimate_similarity():
    import numpy as np

    a = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = a[200:]
    x, y = near_dup.planes(near_dup.minima(a)), near_dup.planes(near_dup.minima(b))
    differ = np.bitwise_or.reduce((x ^ y).reshape(near_dup.BITS, near_dup.WORDS), axis=0)
    equal = 64 * near_dup.WORDS - near_dup.PAD - int(np.bitwise_count(differ).sum())
    assert abs((equal / near_dup.MINIMA - 0.25) / 0.75 - 0.9) < 0.12


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(21)) and all(got[k] == 100 for k in range(100, 130))


def test_block_search_links_what_pivots_leave(monkeypatch, spark):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    base, rows = [f"t{k}" for k in range(100)], []
    for k in range(30):  # a chain: neighbours are similar, ends are not
        rows.append((k, " ".join(f"c{k + j}" if j % 10 == 0 else base[j] for j in range(100 - k))))
    sets = {i: fx.shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == fx.groups(pairs, sets)


def test_blocks_are_bounded_by_shingles_too(monkeypatch, spark):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
    block_links = near_dup._block_links

    def bounded(group):
        if group.drop_duplicates(["cid", "rest"]).groupby("rest")["n"].sum().max() > 1200:  # some 2,200 in the whole bucket
            raise ValueError("a block holds most of the bucket")
        return block_links(group)

    monkeypatch.setattr(near_dup, "_block_links", bounded)
    base, rows = [f"t{k}" for k in range(100)], []
    for k in range(30):
        rows.append((k, " ".join(f"c{k + j}" if j % 10 == 0 else base[j] for j in range(100 - k))))
    sets = {i: fx.shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == fx.groups(pairs, sets)


def test_quality_counts_and_verdicts(docs, none):
    got = line_quality.quality(docs).collect()
    for r in got:
        n, chars, symbols, dup, repeats = fx.base_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["kept"] and by[5]["clean_text"] == by[5]["text"] and by[14]["kept"]
    assert not any(by[i]["kept"] for i in (0, 1, 2, 3, 11, 12, 13, 17))
    assert line_quality.quality(none).count() == 0


def test_failing_lines_go(spark):
    good = "This line ends as a sentence does, with more than ten words in it."
    bad = ["Home | News | Sport", "Please enable JavaScript to read this.", "### $$$ words &&&", "EVERY WORD OF IT SHOUTS HERE!", "six words without an end mark"]
    df = spark.createDataFrame([(1, "\n".join([good, *bad, "", good.replace("This", "That")]))], "doc_id long, text string")
    row = line_quality.quality(df).first()
    assert row["clean_text"] == "\n".join([good, "", good.replace("This", "That")])


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="content"><h1>Title &amp; more</h1><p>First, with <b>bold</b>text, commas, and words enough to count.<p>Second&nbsp;paragraph,
over   lines, is long as well, and has points.<br>After a break.<!-- no --><div class="ad">Buy, buy, buy, this and that, now!</div><form>Name</form>
</div><div id="comments"><p>Nice article, thanks, really, I mean it, so much, wow, and more, more, more.</p></div><footer>end</footer><script>if (a < b) {}</script>"""


def test_main_text():
    assert page_text.main_text(PAGE) == (
        "Title & more First, with boldtext, commas, and words enough to count. Second paragraph, over lines, is long as well, and has points. After a break.")
    assert page_text.main_text(None) == page_text.main_text("") == page_text.main_text("<!-- open <p>x") == ""
    assert page_text.main_text("plain &lt;text&gt;") == "plain <text>"
    assert page_text.main_text("<div>" * 5000 + "deep, deep text that is long enough, surely") == "deep, deep text that is long enough, surely"


LONG = "Words of the article, one after the other, in sentences that go on, and on, for some time, as they do, until they end, at last. "


@pytest.mark.parametrize("name", ["wrap has-sidebar", "no-sidebar", "nav-open", "with-comments", "page-widget", "widget"])
def test_layout_classes_do_not_drop_the_article(name):
    side = '<div class="sidebar"><p>Beside it, and short.</p></div><div id="comments"><article><p>Nice, really, so much, and more, thanks.</p></article></div>'
    want = (LONG * 4).strip()
    for inner in (f"<article><p>{LONG * 4}</p></article>", f"<div><p>{LONG * 4}</p></div>"):
        assert page_text.main_text(f'<body><div class="{name}">{inner}{side}</div></body>') == want
        assert page_text.main_text(f"<body>{inner}{side}</body>") == want
    assert page_text.main_text(f'<body><div class="related"><p>{LONG}</p></div></body>') == LONG.strip()


def test_adverts_do_not_outweigh_short_articles():
    for inner in ("<article><h1>Short</h1></article>", "<article><h1>Short one</h1><p>A sentence, no more, of the article.</p></article>"):
        want = page_text.main_text(f"<body>{inner}</body>")
        for name in ("ad", "footer", "sidebar"):
            assert page_text.main_text(f'<body><div class="{name}">{LONG}</div>{inner}</body>') == want


def test_sections_without_an_article_are_whole():
    first, second = (LONG * 4).strip(), "A second section, shorter than the first one, " + "which has few commas and goes on for a while " * 3 + "still."
    page = (f"<body><div id=page><div><p>{first}</p></div><div><p>{second}</p></div><h3>Heading</h3><div><p>{second}</p></div><ul><li>item</ul>"
            "<table><tr><td>cell</table><ul><li><a href=x>Link</a><li><a href=y>Other link</a></ul></div></body>")
    assert page_text.main_text(page) == f"{first} {second} Heading {second} item cell"


def test_extract_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, n_chars string")
    got = page_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"], r["n_chars"]) for r in got.collect())[1:] == [(2, 0), (2, 0)]
    assert page_text.extract(df.limit(0)).count() == 0


def test_lm_base_and_probabilities(docs, none):
    got = mix_lm.score_documents(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens = lambda t: [*fx.white(fx.lower(t)), None]
    c = Counter(w for i, t in rows if fx.fold(i) != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["held_out"] == (fx.fold(r["doc_id"]) == 2) and r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert mix_lm.score_documents(none).count() == 0


def test_lm_is_a_distribution_and_learns(spark):
    model = mix_lm.train(spark.createDataFrame([(bytearray(b"the "), 50), (bytearray(b"then "), 5), (bytearray(b"of\n"), 20)], "segment binary, n_train long"))
    total = sum(10 ** x for x in model.log10([b"th" + bytes([k]) for k in range(256)]))
    assert abs(total - 10 ** model.log10([b"th"])[0]) < 1e-9
    assert model.log10([b"the "])[0] > model.log10([b"xqz "])[0]


def test_lm_sees_the_words_before(spark):
    words = ["red", "green", "blue", "black", "white", "brown", "grey", "pink"]
    texts = [" ".join(words[(i + k) % 8] for k in range(40)) for i in range(60)]
    mixed = " ".join(sorted(texts[0].split(), key=lambda w: hash_of(w)))
    rows = spark.createDataFrame([*enumerate(texts), (1000, texts[3]), (1001, mixed)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in mix_lm.score_documents(rows).collect()}
    assert got[1000] > got[1001] + 10 and got[1000] == pytest.approx(got[3])


def hash_of(word):
    return sum(ord(x) * 31 ** i for i, x in enumerate(word)) % 101


def test_units_know_what_stands_before():
    found = mix_lm.units(b"ab  cde f")
    tails, parts = [u[8:mix_lm.BEFORE] for u in found], [u[mix_lm.BEFORE:] for u in found]
    assert parts == mix_lm.segments(b"ab  cde f") and tails == [b"\xff" * 3, b"ab ", b"b  ", b"de "]
    assert found[0][:8] == bytes(8) and found[1][:8] == found[2][:8] != found[3][:8]
    # a byte's contexts are the same wherever the text is cut into segments
    slots = mix_lm._bits(parts, [u[: mix_lm.BEFORE] for u in found])[0][:, :3]
    whole = mix_lm._bits([b"".join(parts)])[0][:, :3]
    assert (slots == whole).all()


def test_units_are_handed_on_within_a_batch(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(mix_lm, "FLUSH", 50)
    monkeypatch.setattr(mix_lm, "HANDED", 20, raising=False)
    texts = [" ".join(f"w{k * 9 + j}" for j in range(10)) for k in range(60)] + [" ".join(f"x{j}" for j in range(400))] + ["", None, "a a a"]
    held = [k % 3 == 0 for k in range(len(texts))]
    found = [*mix_lm._counted(iter([pa.RecordBatch.from_pydict({"text": texts, "held_out": held})]))]
    assert len(found) > 30 and max(b.num_rows for b in found) <= 20
    want = [Counter(), Counter()]
    for text, out in zip(texts, held):
        for k in (0, 1)[: 1 if out else 2]:
            want[k].update(mix_lm.units((text or "").encode()))
    got = [Counter(), Counter()]
    for row in (r for b in found for r in b.to_pylist()):
        for k, name in enumerate(("n_all", "n_train")):
            got[k][row["before"] + row["segment"]] += row[name]
    assert got[0] == want[0] and +got[1] == want[1]


def test_lm_mixes_runs_of_bytes_as_bit_by_bit(spark, monkeypatch):
    import types

    import numpy as np
    import pyarrow as pa

    texts = [" ".join(f"w{(k * j) % 23}" for j in range(30)) for k in range(40)]
    batch = lambda: iter([pa.RecordBatch.from_pydict({"text": texts, "held_out": [False] * len(texts)})])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    learned = []
    for rows in (4_096, 7):
        monkeypatch.setattr(mix_lm, "ROWS", rows)
        learned.append([p.to_pylist()[0] for p in mix_lm._learned(mix_lm._counted(batch()))])
    assert [(p["block"], p["zeros"], p["ones"]) for p in learned[0]] == [(p["block"], p["zeros"], p["ones"]) for p in learned[1]]
    assert learned[0][-1]["weights"] == pytest.approx(learned[1][-1]["weights"]) and learned[0][-1]["maps"] == pytest.approx(learned[1][-1]["maps"])
    model = mix_lm.train(spark.createDataFrame([(bytearray(b"w%d " % k), k + 1) for k in range(23)], "segment binary, n_train long"))
    found = mix_lm.units(f"{texts[3]} xyz w5 w5".encode())
    parts, before = [u[mix_lm.BEFORE:] for u in found], [u[: mix_lm.BEFORE] for u in found]
    slots, bit, of = mix_lm._bits(parts, before)
    x = model.logits[slots].astype(np.float32)
    gate = np.arange(len(bit)) % 8 * mix_lm.LONGEST + ((x != 0) * np.arange(1, mix_lm.ORDERS + 1)).max(1)
    mixed = sum(x[:, k] * model.weights[k, gate] for k in range(mix_lm.ORDERS))
    p = np.clip((1 / (1 + np.exp(-mixed)) + model.maps[gate, mix_lm.np.clip(mixed * 2 + 16.5, 0, 32).astype(int)]) / 2, 1e-6, 1 - 1e-6)
    want = np.bincount(of, np.log10(np.where(bit, p, 1 - p)))
    assert len(set(gate % mix_lm.LONGEST)) > 2 and model.log10(parts, before) == pytest.approx(want, rel=1e-5)


def test_words_are_counted_without_what_stands_before():
    cut = mix_lm.Cut([b"a B b", None])
    assert len(cut.words()[0]) == 3 and "_before" not in vars(cut)
    assert len(cut.keys) == 4 and "_before" in vars(cut)


def test_lm_scores_do_not_depend_on_what_is_broadcast(monkeypatch, docs):
    want = {r["doc_id"]: (r["n_known"], r["score"]) for r in mix_lm.score_documents(docs).collect() if r["doc_id"] is not None}
    monkeypatch.setattr(mix_lm, "HOT", 3)
    got = {r["doc_id"]: (r["n_known"], r["score"]) for r in mix_lm.score_documents(docs).collect() if r["doc_id"] is not None}
    assert got == {i: (n, pytest.approx(x)) for i, (n, x) in want.items()}


def test_lm_tables_do_not_grow_with_units(spark, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[(i * j + k) % 40] for k in range(40) for j in (1, 7)) for i in range(60)]
    seen, plain = [], mix_lm.written
    monkeypatch.setattr(mix_lm, "written", lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1])
    got = mix_lm.score_documents(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert len(got) == 60 and len({u for t in texts for u in mix_lm.units(t.encode())}) > 300
    assert sum(df.count() for name, df in seen if name != "lm-parts") <= len(words) + len(texts)


def test_segments_rebuild_the_text():
    for t in fx.texts():
        raw = (t or "").encode()
        assert b"".join(mix_lm.segments(raw)) in (raw + mix_lm.END,)


def test_pieces_are_lossless_and_reproducible(docs, none):
    one = piece_lattice.encode_documents(docs, seed=1)
    got = one.collect()
    for r in got:
        assert (r["piece_ids"] is None) == (r["text"] is None) and r["lossless"] is (None if r["text"] is None else True)
    ids = lambda rs: Counter((r["doc_id"], tuple(r["piece_ids"] or ())) for r in rs)
    assert ids(got) == ids(piece_lattice.encode_documents(docs.repartition(3), seed=1).collect())
    assert ids(got) != ids(piece_lattice.encode_documents(docs, seed=2).collect())
    back = piece_lattice.decode_documents(one.withColumnRenamed("text", "given"))
    assert back.filter("not (given <=> text)").count() == 0
    assert piece_lattice.encode_documents(none).count() == 0


def test_sampled_paths_follow_the_lattice():
    v = piece_lattice.Vocabulary()
    sampler, word = piece_lattice.Sampler(v, edges=10), " there"  # nothing is remembered beyond ten edges

    def paths(at):
        if at == len(word):
            yield (), 0.0
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in v.id:
                for rest, weight in paths(end):
                    yield (v.id[word[at:end]], *rest), weight + v.weight[v.id[word[at:end]]]

    exact = {p: math.exp(w) for p, w in paths(0)}
    whole = sum(exact.values())
    seen = Counter(tuple(x.tolist()) for x in sampler.encode(["there"] * 4000, list(range(4000))))
    assert set(seen) <= set(exact)
    for p, w in exact.items():
        assert abs(seen[p] / 4000 - w / whole) < 0.04


def test_what_a_worker_has_seen_moves_no_draw():
    v = piece_lattice.Vocabulary()
    texts = [t for t in fx.texts() if t] + ["there and ▁ back", "x" * 60, "naïve 日本語 \x00"]
    keys = list(range(len(texts)))
    fresh, old = piece_lattice.Sampler(v, edges=10), piece_lattice.Sampler(v)
    for k in range(40):
        old.encode([f"before{k} {'history' * (k % 5)} {k * k}"] * 3, [k, k + 1, k + 2])
    assert [x.tolist() for x in fresh.encode(texts, keys)] == [x.tolist() for x in old.encode(texts, keys)]
    # draws next to every boundary of a node mean the same edge, wherever the node is stored
    def edges(sampler):
        sampler._prepare([w for w in [" there"] if w not in sampler.end])
        node = sampler.end[" there"]
        bounds = sampler.bounds[sampler.first[node] :]
        bounds = bounds[: int(np.flatnonzero(bounds == piece_lattice.PARTS)[0]) + 1]
        return bounds.tolist(), sampler.piece[sampler.first[node] :][: len(bounds)].tolist()

    assert edges(piece_lattice.Sampler(v)) == edges(old)


def test_giving_back_agrees_with_decoding():
    v = piece_lattice.Vocabulary()
    table = pa.array(v.raw, pa.large_binary())
    texts = [*fx.texts(), "été 日本 ▁", " ", "\n", None, ""]
    ids, bounds = piece_lattice.Sampler(v).encode_flat(texts, list(range(len(texts))))
    told = piece_lattice.gives_back(ids, bounds, texts, table)
    assert told == [None if t is None else piece_lattice.decode(ids[a:b].tolist(), v) == t for t, a, b in zip(texts, bounds, bounds[1:])]
    wrong = [None if t is None else t + "é" for t in texts]
    assert not any(piece_lattice.gives_back(ids, bounds, wrong, table))


PARAGRAPH = "A long paragraph, with commas, and more words than a menu has, so that it gets points. "


@pytest.mark.parametrize("page, text", [
    (f"<body><form id=aspnetForm><div><article><p>{PARAGRAPH * 3}</p></article></div></form>", (PARAGRAPH * 3).strip()),
    (f"<body><form id=aspnetForm><div><p>{PARAGRAPH * 3}</p><p>{PARAGRAPH}</p></div></form>", f"{PARAGRAPH * 4}".strip()),
    (f"<body><article><p>{PARAGRAPH * 3}</p><form><p>{PARAGRAPH * 9}</p></form></article>", (PARAGRAPH * 3).strip()),
    (f"<body><div><p>{PARAGRAPH * 3}</p></div><form class=login><p>{PARAGRAPH}</p></form>", (PARAGRAPH * 3).strip()),
    (f"<body><form class='comment-form'><p>{PARAGRAPH * 3}</p></form>", ""),
    ("<body><form>Name <input> <button>Send</button></form>", ""),
])
def test_forms_around_and_beside_the_article(page, text):
    assert page_text.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<b>" * 100_000 + "<hr>" * 100_000, "<p><button>" + "<b>" * 50_000 + "<hr>" * 50_000, "".join(f"<div>{PARAGRAPH}" for _ in range(20_000)),
    "<form>" * 50_000 + PARAGRAPH, "<ul><li>" * 50_000,
])
def test_deep_and_wide_pages_take_linear_time(page):
    began = time.process_time()
    page_text.main_text(page)
    assert time.process_time() - began < 8
