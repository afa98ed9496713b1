"""Benchmark decontamination: a prefix-filtered join of document shingles with the windows of benchmark items.

Words are runs of digits, a-z (A-Z in lower case first) and characters beyond ASCII. A window is ``window`` consecutive words
of an item; an item with fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

1. The shingles (up to SHINGLE words) of all windows are counted over all documents.
2. Each window keeps its rarest shingle only: a document without it cannot contain the window. Neighbouring windows mostly
   share theirs, so a prefix entry stands for a run of windows of one item text.
3. Document shingles are joined with the prefix entries by hash. Position and length bounds place the run inside the text.
4. Each place is verified word by word; only equal runs of a window's length count.

Entries are broadcast in blocks of a checked size, each block joined with all documents in a scan of its own: no shuffle of
texts. What is found is gathered by the digest of the text, so copies are gathered once, and joined back.

Defined cases: null and wordless texts have no words, no hits, and are clean. Null and wordless items have no window. Items
without an id count as the id ``null``; items that repeat an id count once. Repeated rows get equal results. An empty
benchmark leaves every document clean. Extra columns pass through; columns named like the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logmeld.llm.common import blocks_for, fresh, lower_ascii, written

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered: enough to count them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Bytes of prefix entries that one pass over the documents broadcasts.
BLOCK_BYTES = 32 << 20
NEW = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def shingle_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def _items(benchmark: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(item, key) and (key, words, w, k): items with the same words share a key. w: window length, k: shingle length."""
    named = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), words_of(F.col(f"`{text}`")).alias("words"),
    ).filter(F.size("words") > 0).withColumn("key", F.md5(F.array_join("words", " ")))
    texts = named.groupBy("key").agg(F.first("words").alias("words"))
    w = F.least(F.size("words"), F.lit(window))
    return (
        written(named.select("item", "key").distinct(), "bench-items"),
        written(texts.withColumn("w", w).withColumn("k", F.least(w, F.lit(SHINGLE))), "bench-texts"),
    )


def _shingles(texts: DataFrame) -> DataFrame:
    """(key, w, k, o, h): each shingle of an item text by its place o."""
    placed = texts.select("key", "w", "k", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))).alias("o"))
    h = F.coalesce(*[F.when(F.col("k") == k, shingle_hash(F.col("words"), F.col("o"), k)) for k in range(1, SHINGLE + 1)])
    return placed.select("key", "w", "k", "o", h.alias("h"))


def _at_places(docs: DataFrame, sizes: list[int], carry: list[str]) -> DataFrame:
    """A row for each place of each text in ``docs`` (words, n): at, h."""
    out = None
    for k in sizes:
        part = docs.filter(F.col("n") >= k).select(*carry, F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("at"))
        part = part.withColumn("h", shingle_hash(F.col("words"), F.col("at"), k))
        out = part if out is None else out.unionByName(part)
    return out


def _counted(docs: DataFrame, shingles: DataFrame, sizes: list[int], block_bytes: int) -> DataFrame:
    """(h, n_docs): occurrences over all documents, for the shingles of the benchmark that occur."""
    wanted = written(shingles.select("h").distinct(), "bench-shingles")
    blocks, out = blocks_for(wanted.count() * 40, block_bytes), None
    for b in range(blocks):
        some = F.broadcast(wanted.filter(F.pmod("h", F.lit(blocks)) == b))
        part = _at_places(docs, sizes, ["words"]).join(some, "h").groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"))
        out = part if out is None else out.unionByName(part)
    return out


def prefix_entries(texts: DataFrame, shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, key, o, first, w, run): the rarest shingle h at place o of an item serves the windows from ``first`` on.

    ``run``: the words of those windows, w the length of each. Counts, then hashes, then places order the shingles, so the windows that a place
    serves are neighbours.
    """
    ranked = shingles.join(counts, "h", "left").withColumn("rank", F.struct(F.coalesce("n_docs", F.lit(0)).alias("n"), "h", "o"))
    # windows of an item have one length, so one frame for each possible number of shingles in a window
    best = ranked.withColumn("first", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("o") - F.col("w") + F.col("k")), F.col("o"))))
    best = best.join(texts.select("key", F.size("words").alias("size")), "key").filter("first <= size - w")
    best = best.groupBy("key", "w", "first").agg(F.min("rank").alias("rank"))
    runs = best.filter("rank.n > 0").groupBy("key", "w", F.col("rank.o").alias("o"), F.col("rank.h").alias("h")).agg(
        F.min("first").alias("first"), F.max("first").alias("last"))
    return runs.join(texts.select("key", "k", "words"), "key").select(
        "h", "key", "k", "o", "first", "w", F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("w")).alias("run"))


def _verified() -> Column:
    """Places of the text (a to b) that equal a window of the run, which starts at ``at - o + first``.

    The run may hang over either end of the text; words beyond it equal nothing.
    """
    start = F.col("at") - F.col("o") + F.col("first")
    inside = F.greatest(start, F.lit(0))
    rest = F.size("run") - (inside - start)
    equal = F.zip_with(F.slice("words", inside + 1, rest), F.slice("run", inside - start + 1, rest), lambda x, y: F.coalesce(x == y, F.lit(False)))
    spans = F.aggregate(
        equal,
        F.struct(inside.alias("j"), F.lit(0).alias("streak"), F.array().cast("array<struct<a:int,b:int>>").alias("out")),
        lambda s, e: F.struct(
            (s["j"] + 1).alias("j"), F.when(e, s["streak"] + 1).otherwise(0).alias("streak"),
            F.when(e & (s["streak"] + 1 >= F.col("w")), F.concat(s["out"], F.array(F.struct(
                (s["j"] - F.col("w") + 1).alias("a"), (s["j"] + 1).alias("b"))))).otherwise(s["out"]).alias("out")))
    return spans["out"]


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int,
                 block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """((text_key, key, spans) for texts with occurrences, (item, key)). docs: any table with column ``text``."""
    items, texts = _items(benchmark, item_id, item_text, window)
    shingles = written(_shingles(texts), "bench-places")
    sizes = sorted(r[0] for r in shingles.select("k").distinct().collect())  # SHINGLE values at most
    t = F.col(f"`{text}`")
    key = F.unhex(F.md5(t.cast("binary"))).alias("text_key")
    worded = docs.filter(t.isNotNull()).select(key, words_of(t).alias("words")).withColumn("n", F.size("words"))
    if not sizes:
        empty = docs.sparkSession.createDataFrame([], "text_key binary, key string, spans array<struct<a:int,b:int>>")
        return empty, items
    counts = written(_counted(worded, shingles, sizes, block_bytes), "bench-counts")
    entries = written(prefix_entries(texts, shingles, counts), "bench-prefixes")
    size = entries.agg(F.sum(F.size("run") * 24 + 160)).first()[0]
    used = sorted(r[0] for r in entries.select("k").distinct().collect())
    blocks, found = blocks_for(size, block_bytes), None
    for b in range(blocks if used else 0):
        some = F.broadcast(entries.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).drop("k"))
        part = _at_places(worded, used, ["text_key", "words", "n"]).join(some, "h")
        part = part.filter((F.col("at") - F.col("o") + F.col("first") + F.size("run") >= F.col("w")) & (F.col("n") >= F.col("w")))
        # an outer explode, as the optimizer would make the verification a condition of the join, evaluated for every place
        part = part.select("text_key", "key", F.explode_outer(_verified()).alias("s")).filter("s is not null")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "text_key binary, key string, s struct<a:int,b:int>")
    # copies of a text find the same: one row a place is left, before and after the shuffle
    return written(found.distinct().groupBy("text_key", "key").agg(F.collect_list("s").alias("spans")), "bench-found"), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 13, one_in: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated (a hit, and one word in ``one_in`` or more)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW])
    found, items = find_windows(docs, benchmark, text, item_id, item_text, window, block_bytes)
    covered = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")))
    hits = found.groupBy("text_key").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")).select(
        "text_key", covered["n"].alias("hit"))
    named = found.select("text_key", "key").join(items, "key").groupBy("text_key").agg(F.sort_array(F.collect_set("item")).alias("named"))
    found = written(hits.join(named, "text_key").select(
        "text_key", "hit", F.size("named").alias("items"), F.sha2(F.array_join("named", ",").cast("binary"), 256).alias("sha")), "bench-texts-hit")
    n, key, tk, hit, n_found, sha = fresh(docs, "n", "key", "text_key", "hit", "items", "sha")
    t = F.col(f"`{text}`")
    out = docs.withColumn(n, F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long")).withColumn(key, F.unhex(F.md5(t.cast("binary"))))
    found = found.toDF(tk, hit, n_found, sha)
    out = out.join(found, F.col(key) == F.col(tk), "left")
    n_hit = F.coalesce(hit, F.lit(0)).cast("long")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(n).alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(n_found, F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(sha, F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (one_in * n_hit >= F.col(n))).alias("contaminated"))
