"""Small tables with every awkward case, and plain versions of the rules to compare with."""

import re
import zlib
from collections import Counter, defaultdict

A_WORDS = [f"word{k}x{k * 7 % 13}" for k in range(400)]
PASSAGE = " ".join(f"shared{k}" for k in range(60))
DOCS_SCHEMA = "doc_id long, text string, lang string, n_chars long, kept string, Shard int, span string"


def prose(start: int, n: int) -> str:
    words = [A_WORDS[(start + k * 3) % len(A_WORDS)] for k in range(n)]
    return "\n".join(" ".join(words[a : a + 12]).capitalize() + "." for a in range(0, n, 12))


def texts() -> list[str | None]:
    base = prose(5, 90)
    near = base.replace("word5x9", "other")
    return [
        None, "", "  \n\t ", "one", "One two three four", base, base, near, base.upper(), prose(40, 200) + "\n" + PASSAGE + ".",
        prose(91, 150) + "\n" + PASSAGE + ".\n" + prose(11, 30), "Home | About | Contact | News | More | Help\n" * 8,
        "a b c d e " * 40, "ALL CAPS LINE IS HERE NOW\n" * 4, "É è Ünïcode ▁  x y 日本語 text with😀 more words than ten in it.",
        "x" * 3000, prose(7, 3000), "the the the the the the the the the the the the.",
    ]


def documents(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    rows = [*rows, *rows[5:6], (None, "A row without an id, of ten words and then some more of them.")] if rows else rows
    return spark.createDataFrame(
        [(i, t, "en", None if t is None else len(t), "extra", 7, None) for i, t in rows], DOCS_SCHEMA)


def white(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = white(lower(text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def base_counts(text):
    w, seen, dup = white(text), set(), 0
    for line in (text or "").split("\n"):
        if white(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def contamination(text, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    windows = defaultdict(set)
    for item, x in items:
        w = words(x)
        k = min(13, len(w))
        for s in range(len(w) - k + 1) if k else ():
            windows[tuple(w[s : s + k])].add(str(item))
    w, hit, named = words(text), set(), set()
    for window, names in windows.items():
        k = len(window)
        for s in range(len(w) - k + 1):
            if tuple(w[s : s + k]) == window:
                hit.update(range(s, s + k))
                named |= names
    return len(w), len(hit), sorted(named)


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7
