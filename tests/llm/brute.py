"""Plain definitions that the operators are held against, and tables with awkward rows."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        # Names that operators use themselves.
        T.StructField("component_id", T.StringType()),
        T.StructField("text_key", T.StringType()),
        T.StructField("kept", T.StringType()),
    ]
)
PROSE = "the quick brown fox jumps over the lazy dog while seven old wizards boil a pot of strange green soup near the river"


def prose(n: int, salt: int = 0) -> str:
    words = PROSE.split()
    return " ".join(words[(i * i + 7 * i + salt * 13 + i // 5 * salt) % len(words)] + ("" if i % 9 else str((i * salt) % 101)) for i in range(n))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    """Null and empty texts, blanks, ties, a very long text, near copies, null and repeated ids."""
    base = prose(120, 3)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "ONE two three")]
    rows += [(10 + i, base if i % 3 else base + f" extra{i}") for i in range(9)]
    rows += [(30 + i, prose(60 + 3 * i, 50 + i)) for i in range(12)]
    rows += [(60, prose(40_000, 9)), (61, "x" * 100_000), (62, "é中😀 " * 300), (None, base), (None, None), (70, "same row"), (70, "same row")]
    rows += [(80 + i, f"Shared heading line of some length\nown line {i} {prose(20, 90 + i)}\n\nShared heading line of some lengtH") for i in range(5)]
    return rows


def awkward(spark):
    rows = [(i, t, None if n % 7 == 0 else f"s{n % 3}", "c", None, "k") for n, (i, t) in enumerate(awkward_texts())]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


class Union:
    def __init__(self, items):
        self.parent = {x: x for x in items}

    def top(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.parent[max(a, b)] = min(a, b)


def similar(sets: dict, percent: int) -> list[tuple]:
    """Pairs of keys whose sets have a Jaccard similarity of percent / 100 or more."""
    holders = defaultdict(list)
    for key, items in sets.items():
        for x in items:
            holders[x].append(key)
    both = Counter((a, b) for keys in holders.values() for n, b in enumerate(sorted(keys)) for a in sorted(keys)[:n])
    return [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


def shingles(text: str | None, n: int) -> set:
    words = SPACE_WORDS.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def repetition(text: str | None) -> tuple:
    text = text or ""
    words = SPACE_WORDS.findall(text)
    counts = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if counts[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if SPACE_WORDS.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


def phrases(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def kept_lines(rows, percent: int = 80, k: int = 8) -> dict[int, list[int]]:
    first, counts = {}, Counter()
    for i, text in rows:
        if i is None:
            continue
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\r\x0b\x0c").translate(ASCII_LOWER)
            if line:
                counts[i] += 1
                first[line] = min(first.get(line, (math.inf, 0)), (i, n))
    sets = {line: {line[j : j + k] for j in range(max(1, len(line) - k + 1))} for line in first}
    union = Union(sets)
    for a, b in similar(sets, percent):
        union.join(a, b)
    best = {}
    for line, place in first.items():
        best[union.top(line)] = min(best.get(union.top(line), (math.inf, 0)), place)
    out = {i: [] for i, _ in rows if i is not None}
    for i, n in best.values():
        out[i].append(n)
    return {i: sorted(n) for i, n in out.items()}
