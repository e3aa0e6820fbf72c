"""Consistent weighted sampling against its definition and against exact weighted similarity."""

from __future__ import annotations

import hashlib
import math
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tactus.llm import fingerprints
from tests.llm import brute

LONG = (1 << 64) - 1


def _hash(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def _of_term(term: int, number: int) -> tuple[float, float]:
    """The two uniforms that a term has for a number: hashing of a long, then of an int, each seeded by the one before."""
    h = _hash(struct.pack("<i", number), _hash(struct.pack("<Q", term & LONG)))
    return ((h >> 32) + 0.5) / 2**32, ((h & 0xFFFFFFFF) + 0.5) / 2**32



def _weights(text: str | None) -> Counter:
    return Counter(brute.SPACE_WORDS.findall((text or "").translate(brute.ASCII_LOWER)))


def _samples(text: str | None, count: int) -> list[tuple | None]:
    """Term and level of least rank for each sample, straight from the definition."""
    out = []
    weights = _weights(text)
    ids = {w: _hash(w.encode()) for w in weights}
    for k in range(count):
        best = None
        for word, weight in weights.items():
            u1, u2 = _of_term(ids[word], 2 * k)
            u3, u4 = _of_term(ids[word], 2 * k + 1)
            e1, e2, c = -math.log(u1), -math.log(u2), -math.log(u3 * u4)
            r, beta = e1 + e2, e1 / (e1 + e2)
            level = math.floor(math.log(weight) / r + beta)
            a = math.log(c) - r * (level - beta) - r
            best = min(best or (math.inf,), (a, word, level))
        out.append(best and best[1:])
    return out


def _jaccard(a: Counter, b: Counter) -> float:
    terms = {*a, *b}
    most = sum(max(a[t], b[t]) for t in terms)
    return sum(min(a[t], b[t]) for t in terms) / most if most else 1.0


def _edited(rows: list[tuple[int, str | None]]) -> list[tuple[int, str, str, str]]:
    ordered = sorted(rows, key=lambda r: -r[0])
    out = []
    for n, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out.append((i, text, text[: len(text) - half] + after[:half], after))
    return out


def _texts() -> list[tuple[int, str | None]]:
    found = {i: t for i, t in brute.awkward_texts() if i is not None and len(t or "") < 20_000}
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    found |= {200 + i: " ".join(rng.choices(words, k=rng.randint(1, 120))) for i in range(40)}
    found |= {300 + i: " ".join(["often"] * (5 * i + 1) + ["Seldom", "rare"] * i) for i in range(8)}
    return sorted(found.items())


@pytest.mark.parametrize("partitions", [1, 5])
def test_edited_likeness(spark, partitions):
    texts = _texts()
    table = spark.createDataFrame(texts, "doc_id long, text string").withColumn("codes", F.lit("clash")).repartition(partitions)
    rows = {r["doc_id"]: r for r in fingerprints.edited_likeness(table, samples=24).collect()}
    assert len(rows) == len(texts)
    for i, text, edited, after in _edited(texts):
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = (_samples(t, 24) for t in (text, edited, after))
        assert r["near_edited"] == sum(a == b for a, b in zip(own, other, strict=True)) / 24
        assert r["near_next"] == sum(a == b for a, b in zip(own, following, strict=True)) / 24
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 96


def test_collision_rate_is_weighted_jaccard(spark):
    """Over many samples and pairs the likeness has the mean, and each the spread, that the method promises."""
    rng = random.Random(7)
    pairs = []
    for i in range(40):
        words = [f"t{i}x{j}" for j in range(30)]
        a = Counter({w: rng.choice([1, 1, 2, 3, 9, 40]) for w in words})
        b = Counter({w: max(1, n + rng.choice([-8, -1, 0, 0, 1, 12])) for w, n in a.items() if rng.random() < 0.9})
        pairs.append((a, b))
    spell = lambda c: " ".join(w for w, n in c.items() for _ in range(n))
    table = spark.createDataFrame([(2 * i + s, spell(p[s])) for i, p in enumerate(pairs) for s in (0, 1)], "doc_id long, text string")
    codes = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(table, samples=256).collect()}
    off = []
    for i, (a, b) in enumerate(pairs):
        x, y = codes[2 * i], codes[2 * i + 1]
        found = sum(x[k : k + 4] == y[k : k + 4] for k in range(0, len(x), 4)) / 256
        exact = _jaccard(a, b)
        off.append(found - exact)
        assert abs(off[-1]) < 4 * math.sqrt(max(exact * (1 - exact), 0.01) / 256)
    assert abs(sum(off) / len(off)) < 0.02


def test_awkward_rows(spark):
    table = brute.awkward(spark)
    rows = fingerprints.edited_likeness(table, samples=4).collect()
    assert len(rows) == len(brute.awkward_texts())
    by_hash: dict[str, set] = {}
    found = {r["doc_id"]: r for r in rows}
    for r in fingerprints.fingerprints(table, samples=4).withColumnRenamed("doc_id", "i").collect():
        by_hash.setdefault(r["fingerprint"], set()).add(r["i"])
    # Without words: the one fingerprint of nothing.
    assert found[1]["fingerprint"] == found[2]["fingerprint"] == found[3]["fingerprint"]
    assert found[2]["n_chars"] == 0 and found[3]["near_next"] == 1.0
    assert found[5]["fingerprint"] == found[6]["fingerprint"] != found[4]["fingerprint"]
    assert {None, 1, 2, 3} in by_hash.values()
    nulls = [r for r in rows if r["doc_id"] is None]
    assert len(nulls) == 2 and sum(r["n_chars"] == 0 for r in nulls) == 1
    assert fingerprints.edited_likeness(brute.empty(spark), samples=2).count() == 0


def test_one_document_is_its_own_next(spark):
    (r,) = fingerprints.edited_likeness(spark.createDataFrame([(5, "abcd")], "doc_id long, text string"), samples=8).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0


def test_hot_id_is_cut(spark):
    """An id that a third of all rows share is cut by the hash of the text, and its rows still follow one another."""
    rows = [(i, f"text {i}") for i in range(200)] + [(70, f"again {i}") for i in range(100)]
    placed = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).where("not guest").collect()
    assert len({r["segment"] for r in placed if r["id"] == 70}) > 2
    after = {r["text"]: r["next"] for r in placed}
    assert len(after) == 300 and len(set(after.values())) == 300
    chain, text = [], "text 199"
    for _ in range(300):
        chain.append(text)
        text = after[text]
    assert text == "text 199" and len(set(chain)) == 300
