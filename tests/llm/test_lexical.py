"""Ranked search against plain scoring of every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tactus.llm import lexical
from tests.llm import brute

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(brute.ASCII_LOWER))


def _ranked(docs, items, k: int) -> list[tuple]:
    bags = [(i, Counter(t)) for i, text in docs if (t := _terms(text))]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n_docs) // n_terms
            s = sum(weight[t] * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in _terms(text) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "wizards BOIL, boil; soup-river"),
    (3, None),
    (4, " .,\n"),
    (5, "nowhere tobefound"),
    (6, "é中😀 one extra4 own line"),
    (6, "one"),
    (None, "same row shared heading"),
]


@pytest.mark.parametrize(("postings", "block", "short"), [(2_000_000, 1000, 1 / 64), (150, 2, 1 / 4), (60, 3, 1.0), (300, 1, 0.0)])
def test_search(spark, monkeypatch, postings, block, short):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical, "SHORT", short)
    monkeypatch.setattr(lexical, "WINDOW", 16)
    docs = brute.awkward(spark).repartition(3)
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, score string")
    rows = lexical.search(docs, items, k=7).collect()
    assert Counter(map(tuple, rows)) == Counter(_ranked(brute.awkward_texts(), ITEMS, 7))


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "alpha beta"), ("a", "alpha beta"), ("c", "gamma")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "ALPHA")], "item_id string, text string")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in lexical.search(docs, items).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 12), st.sampled_from([0.0, 1 / 64, 0.2, 1.0]), st.sampled_from([3, 17, 4096]))
def test_best_is_exact(seed, k, short, window):
    """Any mixture of short and long lists, with many equal scores, gives what adding everything up gives."""
    rng = np.random.default_rng(seed)
    docs = int(rng.integers(1, 120))
    lists = lexical.Lists([], [], docs)
    for _ in range(rng.integers(1, 9)):
        places = np.flatnonzero(rng.random(docs) < rng.random() ** 2)
        lists.places.append(places)
        lists.gains.append(rng.integers(1, 1 + rng.integers(1, 6), len(places)))
    terms = rng.integers(0, len(lists.places), rng.integers(1, 8))
    weights = rng.integers(0, 5, len(terms))
    total = np.zeros(docs, np.int64)
    for t, w in zip(terms, weights, strict=True):
        total[lists.places[t]] += lists.gains[t] * w
    expected = sorted((-s, p) for p, s in enumerate(total.tolist()) if s > 0)[:k]
    kept = lexical.SHORT, lexical.WINDOW
    lexical.SHORT, lexical.WINDOW = short, window
    try:
        places, scores = lexical.best(lists, terms, weights, k)
    finally:
        lexical.SHORT, lexical.WINDOW = kept
    assert [(-s, p) for p, s in zip(places.tolist(), scores.tolist(), strict=True)] == expected
