"""Every operator against brute force on awkward rows, and on tables without rows."""

from __future__ import annotations

import hashlib
import os
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tactus.llm import chunk_bpe, components, licenses, line_dedup, mixing, ngram_join, ranks, repair, repetition, sharding, spans, toxicity, vector_join
from tests.llm import brute

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return brute.awkward(spark).repartition(3).cache()


def test_repetition(docs):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = repetition.repetition(docs).collect()
    expected = Counter((i, *brute.repetition(t)) for i, t in brute.awkward_texts())
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in rows) == expected
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_repetition_shares(spark):
    good = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    lines = "\n".join([good] + ["the same long line of text again"] * 3)
    (row,) = repetition.repetition(spark.createDataFrame([(1, lines)], "doc_id long, text string")).collect()
    inside = 2 * len("thesamelonglineoftextagain")
    assert row["share_lines"] == pytest.approx(inside / (26 + 3 * inside / 2)) and not row["kept"]


def test_licenses_base(docs, spark):
    texts = [*brute.awkward_texts(), (900, "Under the MIT License! cc-by_nc; under\nthe mit license"), (901, "xunder the mit license apache license version 2.0")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    rows = licenses.licenses(table).collect()
    found = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    assert found == Counter((i, *brute.phrases(t)) for i, t in texts)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("Licensed under the Apache License, Version 2.0 (the", "apache-2,notice", 1.0),
        ("GNU Lesser General Public License v2.1", "lgpl-2.1", 1.0),
        ("GNU Lesser General Public License", "lgpl", 0.8),
        ("all rights reserved", "all-rights-reserved", 0.5),
        ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa-4.0", 1.0),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3+", 1.0),
        ("nothing to see", "", 0.0),
    ],
)
def test_license_rules(spark, text, labels, score):
    (row,) = licenses.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row["labels"], row["score"]) == (labels, score)


def test_license_keywords():
    """The gate and the keywords let through whatever a rule matches."""
    assert len(licenses.rules()) > 200
    for tier in (licenses.TIER_1, licenses.TIER_2, licenses.TIER_3):
        for line in tier.strip().splitlines():
            _, keyword, rule = (x.strip() for x in line.split(";"))
            words = licenses.required(rule)
            assert any(keyword in w for w in words) or keyword == "bsd", line
            gated = any(g in w for g in licenses.GATE for w in words) or "licen[cs]e" in rule
            assert gated or rule.startswith("cc by") or "bsd" in rule, line


def test_jaccard_join(docs):
    sets = {}
    for i, t in brute.awkward_texts():
        sets.setdefault(i, brute.shingles(t, 4))
    union = brute.Union(i for i in sets if i is not None)
    for a, b in brute.similar({i: s for i, s in sets.items() if i is not None}, 85):
        union.join(a, b)
    rows = ngram_join.jaccard_join(docs).collect()
    expected = Counter((i, len(brute.shingles(t, 4)), None if i is None else union.top(i)) for i, t in brute.awkward_texts())
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == expected
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *(i for i in union.parent if union.top(i) == i)}


@pytest.mark.parametrize(("n", "percent", "words", "edits"), [(4, 85, 90, 3), (5, 80, 60, 2), (3, 60, 40, 4)])
def test_jaccard_join_near(spark, n, percent, words, edits):
    rng = np.random.default_rng(words)
    rows = []
    for group in range(6):
        base = [f"w{x}" for x in rng.integers(0, 400, words)]
        for copy in range(14):
            own = list(base)
            for at in rng.integers(0, words, int(rng.integers(0, edits + 1))):
                own[at] = f"e{rng.integers(0, 50)}"
            rows.append((int(group * 100 + copy), " ".join(own)))
    sets = {i: brute.shingles(t, n) for i, t in rows}
    union = brute.Union(sets)
    for a, b in brute.similar(sets, percent):
        union.join(a, b)
    found = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: union.top(i) for i in sets}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 80)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (200, 2))]
    union = brute.Union({x for pair in links for x in pair})
    for a, b in links:
        union.join(a, b)
    found = components.components(spark.createDataFrame([*links, (None, 5), (7, 7)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: union.top(x) for x in union.parent if any(x in p and p[0] != p[1] for p in links)}


def test_vector_join(spark):
    rng = np.random.default_rng(1)
    rows = []
    for group in range(12):
        base = rng.standard_normal(20)
        for copy in range(6):
            rows.append((group * 10 + copy, (base + rng.standard_normal(20) * 0.09 * copy).tolist(), group % 3))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], None), (503, None, 0), (504, [0.0] * 20, 0), (505, [None, *rows[0][1][1:]], 0)]
    rows += [(506, [float("nan"), *rows[0][1][1:]], 0), (507, rows[0][1][:19], 0), (508, [], 0), (None, rows[0][1], 0)]
    good = {i: (lab, np.array(v, float)) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: 0 for i, _, _ in rows}
    union = brute.Union(i for i, _, _ in rows if i is not None)
    for a in good:
        for b in good:
            x, y = good[a][1], good[b][1]
            if a < b and good[a][0] == good[b][0] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[a], links[b] = links[a] + 1, links[b] + 1
                union.join(a, b)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("block", F.lit("clash")).withColumn("key", F.lit(1))
    found = vector_join.vector_join(table).collect()
    assert sum(links.values()) > 40
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found} == {
        (i, links[i], None if i is None else union.top(i), i is not None and union.top(i) == i) for i, _, _ in rows
    }


def test_vector_join_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "TILE", 7)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * 0.15).tolist(), 1) for i in range(60)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.93).sum(1) - 1
    found = vector_join.vector_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [r["n_links"] for r in sorted(found)] == linked.tolist()


def check_shards(rows, n_shards):
    sizes = Counter(r["shard"] for r in rows)
    counts = [sizes[s] for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(n_shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_sharding(docs):
    rows = sharding.shards(docs, n_shards=5).collect()
    check_shards(rows, 5)
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in brute.awkward_texts())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_sharding_groups(spark):
    """Copies stay together, a text with more copies than a shard holds fills whole shards."""
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(200)] + [(5000 + i, f"own {i}") for i in range(200)]
    found = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=8).collect()
    check_shards(found, 8)
    where = {r["doc_id"]: r["shard"] for r in found}
    assert len({where[i] for i in range(400)}) <= 6  # four at best, with 100 rows a shard
    # Half of all rows are one text here; where shards are full, pairs may stay apart, but few do.
    assert sum(where[1000 + i] != where[1001 + i] for i in range(0, 200, 2)) <= 35
    # All rows are linked: quotas bind everywhere.
    found = sharding.shards(spark.createDataFrame([(i, f"t{i // 4}") for i in range(402)], "doc_id long, text string"), n_shards=7).collect()
    check_shards(found, 7)
    split = Counter((r["text_crc32"], r["shard"]) for r in found)
    assert len(split) <= 220  # about 340 when scattered


def test_running_sums(spark):
    rows = [(k, i, (i * 7) % 5) for k in (None, "a", "b") for i in range(150)]
    table = spark.createDataFrame(rows, "k string, i long, v long")
    found = ranks.running(table, ["k"], ["i"], 9, "before", F.col("v")).collect()
    for key in (None, "a", "b"):
        mine = sorted((r["before"], r["v"]) for r in found if r["k"] == key)
        assert [b for b, v in mine if v] == [sum(v for _, v in mine[:n]) for n, (_, v) in enumerate(mine) if v]


def test_mixing(spark):
    rows = [(i, prose_text, src) for src, n in (("big", 160), ("mid", 40), ("small", 8), (None, 4)) for i, prose_text in ((hash((src, j)) % 10**9, brute.prose(30 + j % 5, j)) for j in range(n))]
    rows += [(7, "", "hollow"), (8, None, "big")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("epoch", F.lit("clash"))
    found = mixing.mix(table, target_entropy=0.9, most_epochs=6.0, block_tokens=200).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.SPACE_WORDS.findall(t or ""))
    drawn = Counter()
    for r in found:
        drawn[r["source"]] += r["n_tokens"]
    weights = {r["source"]: r["weight"] for r in found}
    live = [w for w in weights.values() if w]
    entropy = -sum(w * np.log(w) for w in live) / np.log(len(live))
    budgets = {r["source"]: r["budget"] for r in found}
    assert sum(weights.values()) == pytest.approx(1) and (entropy >= 0.9 - 1e-6 or max(budgets[s] / sizes[s] for s in sizes if sizes[s]) >= 6 - 1e-3)
    for s in sizes:
        if sizes[s]:
            assert budgets[s] <= drawn[s] < budgets[s] + 40  # at most one document over
            at = sorted((r["start"], r["n_tokens"]) for r in found if r["source"] == s and r["n_tokens"])
            assert [x for x, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
            whole = Counter(r["epoch"] for r in found if r["source"] == s)
            assert all(whole[e] == sum(x == s for _, _, x in rows) for e in range(int(budgets[s] // sizes[s])))
    assert Counter(r["source"] for r in found)["hollow"] == 1
    copies = mixing.mixed_documents(table, target_entropy=0.9, most_epochs=6.0, block_tokens=200)
    assert copies.columns == table.columns
    assert Counter((r["doc_id"], r["source"]) for r in copies.collect()) == Counter((r["doc_id"], r["source"]) for r in found)


def test_mixing_limits(spark):
    """The exponent stops at the repetition limit, and a smaller budget draws a part of each source."""
    rows = [(i, "a b c d", "big" if i < 300 else "tiny") for i in range(303)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(table, target_entropy=1.0, most_epochs=5.0, block_tokens=40).collect()
    budget = {r["source"]: r["budget"] for r in found}
    assert budget["tiny"] == pytest.approx(5 * 12, abs=1) and budget["big"] == 1200
    part = mixing.mix(table, target_entropy=0.1, budget_tokens=400, block_tokens=40).collect()
    assert sum(r["n_tokens"] for r in part) <= 400 + 8 and len({r["doc_id"] for r in part}) == len(part)


def test_repair_store(docs):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = repair.stored(docs, WORD_BPE, 4).collect()
    expected = sorted(((i is not None, i or 0, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in brute.awkward_texts()), key=lambda x: x[:2])
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i if some else None for some, i, _ in expected]
    start = 0
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == start
        start += len(ids)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == Counter((i if some else None, np.array(x, "<u4").tobytes()) for some, i, x in expected)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(2, 9), min_size=1, max_size=60), min_size=1, max_size=30), st.integers(0, 10**6))
def test_repair_round_trip(texts, seed):
    texts = texts * 6
    ids = np.array([x for t in texts for x in t], np.int32)
    rules, sizes, seq = repair.compress(ids, np.array([len(t) for t in texts]), 10)
    assert (repair.expand(rules, sizes, seq, 10) == ids).all()
    start = seed % len(ids)
    size = 1 + seed % max(1, len(ids) - start)
    assert (repair.read_slice(rules, sizes, seq, 10, start, size) == ids[start : start + size]).all()


PIECES = ["a", "B", "é", "ß", "İ", "'", "'s", "'LL", "<|endoftext|>", "<|EndOfText|>", "<", "|", ">", "1", "½", "_", ".", "...", "”", "́", " ", "  ", "\n", "\t", " ", "\x02", "中", "😀", " the", "Thing"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=20))
def test_word_encoder(texts):
    encoder = repair._encoder(WORD_BPE)
    ids, sizes = encoder.encode(spans.Block(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), st.lists(st.integers(0, 200), max_size=8), st.sets(st.integers(0, 8)))
def test_chunk_joins(text, cuts, known):
    codec = chunk_bpe._codec(BYTE_BPE)
    raw = text.encode()
    ends = sorted({0, len(raw), *(c for c in cuts if c < len(raw) and (raw[c] & 0xC0) != 0x80)})
    given_ids = {i: codec.encode(raw[ends[i] : ends[i + 1]].decode()) for i in known if i < len(ends) - 1}
    whole = codec.slow.encode(text, add_special_tokens=False).ids
    assert chunk_bpe.assembled(codec, raw, ends if raw else [0], given_ids).tolist() == whole
    assert codec.decode(np.array(whole, np.int32)) == codec.slow.decode(whole, skip_special_tokens=False)


def test_chunk_bpe(docs):
    tok = Tokenizer.from_file(BYTE_BPE)
    expected = Counter()
    for i, t in brute.awkward_texts():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    found = chunk_bpe.digests(docs, BYTE_BPE).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == expected


def test_long_white_space():
    codec = chunk_bpe._codec(BYTE_BPE)
    text = "a" + " " * 1_000_000 + "b"
    assert codec.encode(text).tolist() == codec.slow.encode(text, add_special_tokens=False).ids


def test_kept_lines(docs):
    found = line_dedup.kept_lines(docs).collect()
    assert {r["doc_id"]: r["kept"] for r in found} == brute.kept_lines(brute.awkward_texts())
    rows = line_dedup.without_copies(docs)
    assert rows.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in rows.where("doc_id >= 80").collect()}
    assert left[80].startswith("Shared heading") and left[81].startswith("own line 1") and left[81].endswith("\n")
    ids = {r["doc_id"] for r in rows.collect()}
    assert {1, 2, 3, None} <= ids and 12 not in ids


def test_near_lines(spark):
    rng = np.random.default_rng(11)
    rows = []
    for group in range(10):
        base = [f"word{x}" for x in rng.integers(0, 300, 30)]
        for copy in range(8):
            own = list(base)
            for at in rng.integers(0, 30, int(rng.integers(0, 3))):
                own[at] = f"new{rng.integers(0, 50)}"
            rows.append((group * 100 + copy, " ".join(own)))
    found = line_dedup.kept_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute.kept_lines(rows)
    assert sum(r["kept"] != expected[r["doc_id"]] for r in found) == 0


def test_line_tiles(spark, monkeypatch):
    """Tiles of few lines and narrow matrices, without and with rounds of hubs before them: the same groups."""
    monkeypatch.setattr(line_dedup, "TILE_LINES", 3)
    monkeypatch.setattr(line_dedup, "TILE_CHARS", 700)
    rng = np.random.default_rng(17)
    rows = []
    for group in range(4):  # each line differs a little from the one before, so links form chains
        own = [f"word{x}" for x in rng.integers(0, 300, 30)]
        for copy in range(25):
            own[int(rng.integers(0, 30))] = f"new{rng.integers(0, 50)}"
            rows.append((group * 100 + copy, " ".join(own)))
    rows.append((900, "x" * 5000))
    rows.append((901, "x" * 4000 + "y"))
    expected = brute.kept_lines(rows)
    assert 4 <= sum(len(n) for n in expected.values()) < len(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 2):
        found = line_dedup.kept_lines(table, rounds=rounds).collect()
        assert {r["doc_id"]: r["kept"] for r in found} == expected


def test_line_signatures():
    """Lines are signed in little memory, whatever the size of a batch, and as the sorted shingles say."""
    rng = np.random.default_rng(12)
    words = np.array([f"Wörd{x}" for x in range(500)])
    texts = ["\n".join([*(" ".join(words[rng.integers(0, 500, 30)]) for _ in range(9)), " x", ""]) for _ in range(1600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert batch.nbytes > 3 << 20
    tracemalloc.start()
    sizes = [len(b.data) for _, b in spans.blocks([batch], "text", line_dedup.SIGN_BYTES) if len(line_dedup.Lines(b).bands())]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == len("".join(texts).encode()) and most < 40e6  # 62 MB in blocks of 1 MB
    lines = line_dedup.Lines(spans.Block(pa.array(texts[:20])))
    keys, low = (x := lines.shingles()) >> np.uint64(40), x & line_dedup.LOW
    bins = line_dedup.BINS
    expected = np.arange(1, line_dedup.BANDS + 1, dtype=np.uint64) * spans.INVERSE + np.zeros((len(lines.nodes), 1), np.uint64)
    for i in range(len(lines.nodes)):
        own = {}
        for value in low[keys == i].tolist():
            own.setdefault(value * bins >> 40, value)
        filled = [next((own[(at + n) % bins] + (n << 40)) for n in range(bins) if (at + n) % bins in own) for at in range(bins)]
        for row in range(line_dedup.ROWS):
            expected[i] = spans.mixed(expected[i] * spans.BASE + np.array(filled, np.uint64)[row :: line_dedup.ROWS])
    assert (lines.bands() == expected.view(np.int64)).all()


def test_training_memory():
    """Landmarks are compared and mapped a few words at a time; each word's row has 85,184 numbers."""
    rng = np.random.default_rng(14)
    words = ["".join(map(chr, rng.integers(97, 123, 8))) for _ in range(240)]
    tracemalloc.start()
    assert len(toxicity._diverse(words, 100)) == 100
    used, maps = toxicity._maps(words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = toxicity._features(words)
    assert (used == np.flatnonzero(whole.any(0))).all() and most < 100e6
    again = whole[:, used] @ maps
    assert np.abs(again @ again.T - whole @ whole.T).max() < 1e-3


def test_counted_arrays():
    """Stems are counted a few texts at a time: 400 arrays of 20,000 numbers take 64 MB together."""
    tracemalloc.start()
    values, counts = toxicity._counted(np.random.default_rng(seed).integers(0, 30_000, 20_000) for seed in range(400))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = np.concatenate([np.random.default_rng(seed).integers(0, 30_000, 20_000) for seed in range(400)])
    expected = np.unique(whole, return_counts=True)
    assert (values == expected[0]).all() and (counts == expected[1]).all() and most < 60e6
    assert [len(x) for x in toxicity._counted(iter([]))] == [0, 0]


def test_training_is_a_task(spark, monkeypatch):
    """The texts that a model is fitted on do not come to the driver; the model is the one of these texts in order."""
    texts, marks = sentences(300, 3)
    rows = [(i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    mine = sorted(i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2)
    model, expected = toxicity.fit(table, labels), toxicity.train([texts[i] for i in mine], [marks[i] for i in mine])
    # Threads of the linear algebra differ between driver and worker, so the last digits may.
    assert np.abs(model.weights - expected.weights).max() < 1e-4
    block = spans.Block(pa.array(texts))
    assert np.abs(model.score(block) - expected.score(block)).max() < 1e-4
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: toxicity.Model(np.zeros(toxicity.LETTERS**3), float(os.getpid()), float(len(texts)), 0.0))
    model = toxicity.fit(table, labels)
    assert model.bias != os.getpid() and model.slope == len(mine)


def test_small_batches(spark):
    """Rows with long texts go to Python a few MB at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("line of text "), 400).alias("text"))
    line_dedup.without_copies(docs)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) > 20e6 and max(r["n"] for r in sizes) < 8e6


def test_shared_bands(spark):
    """Keys of two or more different lines, told over batches of few rows; Spark sorts by the key alone."""
    rng = np.random.default_rng(13)
    bands = [[n % 7, *(100 + rng.integers(0, 40, line_dedup.BANDS - 2)).tolist(), 1000 + n] for n in range(60)]
    rows = [(n, bands[n]) for n in rng.integers(0, 60, 300).tolist()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        table = line_dedup._shared(spark.createDataFrame(rows, "node long, bands array<long>").repartition(4))
        found = {tuple(r) for r in table.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {}
    for node, keys in rows:
        for key in keys:
            held.setdefault(key, set()).add(node)
    assert found == {(key, node) for key, nodes in held.items() if len(nodes) > 1 for node in nodes}
    sorts = [x for x in table._jdf.queryExecution().sparkPlan().toString().splitlines() if "Sort [" in x]
    assert len(sorts) == 1 and "node" not in sorts[0]


def test_line_overlaps(monkeypatch):
    monkeypatch.setattr(line_dedup, "COLUMNS", 7)
    rng = np.random.default_rng(5)
    sides = [[set(rng.integers(0, 60, int(n)).tolist()) for n in rng.integers(1, 40, size)] for size in (6, 9)]
    ones = []
    for side in sides:
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        ones.append((row, np.array([v for x in side for v in sorted(x)], np.uint64)))
    found = line_dedup._overlaps(*ones, (6, 9))
    assert found.tolist() == [[len(x & y) for y in sides[1]] for x in sides[0]]
    assert line_dedup._overlaps((np.array([0]), np.array([1], np.uint64)), (np.array([0]), np.array([2], np.uint64)), (1, 1)).tolist() == [[0]]


def test_line_forest():
    rng = np.random.default_rng(6)
    for _ in range(20):
        linked = np.triu(rng.random((15, 15)) < 0.08, 1)
        linked |= linked.T
        links = line_dedup._forest(linked, np.arange(15))
        union, own = brute.Union(range(15)), brute.Union(range(15))
        for a, b in np.argwhere(linked).tolist():
            union.join(a, b)
        for a, b in links:
            assert linked[a, b] and own.top(a) != own.top(b)
            own.join(a, b)
        assert all((own.top(a) == own.top(b)) == (union.top(a) == union.top(b)) for a in range(15) for b in range(15))


INSULTS = ["nitwit", "blockhead", "dunderpate", "scoundrel"]


def sentences(n, seed):
    rng = np.random.default_rng(seed)
    syllables = ["ta", "re", "mi", "no", "lu", "ban", "ker", "sol", "vi", "ed", "ing", "ous"]
    texts, marks = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(40)]
        if i % 4 == 0:
            for at in rng.integers(0, 40, 3):
                words[at] = str(rng.choice(INSULTS))
        texts.append(" ".join(words) + ".")
        marks.append(int(i % 4 == 0))
    return texts, marks


def test_toxicity_accuracy():
    model = toxicity.train(*sentences(400, 1))
    texts, marks = sentences(200, 2)
    score = model.score(spans.Block(pa.array(texts)))
    assert ((score >= 0.3) == np.array(marks)).mean() > 0.97
    spelled = ["ta remi no nit.wit lu " + ". b l o c k h e a d. ta mi no", "ta remi N1TWIT lu ban bl0ckhead", "remi nixtwit no lu ban scouncdrel ta"]
    clean = model.score(spans.Block(pa.array(["ta remi no lu ban ker sol"])))
    assert (model.score(spans.Block(pa.array(spelled))) > clean).all()


SCRIPTS = {
    "cyrillic": (["да", "ми", "но", "лу", "жба", "кер", "фол", "ви", "щед", "ый"], ["гнусняк", "болвашка", "тупищий"], " "),
    "greek": (["δα", "μι", "θο", "λου", "ξερ", "σολ", "βι", "φεδ"], ["ψωροκακος", "βλαξιμο", "ηλιθας"], " "),
    "arabic": (["با", "مي", "نو", "لو", "كر", "سول", "في", "دين"], ["غبيظان", "حقيرطش", "ضثخيل"], " "),
    "hangul": (["가", "나미", "도루", "바", "소리", "유", "하네"], ["멍텅꾸리", "쪼다릭", "얼뜨괭"], " "),
    "han": (["我", "们", "今", "天", "在", "学", "校", "读", "书", "看", "山", "水"], ["笨蛋", "蠢货", "混账"], ""),
    "extended": (["ďa", "mī", "ňo", "łu", "bař", "ķer", "šol", "vį", "ęd"], ["čhłoptaš", "ţěmbećil", "đurňaķ"], " "),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_toxicity_of_any_script(script):
    syllables, insults, between = SCRIPTS[script]

    def made(n, seed):
        rng = np.random.default_rng(seed)
        texts = []
        for i in range(n):
            words = ["".join(rng.choice(syllables, int(rng.integers(2, 5)))) for _ in range(40)]
            for at in rng.choice(40, 3, replace=False) if i % 4 == 0 else ():
                words[at] = str(rng.choice(insults))
            texts.append(between.join(words))
        return texts, [int(i % 4 == 0) for i in range(n)]

    model = toxicity.train(*made(400, 1))
    texts, marks = made(200, 2)
    score = model.score(spans.Block(pa.array(texts)))
    assert ((score >= 0.3) == np.array(marks)).mean() > 0.97


def test_letters_of_any_script_are_folded():
    assert toxicity._words("ni\u0442wit nitw\u0456t \uff4eitwit ŋitwit nitwıt \U0001d427itwit ni\u0301twit") == ["nitwit"] * 7
    assert toxicity._words("ничтожество") and toxicity._words("ничтожество") == toxicity._words("НИЧТОЖЕСТВО")
    words = toxicity._words("abc今天在学校def 山水")
    assert words[0] == "abc" and words[3] == "def" and [len(w) for w in words] == [3, 8, 8, 3, 4]


def test_toxicity_rows(spark, docs):
    texts, marks = sentences(300, 3)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, m, None) for i, m in enumerate(marks)] + [(None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(table, labels)
    rows = toxicity.toxicity(docs, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in brute.awkward_texts())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in rows)
    out = spark.range(50).select(toxicity.held_out(F.col("id"))).collect()
    assert [r[0] for r in out] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)]


def test_empty_tables(spark):
    none = brute.empty(spark)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(none, labels)
    frames = [
        repetition.repetition(none),
        licenses.licenses(none),
        ngram_join.jaccard_join(none),
        ngram_join.one_of_each(none),
        vector_join.vector_join(vectors),
        sharding.shards(none),
        mixing.mix(none),
        mixing.mixed_documents(none),
        repair.stored(none, WORD_BPE, 3),
        chunk_bpe.digests(none, BYTE_BPE),
        line_dedup.kept_lines(none),
        line_dedup.without_copies(none),
        toxicity.toxicity(none, model),
        toxicity.without_toxic(none, model),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_shards_stop_when_nothing_moves(spark):
    """Two texts change places between two shards: the loads stay as they are, yet documents move."""
    units = spark.createDataFrame([(b"a", 0, 3), (b"a", 1, 5), (b"b", 0, 5), (b"b", 1, 3)], "text_key binary, shard int, n long")
    room = {0: 8, 1: 8}
    swapped, moved = sharding._round(units, room)
    assert moved == 6
    assert sharding._loads(swapped) == {0: 8, 1: 8} == sharding._loads(units)
    assert {(bytes(r["text_key"]), r["shard"], r["n"]) for r in swapped.collect()} == {(b"a", 1, 8), (b"b", 0, 8)}
    assert sharding._round(swapped, room)[1] == 0
