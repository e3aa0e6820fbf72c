"""Estimators on series with a known answer, and grouped choices against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions import scalars
from tactus.operators import audit, drift, grid, metrics, prep, selection, series, stats
from tactus.sources import manifest

FPS = k.FRAME_RATE


def pulses(bpm, seconds, offset=0.0):
    """One impulse per beat, shared between the two frames around it."""
    n = int(seconds * FPS)
    values = [0.0] * n
    t = offset
    while t < seconds:
        at = t * FPS
        i = int(at)
        if i + 1 < n:
            values[i] += 1 - (at - i)
            values[i + 1] += at - i
        t += 60.0 / bpm
    return values


def frames(spark, songs):
    rows = [(s, i, v) for s, values in songs.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "song int, frame bigint, value double")


def test_planted_tempo_and_offset(spark):
    df = frames(spark, {0: pulses(120.0, 40, 0.1), 1: [0.0] * 5000, 2: [1.0] * 10})
    found = {r["song"]: r for r in series.estimate_timing(df, ["song"], segment=4096.0).collect()}
    assert found[0]["bpm"] == pytest.approx(120.0)
    assert found[0]["confidence"] > 1.0
    beat = 0.5
    apart = (found[0]["offset"] + 0.1 - k.ONSET_LATENCY) % beat
    assert min(apart, beat - apart) < 0.003
    assert found[1]["bpm"] == 0.0 and found[2]["bpm"] == 0.0


def test_drifting_clicks_are_fitted(spark):
    def track(song, slopes, hop=2.0, n=60):
        rows, y = [], 0.0
        for i in range(n):
            rows.append((song, i * hop + 6.0, y, 128.0))
            y += hop * slopes(i * hop)
        return rows

    steady = track(0, lambda t: 0.0)
    off = track(1, lambda t: 0.005)
    turning = track(2, lambda t: 0.0 if t < 60 else 0.004)
    jump = [(3, t, y + (0.1 if 50 < t < 80 else 0.0), b) for _, t, y, b in track(3, lambda t: 0.0)]
    short = track(4, lambda t: 0.0, n=5)
    df = spark.createDataFrame(steady + off + turning + jump + short, "song int, centre double, phase double, bpm double")
    found = {}
    for r in drift.fit_warps(df, ["song"], "bpm").orderBy("song", "seconds").collect():
        found.setdefault(r["song"], []).append(r)
    assert [(r["seconds"], round(r["bpm"], 6)) for r in found[0]] == [(0.0, 128.0)]
    assert found[1][0]["bpm"] == pytest.approx(128.0 * 0.995)
    assert len(found[2]) == 2
    assert found[2][0]["bpm"] == pytest.approx(128.0, abs=0.01)
    assert found[2][1]["bpm"] == pytest.approx(128.0 * 0.996, abs=0.01)
    assert found[2][1]["seconds"] == pytest.approx(66.0, abs=4.0)
    assert 4 not in found
    assert all(r["slack"] >= 0 for rows in found.values() for r in rows)


def test_long_track_is_fitted_in_stretches(spark):
    """A day of readings with one change of tempo and one splice."""
    rng = np.random.default_rng(4)
    slope = np.where(np.arange(12_000) < 7_000, 0.0004, -0.0007)
    phase = np.cumsum(slope) * 2.0 + rng.normal(0, 0.002, 12_000)
    phase[3_000:3_040] += 0.2
    rows = [(1, i * 2.0, float(y), 120.0) for i, y in enumerate(phase)]
    found = drift.fit_warps(spark.createDataFrame(rows, "song int, centre double, phase double, bpm double"), ["song"], "bpm")
    found = found.orderBy("seconds").collect()
    assert [round(r["seconds"], -2) for r in found] == [0.0, 14_000.0]
    assert [r["bpm"] for r in found] == pytest.approx([120.0 * 0.9996, 120.0 * 1.0007], abs=1e-3)


def test_tempo_change_near_a_stretch_border(spark):
    """Changes from 1 to 20 readings (2 * least) before and after the border at reading 1 000."""
    rng = np.random.default_rng(9)
    aways = [d for n in (1, 3, 7, 9, 10, 11, 15, 20) for d in (-n, n)]
    rows = []
    for away in aways:
        slope = np.where(np.arange(2_000) < 1_000 + away, 0.0, 0.01)
        phase = np.cumsum(slope) * 2.0 + rng.normal(0, 0.001, 2_000)
        rows += [(away, i * 2.0, float(y), 120.0) for i, y in enumerate(phase)]
    found = {}
    for r in drift.fit_warps(spark.createDataFrame(rows, "song int, centre double, phase double, bpm double"), ["song"], "bpm").collect():
        found.setdefault(r["song"], []).append(r)
    for away in aways:
        first, second = sorted(found[away], key=lambda r: r["seconds"])
        assert second["seconds"] == pytest.approx(2.0 * (1_000 + away), abs=2.0)
        assert [first["bpm"], second["bpm"]] == pytest.approx([120.0, 120.0 * 0.99], abs=1e-3)
        assert first["slack"] < 0.020


@pytest.mark.parametrize("decay", [0.999, 0.955, 0.5, 0.1])
def test_panel_usage_at_any_decay(spark, decay):
    rng = np.random.default_rng(6)
    hits = rng.integers(0, 4, 3_000)
    rows = [(1, i, [int(p == h) for p in range(4)]) for i, h in enumerate(hits)]
    found = audit.panel_usage(spark.createDataFrame(rows, "chart int, slot int, codes array<int>"), ["chart"], ["slot"], decay=decay)
    use, expected = np.zeros(4), []
    for h in hits:
        use = use * decay
        use[h] += 1.0
        expected.append(use.tolist())
    got = [r["usage"] for r in found.orderBy("slot").collect()]
    assert np.allclose(got, expected, rtol=1e-7)


def test_pooling_keeps_late_measures(spark):
    rows = [(1, s, [float(s % 7)]) for s in range(600 * 4)]
    found = grid.pool_measures(spark.createDataFrame(rows, "song int, slot int, features array<double>"), ["song"], width=1, per_measure=4)
    assert found.count() == 600
    assert found.agg(F.max("position")).first()[0] == 1.0


def test_hex_modulus_of_any_length(spark):
    digests = ["0", "f", "deadbeef", "0123456789abcdef" * 2, "a" * 40, "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"]
    table = spark.createDataFrame([(d,) for d in [*digests, ""]], "d string")
    got = {r[0]: r[1] for r in table.select("d", scalars.hex_modulus(F.col("d"), 20)).collect()}
    assert got == {"": None, **{d: int(d, 16) % 20 for d in digests}}


def greedy(scores, wanted, rate, gap, seeds):
    """Slots one song gets, by the plain greedy rule."""
    mix = k.RHYTHM_MIX[min(int(rate), 9)]
    quarters, eighths = int(wanted * mix[0] / sum(mix)), int(wanted * mix[1] / sum(mix))
    taken = set(seeds)
    order = sorted(scores, key=lambda s: (-scores[s], s))
    for member, quota in ((12, quarters), (6, eighths), (1, wanted)):
        want = min(quota, wanted - len(taken))
        for slot in order:
            if want <= 0:
                break
            if slot in taken or slot % member:
                continue
            if any(abs(slot - t) < gap for t in taken):
                continue
            taken.add(slot)
            want -= 1
    return taken


@pytest.mark.parametrize("halo", [6, 64])
def test_selection_equals_plain_greedy(spark, halo):
    rng = random.Random(halo)
    songs = {}
    for song in range(6):
        scores = {s: rng.random() for s in range(0, 600, 3)}
        songs[song] = (scores, rng.randrange(20, 90), rng.choice([1.0, 4.0, 9.0]), rng.choice([1, 4, 7, 13]), sorted(rng.sample(sorted(scores), 5)))
    table = spark.createDataFrame(
        [(i, s, v) for i, (scores, *_) in songs.items() for s, v in scores.items()], "song int, slot bigint, score double"
    )
    budget = spark.createDataFrame([(i, x[1], x[2], x[3]) for i, x in songs.items()], "song int, wanted int, rate double, gap int")
    seeds = spark.createDataFrame([(i, s) for i, x in songs.items() for s in x[4]], "song int, slot bigint")
    chosen = selection.select_slots(table, budget, ["song"], seeds=seeds, segment=0.25, piece=48, halo=halo)
    found = {}
    for r in chosen.collect():
        found.setdefault(r["song"], set()).add(r["slot"])
    for i, (scores, wanted, rate, gap, seed) in songs.items():
        assert found[i] == greedy(scores, wanted, rate, gap, seed), i


def test_rests_are_tidied(spark):
    busy = [(0, m * 48 + s) for m in range(30) for s in range(0, 48, 6)]
    thin = [(0, 30 * 48 + 7)]
    chosen = spark.createDataFrame(busy + thin, "song int, slot bigint")
    scores = spark.createDataFrame([(0, s, 1.0 / (1 + s)) for s in range(0, 31 * 48)], "song int, slot bigint, score double")
    songs = spark.createDataFrame([(0, 1)], "song int, gap int")
    assert [tuple(r) for r in selection.thin_measures(chosen, ["song"]).collect()] == [(0, 30)]
    tidy = {r["slot"] for r in selection.tidy_rests(chosen, scores, songs, ["song"]).collect()}
    assert len(tidy) == len(busy) + 1
    assert 30 * 48 in tidy and 30 * 48 + 7 not in tidy


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.choice([None, round(rng.random() * 50, 1)])) for _ in range(500)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r for r in stats.exact_quantiles(df, ["g"], F.col("v"), {"m": 0.5, "p": 0.9}, segment=7.0).collect()}
    for g in "ab":
        values = sorted(v for h, v in data if h == g and v is not None)
        for name, q in (("m", 0.5), ("p", 0.9)):
            at = (len(values) - 1) * q
            low = values[math.floor(at)]
            assert got[g][name] == pytest.approx(low + (at % 1) * (values[math.ceil(at)] - low))


def test_auc_extremes(spark):
    up = [(0, i, int(i >= 20)) for i in range(40)]
    down = [(1, i, int(i < 20)) for i in range(40)]
    one = [(2, i, 1) for i in range(40)]
    df = spark.createDataFrame([(g, float(s), y, 0) for g, s, y in up + down + one], "g int, score double, label int, position int")
    got = {r["g"]: r["auc"] for r in metrics.stratified_auc(df, ["g"], 12, segment=5.0).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: None}


def test_balanced_sample(spark):
    rows = spark.createDataFrame([(i, "a" if i < 950 else "b") for i in range(1000)], "i int, style string")
    first = [tuple(r) for r in prep.balanced_sample(rows, "style", ["i"], 2000, 5, buckets=16).orderBy("draw").select("draw", "i", "style").collect()]
    again = [tuple(r) for r in prep.balanced_sample(rows.repartition(7), "style", ["i"], 2000, 5, buckets=16).orderBy("draw").select("draw", "i", "style").collect()]
    assert first == again and len(first) == 2000
    assert 850 < sum(style == "b" for *_, style in first) < 1150
    assert len({i for _, i, _ in first}) > 600


def test_seeded_windows_and_mirrors(spark):
    rows = [(c, s, [1, 0, 0, 2]) for c in range(20) for s in range(0, 9000, 30)]
    targets = spark.createDataFrame(rows, "chart int, slot int, codes array<int>").withColumn("slot_count", F.lit(9000))
    vocab = spark.createDataFrame([(0, 345, 1)], "token int, pattern int, n int")
    windows = prep.chart_windows(targets, vocab, ["chart"], seed=9, slot_count="slot_count").collect()
    assert len(windows) == 20
    for w in windows:
        assert w["start"] % 48 == 0 and w["start"] <= 9000 - 3072 + 48
        assert len(w["placement"]) == 3072 and len(w["pattern_target"]) == max(x["steps"] for x in windows)
        assert sum(w["placement"]) == w["steps"] and w["pattern_target"].count(0) == w["steps"]
    assert len({w["start"] for w in windows}) > 5
    turned = prep.augment_mirrors(targets, ["chart"], 1, validation=F.col("chart") == 0)
    kinds = {(r["chart"], r["mirror"], tuple(r["codes"])) for r in turned.collect()}
    assert (0, 0, (1, 0, 0, 2)) in kinds
    assert {c for _, _, c in kinds} <= {(1, 0, 0, 2), (2, 0, 0, 1)} and len({m for _, m, _ in kinds}) == 4


def test_envelopes_are_built_once(spark, tmp_path):
    songs = spark.createDataFrame(
        [("a.ogg", True, True, 0, 150.0, -0.1, 60.0), ("b.ogg", True, True, 0, 150.0, -0.1, 20.0), ("c.ogg", False, True, 0, 150.0, 0.0, 60.0)],
        "audio string, constant_bpm boolean, offset_declared boolean, stops int, primary_bpm double, offset double, seconds double",
    )
    series_table = spark.createDataFrame([(a, i, 0.5) for a in ("a.ogg", "b.ogg", "c.ogg") for i in range(3)], "audio string, frame int, value double")
    for _ in range(2):
        prep.build_envelopes(songs, series_table, str(tmp_path / "e"))
    built = manifest.read_features(spark, str(tmp_path / "e")).collect()
    assert len(built) == 3 and {r["audio"] for r in built} == {"a.ogg"} and len(built[0]["key"]) == 16


def test_phase_on_the_edge_of_a_bin(spark):
    # 1 s into a bar of 1.333 s is exactly bin 72; a remainder of doubles rounds it into bin 71.
    songs = spark.createDataFrame([(3.0, 180.0), (4.65, 150.0), (5.5, 280.0)], "offs double, bpm double")
    phases = songs.select(scalars.phase_of_offset(F.col("offs"), F.col("bpm")).alias("p")).collect()
    assert [r["p"] for r in phases] == [72, 9, 56]
