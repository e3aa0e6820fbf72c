"""Warps, phase tracks and local tempo against walks over the rows, with and without segments."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.operators import series, timing


def warps_by_walk(songs, markers):
    out = []
    for song, bpm, offset in songs:
        if offset is None:
            continue
        start = -offset
        mine = sorted((s, b) for k, s, b in markers if k == song and s is not None)
        early = [b for s, b in mine if s <= start]
        now, rate, beat = start, early[-1] if early else bpm, 0.0
        out.append((song, 0.0, rate))
        for s, b in mine:
            if s > start:
                beat += (s - now) * rate / 60
                now, rate = s, b
                out.append((song, beat, b))
    return out


def close(found, expected, digits=6):
    def key(row):
        return tuple((x is None, x or 0) if not isinstance(x, float) else (False, round(x, digits - 1)) for x in row)

    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert all(x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=10**-digits) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("segment", [None, 7.0, 1000.0])
def test_warps_equal_a_walk(spark, segment):
    draw = random.Random(5)
    songs = [(k, 60.0 + 10 * k, draw.choice([-33.0, -3.5, 0.0, 2.0, 21.0])) for k in range(12)]
    songs += [(12, 100.0, None), (13, 90.0, -4.0), (None, 80.0, 1.0)]
    markers = [(draw.choice([0, draw.randrange(13)]), draw.uniform(-40, 90), draw.uniform(60, 200)) for _ in range(300)]
    # Ties, a marker on beat 0 itself, one without a time, and a song that is not there.
    markers += [(1, 5.0, 70.0), (1, 5.0, 75.0), (2, -songs[2][2], 111.0), (3, None, 50.0), (99, 1.0, 60.0), (None, 3.0, 66.0)]
    found = timing.apply_warps(
        spark.createDataFrame(songs, "song int, bpm double, offset double"),
        spark.createDataFrame(markers, "song int, seconds double, bpm double"),
        ["song"],
        segment=segment,
    )
    close(found.select("song", "beat", "bpm").collect(), warps_by_walk(songs, markers))


def test_warps_of_nothing(spark):
    songs = spark.createDataFrame([], "song int, bpm double, offset double")
    markers = spark.createDataFrame([], "song int, seconds double, bpm double")
    assert timing.apply_warps(songs, markers, ["song"], segment=5.0).count() == 0


FPS, SPAN, HOP = 4.3, 11.0, 2.0


def track_by_walk(values, period):
    n, found = len(values), []
    for w in range(math.ceil(max(n / FPS - SPAN, HOP) / HOP)):
        opens, closes = int(w * HOP * FPS), min(int((w * HOP + SPAN) * FPS), n)
        held = np.array(values[opens:closes])
        if len(held) < 8:
            continue
        above = np.maximum(held - held.mean(), 0)
        angle = 2 * math.pi * (np.arange(len(held)) / FPS + w * HOP) / period
        if above.sum() > 0:
            turn = math.atan2((above * np.sin(angle)).sum(), (above * np.cos(angle)).sum()) / (2 * math.pi)
            found.append((w * HOP + SPAN / 2, turn % 1.0 * period))
    if len(found) < 2:
        return []
    out, fix = [], 0.0
    for i, (centre, raw) in enumerate(found):
        if i:
            jump = raw - found[i - 1][1]
            if abs(jump) >= period / 2:
                near = (jump + period / 2) % period - period / 2
                fix += near - jump
        out.append((centre, raw + fix))
    return out


@pytest.fixture(scope="module")
def tracks():
    draw = random.Random(8)
    songs = {
        "long": [draw.random() ** 4 for _ in range(900)],
        # Flat for longer than several segments, so that the reading before is far away.
        "flat": [draw.random() for _ in range(120)] + [0.5] * 400 + [draw.random() for _ in range(150)],
        "silent": [0.0] * 200,
        "short": [draw.random() for _ in range(30)],
        "tiny": [1.0, 2.0],
        "late": [0.0] * 300 + [draw.random() for _ in range(60)],
    }
    return songs


@pytest.mark.parametrize("segment", [None, 15.0, 64.0])
def test_tracks_equal_a_walk(spark, tracks, segment):
    rows = [(song, i, v) for song, values in tracks.items() for i, v in enumerate(values)]
    frames = spark.createDataFrame(rows, "song string, frame bigint, value double").repartition(5)
    found = series.phase_track(frames, ["song"], F.lit(0.7), fps=FPS, window=SPAN, hop=HOP, segment=segment)
    expected = [(song, c, p) for song, values in tracks.items() for c, p in track_by_walk(values, 0.7)]
    close(found.select("song", "centre", "phase").collect(), expected)
    tempo = series.local_tempo(found, ["song"], F.lit(120.0), span=24.0, hop=HOP, segment=segment)
    slopes = []
    for song, values in tracks.items():
        track = track_by_walk(values, 0.7)
        for i in range(0, len(track) - 12, 3):
            x, y = np.array(track[i : i + 12]).T
            slope = np.polyfit(x - x[0], y, 1)[0]
            slopes.append((song, (x[0] + x[-1]) / 2, 120.0 * (1 - slope), slope * (x[-1] - x[0])))
    close(tempo.select("song", "seconds", "bpm", "slip").collect(), slopes)


def test_track_of_nothing(spark):
    frames = spark.createDataFrame([], "song string, frame bigint, value double")
    assert series.phase_track(frames, ["song"], F.lit(0.7), segment=30.0).count() == 0


def exchanges(spark, build):
    """Shuffles of a plan and how many of them are read again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    again = text.count("ReusedExchange")
    return text.count("Exchange hashpartitioning") - again, again


def test_rows_are_shuffled_once(spark):
    frames = spark.range(100).selectExpr("id % 3 as song", "id div 3 as frame", "pmod(hash(id), 97) / 97d as value")
    found = exchanges(spark, lambda: series.phase_track(frames, ["song"], F.lit(0.7), segment=30.0))
    # Lists of frames, the same by segment, readings (read twice), and summaries by key and by segment.
    assert found[0] <= 6 and found[1] >= 1
    songs = spark.range(3).selectExpr("id as song", "100d as bpm", "id / 7d as offset")
    markers = spark.range(30).selectExpr("id % 3 as song", "rand() as seconds", "rand() as bpm")
    found = exchanges(spark, lambda: timing.apply_warps(songs, markers, ["song"], segment=30.0))
    assert found[0] <= 4 and found[1] == 1
