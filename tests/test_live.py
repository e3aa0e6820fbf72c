"""Streams against the same rows taken in order, however they are dealt into micro-batches."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tactus.streaming import live

SCHEMA = "who string, event_id long, t double, codes array<int>"
LEFT, RIGHT = 1, 8
GAP, TTL = 10.0, 100.0


def in_order(rows):
    """Per row its masks, foot and crossing, by walking each key's rows in order."""
    out, by_key = {}, defaultdict(list)
    for r in rows:
        by_key[r[0]].append(r)
    for mine in by_key.values():
        before = held = None
        for who, i, t, codes in sorted(mine, key=lambda r: (r[2], r[1])):
            if before is None or t - before > TTL:
                held, foot, last = set(), 0, None
            before = t
            step = {p for p, c in enumerate(codes) if c in (1, 2, 4, 6)}
            held -= {p for p, c in enumerate(codes) if c == 3}
            in_run = bool(step) and last is not None and t - last <= GAP
            crossed = False
            if step:
                foot = foot ^ 1 if in_run else foot
                if len(step) == 1:
                    (p,) = step
                    if not in_run:
                        foot = int(p == 3)
                    crossed = in_run and p == (0 if foot else 3)
                last = t
            mask = lambda s: sum(1 << p for p in s if p < 4)
            out[i] = (who, mask(held), in_run, foot if step else None, crossed)
            held |= {p for p, c in enumerate(codes) if c in (2, 4)}
    return out


def made(seed: int, n: int, width: int = 4):
    rng = random.Random(seed)
    rows, t = [], defaultdict(float)
    for i in range(n):
        who = rng.choice(["a", "a", "b", None])
        t[who] += rng.choice([0.5, 3.0, 10.0, 10.5, 40.0, 100.0, 130.0]) if rng.random() < 0.5 else 1.0
        codes = [rng.choice([0, 0, 0, 1, 2, 3, 5]) for _ in range(width)]
        rows.append((who, i, t[who], codes))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


def dealt(flow, spark, folder, batches):
    os.makedirs(f"{folder}/in")
    stream = spark.readStream.schema(table(spark, batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for n, rows in enumerate(batches):
        table(spark, rows).coalesce(1).write.parquet(f"{folder}/one{n}")
        (name,) = [x for x in os.listdir(f"{folder}/one{n}") if x.endswith(".parquet")]
        os.link(f"{folder}/one{n}/{name}", f"{folder}/in/{n}.parquet")
        os.utime(f"{folder}/in/{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    flow.start(stream, f"{folder}/flow").awaitTermination()
    return flow.finish(spark, f"{folder}/flow")


def plain(found):
    return {r["event_id"]: (r["who"], r["held"], r["in_run"], r["foot"], r["crossed"]) for r in found.collect()}


@pytest.mark.parametrize(("segment", "width"), [(None, 4), (25.0, 4), (None, 40)])
def test_occupancy_in_any_order(spark, tmp_path, segment, width):
    rows = made(1, 90, width)
    mixed = sorted(rows, key=lambda r: r[2] + random.Random(r[1]).uniform(0, 150))
    batches = [mixed[:30], mixed[30:31], mixed[31:75], mixed[75:]]
    flow = live.live_occupancy(["who"], "200 seconds", gap=GAP, ttl=TTL, segment=segment)
    assert plain(dealt(flow, spark, str(tmp_path), batches)) == in_order(rows)
    assert flow.late(spark, f"{tmp_path}/flow").count() == 0


def test_late_row_expired_key_and_repeated_batch(spark, tmp_path):
    flow = live.live_occupancy(["who"], "5 seconds", gap=GAP, ttl=TTL)
    hold, tap, tail = [2, 0, 0, 0], [0, 1, 0, 0], [3, 0, 0, 0]
    first = [("a", 1, 0.0, hold), ("b", 2, 1.0, hold), ("a", 3, 20.0, tap)]
    second = [("a", 4, 10.0, tail), ("a", 5, 90.0, tap), ("c", 6, 118.0, tap)]
    third = [("b", 7, 130.0, tap), ("a", 8, 131.0, tap)]
    folder = f"{tmp_path}/flow"
    stream = table(spark, first)
    for name in ("pending", "late"):
        stream.limit(0).write.parquet(f"{folder}/{name}/batch=-1")
    live._clock(spark, float("-inf")).write.parquet(f"{folder}/clock/batch=-1")
    for number, rows in enumerate((first, second, second, third)):
        number = min(number, 1) if number < 3 else 2  # the second is run twice, as after a failure
        flow._advance(table(spark, rows), folder, number)
        if number == 1:
            # b was last seen at 1 s, and the watermark stands at 113 s.
            assert [r["who"] for r in spark.read.parquet(f"{folder}/carry/batch=1").collect()] == ["a"]
    found = plain(flow.finish(spark, folder))
    assert [r["event_id"] for r in flow.late(spark, folder).collect()] == [4]
    assert found == in_order([r for r in first + second + third if r[1] != 4])
    assert found[3][1] == 1 and found[5][1] == 1 and found[7][1] == 0 and found[8][1] == 1
    assert not os.path.exists(f"{folder}/carry/batch=0")


def test_runs_in_any_order(spark, tmp_path):
    rows = made(2, 80)
    mixed = sorted(rows, key=lambda r: r[2] + random.Random(r[1]).uniform(0, 60))
    flow = live.live_runs(["who"], GAP, "90 seconds")
    found = dealt(flow, spark, str(tmp_path), [mixed[:25], mixed[25:26], mixed[26:60], mixed[60:]])
    expected, by_key = set(), defaultdict(list)
    for who, _, t, _ in rows:
        by_key[who].append(t)
    for who, times in by_key.items():
        times.sort()
        start, n = times[0], 0
        for t, after in zip(times, [*times[1:], float("inf")], strict=True):
            n += 1
            if after - t >= GAP:
                expected.add((who, start, t, n))
                start, n = after, 0
    seconds = [(F.unix_micros(c) / 1e6).alias(c) for c in ("run_start", "run_end")]
    assert {tuple(r) for r in found.select("who", *seconds, "steps").collect()} == expected
    # Closed runs are out before the stream ends, and only open ones are carried.
    early = spark.read.parquet(f"{tmp_path}/flow/out").where("batch < 3").count()
    assert 0 < early and spark.read.parquet(f"{tmp_path}/flow/carry/batch=3").count() <= len(by_key)


def test_nothing_comes(spark, tmp_path):
    flow = live.live_occupancy(["who"], "5 seconds")
    os.makedirs(f"{tmp_path}/in")
    stream = spark.readStream.schema(table(spark, []).schema).parquet(f"{tmp_path}/in")
    flow.start(stream, f"{tmp_path}/flow").awaitTermination()
    assert flow.finish(spark, f"{tmp_path}/flow").count() == 0
