"""Freezes, closed holds and streams of grid charts against walks over the rows, and what their plans move."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tactus.operators import audit, grid, radar, timing

SF = "/root/testdata/sf0.001"
SCHEMA = "chart int, slot int, codes array<int>"


def executed(df):
    """The plan as it is before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def random_charts(seed, charts=40, panels=6):
    rng = random.Random(seed)
    rows = []
    for chart in range(charts):
        for slot in sorted(rng.sample(range(200), rng.randrange(1, 30))):
            width = rng.randrange(0, panels + 1)
            rows.append((chart, slot, [rng.choice([0, 0, 1, 2, 3, 4, 5, None]) for _ in range(width)]))
    return [*rows, (charts, 3, None), (charts, 90, [2]), (charts, 199, [0, 0, 3])]


def walked(rows):
    """Freezes begun earlier that are down on each row: those that the next mark does not cut to nothing."""
    held = {}
    for chart in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == chart]
        spans = []
        for panel in range(8):
            marks = [(s, c[panel]) for _, s, c in own if c and len(c) > panel and c[panel] in (2, 3, 4)]
            for i, (s, c) in enumerate(marks):
                if c != 3:
                    after = marks[i + 1] if i + 1 < len(marks) else (max(r[1] for r in own), 3)
                    spans.append((s, after[0] if after[1] == 3 else s))
        for _, slot, _ in own:
            held[chart, slot] = sum(s < slot <= e for s, e in spans)
    return held


@pytest.mark.parametrize("segment", [None, 12.0, 50.0, 1000.0])
def test_freezes_down_on_each_row(spark, segment):
    rows = random_charts(7)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("other", F.col("slot") * 2)
    found = radar.held_rows(table, ["chart"], segment=segment)
    assert found.columns == ["chart", "slot", "codes", "other", "held"]
    got = found.collect()
    assert {(r["chart"], r["slot"]): r["held"] for r in got} == walked(rows)
    assert len(got) == len(rows) and all(r["other"] == 2 * r["slot"] for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_rows_are_counted_in_few_shuffles(spark):
    """Lines are dealt before they are hashed, and held freezes take no join of spans with rows."""
    plan = executed(entry_point.queries()["held_count"](spark, SF))
    assert plan.count("Join") <= 1 and plan.count("Exchange hashpartitioning") <= 6
    assert "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("segment", [96.0, 120.0])
def test_values_close_by_come_with_the_freezes(spark, segment):
    rows = random_charts(3, charts=15)
    table = spark.createDataFrame(rows, SCHEMA)
    found = radar.held_rows(table, ["chart"], segment=segment, value=F.col("slot") + 1, reach=96).collect()
    assert {(r["chart"], r["slot"]): r["held"] for r in found} == walked(rows)
    near = {(c, s): sum(t + 1 for d, t, _ in rows if d == c and s - 96 <= t <= s) for c, s, _ in rows}
    assert {(r["chart"], r["slot"]): r["recent"] for r in found} == near


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_radar_shuffles_no_row_twice(spark):
    """Freezes and recent notes share one exchange of the rows, and lengths join charts and not rows."""
    plan = executed(entry_point.queries()["radar"](spark, SF))
    assert plan.count("held#") and plan.count("Join") == 2
    table = spark.createDataFrame(random_charts(5), SCHEMA).withColumn("s", F.lit(10.0))
    timed = radar.radar(table, ["chart"], F.col("s"), segment=96.0)
    lengths = table.groupBy("chart").agg(F.max("s").alias("seconds"))
    joined = radar.radar(table.drop("s"), ["chart"], lengths, segment=96.0)
    assert sorted(map(tuple, timed.collect())) == sorted(map(tuple, joined.collect()))


@pytest.mark.parametrize("segment", [None, 12.0, 96.0])
def test_closed_holds(spark, segment):
    rows = [(1, 0, [2, 0]), (1, 5, [0, 4]), (1, 90, [0, 3]), (1, 200, [4, 0, 2]), (2, 8, [1]), (None, 7, [2])]
    table = spark.createDataFrame(rows, SCHEMA)
    found = audit.close_holds(table, ["chart"], segment=segment)
    added = [(1, 4, (3, 0)), (1, 200 + 12, (3, 0, 3)), (None, 19, (3,))]
    want = [(c, s, tuple(x)) for c, s, x in rows] + added
    assert sorted(((r[0], r[1], tuple(r[2])) for r in found.collect()), key=str) == sorted(want, key=str)
    assert "Union" not in executed(found)


def test_keys_within_one_segment_carry_nothing(spark):
    """A scan's join is gone once it is known that nothing crosses an edge, and rows are dealt by number."""
    from tactus.operators.ordered import scan

    rows = spark.range(1000).select((F.col("id") % 50).alias("key"), (F.col("id") / 50).cast("int").alias("at"))
    found = scan(rows, ["key"], ["at"], F.floor(F.col("at") / 100), running={"n": F.lit(1)}, lag={"before": F.col("at")})
    assert found.where("n <> at + 1 or coalesce(before, -1) <> at - 1").count() == 0 and found.count() == 1000
    assert "REPARTITION_BY_NUM" in executed(found)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    assert "Join" not in final


def test_grid_times(spark, monkeypatch):
    """Slots are laid out after the breakpoints have met their songs, with the times that a look-up of each slot gives."""
    monkeypatch.setattr(grid, "BLOCK", 7)
    rng = random.Random(8)
    songs, tempo, stops = [(None, 0.5, 9.0), (98, 0.0, 3.0), (99, 0.0, 2000.0)], [(None, 1.0, 100.0), (99, 0.0, 120.0)], [(None, 2.0, 0.5)]
    for song in range(30):
        songs.append((song, rng.choice([0.0, 0.3, -1.1]), rng.choice([-5.0, 0.0, 4.0, 20.0])))
        # On slots, beside them and on one beat more than once.
        beats = [rng.choice([rng.randrange(200) / 24, rng.randrange(200) * (1 / 24), rng.random() * 8, 1.0, -1.0, 60.0]) for _ in range(6)]
        tempo += [(song, b, rng.choice([0.0, 90.0, 133.0])) for b in beats[:4]]
        stops += [(song, b, rng.choice([0.0, 0.7])) for b in [*beats[3:], 1.0]]
    songs = spark.createDataFrame(songs, "song int, offset double, duration double")
    tempo = spark.createDataFrame(sorted(set(tempo), key=str), "song int, beat double, bpm double")
    stops = spark.createDataFrame(sorted(set(stops), key=str), "song int, beat double, seconds double")
    points = timing.breakpoints(tempo, stops, songs, ["song"], segment=2.0)
    found = grid.grid_times(songs, points, ["song"], segment=2.0)
    plan = executed(found)
    assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")]
    reached = timing.beat_at_time(songs, points, ["song"], time="duration", probe_id=["duration"], segment=2.0, out="total_beats")
    looked_up = timing.time_at_beat(grid.grid_beats(reached, ["song"]), points, ["song"], probe_id=["fine"], segment=2.0)
    rows = sorted(map(str, (tuple(r) for r in found.select("song", "fine", "beat", "time").collect())))
    assert rows == sorted(map(str, (tuple(r) for r in looked_up.select("song", "fine", "beat", "time").collect())))
    assert len(rows) > 90_000 and "(98, 0, 0.0, None)" in rows
