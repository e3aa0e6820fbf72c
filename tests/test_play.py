"""Playability: hand-built charts, and every window against a plain walk over the rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tactus.operators import audit, play

SCHEMA = "chart int, n int, t double, codes array<int>"


def frame(spark, charts):
    rows = [(c, i, float(t), codes) for c, chart in charts.items() for i, (t, codes) in enumerate(chart)]
    return spark.createDataFrame(rows, SCHEMA)


def single(panel, code=1):
    return [code if p == panel else 0 for p in range(4)]


def alternating(n, gap, panels=(0, 3)):
    return [(i * gap, single(panels[i % len(panels)])) for i in range(n)]


def letters(text, gap=0.1):
    return [(i * gap, single("LDUR".index(c))) for i, c in enumerate(text)]


def walk(chart):
    """The report by walking the rows one after another."""
    held, needed, foot, last, crossings, seen, jack = set(), [], 0, None, 0, {}, math.inf
    for t, codes in chart:
        held -= {p for p, c in enumerate(codes) if c == 3}
        step = {p for p, c in enumerate(codes) if c in (1, 2, 4, 6)}
        if step | held:
            needed.append((t, step | held))
        held |= {p for p, c in enumerate(codes) if c in (2, 4)}
        for p in step:
            jack = min(jack, t - seen.get(p, -math.inf))
            seen[p] = t
        if step:
            run = last is not None and t - last <= 0.16
            last = t
            foot ^= run
            if len(step) == 1:
                (p,) = step
                if not run:
                    foot = int(p == 3)
                else:
                    crossings += p == (0 if foot else 3)
    if not needed:
        return None
    times = [t for t, _ in needed]

    def rate(w):
        if len(times) < 2 or times[-1] - times[0] < w:
            return 0.0
        return max(sum(1 for s in times if t - w <= s <= t) for t in times) / w

    stances = {(a, b) for a in range(4) for b in range(4) if a != b}
    alive, before = stances, None
    for t, panels in needed:
        good = {s for s in stances if len(panels & set(s)) == min(len(panels), 2)}
        quick = before is not None and t - before < 0.09
        alive = {
            s for s in good if any(not quick or s[0] == o[0] or s[1] == o[1] for o in alive)
        }
        before = t
    return {
        "rows": len(needed),
        "burst_nps": rate(1.0),
        "sustained_nps": rate(10.0),
        "crossovers": crossings,
        "fastest_jack": None if jack == math.inf else jack,
        "geometrically_possible": bool(alive),
        "max_simultaneous": max(len(p) for _, p in needed),
    }


def test_wide_charts_equal_a_walk_over_the_rows(spark):
    rng = random.Random(8)
    charts = {i: random_chart(rng, 6) for i in range(60)}
    report = play.playability(frame(spark, charts), ["chart"], ["t", "n"], segment=20.0, panels=6)
    found = {r["chart"]: r for r in report.collect()}
    for i, chart in charts.items():
        for name, value in (walk(chart) or {}).items():
            assert found[i][name] == pytest.approx(value), (i, name)


def random_chart(rng, width=4):
    # Songs may begin before time 0.
    t, chart = rng.choice([-8.0, -1.0, 0.0]), []
    for _ in range(rng.randrange(1, 60)):
        t += rng.choice([0.03, 0.06, 0.08, 0.1, 0.15, 0.2, 0.5, 3.0]) + rng.random() * 1e-3
        pad = [rng.choice([0, 0, 0, 1, 1, 2, 3, 5]) for _ in range(4)]
        chart.append((t, pad + [rng.choice([0] * 12 + [1, 2, 3]) for _ in range(width - 4)]))
    return chart


@pytest.mark.parametrize("segment", [None, 10.5, 37.0])
def test_report_equals_a_walk_over_the_rows(spark, segment):
    rng = random.Random(5)
    charts = {i: random_chart(rng) for i in range(120)}
    report = play.playability(frame(spark, charts), ["chart"], ["t", "n"], segment=segment)
    found = {r["chart"]: r for r in report.collect()}
    expected = {i: w for i, c in charts.items() if (w := walk(c)) is not None}
    assert set(found) == set(expected)
    for i, want in expected.items():
        for name, value in want.items():
            assert found[i][name] == pytest.approx(value), (i, name)


def test_styles_and_reasons(spark):
    charts = {
        0: alternating(40, 0.25),
        1: [(0.0, [1, 1, 1, 0]), (1.0, [1, 0, 0, 0])],
        2: [(i * 0.02, single(0)) for i in range(4)],
        3: alternating(300, 0.05),
        4: [(0.0, [1, 1, 1, 1])],
        5: [(0.0, [2, 0, 0, 2]), (1.0, [0, 1, 0, 0]), (2.0, [3, 0, 0, 3])],
    }
    found = {
        r["chart"]: r
        for r in play.playability(frame(spark, charts), ["chart"], ["t", "n"], segment=11.0).collect()
    }
    assert found[0]["style"] == "feet" and found[0]["reasons"] == []
    assert found[1]["style"] == "hands" and found[1]["pad_playable"]
    assert found[2]["style"] == "keyboard" and "fast_jack" in found[2]["reasons"]
    assert "sustained_rate" in found[3]["reasons"]
    assert found[4]["chord_rows"] == 1
    assert found[5]["chord_rows"] == 1 and found[5]["max_simultaneous"] == 3


def test_wide_rows_are_impossible(spark):
    rows = spark.createDataFrame([(0, 0, 0.0, [1, 1, 1, 1, 1])], SCHEMA)
    report = play.playability(rows, ["chart"], ["t", "n"]).collect()[0]
    assert report["impossible_rows"] == 1 and report["style"] == "keyboard"


def test_crossing_strings(spark):
    texts = ["LULURURU", "LDRDLDRD", "LDLDRURU", "LRLRLRLR", "LURULURU"]
    charts = {i: letters(s) for i, s in enumerate(texts)}
    found = {
        r["chart"]: r["crossovers"]
        for r in play.crossed_steps(frame(spark, charts), ["chart"], ["t", "n"], segment=1.0).collect()
    }
    assert found == {i: walk(c)["crossovers"] for i, c in charts.items()}
    assert found[0] == 2 and found[1] == 2 and found[3] == 0


def test_hot_key_is_cut_into_pieces(spark):
    """No stage of the report sorts or windows by the key alone except over summaries."""
    rows = frame(spark, {0: alternating(2000, 0.11)})
    report = play.playability(rows, ["chart"], ["t", "n"], segment=20.0)
    row = report.collect()[0]
    assert row["steps"] == 2000 and row["burst_nps"] == walk(alternating(2000, 0.11))["burst_nps"]


def test_rows_of_any_width(spark):
    """Panels after the tenth and the thirty-first are struck, held and repeated like any other."""
    rng = random.Random(12)
    charts = {i: random_chart(rng, width) for i, width in enumerate([5, 9, 10, 33, 40] * 4)}
    wide = [0] * 40
    charts[90] = [(0.0, wide[:35] + [1] + wide[36:])]
    charts[91] = [(0.0, wide[:9] + [2]), (1.0, [1, 1] + wide[2:10]), (2.0, wide[:9] + [3])]
    report = play.playability(frame(spark, charts), ["chart"], ["t", "n"], segment=20.0)
    found = {r["chart"]: r for r in report.collect()}
    for i, chart in charts.items():
        for name, value in (walk(chart) or {}).items():
            assert found[i][name] == pytest.approx(value), (i, name)
    assert found[90]["rows"] == 1
    assert found[91]["max_simultaneous"] == 3 and found[91]["chord_rows"] == 1


def test_rules_on_any_panel(spark):
    def row(codes):
        return [codes.get(p, 0) for p in range(40)]

    charts = {
        0: [(0.0, row({35: 2})), (1.0, row({35: 1})), (2.0, row({35: 3})), (3.0, row({35: 3}))],
        1: [(0.0, row({38: 1})), (0.01, row({38: 1})), (0.02, row({39: 1}))],
        2: [(0.0, row({9: 2})), (5.0, row({0: 1, 1: 1})), (9.0, row({9: 3}))],
    }
    found = audit.rule_audit(frame(spark, charts), ["chart"], ["t", "n"])
    assert {(r["chart"], r["n"], r["rule"]) for r in found.collect()} == {
        (0, 1, "step_on_held"),
        (0, 3, "orphan_tail"),
        (1, 1, "fast_jack"),
        (2, 1, "too_many_limbs"),
    }


@pytest.mark.parametrize(("block", "piece", "fan", "segment"), [(2, 2, 3, None), (3, 1, 5, 10.5), (5, 2, 2, 37.0)])
def test_feet_through_many_blocks(spark, monkeypatch, block, piece, fan, segment):
    """Relations joined block by block and level by level say what a walk says."""
    for name, value in (("BLOCK", block), ("PIECE", piece), ("FAN", fan), ("LEVELS", 5)):
        monkeypatch.setattr(play, name, value)
    rng = random.Random(block)
    charts = {}
    for i in range(80):
        t, chart = 0.0, []
        for _ in range(rng.randrange(1, 60)):
            t += rng.choice([0.05, 0.05, 0.08, 0.2])
            chart.append((t, rng.choice([single(rng.randrange(4)), single(rng.randrange(4)), [1, 1, 0, 0], [0, 1, 1, 0], [1, 0, 0, 1]])))
        charts[i] = chart
    report = play.playability(frame(spark, charts), ["chart"], ["t", "n"], segment=segment, width=4)
    found = {r["chart"]: r for r in report.collect()}
    possible = set()
    for i, chart in charts.items():
        want = walk(chart)
        possible.add(want["geometrically_possible"])
        for name, value in want.items():
            assert found[i][name] == pytest.approx(value), (i, name)
    assert possible == {True, False}


def test_dense_key(spark):
    """A million rows of one key inside one segment: whole results, and nothing in the plan lists a group's rows."""
    n = 1_000_000
    at = F.col("id") * 0.05
    rows = spark.range(n).select(F.lit(1).alias("chart"), F.col("id").alias("n"), at.alias("t"), F.array(*[
        F.when(F.col("id") % 4 == p, 1).otherwise(0) for p in range(4)
    ]).alias("codes"))
    report = play.playability(rows, ["chart"], ["t", "n"], segment=1e6, width=4)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan
    (row,) = report.collect()
    assert row["rows"] == row["steps"] == n and row["geometrically_possible"]
    assert row["fastest_jack"] == pytest.approx(0.2) and row["burst_nps"] == 21.0
    # A jump from one pair of panels to the other within the shortest gap cannot be danced, however late it comes.
    n = 100_000
    rows = rows.where(F.col("n") < n)
    both = F.when(F.col("n") == n - 2, F.array(*[F.lit(c) for c in (1, 1, 0, 0)])).when(F.col("n") == n - 1, F.array(*[F.lit(c) for c in (0, 0, 1, 1)]))
    broken = rows.withColumn("codes", F.coalesce(both, F.col("codes")))
    assert not play.feet_feasible(broken, ["chart"], ["t", "n"], segment=1e6, width=4).first()["geometrically_possible"]


def test_promised_width_is_checked(spark):
    rows = spark.createDataFrame([(0, 0, 0.0, [1, 0, 0, 0, 1])], SCHEMA)
    with pytest.raises(Exception, match="wider than the 4 panels"):
        play.playability(rows, ["chart"], ["t", "n"], width=4).collect()
