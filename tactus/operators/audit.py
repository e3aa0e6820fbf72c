"""Rules a chart is written by, checked on any chart."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import count_codes, panel_mask, panel_set, step_mask
from tactus.operators.ordered import scan, settle
from tactus.operators.play import foot_steps, occupied


def _cut(column: str, segment: float | None) -> Column | None:
    return None if segment is None else F.floor(F.col(column) / F.lit(float(segment)))


def crowded(
    rows: DataFrame, keys: Sequence[str], *, slot: str = "slot", segment: float | None = None
) -> DataFrame:
    """W07 - mark rows with another less than six slots after them; nothing follows the last."""
    ahead = scan(rows, keys, [slot], _cut(slot, segment), lead={"__next": F.col(slot)})
    room = F.coalesce("__next", F.col(slot) + k.HOLD_SLOTS) - F.col(slot)
    return ahead.withColumn("crowded", room < 6).drop("__next")


#: What two blocks of rows have decayed to is below the rounding of what follows them.
FADED = 1e-8


def panel_usage(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    codes: str = "codes",
    decay: float = k.USAGE_DECAY,
    segment: Column | None = None,
) -> DataFrame:
    """W15 - decayed use of each panel up to every row, and the bias that evens it out.

    Rows are numbered and cut into blocks over which a tap decays to about ``FADED``, whatever the
    decay is. Inside a block the decayed sum is an ordinary running sum of scaled terms (the scale
    stays below 1 / ``FADED``); what earlier blocks contribute has decayed below double precision
    after two of them.
    """
    if not 0.0 < decay < 1.0:
        raise ValueError("decay must lie between 0 and 1")
    block = max(1, round(math.log(FADED) / math.log(decay)))
    numbered = scan(
        rows.withColumn("__step", step_mask(F.col(codes))),
        keys,
        order,
        segment,
        running={"__n": F.lit(1)},
    )
    index = F.col("__n") - 1
    placed = numbered.withColumns(
        {"__block": F.floor(index / block), "__in": F.pmod(index, F.lit(block))}
    )
    grow = F.pow(F.lit(1.0 / decay), F.col("__in"))
    terms = [
        F.when(F.col("__step").bitwiseAND(F.lit(1 << p)) != 0, grow).otherwise(F.lit(0.0))
        for p in range(k.PANELS)
    ]
    full = decay ** (block - 1)
    ends = placed.groupBy(*keys, "__block").agg(
        *[(F.sum(t) * F.lit(full)).alias(f"__end{p}") for p, t in enumerate(terms)]
    )
    across = Window.partitionBy(*keys).orderBy("__block")
    carried = ends.select(
        *keys,
        "__block",
        *[
            (
                F.coalesce(F.lag(f"__end{p}").over(across), F.lit(0.0))
                + F.coalesce(F.lag(f"__end{p}", 2).over(across), F.lit(0.0)) * F.lit(decay**block)
            ).alias(f"__carry{p}")
            for p in range(k.PANELS)
        ],
    )
    joined = placed.join(carried, [*keys, "__block"], "left")
    upto = (
        Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    fade = F.pow(F.lit(decay), F.col("__in"))
    usage = [
        fade * F.sum(t).over(upto) + F.col(f"__carry{p}") * fade * F.lit(decay)
        for p, t in enumerate(terms)
    ]
    used = joined.withColumn("usage", F.array(*usage))
    total = sum((F.get("usage", F.lit(p)) for p in range(k.PANELS)), F.lit(0.0)) + F.lit(4.0)
    bias = F.transform("usage", lambda u: -F.log((u + F.lit(1.0)) / total * F.lit(4.0)))
    return used.withColumn("bias", bias).select(*rows.columns, "usage", "bias")


def same_arrow_runs(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    codes: str = "codes",
    limit: int = k.SAME_ARROW_LIMIT,
    segment: Column | None = None,
) -> DataFrame:
    """W16 - how many times in a row the same single arrow has come, and whether that is stale."""
    stepped = rows.withColumn("__step", panel_set(F.col(codes), k.STEP_CODES))
    linked = scan(stepped, keys, order, segment, lag={"__before": F.col("__step")})
    same = (F.col("__step") == F.col("__before")) & (F.size("__step") == 1)
    breaks = ~F.coalesce(same, F.lit(False))
    counted = scan(
        linked,
        keys,
        order,
        segment,
        running={"__n": F.lit(1)},
        marks={"__from": (breaks, "__n")},
    )
    streak = F.col("__n") - F.col("__from") + 1
    return counted.withColumns({"repeats": streak, "stale": streak >= limit}).drop(
        "__step", "__before", "__n", "__from"
    )


@dataclass(frozen=True)
class Rations:
    """Shares a chart may spend."""

    holds: float = 0.04
    jumps: float = 0.08
    crossovers: float = 0.04


def ration_audit(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    seconds_per_slot: Column,
    *,
    codes: str = "codes",
    rations: Rations = Rations(),
    gap: float = k.STREAM_GAP,
    segment: float | None = None,
) -> DataFrame:
    """W17 - running shares of freezes, jumps and crossings, and the rows where one is overspent.

    A crossed stretch may last one step when the notes are sixteenths or faster, two otherwise; a
    jump leaves the stretch as it is.
    """
    time = order[0]
    cut = _cut(time, segment)
    prepared = rows.withColumns(
        {
            "stepped": step_mask(F.col(codes)),
            "__freezes": count_codes(F.col(codes), k.HOLD_CODES),
            "__sps": seconds_per_slot,
        }
    )
    linked = settle(foot_steps(prepared, keys, order, gap=gap, segment=segment))
    near = F.col(time) - F.col("previous")
    # The feet start together, so the first row is as fast as its own time from 0 says.
    fast = F.coalesce(near, F.lit(1e9)) <= F.col("__sps") * 3
    linked = linked.withColumn("fast", fast)
    single = F.bit_count(F.col("stepped")) == 1
    crossed, in_run = F.col("crossed"), F.col("in_run")
    count = {
        "rows": F.lit(1),
        "jumps": (F.bit_count(F.col("stepped")) > 1).cast("int"),
        "notes": F.bit_count(F.col("stepped")),
        "freezes": F.col("__freezes"),
        "streamed": in_run.cast("int"),
        "crossings": crossed.cast("int"),
        "fast_streamed": (in_run & F.col("fast")).cast("int"),
        "fast_crossings": (crossed & F.col("fast")).cast("int"),
    }
    summed = scan(
        linked, keys, order, cut, running=count, marks={"__reset": (single & ~crossed, "crossings")}
    )
    run = F.col("crossings") - F.coalesce("__reset", F.lit(0))
    over_crossings = (F.col("crossings") > F.col("streamed") * F.lit(rations.crossovers)) | (
        F.col("fast")
        & (
            F.col("fast_crossings")
            > F.col("fast_streamed") * F.lit(rations.crossovers * k.FAST_CROSSOVER_FRACTION)
        )
    )
    return summed.withColumns(
        {
            "crossed_run": run,
            "over_freezes": F.col("freezes") > F.greatest("notes", F.lit(1)) * F.lit(rations.holds),
            "over_jumps": F.col("jumps") > F.greatest("rows", F.lit(1)) * F.lit(rations.jumps),
            "over_crossings": over_crossings,
            "over_run": run > F.when(F.col("fast"), F.lit(1)).otherwise(F.lit(2)),
        }
    ).drop("__freezes", "__sps", "previous", "__reset")


def rule_audit(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    codes: str = "codes",
    style: str = "feet",
    mines: bool = False,
    rolls: bool = False,
    min_jack: float = k.MIN_JACK,
    min_room: float = k.MIN_JUMP_ROOM,
    segment: float | None = None,
    width: int | None = None,
) -> DataFrame:
    """W18 - violations of the charting rules, one row each: the row's columns and ``rule``. ``width`` is as in :func:`occupied`."""
    time = order[0]
    cut = _cut(time, segment)
    seen = occupied(rows, keys, order, codes=codes, width=width, segment=cut)
    near = scan(
        seen,
        keys,
        order,
        cut,
        lag={"__t0": F.col(time), "__step0": panel_set(F.col(codes), k.STEP_CODES)},
        lead={"__t1": F.col(time)},
    )
    gap = F.col(time) - F.col("__t0")
    room = F.least(gap, F.col("__t1") - F.col(time))
    c, pinned, beyond = F.col(codes), F.col("pinned"), F.col("beyond")
    steps = count_codes(c, k.STEP_CODES)
    limit = 2 if style == "feet" else 4
    blocked = panel_mask(c, (k.TAP, k.HOLD, k.ROLL, k.MINE, k.LIFT))
    tails = panel_mask(F.slice(c, 1, k.PANELS), (k.TAIL,))
    never = F.lit(False)
    rules = {
        "fast_jack": never
        if style == "keyboard"
        else (gap < min_jack) & F.arrays_overlap(panel_set(c, k.STEP_CODES), "__step0"),
        "cramped_jump": (steps > 1) & (room < min_room) if style == "feet" else never,
        "step_on_held": (blocked.bitwiseAND(pinned) != 0) | beyond["on_held"],
        "orphan_tail": (tails.bitwiseAND(F.bitwise_not(pinned)) != 0) | beyond["orphan"],
        "too_many_limbs": steps + F.bit_count(pinned) + beyond["pinned"] > limit,
        "mine": never if mines else F.array_contains(c, k.MINE),
        "roll": never if rolls else F.array_contains(c, k.ROLL),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return near.select(*rows.columns, F.explode(broken).alias("rule"))


def close_holds(
    rows: DataFrame, keys: Sequence[str], *, slot: str = "slot", codes: str = "codes", segment: float | None = None
) -> DataFrame:
    """W19 - rows with a tail row added for every freeze the next row does not end itself.

    The tail falls twelve slots after the head or one slot before the next row, whichever is first;
    freezes begun together end together.
    """
    ahead = scan(
        rows.select(*keys, slot, codes),
        keys,
        [slot],
        _cut(slot, segment),
        lead={"__next": F.struct(F.col(slot).alias("s"), F.col(codes).alias("c"))},
    )
    ends = F.least(F.col(slot) + k.HOLD_SLOTS, F.col("__next.s") - 1)
    tail = F.transform(
        F.col(codes),
        lambda c, p: F.when(
            c.isin(*k.HOLD_CODES) & (F.coalesce(F.get(F.col("__next.c"), p), F.lit(0)) != k.TAIL),
            F.lit(k.TAIL),
        ).otherwise(F.lit(0)),
    )
    added = F.when(F.exists(tail, lambda c: c == k.TAIL), F.struct(ends.alias(slot), tail.alias(codes)))
    both = F.array_compact(F.array(F.struct(F.col(slot).alias(slot), F.col(codes).alias(codes)), added))
    return ahead.select(*keys, F.explode(both).alias("__r")).select(*keys, "__r.*")
