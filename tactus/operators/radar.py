"""Freezes and the difficulty radar of grid charts: rows of ``(keys, slot, codes)``.

Slots are unique within a chart. ``segment`` is a width in slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import count_codes
from tactus.operators.ordered import KEY, SEGMENT, dealt, scan, spread

VOLTAGE_BEATS = 8
VOLTAGE_SLOTS = VOLTAGE_BEATS * k.SLOTS_PER_BEAT
#: Panels of what is no mark: a row as a whole, and its value in the next segment.
ROW, GHOST = -1, -2


def _cut(slot: str, segment: float | None) -> Column | None:
    return None if segment is None else F.floor(F.col(slot) / F.lit(float(segment)))


def hold_spans(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    slot: str = "slot",
    codes: str = "codes",
    segment: float | None = None,
) -> DataFrame:
    """J08 - where every freeze and roll ends.

    The next tail on the panel ends it; a head overwritten by another head has no length; one that
    is never closed ends with the chart.
    """
    last = rows.groupBy(*keys).agg(F.max(slot).alias("__last"))
    marks = rows.select(*keys, slot, F.posexplode(codes).alias("panel", "code")).where(
        F.col("code").isin(k.HOLD, k.TAIL, k.ROLL)
    )
    ahead = scan(
        marks,
        [*keys, "panel"],
        [slot],
        _cut(slot, segment),
        lead={"__next": F.struct(F.col("code").alias("c"), F.col(slot).alias("s"))},
    )
    end = (
        F.when(F.col("__next").isNull(), F.col("__last"))
        .when(F.col("__next.c") == k.TAIL, F.col("__next.s"))
        .otherwise(F.col(slot))
    )
    return (
        ahead.where(F.col("code") != k.TAIL)
        .join(last, list(keys), "left")
        .select(*keys, slot, "panel", "code", end.alias("end"))
    )


def held_count(
    rows: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    *,
    slot: str = "slot",
    segment: float | None = None,
) -> DataFrame:
    """W10 - add how many freezes begun earlier are still down on each row.

    Freezes become +1 and -1 events between the rows, and the count is a running sum.
    """
    keep = [c for c in rows.columns if c not in keys and c != slot]
    asked = rows.select(
        *keys, slot, F.lit(0).alias("__kind"), F.struct(*keep).alias("__row") if keep else F.lit(1).alias("__row"), F.lit(0).alias("__step")
    )
    ends = F.array(
        F.struct(F.col(slot).cast("bigint").alias("s"), F.lit(1).alias("kind"), F.lit(1).alias("step")),
        F.struct(F.col("end").cast("bigint").alias("s"), F.lit(2).alias("kind"), F.lit(-1).alias("step")),
    )
    events = (
        spans.select(*keys, F.explode(ends).alias("e"))
        .groupBy(*keys, F.col("e.s").cast(dict(rows.dtypes)[slot]).alias(slot), F.col("e.kind").alias("__kind"))
        .agg(F.sum("e.step").cast("int").alias("__step"))
    )
    both = asked.unionByName(events, allowMissingColumns=True)
    counted = scan(
        both, keys, [slot, "__kind"], _cut(slot, segment), running_before={"held": F.col("__step")}
    ).where(F.col("__kind") == 0)
    kept = ["__row.*"] if keep else []
    return counted.select(*keys, slot, *kept, F.col("held").cast("int").alias("held"))


def held_rows(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    slot: str = "slot",
    codes: str = "codes",
    segment: float | None = None,
    value: Column | None = None,
    reach: int = 0,
) -> DataFrame:
    """J08 and W10 - ``held_count`` over the freezes that ``hold_spans`` finds, in one shuffle of the rows.

    A head counts from its row on unless the next mark of its panel is a head, and a tail ends the count of
    the head before it. What enters a segment is how many freezes are down, the panels whose latest
    mark is a head and those whose next mark is one. With a ``value``, ``recent`` is added as ``peak_in_range``
    does it, in the same shuffle.
    """
    if segment is not None and reach > segment:
        raise ValueError("a segment must be at least as wide as the frame that crosses its edge")
    keep = [c for c in rows.columns if c not in keys and c != slot]
    heads = (k.HOLD, k.ROLL)
    marks = F.filter(
        F.transform(codes, lambda c, p: F.struct(p.alias("panel"), c.alias("code"))),
        lambda m: m["code"].isin(*heads, k.TAIL),
    )

    def alone(panel: int) -> Column:
        return F.array(F.struct(F.lit(panel).alias("panel"), F.lit(0).alias("code")))

    # The row itself, its marks, and its value once more in the next segment if that is within reach.
    cut = F.lit(0) if segment is None else _cut(slot, segment)
    parts = [alone(ROW), F.coalesce(marks, F.array())]
    if value is not None and segment is not None:
        crosses = F.floor((F.col(slot) + F.lit(reach)) / F.lit(float(segment))) > cut
        parts.append(F.when(crosses, alone(GHOST)).otherwise(F.array()))
    panel, code = F.col("panel"), F.col("code")
    listed = rows.select(
        F.struct(*keys).alias(KEY),
        cut.alias(SEGMENT),
        slot,
        F.struct(*keep).alias("__row"),
        (F.lit(None) if value is None else value).alias("__value"),
        F.explode(F.concat(*parts)).alias("__m"),
    ).select(KEY, SEGMENT, slot, "__row", "__value", "__m.*")
    events = dealt(
        listed.select(
            KEY,
            (F.col(SEGMENT) + (panel == GHOST).cast("int")).alias(SEGMENT),
            slot,
            "panel",
            "code",
            F.when(panel == ROW, F.col("__row")).alias("__row"),
            F.when(panel < 0, F.col("__value")).alias("__value"),
        ),
        KEY,
        SEGMENT,
    )
    local = Window.partitionBy(KEY, SEGMENT, "panel").orderBy(slot)
    whole = Window.partitionBy(KEY, SEGMENT)
    prior = whole.orderBy(slot, "panel").rowsBetween(Window.unboundedPreceding, -1)
    before, after = F.lag("code").over(local).isin(*heads), F.lead("code").over(local).isin(*heads)
    down = F.lit(0).cast("bigint")
    if segment is not None:
        events = events.join(_entering(events.where(panel != GHOST), slot, heads), [KEY, SEGMENT], "left")
        before = F.coalesce(before, F.array_contains("__begun", panel))
        after = F.coalesce(after, F.array_contains("__ahead", panel))
        down = F.coalesce("__down", down)
    no = F.lit(False)
    step = F.when(code.isin(*heads) & ~F.coalesce(after, no), 1).when((code == k.TAIL) & F.coalesce(before, no), -1)
    counted = events.withColumn("__step", step).withColumn("held", F.coalesce(F.sum("__step").over(prior), F.lit(0)) + down)
    added = [F.col("held").cast("int").alias("held")]
    if value is not None:
        counted = counted.withColumn("recent", F.sum("__value").over(whole.orderBy(slot).rangeBetween(-reach, 0)))
        added.append(F.col("recent"))
    kept = ["__row.*"] if keep else []
    return counted.where(panel == ROW).select(f"{KEY}.*", slot, *kept, *added)


def _entering(events: DataFrame, slot: str, heads: Sequence[int]) -> DataFrame:
    """Freezes that are down where a segment begins, for keys of two or more segments."""
    edges = events.groupBy(KEY, SEGMENT, "panel").agg(
        F.min_by("code", slot).alias("first"), F.max_by("code", slot).alias("last")
    )
    packed = edges.groupBy(KEY, SEGMENT).agg(F.collect_list(F.struct("panel", "first", "last")).alias("__edges"))
    whole = Window.partitionBy(KEY)
    several = packed.withColumn("__n", F.count(F.lit(1)).over(whole)).where(F.col("__n") > 1)
    edges = several.select(KEY, SEGMENT, F.explode("__edges").alias("e")).select(KEY, SEGMENT, "e.*")
    across = Window.partitionBy(KEY, "panel").orderBy(SEGMENT)
    no = F.lit(False)
    begun = F.coalesce(F.lag("last").over(across).isin(*heads), no)
    ahead = F.coalesce(F.lead("first").over(across).isin(*heads), no)
    edges = edges.withColumns({"__b": begun, "__a": ahead})
    change = (F.col("last").isin(*heads) & ~F.col("__a")).cast("int") - (F.col("__b") & (F.col("first") == k.TAIL)).cast("int")
    sums = edges.groupBy(KEY, SEGMENT).agg(
        F.sum(change).alias("__change"),
        F.collect_list(F.when(F.col("__b"), F.col("panel"))).alias("__begun"),
        F.collect_list(F.when(F.col("__a"), F.col("panel"))).alias("__ahead"),
    )
    earlier = whole.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(KEY, SEGMENT, F.sum("__change").over(earlier).alias("__down"), "__begun", "__ahead")


def peak_in_range(
    rows: DataFrame,
    keys: Sequence[str],
    value: Column,
    reach: int,
    *,
    slot: str = "slot",
    segment: float | None = None,
) -> DataFrame:
    """W09 - add the sum of ``value`` over rows at most ``reach`` slots back, as ``recent``."""
    placed = spread(
        rows.withColumn("__value", value),
        F.col(slot),
        segment,
        behind=float(reach),
    )
    near = Window.partitionBy(*keys, SEGMENT).orderBy(slot).rangeBetween(-reach, 0)
    return (
        placed.withColumn("recent", F.sum("__value").over(near))
        .where(~F.col("ghost"))
        .drop("ghost", "__value", SEGMENT)
    )


RADAR = (
    "stream",
    "voltage",
    "air",
    "freeze",
    "chaos",
    "notes",
    "taps_and_holds",
    "jumps",
    "holds",
    "mines",
    "hands",
    "rolls",
    "lifts",
    "fakes",
)


def radar(
    rows: DataFrame,
    keys: Sequence[str],
    seconds: Column | DataFrame,
    *,
    slot: str = "slot",
    codes: str = "codes",
    segment: float | None = None,
) -> DataFrame:
    """A03 - the fourteen radar values of each chart, lasting ``seconds``.

    That is a column of ``rows``, or a table (keys, seconds) of the charts that are wanted.
    """
    c = F.col(codes)
    notes = F.col("notes")
    timed = isinstance(seconds, Column)
    # One struct of small numbers a row; the codes themselves go no further than their marks.
    counted = rows.select(
        *keys,
        slot,
        codes,
        *([seconds.alias("__seconds")] if timed else []),
        count_codes(c, k.STEP_CODES).alias("notes"),
        *[count_codes(c, [code]).alias(n) for n, code in (("holds", k.HOLD), ("mines", k.MINE), ("rolls", k.ROLL), ("lifts", k.LIFT))],
    )
    near = held_rows(counted, keys, slot=slot, codes=codes, segment=segment, value=notes, reach=VOLTAGE_SLOTS)

    def flag(condition: Column) -> Column:
        return F.sum(condition.cast("int"))

    found = near.groupBy(*keys).agg(
        *([F.max("__seconds").alias("__s")] if timed else []),
        F.max(slot).alias("__last"),
        F.max("recent").alias("__peak"),
        flag(F.pmod(F.col(slot), F.lit(6)) != 0).alias("__fine"),
        F.sum(notes).alias("notes"),
        flag(notes >= 1).alias("taps_and_holds"),
        flag(notes >= 2).alias("jumps"),
        F.sum("holds").alias("holds"),
        F.sum("mines").alias("mines"),
        flag(notes + F.col("held") >= 3).alias("hands"),
        F.sum("rolls").alias("rolls"),
        F.sum("lifts").alias("lifts"),
    )
    if not timed:
        found = found.join(seconds.select(*keys, F.col("seconds").alias("__s")), list(keys))
    s = F.col("__s")

    def rate(value: Column) -> Column:
        return F.when(s > 0, value).otherwise(F.lit(0.0))

    beats = F.col("__last") / F.lit(float(k.SLOTS_PER_BEAT))
    return found.select(
        *keys,
        rate(F.col("notes") / s / F.lit(7.0)).alias("stream"),
        rate(F.col("__peak") / F.lit(float(VOLTAGE_BEATS)) * (beats / s) / F.lit(10.0)).alias("voltage"),
        rate(F.col("jumps") / s).alias("air"),
        rate(F.col("holds") / s).alias("freeze"),
        rate(F.col("__fine") / s * F.lit(0.5)).alias("chaos"),
        "notes",
        "taps_and_holds",
        "jumps",
        "holds",
        "mines",
        "hands",
        "rolls",
        "lifts",
        F.lit(0).cast("bigint").alias("fakes"),
    )
