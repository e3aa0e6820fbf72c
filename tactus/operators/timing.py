"""Beats and seconds: piecewise-linear timing maps and the as-of joins over them.

A timing map is three tables: ``tempo(keys, beat, bpm)``, ``stops(keys, beat, seconds)`` and
``songs(keys, offset)``. An as-of join is a union of both sides ordered by position, with the latest
build row carried forward (:func:`tactus.operators.ordered.scan`); there is no range join and a song
holding most of the probes is still cut into segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.operators.ordered import KEY, SEGMENT, scan, settle

FAR = -1e12


def _seconds_per_beat(bpm: Column) -> Column:
    return F.when(bpm > 0, F.lit(60.0) / bpm).otherwise(F.lit(0.0))


def _cut(column: Column, segment: float | None) -> Column | None:
    return None if segment is None else F.floor(column / F.lit(float(segment)))


def union_segments(*tables: DataFrame) -> DataFrame:
    """U01 - stack segment tables that name their columns alike."""
    first, *rest = tables
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def opening_tempo(tempo: DataFrame, keys: Sequence[str], listed: str | None = None) -> DataFrame:
    """Tempo declared first, and the tempo with the smallest beat, of each song."""
    by_beat = F.struct("beat", "bpm")
    return tempo.groupBy(*keys).agg(
        F.min_by("bpm", F.col(listed) if listed else by_beat).alias("declared_bpm"),
        F.min_by("bpm", by_beat).alias("first_bpm"),
    )


def breakpoints(
    tempo: DataFrame,
    stops: DataFrame,
    songs: DataFrame,
    keys: Sequence[str],
    *,
    listed: str | None = None,
    segment: float | None = None,
) -> DataFrame:
    """J01 - where the clock of each song changes.

    One row per tempo change or stop plus one for beat 0: the beat, the time before and after any
    stop on it, the tempo from there on and the beat of the next row. The earliest tempo governs
    from beat 0 even when it is declared later.

    The table has one row per change, far fewer than the notes looked up in it, and every look-up
    reads it more than once, so it is settled.
    """
    base = songs.select(*keys, "offset").join(opening_tempo(tempo, keys, listed), list(keys))
    events = union_segments(
        base.select(
            *keys,
            F.lit(FAR).alias("declared"),
            F.lit(-1).alias("kind"),
            F.col("first_bpm").alias("value"),
            (-F.col("offset")).alias("origin"),
            "declared_bpm",
        ),
        tempo.select(
            *keys, F.col("beat").alias("declared"), F.lit(0).alias("kind"), F.col("bpm").alias("value")
        ),
        stops.select(
            *keys,
            F.col("beat").alias("declared"),
            F.lit(1).alias("kind"),
            F.col("seconds").alias("value"),
        ),
    ).withColumn("beat", F.greatest("declared", F.lit(0.0)))
    events = settle(events)
    order = ["beat", "declared", "kind", "value"]
    cut = _cut(F.col("beat"), segment)
    sets_tempo = F.when(F.col("kind") < 1, F.col("value"))
    linked = scan(
        events,
        keys,
        order,
        cut,
        lag={"__before": F.col("beat")},
        lead={"next_beat": F.col("beat")},
        last_before={"__bpm": sets_tempo},
        last={
            "bpm": sets_tempo,
            "start": F.col("origin"),
            "opening": F.col("declared_bpm"),
        },
    )
    advance = F.coalesce(
        (F.col("beat") - F.col("__before")) * _seconds_per_beat(F.col("__bpm")), F.lit(0.0)
    )
    pause = F.when(F.col("kind") == 1, F.col("value")).otherwise(F.lit(0.0))
    timed = scan(
        linked,
        keys,
        order,
        cut,
        running={"__moved": advance, "__paused": pause},
    )
    ended = F.col("start") + F.col("__moved") + F.col("__paused")
    # A song without any tempo has no opening row, hence no clock.
    return settle(
        timed.where(F.col("start").isNotNull()).select(
            *keys,
            "kind",
            "declared",
            "beat",
            "value",
            (ended - pause).alias("t_start"),
            ended.alias("t_end"),
            "bpm",
            "next_beat",
            F.col("start").alias("origin"),
            F.col("opening").alias("declared_bpm"),
        )
    )


def as_of(
    probes: DataFrame,
    build: DataFrame,
    keys: Sequence[str],
    *,
    probe_at: Column,
    build_at: Column,
    probe_id: Sequence[str],
    build_id: Sequence[str],
    carry: Sequence[str],
    segment: float | None = None,
) -> DataFrame:
    """Latest build row at or before each probe, as a struct column ``hit``.

    Of several build rows on one position the last in ``build_id`` order wins; ``probe_id`` only has
    to make the probes of a key distinct.
    """
    hit = F.struct(*carry)
    rank = F.struct(*[F.col(c) for c in build_id])
    left = build.select(
        *keys, build_at.alias("__at"), F.lit(0).alias("__side"), rank.alias("__rank"), hit.alias("__b")
    )
    right = probes.select(
        *keys,
        probe_at.alias("__at"),
        F.lit(1).alias("__side"),
        F.struct(*probe_id).alias("__pid"),
        F.struct(*[c for c in probes.columns]).alias("__p"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    found = scan(
        both,
        keys,
        ["__at", "__side", "__rank", "__pid"],
        _cut(F.col("__at"), segment),
        last={"hit": F.col("__b")},
    )
    return found.where(F.col("__side") == 1).select("__p.*", "hit")


def time_at_beat(
    probes: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    *,
    beat: str = "beat",
    probe_id: Sequence[str],
    segment: float | None = None,
    out: str = "time",
) -> DataFrame:
    """J02 - seconds at which a beat falls, after any stop on that very beat.

    Beats before 0 run backwards at the opening tempo.
    """
    b = F.col(beat)
    found = as_of(
        probes,
        points,
        keys,
        probe_at=F.greatest(b, F.lit(0.0)),
        build_at=F.col("beat"),
        probe_id=probe_id,
        build_id=["declared", "kind", "value"],
        carry=["beat", "t_end", "bpm", "origin"],
        segment=segment,
    )
    rate = _seconds_per_beat(F.col("hit.bpm"))
    time = F.when(b < 0, F.col("hit.origin") + b * rate).otherwise(
        F.col("hit.t_end") + (b - F.col("hit.beat")) * rate
    )
    return found.withColumn(out, time).drop("hit")


def constant_time_at_beat(beat: Column, bpm: Column, offset: Column) -> Column:
    """J02 for a song with one tempo and no stops: plain arithmetic, no join."""
    return beat * F.lit(60.0) / bpm - offset


def beat_at_time(
    probes: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    *,
    time: str = "time",
    probe_id: Sequence[str],
    segment: float | None = None,
    out: str = "beat",
) -> DataFrame:
    """J03 - beat reached at a time. Inside a stop the beat stands still.

    Before beat 0 the first declared tempo runs backwards.
    """
    opening = points.where(F.col("kind") == -1).select(
        *keys,
        F.lit(-2).alias("kind"),
        F.lit(FAR).alias("declared"),
        F.lit(0.0).alias("beat"),
        F.lit(FAR).alias("t_sort"),
        F.col("origin").alias("t_end"),
        F.col("declared_bpm").alias("bpm"),
        F.lit(0.0).alias("next_beat"),
        F.lit(0.0).alias("value"),
    )
    build = points.withColumn("t_sort", F.col("t_end")).unionByName(opening, allowMissingColumns=True)
    found = as_of(
        probes,
        build,
        keys,
        probe_at=F.col(time),
        build_at=F.col("t_sort"),
        probe_id=probe_id,
        build_id=["beat", "declared", "kind", "value"],
        carry=["beat", "t_end", "bpm", "next_beat"],
        segment=segment,
    )
    beats = F.when(
        F.col("hit.bpm") > 0,
        F.col("hit.beat") + (F.col(time) - F.col("hit.t_end")) / (F.lit(60.0) / F.col("hit.bpm")),
    ).otherwise(F.col("hit.beat"))
    return found.withColumn(out, F.least(beats, F.col("hit.next_beat"))).drop("hit")


def bpm_at_beat(
    probes: DataFrame,
    tempo: DataFrame,
    keys: Sequence[str],
    *,
    beat: str = "beat",
    probe_id: Sequence[str],
    listed: str | None = None,
    segment: float | None = None,
    out: str = "bpm",
) -> DataFrame:
    """J04 - tempo in force on a beat; before the first segment, the first declared tempo."""
    opening = opening_tempo(tempo, keys, listed).select(
        *keys, F.lit(FAR).alias("beat"), F.col("declared_bpm").alias("bpm")
    )
    build = settle(tempo.select(*keys, "beat", "bpm").unionByName(opening))
    found = as_of(
        probes,
        build,
        keys,
        probe_at=F.col(beat),
        build_at=F.col("beat"),
        probe_id=probe_id,
        build_id=["bpm"],
        carry=["bpm"],
        segment=segment,
    )
    return found.withColumn(out, F.col("hit.bpm")).drop("hit")


def apply_warps(
    songs: DataFrame,
    markers: DataFrame,
    keys: Sequence[str],
    *,
    segment: float | None = None,
) -> DataFrame:
    """J10 - tempo segments after placing markers ``(keys, seconds, bpm)`` on a constant tempo.

    The beat of a marker is the tempo in force, integrated from the start of the song. What a segment
    does to the beat that enters it is an affine map: add a known number of beats, and one gap times the tempo
    that enters. One row per segment carries that map, so markers are shuffled once. A marker at or
    before beat 0 replaces the opening tempo. Markers without a time, and those of songs without an
    offset, are left out.
    """
    starts = songs.select(*keys, (-F.col("offset")).alias("at"), F.lit(1).alias("side"), "bpm")
    changes = markers.select(*keys, F.col("seconds").alias("at"), F.lit(0).alias("side"), "bpm")
    cut = F.lit(0) if segment is None else _cut(F.col("at"), segment)
    # Inside a struct nulls are equal. Both uses of these rows share the exchange: a left join adds no filter to one.
    rows = (
        changes.unionByName(starts)
        .where(F.col("at").isNotNull())
        .select(F.struct(*keys).alias(KEY), cut.alias(SEGMENT), "at", "side", "bpm")
        .repartition(KEY, SEGMENT)
    )
    tempo = F.struct("bpm")
    w = Window.partitionBy(KEY, SEGMENT).orderBy("at", "side", "bpm")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)

    def latest(side: int, frame: Window) -> Column:
        return F.last(F.when(F.col("side") == side, tempo), ignorenulls=True).over(frame)

    local = rows.withColumns(
        {
            "__gap": F.col("at") - F.lag("at").over(w),
            "__marker": latest(0, prior),
            "__start": latest(1, prior),
            "__begun": latest(1, upto),
        }
    )
    begun, known = F.col("__start").isNotNull(), F.col("__marker").isNotNull()
    marks = F.when(F.col("side") == 0, F.struct("at", "bpm"))
    maps = local.groupBy(KEY, SEGMENT).agg(
        F.min("at").alias("__first"),
        F.max("at").alias("__last"),
        F.max_by(tempo, marks).alias("__out"),
        F.max(F.when(F.col("side") == 1, tempo)).alias("__opens"),
        F.sum(F.col("__gap") * F.col("__marker.bpm")).alias("__whole"),
        F.sum(F.when(begun & known, F.col("__gap") * F.col("__marker.bpm"))).alias("__known"),
        F.sum(F.when(begun & ~known, F.col("__gap"))).alias("__open_gap"),
    )
    across = Window.partitionBy(KEY).orderBy(SEGMENT)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    entered = maps.withColumns(
        {
            "__in": F.last("__out", ignorenulls=True).over(earlier),
            "__since": F.last("__opens", ignorenulls=True).over(earlier),
            "__enter": F.col("__first") - F.lag("__last").over(across),
        }
    )
    enter = F.when(
        F.col("__since").isNotNull(), F.col("__enter") * F.coalesce("__in", "__since")["bpm"]
    )
    zero = F.lit(0.0)
    opened = F.coalesce(F.col("__open_gap") * F.coalesce("__in", "__opens")["bpm"], zero)
    inner = F.when(F.col("__since").isNotNull(), F.coalesce("__whole", zero)).otherwise(
        F.coalesce("__known", zero) + opened
    )
    entered = entered.withColumn("__enter", F.coalesce(enter, zero)).withColumn("__all", F.col("__enter") + inner)
    carried = entered.select(
        KEY,
        SEGMENT,
        (F.coalesce(F.sum("__all").over(earlier), F.lit(0.0)) + F.col("__enter")).alias("__from"),
        "__in",
        "__since",
    )
    rate = F.coalesce("__marker", "__in", "__since", "__start")["bpm"]
    moving = F.coalesce("__since", "__start").isNotNull()
    moved = F.coalesce(F.when(moving, F.col("__gap") * rate), zero)
    placed = local.join(carried, [KEY, SEGMENT], "left").withColumn(
        "beat", (F.col("__from") + F.sum(moved).over(upto)) / F.lit(60.0)
    )
    opening = F.coalesce("__marker", "__in", tempo)["bpm"]
    return placed.where(F.coalesce("__since", "__begun").isNotNull()).select(
        f"{KEY}.*", "beat", F.when(F.col("side") == 1, opening).otherwise(F.col("bpm")).alias("bpm")
    )


def timing_summary(
    tempo: DataFrame, stops: DataFrame, keys: Sequence[str], *, listed: str | None = None
) -> DataFrame:
    """A01 - primary, lowest and highest tempo, number of stops, and whether the tempo is constant."""
    rank = F.col(listed) if listed else F.struct("beat", "bpm")
    both = union_segments(
        tempo.select(*keys, "bpm", rank.alias("__rank"), F.lit(0).alias("__stop")),
        stops.select(*keys, F.lit(1).alias("__stop")),
    )
    found = both.groupBy(*keys).agg(
        F.min_by("bpm", "__rank").alias("primary_bpm"),
        F.min("bpm").alias("min_bpm"),
        F.max("bpm").alias("max_bpm"),
        F.sum("__stop").alias("stops"),
    )
    spread_out = F.greatest(
        F.col("max_bpm") - F.col("primary_bpm"), F.col("primary_bpm") - F.col("min_bpm")
    )
    return found.where(F.col("primary_bpm").isNotNull()).withColumn(
        "constant_bpm", (F.col("stops") == 0) & (spread_out < 1e-6)
    )


def adjust_timing(
    songs: DataFrame,
    *,
    shift_beats: float | Column = 0.0,
    latency: float | Column = 0.0,
    multiply: float | Column = 1.0,
) -> DataFrame:
    """P20 - scale the tempo, then move beat 0 by beats, then take off playback latency."""

    def column(x: float | Column) -> Column:
        return x if isinstance(x, Column) else F.lit(float(x))

    bpm = F.col("bpm") * column(multiply)
    offset = F.col("offset") - column(shift_beats) * F.lit(60.0) / bpm - column(latency)
    return songs.withColumns({"bpm": bpm, "offset": offset})
