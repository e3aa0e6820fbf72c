"""Grid targets, slot features and frames assigned to slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import grid_slot, panel_codes
from tactus.operators import timing
from tactus.operators.ordered import KEY, dealt, scan

#: Slots that are laid out from one row at a time.
BLOCK = 4096


def to_slots(rows: DataFrame, counts: DataFrame, keys: Sequence[str], *, beat: str = "beat") -> DataFrame:
    """P14 - add the grid slot of each row and drop rows outside ``0 .. slot_count``."""
    placed = rows.withColumn("slot", grid_slot(F.col(beat))).join(counts, list(keys))
    return placed.where((F.col("slot") >= 0) & (F.col("slot") < F.col("slot_count"))).drop("slot_count")


def chart_targets(rows: DataFrame, counts: DataFrame, keys: Sequence[str], columns: str = "columns") -> DataFrame:
    """P11 and P14 - slot and four panel codes of every note row."""
    return to_slots(rows, counts, keys).withColumn("codes", panel_codes(F.col(columns)))


def placement(
    targets: DataFrame, counts: DataFrame, keys: Sequence[str], *, slot: str = "slot", codes: str = "codes"
) -> DataFrame:
    """P15 - every grid slot of a chart with 1 where the player must step.

    Steps shrink to one bit mask per measure before the shuffle, and the grid is only laid out once
    the masks have met it, so the dense rows themselves are never shuffled.
    """
    per = k.SLOTS_PER_MEASURE
    measure, bit = F.floor(F.col(slot) / per), F.pmod(F.col(slot), F.lit(per)).cast("int")
    bits = F.expr("array(" + ", ".join(f"{1 << i}L" for i in range(per)) + ")")
    masks = (
        targets.where(F.exists(codes, lambda c: c.isin(*k.STEP_CODES)))
        .groupBy(*keys, measure.alias("__measure"))
        .agg(F.bit_or(F.get(bits, bit)).alias("__mask"))
    )
    n = F.col("slot_count")
    measures = counts.where(n > 0).select(
        *keys,
        n.cast("bigint").alias("__n"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / per))).alias("__measure"),
    )
    joined = measures.join(masks, [*keys, "__measure"], "left")
    start = F.col("__measure") * per
    top = F.least(F.lit(per).cast("bigint"), F.col("__n") - start)
    laid = joined.select(
        *keys, start.alias("__start"), "__mask", F.explode(F.sequence(F.lit(0), (top - 1).cast("int"))).alias("__i")
    )
    set_here = F.coalesce(F.col("__mask").bitwiseAND(F.get(bits, F.col("__i"))) != 0, F.lit(False))
    return laid.select(
        *keys, (F.col("__start") + F.col("__i")).alias(slot), set_here.cast("int").alias("placed")
    )


def _slot_count(beats: str) -> Column:
    """How many fine slots fit into these beats, at least one."""
    return F.greatest((F.greatest(F.col(beats), F.lit(0.0)) * F.lit(float(k.FINE_SLOTS_PER_BEAT))).cast("int"), F.lit(1))


def grid_beats(songs: DataFrame, keys: Sequence[str], *, beats: str = "total_beats") -> DataFrame:
    """P16 - fine slots of a song and the beat each stands on, at least one per song."""
    return songs.select(*keys, F.explode(F.sequence(F.lit(0), _slot_count(beats) - 1)).alias("fine")).withColumn(
        "beat", F.col("fine") / F.lit(float(k.FINE_SLOTS_PER_BEAT))
    )


def grid_times(
    songs: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    *,
    duration: str = "duration",
    segment: float | None = None,
) -> DataFrame:
    """P16 - seconds of every fine slot of a song: ``(keys, fine, beat, time)``.

    ``points`` are the breakpoints of the songs. A song has as many slots as fit into the beats reached
    at its duration, at least one; without a timing map that one has no time.

    A breakpoint gives the times of all slots from its beat to the next one's. Breakpoints meet the counts of their
    songs, and slots are laid out after that, so the slots themselves are never shuffled or sorted.
    """
    reached = timing.beat_at_time(
        songs.select(*keys, duration), points, keys, time=duration, probe_id=[duration], segment=segment, out="total_beats"
    )
    per = F.lit(float(k.FINE_SLOTS_PER_BEAT))
    # Inside a struct nulls are equal, so songs with nulls among their keys find their breakpoints.
    counts = reached.select(F.struct(*keys).alias(KEY), _slot_count("total_beats").cast("bigint").alias("__n"))
    # Of rows on one beat the last one holds; only it has a later row, if any, on another beat.
    held = F.max_by(F.struct("t_end", "bpm"), F.struct("declared", "kind", "value", "t_end"))
    after = F.max(F.coalesce(F.col("next_beat"), F.lit(float("inf"))))
    starts = points.groupBy(F.struct(*keys).alias(KEY), F.col("beat").alias("__beat")).agg(held.alias("__hit"), after.alias("__after"))
    joined = dealt(counts, KEY).join(dealt(starts, KEY), KEY, "left")

    def first_slot(beat: Column) -> Column:
        """The first slot on or after a beat, or the count of slots if there is none."""
        near = F.ceil(beat * per)
        exact = F.when((near - 1) / per >= beat, near - 1).when(near / per < beat, near + 1).otherwise(near)
        return F.when(beat > (F.col("__n") - 1) / per, F.col("__n")).otherwise(F.greatest(exact, F.lit(0)))

    known = F.col("__beat").isNotNull()
    ranges = joined.withColumn("__lo", F.when(known, first_slot(F.col("__beat"))).otherwise(F.lit(0)))
    ranges = ranges.withColumn("__hi", F.when(known, first_slot(F.col("__after"))).otherwise(F.col("__n")) - 1).where(F.col("__lo") <= F.col("__hi"))
    blocks = ranges.withColumn("__at", F.explode(F.sequence("__lo", "__hi", F.lit(BLOCK).cast("bigint"))))
    laid = blocks.withColumn("__fine", F.explode(F.sequence("__at", F.least(F.col("__at") + (BLOCK - 1), F.col("__hi")))))
    beat = F.col("__fine").cast("int") / per
    rate = F.when(F.col("__hit.bpm") > 0, F.lit(60.0) / F.col("__hit.bpm")).otherwise(F.lit(0.0))
    time = F.col("__hit.t_end") + (beat - F.col("__beat")) * rate
    return laid.select(*[F.col(f"{KEY}.{c}").alias(c) for c in keys], F.col("__fine").cast("int").alias("fine"), beat.alias("beat"), time.alias("time"))


def frame_edges(slots: DataFrame, keys: Sequence[str], frames: DataFrame, *, time: str = "time", fps: float = k.FRAME_RATE, slot: str = "slot", segment: Column | None = None) -> DataFrame:
    """First frame of each slot and the first frame past it.

    ``frames`` has one row per song with ``frame_count``. A slot always takes at least one frame.
    """
    last = F.col("frame_count") - 1
    edge = F.greatest(F.lit(0), F.least((F.col(time) * F.lit(fps)).cast("bigint"), last))
    edged = slots.join(frames, list(keys)).withColumn("first", edge)
    ahead = scan(edged, keys, [slot], segment, lead={"__next": F.col("first")})
    stop = F.greatest(F.coalesce("__next", F.col("frame_count")), F.col("first") + 1)
    return ahead.withColumn("stop", stop).drop("__next", "frame_count")


def assign_frames(
    frames: DataFrame, edges: DataFrame, keys: Sequence[str], *, frame: str = "frame", slot: str = "slot"
) -> DataFrame:
    """J09 - frames with the slot that takes them.

    Every edge row lists the frames it spans, which is a bounded span of one slot, so the interval
    join becomes an equi-join on ``(key, frame)``. Two slots on one frame both get it.
    """
    wanted = edges.select(
        *keys, slot, F.explode(F.sequence("first", F.col("stop") - 1)).alias(frame)
    )
    return frames.join(wanted, [*keys, frame])


def slot_features(
    frames: DataFrame,
    keys: Sequence[str],
    *,
    bands: str = "bands",
    onset: str = "onset",
    width: int,
) -> DataFrame:
    """A09 - per slot: mean of every band, mean and maximum of the onset strength."""
    b = F.col(bands)
    means = F.array(*[F.avg(F.get(b, F.lit(i)).cast("double")) for i in range(width)])
    return frames.groupBy(*keys).agg(
        means.alias("bands"),
        F.avg(F.col(onset).cast("double")).alias("onset_mean"),
        F.max(F.col(onset).cast("double")).alias("onset_max"),
    )


# Layers of a song in the order their features are written, and the bands of each.
LAYERS = (("drums", 48), ("bass", 48), ("other", 48), ("vocals", 48), ("mixture", 64))


def join_layers(features: DataFrame, keys: Sequence[str], *, layer: str = "layer", layers: Sequence[tuple[str, int]] = LAYERS) -> DataFrame:
    """A09 - one feature array per slot with all layers in order; a missing layer is all zero."""
    whole = F.concat("bands", F.array("onset_mean", "onset_max"))
    parts = [
        F.coalesce(
            F.max_by(whole, F.when(F.col(layer) == name, F.lit(1))),
            F.array_repeat(F.lit(0.0), width + 2),
        )
        for name, width in layers
    ]
    return features.groupBy(*keys).agg(F.concat(*parts).alias("features"))


def slot_loudness(
    features: DataFrame, keys: Sequence[str], *, fine: str = "fine", bands: str = "bands"
) -> DataFrame:
    """A10 - loudest band over the two fine slots of each note slot; an odd last one is dropped."""
    pairs = features.groupBy(*keys, F.floor(F.col(fine) / 2).alias("slot")).agg(
        F.max(F.array_max(bands)).alias("loudness"), F.count(F.lit(1)).alias("__n")
    )
    return pairs.where(F.col("__n") == 2).drop("__n")


def pool_measures(
    features: DataFrame,
    keys: Sequence[str],
    *,
    slot: str = "slot",
    values: str = "features",
    width: int,
    per_measure: int = k.SLOTS_PER_MEASURE,
    scale: float = 80.0,
    most: int | None = None,
) -> DataFrame:
    """A11 - mean and maximum of every feature over each whole measure, and its relative position.

    ``most`` keeps only the first measures, for readers of fixed length; all count by default.
    """
    v = F.col(values)
    at = [F.get(v, F.lit(i)).cast("double") / F.lit(scale) for i in range(width)]
    pooled = (
        features.groupBy(*keys, F.floor(F.col(slot) / per_measure).alias("measure"))
        .agg(
            F.array(*[F.avg(x) for x in at]).alias("mean"),
            F.array(*[F.max(x) for x in at]).alias("peak"),
            F.count(F.lit(1)).alias("__n"),
        )
        .where((F.col("__n") == per_measure) & (F.lit(True) if most is None else F.col("measure") < most))
        .drop("__n")
    )
    counts = pooled.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"))
    place = F.when(F.col("__count") > 1, F.col("measure") / (F.col("__count") - 1)).otherwise(F.lit(0.0))
    return pooled.join(counts, list(keys)).withColumn("position", place).drop("__count")
