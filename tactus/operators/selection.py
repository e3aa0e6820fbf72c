"""Choosing grid slots from scores: silence, seeds, quotas, spacing, rests, preview.

``scores`` hold song keys, an integer ``slot`` and a ``score`` (NULL where the slot is out of
reach). Ties go to the earlier slot.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.operators.ordered import scan, settle
from tactus.operators.stats import exact_quantiles, median


def on_grid(scores: DataFrame, *, triplets: bool = False, slot: str = "slot") -> DataFrame:
    """F06 - slots on sixteenths, and on twelfths when triplets are wanted."""
    within = F.pmod(F.col(slot), F.lit(k.SLOTS_PER_BEAT))
    usable = within % 3 == 0
    return scores.where(usable | (within % 4 == 0) if triplets else usable)


def audible(
    scores: DataFrame, loudness: DataFrame, keys: Sequence[str], *, floor: float = k.SILENT_DECIBELS, slot: str = "slot"
) -> DataFrame:
    """F07 - slots with sound in them; slots the loudness table does not reach count as audible."""
    heard = loudness.select(*keys, slot, F.col("loudness").alias("__loud"))
    joined = scores.join(heard, [*keys, slot], "left")
    return joined.where(F.coalesce(F.col("__loud") > floor, F.lit(True))).drop("__loud")


def silence_threshold(
    measures: DataFrame, keys: Sequence[str], value: str = "loudest", *, segment: float | None = None
) -> DataFrame:
    """A14 - median less six median absolute deviations; just below the minimum when they are all alike."""
    middles = median(measures, keys, F.col(value), "__middle", segment=segment)
    lows = measures.groupBy(*keys).agg(F.min(value).alias("__low"))
    apart = measures.join(middles, list(keys)).withColumn("__d", F.abs(F.col(value) - F.col("__middle")))
    spreads = median(apart, keys, F.col("__d"), "__spread", segment=segment)
    limit = F.when(F.col("__spread") <= 0, F.col("__low") - 1.0).otherwise(
        F.col("__middle") - F.lit(k.SILENCE_DROP) * F.col("__spread")
    )
    return middles.join(spreads, list(keys)).join(lows, list(keys)).select(*keys, limit.alias("threshold"))


def strongest_slots(
    scores: DataFrame, keys: Sequence[str], *, slot: str = "slot", score: str = "score", per_measure: int = k.SLOTS_PER_MEASURE
) -> DataFrame:
    """Strongest slot and highest score of every measure."""
    measure = F.floor(F.col(slot) / per_measure)
    return (
        scores.where(F.col(score).isNotNull())
        .groupBy(*keys, measure.alias("measure"))
        .agg(
            F.max_by(slot, F.struct(F.col(score), -F.col(slot))).alias(slot),
            F.max(score).alias("loudest"),
        )
    )


def seed_pulse(
    scores: DataFrame,
    songs: DataFrame,
    keys: Sequence[str],
    *,
    slot: str = "slot",
    score: str = "score",
    per_measure: int = k.SLOTS_PER_MEASURE,
    segment: float | None = None,
) -> DataFrame:
    """K02 - the strongest slot of every measure that is not silent: ``(keys, measure, slot)``.

    ``songs`` carries ``slot_count`` and the budget ``wanted``. A song of one measure, or with a
    budget below one note per measure, seeds nothing.
    """
    best = strongest_slots(scores, keys, slot=slot, score=score, per_measure=per_measure)
    limits = silence_threshold(best, keys, segment=segment)
    measures = F.ceil(F.col("slot_count") / per_measure)
    seeded = songs.where((measures >= 2) & (F.col("wanted") >= measures)).select(*keys)
    return (
        best.join(limits, list(keys))
        .join(seeded, list(keys), "left_semi")
        .where(F.col("loudest") > F.col("threshold"))
        .select(*keys, "measure", slot)
    )


def _mix(rate: Column, part: int) -> Column:
    values = ", ".join(f"{row[part]!r}D" for row in k.RHYTHM_MIX)
    index = F.least(F.floor(F.greatest(rate, F.lit(0.0))), F.lit(len(k.RHYTHM_MIX) - 1)).cast("int")
    return F.get(F.expr(f"array({values})"), index)


def subdivision_quota(rate: Column, wanted: Column) -> Column:
    """K03 - how many notes go on quarters, eighths and sixteenths, as a struct."""
    parts = [_mix(rate, i) for i in range(3)]
    total = parts[0] + parts[1] + parts[2]
    quarters = (wanted * parts[0] / total).cast("int")
    eighths = (wanted * parts[1] / total).cast("int")
    return F.struct(
        quarters.alias("quarters"), eighths.alias("eighths"), (wanted - quarters - eighths).alias("sixteenths")
    )


def note_budget(rate: Column, density: Column, seconds: Column) -> Column:
    """Notes a chart may have: at least one."""
    return F.greatest((rate * density * seconds).cast("int"), F.lit(1))


def jack_gap(style: Column, fastest_bpm: Column) -> Column:
    """Slots two notes must be apart at the fastest tempo; the keyboard has no such limit."""
    slot = F.lit(60.0) / fastest_bpm / F.lit(float(k.SLOTS_PER_BEAT))
    close = F.greatest(F.bround(F.lit(k.FAST_JACK) / F.greatest(slot, F.lit(1e-6))).cast("int"), F.lit(1))
    return F.when(style == "keyboard", F.lit(0)).otherwise(close)


UNKNOWN = -1


def _spaced_piece(piece: pd.DataFrame) -> np.ndarray:
    """Greedy choice by score within one piece: 1 taken, 0 crowded out, -1 not decidable here.

    A slot is undecided while a better undecided slot, or the unseen part beyond the piece, is close
    enough to crowd it out.
    """
    slots = piece["slot"].to_numpy()
    fixed = piece["taken"].to_numpy()
    gap = int(piece["gap"].iloc[0])
    open_left = slots - piece["low"].to_numpy() < gap
    open_right = piece["high"].to_numpy() - slots < gap
    state = np.where(fixed, 1, 2)
    order = np.lexsort((slots, -piece["score"].to_numpy()))
    for i in order:
        if fixed[i]:
            continue
        left = np.searchsorted(slots, slots[i] - gap, side="right")
        right = np.searchsorted(slots, slots[i] + gap, side="left")
        near = state[left:right]
        if (near == 1).any():
            state[i] = 0
        elif (near == UNKNOWN).any() or open_left[i] or open_right[i]:
            state[i] = UNKNOWN
        else:
            state[i] = 1
    return state


def spaced(
    scores: DataFrame, keys: Sequence[str], *, piece: int = 8192, halo: int = 512
) -> DataFrame:
    """Greedy spacing: take slots by descending score unless one within ``gap`` is taken.

    Input columns are the keys, ``slot``, ``score``, ``taken`` (chosen beforehand) and ``gap``.
    Whether a slot is taken only depends on better slots nearby, so a song is cut into pieces with a
    margin on both sides and every piece is decided on its own. Slots whose chain of better
    neighbours runs past the margin come back undecided and are settled again with a wider margin,
    until none is left; nothing is dropped or capped. Adds ``state``: 1 taken, 0 crowded out.
    """
    decided = None
    pending = None
    schema = ", ".join(
        [f"`{c}` {t}" for c, t in scores.select(*keys).dtypes]
        + ["slot bigint", "score double", "taken boolean", "gap int", "state int"]
    )
    base = scores.select(
        *keys,
        F.col("slot").cast("bigint").alias("slot"),
        F.col("score").cast("double").alias("score"),
        F.col("taken").cast("boolean").alias("taken"),
        F.col("gap").cast("int").alias("gap"),
    )
    while True:
        own = F.floor(F.col("slot") / piece)
        first = F.floor((F.col("slot") - halo) / piece)
        last = F.floor((F.col("slot") + halo) / piece)
        copied = base.withColumn("__piece", F.explode(F.sequence(first, last))).withColumns(
            {
                "low": F.col("__piece") * piece - halo,
                "high": (F.col("__piece") + 1) * piece + halo - 1,
                "__own": F.col("__piece") == own,
            }
        )
        if pending is not None:
            wanted = pending.select(*keys, F.floor(F.col("slot") / piece).alias("__piece")).distinct()
            copied = copied.join(wanted, [*keys, "__piece"], "left_semi")

        def decide(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("slot", kind="stable")
            part["state"] = _spaced_piece(part)
            return part.loc[part["__own"], [*keys, "slot", "score", "taken", "gap", "state"]]

        found = copied.groupBy(*keys, "__piece").applyInPandas(decide, schema)
        if pending is not None:
            found = found.join(pending.select(*keys, "slot"), [*keys, "slot"], "left_semi").select(
                *found.columns
            )
        found = settle(found)
        known = found.where(F.col("state") != UNKNOWN)
        decided = known if decided is None else decided.unionByName(known)
        pending = found.where(F.col("state") == UNKNOWN)
        if pending.isEmpty():
            return decided
        halo *= 4


def ranked(
    scores: DataFrame, keys: Sequence[str], *, score: str = "score", slot: str = "slot", segment: float | None = None
) -> DataFrame:
    """Add the 1-based rank of each slot by descending score, without gathering a song."""
    cut = None if segment is None else F.floor(-F.col(score) / F.lit(float(segment)))
    down = scores.withColumn("__down", -F.col(score))
    return scan(down, keys, ["__down", slot], cut, running={"rank": F.lit(1)}).drop("__down")


def fill(
    candidates: DataFrame,
    keys: Sequence[str],
    want: DataFrame,
    *,
    segment: float | None = None,
    spacing: bool = True,
    piece: int = 8192,
    halo: int = 512,
) -> DataFrame:
    """The best ``want`` free slots of each song that keep their distance: ``(keys, slot)``.

    ``candidates`` are the free slots of one family together with everything already taken; the
    greedy rule only looks at better slots, so choosing all that could be taken and then ranking them
    gives the same notes as stopping early.
    """
    if spacing:
        free = spaced(candidates, keys, piece=piece, halo=halo).where("state = 1 and not taken")
    else:
        free = candidates.where(~F.col("taken"))
    order = ranked(free, keys, segment=segment)
    return order.join(want, list(keys)).where(F.col("rank") <= F.col("want")).select(*keys, "slot")


def _marked(playable: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Playable and taken slots together, one row each, with whether they are taken."""
    free = playable.select(*keys, F.col("slot").cast("bigint").alias("slot"), F.col("score").cast("double").alias("score"), F.lit(False).alias("taken"))
    fixed = taken.select(*keys, F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("taken"))
    both = free.unionByName(fixed).groupBy(*keys, "slot")
    return both.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), F.max("taken").alias("taken"))


def select_slots(
    scores: DataFrame,
    songs: DataFrame,
    keys: Sequence[str],
    *,
    seeds: DataFrame | None = None,
    segment: float | None = None,
    piece: int = 8192,
    halo: int = 512,
) -> DataFrame:
    """K04 - slots of a chart: seeds, then quarters, then eighths, then whatever is left.

    ``scores`` are the playable slots; ``songs`` carry ``wanted``, ``rate`` and ``gap``. Each family
    has its quota and notes of one song stay ``gap`` slots apart.
    """
    taken = (
        seeds.select(*keys, "slot")
        if seeds is not None
        else scores.select(*keys, "slot").where(F.lit(False))
    )
    quota = subdivision_quota(F.col("rate"), F.col("wanted"))
    budgets = songs.select(*keys, "wanted", "gap", quota.alias("q"))
    playable = scores.where(F.col("score").isNotNull()).select(*keys, "slot", "score")
    families = (
        (F.pmod("slot", F.lit(12)) == 0, F.col("q.quarters")),
        (F.pmod("slot", F.lit(6)) == 0, F.col("q.eighths")),
        (F.lit(True), F.col("wanted")),
    )
    for member, share in families:
        counts = taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("__have"))
        want = budgets.join(counts, list(keys), "left").select(
            *keys, "gap", F.least(share, F.col("wanted") - F.coalesce("__have", F.lit(0))).alias("want")
        )
        marked = _marked(playable, taken, keys)
        candidates = (
            marked.where(member | F.col("taken"))
            .join(want.select(*keys, "gap"), list(keys))
            .select(*keys, "slot", "score", "taken", "gap")
        )
        more = fill(candidates, keys, want.select(*keys, "want"), segment=segment, piece=piece, halo=halo)
        taken = settle(taken.unionByName(more.select(*keys, F.col("slot").cast(dict(taken.dtypes)["slot"]).alias("slot"))))
    return taken


def thin_measures(
    chosen: DataFrame, keys: Sequence[str], *, slot: str = "slot", per_measure: int = k.SLOTS_PER_MEASURE
) -> DataFrame:
    """K05 - measures to empty: well under the upper median, emptiest first, a tenth of the span at most."""
    counts = chosen.groupBy(*keys, F.floor(F.col(slot) / per_measure).alias("measure")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    facts = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__m"), (F.max("measure") + 1).alias("__span")
    )
    # Upper median: the value at place m // 2 of the ascending counts.
    by_count = counts.groupBy(*keys, "__n").agg(F.count(F.lit(1)).alias("__w"))
    stepped = scan(by_count, keys, ["__n"], None, running={"__upto": F.col("__w")}).join(facts, list(keys))
    at = F.floor(F.col("__m") / 2)
    upper = stepped.where((F.col("__upto") - F.col("__w") <= at) & (at < F.col("__upto"))).select(
        *keys, F.col("__n").alias("__median"), "__span"
    )
    low = counts.join(upper, list(keys)).where(F.col("__n") < F.col("__median") * F.lit(k.SPARSE_FRACTION))
    order = scan(low, keys, ["__n", "measure"], F.col("__n"), running={"__rank": F.lit(1)})
    most = (F.col("__span") * F.lit(k.MAX_EMPTY_SHARE)).cast("int")
    return order.where(F.col("__rank") <= most).select(*keys, "measure")


def tidy_rests(
    chosen: DataFrame,
    scores: DataFrame,
    songs: DataFrame,
    keys: Sequence[str],
    *,
    per_measure: int = k.SLOTS_PER_MEASURE,
    segment: float | None = None,
    piece: int = 8192,
    halo: int = 512,
) -> DataFrame:
    """K05 - empty the thin measures but for their downbeat and place the freed notes elsewhere."""
    measure = F.floor(F.col("slot") / per_measure).alias("measure")
    thin = settle(thin_measures(chosen, keys, per_measure=per_measure))
    located = chosen.select(*keys, "slot", measure)
    kept = located.join(thin, [*keys, "measure"], "left_anti").select(*keys, "slot")
    playable = scores.where(F.col("score").isNotNull())
    downbeats = thin.select(*keys, (F.col("measure") * per_measure).alias("slot")).join(
        playable.select(*keys, "slot"), [*keys, "slot"], "left_semi"
    )
    taken = kept.unionByName(downbeats.select(*keys, "slot"))
    before = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__before"))
    now = taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("__now"))
    want = before.join(now, list(keys), "left").select(
        *keys, (F.col("__before") - F.coalesce("__now", F.lit(0))).alias("want")
    )
    outside = playable.select(*keys, "slot", "score", measure).join(
        thin, [*keys, "measure"], "left_anti"
    )
    candidates = (
        _marked(outside.drop("measure"), taken, keys)
        .join(songs.select(*keys, "gap"), list(keys))
        .select(*keys, "slot", "score", "taken", "gap")
    )
    more = fill(candidates, keys, want, segment=segment, piece=piece, halo=halo)
    return taken.unionByName(more.select(*keys, F.col("slot").cast(dict(taken.dtypes)["slot"]).alias("slot")))


def choose_slots(
    scores: DataFrame,
    loudness: DataFrame,
    songs: DataFrame,
    keys: Sequence[str],
    *,
    triplets: bool = False,
    tidy: bool = True,
    per_measure: int = k.SLOTS_PER_MEASURE,
    segment: float | None = None,
    piece: int = 8192,
    halo: int = 512,
) -> DataFrame:
    """K04 and K05 - the whole choice for a corpus: ``(keys, slot)``.

    Scores are kept where the grid has slots and where there is sound; each song is seeded with the pulse of its measures,
    filled up to its budget family by family, and rid of thin measures. ``songs`` carry ``slot_count``, ``wanted``, ``rate``
    and ``gap``, one row each; a song without a usable slot has none in the result.
    """
    heard = settle(audible(on_grid(scores, triplets=triplets), loudness, keys))
    seeds = settle(seed_pulse(heard, songs, keys, per_measure=per_measure, segment=segment).select(*keys, "slot"))
    chosen = select_slots(heard, songs, keys, seeds=seeds, segment=segment, piece=piece, halo=halo)
    if not tidy:
        return chosen
    return tidy_rests(chosen, heard, songs, keys, per_measure=per_measure, segment=segment, piece=piece, halo=halo)


def preview_start(
    measures: DataFrame, keys: Sequence[str], *, measure: str = "measure", score: str = "score"
) -> DataFrame:
    """K06 - measure a preview starts on: the best, kept within 10 and 65 percent of the song.

    Songs under four measures start at 0. The second it falls on is a look-up in the timing map.
    """
    best = measures.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max_by(measure, F.struct(F.col(score), -F.col(measure))).alias("__m"),
    )
    low = (F.col("__n") * F.lit(0.10)).cast("int")
    high = F.greatest((F.col("__n") * F.lit(0.65)).cast("int"), low)
    start = F.when(F.col("__n") < 4, F.lit(0)).otherwise(F.least(F.greatest("__m", low), high))
    return best.select(*keys, start.cast("bigint").alias("measure"), (start * 4.0).alias("beat"))


__all__ = [
    "audible",
    "choose_slots",
    "exact_quantiles",
    "fill",
    "jack_gap",
    "note_budget",
    "on_grid",
    "preview_start",
    "seed_pulse",
    "select_slots",
    "settle",
    "silence_threshold",
    "spaced",
    "subdivision_quota",
    "thin_measures",
    "tidy_rests",
]
