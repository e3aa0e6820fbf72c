"""Periodicity of time series: folding, tempo, phase and drift.

``frames`` hold keys, an integer ``frame`` and a ``value``; frames of a key are dense. Folding is a
plain aggregation, so a hot key is combined before it is shuffled; arrays only ever hold the bins of
one period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import (
    drawn,
    bar_seconds,
    circular_parabola,
    offset_for_phase,
    phase_of_offset,
    snap_bpm,
    tempo_candidates,
    tempo_prior,
)
from tactus.operators.ordered import KEY, SEGMENT, scan, settle, spread

TWO_PI = 6.283185307179586


def _cut(column: str, segment: float | None) -> Column | None:
    return None if segment is None else F.floor(F.col(column) / F.lit(float(segment)))


def onset_flux(
    frames: DataFrame, keys: Sequence[str], *, frame: str = "frame", bands: str = "bands", segment: float | None = None
) -> DataFrame:
    """W11 - rise of each band since the frame before, median over the bands; 0 on the first."""
    linked = scan(frames, keys, [frame], _cut(frame, segment), lag={"__before": F.col(bands)})
    rise = F.array_sort(
        F.zip_with(bands, "__before", lambda a, b: F.greatest((a - b).cast("double"), F.lit(0.0)))
    )
    n = F.size("__before")
    upper = F.get("__rise", F.floor(n / 2).cast("int"))
    lower = F.get("__rise", F.floor((n - 1) / 2).cast("int"))
    flux = F.when(F.col("__before").isNull(), F.lit(0.0)).otherwise((lower + upper) / F.lit(2.0))
    return linked.withColumn("__rise", rise).select(*keys, frame, flux.alias("flux"))


def scale_bands(frames: DataFrame, keys: Sequence[str], *, value: str = "value") -> DataFrame:
    """W12 - divide each band (part of ``keys``) by its own maximum."""
    peaks = frames.groupBy(*keys).agg(F.greatest(F.max(value), F.lit(1e-6)).alias("__peak"))
    return (
        frames.join(peaks, list(keys)).withColumn(value, F.col(value) / F.col("__peak")).drop("__peak")
    )


def fold_bin(seconds: Column, period: Column, bins: int) -> Column:
    """Bin of a time within its period."""
    place = F.floor(F.pmod(seconds, period) / period * F.lit(float(bins)))
    return F.pmod(place, F.lit(bins)).cast("int")


def fold_profile(
    frames: DataFrame,
    keys: Sequence[str],
    period: Column,
    *,
    fps: float = k.FRAME_RATE,
    start: float = 0.0,
    bins: int = k.PHASE_BINS,
    frame: str = "frame",
    value: str = "value",
) -> DataFrame:
    """A12 - mean of every bin of a bar, centred and scaled to at most 1 in size.

    ``period`` is a column of the frames. Bins nothing fell into count as 0.
    """
    seconds = F.col(frame) / F.lit(float(fps)) - F.lit(float(start))
    folded = frames.groupBy(*keys, fold_bin(seconds, period, bins).alias("bin")).agg(
        F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__n")
    )
    means = folded.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct("bin", (F.col("__s") / F.col("__n")).alias("m")))
        ).alias("__m")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.coalesce(F.try_element_at("__m", b), F.lit(0.0)),
    )
    total = F.aggregate("__d", F.lit(0.0), lambda a, x: a + x)
    centred = F.transform("__d", lambda x: x - F.col("__mean"))
    peak = F.greatest(F.array_max(F.transform("__c", F.abs)), F.lit(1e-6))
    return (
        means.withColumn("__d", dense)
        .withColumn("__mean", total / F.lit(float(bins)))
        .withColumn("__c", centred)
        .withColumn("__peak", peak)
        .select(*keys, F.posexplode("__c").alias("bin", "__v"), "__peak")
        .select(*keys, "bin", (F.col("__v") / F.col("__peak")).alias("profile"))
    )


def tempi(low: float = 60.0, high: float = 300.0, step: float = 1.002) -> Column:
    """Array of candidate tempi of a scan."""
    count = tempo_candidates(low, high, step)
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(low) * F.pow(F.lit(step), i)
    )


def fold_scores(
    frames: DataFrame,
    keys: Sequence[str],
    candidates: Column,
    *,
    fps: float = k.FRAME_RATE,
    bins: int = k.FOLD_BINS,
    frame: str = "frame",
    value: str = "value",
) -> DataFrame:
    """A13 - for every candidate tempo, the highest mean of any bin of its beat.

    Each frame meets the fixed list of candidates; sums per bin are combined before the shuffle, so
    what is shuffled per key is candidates times bins however long the series is.
    """
    spun = frames.select(*keys, frame, value, F.posexplode(candidates).alias("candidate", "bpm"))
    turn = F.col(frame) * (F.col("bpm") / F.lit(60.0 * fps))
    part = (F.pmod(turn, F.lit(1.0)) * F.lit(float(bins))).cast("int")
    means = spun.groupBy(*keys, "candidate", "bpm", part.alias("bin")).agg(F.avg(value).alias("__m"))
    return means.groupBy(*keys, "candidate", "bpm").agg(
        F.greatest(F.max("__m"), F.lit(0.0)).alias("score")
    )


def best_candidate(
    scores: DataFrame, keys: Sequence[str], *, score: str = "score", item: str = "bpm", rank: str = "candidate"
) -> DataFrame:
    """K07 - best item of each key and how far ahead of the second it is; the earliest wins a tie."""
    top = F.slice(F.sort_array(F.collect_list(score), asc=False), 1, 2)
    found = scores.groupBy(*keys).agg(
        F.max_by(item, F.struct(F.col(score), -F.col(rank))).alias(item), top.alias("__top")
    )
    first, second = F.get("__top", F.lit(0)), F.get("__top", F.lit(1))
    ahead = F.when(second > 0, first / second).otherwise(F.lit(0.0))
    return found.select(
        *keys,
        F.when(first > 0, F.col(item)).otherwise(F.lit(0.0)).alias(item),
        F.when(first > 0, ahead).otherwise(F.lit(0.0)).alias("confidence"),
    )


def lengths(frames: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """Number of frames of each key."""
    return frames.groupBy(*keys).agg((F.max(frame) + 1).alias("frame_count"))


def coarse_tempo(
    frames: DataFrame,
    keys: Sequence[str],
    *,
    fps: float = k.FRAME_RATE,
    low: float = 60.0,
    high: float = 300.0,
    step: float = 1.002,
    excerpt: float = k.EXCERPT_SECONDS,
    frame: str = "frame",
    value: str = "value",
) -> DataFrame:
    """E01 - tempo scan over the middle excerpt of each series, weighed by the tempo prior."""
    span = int(excerpt * fps)
    n = F.col("frame_count")
    start = F.greatest(F.floor((n - span) / 2), F.lit(0))
    cut = (
        frames.join(lengths(frames, keys, frame), list(keys))
        .where((n <= span) | ((F.col(frame) >= start) & (F.col(frame) < start + span)))
        .withColumn(frame, F.when(n > span, F.col(frame) - start).otherwise(F.col(frame)))
    )
    scores = fold_scores(cut, keys, tempi(low, high, step), fps=fps, frame=frame, value=value)
    weighed = scores.withColumn("score", F.col("score") * tempo_prior(F.col("bpm")))
    return best_candidate(weighed, keys)


def phase_totals(
    frames: DataFrame,
    tried: DataFrame,
    keys: Sequence[str],
    *,
    fps: float = k.FRAME_RATE,
    frame: str = "frame",
    value: str = "value",
    segment: float | None = None,
) -> DataFrame:
    """Mean of the interpolated series along a beat grid, for every phase of every candidate tempo.

    ``tried`` lists ``(keys, candidate, bpm)``. Grid points of all beats and phases of a candidate
    form one even grid, so each frame works out which points fall between it and the next frame and
    what they interpolate to; the rest is an aggregation.
    """
    listed = tried.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("candidate", "bpm"))).alias("__tried")
    )
    ahead = scan(
        frames.select(*keys, frame, value), keys, [frame], _cut(frame, segment), lead={"__next": F.col(value)}
    )
    n = F.col("frame_count")
    spun = (
        ahead.join(lengths(frames, keys, frame).join(listed, list(keys)), list(keys))
        .select("*", F.explode("__tried").alias("__c"))
        .select(*keys, frame, value, "__next", "frame_count", "__c.candidate", "__c.bpm")
    )
    period = F.lit(60.0) / F.col("bpm")
    length = n / F.lit(float(fps))
    steps = F.greatest((period * F.lit(fps * 8.0)).cast("int"), F.lit(32))
    spaced = spun.withColumns(
        {"__steps": steps, "__beats": F.floor(length / period), "__d": period / steps * F.lit(float(fps))}
    ).where(length > period)
    low = F.ceil(F.col(frame) / F.col("__d"))
    high = F.least(
        F.ceil((F.col(frame) + 1) / F.col("__d")) - 1, F.col("__beats") * F.col("__steps") - 1
    )
    points = spaced.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("__m"))
    share = F.col("__m") * F.col("__d") - F.col(frame)
    level = F.col(value) + share * (F.col("__next") - F.col(value))
    # Past the last frame the series is 0.
    sample = F.when(F.col("__next").isNotNull(), level).when(share <= 0, F.col(value)).otherwise(0.0)
    return points.groupBy(
        *keys, "candidate", "bpm", "__steps", "__beats", F.pmod("__m", "__steps").alias("phase")
    ).agg(F.sum(sample).alias("__s")).select(
        *keys,
        "candidate",
        "bpm",
        F.col("__steps").alias("steps"),
        "phase",
        (F.col("__s") / F.col("__beats")).alias("total"),
    )


def alignment(frames: DataFrame, tried: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """How well the best phase of each candidate tempo lines up with the series."""
    totals = phase_totals(frames, tried, keys, **options)
    best = totals.groupBy(*keys, "candidate", "bpm").agg(F.max("total").alias("__a"))
    return tried.join(best.drop("bpm"), [*keys, "candidate"], "left").select(
        *keys, "candidate", "bpm", F.coalesce("__a", F.lit(0.0)).alias("alignment")
    )


def refine_tempo(
    frames: DataFrame,
    coarse: DataFrame,
    keys: Sequence[str],
    *,
    span: float = 0.003,
    fine: Sequence[int] = (61, 21),
    **options,
) -> DataFrame:
    """E02 - tempo of ``coarse`` refined over the whole series, each pass searching finer."""
    found, width = coarse.select(*keys, "bpm"), span
    for steps in fine:
        step = 2.0 * width / (steps - 1)
        ladder = F.transform(
            F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.lit(1.0 - width) + i * F.lit(step)
        )
        tried = found.select(*keys, F.col("bpm").alias("__b"), F.posexplode(ladder).alias("candidate", "__f")).select(
            *keys, "candidate", (F.col("__b") * F.col("__f")).alias("bpm")
        )
        scored = alignment(frames, settle(tried), keys, **options)
        found = scored.groupBy(*keys).agg(
            F.max_by("bpm", F.struct(F.col("alignment"), -F.col("candidate"))).alias("bpm")
        )
        width = step
    return found


def snap_if_fits(
    frames: DataFrame, refined: DataFrame, keys: Sequence[str], *, slack: float = 0.25, **options
) -> DataFrame:
    """E03 - the nearest half beat per minute, kept when it aligns nearly as well."""
    pair = F.array(
        F.struct(F.lit(0).alias("candidate"), F.col("bpm").alias("b")),
        F.struct(F.lit(1).alias("candidate"), snap_bpm(F.col("bpm")).alias("b")),
    )
    tried = refined.select(*keys, F.explode(pair).alias("p")).select(
        *keys, "p.candidate", F.col("p.b").alias("bpm")
    )
    scored = alignment(frames, tried, keys, **options)

    def of(candidate: int, column: str) -> Column:
        return F.max(F.when(F.col("candidate") == candidate, F.col(column)))

    sides = scored.groupBy(*keys).agg(
        of(0, "bpm").alias("__b"), of(1, "bpm").alias("__r"),
        of(0, "alignment").alias("__ab"), of(1, "alignment").alias("__ar"),
    )
    fits = F.col("__ar") >= F.col("__ab") * F.lit(1.0 - slack)
    return sides.select(*keys, F.when(fits, F.col("__r")).otherwise(F.col("__b")).alias("bpm"))


def estimate_phase(
    frames: DataFrame, tempo: DataFrame, keys: Sequence[str], *, latency: float = k.ONSET_LATENCY, **options
) -> DataFrame:
    """E04 - time of the strongest phase of a known tempo, to a fraction of a step."""
    tried = tempo.select(*keys, F.lit(0).alias("candidate"), "bpm")
    totals = phase_totals(frames, tried, keys, **options)
    listed = totals.groupBy(*keys, "bpm", "steps").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("phase", "total"))), lambda s: s["total"]).alias("__t"),
        F.max_by("phase", F.struct(F.col("total"), -F.col("phase"))).alias("__p"),
    )
    n, p = F.col("steps"), F.col("__p")

    def total(place: Column) -> Column:
        return F.get("__t", F.pmod(place, n).cast("int"))

    shift = circular_parabola(total(p - 1), total(p), total(p + 1))
    period = F.lit(60.0) / F.col("bpm")
    phase = listed.select(
        *keys, "bpm", (F.pmod((p + shift) * period / n, period) - F.lit(latency)).alias("downbeat")
    )
    # A series no longer than a beat has no phase to find.
    known = tempo.select(*keys, "bpm").join(phase.drop("bpm"), list(keys), "left")
    return known.select(
        *keys, "bpm", (-F.coalesce("downbeat", F.lit(-latency))).alias("offset")
    )


def estimate_timing(
    frames: DataFrame,
    keys: Sequence[str],
    *,
    phase_frames: DataFrame | None = None,
    fps: float = k.FRAME_RATE,
    low: float = 60.0,
    high: float = 300.0,
    step: float = 1.002,
    excerpt: float = k.EXCERPT_SECONDS,
    fine: Sequence[int] = (61, 21),
    least: int = 64,
    segment: float | None = None,
) -> DataFrame:
    """E01-E04 - tempo, confidence and offset of every series.

    Series shorter than ``least`` frames or without any positive value come back with zeros.
    """
    facts = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.max("value").alias("__top")
    )
    good = facts.where((F.col("__n") >= least) & (F.col("__top") > 0)).select(*keys)
    usable = frames.join(good, list(keys), "left_semi")
    options = {"fps": fps, "segment": segment}
    # Each stage leaves one row per key and feeds several branches of the next, so it is settled.
    scanned = coarse_tempo(usable, keys, fps=fps, low=low, high=high, step=step, excerpt=excerpt)
    coarse = settle(scanned.where(F.col("bpm") > 0))
    refined = settle(refine_tempo(usable, coarse, keys, fine=fine, **options))
    snapped = settle(snap_if_fits(usable, refined, keys, **options))
    placed = estimate_phase(usable if phase_frames is None else phase_frames, snapped, keys, **options)
    return (
        facts.select(*keys)
        .join(placed, list(keys), "left")
        .join(coarse.select(*keys, "confidence"), list(keys), "left")
        .na.fill(0.0, ["bpm", "offset", "confidence"])
    )


def _bin_array(pairs: DataFrame, keys: Sequence[str], bins: int, value: str) -> DataFrame:
    """The bins of each key as one dense array."""
    entries = pairs.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", value))).alias("__m")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.coalesce(F.try_element_at("__m", b), F.lit(0.0)),
    )
    return entries.select(*keys, dense.alias("bins"))


def _first_peak(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def kick_phase(
    frames: DataFrame,
    keys: Sequence[str],
    bpm: str = "bpm",
    *,
    fps: float = k.FRAME_RATE,
    bins: int = k.PHASE_BINS,
    lag: float = k.KICK_LAG,
    frame: str = "frame",
    value: str = "value",
) -> DataFrame:
    """E05 - where in the beat the kick falls and how far its peak stands out.

    ``bpm`` is a column of the frames, constant per key.
    """
    period = F.lit(60.0) / F.col(bpm)
    folded = frames.groupBy(
        *keys, bpm, fold_bin(F.col(frame) / F.lit(float(fps)), period, bins).alias("bin")
    ).agg(F.avg(value).alias("mean"))
    arrays = _bin_array(folded, [*keys, bpm], bins, "mean").withColumn("__p", _first_peak(F.col("bins")))
    p = F.col("__p")

    def at(place: Column) -> Column:
        return F.get("bins", F.pmod(place, F.lit(bins)).cast("int"))

    shift = circular_parabola(at(p - 1), at(p), at(p + 1))
    ordered = F.array_sort("bins")
    middle = (F.get(ordered, F.lit((bins - 1) // 2)) + F.get(ordered, F.lit(bins // 2))) / F.lit(2.0)
    seconds = F.pmod((p + F.lit(0.5) + shift) / F.lit(float(bins)) * period - F.lit(lag), period)
    return arrays.select(
        *keys,
        bpm,
        seconds.alias("seconds"),
        (at(p) / F.greatest(middle, F.lit(1e-9))).alias("clarity"),
    )


def mass_near(values: Column, centre: Column, reach: int, bins: int) -> Column:
    """Sum of the bins at most ``reach`` away from a centre, the short way round."""
    terms = [
        F.get(values, F.pmod(centre + d, F.lit(bins)).cast("int")) for d in range(-reach, reach + 1)
    ]
    return sum(terms[1:], terms[0])


def _pooled(values: Column, bins: int, beats: int = k.BEATS_PER_MEASURE) -> Column:
    per_beat = bins // beats
    return F.transform(
        F.sequence(F.lit(0), F.lit(per_beat - 1)),
        lambda i: sum(
            (F.get(values, i + b * per_beat) for b in range(1, beats)), F.get(values, i)
        ),
    )


def rivalry(values: Column, phase: Column, bins: int = k.PHASE_BINS) -> Column:
    """A20 - mass half a beat away from a phase over the mass at it, all beats taken together."""
    per_beat = bins // k.BEATS_PER_MEASURE
    pooled = _pooled(values, bins)
    here = F.pmod(phase, F.lit(per_beat))
    away = mass_near(pooled, here + per_beat // 2, 2, per_beat)
    return away / F.greatest(mass_near(pooled, here, 2, per_beat), F.lit(1e-9))


def half_beat_rivalry(weights: DataFrame, keys: Sequence[str], phase: str = "phase", *, bins: int = k.PHASE_BINS) -> DataFrame:
    """A20 - rivalry of each key from a ``(keys, phase, bin, weight)`` table."""
    arrays = _bin_array(weights, [*keys, phase], bins, "weight")
    return arrays.select(*keys, phase, rivalry(F.col("bins"), F.col(phase), bins).alias("rivalry"))


def refine_offset(
    kicks: DataFrame, weights: DataFrame, keys: Sequence[str], *, bpm: str = "bpm", bins: int = k.PHASE_BINS
) -> DataFrame:
    """E06 - offset from the kick when it is clear, else from the bar weights alone.

    ``weights`` is ``(keys, bin, weight)`` from any model. The kick places the beat and the weights
    choose which beat of the bar is the first. A kick is overruled when it hardly stands out, or
    does not stand out clearly while the weights favour the half beat.
    """
    per_beat = bins // k.BEATS_PER_MEASURE
    both = kicks.join(_bin_array(weights, keys, bins, "weight"), list(keys))
    w, period = F.col("bins"), F.lit(60.0) / F.col(bpm)
    phase = _first_peak(w)
    kick_bin = F.pmod((F.col("seconds") / period * F.lit(float(per_beat))).cast("int"), F.lit(per_beat))
    placed = both.withColumns({"__phase": phase, "__kick": kick_bin})
    kick = F.col("__kick")
    masses = F.array(
        *[mass_near(w, kick + b * per_beat, per_beat // 2 - 1, bins) for b in range(k.BEATS_PER_MEASURE)]
    )
    beat = _first_peak(masses)
    clear = F.col("clarity")
    overruled = (clear < k.KICK_CLARITY) & (
        (rivalry(w, kick, bins) > 1.0) | (clear < k.NO_KICK_CLARITY)
    )
    offset = F.when(overruled, offset_for_phase(F.col("__phase"), F.col(bpm), bins)).otherwise(
        -(F.col("seconds") + beat * period)
    )
    at = F.when(overruled, F.col("__phase")).otherwise(F.pmod(kick + beat * per_beat, F.lit(bins)))
    return placed.select(
        *keys,
        offset.alias("offset"),
        F.when(overruled, F.lit("model")).otherwise(F.lit("kick")).alias("source"),
        clear.alias("clarity"),
        F.get(w, at.cast("int")).alias("weight"),
    )


def excerpt_profiles(
    frames: DataFrame,
    keys: Sequence[str],
    song: Sequence[str],
    period: Column,
    *,
    fps: float = k.FRAME_RATE,
    excerpt: float = k.EXCERPT_SECONDS,
    bins: int = k.PHASE_BINS,
    frame: str = "frame",
) -> DataFrame:
    """E07 - the profile of each consecutive excerpt; a short last one is left out.

    Times stay counted from the start of the song, so all excerpts of a song share their phase.
    """
    span = max(int(excerpt * fps), 1)
    n = F.col("frame_count")
    piece = F.floor(F.col(frame) / span)
    cut = (
        frames.join(lengths(frames, song, frame), list(song))
        .withColumn("excerpt", piece)
        .where(F.col("excerpt") * span < F.greatest(n - span, F.lit(1)))
        .drop("frame_count")
    )
    return fold_profile(cut, [*keys, "excerpt"], period, fps=fps, bins=bins, frame=frame)


def predict_phase(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E07 - phase with the highest weight averaged over the excerpts, and that weight."""
    means = weights.groupBy(*keys, "bin").agg(F.avg("weight").alias("weight"))
    return means.groupBy(*keys).agg(
        F.max_by("bin", F.struct(F.col("weight"), -F.col("bin"))).alias("phase"),
        F.max("weight").alias("weight"),
    )


def _windows(
    frames: DataFrame,
    keys: Sequence[str],
    period: Column,
    fps: float,
    window: float,
    hop: float,
    frame: str,
    value: str,
    segment: float | None,
) -> DataFrame:
    """Mean direction of every window of a track: ``(key, segment, __w, __top, __period, __raw)``.

    Frames are gathered by hop, at most ``hop * fps`` of a key, and a window reads the next few of
    these lists; its mean has to be known before a frame has a weight. ``__raw`` is null where a window
    is too short or flat.
    """
    rate, reach = F.lit(float(fps)), max(int(-(-window // hop)), 1)

    def opens(place: Column) -> Column:
        return (place * F.lit(float(hop)) * rate).cast("bigint")

    f = F.col(frame)
    near = F.floor(f / rate / F.lit(float(hop)))
    place = near + F.when(f >= opens(near + 1), 1).when(f < opens(near), -1).otherwise(0)
    lists = (
        frames.select(F.struct(*keys).alias(KEY), place.alias("__w"), period.alias("__period"), f.alias("f"), F.col(value).cast("double").alias("v"))
        .groupBy(KEY, "__w")
        .agg(
            F.collect_list(F.struct("f", "v")).alias("__list"),
            F.max("f").alias("__top"),
            F.max("__period").alias("__period"),
        )
    )
    width = None if segment is None else float(max(int(segment / hop), reach + 1))
    placed = spread(lists, F.col("__w"), width, ahead=float(reach))
    w = Window.partitionBy(KEY, SEGMENT).orderBy("__w").rangeBetween(0, reach - 1)
    start = F.col("__w") * F.lit(float(hop))
    closes = ((start + F.lit(window)) * rate).cast("bigint")
    met = placed.withColumn("__list", F.flatten(F.collect_list("__list").over(w))).where(~F.col("ghost"))
    met = met.withColumn("__list", F.filter("__list", lambda x: x["f"] < closes))
    there = F.filter("__list", lambda x: x["v"].isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x["v"]) / F.nullif(F.size(there), F.lit(0))
    met = met.withColumn("__mean", mean)

    def weighed(x: Column) -> Column:
        above = F.greatest(x["v"] - F.col("__mean"), F.lit(0.0))
        angle = F.lit(TWO_PI) * ((x["f"] - opens(F.col("__w"))) / rate + start) / F.col("__period")
        return F.struct(above.alias("n"), (above * F.cos(angle)).alias("x"), (above * F.sin(angle)).alias("y"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in "nxy"])
    met = met.withColumn("__few", F.size("__list") < 8).withColumn(
        "__sum",
        F.aggregate(
            F.transform("__list", weighed), zero, lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in "nxy"])
        ),
    )
    turn = F.pmod(F.atan2("__sum.y", "__sum.x") / F.lit(TWO_PI), F.lit(1.0))
    raw = F.when(~F.col("__few") & (F.col("__sum.n") > 0), turn * F.col("__period"))
    return met.select(KEY, SEGMENT, "__w", "__top", "__period", raw.alias("__raw"))


def phase_track(
    frames: DataFrame,
    keys: Sequence[str],
    period: Column,
    *,
    fps: float = k.FRAME_RATE,
    window: float = 12.0,
    hop: float = 2.0,
    frame: str = "frame",
    value: str = "value",
    segment: float | None = None,
) -> DataFrame:
    """W13 - phase of the beat in overlapping windows, unwrapped: ``(keys, centre, phase)``.

    Windows that are too short or flat are dropped, as is a key with fewer than two left. Frames are
    shuffled once, as lists of one hop; after that there is one row per window. ``period`` is constant per key.
    """
    # Both uses of these rows share the exchange.
    windows = _windows(frames, keys, period, fps, window, hop, frame, value, segment).repartition(KEY, SEGMENT)
    raw, half = F.col("__raw"), F.col("__period") / 2

    def fix(before: Column, now: Column) -> Column:
        jump = now - before
        near_jump = F.pmod(jump + half, F.col("__period")) - half
        near_jump = F.when((near_jump == -half) & (jump > 0), half).otherwise(near_jump)
        return F.coalesce(F.when(F.abs(jump) < half, F.lit(0.0)).otherwise(near_jump - jump), F.lit(0.0))

    w = Window.partitionBy(KEY, SEGMENT).orderBy("__w")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("__raw", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = F.when(raw.isNotNull(), F.col("__w"))
    after = F.min(kept).over(w.rowsBetween(1, Window.unboundedFollowing))
    local = windows.withColumns({"__fix": fix(before, raw), "__kept": kept, "__next": after})
    summary = local.groupBy(KEY, SEGMENT).agg(
        F.max("__top").alias("__end"),
        F.max("__period").alias("__period"),
        F.min("__kept").alias("__first"),
        F.min_by("__raw", "__kept").alias("__opens"),
        F.max_by("__raw", "__kept").alias("__closes"),
        F.sum("__fix").alias("__inner"),
    )
    across = Window.partitionBy(KEY).orderBy(SEGMENT)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    entered = fix(F.last("__closes", ignorenulls=True).over(earlier), F.col("__opens"))
    summary = summary.withColumn("__enter", entered)
    carried = summary.select(
        KEY,
        SEGMENT,
        (F.coalesce(F.sum(F.col("__enter") + F.col("__inner")).over(earlier), F.lit(0.0)) + F.col("__enter")).alias("__from"),
        (F.max("__first").over(earlier).isNotNull()).alias("__later"),
        F.min("__first").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("__beyond"),
        (F.max("__end").over(Window.partitionBy(KEY)) + 1).alias("__n"),
    )
    length = F.col("__n") / F.lit(float(fps))
    count = F.ceil(F.greatest(length - F.lit(window), F.lit(hop)) / F.lit(hop))
    numbered = local.join(carried, [KEY, SEGMENT], "left").withColumns(
        {"phase": raw + F.col("__from") + F.sum("__fix").over(upto), "__nth": F.count("__kept").over(upto)}
    )
    paired = F.col("__later") | (F.col("__nth") > 1) | (F.coalesce("__next", "__beyond") < count)
    # The first condition always holds; with it, and a left join, both branches are alike and share the exchange.
    inside = (F.col("__top") < F.col("__n")) & (F.col("__w") < count)
    return numbered.where(raw.isNotNull() & inside & paired).select(
        f"{KEY}.*", (F.col("__w") * F.lit(hop) + F.lit(window / 2.0)).alias("centre"), "phase"
    )


def local_tempo(
    track: DataFrame,
    keys: Sequence[str],
    bpm: Column,
    *,
    span: float = 40.0,
    hop: float = 2.0,
    segment: float | None = None,
) -> DataFrame:
    """W14 - tempo over stretches of consecutive readings: ``(keys, seconds, bpm, slip)``.

    ``bpm`` is a column of the track. The fit is a least-squares slope in a row frame; stretches
    start every quarter span and the very last full one is left out.
    """
    width = max(int(span / hop), 4)
    step = max(int(span / 4.0 / hop), 1)
    cut = F.lit(0) if segment is None else _cut("centre", segment)
    rows = track.select(
        F.struct(*keys).alias(KEY), cut.alias(SEGMENT), "centre", "phase", bpm.alias("__ref")
    ).repartition(KEY, SEGMENT)
    across = Window.partitionBy(KEY).orderBy(SEGMENT)
    sizes = rows.groupBy(KEY, SEGMENT).agg(F.count("*").alias("__size"))
    carried = sizes.select(
        KEY,
        SEGMENT,
        F.coalesce(F.sum("__size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"),
        F.sum("__size").over(Window.partitionBy(KEY)).alias("__count"),
    )
    nth = F.row_number().over(Window.partitionBy(KEY, SEGMENT).orderBy("centre"))
    numbered = rows.join(carried, [KEY, SEGMENT], "left").withColumn("__i", F.col("__from") + nth - 1).drop(SEGMENT)
    piece = None if segment is None else float(max(width * 8, 256))
    placed = spread(numbered, F.col("__i"), piece, ahead=float(width))
    w = Window.partitionBy(KEY, SEGMENT).orderBy("__i").rowsBetween(0, width - 1)
    fitted = placed.withColumns(
        {
            "__slope": F.regr_slope("phase", "centre").over(w),
            "__end": F.last("centre").over(w),
        }
    )
    kept = fitted.where(
        ~F.col("ghost") & (F.col("__i") % step == 0) & (F.col("__i") < F.col("__count") - width)
    )
    covered = F.col("__end") - F.col("centre")
    return kept.select(
        f"{KEY}.*",
        (F.col("centre") + covered / 2).alias("seconds"),
        (F.col("__ref") * (F.lit(1.0) - F.col("__slope"))).alias("bpm"),
        (F.col("__slope") * covered).alias("slip"),
    )


def drift_report(readings: DataFrame, keys: Sequence[str], tolerance: float = 0.020) -> DataFrame:
    """A22 - lowest and highest tempo of each key and the stretches that slip too far."""
    slips = F.abs(F.col("slip")) >= F.lit(tolerance)
    return readings.groupBy(*keys).agg(
        F.min("bpm").alias("min_bpm"),
        F.max("bpm").alias("max_bpm"),
        F.avg("bpm").alias("mean_bpm"),
        F.count(F.lit(1)).alias("stretches"),
        F.sum(slips.cast("bigint")).alias("slipping"),
    )


def phase_excerpts(
    frames: DataFrame,
    songs: DataFrame,
    keys: Sequence[str],
    *,
    per_song: int = 8,
    seed: int = 0,
    fps: float = k.FRAME_RATE,
    excerpt: float = k.EXCERPT_SECONDS,
    bins: int = k.PHASE_BINS,
    validation: bool = False,
    index: str | None = None,
    band: Sequence[str] = (),
    frame: str = "frame",
) -> DataFrame:
    """G05 - folded excerpts with the bin their downbeat falls into.

    ``songs`` carries ``bpm`` and ``offset``. Training excerpts start at seeded places; a held-out
    song gives one excerpt whose start follows from its ``index``. The label does not depend on the
    start.
    """
    span = int(excerpt * fps)
    room = F.greatest(F.col("frame_count") - span, F.lit(1))
    if validation:
        starts = F.array(F.pmod(F.col(index) * 7919, room))
    else:
        starts = F.transform(
            F.sequence(F.lit(1), F.lit(per_song)),
            lambda i: drawn(F.lit(seed), *[F.col(c) for c in keys], i) % room,
        )
    placed = songs.join(lengths(frames, keys, frame), list(keys)).withColumn("__starts", starts)
    inside = F.filter(
        F.transform("__starts", lambda s, i: F.struct(i.alias("excerpt"), s.alias("start"))),
        lambda s: (F.col(frame) >= s["start"]) & (F.col(frame) < s["start"] + span),
    )
    cut = (
        frames.join(placed, list(keys))
        .select("*", F.explode(inside).alias("__e"))
        .withColumn("excerpt", F.col("__e.excerpt"))
    )
    profile = fold_profile(
        cut, [*keys, *band, "excerpt"], bar_seconds(F.col("bpm")), fps=fps, bins=bins, frame=frame
    )
    labels = songs.select(*keys, phase_of_offset(F.col("offset"), F.col("bpm"), bins).alias("label"))
    return profile.join(labels, list(keys))
