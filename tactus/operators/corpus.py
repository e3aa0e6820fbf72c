"""Corpus statistics: vocabulary, priors, rating scales and calibration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import encode_row, log_odds
from tactus.operators.stats import exact_quantiles


def pack_scales(charts: DataFrame, *, pack: str = "pack", meter: str = "meter") -> DataFrame:
    """A04 - rating scale of each pack: 0 up to rating 10, 1 from 13; packs in between are left out."""
    tops = charts.groupBy(pack).agg(F.greatest(F.max(meter), F.lit(0)).alias("__top"))
    return tops.where((F.col("__top") <= 10) | (F.col("__top") >= 13)).select(
        pack, F.when(F.col("__top") >= 13, 1).otherwise(0).alias("scale")
    )


def with_known_scale(charts: DataFrame, scales: DataFrame, *, pack: str = "pack") -> DataFrame:
    """F08 - charts whose pack has a rating scale, with it."""
    return charts.join(scales, pack)


def pattern_counts(targets: DataFrame, codes: str = "codes") -> DataFrame:
    """How often each packed row occurs, the empty row left out."""
    packed = targets.select(encode_row(F.col(codes)).alias("pattern"))
    return packed.where(F.col("pattern") != 0).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def top_k(counts: DataFrame, limit: int, *, by: str = "n", tie: str = "pattern") -> DataFrame:
    """K01 - the most frequent entries; ties in ascending order."""
    return counts.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(limit)


def build_vocabulary(targets: DataFrame, limit: int = 512, codes: str = "codes") -> DataFrame:
    """A05 - the most frequent patterns; their frequency order is their token."""
    kept = top_k(pattern_counts(targets, codes), limit)
    order = Window.orderBy(F.col("n").desc(), F.col("pattern").asc())
    return kept.select((F.row_number().over(order) - 1).alias("token"), "pattern", "n")


def coverage(counts: DataFrame, limit: int) -> DataFrame:
    """A06 - share of rows the ``limit`` most frequent patterns account for; 0 when there are none."""
    kept = top_k(counts, limit).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    both = kept.select(F.col("kept"), F.lit(None).cast("bigint").alias("total")).unionByName(
        whole.select(F.lit(None).cast("bigint").alias("kept"), "total")
    )
    share = F.max("kept") / F.max("total")
    return both.agg(
        F.when(F.max("total") > 0, share).otherwise(F.lit(0.0)).alias("coverage")
    )


def tokenize(rows: DataFrame, vocab: DataFrame, codes: str = "codes") -> DataFrame:
    """J05 - add the token of each row; a pattern the vocabulary does not have gets 0.

    The vocabulary is bounded by its limit, so Spark broadcasts it after checking its size.
    """
    packed = rows.withColumn("pattern", encode_row(F.col(codes)))
    known = vocab.select("pattern", F.col("token").alias("__token"))
    return (
        packed.join(known, "pattern", "left")
        .withColumn("token", F.coalesce("__token", F.lit(0)))
        .drop("__token")
    )


def nearest_scale(scale: Column) -> Column:
    """Rating scale closest to a number; the smaller wins a tie."""
    far = {s: F.abs(scale - s) for s in k.NPS_BY_SCALE}
    return (
        F.when((far[10] <= far[15]) & (far[10] <= far[20]), 10).when(far[15] <= far[20], 15).otherwise(20)
    )


def _table(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")")


def _from_table(values: Sequence[float], meter: Column) -> Column:
    return F.get(_table(values), F.greatest(F.lit(0), F.least(meter, F.lit(len(values) - 1))))


def target_nps(meter: Column, scale: Column) -> Column:
    """Notes per second a rating stands for on its scale."""
    near = nearest_scale(scale)
    return (
        F.when(near == 10, _from_table(k.NPS_10, meter))
        .when(near == 15, _from_table(k.NPS_15, meter))
        .otherwise(_from_table(k.NPS_20, meter))
    )


def target_rate(
    meter: Column, scale: Column, style: Column, explicit: Column | None = None
) -> Column:
    """J06 - note rate to aim for: a given rate wins, keyboard charts have their own table.

    The tables are fixed literals of at most 21 entries, so the look-up is an expression, not a join.
    """
    by_table = F.when(style == "keyboard", _from_table(k.NPS_KEYBOARD, meter)).otherwise(
        target_nps(meter, scale)
    )
    return by_table if explicit is None else F.when(explicit > 0, explicit).otherwise(by_table)


def convert_meter(meter: Column, source: Column, target: Column) -> Column:
    """J07 - rating on another scale whose note rate is nearest; the lowest wins a tie."""
    wanted = target_nps(meter, source)

    def nearest(values: Sequence[float]) -> Column:
        ranked = F.transform(
            F.slice(_table(values), 2, len(values)),
            lambda v, i: F.struct(F.abs(v - wanted).alias("d"), (i + 1).alias("m")),
        )
        return F.array_min(ranked)["m"]

    near = nearest_scale(target)
    return F.when(near == nearest_scale(source), meter).otherwise(
        F.when(near == 10, nearest(k.NPS_10)).when(near == 15, nearest(k.NPS_15)).otherwise(nearest(k.NPS_20))
    )


# Rating a difficulty has on the ten-point scale when none is given.
DEFAULT_METERS = {"Beginner": 2, "Easy": 4, "Medium": 6, "Hard": 9, "Challenge": 12, "Edit": 9}


def default_meter(difficulty: Column, scale: Column) -> Column:
    """Rating of a difficulty on a scale, by way of its note rate."""
    table = F.create_map(*[F.lit(x) for pair in DEFAULT_METERS.items() for x in pair])
    classic = F.coalesce(F.try_element_at(table, difficulty), F.lit(6))
    return convert_meter(classic, F.lit(10), scale)


def note_rate(
    targets: DataFrame, keys: Sequence[str], bpm: Column, *, slot: str = "slot"
) -> DataFrame:
    """A08 - whole notes per second of each chart, at most 15; ``bpm`` is a column of the rows."""
    seen = targets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        (F.max(slot) - F.min(slot)).alias("__span"),
        F.max(bpm).alias("__bpm"),
    )
    seconds = F.col("__span") * F.lit(60.0) / F.col("__bpm") / F.lit(float(k.SLOTS_PER_BEAT))
    usable = (F.col("__n") >= 2) & (F.col("__bpm") > 0) & (F.col("__span") > 0)
    rate = F.when(usable, F.least(F.floor(F.col("__n") / seconds), F.lit(15))).otherwise(F.lit(0))
    return seen.select(*keys, rate.cast("int").alias("rate"))


def metric_prior(
    examples: DataFrame,
    targets: DataFrame,
    songs: DataFrame,
    keys: Sequence[str],
    *,
    difficulty: str = "difficulty",
    slot: str = "slot",
) -> DataFrame:
    """A07 - log odds of a note on each of the 48 positions of a measure.

    ``examples`` names a song and a difficulty; each example counts all rows of its song at that
    difficulty. Targets shrink to 48 counts per song and difficulty before they are joined, and how
    often a position occurs in n slots is arithmetic rather than an exploded grid.
    """
    times = examples.groupBy(*keys, difficulty).agg(F.count(F.lit(1)).alias("__times"))
    position = F.pmod(F.col(slot), F.lit(k.SLOTS_PER_MEASURE)).cast("int")
    rows = targets.groupBy(*keys, difficulty, position.alias("position")).agg(
        F.count(F.lit(1)).alias("__rows")
    )
    counts = rows.join(times, [*keys, difficulty]).select(
        "position", (F.col("__rows") * F.col("__times")).alias("__c"), F.lit(0).alias("__t")
    )
    per_song = examples.groupBy(*keys).agg(F.count(F.lit(1)).alias("__times"))
    n = F.col("slot_count")
    places = F.explode(F.sequence(F.lit(0), F.lit(k.SLOTS_PER_MEASURE - 1))).alias("position")
    whole = F.floor(n / k.SLOTS_PER_MEASURE)
    totals = (
        songs.join(per_song, list(keys))
        .select(places, whole.alias("__w"), (n % k.SLOTS_PER_MEASURE).alias("__r"), "__times")
        .select(
            "position",
            F.lit(0).alias("__c"),
            ((F.col("__w") + (F.col("position") < F.col("__r")).cast("int")) * F.col("__times")).alias("__t"),
        )
    )
    summed = counts.unionByName(totals).groupBy("position").agg(
        F.sum("__c").alias("count"), F.sum("__t").alias("total")
    )
    rate = F.col("count") / F.greatest(F.col("total"), F.lit(1))
    return summed.select("position", "count", "total", log_odds(rate).alias("log_odds"))


def style_weights(examples: DataFrame, by: str = "style") -> DataFrame:
    """A19 - examples with the inverse of how many share their style."""
    counts = examples.groupBy(by).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return examples.join(counts, by)


def rate_calibration(
    charts: DataFrame, by: Sequence[str], *, nps: str = "nps", segment: float | None = 1.0
) -> DataFrame:
    """A23 - median note rate per rating of each scale, and how many charts it rests on."""
    counts = charts.groupBy(*by).agg(F.count(F.lit(1)).alias("charts"))
    medians = exact_quantiles(charts, by, F.col(nps), {"median_nps": 0.5}, segment=segment)
    return medians.join(counts, list(by))


def rhythm_shares(rows: DataFrame, rate: Column, *, slot: str = "slot") -> DataFrame:
    """A23 - percent of rows on quarters, eighths, sixteenths and finer, by whole notes per second."""
    s = F.col(slot)
    family = (
        F.when(s % 12 == 0, "quarter").when(s % 6 == 0, "eighth").when(s % 3 == 0, "sixteenth").otherwise("finer")
    )
    marked = rows.select(F.floor(rate).alias("rate"), family.alias("f"))

    def share(name: str) -> Column:
        return (F.avg((F.col("f") == name).cast("int")) * 100).alias(name)

    return marked.groupBy("rate").agg(
        share("quarter"), share("eighth"), share("sixteenth"), share("finer"), F.count(F.lit(1)).alias("rows")
    )


def event_shares(rows: DataFrame, by: Sequence[str], codes: str = "codes") -> DataFrame:
    """A23 - jumps per row and freezes per note."""
    notes = F.size(F.filter(codes, lambda c: c.isin(*k.STEP_CODES)))
    holds = F.size(F.filter(codes, lambda c: c.isin(*k.HOLD_CODES)))
    return rows.groupBy(*by).agg(
        (F.sum((notes > 1).cast("int")) / F.sum((notes > 0).cast("int"))).alias("jump_share"),
        (F.sum(holds) / F.sum(notes)).alias("freeze_share"),
    )


def crossover_share(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """A23 - crossed steps per step taken inside a run, from rows with ``in_run`` and ``crossed``."""
    crossed, streamed = F.sum(F.col("crossed").cast("int")), F.sum(F.col("in_run").cast("int"))
    return steps.groupBy(*by).agg(
        F.when(streamed > 0, crossed / streamed).otherwise(F.lit(0.0)).alias("crossover_share")
    )


def interval_percentiles(
    gaps: DataFrame, by: Sequence[str], value: str, *, segment: float | None = None
) -> DataFrame:
    """A23 - low percentiles of the time between repeats of one panel."""
    wanted = {"p01": 0.01, "p05": 0.05, "p50": 0.5}
    return exact_quantiles(gaps, by, F.col(value), wanted, segment=segment)
