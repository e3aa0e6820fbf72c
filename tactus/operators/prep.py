"""Tables for models: splits, examples, windows, mirrors and balanced samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import (
    drawn,
    drawn_share,
    cache_key,
    clamp_meter,
    difficulty_index,
    mirror_row,
    stem_bucket,
    style_index,
)
from tactus.operators.corpus import tokenize
from tactus.operators.ordered import attach

WINDOW_MEASURES = 64
PAD = -100


def usable_charts(
    charts: DataFrame,
    rows: DataFrame,
    songs: DataFrame,
    song: Sequence[str],
    chart: Sequence[str],
    *,
    min_rows: int = 16,
    min_slots: int = 64,
) -> DataFrame:
    """F02 - charts with a canonical difficulty, enough rows, in a song with enough slots."""
    enough = rows.groupBy(*chart).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_rows)
    long = songs.where(F.col("slot_count") >= min_slots)
    return (
        charts.where(F.col("difficulty").isin(*k.DIFFICULTIES))
        .join(enough.select(*chart), list(chart), "left_semi")
        .join(long.select(*song), list(song), "left_semi")
    )


def usable_songs(songs: DataFrame, charts: DataFrame, song: Sequence[str]) -> DataFrame:
    """F02 - songs that keep at least one chart."""
    return songs.join(charts.select(*song), list(song), "left_semi")


def trusted_timing(songs: DataFrame, *, min_seconds: float = 30.0, seconds: str | None = None) -> DataFrame:
    """F03 - songs whose declared offset can serve as a label."""
    kept = songs.where(
        F.col("constant_bpm")
        & F.col("offset_declared")
        & (F.coalesce("stops", F.lit(0)) == 0)
        & (F.col("primary_bpm") != 0)
    )
    return kept if seconds is None else kept.where(F.col(seconds) >= min_seconds)


def hash_split(df: DataFrame, stem: Column, modulus: int = 20, held_out: int = 2) -> DataFrame:
    """F05 - mark held-out rows by a digest of a name, so that a song never changes sides."""
    return df.withColumn("validation", stem_bucket(stem, modulus) < held_out)


def examples(
    charts: DataFrame, songs: DataFrame, scales: DataFrame, *, pack: str = "pack", simfile: str = "simfile"
) -> DataFrame:
    """G01 - charts with everything a model is conditioned on, and the split they belong to."""
    conditioned = charts.select(
        simfile,
        "chart_idx",
        difficulty_index(F.col("difficulty")).alias("difficulty"),
        clamp_meter(F.col("meter")).alias("meter"),
        style_index(F.col("style")).alias("style"),
    )
    known = songs.select(simfile, pack, F.col("primary_bpm").alias("bpm")).join(scales, pack)
    joined = conditioned.join(known, simfile)
    return hash_split(joined, cache_key(F.col(simfile)))


def mirrors(rows: DataFrame, codes: str = "codes") -> DataFrame:
    """P18 - every row under each of the four pad symmetries."""
    turned = F.array(
        *[
            F.struct(F.lit(i).alias("mirror"), mirror_row(F.col(codes), p).alias("codes"))
            for i, p in enumerate(k.MIRRORS)
        ]
    )
    rest = [c for c in rows.columns if c != codes]
    return rows.select(*rest, F.explode(turned).alias("m")).select(*rest, "m.*")


def augment_mirrors(rows: DataFrame, by: Sequence[str], seed: int, *, codes: str = "codes", validation: Column | None = None) -> DataFrame:
    """G03 - turn each window one of four ways, chosen by a seeded digest of its key.

    Held-out windows are never turned.
    """
    pick = (drawn(F.lit(seed), *[F.col(c) for c in by]) % len(k.MIRRORS)).cast("int")
    if validation is not None:
        pick = F.when(validation, F.lit(0)).otherwise(pick)
    turned = mirror_row(F.col(codes), k.MIRRORS[0])
    for i, p in enumerate(k.MIRRORS[1:], start=1):
        turned = F.when(F.col("mirror") == i, mirror_row(F.col(codes), p)).otherwise(turned)
    return rows.withColumn("mirror", pick).withColumn(codes, turned)


def window_start(slot_count: Column, measures: int, seed: int, *key: str) -> Column:
    """Seeded start of a training window, on a measure line."""
    width = measures * k.SLOTS_PER_MEASURE
    room = F.greatest(slot_count - width, F.lit(1))
    start = drawn(F.lit(seed), *[F.col(c) for c in key]) % room
    return start - start % k.SLOTS_PER_MEASURE


def chart_windows(
    targets: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str],
    *,
    measures: int = WINDOW_MEASURES,
    max_steps: int | None = None,
    seed: int | None = None,
    slot_count: str | None = None,
) -> DataFrame:
    """G02 - one row per window of a chart with its placement and padded step arrays.

    Without a seed the windows tile the chart; with one, each chart gives one window at a seeded
    start. A window holds at most ``measures * 48`` rows, so its arrays are bounded. Step arrays are
    padded to the longest window; ``max_steps`` cuts or pads them to a fixed length instead. ``steps``
    counts all rows of the window either way.
    """
    width = measures * k.SLOTS_PER_MEASURE
    if seed is None:
        start = F.floor(F.col("slot") / width) * width
    else:
        start = window_start(F.col(slot_count), measures, seed, *keys)
    placed = targets.withColumn("start", start.cast("int")).where(
        (F.col("slot") >= F.col("start")) & (F.col("slot") < F.col("start") + width)
    )
    coded = tokenize(placed, vocab).withColumn("local", (F.col("slot") - F.col("start")).cast("int"))
    size = vocab.agg(F.count(F.lit(1)).cast("int")).scalar()
    grouped = coded.groupBy(*keys, "start").agg(
        F.array_sort(F.collect_list(F.struct("local", "token"))).alias("__steps")
    )
    if max_steps is None:
        kept, length = F.col("__steps"), grouped.agg(F.max(F.size("__steps"))).scalar()
    else:
        kept, length = F.slice("__steps", 1, max_steps), F.lit(max_steps)

    def padded(values: Column, fill: Column) -> Column:
        return F.concat(values, F.array_repeat(fill, F.col("__length") - F.size(kept)))

    local = F.transform(kept, lambda s: s["local"])
    tokens = F.transform(kept, lambda s: s["token"])
    before = F.transform(
        kept,
        lambda s, i: F.when(i == 0, F.col("__vocab")).otherwise(F.get(kept, i - 1)["token"]),
    )
    delta = F.transform(
        kept,
        lambda s, i: F.when(i == 0, F.lit(0)).otherwise(
            F.least(s["local"] - F.get(kept, i - 1)["local"], F.lit(k.MAX_DELTA))
        ),
    )
    zero, one = F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint")
    last = F.coalesce(F.element_at("__steps", -1)["local"], F.lit(-1))

    def upto(step: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get("__steps", i - 1)["local"])
        return F.concat(F.array_repeat(zero, step["local"] - before - 1), F.array(one))

    placement = F.concat(F.flatten(F.transform("__steps", upto)), F.array_repeat(zero, F.lit(width - 1) - last))
    return grouped.withColumns({"__vocab": size, "__length": length}).select(
        *keys,
        "start",
        F.size("__steps").alias("steps"),
        placement.alias("placement"),
        padded(tokens, F.lit(PAD)).alias("pattern_target"),
        padded(before, F.col("__vocab")).alias("previous"),
        padded(delta, F.lit(0)).alias("delta"),
        padded(local, F.lit(0)).alias("step_slots"),
        F.transform(
            padded(local, F.lit(0)), lambda s: F.pmod(s + F.col("start"), F.lit(k.SLOTS_PER_MEASURE))
        ).alias("step_position"),
    )


def step_context(
    tokens: DataFrame, keys: Sequence[str], vocab_size: int, *, slot: str = "slot"
) -> DataFrame:
    """W08 - slots since the previous step (at most 96) and its token, in one bounded window.

    ``keys`` name a window; its first step has a delta of 0 and the vocabulary size as its previous
    token.
    """
    w = Window.partitionBy(*keys).orderBy(slot)
    gap = F.col(slot) - F.lag(slot).over(w)
    return tokens.withColumns(
        {
            "delta": F.coalesce(F.least(F.greatest(gap, F.lit(0)), F.lit(k.MAX_DELTA)), F.lit(0)),
            "previous": F.coalesce(F.lag("token").over(w), F.lit(vocab_size)),
        }
    )


def _numbered(rows: DataFrame, within: Sequence[str], key: Sequence[str], seed: Column, buckets: int, into: str) -> DataFrame:
    """Dense numbers from 0 within ``within``, in the order of a drawn bucket and then of ``key``.

    Only the buckets' counts are brought together; a bucket is sorted by itself.
    """
    bucketed = rows.withColumn("__b", drawn(seed, *[F.col(c) for c in key]) % buckets)
    counts = bucketed.groupBy(*within, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = Window.partitionBy(*within, "__b").orderBy(*key)
    found = attach(bucketed, offsets, [*within, "__b"])
    return found.withColumn(into, F.row_number().over(place) - 1 + F.col("__o")).drop("__b", "__o")


def balanced_sample(
    rows: DataFrame, by: str, key: Sequence[str], n: int, seed: int, *, buckets: int = 1 << 16
) -> DataFrame:
    """G04 - ``n`` draws with replacement in which every value of ``by`` is equally likely.

    Rows are numbered within their group, and groups among themselves. A draw picks a group and a row by number, so
    the draws meet both in equi-joins, and the result does not depend on how the data is partitioned. ``key`` is
    unique within a group; ``buckets`` should leave each bucket of the largest group small enough to sort in one task.
    A null is a group like any other.
    """
    numbered = _numbered(rows, [by], key, F.lit(seed), buckets, "__i")
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__size"))
    groups = _numbered(sizes, [], [by], F.lit(f"{seed}/groups"), 1024, "__g").withColumnRenamed(by, "__by")
    many = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    picks = (
        rows.sparkSession.range(n)
        .withColumnRenamed("id", "draw")
        .withColumn("__g", F.floor(drawn_share(F.lit(seed), F.lit("group"), F.col("draw")) * many))
        .join(groups, "__g")
        .withColumn("__i", F.floor(drawn_share(F.lit(seed), F.lit("row"), F.col("draw")) * F.col("__size")))
        .select("draw", F.col("__by").alias(by), "__i")
    )
    found = numbered.withColumnsRenamed({by: "__by", "__i": "__at"})
    joined = picks.join(found, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__i") == F.col("__at")))
    return joined.drop("__by", "__at", "__i")


def build_envelopes(songs: DataFrame, frames: DataFrame, target: str, *, seconds: str = "seconds") -> None:
    """G06 - append the frames of trustworthy songs of at least 30 s the target does not have yet.

    Entries are named by the first sixteen digits of the digest of the audio path.
    """
    from tactus.sources.manifest import build_incremental

    kept = trusted_timing(songs, seconds=seconds).select(
        "audio", F.col("primary_bpm").alias("bpm"), "offset"
    )
    build_incremental(frames.join(kept, "audio"), target, "audio", digits=16)
