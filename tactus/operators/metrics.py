"""Figures that score predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import cyclic_distance
from tactus.operators.ordered import scan
from tactus.operators.stats import median


def stratified_auc(
    scores: DataFrame,
    keys: Sequence[str],
    stride: int,
    *,
    score: str = "score",
    label: str = "label",
    position: str = "position",
    least: int = 8,
    segment: float | None = None,
) -> DataFrame:
    """A15 - area under the ROC curve over positions on the stride, ties at their middle rank.

    NULL with fewer than ``least`` rows of either label. Equal scores are counted first, and ranks
    come from a running sum over the distinct scores, cut into segments of the score axis.
    """
    kept = scores.where(F.pmod(F.col(position), F.lit(stride)) == 0)
    named = [*keys] or ["__all"]
    kept = kept if keys else kept.withColumn("__all", F.lit(0))
    counts = kept.groupBy(*named, score).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("__pos"), F.count(F.lit(1)).alias("__n")
    )
    cut = None if segment is None else F.floor(F.col(score) / F.lit(float(segment)))
    ranked = scan(counts, named, [score], cut, running_before={"__below": F.col("__n")})
    middle = F.col("__below") + (F.col("__n") + 1) / F.lit(2.0)
    summed = ranked.groupBy(*named).agg(
        F.sum("__pos").alias("positives"),
        F.sum(F.col("__n") - F.col("__pos")).alias("negatives"),
        F.sum(middle * F.col("__pos")).alias("__ranks"),
    )
    p, n = F.col("positives"), F.col("negatives")
    auc = (F.col("__ranks") - p * (p + 1) / F.lit(2.0)) / (p * n)
    found = summed.select(
        *named, "positives", "negatives", F.when((p >= least) & (n >= least), auc).alias("auc")
    )
    return found if keys else found.drop("__all")


def phase_metrics(pairs: DataFrame, predicted: str, actual: str, bins: int = k.PHASE_BINS) -> DataFrame:
    """A17 - shares of predictions exact, within one and two bins, and half a beat out."""
    gap = cyclic_distance(F.col(predicted), F.col(actual), bins)

    def share(condition: Column, name: str) -> Column:
        return F.avg(condition.cast("int")).alias(name)

    return pairs.agg(
        share(gap == 0, "exact"),
        share(gap <= 1, "within_one_bin"),
        share(gap <= 2, "within_two_bins"),
        share(F.abs(gap - bins // 8) <= 1, "half_beat_out"),
    )


def timing_accuracy(
    pairs: DataFrame,
    *,
    bpm: str = "bpm",
    offset: str = "offset",
    true_bpm: str = "true_bpm",
    true_offset: str = "true_offset",
    bpm_tolerance: float = 0.5,
    offset_tolerance: float = 0.030,
    segment: float | None = 0.01,
) -> DataFrame:
    """A18 - tempo and offset accuracy; offset figures only over songs whose tempo is right.

    An offset is compared within one beat, the short way round.
    """
    beat = F.lit(60.0) / F.col(true_bpm)
    apart = F.pmod(F.col(offset) - F.col(true_offset), beat)
    error = F.least(apart, beat - apart)
    scored = pairs.select(
        (F.abs(F.col(bpm) - F.col(true_bpm)) <= bpm_tolerance).alias("tempo_ok"),
        error.alias("error"),
        (F.abs(error - beat / 2) <= offset_tolerance).alias("half"),
    )
    right = F.col("tempo_ok")
    counted = scored.agg(
        F.avg(right.cast("int")).alias("tempo_right"),
        F.avg(F.when(right, (F.col("error") <= offset_tolerance).cast("int"))).alias("offset_right"),
        F.avg(F.when(right, F.col("half").cast("int"))).alias("half_beat_out"),
        F.avg((right & (F.col("error") <= offset_tolerance)).cast("int")).alias("both_right"),
    )
    middle = median(scored.where(right), [], F.col("error"), "median_error", segment=segment)
    return counted.withColumn("median_error", middle.scalar())
