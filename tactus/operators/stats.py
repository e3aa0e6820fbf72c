"""Exact order statistics that do not gather a group into one place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.operators.ordered import scan


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    wanted: Mapping[str, float],
    *,
    segment: float | None = None,
) -> DataFrame:
    """Interpolated quantiles of ``value`` per key, NULLs left out.

    Equal values are counted first (with map-side combining), then ranked by a running sum over
    segments ``segment`` wide on the value axis, so that neither a hot key nor a long value axis
    ends up in one task.
    """
    named = [*keys] or ["__all"]
    source = df if keys else df.withColumn("__all", F.lit(0))
    counts = (
        source.select(*named, value.alias("__v"))
        .where(F.col("__v").isNotNull())
        .groupBy(*named, "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    totals = counts.groupBy(*named).agg(F.sum("__n").alias("__total"))
    cut = None if segment is None else F.floor(F.col("__v") / F.lit(float(segment)))
    ranked = scan(counts, named, ["__v"], cut, running={"__upto": F.col("__n")}).join(totals, named)

    def at(rank: Column) -> Column:
        here = (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
        return F.max(F.when(here, F.col("__v")))

    columns = []
    for name, q in wanted.items():
        place = (F.col("__total") - 1) * F.lit(float(q))
        low = at(F.floor(place))
        high = at(F.ceil(place))
        part = F.max(place - F.floor(place))
        columns.append((low + part * (high - low)).alias(name))
    found = ranked.groupBy(*named).agg(*columns)
    return found if keys else found.drop("__all")


def median(
    df: DataFrame, keys: Sequence[str], value: Column, out: str = "median", *, segment: float | None = None
) -> DataFrame:
    """A16 - exact median per key; NULL metrics are ignored."""
    return exact_quantiles(df, keys, value, {out: 0.5}, segment=segment)
