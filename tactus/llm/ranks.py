"""Ranks and running sums inside keys of any size.

A key's rows are dealt into segments by a hash, so that no task holds a whole key. Only one summary
row per segment is brought together, and each row adds its segment's offset to its local value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a segment is meant to hold.
SEGMENT_ROWS = 20_000


def segments_for(rows: int, segment_rows: int = SEGMENT_ROWS) -> int:
    return max(512, -(-rows // segment_rows))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    segments: int,
    into: str,
    value: Column | None = None,
    axis: Column | None = None,
) -> DataFrame:
    """Add ``into``: the sum of ``value`` (1 by default) over the rows of the key before this one.

    The order is by segment, then by ``order``. ``axis`` is a number from 0 to 2**31 - 1 that is spread
    evenly and decides the segment; a hash of ``order`` by default. ``keys`` may hold nulls.
    """
    value = F.lit(1).cast("long") if value is None else value.cast("long")
    spread = F.pmod(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in order]), F.lit(1 << 31)) if axis is None else axis
    width = max(1, (1 << 31) // segments)
    rows = df.withColumns({"__seg": F.least((spread / F.lit(width)).cast("long"), F.lit(segments - 1)), "__value": value})
    local = Window.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__seg").agg(F.sum("__value").alias("__total"))
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    offsets = totals.select(
        *named, F.col("__seg").alias("__seg_of"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset")
    )
    rows = rows.withColumn("__local", F.coalesce(F.sum("__value").over(local), F.lit(0)))
    same = rows["__seg"] == offsets["__seg_of"]
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(offsets[f"__key{i}"])
    found = rows.join(offsets, same, "left")
    return found.select(*[F.col(c) for c in df.columns], (F.col("__local") + F.col("__offset")).alias(into))
