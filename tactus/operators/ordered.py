"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task. Here the ordered axis
is cut into segments (a function of the ordering column, so the cut is deterministic and survives a
re-run of a lost task) and the window runs per ``(key, segment)``. What has to cross a segment edge
is handled in one of two ways:

* :func:`spread` copies the few rows near an edge into the neighbouring segment, for frames of a
  bounded width;
* :func:`scan` reduces each segment to one summary row (a partial aggregate), runs the window over
  those, and joins the carried state back on ``(key, segment)``, for unbounded frames.

Passing ``segment=None`` means that the caller knows a key to be small, such as the rows of one
chart, which all came out of one text cell; then plain windows over the key are used.
"""

from __future__ import annotations

import functools
import operator
import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "__segment"
KEY = "__key"


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows by ``columns`` over as many tasks as a shuffle of the session starts with.

    Left to itself, Spark merges partitions up to 64 MB of packed rows and hashes whole file splits
    before a shuffle. What a sort or a hash map unpacks from either is many times that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def spread(
    df: DataFrame,
    position: Column,
    width: float | None,
    *,
    behind: float = 0.0,
    ahead: float = 0.0,
    ghost: str = "ghost",
) -> DataFrame:
    """Assign rows to segments of ``width``, copying rows near an edge as ghosts.

    After this, any frame reaching at most ``behind`` back (or ``ahead`` forward) from a row whose
    ``ghost`` is false is complete inside its ``(key, segment)``. Without a width a key is one
    segment.
    """
    if width is None:
        return df.withColumns({SEGMENT: F.lit(0).cast("bigint"), ghost: F.lit(False)})
    if behind > width or ahead > width:
        raise ValueError("a segment must be at least as wide as the frame that crosses its edge")
    slack = width * 1e-6
    own = F.floor(position / F.lit(width))
    copies = [F.struct(own.alias("s"), F.lit(False).alias("g"))]
    if behind:
        later = F.floor((position + F.lit(behind + slack)) / F.lit(width)) > own
        copies.append(F.when(later, F.struct((own + 1).alias("s"), F.lit(True).alias("g"))))
    if ahead:
        earlier = F.floor((position - F.lit(ahead + slack)) / F.lit(width)) < own
        copies.append(F.when(earlier, F.struct((own - 1).alias("s"), F.lit(True).alias("g"))))
    if len(copies) == 1:
        return df.withColumn(SEGMENT, own).withColumn(ghost, F.lit(False))
    placed = df.withColumn("__copy", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
    return (
        placed.withColumn(SEGMENT, F.col("__copy.s"))
        .withColumn(ghost, F.col("__copy.g"))
        .drop("__copy")
    )


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column | None = None,
    *,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    running_before: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    marks: Mapping[str, tuple[Column, str]] | None = None,
) -> DataFrame:
    """Add columns that depend on all earlier (or the next) rows of a key.

    ``order`` has to be unique within a key and ``segment`` non-decreasing along it.

    * ``lag`` / ``lead`` - the expression on the neighbouring row;
    * ``running`` / ``running_before`` - sum up to and including, or up to but excluding, the row;
    * ``last`` / ``last_before`` - latest non-null value, including or excluding the row;
    * ``marks`` - ``(condition, name)``: what the running sum ``name`` was on the latest row (this
      one included) where the condition held.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    running, running_before = dict(running or {}), dict(running_before or {})
    last, last_before, marks = dict(last or {}), dict(last_before or {}), dict(marks or {})
    by_order = [F.col(c) for c in order]
    position = F.struct(*by_order)
    # Inside a struct nulls are equal, so keys with nulls find their summaries again.
    local_keys = [KEY, SEGMENT] if segment is not None else [*keys]
    rows = df
    if segment is not None:
        rest = [c for c in df.columns if c not in keys]
        rows = dealt(df.select(F.struct(*keys).alias(KEY), segment.alias(SEGMENT), *rest), KEY, SEGMENT)
        rows = rows.withColumns({c: F.col(f"{KEY}.{c}") for c in keys})
    w = Window.partitionBy(*local_keys).orderBy(*by_order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = {**running, **running_before}

    def marked(columns: DataFrame) -> DataFrame:
        for name in {s for _, s in marks.values()}:
            columns = columns.withColumn(f"__run_{name}", F.sum(running[name]).over(upto))
        return columns

    if segment is not None:
        summary = marked(rows).groupBy(*local_keys).agg(
            F.max(F.lit(1)).alias("__one"),
            *[F.max_by(F.struct(e.alias("v")), position).alias(f"__c_{n}") for n, e in lag.items()],
            *[F.min_by(F.struct(e.alias("v")), position).alias(f"__c_{n}") for n, e in lead.items()],
            *[F.sum(e).alias(f"__c_{n}") for n, e in sums.items()],
            *[
                F.max_by(F.struct(e.alias("v")), F.when(e.isNotNull(), position)).alias(f"__c_{n}")
                for n, e in {**last, **last_before}.items()
            ],
            *[
                F.max_by(F.col(f"__run_{s}"), F.when(c, position)).alias(f"__c_{n}")
                for n, (c, s) in marks.items()
            ],
        )
        across = Window.partitionBy(KEY).orderBy(SEGMENT)
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        for n in sums:
            summary = summary.withColumn(
                f"__b_{n}", F.coalesce(F.sum(f"__c_{n}").over(earlier), F.lit(0))
            )
        carried = summary.select(
            *local_keys,
            *[F.lag(f"__c_{n}").over(across).alias(f"__b_{n}") for n in lag],
            *[F.lead(f"__c_{n}").over(across).alias(f"__b_{n}") for n in lead],
            *[F.col(f"__b_{n}") for n in sums],
            *[
                F.last(f"__c_{n}", ignorenulls=True).over(earlier).alias(f"__b_{n}")
                for n in [*last, *last_before]
            ],
            *[
                F.last(F.col(f"__c_{n}") + F.col(f"__b_{s}"), ignorenulls=True)
                .over(earlier)
                .alias(f"__b_{n}")
                for n, (_, s) in marks.items()
            ],
        )
        # Segments that nothing enters, such as all of keys that lie within one, need no summary.
        entered = [F.col(f"__b_{n}") != 0 for n in sums]
        entered += [F.col(f"__b_{n}").isNotNull() for n in [*lag, *lead, *last, *last_before, *marks]]
        rows = rows.join(carried.where(functools.reduce(operator.or_, entered)), local_keys, "left")

    def base(name: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(f"__b_{name}"), otherwise) if segment is not None else otherwise

    def carried_value(name: str, local: Column) -> Column:
        return F.coalesce(local, F.col(f"__b_{name}"))["v"] if segment is not None else local["v"]

    rows = marked(rows)
    added: dict[str, Column] = {}
    for n, e in lag.items():
        added[n] = carried_value(n, F.lag(F.struct(e.alias("v"))).over(w))
    for n, e in lead.items():
        added[n] = carried_value(n, F.lead(F.struct(e.alias("v"))).over(w))
    for n, e in running.items():
        added[n] = F.sum(e).over(upto) + base(n, F.lit(0))
    for n, e in running_before.items():
        added[n] = F.coalesce(F.sum(e).over(prior), F.lit(0)) + base(n, F.lit(0))
    for frame, wanted in ((upto, last), (prior, last_before)):
        for n, e in wanted.items():
            tagged = F.when(e.isNotNull(), F.struct(e.alias("v")))
            added[n] = carried_value(n, F.last(tagged, ignorenulls=True).over(frame))
    for n, (c, s) in marks.items():
        local = F.last(F.when(c, F.col(f"__run_{s}")), ignorenulls=True).over(upto)
        added[n] = (
            F.coalesce(local + base(s, F.lit(0)), F.col(f"__b_{n}")) if segment is not None else local
        )
    kept = [c for c in df.columns if c not in added]
    return rows.select(*kept, *[e.alias(n) for n, e in added.items()])


def attach(rows: DataFrame, more: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add the other columns of ``more``, which has a row for some keys; null keys match."""
    named = more.withColumnsRenamed({c: f"__on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on]
    return rows.join(named, same, "left").drop(*[f"__on_{c}" for c in on])


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session that names none, as in tests, gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return shared
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="tactus-checkpoint-")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table at a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
