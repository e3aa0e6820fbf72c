"""Views that shape the star-schema tables into the inputs of the operators.

Every binding reads a whole table and keeps only the columns it needs, so that the scan is pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.operators.ordered import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Seconds since 1970 as a double, whatever the session time zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    else:
        micros = F.unix_micros(F.col(column))
    return micros / F.lit(1e6)


def epoch_days(df: DataFrame, column: str) -> Column:
    """Whole days since 1970."""
    return F.floor(epoch_seconds(df, column) / F.lit(86400.0))


def drawn_sql(text: str) -> str:
    """What ``drawn`` gives for a text, in SQL."""
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


#: Note rows of events have this many panels.
EVENT_WIDTH = 4
EVENT_TYPES = ("click", "view", "purchase", "signup")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a chart, each event a row: its type is the panel, ``props.k`` the code.

    Errors land on panel ``k % 4`` as mines; large ``k`` add a second and third struck panel.
    """
    return event_rows_of(table(spark, sf_dir, "events"))


def event_rows_of(events: DataFrame) -> DataFrame:
    """Note rows of an events table or stream."""
    number = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    base = events.select(
        F.col("user_id"),
        epoch_seconds(events, "ts").alias("t"),
        F.col("event_id"),
        number.alias("kk"),
        F.when(kind >= 0, kind).otherwise(number % 4).cast("int").alias("panel"),
        (kind < 0).alias("mine"),
    )
    main = F.when(F.col("mine"), 5).otherwise(
        F.when(F.col("kk") % 7 == 5, 1).otherwise(F.col("kk") % 7)
    )

    def code(p: int) -> Column:
        return (
            F.when(F.col("panel") == p, main)
            .when((F.col("kk") >= 80) & ((F.col("panel") + 1) % 4 == p), F.lit(1))
            .when((F.col("kk") >= 92) & ((F.col("panel") + 2) % 4 == p), F.lit(1))
            .otherwise(F.lit(0))
            .cast("int")
        )

    return base.select(
        "user_id", "t", "event_id", F.array(*[code(p) for p in range(4)]).alias("codes")
    )


EVENT_ROWS_SQL = """
base AS (
  SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id,
         CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS kk,
         CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2
              WHEN 'signup' THEN 3
              ELSE CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 4 END AS panel,
         event_type NOT IN ('click', 'view', 'purchase', 'signup') AS mine
  FROM events),
main AS (
  SELECT *, CASE WHEN mine THEN 5 WHEN kk % 7 = 5 THEN 1 ELSE kk % 7 END AS code FROM base),
ev AS (
  SELECT user_id, t, event_id,
    CASE WHEN panel = 0 THEN code WHEN kk >= 80 AND (panel + 1) % 4 = 0 THEN 1
         WHEN kk >= 92 AND (panel + 2) % 4 = 0 THEN 1 ELSE 0 END AS c0,
    CASE WHEN panel = 1 THEN code WHEN kk >= 80 AND (panel + 1) % 4 = 1 THEN 1
         WHEN kk >= 92 AND (panel + 2) % 4 = 1 THEN 1 ELSE 0 END AS c1,
    CASE WHEN panel = 2 THEN code WHEN kk >= 80 AND (panel + 1) % 4 = 2 THEN 1
         WHEN kk >= 92 AND (panel + 2) % 4 = 2 THEN 1 ELSE 0 END AS c2,
    CASE WHEN panel = 3 THEN code WHEN kk >= 80 AND (panel + 1) % 4 = 3 THEN 1
         WHEN kk >= 92 AND (panel + 2) % 4 = 3 THEN 1 ELSE 0 END AS c3
  FROM main),
steps AS (
  SELECT *, (c0 IN (1,2,4,6))::INT AS s0, (c1 IN (1,2,4,6))::INT AS s1,
            (c2 IN (1,2,4,6))::INT AS s2, (c3 IN (1,2,4,6))::INT AS s3
  FROM ev)"""


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Round computed doubles for comparison, keeping exact ties off the rounding edge."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value + F.lit(1e-9), digits)


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a chart, each line number a grid slot, each part a panel.

    Lines that share an order, a line number and a panel are one note, so they are aggregated first.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_partkey") % 4).cast("int").alias("panel"),
        (F.col("l_quantity").cast("int") % 7).alias("code"),
    )

    def at(p: int) -> Column:
        return F.max(F.when(F.col("panel") == p, F.col("code")).otherwise(F.lit(0)))

    return (
        dealt(lines, "l_orderkey", "l_linenumber")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.array(*[at(p) for p in range(4)]).alias("codes"))
        .where(F.exists("codes", lambda c: c > 0))
        .select(
            F.col("l_orderkey").alias("chart"),
            ((F.col("l_linenumber") - 1) * 9).cast("int").alias("slot"),
            "codes",
        )
    )


LINE_ROWS_SQL = """
lr AS (
  SELECT l_orderkey AS chart, (l_linenumber - 1) * 9 AS slot,
    max(CASE WHEN l_partkey % 4 = 0 THEN l_quantity::INT % 7 ELSE 0 END) AS c0,
    max(CASE WHEN l_partkey % 4 = 1 THEN l_quantity::INT % 7 ELSE 0 END) AS c1,
    max(CASE WHEN l_partkey % 4 = 2 THEN l_quantity::INT % 7 ELSE 0 END) AS c2,
    max(CASE WHEN l_partkey % 4 = 3 THEN l_quantity::INT % 7 ELSE 0 END) AS c3
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
rows_ AS (
  SELECT *, (c0 IN (1,2,4,6))::INT + (c1 IN (1,2,4,6))::INT + (c2 IN (1,2,4,6))::INT
            + (c3 IN (1,2,4,6))::INT AS notes,
         array_to_string(list_transform([c0, c1, c2, c3], lambda c: ['0','1','2','3','4','M','L'][c + 1]), '') AS txt
  FROM lr WHERE c0 + c1 + c2 + c3 > 0)"""
