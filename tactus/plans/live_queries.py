"""Events replayed as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.operators.ordered import shared_folder
from tactus.plans.bindings import EVENT_ROWS_SQL, epoch_seconds, event_rows_of, rounded, table
from tactus.plans.play_queries import HOUR, OCCUPIED_SQL, STREAM_SQL
from tactus.plans.registry import query
from tactus.streaming import live

KEYS = ["user_id"]


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of note rows with an event time."""
    schema = table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    return event_rows_of(events).withColumn(
        "ts", F.timestamp_micros(F.round(F.col("t") * F.lit(1e6)).cast("bigint"))
    )


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _finished(flow: live.Carried, stream: DataFrame) -> DataFrame:
    folder = _folder(stream.sparkSession)
    flow.start(stream, folder).awaitTermination()
    return flow.finish(stream.sparkSession, folder)


def _seconds(df: DataFrame, column: str):
    return rounded(epoch_seconds(df, column)).alias(column)


@query(
    "live_runs",
    f"""WITH {EVENT_ROWS_SQL},
    a AS (SELECT user_id, t, event_id, CASE WHEN t - lag(t) OVER w < 43200 THEN 0 ELSE 1 END AS opens
          FROM steps WHERE s0+s1+s2+s3 > 0 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    b AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM a)
    SELECT user_id, round(min(t) + 1e-9, 6) AS run_start, round(max(t) + 1e-9, 6) AS run_end, count(*) AS steps
    FROM b GROUP BY user_id, run""",
)
def live_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = event_stream(spark, sf_dir).where(F.exists("codes", lambda c: c.isin(1, 2, 4, 6)))
    found = _finished(live.live_runs(KEYS, 12 * HOUR, "1 day"), steps)
    return found.select("user_id", _seconds(found, "run_start"), _seconds(found, "run_end"), "steps")


@query(
    "live_peak_rate",
    f"""WITH {EVENT_ROWS_SQL},
    w AS (SELECT user_id, (floor(t / 3600)::BIGINT - g.i) * 3600 AS start FROM ev, generate_series(0, 5) g(i))
    SELECT user_id, start::DOUBLE AS start, count(*) AS rows, round(count(*) / 6.0::DOUBLE + 1e-9, 6) AS per_hour
    FROM w GROUP BY user_id, start""",
)
def live_peak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = live.live_peak_rate(event_stream(spark, sf_dir), KEYS, "6 hours", "1 hour", "1 day")
    found = live.drain(rates, _folder(spark), [*KEYS, "start", "end"])
    return found.select(
        "user_id", _seconds(found, "start"), "rows", rounded(F.col("rate") * 3600).alias("per_hour")
    )


@query(
    "live_occupancy",
    f"""WITH {OCCUPIED_SQL}, {STREAM_SQL}
    SELECT o.user_id, o.event_id, o.stepped::BIGINT AS stepped, o.held::BIGINT AS held, o.occupied::BIGINT AS occupied,
      coalesce(s.crossed, false)::BIGINT AS crossed FROM occ o LEFT JOIN st5 s USING (event_id)""",
)
def live_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = live.live_occupancy(KEYS, "1 day", gap=12 * HOUR, ttl=60 * 24 * HOUR)
    found = _finished(flow, event_stream(spark, sf_dir))
    flags = ("stepped", "held", "occupied", "crossed")
    return found.select("user_id", "event_id", *[F.col(c).cast("bigint").alias(c) for c in flags])
