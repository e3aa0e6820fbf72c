"""Playability over timed events: each user is a chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.operators import corpus, play
from tactus.plans.bindings import EVENT_ROWS_SQL, EVENT_WIDTH, event_rows, rounded
from tactus.plans.registry import query

HOUR, DAY = 3600.0, 86400.0
PIECE = 5 * DAY
ORDER = ["t", "event_id"]
KEYS = ["user_id"]
LIMITS = play.Limits(
    burst_window=6 * HOUR,
    sustained_window=2 * DAY,
    max_burst=5 / (6 * HOUR),
    max_sustained=14 / (2 * DAY),
    fast_jack=HOUR / 4,
    stream_gap=12 * HOUR,
)

HELD = ", ".join(
    f"""CASE WHEN c{p} <> 3 AND coalesce(last_value(CASE WHEN c{p} IN (2,4) THEN 1
        WHEN c{p} = 3 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 1 ELSE 0 END AS h{p}"""
    for p in range(4)
)
OCCUPIED_SQL = f"""{EVENT_ROWS_SQL},
held AS (SELECT *, {HELD} FROM steps),
occ AS (
  SELECT *, s0 + 2*s1 + 4*s2 + 8*s3 AS stepped, h0 + 2*h1 + 4*h2 + 8*h3 AS held,
    (s0|h0) + 2*(s1|h1) + 4*(s2|h2) + 8*(s3|h3) AS occupied,
    (s0|h0) + (s1|h1) + (s2|h2) + (s3|h3) AS n_occ, s0+s1+s2+s3 AS n_step
  FROM held)"""

STREAM_SQL = """
st AS (SELECT * FROM occ WHERE stepped > 0),
st1 AS (SELECT *, coalesce(t - lag(t) OVER w <= 43200, false) AS in_run
        FROM st WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
st2 AS (SELECT *, sum(in_run::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS turns FROM st1),
st3 AS (SELECT *,
   last_value(CASE WHEN n_step = 1 AND NOT in_run THEN s3 END IGNORE NULLS) OVER w AS f,
   last_value(CASE WHEN n_step = 1 AND NOT in_run THEN turns END IGNORE NULLS) OVER w AS f_turns
   FROM st2 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
st4 AS (SELECT *, (coalesce(f, 0) + turns - coalesce(f_turns, 0)) % 2 AS foot FROM st3),
st5 AS (SELECT *, in_run AND ((foot = 0 AND stepped = 8) OR (foot = 1 AND stepped = 1)) AS crossed
        FROM st4)"""

RATES_SQL = """
rt AS (
  SELECT user_id, t,
    count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS nb,
    count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) AS ns
  FROM occ WHERE occupied > 0),
rates AS (
  SELECT user_id, count(*) AS rows,
    CASE WHEN count(*) >= 2 AND max(t) - min(t) >= 21600 THEN max(nb) / 21600.0::DOUBLE ELSE 0 END AS burst,
    CASE WHEN count(*) >= 2 AND max(t) - min(t) >= 172800 THEN max(ns) / 172800.0::DOUBLE ELSE 0 END AS sust
  FROM rt GROUP BY user_id)"""

JACK_SQL = """
panels AS (
  SELECT user_id, t, event_id, p FROM steps, (VALUES (0),(1),(2),(3)) v(p)
  WHERE CASE p WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END = 1),
gaps AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id, p ORDER BY t, event_id) AS g FROM panels),
jack AS (SELECT user_id, min(g) AS jack FROM gaps GROUP BY user_id)"""

FEET_SQL = """
stance AS (
  SELECT l.v AS l, r.v AS r, (1 << l.v) | (1 << r.v) AS bits
  FROM (VALUES (0),(1),(2),(3)) l(v), (VALUES (0),(1),(2),(3)) r(v) WHERE l.v <> r.v),
need AS (
  SELECT user_id, t, occupied, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn,
         t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap
  FROM occ WHERE occupied > 0),
reach AS (
  SELECT user_id, rn, l, r FROM need, stance
  WHERE rn = 1 AND bit_count(occupied & bits) = least(bit_count(occupied), 2)
  UNION
  SELECT n.user_id, n.rn, s.l, s.r
  FROM reach q JOIN need n ON n.user_id = q.user_id AND n.rn = q.rn + 1, stance s
  WHERE bit_count(n.occupied & s.bits) = least(bit_count(n.occupied), 2)
    AND (n.gap >= 900 OR q.l = s.l OR q.r = s.r)),
feet AS (
  SELECT n.user_id, max(n.rn) = coalesce(max(q.rn), 0) AS possible
  FROM need n LEFT JOIN reach q ON q.user_id = n.user_id AND q.rn = n.rn GROUP BY n.user_id)"""


@query(
    "runs",
    f"""WITH {EVENT_ROWS_SQL},
    a AS (SELECT user_id, t, event_id,
            CASE WHEN t - lag(t) OVER w <= 43200 THEN 0 ELSE 1 END AS opens
          FROM steps WHERE s0+s1+s2+s3 > 0 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    b AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM a)
    SELECT user_id, min(t) AS run_start, max(t) AS run_end, count(*) AS steps
    FROM b GROUP BY user_id, run""",
)
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    steps = rows.where(F.exists("codes", lambda c: c.isin(1, 2, 4, 6)))
    return play.runs(steps, KEYS, ORDER, 12 * HOUR, segment=PIECE)


@query(
    "occupied",
    f"""WITH {OCCUPIED_SQL}
    SELECT user_id, event_id, stepped::BIGINT AS stepped, held::BIGINT AS held,
           occupied::BIGINT AS occupied FROM occ""",
)
def occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    cut = F.floor(F.col("t") / F.lit(PIECE))
    seen = play.occupied(rows, KEYS, ORDER, segment=cut, width=EVENT_WIDTH)
    masks = [F.col(c).cast("bigint").alias(c) for c in ("stepped", "held", "occupied")]
    return seen.select("user_id", "event_id", *masks)


@query(
    "peak_rate",
    f"""WITH {OCCUPIED_SQL}, {RATES_SQL}
    SELECT user_id, round(burst * 3600, 6) AS peak_per_hour FROM rates""",
)
def peak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = play.peak_rate(event_rows(spark, sf_dir), KEYS, ORDER, 6 * HOUR, segment=PIECE, width=EVENT_WIDTH)
    return peaks.select("user_id", F.round(F.col("peak_rate") * 3600, 6).alias("peak_per_hour"))


@query(
    "fastest_jack",
    f"WITH {EVENT_ROWS_SQL}, {JACK_SQL} SELECT user_id, round(jack, 6) AS fastest_jack FROM jack",
)
def fastest_jack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = play.fastest_jack(event_rows(spark, sf_dir), KEYS, ORDER, segment=PIECE)
    return found.select("user_id", F.round("fastest_jack", 6).alias("fastest_jack"))


@query(
    "crossed_steps",
    f"""WITH {OCCUPIED_SQL}, {STREAM_SQL}
    SELECT o.user_id, count(*) FILTER (WHERE o.stepped > 0) AS steps,
           (SELECT count(*) FROM st5 s WHERE s.user_id = o.user_id AND s.crossed) AS crossovers
    FROM occ o WHERE o.occupied > 0 GROUP BY o.user_id""",
)
def crossed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    return play.crossed_steps(rows, KEYS, ORDER, gap=12 * HOUR, segment=PIECE, width=EVENT_WIDTH)


@query(
    "foot_steps",
    f"""WITH {OCCUPIED_SQL}, {STREAM_SQL}
    SELECT user_id, event_id, in_run::BIGINT AS in_run, foot::BIGINT AS foot,
           crossed::BIGINT AS crossed FROM st5""",
)
def foot_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).withColumn("stepped", play.step_mask(F.col("codes")))
    walked = play.foot_steps(rows, KEYS, ORDER, gap=12 * HOUR, segment=PIECE)
    flags = [F.col(c).cast("bigint").alias(c) for c in ("in_run", "foot", "crossed")]
    return walked.select("user_id", "event_id", *flags)


@query(
    "crossover_share",
    f"""WITH {OCCUPIED_SQL}, {STREAM_SQL}
    SELECT user_id % 10 AS stage, round(coalesce(sum(crossed::INT) / nullif(sum(in_run::INT), 0), 0) + 1e-9, 6) AS crossover_share
    FROM st5 GROUP BY 1""",
)
def crossover_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).withColumn("stepped", play.step_mask(F.col("codes")))
    walked = play.foot_steps(rows, KEYS, ORDER, gap=12 * HOUR, segment=PIECE)
    shares = corpus.crossover_share(walked.withColumn("stage", F.col("user_id") % 10), ["stage"])
    return shares.select("stage", rounded("crossover_share").alias("crossover_share"))


@query(
    "feet_feasible",
    f"""WITH RECURSIVE {OCCUPIED_SQL}, {FEET_SQL}
    SELECT user_id, possible::BIGINT AS possible FROM feet""",
)
def feet_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = play.feet_feasible(event_rows(spark, sf_dir), KEYS, ORDER, fast=HOUR / 4, segment=PIECE, width=EVENT_WIDTH)
    return found.select("user_id", F.col("geometrically_possible").cast("bigint").alias("possible"))


@query(
    "playability",
    f"""WITH RECURSIVE {OCCUPIED_SQL}, {STREAM_SQL}, {RATES_SQL}, {JACK_SQL}, {FEET_SQL},
    sizes AS (
      SELECT user_id, count(*) FILTER (WHERE n_occ > 2) AS chord_rows, max(n_occ) AS most,
             count(*) FILTER (WHERE stepped > 0) AS steps
      FROM occ WHERE occupied > 0 GROUP BY user_id),
    cross_n AS (SELECT user_id, count(*) FILTER (WHERE crossed) AS n FROM st5 GROUP BY user_id),
    joined AS (
      SELECT z.user_id, z.steps, rows, burst, sust, chord_rows, most, coalesce(c.n, 0) AS crossovers,
             jack, possible,
             concat_ws(',', CASE WHEN NOT possible THEN 'no_two_foot_assignment' END,
               CASE WHEN jack < 900 THEN 'fast_jack' END,
               CASE WHEN sust > 14 / 172800::DOUBLE THEN 'sustained_rate' END,
               CASE WHEN burst > 5 / 21600::DOUBLE THEN 'burst_rate' END) AS reasons
      FROM sizes z JOIN rates r USING (user_id) LEFT JOIN jack j USING (user_id)
      JOIN feet f USING (user_id) LEFT JOIN cross_n c USING (user_id))
    SELECT user_id, steps, rows AS occupied_rows, round(burst * 3600, 6) AS burst_per_hour,
      round(sust * 3600, 6) AS sustained_per_hour, chord_rows, most::BIGINT AS max_simultaneous,
      crossovers, round(jack, 6) AS fastest_jack, possible::BIGINT AS possible, reasons,
      CASE WHEN reasons <> '' THEN 'keyboard' WHEN chord_rows > 0 THEN 'hands' ELSE 'feet' END AS style
    FROM joined""",
)
def playability(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = play.playability(
        event_rows(spark, sf_dir), KEYS, ORDER, limits=LIMITS, segment=PIECE, width=EVENT_WIDTH
    )
    return report.select(
        "user_id",
        "steps",
        F.col("rows").alias("occupied_rows"),
        F.round(F.col("burst_nps") * 3600, 6).alias("burst_per_hour"),
        F.round(F.col("sustained_nps") * 3600, 6).alias("sustained_per_hour"),
        "chord_rows",
        F.col("max_simultaneous").cast("bigint").alias("max_simultaneous"),
        "crossovers",
        F.round("fastest_jack", 6).alias("fastest_jack"),
        F.col("geometrically_possible").cast("bigint").alias("possible"),
        F.array_join("reasons", ",").alias("reasons"),
        "style",
    )
