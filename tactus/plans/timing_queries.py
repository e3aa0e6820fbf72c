"""Timing maps: each customer is a song, their orders its tempo changes and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions import scalars
from tactus.operators import grid, timing
from tactus.plans.bindings import epoch_days, rounded, table
from tactus.plans.registry import query

KEY = ["song"]
PIECE = 64.0
DAY_ZERO = 8235


def tempo_map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    placed = orders.select(
        F.col("o_custkey").alias("song"),
        ((epoch_days(orders, "o_orderdate") - DAY_ZERO) / F.lit(10.0)).alias("beat"),
        "o_totalprice",
        "o_orderstatus",
    )
    tempo = placed.where("o_orderstatus <> 'F'").select(
        "song", "beat", (F.lit(60.0) + F.col("o_totalprice") % 240).alias("bpm")
    )
    stops = placed.where("o_orderstatus = 'F'").select(
        "song", "beat", (F.col("o_totalprice") % 7 / 2).alias("seconds")
    )
    songs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("song"), (F.col("c_acctbal") / 1000).alias("offset")
    )
    return tempo, stops, songs


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("song"))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        ((epoch_days(lines, "l_shipdate") - DAY_ZERO) / F.lit(10.0)).alias("beat"),
    ).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


MAP_SQL = f"""
placed AS (
  SELECT o_custkey AS song, (floor(epoch_us(o_orderdate) / 86400000000)::BIGINT - {DAY_ZERO}) / 10.0::DOUBLE AS beat,
         o_totalprice, o_orderstatus FROM orders),
tempo AS (SELECT song, beat, 60 + o_totalprice % 240 AS bpm FROM placed WHERE o_orderstatus <> 'F'),
stops AS (SELECT song, beat, o_totalprice % 7 / 2 AS seconds FROM placed WHERE o_orderstatus = 'F'),
songs AS (SELECT c_custkey AS song, c_acctbal / 1000 AS offs FROM customer),
firsts AS (SELECT song, bpm AS first_bpm FROM (
  SELECT *, row_number() OVER (PARTITION BY song ORDER BY beat, bpm) AS rn FROM tempo) WHERE rn = 1),
probes AS (
  SELECT o_custkey AS song, l_orderkey, l_linenumber,
         (floor(epoch_us(l_shipdate) / 86400000000)::BIGINT - {DAY_ZERO}) / 10.0::DOUBLE AS beat
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

POINTS_SQL = f"""{MAP_SQL},
ev AS (
  SELECT f.song, 0.0::DOUBLE AS beat, -1e12 AS declared, -1 AS kind, first_bpm AS value, -offs AS origin
  FROM firsts f JOIN songs USING (song)
  UNION ALL SELECT t.song, greatest(beat, 0.0), beat, 0, bpm, -offs FROM tempo t JOIN songs USING (song)
  UNION ALL SELECT s.song, greatest(beat, 0.0), beat, 1, seconds, -offs FROM stops s
    JOIN songs USING (song) WHERE song IN (SELECT song FROM firsts)),
ev1 AS (
  SELECT *, lag(beat) OVER w AS before, lead(beat) OVER w AS next_beat,
    last_value(CASE WHEN kind < 1 THEN value END IGNORE NULLS) OVER (PARTITION BY song
      ORDER BY beat, declared, kind, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bpm_before,
    last_value(CASE WHEN kind < 1 THEN value END IGNORE NULLS) OVER (PARTITION BY song
      ORDER BY beat, declared, kind, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bpm
  FROM ev WINDOW w AS (PARTITION BY song ORDER BY beat, declared, kind, value)),
ev2 AS (
  SELECT *, origin + sum(coalesce((beat - before) * 60 / bpm_before, 0)
      + CASE WHEN kind = 1 THEN value ELSE 0 END)
      OVER (PARTITION BY song ORDER BY beat, declared, kind, value
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t_end FROM ev1),
points AS (SELECT *, t_end - CASE WHEN kind = 1 THEN value ELSE 0 END AS t_start FROM ev2)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    tempo, stops, songs = tempo_map(spark, sf_dir)
    return timing.breakpoints(tempo, stops, songs, KEY, segment=PIECE)


@query(
    "breakpoints",
    f"""WITH {POINTS_SQL} SELECT song, kind::BIGINT AS kind, beat, round(t_start + 1e-9, 6) AS t_start,
    round(t_end + 1e-9, 6) AS t_end, round(bpm + 1e-9, 6) AS bpm, next_beat FROM points""",
)
def breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return points.select(
        "song",
        F.col("kind").cast("bigint").alias("kind"),
        "beat",
        *[rounded(c).alias(c) for c in ("t_start", "t_end", "bpm")],
        "next_beat",
    )


@query(
    "time_at_beat",
    f"""WITH {POINTS_SQL},
    uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song, beat
       ORDER BY declared DESC, kind DESC, value DESC) AS rn FROM points) WHERE rn = 1)
    SELECT p.song, l_orderkey, p.beat,
      round(CASE WHEN p.beat < 0 THEN u.origin + p.beat * 60 / u.bpm
                 ELSE u.t_end + (p.beat - u.beat) * 60 / u.bpm END + 1e-9, 6) AS time
    FROM (SELECT *, greatest(beat, 0.0) AS at FROM probes) p
    ASOF LEFT JOIN uniq u ON p.song = u.song AND p.at >= u.beat""",
)
def time_at_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timing.time_at_beat(
        probes(spark, sf_dir),
        _points(spark, sf_dir),
        KEY,
        probe_id=["l_orderkey", "l_linenumber"],
        segment=PIECE,
    )
    return found.select("song", "l_orderkey", "beat", rounded("time").alias("time"))


@query(
    "beat_at_time",
    f"""WITH {POINTS_SQL},
    tp AS (SELECT song, l_orderkey, beat * 0.4::DOUBLE AS time FROM probes),
    uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song, t_end
       ORDER BY beat DESC, declared DESC, kind DESC, value DESC) AS rn FROM points) WHERE rn = 1),
    hit AS (
      SELECT p.song, p.l_orderkey, p.time, u.beat, u.t_end, u.bpm, u.next_beat, s.offs, f.first_bpm
      FROM tp p ASOF LEFT JOIN uniq u ON p.song = u.song AND p.time >= u.t_end
      LEFT JOIN songs s ON s.song = p.song LEFT JOIN firsts f ON f.song = p.song)
    SELECT song, l_orderkey, round(time + 1e-9, 6) AS time,
      round(CASE WHEN first_bpm IS NULL THEN NULL
                 WHEN t_end IS NULL THEN (time + offs) / (60 / first_bpm)
                 ELSE least(beat + (time - t_end) / (60 / bpm), coalesce(next_beat, 1e300)) END + 1e-9, 6) AS beat
    FROM hit""",
)
def beat_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = probes(spark, sf_dir).select(
        "song", "l_orderkey", "l_linenumber", (F.col("beat") * 0.4).alias("time")
    )
    found = timing.beat_at_time(
        asked,
        _points(spark, sf_dir),
        KEY,
        probe_id=["l_orderkey", "l_linenumber"],
        segment=PIECE,
    )
    return found.select(
        "song", "l_orderkey", rounded("time").alias("time"), rounded("beat").alias("beat")
    )


@query(
    "grid_times",
    f"""WITH {POINTS_SQL},
    ends AS (SELECT song, offs, -offs + song % 4 * 0.75::DOUBLE AS duration FROM songs),
    by_time AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song, t_end
       ORDER BY beat DESC, declared DESC, kind DESC, value DESC) AS rn FROM points) WHERE rn = 1),
    reached AS (
      SELECT e.song, CASE WHEN first_bpm IS NULL THEN 0 WHEN t_end IS NULL THEN (duration + offs) / (60 / first_bpm)
        ELSE least(beat + (duration - t_end) / (60 / bpm), coalesce(next_beat, 1e300)) END AS total
      FROM ends e ASOF LEFT JOIN by_time u ON e.song = u.song AND e.duration >= u.t_end LEFT JOIN firsts f ON f.song = e.song),
    slots AS (
      SELECT song, fine, fine / 24.0::DOUBLE AS beat
      FROM (SELECT song, unnest(range(greatest(floor(greatest(total, 0) * 24), 1)::BIGINT)) AS fine FROM reached)),
    uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song, beat
       ORDER BY declared DESC, kind DESC, value DESC) AS rn FROM points) WHERE rn = 1)
    SELECT s.song, fine, round(s.beat + 1e-9, 6) AS beat, round(t_end + (s.beat - u.beat) * 60 / bpm + 1e-9, 6) AS time
    FROM slots s ASOF LEFT JOIN uniq u ON s.song = u.song AND s.beat >= u.beat""",
)
def grid_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, songs = tempo_map(spark, sf_dir)
    ends = songs.select("song", (-F.col("offset") + F.col("song") % 4 * 0.75).alias("duration"))
    found = grid.grid_times(ends, _points(spark, sf_dir), KEY, segment=PIECE)
    return found.select(
        "song", F.col("fine").cast("bigint").alias("fine"), rounded("beat").alias("beat"), rounded("time").alias("time")
    )


@query(
    "bpm_at_beat",
    f"""WITH {MAP_SQL},
    uniq AS (SELECT song, beat, max(bpm) AS bpm FROM tempo GROUP BY song, beat)
    SELECT p.song, l_orderkey, p.beat, round(coalesce(u.bpm, f.first_bpm) + 1e-9, 6) AS bpm
    FROM probes p ASOF LEFT JOIN uniq u ON p.song = u.song AND p.beat >= u.beat
    LEFT JOIN firsts f ON f.song = p.song""",
)
def bpm_at_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tempo, _, _ = tempo_map(spark, sf_dir)
    found = timing.bpm_at_beat(
        probes(spark, sf_dir), tempo, KEY, probe_id=["l_orderkey", "l_linenumber"], segment=PIECE
    )
    return found.select("song", "l_orderkey", "beat", rounded("bpm").alias("bpm"))


@query(
    "apply_warps",
    f"""WITH {MAP_SQL},
    m AS (
      SELECT song, -1e12 AS seconds, first_bpm AS bpm, -offs AS origin FROM firsts JOIN songs USING (song)
      UNION ALL SELECT t.song, beat * 0.5, bpm, -offs FROM tempo t JOIN songs USING (song)),
    a AS (SELECT *, greatest(seconds, origin) AS at_s FROM m),
    b AS (SELECT *, lag(at_s) OVER w AS pa, lag(bpm) OVER w AS pb, lead(at_s) OVER w AS na
          FROM a WINDOW w AS (PARTITION BY song ORDER BY seconds, bpm)),
    c AS (SELECT *, sum(coalesce((at_s - pa) * pb / 60, 0)) OVER (PARTITION BY song
            ORDER BY seconds, bpm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS beat FROM b)
    SELECT song, round(beat + 1e-9, 6) AS beat, round(bpm + 1e-9, 6) AS bpm FROM c
    WHERE NOT (at_s <= origin AND coalesce(na, 1e300) <= origin)""",
)
def apply_warps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tempo, _, songs = tempo_map(spark, sf_dir)
    first = timing.opening_tempo(tempo, KEY).select("song", F.col("first_bpm").alias("bpm"))
    markers = tempo.select("song", (F.col("beat") * 0.5).alias("seconds"), "bpm")
    placed = timing.apply_warps(songs.join(first, "song"), markers, KEY, segment=PIECE)
    return placed.select("song", rounded("beat").alias("beat"), rounded("bpm").alias("bpm"))


@query(
    "timing_summary",
    f"""WITH {MAP_SQL}
    SELECT t.song, round(first_bpm + 1e-9, 6) AS primary_bpm, round(min(bpm) + 1e-9, 6) AS min_bpm,
      round(max(bpm) + 1e-9, 6) AS max_bpm, (SELECT count(*) FROM stops s WHERE s.song = t.song) AS stops,
      ((SELECT count(*) FROM stops s WHERE s.song = t.song) = 0
        AND max(abs(bpm - first_bpm)) < 1e-6)::BIGINT AS constant_bpm
    FROM tempo t JOIN firsts f USING (song) GROUP BY t.song, first_bpm""",
)
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tempo, stops, _ = tempo_map(spark, sf_dir)
    found = timing.timing_summary(tempo, stops, KEY)
    return found.select(
        "song",
        *[rounded(c).alias(c) for c in ("primary_bpm", "min_bpm", "max_bpm")],
        "stops",
        F.col("constant_bpm").cast("bigint").alias("constant_bpm"),
    )


@query(
    "union_segments",
    f"""WITH {MAP_SQL}
    SELECT song, beat, round(seconds + 1e-9, 6) AS seconds, 0 AS is_delay FROM stops
    UNION ALL SELECT song, beat, round(bpm / 100 + 1e-9, 6), 1 FROM tempo""",
)
def union_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tempo, stops, _ = tempo_map(spark, sf_dir)
    delays = tempo.select("song", "beat", (F.col("bpm") / 100).alias("seconds"))
    both = timing.union_segments(
        stops.withColumn("is_delay", F.lit(0).cast("bigint")),
        delays.withColumn("is_delay", F.lit(1).cast("bigint")),
    )
    return both.select("song", "beat", rounded("seconds").alias("seconds"), "is_delay")


@query(
    "adjust_timing",
    f"""WITH {MAP_SQL}
    SELECT song, round(first_bpm * 1.5 + 1e-9, 6) AS bpm,
      round(offs - 2 * 60 / (first_bpm * 1.5) - 0.02 + 1e-9, 6) AS "offset"
    FROM songs JOIN firsts USING (song)""",
)
def adjust_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tempo, _, songs = tempo_map(spark, sf_dir)
    first = timing.opening_tempo(tempo, KEY).select("song", F.col("first_bpm").alias("bpm"))
    moved = timing.adjust_timing(
        songs.join(first, "song"), shift_beats=2.0, latency=0.02, multiply=1.5
    )
    return moved.select("song", rounded("bpm").alias("bpm"), rounded("offset").alias("offset"))


@query(
    "timing_formulas",
    """WITH b AS (SELECT c_custkey AS song, c_acctbal / 1000 AS offs,
        60 + c_acctbal % 240 + 240 * (c_acctbal < 0)::INT AS bpm FROM customer),
    p AS (SELECT *, 240 / bpm AS period, (-offs) - floor((-offs) / (240 / bpm)) * (240 / bpm) AS within FROM b),
    q AS (SELECT *, floor(within / period * 96)::BIGINT % 96 AS phase FROM p)
    SELECT song, phase, round(-((phase + 0.5) / 96) * period + 1e-9, 6) AS centre,
      round(-offs * 1000 + 1e-9, 6) AS gap, round(-(offs * 250) / 1000 + 1e-9, 6) AS offset_of_gap,
      least(abs(phase - 48), 96 - abs(phase - 48))::BIGINT AS from_half,
      round(exp(-0.5 * pow(log2(bpm / 140) / 0.8, 2)) + 1e-9, 6) AS prior,
      round(CASE WHEN abs(round_even(bpm * 2, 0) / 2 - bpm) <= 0.2
                 THEN round_even(bpm * 2, 0) / 2 ELSE bpm END + 1e-9, 6) AS snapped
    FROM q""",
)
def timing_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    songs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("song"),
        (balance / 1000).alias("offs"),
        (F.lit(60.0) + balance % 240 + F.when(balance < 0, 240.0).otherwise(0.0)).alias("bpm"),
    )
    phase = scalars.phase_of_offset(F.col("offs"), F.col("bpm"))
    timed = songs.withColumn("phase", phase.cast("bigint"))
    return timed.select(
        "song",
        "phase",
        rounded(scalars.offset_for_phase(F.col("phase"), F.col("bpm"))).alias("centre"),
        rounded(scalars.offset_to_gap(F.col("offs"))).alias("gap"),
        rounded(scalars.gap_to_offset(F.col("offs") * 250)).alias("offset_of_gap"),
        scalars.cyclic_distance(F.col("phase"), F.lit(48)).cast("bigint").alias("from_half"),
        rounded(scalars.tempo_prior(F.col("bpm"))).alias("prior"),
        rounded(scalars.snap_bpm(F.col("bpm"), 0.2)).alias("snapped"),
    )
