"""Folding and drift over events: each event type is a series of hourly frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.operators import drift, grid, selection, series
from tactus.plans.bindings import drawn_sql, epoch_seconds, rounded, table
from tactus.plans.registry import query

START = 1704067200
KEY = ["song"]
PIECE = 256.0


def big(*names: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in names]


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of values per event type and hour, with the empty hours in between."""
    events = table(spark, sf_dir, "events")
    hour = F.floor((epoch_seconds(events, "ts") - F.lit(START)) / F.lit(3600.0))
    sums = events.select(F.col("event_type").alias("song"), hour.alias("frame"), "value")
    found = sums.groupBy("song", "frame").agg(F.sum("value").alias("value"))
    grid_rows = (
        found.groupBy("song")
        .agg(F.max("frame").alias("top"))
        .select("song", F.explode(F.sequence(F.lit(0).cast("bigint"), "top")).alias("frame"), F.lit(0.0).alias("value"))
    )
    return found.unionByName(grid_rows).groupBy("song", "frame").agg(F.round(F.sum("value"), 2).alias("value"))


FRAMES_SQL = f"""
hs AS (SELECT event_type AS song, floor((epoch_us(ts) / 1e6 - {START}) / 3600)::BIGINT AS frame, sum(value) AS v FROM events GROUP BY 1, 2),
tops AS (SELECT song, max(frame) AS top FROM hs GROUP BY song),
frames AS (SELECT t.song, g.i AS frame, round(coalesce(h.v, 0), 2) AS value
  FROM tops t CROSS JOIN generate_series(0, 719) g(i) LEFT JOIN hs h ON h.song = t.song AND h.frame = g.i WHERE g.i <= t.top),
n AS (SELECT song, max(frame) + 1 AS n FROM frames GROUP BY song)"""


def fold_sql(source: str, keys: str, period: str, bins: int) -> str:
    """Profile of ``source`` (keys, frame, value) folded on a period in frames."""
    return f"""
fb AS (SELECT {keys}, floor((frame::DOUBLE % {period}) / {period} * {bins})::BIGINT % {bins} AS bin, avg(value) AS m
  FROM {source} GROUP BY {keys}, bin),
dense AS (SELECT k.*, g.i AS bin, coalesce(fb.m, 0) AS m FROM (SELECT DISTINCT {keys} FROM {source}) k
  CROSS JOIN generate_series(0, {bins - 1}) g(i) LEFT JOIN fb ON fb.bin = g.i AND {" AND ".join(f"fb.{c} = k.{c}" for c in keys.split(", "))}),
cen AS (SELECT *, m - avg(m) OVER (PARTITION BY {keys}) AS c FROM dense),
prof AS (SELECT {keys}, bin, c / greatest(max(abs(c)) OVER (PARTITION BY {keys}), 1e-6) AS profile FROM cen)"""


@query(
    "fold_profile",
    f"""WITH {FRAMES_SQL}, {fold_sql("frames", "song", "23.7::DOUBLE", 96)}
    SELECT song, bin, round(profile + 1e-9, 6) AS profile FROM prof""",
)
def fold_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.fold_profile(hourly(spark, sf_dir), KEY, F.lit(23.7), fps=1.0)
    return found.select("song", *big("bin"), rounded("profile").alias("profile"))


CANDS_SQL = "cands AS (SELECT i AS candidate, 2.0::DOUBLE * pow(1.05, i) AS bpm FROM generate_series(0, 32) g(i))"
SCORES_SQL = """
fr AS (SELECT song, candidate, bpm, floor((frame * (bpm / 60) - floor(frame * (bpm / 60))) * 64) AS bin, value FROM {source}, cands),
fm AS (SELECT song, candidate, bpm, bin, avg(value) AS m FROM fr GROUP BY 1, 2, 3, 4),
sc AS (SELECT song, candidate, bpm, greatest(max(m), 0) AS score FROM fm GROUP BY 1, 2, 3)"""


@query(
    "fold_scores",
    f"""WITH {FRAMES_SQL}, {CANDS_SQL}, {SCORES_SQL.format(source="frames")}
    SELECT song, candidate, round(bpm + 1e-9, 6) AS bpm, round(score + 1e-9, 6) AS score FROM sc""",
)
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.fold_scores(hourly(spark, sf_dir), KEY, series.tempi(2.0, 10.0, 1.05), fps=1.0)
    return found.select("song", *big("candidate"), rounded("bpm").alias("bpm"), rounded("score").alias("score"))


COARSE_SQL = f"""{FRAMES_SQL}, {CANDS_SQL},
cutf AS (SELECT f.song, f.frame - greatest((n - 360) // 2, 0) AS frame, value FROM frames f JOIN n USING (song)
  WHERE f.frame >= greatest((n - 360) // 2, 0) AND f.frame < greatest((n - 360) // 2, 0) + 360),
{SCORES_SQL.format(source="cutf")},
ws AS (SELECT *, score * exp(-0.5 * pow(log2(bpm / 140) / 0.8, 2)) AS w FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY w DESC, candidate) AS r FROM ws),
coarse AS (SELECT song, max(CASE WHEN r = 1 THEN bpm END) AS bpm, max(CASE WHEN r = 1 THEN w END) / max(CASE WHEN r = 2 THEN w END) AS confidence FROM rk GROUP BY song)"""


@query(
    "coarse_tempo",
    f"WITH {COARSE_SQL} SELECT song, round(bpm + 1e-9, 6) AS bpm, round(confidence + 1e-9, 6) AS confidence FROM coarse",
)
def coarse_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.coarse_tempo(
        hourly(spark, sf_dir), KEY, fps=1.0, low=2.0, high=10.0, step=1.05, excerpt=360.0
    )
    return found.select("song", rounded("bpm").alias("bpm"), rounded("confidence").alias("confidence"))


def tried(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames = hourly(spark, sf_dir)
    ladder = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.lit(2.4) + i * F.lit(0.05))
    songs = frames.select("song").distinct()
    return frames, songs.select("song", F.posexplode(ladder).alias("candidate", "bpm"))


TOTALS_SQL = """
prm AS (SELECT t.song, candidate, bpm, n, 60 / bpm AS period, greatest(floor(60 / bpm * 8), 32)::BIGINT AS steps, floor(n / (60 / bpm))::BIGINT AS beats
  FROM tried t JOIN n USING (song) WHERE n > 60 / bpm),
pts AS (SELECT song, candidate, bpm, n, steps, beats, m, m * (period / steps) AS x FROM (SELECT *, unnest(range(0, steps * beats)) AS m FROM prm)),
smp AS (SELECT p.song, candidate, bpm, steps, beats, m % steps AS phase,
    CASE WHEN x > n - 1 THEN 0 ELSE a.value + (x - floor(x)) * (coalesce(b.value, a.value) - a.value) END AS v
  FROM pts p LEFT JOIN frames a ON a.song = p.song AND a.frame = floor(p.x)::BIGINT LEFT JOIN frames b ON b.song = p.song AND b.frame = floor(p.x)::BIGINT + 1),
tot AS (SELECT song, candidate, bpm, steps, phase, sum(v) / any_value(beats) AS total FROM smp GROUP BY 1, 2, 3, 4, 5),
ali AS (SELECT song, candidate, bpm, max(total) AS alignment FROM tot GROUP BY 1, 2, 3)"""


@query(
    "alignment",
    f"""WITH {FRAMES_SQL}, tried AS (SELECT song, i AS candidate, 2.4::DOUBLE + i * 0.05::DOUBLE AS bpm FROM tops, generate_series(0, 8) g(i)), {TOTALS_SQL}
    SELECT song, candidate, round(bpm + 1e-9, 6) AS bpm, round(alignment + 1e-9, 6) AS alignment FROM ali""",
)
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, candidates = tried(spark, sf_dir)
    found = series.alignment(frames, candidates, KEY, fps=1.0, segment=PIECE)
    return found.select("song", *big("candidate"), rounded("bpm").alias("bpm"), rounded("alignment").alias("alignment"))


@query(
    "refine_tempo",
    f"""WITH {FRAMES_SQL}, tried AS (SELECT song, i AS candidate, 2.5::DOUBLE * (0.997::DOUBLE + i * (0.006::DOUBLE / 20)) AS bpm FROM tops, generate_series(0, 20) g(i)), {TOTALS_SQL},
    best AS (SELECT song, bpm FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY alignment DESC, candidate) AS r FROM ali) WHERE r = 1)
    SELECT song, round(bpm + 1e-9, 6) AS bpm FROM best""",
)
def refine_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = hourly(spark, sf_dir)
    start = frames.select("song").distinct().withColumn("bpm", F.lit(2.5))
    found = series.refine_tempo(frames, start, KEY, fine=(21,), fps=1.0, segment=PIECE)
    return found.select("song", rounded("bpm").alias("bpm"))


@query(
    "snap_if_fits",
    f"""WITH {FRAMES_SQL}, tried AS (SELECT song, c AS candidate, CASE c WHEN 0 THEN 2.4::DOUBLE + length(song) * 0.02 ELSE 2.5 END AS bpm FROM tops, (VALUES (0), (1)) v(c)), {TOTALS_SQL}
    SELECT a.song, round(CASE WHEN b.alignment >= a.alignment * 0.75 THEN b.bpm ELSE a.bpm END + 1e-9, 6) AS bpm
    FROM ali a JOIN ali b ON a.song = b.song AND a.candidate = 0 AND b.candidate = 1""",
)
def snap_if_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = hourly(spark, sf_dir)
    start = frames.select("song").distinct().withColumn("bpm", F.lit(2.4) + F.length("song") * F.lit(0.02))
    found = series.snap_if_fits(frames, start, KEY, fps=1.0, segment=PIECE)
    return found.select("song", rounded("bpm").alias("bpm"))


@query(
    "estimate_phase",
    f"""WITH {FRAMES_SQL}, tried AS (SELECT song, 0 AS candidate, 2.5::DOUBLE + length(song) * 0.01 AS bpm FROM tops), {TOTALS_SQL},
    pk AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY total DESC, phase) AS r FROM tot),
    nb AS (SELECT p.song, p.bpm, p.steps, p.phase, p.total AS y, b.total AS yb, a.total AS ya FROM pk p
      JOIN tot b ON b.song = p.song AND b.phase = (p.phase - 1 + p.steps) % p.steps JOIN tot a ON a.song = p.song AND a.phase = (p.phase + 1) % p.steps WHERE r = 1),
    sh AS (SELECT *, 60 / bpm AS period, (phase + CASE WHEN yb - 2 * y + ya = 0 THEN 0 ELSE 0.5 * (yb - ya) / (yb - 2 * y + ya) END) * (60 / bpm) / steps AS s FROM nb)
    SELECT song, round(bpm + 1e-9, 6) AS bpm, round(-((s - floor(s / period) * period) - 0.0046) + 1e-9, 6) AS "offset" FROM sh""",
)
def estimate_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = hourly(spark, sf_dir)
    tempo = frames.select("song").distinct().withColumn("bpm", F.lit(2.5) + F.length("song") * F.lit(0.01))
    found = series.estimate_phase(frames, tempo, KEY, fps=1.0, segment=PIECE)
    return found.select("song", rounded("bpm").alias("bpm"), rounded("offset").alias("offset"))


@query("estimate_timing")
def estimate_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.estimate_timing(
        hourly(spark, sf_dir), KEY, fps=1.0, low=2.0, high=10.0, step=1.05, excerpt=360.0,
        fine=(21, 11), segment=PIECE,
    )


KICK_SQL = f"""{FRAMES_SQL},
kb AS (SELECT song, 2.5::DOUBLE + length(song) * 0.013 AS bpm FROM tops),
kf AS (SELECT song, bpm, 60 / bpm AS period, floor((frame::DOUBLE % (60 / bpm)) / (60 / bpm) * 96)::BIGINT % 96 AS bin, avg(value) AS m
  FROM frames JOIN kb USING (song) GROUP BY 1, 2, 3, 4),
kd AS (SELECT kb.song, kb.bpm, 60 / kb.bpm AS period, g.i AS bin, coalesce(m, 0) AS m FROM kb CROSS JOIN generate_series(0, 95) g(i) LEFT JOIN kf ON kf.song = kb.song AND kf.bin = g.i),
kp AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY m DESC, bin) AS r, median(m) OVER (PARTITION BY song) AS med FROM kd),
kn AS (SELECT p.*, b.m AS yb, a.m AS ya FROM kp p JOIN kd b ON b.song = p.song AND b.bin = (p.bin + 95) % 96 JOIN kd a ON a.song = p.song AND a.bin = (p.bin + 1) % 96 WHERE r = 1),
ks AS (SELECT *, (bin + 0.5 + CASE WHEN yb - 2 * m + ya = 0 THEN 0 ELSE 0.5 * (yb - ya) / (yb - 2 * m + ya) END) / 96 * period - 0.0259 AS s FROM kn),
kick AS (SELECT song, bpm, period, s - floor(s / period) * period AS seconds, m / greatest(med, 1e-9) AS clarity FROM ks)"""


def _kicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = hourly(spark, sf_dir).withColumn("bpm", F.lit(2.5) + F.length("song") * F.lit(0.013))
    return series.kick_phase(frames, KEY, fps=1.0)


@query(
    "kick_phase",
    f"WITH {KICK_SQL} SELECT song, round(seconds + 1e-9, 6) AS seconds, round(clarity + 1e-9, 6) AS clarity FROM kick",
)
def kick_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _kicks(spark, sf_dir)
    return found.select("song", rounded("seconds").alias("seconds"), rounded("clarity").alias("clarity"))


def weights(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Share of a type's value in each quarter hour of the day: 96 bins."""
    events = table(spark, sf_dir, "events")
    seconds = epoch_seconds(events, "ts")
    base = events.select(
        F.col("event_type").alias("song"),
        F.floor(F.pmod(seconds, F.lit(86400.0)) / F.lit(900.0)).cast("int").alias("bin"),
        F.floor((seconds - F.lit(START)) / F.lit(604800.0)).alias("excerpt"),
        "value",
    )
    return base.groupBy("song", *more, "bin").agg(F.round(F.sum("value"), 2).alias("weight"))


WEIGHTS_SQL = f"""
wt AS (SELECT event_type AS song, floor((epoch_us(ts) / 1e6 - floor(epoch_us(ts) / 86400000000) * 86400) / 900)::BIGINT AS bin, round(sum(value), 2) AS weight FROM events GROUP BY 1, 2),
wd AS (SELECT s.song, g.i AS bin, coalesce(weight, 0) AS w FROM (SELECT DISTINCT song FROM wt) s CROSS JOIN generate_series(0, 95) g(i) LEFT JOIN wt ON wt.song = s.song AND wt.bin = g.i),
pool AS (SELECT song, bin % 24 AS b, sum(w) AS w FROM wd GROUP BY 1, 2)"""


@query(
    "half_beat_rivalry",
    f"""WITH {WEIGHTS_SQL}, p AS (SELECT DISTINCT song, length(song) * 7 AS phase FROM wt)
    SELECT p.song, round(sum(CASE WHEN least(abs(b - (phase + 12) % 24), 24 - abs(b - (phase + 12) % 24)) <= 2 THEN w ELSE 0 END)
      / greatest(sum(CASE WHEN least(abs(b - phase % 24), 24 - abs(b - phase % 24)) <= 2 THEN w ELSE 0 END), 1e-9) + 1e-9, 6) AS rivalry
    FROM p JOIN pool ON pool.song = p.song GROUP BY p.song""",
)
def half_beat_rivalry(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = weights(spark, sf_dir).withColumn("phase", F.length("song") * 7)
    found = series.half_beat_rivalry(table_, KEY)
    return found.select("song", rounded("rivalry").alias("rivalry"))


@query(
    "refine_offset",
    f"""WITH {KICK_SQL}, {WEIGHTS_SQL},
    a AS (SELECT k.*, floor(seconds / period * 24)::BIGINT % 24 AS kb FROM kick k),
    riv AS (SELECT a.song, sum(CASE WHEN least(abs(b - (kb + 12) % 24), 24 - abs(b - (kb + 12) % 24)) <= 2 THEN w ELSE 0 END)
      / greatest(sum(CASE WHEN least(abs(b - kb), 24 - abs(b - kb)) <= 2 THEN w ELSE 0 END), 1e-9) AS r FROM a JOIN pool ON pool.song = a.song GROUP BY a.song),
    top AS (SELECT song, bin AS phase, w FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY w DESC, bin) AS rn FROM wd) WHERE rn = 1),
    bm AS (SELECT a.song, q.beat, sum(CASE WHEN least(abs(bin - (kb + q.beat * 24) % 96), 96 - abs(bin - (kb + q.beat * 24) % 96)) <= 11 THEN w ELSE 0 END) AS mass
      FROM a JOIN wd ON wd.song = a.song, (VALUES (0), (1), (2), (3)) q(beat) GROUP BY 1, 2),
    bb AS (SELECT song, beat FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY mass DESC, beat) AS rn FROM bm) WHERE rn = 1),
    j AS (SELECT a.*, clarity < 10 AND (r > 1 OR clarity < 2) AS over_, phase, beat, top.w AS tw FROM a JOIN riv USING (song) JOIN top USING (song) JOIN bb USING (song))
    SELECT j.song, CASE WHEN over_ THEN 'model' ELSE 'kick' END AS source,
      round(CASE WHEN over_ THEN -((phase + 0.5) / 96) * 4 * period ELSE -(seconds + beat * period) END + 1e-9, 6) AS "offset",
      round(CASE WHEN over_ THEN tw ELSE wd.w END + 1e-9, 6) AS weight
    FROM j JOIN wd ON wd.song = j.song AND wd.bin = (kb + beat * 24) % 96""",
)
def refine_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.refine_offset(_kicks(spark, sf_dir), weights(spark, sf_dir), KEY)
    return found.select("song", "source", rounded("offset").alias("offset"), rounded("weight").alias("weight"))


@query(
    "excerpt_profiles",
    f"""WITH {FRAMES_SQL}, ex AS (SELECT f.song, frame // 168 AS excerpt, frame, value FROM frames f JOIN n USING (song) WHERE frame // 168 * 168 < greatest(n - 168, 1)),
    {fold_sql("ex", "song, excerpt", "24.0::DOUBLE", 24)}
    SELECT song, excerpt, bin, round(profile + 1e-9, 6) AS profile FROM prof""",
)
def excerpt_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.excerpt_profiles(
        hourly(spark, sf_dir), KEY, KEY, F.lit(24.0), fps=1.0, excerpt=168.0, bins=24
    )
    return found.select("song", *big("excerpt", "bin"), rounded("profile").alias("profile"))


@query(
    "predict_phase",
    f"""WITH w AS (SELECT event_type AS song, floor((epoch_us(ts) / 1e6 - {START}) / 604800) AS excerpt,
        floor((epoch_us(ts) / 1e6 - floor(epoch_us(ts) / 86400000000) * 86400) / 900)::BIGINT AS bin, round(sum(value), 2) AS weight FROM events GROUP BY 1, 2, 3),
    m AS (SELECT song, bin, avg(weight) AS w FROM w GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY w DESC, bin) AS rn FROM m)
    SELECT song, bin AS phase, round(w + 1e-9, 6) AS weight FROM r WHERE rn = 1""",
)
def predict_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.predict_phase(weights(spark, sf_dir, "excerpt"), KEY)
    return found.select("song", *big("phase"), rounded("weight").alias("weight"))


TRACK_SQL = f"""{FRAMES_SQL},
wn AS (SELECT song, n, ceil(greatest(n - 72, 12) / 12.0)::BIGINT AS cnt FROM n),
wf AS (SELECT f.song, g.w, f.frame, f.value, w * 12 + (frame - w * 12) AS t FROM frames f JOIN wn USING (song), generate_series(0, 60) g(w)
  WHERE g.w < cnt AND f.frame >= g.w * 12 AND f.frame < least(g.w * 12 + 72, n)),
wm AS (SELECT *, avg(value) OVER (PARTITION BY song, w) AS mean, count(*) OVER (PARTITION BY song, w) AS c FROM wf),
wg AS (SELECT song, w, sum(greatest(value - mean, 0)) AS total, sum(greatest(value - mean, 0) * cos(2 * pi() * t / 24)) AS x,
  sum(greatest(value - mean, 0) * sin(2 * pi() * t / 24)) AS y FROM wm WHERE c >= 8 GROUP BY 1, 2),
ph AS (SELECT song, w * 12 + 36.0::DOUBLE AS centre, (atan2(y, x) / (2 * pi()) - floor(atan2(y, x) / (2 * pi()))) * 24 AS raw FROM wg WHERE total > 0),
dj AS (SELECT *, raw - lag(raw) OVER (PARTITION BY song ORDER BY centre) AS d FROM ph),
fx AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < 12 THEN 0 ELSE (d + 12 - floor((d + 12) / 24) * 24 - 12) - d END AS fix FROM dj),
track AS (SELECT song, centre, raw + sum(fix) OVER (PARTITION BY song ORDER BY centre) AS phase FROM fx)"""


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.phase_track(
        hourly(spark, sf_dir), KEY, F.lit(24.0), fps=1.0, window=72.0, hop=12.0, segment=PIECE
    )


@query("phase_track", f"WITH {TRACK_SQL} SELECT song, centre, round(phase + 1e-9, 6) AS phase FROM track")
def phase_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _track(spark, sf_dir).select("song", "centre", rounded("phase").alias("phase"))


LOCAL_SQL = f"""{TRACK_SQL},
ti AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY centre) - 1 AS i, count(*) OVER (PARTITION BY song) AS c FROM track),
lt AS (SELECT *, regr_slope(phase, centre) OVER w AS slope, last_value(centre) OVER w AS stop FROM ti
  WINDOW w AS (PARTITION BY song ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
readings AS (SELECT song, centre + (stop - centre) / 2 AS seconds, 2.5::DOUBLE * (1 - slope) AS bpm, slope * (stop - centre) AS slip FROM lt WHERE i % 5 = 0 AND i < c - 20)"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.local_tempo(_track(spark, sf_dir), KEY, F.lit(2.5), span=240.0, hop=12.0, segment=PIECE)


@query(
    "local_tempo",
    f"""WITH {LOCAL_SQL} SELECT song, seconds, round(bpm + 1e-9, 6) AS bpm, round(slip + 1e-9, 6) AS slip FROM readings""",
)
def local_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(spark, sf_dir).select("song", "seconds", rounded("bpm").alias("bpm"), rounded("slip").alias("slip"))


@query(
    "drift_report",
    f"""WITH {LOCAL_SQL} SELECT song, round(min(bpm) + 1e-9, 6) AS min_bpm, round(max(bpm) + 1e-9, 6) AS max_bpm,
    round(avg(bpm) + 1e-9, 6) AS mean_bpm, count(*) AS stretches, count(*) FILTER (WHERE abs(slip) >= 1.5) AS slipping FROM readings GROUP BY song""",
)
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.drift_report(_readings(spark, sf_dir), KEY, 1.5)
    return found.select("song", *[rounded(c).alias(c) for c in ("min_bpm", "max_bpm", "mean_bpm")], "stretches", "slipping")


@query(
    "phase_excerpts",
    f"""WITH {FRAMES_SQL}, so AS (SELECT song, n, (length(song) * 7919) % greatest(n - 168, 1) AS s FROM n),
    ex AS (SELECT f.song, f.frame, f.value FROM frames f JOIN so USING (song) WHERE frame >= s AND frame < s + 168),
    {fold_sql("ex", "song", "96.0::DOUBLE", 48)}
    SELECT song, bin, round(profile + 1e-9, 6) AS profile, floor((length(song) * 1.7 + 0.0) / 96 * 48)::BIGINT % 48 AS label FROM prof""",
)
def phase_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = hourly(spark, sf_dir)
    songs = frames.select("song").distinct().select(
        "song", F.lit(2.5).alias("bpm"), (F.length("song") * F.lit(-1.7)).alias("offset"), F.length("song").alias("place")
    )
    found = series.phase_excerpts(
        frames, songs, KEY, fps=1.0, excerpt=168.0, bins=48, validation=True, index="place"
    )
    return found.select("song", *big("bin", "label"), rounded("profile").alias("profile"))


@query(
    "phase_excerpts_training",
    f"""WITH {FRAMES_SQL}, so AS (SELECT song, g.i - 1 AS excerpt, {drawn_sql("'3/' || song || '/' || g.i")} % greatest(n - 168, 1) AS s FROM n, generate_series(1, 8) g(i)),
    ex AS (SELECT f.song, excerpt, f.frame, f.value FROM frames f JOIN so USING (song) WHERE frame >= s AND frame < s + 168),
    {fold_sql("ex", "song, excerpt", "96.0::DOUBLE", 48)}
    SELECT song, excerpt, bin, round(profile + 1e-9, 6) AS profile, floor((length(song) * 1.7 + 0.0) / 96 * 48)::BIGINT % 48 AS label FROM prof""",
)
def phase_excerpts_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = hourly(spark, sf_dir)
    songs = frames.select("song").distinct().select(
        "song", F.lit(2.5).alias("bpm"), (F.length("song") * F.lit(-1.7)).alias("offset")
    )
    found = series.phase_excerpts(frames, songs, KEY, seed=3, fps=1.0, excerpt=168.0, bins=48)
    return found.select("song", *big("excerpt", "bin", "label"), rounded("profile").alias("profile"))


# --- spectral frames: blocks of a hundred embeddings are songs, their components the bands ---


def band_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 100).alias("song"), (F.col("vec_id") % 100).alias("frame"), F.col("embedding").alias("bands")
    )


BANDS_SQL = "bf AS (SELECT vec_id // 100 AS song, vec_id % 100 AS frame, embedding AS bands FROM embeddings)"
FLUX_SQL = f"""{BANDS_SQL},
lg AS (SELECT *, lag(bands) OVER (PARTITION BY song ORDER BY frame) AS before FROM bf),
fl AS (SELECT song, frame, CASE WHEN before IS NULL THEN 0 ELSE list_median(list_transform(range(1, len(bands) + 1), lambda i: greatest((bands[i] - before[i])::DOUBLE, 0))) END AS flux FROM lg)"""


@query("onset_flux", f"WITH {FLUX_SQL} SELECT song, frame, round(flux + 1e-9, 6) AS flux FROM fl")
def onset_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.onset_flux(band_frames(spark, sf_dir), KEY, segment=32.0)
    return found.select("song", "frame", rounded("flux").alias("flux"))


@query(
    "scale_bands",
    f"""WITH {BANDS_SQL}, u AS (SELECT song, frame, unnest(range(0, len(bands))) AS band, unnest(bands)::DOUBLE AS v FROM bf)
    SELECT song, frame, band, round(v / greatest(max(v) OVER (PARTITION BY song, band), 1e-6) + 1e-9, 6) AS value FROM u""",
)
def scale_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = band_frames(spark, sf_dir).select("song", "frame", F.posexplode("bands").alias("band", "v"))
    long = long.select("song", "frame", "band", F.col("v").cast("double").alias("value"))
    found = series.scale_bands(long, ["song", "band"])
    return found.select("song", "frame", *big("band"), rounded("value").alias("value"))


EDGES_SQL = f"""{FLUX_SQL},
nf AS (SELECT song, max(frame) + 1 AS n FROM bf GROUP BY song),
ed AS (SELECT song, i AS slot, n, greatest(0, least(floor(i * (0.009 + 0.003 * (song % 3)) * 172.265625), n - 1))::BIGINT AS first FROM nf, generate_series(0, 59) g(i)),
eg AS (SELECT *, greatest(coalesce(lead(first) OVER (PARTITION BY song ORDER BY slot), n), first + 1) AS stop FROM ed),
asg AS (SELECT e.song, e.slot, b.frame, b.bands, fl.flux FROM eg e JOIN bf b ON b.song = e.song AND b.frame >= e.first AND b.frame < e.stop JOIN fl ON fl.song = b.song AND fl.frame = b.frame)"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = band_frames(spark, sf_dir)
    flux = series.onset_flux(frames, KEY, segment=32.0)
    counts = series.lengths(frames, KEY)
    time = F.col("slot") * (F.lit(0.009) + F.lit(0.003) * (F.col("song") % 3))
    slots = counts.select("song", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("slot")).withColumn("time", time)
    edges = grid.frame_edges(slots, KEY, counts)
    return grid.assign_frames(frames.join(flux, ["song", "frame"]), edges, KEY)


@query("frames_in_slots", f"WITH {EDGES_SQL} SELECT song, slot, frame, round(flux + 1e-9, 6) AS flux FROM asg")
def frames_in_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("song", *big("slot", "frame"), rounded("flux").alias("flux"))


def text_list(column: str | Column) -> Column:
    return F.array_join(F.transform(column, lambda x: F.format_string("%.4f", x + F.lit(1e-9))), ",")


@query(
    "slot_features",
    f"""WITH {EDGES_SQL}, u AS (SELECT song, slot, unnest(range(0, 64)) AS band, unnest(bands)::DOUBLE AS v FROM asg),
    m AS (SELECT song, slot, band, avg(v) AS m FROM u GROUP BY 1, 2, 3),
    t AS (SELECT song, slot, string_agg(printf('%.4f', m + 1e-9), ',' ORDER BY band) AS bands FROM m GROUP BY 1, 2),
    o AS (SELECT song, slot, avg(flux) AS a, max(flux) AS b FROM asg GROUP BY 1, 2)
    SELECT song, slot, replace(bands, '-0.0000', '0.0000') AS bands, round(a + 1e-9, 6) AS onset_mean, round(b + 1e-9, 6) AS onset_max FROM t JOIN o USING (song, slot)""",
)
def slot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.slot_features(assigned(spark, sf_dir), ["song", "slot"], onset="flux", width=64)
    bands = F.replace(text_list("bands"), F.lit("-0.0000"), F.lit("0.0000"))
    return found.select(
        "song", *big("slot"), bands.alias("bands"), rounded("onset_mean").alias("onset_mean"), rounded("onset_max").alias("onset_max")
    )


@query(
    "slot_loudness",
    f"""WITH {BANDS_SQL}, g AS (SELECT song, frame // 2 AS slot, max(list_max(bands)) AS l, count(*) AS c FROM bf GROUP BY 1, 2)
    SELECT song, slot, round(l::DOUBLE + 1e-9, 6) AS loudness FROM g WHERE c = 2""",
)
def slot_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.slot_loudness(band_frames(spark, sf_dir), KEY, fine="frame")
    return found.select("song", *big("slot"), rounded(F.col("loudness").cast("double")).alias("loudness"))


@query(
    "pool_measures",
    f"""WITH {BANDS_SQL}, u AS (SELECT song, frame // 16 AS measure, frame, unnest(range(0, 64)) AS band, unnest(bands)::DOUBLE / 80 AS v FROM bf),
    m AS (SELECT song, measure, band, avg(v) AS a, max(v) AS b, count(*) AS c FROM u GROUP BY 1, 2, 3),
    w AS (SELECT * FROM m WHERE c = 16), k AS (SELECT song, count(DISTINCT measure) AS n FROM w GROUP BY 1)
    SELECT song, measure, replace(string_agg(printf('%.4f', a + 1e-9), ',' ORDER BY band), '-0.0000', '0.0000') AS means,
      replace(string_agg(printf('%.4f', b + 1e-9), ',' ORDER BY band), '-0.0000', '0.0000') AS peaks,
      round(measure / (any_value(n) - 1) + 1e-9, 6) AS position FROM w JOIN k USING (song) GROUP BY song, measure""",
)
def pool_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.pool_measures(band_frames(spark, sf_dir), KEY, slot="frame", values="bands", width=64, per_measure=16)
    texts = [F.replace(text_list(c), F.lit("-0.0000"), F.lit("0.0000")).alias(n) for c, n in (("mean", "means"), ("peak", "peaks"))]
    return found.select("song", *big("measure"), *texts, rounded("position").alias("position"))


@query(
    "join_layers",
    f"""WITH {BANDS_SQL}, u AS (SELECT song, frame AS slot, unnest(range(0, 64)) AS band, unnest(bands)::DOUBLE AS v FROM bf),
    t AS (SELECT song, slot, replace(string_agg(printf('%.4f', v + 1e-9), ',' ORDER BY band), '-0.0000', '0.0000') || ',0.5000,1.0000' AS bands FROM u GROUP BY 1, 2),
    z AS (SELECT string_agg('0.0000', ',') AS none FROM range(0, 66))
    SELECT song, slot, CASE WHEN slot % 2 = 0 THEN bands ELSE none END || ',' || CASE WHEN slot % 3 = 0 THEN bands ELSE none END AS features FROM t, z WHERE slot % 2 = 0 OR slot % 3 = 0""",
)
def join_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = band_frames(spark, sf_dir)

    def layer(name: str, keep: Column) -> DataFrame:
        return frames.where(keep).select(
            "song", F.col("frame").alias("slot"), F.lit(name).alias("layer"), F.col("bands").cast("array<double>").alias("bands"),
            F.lit(0.5).alias("onset_mean"), F.lit(1.0).alias("onset_max"),
        )

    both = layer("drums", F.col("frame") % 2 == 0).unionByName(layer("mixture", F.col("frame") % 3 == 0))
    found = grid.join_layers(both, ["song", "slot"], layers=(("drums", 64), ("mixture", 64)))
    return found.select("song", *big("slot"), F.replace(text_list("features"), F.lit("-0.0000"), F.lit("0.0000")).alias("features"))


# --- slot selection: hours of a type are slots, their values the scores, days the measures ---

DAYS_SQL = f"""{FRAMES_SQL},
ms AS (SELECT song, frame // 24 AS measure, max(value) AS loudest, arg_max(frame, value * 1000000 - frame) AS slot FROM frames GROUP BY 1, 2),
med AS (SELECT song, median(loudest) AS m FROM ms GROUP BY song),
mad AS (SELECT song, median(abs(loudest - m)) AS d, any_value(m) AS m, min(loudest) AS lo FROM ms JOIN med USING (song) GROUP BY song),
thr AS (SELECT song, CASE WHEN d <= 0 THEN lo - 1 ELSE m - 6 * d END AS threshold FROM mad)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("song", F.col("frame").alias("slot"), F.col("value").alias("score"))


@query("silence_threshold", f"WITH {DAYS_SQL} SELECT song, round(threshold + 1e-9, 6) AS threshold FROM thr")
def silence_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = selection.strongest_slots(_scores(spark, sf_dir), KEY, per_measure=24)
    found = selection.silence_threshold(best, KEY, segment=50.0)
    return found.select("song", rounded("threshold").alias("threshold"))


@query(
    "seed_pulse",
    f"""WITH {DAYS_SQL}, best AS (SELECT * FROM (SELECT song, frame // 24 AS measure, frame AS slot, value AS loudest,
      row_number() OVER (PARTITION BY song, frame // 24 ORDER BY value DESC, frame) AS r FROM frames) WHERE r = 1)
    SELECT b.song, measure, slot FROM best b JOIN thr USING (song) JOIN n USING (song) WHERE loudest > threshold AND ceil(n / 24) >= 2 AND 25 + length(song) >= ceil(n / 24)""",
)
def seed_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = series.lengths(hourly(spark, sf_dir), KEY).select(
        "song", F.col("frame_count").alias("slot_count"), (F.length("song") + 25).alias("wanted")
    )
    found = selection.seed_pulse(_scores(spark, sf_dir), songs, KEY, per_measure=24, segment=50.0)
    return found.select("song", *big("measure", "slot"))


@query(
    "on_grid",
    f"WITH {FRAMES_SQL} SELECT song, frame AS slot, value AS score FROM frames WHERE frame % 12 % 3 = 0 OR frame % 12 % 4 = 0",
)
def on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.on_grid(_scores(spark, sf_dir), triplets=True)


@query(
    "audible",
    f"WITH {FRAMES_SQL} SELECT song, frame AS slot, value AS score FROM frames WHERE frame >= 600 OR value / 10 - 80 > -70",
)
def audible(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    loud = scores.where("slot < 600").select("song", "slot", (F.col("score") / 10 - 80).alias("loudness"))
    return selection.audible(scores, loud, KEY).select("song", "slot", "score")


@query(
    "subdivision_quota",
    """WITH mix(i, a, b, c) AS (VALUES (0, 100.0, 0.0, 0.0), (1, 100.0, 0.0, 0.0), (2, 79.0, 19.5, 0.0), (3, 59.1, 34.0, 3.1), (4, 50.0, 35.6, 9.3),
      (5, 43.6, 33.8, 18.8), (6, 38.0, 31.0, 23.1), (7, 34.8, 31.2, 24.7), (8, 32.8, 30.8, 31.8), (9, 30.7, 30.3, 38.8)),
    p AS (SELECT p_partkey, p_size / 4.0::DOUBLE AS rate, floor(p_retailprice)::BIGINT AS wanted FROM part),
    q AS (SELECT p_partkey, wanted, floor(wanted * a::DOUBLE / (a::DOUBLE + b::DOUBLE + c::DOUBLE))::BIGINT AS quarters, floor(wanted * b::DOUBLE / (a::DOUBLE + b::DOUBLE + c::DOUBLE))::BIGINT AS eighths
      FROM p JOIN mix ON i = least(floor(greatest(rate, 0)), 9)::BIGINT)
    SELECT p_partkey, quarters, eighths, wanted - quarters - eighths AS sixteenths FROM q""",
)
def subdivision_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    quota = selection.subdivision_quota(F.col("p_size") / 4.0, F.floor("p_retailprice"))
    return parts.select("p_partkey", quota.alias("q")).select(
        "p_partkey", *[F.col(f"q.{c}").cast("bigint").alias(c) for c in ("quarters", "eighths", "sixteenths")]
    )


def _chosen(spark: SparkSession, sf_dir: str, tidy: bool) -> DataFrame:
    scores = _scores(spark, sf_dir)
    loud = scores.where("slot < 600").select("song", "slot", (F.col("score") / 10 - 80).alias("loudness"))
    letters = F.length("song")
    songs = series.lengths(hourly(spark, sf_dir), KEY).select(
        "song", F.col("frame_count").alias("slot_count"), (90 + letters).alias("wanted"), (letters % 5 + 2.5).alias("rate"), (2 + letters % 3).alias("gap")
    )
    return selection.choose_slots(scores, loud, songs, KEY, tidy=tidy, per_measure=24, segment=50.0, piece=96, halo=48)


#: Songs, usable slots, the pulse, and the choice as a walk over the candidates, family by family and best first.
CHOSEN_SQL = f"""{FRAMES_SQL},
b AS (SELECT song, n, 90 + length(song) AS wanted, 2 + length(song) % 3 AS gap, CASE length(song) % 5 WHEN 0 THEN 79.0 WHEN 1 THEN 59.1 WHEN 2 THEN 50.0 WHEN 3 THEN 43.6 ELSE 38.0 END::DOUBLE AS m1,
  CASE length(song) % 5 WHEN 0 THEN 19.5 WHEN 1 THEN 34.0 WHEN 2 THEN 35.6 WHEN 3 THEN 33.8 ELSE 31.0 END::DOUBLE AS m2,
  CASE length(song) % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 3.1 WHEN 2 THEN 9.3 WHEN 3 THEN 18.8 ELSE 23.1 END::DOUBLE AS m3 FROM n),
sc AS (SELECT song, frame AS slot, value AS score FROM frames WHERE frame % 3 = 0 AND (frame >= 600 OR value / 10 - 80 > -70)),
ms AS (SELECT song, slot // 24 AS measure, max(score) AS loudest FROM sc GROUP BY 1, 2),
med AS (SELECT song, median(loudest) AS m FROM ms GROUP BY song),
mad AS (SELECT song, median(abs(loudest - m)) AS d, any_value(m) AS m, min(loudest) AS lo FROM ms JOIN med USING (song) GROUP BY song),
thr AS (SELECT song, CASE WHEN d <= 0 THEN lo - 1 ELSE m - 6 * d END AS threshold FROM mad),
seed AS (SELECT song, slot FROM (SELECT *, row_number() OVER (PARTITION BY song, slot // 24 ORDER BY score DESC, slot) AS r FROM sc) JOIN thr USING (song) JOIN b USING (song)
  WHERE r = 1 AND score > threshold AND ceil(n / 24) >= 2 AND wanted >= ceil(n / 24)),
cand AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY fam, score DESC, slot) AS rk FROM
  (SELECT song, slot, score, unnest(CASE WHEN slot % 12 = 0 THEN [1, 2, 3] WHEN slot % 6 = 0 THEN [2, 3] ELSE [3] END) AS fam FROM sc)),
walk(song, i, fam, begun, taken) AS (
  SELECT b.song, 0::BIGINT, 0, 0::BIGINT, coalesce((SELECT list(slot) FROM seed WHERE seed.song = b.song), []::BIGINT[]) FROM b
  UNION ALL
  SELECT song, i + 1, fam2, begun2, CASE WHEN len(taken) - begun2 < least(CASE fam2 WHEN 1 THEN floor(wanted * m1 / (m1 + m2 + m3)) WHEN 2 THEN floor(wanted * m2 / (m1 + m2 + m3)) ELSE wanted END, wanted - begun2)
      AND len(list_filter(taken, lambda x: abs(x - slot) < gap)) = 0 THEN list_append(taken, slot) ELSE taken END
  FROM (SELECT w.song, w.i, c.fam AS fam2, CASE WHEN c.fam <> w.fam THEN len(w.taken) ELSE w.begun END AS begun2, w.taken, c.slot, b.wanted, b.gap, b.m1, b.m2, b.m3
    FROM walk w JOIN cand c ON c.song = w.song AND c.rk = w.i + 1 JOIN b ON b.song = w.song)),
chosen AS (SELECT song, unnest(arg_max(taken, i)) AS slot FROM walk GROUP BY song)"""


@query("select_slots", f"WITH RECURSIVE {CHOSEN_SQL} SELECT song, slot FROM chosen")
def select_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir, tidy=False).select("song", *big("slot"))


@query(
    "tidy_rests",
    f"""WITH RECURSIVE {CHOSEN_SQL},
    c AS (SELECT song, slot // 24 AS measure, count(*) AS k FROM chosen GROUP BY 1, 2),
    f AS (SELECT song, measure, k, row_number() OVER (PARTITION BY song ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY song) AS m, max(measure) OVER (PARTITION BY song) + 1 AS span FROM c),
    u AS (SELECT song, max(CASE WHEN pos = m // 2 THEN k END) AS mid, any_value(span) AS span FROM f GROUP BY song),
    thin AS (SELECT song, measure FROM (SELECT c.*, span, row_number() OVER (PARTITION BY song ORDER BY k, measure) AS r FROM c JOIN u USING (song) WHERE k < 0.34::DOUBLE * mid) WHERE r <= floor(span * 0.10::DOUBLE)),
    kept AS (SELECT song, slot FROM chosen WHERE (song, slot // 24) NOT IN (SELECT (song, measure) FROM thin)
      UNION SELECT song, slot FROM sc WHERE slot % 24 = 0 AND (song, slot // 24) IN (SELECT (song, measure) FROM thin)),
    free AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY score DESC, slot) AS rk FROM sc WHERE (song, slot // 24) NOT IN (SELECT (song, measure) FROM thin)),
    again(song, i, want, taken) AS (
      SELECT song, 0::BIGINT, (SELECT count(*) FROM chosen c2 WHERE c2.song = kept.song) , list(slot) FROM kept GROUP BY song
      UNION ALL
      SELECT a.song, a.i + 1, want, CASE WHEN len(taken) < want AND len(list_filter(taken, lambda x: abs(x - slot) < gap)) = 0 THEN list_append(taken, slot) ELSE taken END
      FROM again a JOIN free r ON r.song = a.song AND r.rk = a.i + 1 JOIN b ON b.song = a.song)
    SELECT song, unnest(arg_max(taken, i)) AS slot FROM again GROUP BY song""",
)
def tidy_rests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir, tidy=True).select("song", *big("slot"))


@query(
    "thin_measures",
    """WITH c AS (SELECT user_id AS song, floor((epoch_us(ts) / 1e6 - 1704067200) / 86400)::BIGINT AS measure, count(*) AS n FROM events GROUP BY 1, 2),
    f AS (SELECT song, measure, n, row_number() OVER (PARTITION BY song ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY song) AS m, max(measure) OVER (PARTITION BY song) + 1 AS span FROM c),
    u AS (SELECT song, max(CASE WHEN i = m // 2 THEN n END) AS med, any_value(span) AS span FROM f GROUP BY song),
    t AS (SELECT c.*, span, row_number() OVER (PARTITION BY song ORDER BY n, measure) AS r FROM c JOIN u USING (song) WHERE n < 0.34::DOUBLE * med)
    SELECT song, measure FROM t WHERE r <= floor(span * 0.10::DOUBLE)""",
)
def thin_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    chosen = events.select(
        F.col("user_id").alias("song"),
        (F.floor((epoch_seconds(events, "ts") - F.lit(START)) / F.lit(86400.0)) * 48).alias("slot"),
    )
    return selection.thin_measures(chosen, KEY).select("song", *big("measure"))


@query(
    "preview_start",
    f"""WITH {DAYS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY loudest DESC, measure) AS rn, count(*) OVER (PARTITION BY song) AS n FROM ms)
    SELECT song, least(greatest(measure, floor(n * 0.10::DOUBLE)), greatest(floor(n * 0.65::DOUBLE), floor(n * 0.10::DOUBLE)))::BIGINT AS measure,
     least(greatest(measure, floor(n * 0.10::DOUBLE)), greatest(floor(n * 0.65::DOUBLE), floor(n * 0.10::DOUBLE))) * 4.0::DOUBLE AS beat FROM r WHERE rn = 1""",
)
def preview_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = selection.strongest_slots(_scores(spark, sf_dir), KEY, per_measure=24)
    return selection.preview_start(best, KEY, score="loudest")





@query("fit_warps")
def fit_warps(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = _track(spark, sf_dir).withColumn("bpm", F.lit(2.5))
    found = drift.fit_warps(track, KEY, "bpm", tolerance=1.5, hop=12.0, shortest=120.0)
    return found.select(
        "song", "seconds", rounded("bpm").alias("bpm"), rounded("slack").alias("slack"),
        F.size("splices").cast("bigint").alias("splices"),
    )
