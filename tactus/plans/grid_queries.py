"""Radar, rendering and parsing over orders: each order is a chart of line rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions import scalars
from tactus.operators import radar as radar_ops
from tactus.plans.bindings import LINE_ROWS_SQL, line_rows, rounded, table
from tactus.plans.registry import query
from tactus.sources import msd, render

KEY = ["chart"]
PIECE = 96.0

SPANS_SQL = f"""{LINE_ROWS_SQL},
lasts AS (SELECT chart, max(slot) AS last_slot FROM rows_ GROUP BY chart),
marks AS (
  SELECT chart, slot, p AS panel, [c0, c1, c2, c3][p + 1] AS code FROM rows_, (VALUES (0),(1),(2),(3)) v(p)
  WHERE [c0, c1, c2, c3][p + 1] IN (2, 3, 4)),
ahead AS (SELECT *, lead(code) OVER w AS nc, lead(slot) OVER w AS ns FROM marks
          WINDOW w AS (PARTITION BY chart, panel ORDER BY slot)),
spans AS (
  SELECT chart, slot, panel, code, CASE WHEN nc IS NULL THEN last_slot WHEN nc = 3 THEN ns ELSE slot END AS end_slot
  FROM ahead JOIN lasts USING (chart) WHERE code <> 3)"""
HELD_SQL = f"""{SPANS_SQL},
held AS (
  SELECT r.*, (SELECT count(*) FROM spans s WHERE s.chart = r.chart AND s.slot < r.slot AND s.end_slot >= r.slot) AS held
  FROM rows_ r)"""
MEASURE_SQL = f"""{LINE_ROWS_SQL},
mr AS (SELECT *, slot // 48 AS measure, slot % 48 AS pos FROM rows_),
ml AS (
  SELECT chart, measure,
    CASE WHEN bool_and(pos % 12 = 0) THEN 4 WHEN bool_and(pos % 6 = 0) THEN 8
         WHEN bool_and(pos % 4 = 0) THEN 12 WHEN bool_and(pos % 3 = 0) THEN 16
         WHEN bool_and(pos % 2 = 0) THEN 24 ELSE 48 END AS lines
  FROM mr GROUP BY chart, measure),
cells AS (
  SELECT m.chart, m.measure, m.lines, g.i, coalesce(r.txt, '0000') AS txt
  FROM ml m CROSS JOIN generate_series(0, 47) g(i)
  LEFT JOIN mr r ON r.chart = m.chart AND r.measure = m.measure AND r.pos = g.i * (48 // m.lines)
  WHERE g.i < m.lines),
mt AS (SELECT chart, measure, lines, string_agg(txt, chr(10) ORDER BY i) AS text FROM cells
       GROUP BY chart, measure, lines),
full_m AS (
  SELECT c.chart, g.i AS measure, coalesce(t.text, '0000' || chr(10) || '0000' || chr(10) || '0000' || chr(10) || '0000') AS text
  FROM (SELECT chart, max(measure) AS top FROM mt GROUP BY chart) c CROSS JOIN generate_series(0, 1) g(i)
  LEFT JOIN mt t ON t.chart = c.chart AND t.measure = g.i WHERE g.i <= c.top)"""


@query(
    "hold_spans",
    f"""WITH {SPANS_SQL} SELECT chart, slot::BIGINT AS slot, panel::BIGINT AS panel,
    code::BIGINT AS code, end_slot::BIGINT AS "end" FROM spans""",
)
def hold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = radar_ops.hold_spans(line_rows(spark, sf_dir), KEY, segment=PIECE)
    return spans.select("chart", *[F.col(c).cast("bigint").alias(c) for c in ("slot", "panel", "code", "end")])


@query(
    "held_count",
    f"WITH {HELD_SQL} SELECT chart, slot::BIGINT AS slot, held::BIGINT AS held FROM held",
)
def held_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = radar_ops.held_rows(line_rows(spark, sf_dir), KEY, segment=PIECE)
    return held.select("chart", *[F.col(c).cast("bigint").alias(c) for c in ("slot", "held")])


@query(
    "peak_in_range",
    f"""WITH {LINE_ROWS_SQL} SELECT chart, slot::BIGINT AS slot,
    sum(notes) OVER (PARTITION BY chart ORDER BY slot RANGE BETWEEN 20 PRECEDING AND CURRENT ROW)::BIGINT AS recent
    FROM rows_""",
)
def peak_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = scalars.count_codes(F.col("codes"), (1, 2, 4, 6))
    near = radar_ops.peak_in_range(line_rows(spark, sf_dir), KEY, notes, 20, segment=32.0)
    return near.select("chart", *[F.col(c).cast("bigint").alias(c) for c in ("slot", "recent")])


@query(
    "radar",
    f"""WITH {HELD_SQL},
    pk AS (SELECT *, sum(notes) OVER (PARTITION BY chart ORDER BY slot RANGE BETWEEN 96 PRECEDING AND CURRENT ROW) AS recent FROM held),
    g AS (
      SELECT chart, max(slot) / 12.0::DOUBLE + 1 AS s, max(slot) / 12.0::DOUBLE AS beats, max(recent) AS peak,
        count(*) FILTER (WHERE slot % 6 <> 0) AS fine, sum(notes) AS notes,
        count(*) FILTER (WHERE notes >= 1) AS taps_and_holds, count(*) FILTER (WHERE notes >= 2) AS jumps,
        sum((c0=2)::INT + (c1=2)::INT + (c2=2)::INT + (c3=2)::INT) AS holds,
        sum((c0=5)::INT + (c1=5)::INT + (c2=5)::INT + (c3=5)::INT) AS mines,
        count(*) FILTER (WHERE notes + held >= 3) AS hands,
        sum((c0=4)::INT + (c1=4)::INT + (c2=4)::INT + (c3=4)::INT) AS rolls,
        sum((c0=6)::INT + (c1=6)::INT + (c2=6)::INT + (c3=6)::INT) AS lifts
      FROM pk GROUP BY chart)
    SELECT chart, round(notes / s / 7 + 1e-9, 6) AS stream, round(peak / 8 * (beats / s) / 10 + 1e-9, 6) AS voltage,
      round(jumps / s + 1e-9, 6) AS air, round(holds / s + 1e-9, 6) AS freeze, round(fine / s * 0.5 + 1e-9, 6) AS chaos,
      notes::BIGINT AS notes, taps_and_holds, jumps, holds::BIGINT AS holds, mines::BIGINT AS mines, hands,
      rolls::BIGINT AS rolls, lifts::BIGINT AS lifts, 0::BIGINT AS fakes FROM g""",
)
def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir)
    length = rows.groupBy("chart").agg((F.max("slot") / 12.0 + 1).alias("seconds"))
    found = radar_ops.radar(rows, KEY, length, segment=PIECE)
    rates = ("stream", "voltage", "air", "freeze", "chaos")
    rest = [c for c in found.columns if c not in rates and c != "chart"]
    return found.select(
        "chart",
        *[rounded(c).alias(c) for c in rates],
        *[F.col(c).cast("bigint").alias(c) for c in rest],
    )


@query(
    "measure_text",
    f"WITH {MEASURE_SQL} SELECT chart, measure::BIGINT AS measure, lines::BIGINT AS lines, text FROM mt",
)
def measure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = render.measure_text(line_rows(spark, sf_dir), KEY)
    return text.select(
        "chart", F.col("measure").cast("bigint").alias("measure"), F.col("lines").cast("bigint").alias("lines"), "text"
    )


@query(
    "chart_text",
    f"""WITH {MEASURE_SQL}
    SELECT chart, string_agg(text, chr(10) || ',' || chr(10) ORDER BY measure) AS notes FROM full_m GROUP BY chart""",
)
def chart_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.chart_text(line_rows(spark, sf_dir), KEY)


@query(
    "measure_block",
    f"""WITH {MEASURE_SQL}
    SELECT chart, string_agg(CASE WHEN measure > 0 THEN ',  ' ELSE '' END || '// measure ' || measure || chr(10) || text,
       chr(10) ORDER BY measure) AS notes,
      md5(string_agg(CASE WHEN measure > 0 THEN ',  ' ELSE '' END || chr(10) || text, chr(10) ORDER BY measure)) AS digest
    FROM full_m GROUP BY chart""",
)
def measure_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = render.measure_block(line_rows(spark, sf_dir), KEY)
    return block.select("chart", "notes", scalars.chart_hash(F.col("notes")).alias("digest"))


def songs_from_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Customers as songs, their orders as charts: songs, tempo, stops, charts and rows."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("song"), F.col("o_orderkey").alias("chart"), "o_totalprice",
        "o_orderpriority",
    )
    rows = line_rows(spark, sf_dir).join(orders.select("song", "chart"), "chart")
    songs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("song"),
        F.translate("c_name", "#", " ").alias("title"),
        F.col("c_mktsegment").alias("artist"),
        (F.col("c_acctbal") / 1000).alias("offset"),
    )
    base = orders.select("song", "chart", "o_totalprice")
    tempo = base.select(
        "song",
        (F.col("chart") % 64).cast("double").alias("beat"),
        F.floor(F.lit(60) + F.col("o_totalprice") % 240).cast("double").alias("bpm"),
    )
    stops = base.where("o_totalprice > 300000").select(
        "song", (F.col("chart") % 96).cast("double").alias("beat"), F.lit(0.25).alias("seconds")
    )
    names = F.create_map(
        *[
            F.lit(x)
            for pair in {
                "1-URGENT": "Challenge",
                "2-HIGH": "Hard",
                "3-MEDIUM": "medium",
                "4-NOT SPECIFIED": "Unrated",
                "5-LOW": "Beginner",
            }.items()
            for x in pair
        ]
    )
    charts = orders.select(
        "song",
        "chart",
        F.element_at(names, F.col("o_orderpriority")).alias("difficulty"),
        (F.floor(F.col("o_totalprice")) % 21).cast("int").alias("meter"),
    )
    return songs, tempo, stops, charts, rows


SONGS_SQL = f"""{MEASURE_SQL},
oc AS (
  SELECT o_custkey AS song, o_orderkey AS chart, o_totalprice,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Challenge' WHEN '2-HIGH' THEN 'Hard' WHEN '5-LOW' THEN 'Beginner'
         ELSE 'Edit' END AS name, floor(o_totalprice)::BIGINT % 21 AS meter FROM orders),
notes AS (SELECT chart, string_agg(text, chr(10) || ',' || chr(10) ORDER BY measure) AS notes FROM full_m GROUP BY chart),
tm AS (SELECT song, (chart % 64)::DOUBLE AS beat, floor(60 + o_totalprice % 240) AS bpm FROM oc),
stp AS (SELECT song, (chart % 96)::DOUBLE AS beat FROM oc WHERE o_totalprice > 300000)"""


@query(
    "render_sm",
    f"""WITH {SONGS_SQL},
    body AS (
      SELECT song, string_agg('#NOTES:' || chr(10) || '     dance-single:' || chr(10) || '     tactus:' || chr(10)
        || '     ' || name || ':' || chr(10) || '     ' || meter || ':' || chr(10)
        || '     0.000,0.000,0.000,0.000,0.000:' || chr(10)
        || coalesce(notes, '0000' || chr(10) || '0000' || chr(10) || '0000' || chr(10) || '0000') || chr(10) || ';' || chr(10),
        chr(10) ORDER BY oc.chart) AS charts
      FROM oc LEFT JOIN notes ON notes.chart = oc.chart GROUP BY song),
    b AS (SELECT song, string_agg(printf('%.3f=%.3f', beat, bpm), ',' ORDER BY beat, bpm) AS bpms FROM tm GROUP BY song),
    s AS (SELECT song, string_agg(printf('%.3f=0.250', beat), ',' ORDER BY beat) AS stops FROM stp GROUP BY song)
    SELECT c_custkey AS song, '#TITLE:' || replace(c_name, '#', ' ') || ';' || chr(10) || '#SUBTITLE:;' || chr(10) || '#ARTIST:' || c_mktsegment || ';'
      || chr(10) || '#TITLETRANSLIT:;' || chr(10) || '#SUBTITLETRANSLIT:;' || chr(10) || '#ARTISTTRANSLIT:;' || chr(10)
      || '#GENRE:;' || chr(10) || '#CREDIT:;' || chr(10) || '#BANNER:;' || chr(10) || '#BACKGROUND:;' || chr(10) || '#CDTITLE:;'
      || chr(10) || '#MUSIC:;' || chr(10) || '#OFFSET:' || printf('%.6f', c_acctbal / 1000) || ';' || chr(10)
      || '#SAMPLESTART:0.000;' || chr(10) || '#SAMPLELENGTH:15.000;' || chr(10) || '#SELECTABLE:YES;' || chr(10)
      || '#BPMS:' || coalesce(bpms, '') || ';' || chr(10) || '#STOPS:' || coalesce(stops, '') || ';' || chr(10)
      || coalesce(chr(10) || charts, '') AS text
    FROM customer LEFT JOIN body ON body.song = c_custkey LEFT JOIN b ON b.song = c_custkey LEFT JOIN s ON s.song = c_custkey""",
)
def render_sm(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs, tempo, stops, charts, rows = songs_from_orders(spark, sf_dir)
    return render.render_sm(songs, tempo, stops, charts, rows, ["song"])


def parsed_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered texts, read back: header columns and tags."""
    text = render_sm(spark, sf_dir)
    parsed = text.select(
        "song", F.lit("sm").alias("file_format"), msd.msd_tags(F.col("text")).alias("tags")
    )
    return msd.song_header(parsed)


@query(
    "msd_tags",
    """WITH n AS (SELECT o_custkey AS song, count(*) AS n FROM orders GROUP BY 1)
    SELECT c_custkey AS song, 18 + coalesce(n, 0)::BIGINT AS tags, coalesce(n, 0)::BIGINT AS charts,
      18 + 6 * coalesce(n, 0)::BIGINT AS params
    FROM customer LEFT JOIN n ON n.song = c_custkey""",
)
def msd_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = msd.explode_tags(parsed_songs(spark, sf_dir), ["song"])
    return tags.groupBy("song").agg(
        F.count(F.lit(1)).alias("tags"),
        F.sum((F.col("tag") == "NOTES").cast("bigint")).alias("charts"),
        F.sum(F.size("params").cast("bigint")).alias("params"),
    )


@query(
    "song_header",
    """SELECT c_custkey AS song, replace(c_name, '#', ' ') AS title, c_mktsegment AS artist, '' AS music,
      round(c_acctbal / 1000 + 1e-9, 6) AS "offset", 1::BIGINT AS offset_declared, 15.0::DOUBLE AS sample_length FROM customer""",
)
def song_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_songs(spark, sf_dir).select(
        "song",
        "title",
        "artist",
        "music",
        rounded("offset").alias("offset"),
        F.col("offset_declared").cast("bigint").alias("offset_declared"),
        "sample_length",
    )


@query(
    "tempo_segments",
    """SELECT o_custkey AS song, (o_orderkey % 64)::DOUBLE AS beat, floor(60 + o_totalprice % 240) AS bpm FROM orders""",
)
def tempo_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msd.tempo_segments(parsed_songs(spark, sf_dir), ["song"]).select("song", "beat", "bpm")


@query(
    "stop_segments",
    """SELECT o_custkey AS song, (o_orderkey % 96)::DOUBLE AS beat, 0.25::DOUBLE AS seconds, 0::BIGINT AS is_delay
    FROM orders WHERE o_totalprice > 300000""",
)
def stop_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = msd.stop_segments(parsed_songs(spark, sf_dir), ["song"])
    return stops.withColumn("is_delay", F.col("is_delay").cast("bigint"))


CHARTS_SQL = """SELECT o_custkey AS song,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS chart_idx, o_orderkey,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Challenge' WHEN '2-HIGH' THEN 'Hard' WHEN '5-LOW' THEN 'Beginner'
           ELSE 'Edit' END AS difficulty, floor(o_totalprice)::BIGINT % 21 AS meter FROM orders"""


@query(
    "sm_charts",
    f"""WITH oc AS ({CHARTS_SQL})
    SELECT song, chart_idx, 'dance-single' AS stepstype, 'tactus' AS description, difficulty, meter,
      CASE difficulty WHEN 'Beginner' THEN 0 WHEN 'Hard' THEN 3 WHEN 'Challenge' THEN 4 ELSE 5 END::BIGINT AS difficulty_index
    FROM oc""",
)
def sm_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    charts = msd.chart_table(parsed_songs(spark, sf_dir), ["song"])
    return charts.select(
        "song",
        F.col("chart_idx").cast("bigint").alias("chart_idx"),
        "stepstype",
        "description",
        "difficulty",
        F.col("meter").cast("bigint").alias("meter"),
        scalars.difficulty_index(F.col("difficulty")).cast("bigint").alias("difficulty_index"),
    )


@query(
    "chart_rows",
    f"""WITH {LINE_ROWS_SQL}, oc AS ({CHARTS_SQL})
    SELECT oc.song, oc.chart_idx, slot / 12.0::DOUBLE AS beat, txt AS columns, slot::BIGINT AS slot, txt AS codes
    FROM rows_ JOIN oc ON oc.o_orderkey = rows_.chart""",
)
def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    charts = msd.chart_table(parsed_songs(spark, sf_dir), ["song"])
    rows = msd.chart_rows(charts, ["song", "chart_idx"])
    return rows.select(
        "song",
        F.col("chart_idx").cast("bigint").alias("chart_idx"),
        "beat",
        "columns",
        scalars.grid_slot(F.col("beat")).cast("bigint").alias("slot"),
        scalars.code_text(scalars.panel_codes(F.col("columns"))).alias("codes"),
    )
