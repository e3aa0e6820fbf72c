"""Sources and formats over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions import scalars
from tactus.operators import grid, radar
from tactus.plans.bindings import LINE_ROWS_SQL, line_rows, rounded, table
from tactus.plans.grid_queries import CHARTS_SQL, songs_from_orders
from tactus.plans.registry import query
from tactus.sources import dwi, files, manifest, msd, render


def big(*names: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in names]


@query(
    "choose_simfile",
    """WITH f AS (SELECT source AS directory, lang || '-' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.dwi' WHEN 1 THEN '.SM' WHEN 2 THEN '.txt' ELSE '.dwi' END AS file,
      CASE doc_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END AS pref FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY pref, file) AS rn FROM f WHERE pref > 0)
    SELECT directory, file FROM r WHERE rn = 1""",
)
def choose_simfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(s) for s in (".dwi", ".SM", ".txt", ".dwi")]), (F.col("doc_id") % 4 + 1).cast("int"))
    listing = table(spark, sf_dir, "documents").select(
        F.col("source").alias("directory"), F.concat_ws("", F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"), kind).alias("file")
    )
    suffix = F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1))
    return files.choose_simfile(listing.withColumn("suffix", suffix)).select("directory", "file")


@query(
    "resolve_audio",
    """WITH s AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 30) AS directory, CASE WHEN s_suppkey % 3 = 0 THEN 'RED WIDGET' WHEN s_suppkey % 3 = 1 THEN 'small ring' ELSE '' END AS music FROM supplier),
    l AS (SELECT p_brand AS directory, p_partkey, p_name, CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS sfx FROM part),
    c AS (SELECT s_suppkey, p_partkey, p_name, CASE WHEN p_name = music THEN 1 WHEN music <> '' AND lower(p_name) = lower(music) THEN 2 WHEN sfx > 0 THEN sfx + 2 END AS rk FROM s JOIN l USING (directory)),
    r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY rk, p_name, p_partkey) AS rn FROM c WHERE rk IS NOT NULL)
    SELECT s.s_suppkey, rk::BIGINT AS found, r.p_name AS audio FROM s LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (s_suppkey)""".replace("rk::BIGINT AS found, ", ""),
)
def resolve_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("s_suppkey") % 3
    songs = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("directory"),
        F.when(third == 0, "RED WIDGET").when(third == 1, "small ring").otherwise("").alias("music"),
    )
    kind = F.element_at(F.array(*[F.lit(s) for s in ("ogg", "mp3", "wav", "png", "txt")]), (F.col("p_size") % 5 + 1).cast("int"))
    # A brand is one directory, which all of its songs share.
    listing = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("directory"), F.col("p_name").alias("path"), F.col("p_name").alias("file"), kind.alias("suffix")
    )
    found = files.resolve_audio(songs, listing)
    return found.select("s_suppkey", "audio")


@query(
    "apply_tags",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name WHEN s_suppkey % 3 = 0 THEN 'album ' || s_nationkey ELSE 'perf ' || s_suppkey END AS artist,
      CASE WHEN s_suppkey % 5 = 0 THEN 'rock' ELSE '' END AS genre FROM supplier""",
)
def apply_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    songs = suppliers.select("s_suppkey", F.when(key % 2 == 0, F.col("s_name")).otherwise("").alias("artist"), F.lit("").alias("genre"))
    tags = (
        suppliers.where(key % 3 == 0).select("s_suppkey", F.lit("albumartist").alias("name"), F.concat(F.lit(" album "), F.col("s_nationkey").cast("string")).alias("value"))
        .unionByName(suppliers.select("s_suppkey", F.lit("performer").alias("name"), F.concat(F.lit("perf "), key.cast("string")).alias("value")))
        .unionByName(suppliers.where(key % 5 == 0).select("s_suppkey", F.lit("genre").alias("name"), F.lit("rock").alias("value")))
    )
    return render.apply_tags(songs, tags, ["s_suppkey"])


@query(
    "not_yet_built",
    """SELECT o_orderkey, substr(sha1(o_orderkey::VARCHAR), 1, 2) AS prefix FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)""",
)
def not_yet_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("simfile"))
    built = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.sha1(F.col("l_orderkey").cast("string")).alias("key"))
    fresh = manifest.not_yet_built(manifest.with_cache_key(orders, "simfile"), built)
    return fresh.select("o_orderkey", "prefix")


@query(
    "singles",
    """SELECT o_orderkey, 4::BIGINT AS panels FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "dance-single").when(F.col("o_orderpriority") == "2-HIGH", "Dance-Single").otherwise("dance-double")
    charts = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("stepstype"))
    kept = manifest.singles(charts)
    return kept.select("o_orderkey", manifest.panel_count(F.col("stepstype")).cast("bigint").alias("panels"))


@query(
    "keyboard_override",
    """SELECT p_partkey, (p_brand IN ('Brand#2', 'Brand#17') OR p_name IN ('red widget', 'small ring'))::BIGINT AS keyboard FROM part""",
)
def keyboard_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = manifest.keyboard_override(
        F.col("p_brand"), F.col("p_name"), ("Brand#2", "Brand#17"), ("red widget", "small ring")
    )
    return table(spark, sf_dir, "part").select("p_partkey", flag.cast("bigint").alias("keyboard"))


@query(
    "beat_values",
    """SELECT o_custkey, o_orderkey::DOUBLE / 4 AS beat, o_totalprice AS value FROM orders WHERE o_totalprice > 100000""",
)
def beat_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    pair = F.concat(
        F.lit("\n "), (F.col("o_orderkey") / 4).cast("string"), F.lit("="), F.col("o_totalprice").cast("string"),
        F.when(F.col("o_totalprice") > 100000, F.lit(" ")).otherwise(F.lit("x")),
    )
    text = orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(pair), ",").alias("text"))
    found = text.select("o_custkey", F.explode(msd.beat_values(F.col("text"))).alias("p"))
    return found.select("o_custkey", "p.beat", "p.value")


@query(
    "grid_beats",
    """SELECT c_custkey, g.i AS fine, round(g.i / 24.0::DOUBLE + 1e-9, 6) AS beat FROM customer, generate_series(0, 200) g(i)
    WHERE g.i < greatest(floor(greatest(c_acctbal / 2000, 0) * 24), 1)""",
)
def grid_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 2000).alias("total_beats"))
    found = grid.grid_beats(songs, ["c_custkey"])
    return found.select("c_custkey", *big("fine"), rounded("beat").alias("beat"))


@query(
    "ssc_charts",
    f"""WITH {LINE_ROWS_SQL}, oc AS ({CHARTS_SQL}),
    n AS (SELECT chart, count(*) AS n FROM rows_ GROUP BY chart)
    SELECT song, chart_idx, 'dance-single' AS stepstype, 'tactus' AS description, difficulty, meter, coalesce(n, 0) AS rows
    FROM oc LEFT JOIN n ON n.chart = oc.o_orderkey""",
)
def ssc_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs, tempo, stops, charts, rows = songs_from_orders(spark, sf_dir)
    timed = rows.withColumn("seconds", F.lit(10.0))
    measured = radar.radar(timed, ["song", "chart"], F.col("seconds")).withColumn("last_second", F.lit(9.5))
    text = render.render_ssc(songs, tempo, stops, charts, rows, measured, ["song"])
    parsed = text.select("song", F.lit("ssc").alias("file_format"), msd.msd_tags(F.col("text")).alias("tags"))
    found = msd.chart_table(parsed, ["song"])
    # Counted where they are, so that the texts are written and parsed once.
    rows = F.coalesce(F.array_size(msd.note_rows(F.col("notes"))), F.lit(0)).cast("bigint")
    return found.select(
        "song", *big("chart_idx"), "stepstype", "description", "difficulty", *big("meter"), rows.alias("rows")
    )


@query(
    "dwi_rows",
    f"""WITH {LINE_ROWS_SQL},
    ev AS (SELECT chart, slot, p, code IN (2, 4) AS marked FROM (SELECT chart, slot, p, [c0, c1, c2, c3][p + 1] AS code FROM rows_, (VALUES (0), (1), (2), (3)) v(p)) WHERE code IN (1, 2, 3, 4)),
    r AS (SELECT *, sum((NOT marked)::INT) OVER (PARTITION BY chart, p ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plain_before FROM ev),
    s AS (SELECT *, row_number() OVER (PARTITION BY chart, p, coalesce(plain_before, 0) ORDER BY slot) - 1 AS ones FROM r),
    c AS (SELECT chart, slot, p, CASE WHEN ones % 2 = 1 THEN 3 WHEN marked THEN 2 ELSE 1 END AS code FROM s)
    SELECT chart, slot::BIGINT AS slot, max(CASE WHEN p = 0 THEN code ELSE 0 END)::VARCHAR || max(CASE WHEN p = 1 THEN code ELSE 0 END)
      || max(CASE WHEN p = 2 THEN code ELSE 0 END) || max(CASE WHEN p = 3 THEN code ELSE 0 END) AS codes FROM c GROUP BY chart, slot""",
)
def dwi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as a DWI stream and read back."""
    streams = render.step_stream(line_rows(spark, sf_dir), ["chart"])
    back = dwi.dwi_rows(streams, ["chart"])
    return back.select(
        "chart", scalars.grid_slot(F.col("beat")).cast("bigint").alias("slot"), scalars.code_text(F.col("codes")).alias("codes")
    )


@query(
    "panel_codes",
    """SELECT doc_id, sum((c = '1')::INT)::BIGINT AS taps, sum((c = '2')::INT)::BIGINT AS heads, sum((c = '3')::INT)::BIGINT AS tails,
      sum((c = 'M')::INT)::BIGINT AS mines, sum((c = 'L')::INT)::BIGINT AS lifts, count(*) AS width
    FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0) GROUP BY doc_id
    UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, 0 FROM documents WHERE coalesce(length(text), 0) = 0""",
)
def panel_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    coded = table(spark, sf_dir, "documents").select("doc_id", scalars.panel_codes(text, None).alias("codes"))

    def count(code: int, name: str):
        return F.size(F.filter("codes", lambda c: c == code)).cast("bigint").alias(name)

    return coded.select(
        "doc_id", count(1, "taps"), count(2, "heads"), count(3, "tails"), count(5, "mines"), count(6, "lifts"),
        F.size("codes").cast("bigint").alias("width"),
    )
