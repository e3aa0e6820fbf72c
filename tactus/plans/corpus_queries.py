"""Corpus statistics, training tables and metrics over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions import scalars
from tactus.operators import corpus, grid, metrics, prep, stats
from tactus.plans.bindings import LINE_ROWS_SQL, drawn_sql, line_rows, rounded, table
from tactus.plans.registry import query


def big(*names: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in names]


PATTERN_SQL = f"""{LINE_ROWS_SQL},
pat AS (SELECT *, c0 * 343 + c1 * 49 + c2 * 7 + c3 AS pattern FROM rows_),
cnt AS (SELECT pattern, count(*) AS n FROM pat GROUP BY pattern),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, pattern) - 1 AS token FROM cnt)"""


def part_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as charts: the brand is the pack and the size the rating."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("pack"), (F.col("p_size") % (8 + number % 8)).alias("meter")
    )


PARTS_SQL = """charts AS (SELECT p_partkey, p_brand AS pack,
  p_size % (8 + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 8) AS meter FROM part),
tops AS (SELECT pack, max(meter) AS top FROM charts GROUP BY pack),
scales AS (SELECT pack, (top >= 13)::BIGINT AS scale FROM tops WHERE top <= 10 OR top >= 13)"""


@query("pack_scales", f"WITH {PARTS_SQL} SELECT pack, scale FROM scales")
def pack_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pack_scales(part_charts(spark, sf_dir)).select("pack", *big("scale"))


@query(
    "with_known_scale",
    f"WITH {PARTS_SQL} SELECT p_partkey, pack, meter::BIGINT AS meter, scale FROM charts JOIN scales USING (pack)",
)
def with_known_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    charts = part_charts(spark, sf_dir)
    known = corpus.with_known_scale(charts, corpus.pack_scales(charts))
    return known.select("p_partkey", "pack", *big("meter", "scale"))


@query(
    "build_vocabulary",
    f"WITH {PATTERN_SQL} SELECT token, pattern::BIGINT AS pattern, n FROM ranked WHERE token < 512",
)
def build_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.build_vocabulary(line_rows(spark, sf_dir)).select(*big("token", "pattern", "n"))


@query("top_patterns", f"WITH {PATTERN_SQL} SELECT pattern::BIGINT AS pattern, n FROM ranked WHERE token < 25")
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus.pattern_counts(line_rows(spark, sf_dir))
    return corpus.top_k(counts, 25).select(*big("pattern", "n"))


@query(
    "coverage",
    f"""WITH {PATTERN_SQL} SELECT round(sum(CASE WHEN token < 20 THEN n ELSE 0 END) / sum(n) + 1e-9, 6) AS coverage
    FROM ranked""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus.pattern_counts(line_rows(spark, sf_dir))
    return corpus.coverage(counts, 20).select(rounded("coverage").alias("coverage"))


@query(
    "tokenize",
    f"""WITH {PATTERN_SQL}
    SELECT chart, slot::BIGINT AS slot, p.pattern::BIGINT AS pattern, coalesce(r.token, 0) AS token
    FROM pat p LEFT JOIN (SELECT * FROM ranked WHERE token < 64) r ON r.pattern = p.pattern""",
)
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir)
    coded = corpus.tokenize(rows, corpus.build_vocabulary(rows, 64))
    return coded.select("chart", *big("slot", "pattern", "token"))


@query(
    "row_codec",
    f"""WITH {PATTERN_SQL} SELECT chart, slot::BIGINT AS slot, pattern::BIGINT AS pattern, txt AS decoded,
      ((c0 IN (1,2,4,6))::INT + 2 * (c1 IN (1,2,4,6))::INT + 4 * (c2 IN (1,2,4,6))::INT
       + 8 * (c3 IN (1,2,4,6))::INT)::BIGINT AS stepped, (slot % 48)::BIGINT AS position FROM pat""",
)
def row_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = line_rows(spark, sf_dir).withColumn("pattern", scalars.encode_row(F.col("codes")))
    decoded = scalars.decode_row(F.col("pattern"))
    return packed.select(
        "chart",
        *big("slot", "pattern"),
        scalars.code_text(decoded).alias("decoded"),
        scalars.step_mask(decoded).cast("bigint").alias("stepped"),
        scalars.metric_position(F.col("slot")).cast("bigint").alias("position"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def _sql_rate(meter: str, scale: str) -> str:
    def pick(values) -> str:
        return f"list_extract({_sql_list(values)}, 1 + greatest(0, least({meter}, {len(values) - 1})))"

    return (
        f"CASE WHEN abs({scale} - 10) <= abs({scale} - 15) AND abs({scale} - 10) <= abs({scale} - 20) THEN {pick(k.NPS_10)}"
        f" WHEN abs({scale} - 15) <= abs({scale} - 20) THEN {pick(k.NPS_15)} ELSE {pick(k.NPS_20)} END"
    )


@query(
    "target_rate",
    f"""WITH p AS (SELECT p_partkey, (p_size % 27 - 2)::BIGINT AS meter, p_partkey % 25 AS scale,
      CASE WHEN p_type = 'ECONOMY' THEN 'keyboard' ELSE 'feet' END AS style,
      CASE WHEN p_partkey % 10 = 0 THEN 7.5 ELSE 0 END AS given FROM part)
    SELECT p_partkey, meter, scale, round(CASE WHEN given > 0 THEN given WHEN style = 'keyboard'
      THEN list_extract({_sql_list(k.NPS_KEYBOARD)}, 1 + greatest(0, least(meter, 20)))
      ELSE {_sql_rate("meter", "scale")} END + 1e-9, 6) AS rate FROM p""",
)
def target_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.col("p_size") % 27 - 2).alias("meter"),
        (F.col("p_partkey") % 25).alias("scale"),
        F.when(F.col("p_type") == "ECONOMY", "keyboard").otherwise("feet").alias("style"),
        F.when(F.col("p_partkey") % 10 == 0, 7.5).otherwise(0.0).alias("given"),
    )
    rate = corpus.target_rate(F.col("meter"), F.col("scale"), F.col("style"), F.col("given"))
    return parts.select("p_partkey", *big("meter", "scale"), rounded(rate).alias("rate"))


@query(
    "convert_meter",
    f"""WITH p AS (SELECT p_partkey, (p_size % 11)::BIGINT AS meter, 15 + 5 * (p_partkey % 2) AS target FROM part),
    c AS (SELECT p.*, r.m, abs(CASE WHEN target = 15 THEN list_extract({_sql_list(k.NPS_15)}, 1 + r.m)
             ELSE list_extract({_sql_list(k.NPS_20)}, 1 + r.m) END
             - list_extract({_sql_list(k.NPS_10)}, 1 + meter)) AS d
          FROM p, generate_series(1, 20) r(m) WHERE r.m <= CASE WHEN target = 15 THEN 15 ELSE 20 END),
    w AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, m) AS rn FROM c)
    SELECT p_partkey, meter, target::BIGINT AS target, m::BIGINT AS converted FROM w WHERE rn = 1""",
)
def convert_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.col("p_size") % 11).alias("meter"),
        (F.lit(15) + 5 * (F.col("p_partkey") % 2)).alias("target"),
    )
    converted = corpus.convert_meter(F.col("meter"), F.lit(10), F.col("target"))
    return parts.select("p_partkey", *big("meter", "target"), converted.cast("bigint").alias("converted"))


@query(
    "default_meter",
    f"""WITH p AS (SELECT p_partkey, ['Beginner', 'Easy', 'Medium', 'Hard', 'Challenge', 'Edit', 'Other'][1 + p_size % 7] AS difficulty,
      [2, 4, 6, 9, 12, 9, 6][1 + p_size % 7] AS classic, 10 + 5 * (p_partkey % 3) AS scale FROM part),
    c AS (SELECT p.*, r.m, abs(CASE WHEN scale = 15 THEN list_extract({_sql_list(k.NPS_15)}, 1 + r.m)
             ELSE list_extract({_sql_list(k.NPS_20)}, 1 + r.m) END - list_extract({_sql_list(k.NPS_10)}, 1 + least(classic, 10))) AS d
          FROM p, generate_series(1, 20) r(m) WHERE r.m <= scale),
    w AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, m) AS rn FROM c)
    SELECT p_partkey, difficulty, scale::BIGINT AS scale, CASE WHEN scale = 10 THEN classic ELSE m END::BIGINT AS meter FROM w WHERE rn = 1""",
)
def default_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(d) for d in ("Beginner", "Easy", "Medium", "Hard", "Challenge", "Edit", "Other")])
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.get(names, (F.col("p_size") % 7).cast("int")).alias("difficulty"),
        (F.lit(10) + 5 * (F.col("p_partkey") % 3)).alias("scale"),
    )
    found = corpus.default_meter(F.col("difficulty"), F.col("scale"))
    return parts.select("p_partkey", "difficulty", *big("scale"), found.cast("bigint").alias("meter"))


@query(
    "note_rate",
    f"""WITH {LINE_ROWS_SQL},
    g AS (SELECT chart, count(*) AS n, max(slot) - min(slot) AS span, 60 + chart % 200 AS bpm FROM rows_ GROUP BY chart)
    SELECT chart, CASE WHEN n < 2 OR span <= 0 THEN 0 ELSE least(floor(n / (span * 60 / bpm / 12)), 15) END::BIGINT AS rate FROM g""",
)
def note_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpm = F.col("chart") % 200 + 60
    return corpus.note_rate(line_rows(spark, sf_dir), ["chart"], bpm).select("chart", *big("rate"))


def _order_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("song"),
        F.col("o_orderkey").alias("chart"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("difficulty"),
    )


PRIOR_SQL = f"""{LINE_ROWS_SQL},
ex AS (SELECT o_custkey AS song, o_orderkey AS chart, substr(o_orderpriority, 1, 1)::INT AS difficulty FROM orders),
songs AS (SELECT c_custkey AS song, 64 + c_custkey % 500 AS slot_count FROM customer),
hits AS (
  SELECT r.slot % 48 AS position, count(*) AS c
  FROM ex JOIN ex t ON t.song = ex.song AND t.difficulty = ex.difficulty JOIN rows_ r ON r.chart = t.chart
  GROUP BY 1),
tot AS (
  SELECT p.position, sum(slot_count // 48 + (p.position < slot_count % 48)::INT) AS t
  FROM ex JOIN songs USING (song), generate_series(0, 47) p(position) GROUP BY 1),
pr AS (SELECT position, coalesce(c, 0) AS c, t, least(greatest(coalesce(c, 0) / greatest(t, 1), 1e-4), 1 - 1e-4) AS r
       FROM tot LEFT JOIN hits USING (position))"""


@query(
    "metric_prior",
    f"""WITH {PRIOR_SQL} SELECT position::BIGINT AS position, c::BIGINT AS "count", t::BIGINT AS total,
    round(ln(r / (1 - r)) + 1e-9, 6) AS log_odds FROM pr""",
)
def metric_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = _order_examples(spark, sf_dir)
    targets = line_rows(spark, sf_dir).join(examples, "chart")
    songs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("song"), (F.col("c_custkey") % 500 + 64).alias("slot_count")
    )
    prior = corpus.metric_prior(examples.select("song", "difficulty"), targets, songs, ["song"])
    return prior.select(*big("position", "count", "total"), rounded("log_odds").alias("log_odds"))


@query(
    "style_weights",
    """SELECT o_orderkey, o_orderpriority AS style, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderpriority) AS weight FROM orders""",
)
def style_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("style"))
    return prep_columns(corpus.style_weights(orders))


def prep_columns(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "style", "weight")


@query(
    "rate_calibration",
    """SELECT p_brand AS pack, (p_size % 5)::BIGINT AS meter, round(median(p_retailprice) + 1e-9, 6) AS median_nps, count(*) AS charts
    FROM part GROUP BY 1, 2""",
)
def rate_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    charts = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("pack"), (F.col("p_size") % 5).alias("meter"), F.col("p_retailprice").alias("nps")
    )
    found = corpus.rate_calibration(charts, ["pack", "meter"], segment=50.0)
    return found.select("pack", *big("meter"), rounded("median_nps").alias("median_nps"), "charts")


@query(
    "rhythm_shares",
    f"""WITH {LINE_ROWS_SQL}
    SELECT chart % 10 AS rate, round(avg((slot % 12 = 0)::INT) * 100 + 1e-9, 6) AS quarter,
      round(avg((slot % 12 <> 0 AND slot % 6 = 0)::INT) * 100 + 1e-9, 6) AS eighth,
      round(avg((slot % 6 <> 0 AND slot % 3 = 0)::INT) * 100 + 1e-9, 6) AS sixteenth,
      round(avg((slot % 3 <> 0)::INT) * 100 + 1e-9, 6) AS finer, count(*) AS rows FROM rows_ GROUP BY 1""",
)
def rhythm_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.rhythm_shares(line_rows(spark, sf_dir), F.col("chart") % 10)
    shares = ("quarter", "eighth", "sixteenth", "finer")
    return found.select(*big("rate"), *[rounded(c).alias(c) for c in shares], "rows")


@query(
    "event_shares",
    f"""WITH {LINE_ROWS_SQL}
    SELECT chart % 20 AS grp, round(sum((notes > 1)::INT) / sum((notes > 0)::INT) + 1e-9, 6) AS jump_share,
      round(sum((c0 IN (2,4))::INT + (c1 IN (2,4))::INT + (c2 IN (2,4))::INT + (c3 IN (2,4))::INT) / sum(notes) + 1e-9, 6) AS freeze_share
    FROM rows_ GROUP BY 1""",
)
def event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir).withColumn("grp", F.col("chart") % 20)
    found = corpus.event_shares(rows, ["grp"])
    return found.select("grp", rounded("jump_share").alias("jump_share"), rounded("freeze_share").alias("freeze_share"))


@query(
    "interval_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.01) + 1e-9, 6) AS p01, round(quantile_cont(value, 0.05) + 1e-9, 6) AS p05,
      round(quantile_cont(value, 0.5) + 1e-9, 6) AS p50 FROM events GROUP BY 1""",
)
def interval_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "value")
    found = corpus.interval_percentiles(events, ["event_type"], "value", segment=10.0)
    return found.select("event_type", *[rounded(c).alias(c) for c in ("p01", "p05", "p50")])


@query(
    "usable_charts",
    f"""WITH {LINE_ROWS_SQL}, {"ex AS (SELECT o_orderkey AS chart, o_custkey AS song, o_orderpriority AS p FROM orders)"},
    n AS (SELECT chart, count(*) AS n FROM rows_ GROUP BY 1)
    SELECT ex.chart, ex.song FROM ex JOIN n USING (chart)
    WHERE n >= 3 AND p IN ('1-URGENT', '2-HIGH') AND song % 100 >= 64""",
)
def usable_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("o_orderpriority") == "1-URGENT", "Challenge").when(
        F.col("o_orderpriority") == "2-HIGH", "Hard"
    )
    charts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("chart"),
        F.col("o_custkey").alias("song"),
        F.coalesce(names, F.col("o_orderpriority")).alias("difficulty"),
    )
    songs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("song"), (F.col("c_custkey") % 100).alias("slot_count")
    )
    kept = prep.usable_charts(charts, line_rows(spark, sf_dir), songs, ["song"], ["chart"], min_rows=3)
    return kept.select("chart", "song")


@query(
    "trusted_timing",
    """SELECT c_custkey AS song FROM customer WHERE c_nationkey % 2 = 0 AND c_acctbal > 0 AND c_nationkey % 3 <> 1
      AND c_custkey % 7 <> 0 AND c_custkey % 60 >= 30""",
)
def trusted_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("song"),
        (F.col("c_nationkey") % 2 == 0).alias("constant_bpm"),
        (F.col("c_acctbal") > 0).alias("offset_declared"),
        (F.col("c_nationkey") % 3 == 1).cast("int").alias("stops"),
        (F.col("c_custkey") % 7).cast("double").alias("primary_bpm"),
        (F.col("c_custkey") % 60).alias("seconds"),
    )
    return prep.trusted_timing(songs, seconds="seconds").select("song")


DIGITS_SQL = """
d AS (SELECT doc_id, sha1(text) AS h FROM documents),
b AS (SELECT doc_id, h,
  (16 * list_sum(list_transform(range(1, 40), lambda i: instr('0123456789abcdef', substr(h, i::INT, 1)) - 1))
    + instr('0123456789abcdef', substr(h, 40, 1)) - 1)::BIGINT % 20 AS bucket,
  ('0x' || substr(h, 1, 8))::BIGINT % 8 AS prefix_bucket FROM d)"""


@query(
    "hash_split",
    f"""WITH {DIGITS_SQL} SELECT doc_id, substr(h, 1, 2) AS prefix, bucket, prefix_bucket, (bucket < 2)::BIGINT AS validation FROM b""",
)
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prep.hash_split(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    digest = scalars.cache_key(F.col("text"))
    return docs.select(
        "doc_id",
        F.substring(digest, 1, 2).alias("prefix"),
        scalars.stem_bucket(F.col("text")).cast("bigint").alias("bucket"),
        scalars.prefix_bucket(digest).cast("bigint").alias("prefix_bucket"),
        *big("validation"),
    )


@query(
    "safe_names",
    r"""WITH a AS (SELECT page_id, regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '', 'g') AS n FROM pages),
    b AS (SELECT page_id, trim(substr(regexp_replace(trim(n), '[. ]+$', ''), 1, 120)) AS n FROM a)
    SELECT page_id, coalesce(nullif(n, ''), 'Untitled') AS name FROM b""",
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", scalars.safe_name(F.col("url")).alias("name"))


@query(
    "chart_hash",
    r"""SELECT doc_id, md5(regexp_replace(replace(text, chr(13), ''), '//[^\n]*', '', 'g')) AS digest FROM documents""",
)
def chart_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", scalars.chart_hash(F.col("text")).alias("digest"))


@query(
    "examples",
    f"""WITH {PARTS_SQL},
    s AS (SELECT p_partkey, sha1(sha1(p_partkey::VARCHAR)) AS h FROM part),
    b AS (SELECT p_partkey, (16 * list_sum(list_transform(range(1, 40), lambda i: instr('0123456789abcdef', substr(h, i::INT, 1)) - 1))
      + instr('0123456789abcdef', substr(h, 40, 1)) - 1)::BIGINT % 20 AS bucket FROM s)
    SELECT p_partkey::VARCHAR AS simfile, pack, scale, least(greatest(meter, 0), 20)::BIGINT AS meter,
      CASE WHEN p_type = 'ECONOMY' THEN 2 WHEN p_type = 'STANDARD' THEN 1 ELSE 0 END::BIGINT AS style,
      CASE WHEN p_size % 3 = 0 THEN 3 WHEN p_size % 3 = 1 THEN 0 ELSE 5 END::BIGINT AS difficulty, (bucket < 2)::BIGINT AS validation
    FROM charts JOIN scales USING (pack) JOIN part USING (p_partkey) JOIN b USING (p_partkey)""",
)
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    base = part_charts(spark, sf_dir).join(parts, "p_partkey").withColumn(
        "simfile", F.col("p_partkey").cast("string")
    )
    charts = base.select(
        "simfile",
        F.lit(0).alias("chart_idx"),
        F.when(F.col("p_size") % 3 == 0, "Hard").when(F.col("p_size") % 3 == 1, "Beginner").otherwise("?").alias("difficulty"),
        "meter",
        F.when(F.col("p_type") == "ECONOMY", "keyboard").when(F.col("p_type") == "STANDARD", "hands").otherwise("-").alias("style"),
    )
    songs = base.select("simfile", "pack", F.col("p_retailprice").alias("primary_bpm"))
    made = prep.examples(charts, songs, corpus.pack_scales(part_charts(spark, sf_dir)))
    return made.select("simfile", "pack", *big("scale", "meter", "style", "difficulty", "validation"))


@query(
    "mirrors",
    f"""WITH {LINE_ROWS_SQL}, m(mirror, a, b, c, d) AS (VALUES (0, 1, 2, 3, 4), (1, 4, 2, 3, 1), (2, 1, 3, 2, 4), (3, 4, 3, 2, 1))
    SELECT chart, slot::BIGINT AS slot, mirror::BIGINT AS mirror,
      substr(txt, a, 1) || substr(txt, b, 1) || substr(txt, c, 1) || substr(txt, d, 1) AS codes FROM rows_, m""",
)
def mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = prep.mirrors(line_rows(spark, sf_dir))
    return turned.select("chart", *big("slot", "mirror"), scalars.code_text(F.col("codes")).alias("codes"))


@query(
    "augment_mirrors",
    f"""WITH {LINE_ROWS_SQL}, m(mirror, a, b, c, d) AS (VALUES (0, 1, 2, 3, 4), (1, 4, 2, 3, 1), (2, 1, 3, 2, 4), (3, 4, 3, 2, 1)),
    p AS (SELECT *, CASE WHEN chart % 20 < 2 THEN 0 ELSE {drawn_sql("'7/' || chart")} % 4 END AS pick FROM rows_)
    SELECT chart, slot::BIGINT AS slot, mirror::BIGINT AS mirror,
      substr(txt, a, 1) || substr(txt, b, 1) || substr(txt, c, 1) || substr(txt, d, 1) AS codes FROM p JOIN m ON mirror = pick""",
)
def augment_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir)
    turned = prep.augment_mirrors(rows, ["chart"], 7, validation=F.col("chart") % 20 < 2)
    return turned.select("chart", *big("slot", "mirror"), scalars.code_text(F.col("codes")).alias("codes"))


@query(
    "chart_windows",
    f"""WITH {PATTERN_SQL},
    tok AS (SELECT p.chart, p.slot // 48 * 48 AS start, p.slot % 48 AS loc, coalesce(r.token, 0) AS token
      FROM pat p LEFT JOIN (SELECT * FROM ranked WHERE token < 64) r ON r.pattern = p.pattern),
    ctx AS (SELECT *, row_number() OVER w AS rn, coalesce(lag(token) OVER w, 64) AS prev,
        least(loc - coalesce(lag(loc) OVER w, loc), 96) AS delta
      FROM tok WINDOW w AS (PARTITION BY chart, start ORDER BY loc)),
    pad AS (SELECT c.chart, c.start, g.i, coalesce(x.token, -100) AS token, coalesce(x.prev, 64) AS prev,
        coalesce(x.delta, 0) AS delta, coalesce(x.loc, 0) AS loc
      FROM (SELECT DISTINCT chart, start FROM ctx) c CROSS JOIN (SELECT unnest(generate_series(1, (SELECT max(rn) FROM ctx))) AS i) g
      LEFT JOIN ctx x ON x.chart = c.chart AND x.start = c.start AND x.rn = g.i),
    arr AS (SELECT chart, start, string_agg(token::VARCHAR, ',' ORDER BY i) AS pattern_target,
        string_agg(prev::VARCHAR, ',' ORDER BY i) AS previous, string_agg(delta::VARCHAR, ',' ORDER BY i) AS delta,
        string_agg(((loc + start) % 48)::VARCHAR, ',' ORDER BY i) AS step_position FROM pad GROUP BY 1, 2),
    plc AS (SELECT c.chart, c.start, string_agg((x.loc IS NOT NULL)::INT::VARCHAR, '' ORDER BY g.i) AS placement
      FROM (SELECT DISTINCT chart, start FROM ctx) c CROSS JOIN generate_series(0, 47) g(i)
      LEFT JOIN ctx x ON x.chart = c.chart AND x.start = c.start AND x.loc = g.i GROUP BY 1, 2)
    SELECT chart, start::BIGINT AS start, (SELECT count(*) FROM ctx x WHERE x.chart = a.chart AND x.start = a.start) AS steps,
      pattern_target, previous, delta, step_position, placement FROM arr a JOIN plc USING (chart, start)""",
)
def chart_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir)
    windows = prep.chart_windows(
        rows, corpus.build_vocabulary(rows, 64), ["chart"], measures=1
    )
    lists = ("pattern_target", "previous", "delta", "step_position")
    return windows.select(
        "chart",
        *big("start", "steps"),
        *[F.array_join(c, ",").alias(c) for c in lists],
        F.array_join("placement", "").alias("placement"),
    )


@query(
    "step_context",
    f"""WITH {PATTERN_SQL},
    tok AS (SELECT p.chart, p.slot, coalesce(r.token, 0) AS token
      FROM pat p LEFT JOIN (SELECT * FROM ranked WHERE token < 64) r ON r.pattern = p.pattern)
    SELECT chart, slot::BIGINT AS slot, token, coalesce(lag(token) OVER w, 64) AS previous,
      least(slot - coalesce(lag(slot) OVER w, slot), 96)::BIGINT AS delta FROM tok WINDOW w AS (PARTITION BY chart ORDER BY slot)""",
)
def step_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir)
    tokens = corpus.tokenize(rows, corpus.build_vocabulary(rows, 64))
    return prep.step_context(tokens, ["chart"], 64).select("chart", *big("slot", "token", "previous", "delta"))


@query(
    "balanced_sample",
    f"""WITH o AS (SELECT o_orderkey, o_orderpriority AS style, {drawn_sql("'11/' || o_orderkey")} % 65536 AS b FROM orders),
    r AS (SELECT o_orderkey, style, row_number() OVER (PARTITION BY style ORDER BY b, o_orderkey) - 1 AS i FROM o),
    g AS (SELECT style, count(*) AS size, row_number() OVER (ORDER BY {drawn_sql("'11/groups/' || style")} % 1024, style) - 1 AS g FROM o GROUP BY style),
    d AS (SELECT t.i AS draw, floor({drawn_sql("'11/group/' || t.i")} / 4503599627370496.0::DOUBLE * (SELECT count(*) FROM g))::BIGINT AS g,
      {drawn_sql("'11/row/' || t.i")} / 4503599627370496.0::DOUBLE AS u FROM generate_series(0, 4999) t(i))
    SELECT draw, style, o_orderkey FROM d JOIN g USING (g) JOIN r USING (style) WHERE i = floor(u * size)::BIGINT""",
)
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("style"))
    return prep.balanced_sample(orders, "style", ["o_orderkey"], 5000, 11)


@query(
    "stratified_auc",
    """WITH s AS (SELECT lang, n_chars, quality FROM labels JOIN documents USING (doc_id) WHERE doc_id % 2 = 0),
    r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS mid FROM s),
    g AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n,
      sum(CASE WHEN quality = 1 THEN mid ELSE 0 END) AS ranks FROM r GROUP BY lang)
    SELECT lang, p AS positives, n AS negatives,
      CASE WHEN p >= 8 AND n >= 8 THEN round((ranks - p * (p + 1) / 2.0) / (p * n) + 1e-9, 6) END AS auc FROM g""",
)
def stratified_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    scored = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    found = metrics.stratified_auc(
        scored, ["lang"], 2, score="n_chars", label="quality", position="doc_id", segment=500.0
    )
    return found.select("lang", *big("positives", "negatives"), rounded("auc").alias("auc"))


@query(
    "median_metric",
    "SELECT source, round(median(n_chars / 7) + 1e-9, 6) AS median FROM documents GROUP BY source",
)
def median_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", (F.col("n_chars") / 7).alias("metric"))
    found = stats.median(docs, ["source"], F.col("metric"), segment=200.0)
    return found.select("source", rounded("median").alias("median"))


@query(
    "phase_metrics",
    """WITH g AS (SELECT abs(doc_id * 7 % 96 - n_chars % 96) AS d FROM documents),
    h AS (SELECT least(d, 96 - d) AS gap FROM g)
    SELECT round(avg((gap = 0)::INT) + 1e-9, 6) AS exact, round(avg((gap <= 1)::INT) + 1e-9, 6) AS within_one_bin,
      round(avg((gap <= 2)::INT) + 1e-9, 6) AS within_two_bins, round(avg((abs(gap - 12) <= 1)::INT) + 1e-9, 6) AS half_beat_out FROM h""",
)
def phase_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") * 7 % 96).alias("p"), (F.col("n_chars") % 96).alias("a")
    )
    found = metrics.phase_metrics(docs, "p", "a")
    return found.select(*[rounded(c).alias(c) for c in found.columns])


@query(
    "timing_accuracy",
    """WITH b AS (SELECT 60 + p_size AS tb, 60 + p_size + (p_partkey % 5 - 2) * 0.3 AS bpm, p_retailprice / 7 AS o, p_retailprice / 7 + (p_partkey % 11) * 0.0173 AS o2 FROM part),
    e AS (SELECT abs(bpm - tb) <= 0.5 AS ok, 60 / tb AS beat, (o2 - o) - floor((o2 - o) / (60 / tb)) * (60 / tb) AS d FROM b),
    f AS (SELECT ok, beat, least(d, beat - d) AS err FROM e)
    SELECT round(avg(ok::INT) + 1e-9, 6) AS tempo_right, round(avg((err <= 0.03)::INT) FILTER (WHERE ok) + 1e-9, 6) AS offset_right,
      round(avg((abs(err - beat / 2) <= 0.03)::INT) FILTER (WHERE ok) + 1e-9, 6) AS half_beat_out,
      round(avg((ok AND err <= 0.03)::INT) + 1e-9, 6) AS both_right, round(median(err) FILTER (WHERE ok) + 1e-9, 6) AS median_error FROM f""",
)
def timing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    pairs = table(spark, sf_dir, "part").select(
        (size + 60).alias("true_bpm"),
        (size + 60 + (key % 5 - 2) * F.lit(0.3)).alias("bpm"),
        (F.col("p_retailprice") / 7).alias("true_offset"),
        (F.col("p_retailprice") / 7 + (key % 11) * F.lit(0.0173)).alias("offset"),
    )
    found = metrics.timing_accuracy(pairs)
    return found.select(*[rounded(c).alias(c) for c in found.columns])


@query(
    "to_slots",
    f"""WITH {LINE_ROWS_SQL}, b AS (SELECT chart, txt, (slot + 0.5 * (chart % 3)) / 12.0::DOUBLE - 1 AS beat FROM rows_)
    SELECT chart, round_even(beat * 12, 0)::BIGINT AS slot, txt AS codes FROM b
    WHERE round_even(beat * 12, 0) >= 0 AND round_even(beat * 12, 0) < 20 + chart % 40""",
)
def to_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir).select(
        "chart",
        ((F.col("slot") + F.lit(0.5) * (F.col("chart") % 3)) / 12.0 - 1).alias("beat"),
        scalars.code_text(F.col("codes")).alias("columns"),
    )
    counts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("chart"), (F.col("o_orderkey") % 40 + 20).alias("slot_count")
    )
    placed = grid.chart_targets(rows, counts, ["chart"])
    return placed.select("chart", *big("slot"), scalars.code_text(F.col("codes")).alias("codes"))


@query(
    "placement",
    f"""WITH {LINE_ROWS_SQL}
    SELECT o_orderkey AS chart, g.i::BIGINT AS slot, (r.chart IS NOT NULL)::BIGINT AS placed
    FROM orders CROSS JOIN generate_series(0, 63) g(i)
    LEFT JOIN (SELECT * FROM rows_ WHERE notes > 0) r ON r.chart = o_orderkey AND r.slot = g.i""",
)
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chart"), F.lit(64).alias("slot_count"))
    placed = grid.placement(line_rows(spark, sf_dir), counts, ["chart"])
    return placed.select("chart", *big("slot", "placed"))
