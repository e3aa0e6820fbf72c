"""Song folders written, scanned and parsed back: every supplier is a song in the pack of its nation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.operators.ordered import shared_folder
from tactus.plans.bindings import rounded, table
from tactus.plans.registry import query
from tactus.sources import files, ledger, manifest, render

#: Which suppliers lack what: each is every n-th of them.
NO_AUDIO, NO_TEMPO, BLANK, LEGACY, NO_CHART, BAD_METER = 7, 11, 13, 17, 19, 5

FACTS_SQL = f"""f AS (SELECT s_suppkey AS k, s_nationkey AS pack, CASE s_suppkey % 3 WHEN 0 THEN 'dwi' WHEN 1 THEN 'sm' ELSE 'ssc' END AS fmt,
      s_suppkey % {NO_AUDIO} = 0 AS no_audio, s_suppkey % {NO_TEMPO} = 0 AS no_tempo, s_suppkey % {BLANK} = 0 AS blank,
      s_suppkey % {LEGACY} = 0 AS legacy, s_suppkey % {NO_CHART} = 0 AS no_chart, s_suppkey % {BAD_METER} = 0 AS bad_meter FROM supplier),
    c AS (SELECT * FROM f WHERE NOT no_chart)"""


def _every(n: int) -> Column:
    return F.col("s_suppkey") % n == 0


def song_folders(spark: SparkSession, sf_dir: str) -> str:
    """Write a folder for each supplier, with a chart file, an audio file, both or neither; its root."""
    root = f"{shared_folder(spark)}/songs-{uuid.uuid4().hex}"
    songs = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    key = F.col("s_suppkey")
    text = key.cast("string")
    title = F.concat(F.when(_every(LEGACY), F.lit("曲")).otherwise(F.lit("Song ")), text)
    bpm = F.when(_every(NO_TEMPO), F.lit("0")).otherwise((60 + key % 200).cast("string"))
    meter = F.when(_every(BAD_METER), F.lit("inf")).otherwise((1 + key % 9).cast("string"))
    # A song with a stop has no constant tempo.
    stops, freeze = (F.when(_every(2), F.lit(x)).otherwise(F.lit("")) for x in ("2=0.5", "8=500"))
    rows = F.lit("1000\n0100\n0010\n0001\n")
    head = F.concat(F.lit("#TITLE:"), title, F.lit(";\n"))
    sm = F.concat(head, F.lit("#OFFSET:-0.25;\n#BPMS:0="), bpm, F.lit(";\n#STOPS:"), stops, F.lit(";\n#NOTES:\n dance-single:\n:\nHard:\n"), meter, F.lit(":\n:\n"), rows, F.lit(";\n"))
    ssc = F.concat(
        head, F.lit("#OFFSET:-0.25;\n#BPMS:0="), bpm,
        F.lit(";\n#STOPS:"), stops, F.lit(";\n#NOTEDATA:;\n#STEPSTYPE:dance-single;\n#DIFFICULTY:Hard;\n#METER:"), meter, F.lit(";\n#NOTES:\n"), rows, F.lit(";\n"),
    )
    dwi = F.concat(head, F.lit("#GAP:250;\n#BPM:"), bpm, F.lit(";\n#FREEZE:"), freeze, F.lit(";\n#SINGLE:MANIAC:"), meter, F.lit(":4286;\n"))
    kind = F.get(F.array(F.lit("dwi"), F.lit("sm"), F.lit("ssc")), (key % 3).cast("int"))
    body = F.when(_every(BLANK), F.lit("")).when(kind == "dwi", dwi).when(kind == "sm", sm).otherwise(ssc)
    folder = F.concat(F.lit("Pack "), F.col("s_nationkey").cast("string"), F.lit("/S"), text, F.lit("/"))
    charts = songs.where(~_every(NO_CHART)).select(
        F.concat(folder, F.lit("song."), kind).alias("path"), body.alias("text"), F.when(_every(LEGACY), F.lit("cp932")).otherwise(F.lit("utf-8")).alias("encoding")
    )
    audio = songs.where(~_every(NO_AUDIO)).select(F.concat(folder, F.lit("song.ogg")).alias("path"), F.lit("x").alias("text"), F.lit("utf-8").alias("encoding"))
    render.write_texts(charts.unionByName(audio), root)
    return root


def _number(path: str = "song_id") -> Column:
    return F.regexp_extract(path, r"/S(\d+)(/[^/]*)?$", 1).cast("bigint")


@query(
    "scan_texts",
    f"""WITH {FACTS_SQL}
    SELECT k AS s_suppkey, 'song.' || fmt AS file, fmt AS suffix, CASE WHEN legacy AND NOT blank THEN 'cp932' ELSE 'utf-8' END AS encoding,
      CASE WHEN blank THEN NULL ELSE CASE WHEN legacy THEN '曲' ELSE 'Song ' END || k END AS title FROM c""",
)
def scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.scan_texts(spark, song_folders(spark, sf_dir)).where("error is null")
    title = F.regexp_extract("text", "#TITLE:([^;]*);", 1)
    return found.select(_number("path").alias("s_suppkey"), "file", "suffix", "encoding", F.when(title != "", title).alias("title"))


@query(
    "rejects",
    f"""WITH {FACTS_SQL}
    SELECT k AS s_suppkey, CASE WHEN blank THEN 'unparsed' WHEN no_tempo THEN 'no_tempo' ELSE 'no_audio' END AS reason FROM c WHERE blank OR no_tempo OR no_audio
    UNION ALL SELECT k, 'bad_meter' FROM c WHERE bad_meter AND NOT blank
    UNION ALL SELECT k, 'not_utf8' FROM c WHERE legacy AND NOT blank
    UNION ALL SELECT k, 'no_simfile' FROM f WHERE no_chart AND NOT no_audio""",
)
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = song_folders(spark, sf_dir)
    found = manifest.rejects(files.scan_texts(spark, root), files.list_files(spark, root))
    return found.select(_number().alias("s_suppkey"), "reason")


@query(
    "build_manifest",
    f"""WITH {FACTS_SQL}
    SELECT k AS s_suppkey, 'Pack ' || pack AS pack, 'song.ogg' AS audio, CASE WHEN legacy THEN '曲' ELSE 'Song ' END || k AS title, fmt AS file_format,
      -0.25::DOUBLE AS "offset", true AS offset_declared, (60 + k % 200)::DOUBLE AS primary_bpm, 1::BIGINT AS n_bpms, k % 2 = 1 AS constant_bpm, (1 - k % 2)::BIGINT AS stops,
      CASE WHEN NOT bad_meter THEN 'Hard ' || (1 + k % 9) || ' 4 feet' END AS chart FROM c WHERE NOT (blank OR no_tempo OR no_audio)""",
)
def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = song_folders(spark, sf_dir)
    songs = manifest.build_manifest(files.scan_texts(spark, root), files.list_files(spark, root))
    first = F.get("charts", 0)
    chart = F.concat_ws(" ", first["difficulty"], first["meter"].cast("string"), first["rows"].cast("string"), first["style"])
    return songs.select(
        _number().alias("s_suppkey"), "pack", F.element_at(F.split("audio", "/"), -1).alias("audio"), "title", "file_format",
        rounded(F.col("offset")).alias("offset"), "offset_declared", rounded(F.col("primary_bpm")).alias("primary_bpm"),
        F.size("bpms").cast("bigint").alias("n_bpms"), "constant_bpm", F.col("stops").cast("bigint").alias("stops"),
        F.when(first.isNotNull(), chart).alias("chart"),
    )


class _Killed(Exception):
    pass


@query(
    "build_incremental",
    """SELECT p_brand, sha1(p_brand) AS key, substr(sha1(p_brand), 1, 2) AS prefix, count(*) AS parts, sum(p_size)::BIGINT AS size FROM part GROUP BY p_brand""",
)
def build_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the brands, then a run that ends before its commit, then all of them."""
    target = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.sum("p_size").cast("bigint").alias("size"))
    manifest.build_incremental(brands.where(F.pmod(F.xxhash64("p_brand"), F.lit(2)) == 0), target, "p_brand")

    def killed() -> None:
        raise _Killed

    try:
        ledger.add(manifest.with_cache_key(brands, "p_brand"), target, "key", ["prefix"], killed)
    except _Killed:
        pass
    manifest.build_incremental(brands, target, "p_brand")
    return manifest.read_features(spark, target).select("p_brand", "key", "prefix", "parts", "size")
