"""From chart files to the song manifest, and incremental feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import cache_key, panel_codes
from tactus.operators import play, timing
from tactus.operators.ordered import settle
from tactus.sources import ledger, msd
from tactus.sources.dwi import dwi_rows
from tactus.sources.files import choose_simfile, decode_text, resolve_audio

SONG = ["song_id"]
CHART = ["song_id", "chart_idx"]


@dataclass(frozen=True)
class Corpus:
    """Tables of a parsed corpus."""

    songs: DataFrame
    charts: DataFrame
    rows: DataFrame
    tempo: DataFrame
    stops: DataFrame


def parse_files(files: DataFrame) -> DataFrame:
    """One row per chosen file with its tags and header; ``song_id`` is its path.

    Files come with their ``content``, or with the ``text`` that :func:`scan_texts` has read; files without one are not chosen.
    """
    text = F.col("text") if "text" in files.columns else decode_text(F.col("content"))
    chosen = choose_simfile(files.where(F.col("text").isNotNull()) if "text" in files.columns else files)
    texts = chosen.select(
        F.col("path").alias("song_id"),
        "pack",
        "song",
        "directory",
        F.col("suffix").alias("file_format"),
        msd.msd_tags(text).alias("tags"),
    )
    return msd.song_header(texts)


def parse_corpus(files: DataFrame, *, once: bool = False) -> Corpus:
    """P01-P11 over a whole corpus.

    With ``once`` the tags are kept at a checkpoint, so no table reads or parses the files again.
    """
    parsed = parse_files(files)
    if once:
        parsed = settle(parsed)
    charts = msd.chart_table(parsed, SONG)
    text_rows = msd.chart_rows(charts.where("file_format <> 'dwi'"), CHART)
    coded = text_rows.select(
        *CHART, "beat", panel_codes(F.col("columns"), None).alias("codes")
    )
    streams = charts.where("file_format = 'dwi'")
    rows = coded.unionByName(dwi_rows(streams, CHART))
    return Corpus(
        songs=parsed,
        charts=charts,
        rows=rows,
        tempo=msd.tempo_segments(parsed, SONG),
        stops=msd.stop_segments(parsed, SONG),
    )


def singles(charts: DataFrame) -> DataFrame:
    """F01 - four-panel charts only."""
    return charts.where(F.col("stepstype") == "dance-single")


def panel_count(stepstype: Column) -> Column:
    """Panels a chart type is played on; anything but a single counts as two pads."""
    return F.when(stepstype == "dance-single", F.lit(4)).otherwise(F.lit(8))


def keyboard_override(
    pack: Column,
    song: Column,
    packs: Sequence[str] = k.KEYBOARD_PACKS,
    songs: Sequence[str] = k.KEYBOARD_SONGS,
) -> Column:
    """F04 - whether a pack or a song directory is known to be written for the keyboard."""
    return pack.isin(*packs) | song.isin(*songs)


def timed_rows(corpus: Corpus) -> DataFrame:
    """Rows of four-panel charts with the second each falls on."""
    wanted = corpus.rows.join(singles(corpus.charts).select(*CHART), CHART, "left_semi")
    points = timing.breakpoints(
        corpus.tempo, corpus.stops, corpus.songs, SONG, listed="listed"
    )
    return timing.time_at_beat(wanted, points, SONG, probe_id=["chart_idx", "beat"], out="t")


def build_manifest(
    files: DataFrame, listing: DataFrame, keyboard: Column | None = None
) -> DataFrame:
    """S05 - one row per usable song with its charts nested, in file order.

    Songs without a usable tempo or without audio are left out (see :func:`rejects`).
    """
    corpus = parse_corpus(files, once=True)
    located = resolve_audio(corpus.songs, listing).where(F.col("audio").isNotNull())
    summary = timing.timing_summary(corpus.tempo, corpus.stops, SONG, listed="listed")
    report = play.playability(timed_rows(corpus), CHART, ["t", "beat"])
    counts = corpus.rows.groupBy(*CHART).agg(F.count(F.lit(1)).alias("n_rows"))
    override = keyboard if keyboard is not None else keyboard_override(F.col("pack"), F.col("song"))
    styled = (
        singles(corpus.charts)
        .where(F.col("meter").isNotNull())
        .join(counts, CHART, "left")
        .join(report.select(*CHART, F.col("style").alias("__style")), CHART, "left")
        .join(corpus.songs.select(*SONG, override.alias("__keyboard")), SONG)
    )
    chart = F.struct(
        "chart_idx",
        "difficulty",
        "meter",
        F.coalesce("n_rows", F.lit(0)).alias("rows"),
        F.when(F.col("__keyboard"), F.lit("keyboard"))
        .otherwise(F.coalesce("__style", F.lit("feet")))
        .alias("style"),
    )
    nested = styled.groupBy(*SONG).agg(
        F.transform(
            F.array_sort(F.collect_list(chart)),
            lambda c: F.struct(c["difficulty"], c["meter"], c["rows"], c["style"]),
        ).alias("charts")
    )
    bpms = corpus.songs.select(
        *SONG,
        F.transform(
            msd.tempo_pairs(F.col("tags"), F.col("file_format")),
            lambda p: F.struct(p["beat"].alias("beat"), p["value"].alias("bpm")),
        ).alias("bpms"),
    )
    none = F.expr("array()").cast(
        "array<struct<difficulty:string,meter:int,rows:bigint,style:string>>"
    )
    return (
        located.join(summary, SONG)
        .join(bpms, SONG)
        .join(nested, SONG, "left")
        .select(
            "song_id",
            "pack",
            F.col("song_id").alias("simfile"),
            "audio",
            "title",
            "file_format",
            "offset",
            "offset_declared",
            "primary_bpm",
            "bpms",
            "constant_bpm",
            F.col("stops").cast("int").alias("stops"),
            "sample_start",
            "sample_length",
            F.coalesce("charts", none).alias("charts"),
        )
    )


def rejects(files: DataFrame, listing: DataFrame) -> DataFrame:
    """S06 - what a scan leaves out or had to guess at: ``(song_id, reason)``, ``song_id`` being a path.

    * ``unreadable``: a file or folder whose bytes could not be read; ``not_utf8``: a file that was read in another encoding
      (both only of files from :func:`scan_texts`, which says so);
    * ``unparsed``: a chosen file without any tag; ``no_tempo``, ``no_audio``: a song that lacks what it takes;
    * ``bad_meter``: a chart whose rating is not finite (one row each); ``no_simfile``: a song folder without a readable chart file.
    """
    parsed = settle(parse_files(files))
    located = resolve_audio(parsed, listing)
    tempo = F.size(msd.tempo_pairs(F.col("tags"), F.col("file_format")))
    reason = (
        F.when(F.size("tags") == 0, F.lit("unparsed"))
        .when(tempo <= 0, F.lit("no_tempo"))
        .when(F.col("audio").isNull(), F.lit("no_audio"))
    )
    found = located.select("song_id", reason.alias("reason")).where(F.col("reason").isNotNull())
    charts = (
        msd.chart_table(parsed, SONG)
        .where(F.col("meter").isNull())
        .select("song_id", F.lit("bad_meter").alias("reason"))
    )
    found = found.unionByName(charts)
    with_file = files
    if "error" in files.columns:
        why = F.when(F.col("error").isNotNull(), F.lit("unreadable")).when(F.col("encoding") != "utf-8", F.lit("not_utf8"))
        found = found.unionByName(files.select(F.col("path").alias("song_id"), why.alias("reason")).where(F.col("reason").isNotNull()))
        with_file = files.where(F.col("error").isNull())
    empty = (
        listing.select("directory")
        .distinct()
        .join(with_file.select("directory").distinct(), "directory", "left_anti")
        .select(F.col("directory").alias("song_id"), F.lit("no_simfile").alias("reason"))
    )
    return found.unionByName(empty)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Sink of S05: JSON lines, one song each."""
    manifest.write.mode("overwrite").json(path)


def with_cache_key(df: DataFrame, source: str, digits: int = 40) -> DataFrame:
    """Add the digest that names an entry and the two characters it is filed under."""
    return df.withColumn("key", F.substring(cache_key(F.col(source)), 1, digits)).withColumn(
        "prefix", F.substring("key", 1, 2)
    )


def not_yet_built(df: DataFrame, built: DataFrame, key: str = "key") -> DataFrame:
    """U02 - rows whose key is not in the target yet."""
    return df.join(built.select(key).distinct(), key, "left_anti")


def build_incremental(df: DataFrame, target: str, source: str, digits: int = 40) -> None:
    """S07 - add the entries the target does not have, filed by the first two digits of the key.

    A run shows all at once or not at all, and a run that is repeated adds nothing twice (see
    :mod:`tactus.sources.ledger`). All rows of a source make up its entry, which is taken whole or not at all.
    """
    ledger.add(with_cache_key(df, source, digits), target, "key", ["prefix"])


def read_features(
    spark: SparkSession, path: str, order_by: Sequence[str] | None = None
) -> DataFrame:
    """S08 - entries of the runs that are done, sorted only on request. Files that cannot be read are left out."""
    table = ledger.read(spark, path)
    if table is None:
        raise FileNotFoundError(f"no run has been committed to {path}")
    # As a folder's name it might be taken for a number.
    table = table.withColumn("prefix", F.substring("key", 1, 2))
    return table.orderBy(*order_by) if order_by else table


def write_vocab(vocab: DataFrame, path: str) -> None:
    """S14 - save a vocabulary; its order is the ``token`` column."""
    vocab.write.mode("overwrite").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """S14 - load a vocabulary in token order."""
    return spark.read.parquet(path).orderBy("token")
