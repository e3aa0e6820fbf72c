"""Finding and decoding chart files."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.functions import constants as k
from tactus.sources.store import NAME, SongFolders, opened

SIMFILES = "*.{[sS][sS][cC],[sS][mM],[dD][wW][iI]}"


def _located(files: DataFrame) -> DataFrame:
    """Split a path into directory, pack, song, file name and lower-case suffix."""
    parts = F.split(F.col("path"), "/")
    name = F.element_at(parts, -1)
    return files.withColumns(
        {
            "directory": F.regexp_replace("path", "/[^/]*$", ""),
            "pack": F.element_at(parts, -3),
            "song": F.element_at(parts, -2),
            "file": name,
            "suffix": F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)),
        }
    )


def scan_corpus(
    spark: SparkSession, root: str, excluded: Sequence[str] = k.EXCLUDED_PACKS
) -> DataFrame:
    """S01 - every chart file at ``root/pack/song/file``, packs in ``excluded`` left out.

    Only paths are looked at until a later operator asks for ``content``, so files that are filtered
    out or not chosen are not read. Unreadable files are skipped.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", SIMFILES)
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
        .select("path", "content")
    )
    return _at_depth(_located(files), root).where(~F.col("pack").isin(*excluded))


def _with_scheme() -> Column:
    """Paths as Spark writes them, local ones with one slash."""
    return F.when(F.startswith("path", F.lit("/")), F.concat(F.lit("file:"), "path")).otherwise(F.col("path"))


def scan_texts(
    spark: SparkSession, root: str, excluded: Sequence[str] = k.EXCLUDED_PACKS
) -> DataFrame:
    """S01 and S03 in one pass - every chart file with its ``text`` and ``encoding``, or the ``error`` that kept it from being read.

    Bytes are decoded once, in the task that reads them. Packs and songs that cannot be listed come as rows with an error too.
    Reads through Arrow's file systems; stores that only Spark reaches are scanned with :func:`scan_corpus`.
    """
    spark.dataSource.register(SongFolders)
    options = {"excluded": "/".join(excluded)}
    local = _with_scheme()
    found = spark.read.format(NAME).options(**options).load(root)
    return found.withColumns({"path": local, "directory": F.regexp_replace(local, "/[^/]*$", "")})


def _at_depth(files: DataFrame, root: str) -> DataFrame:
    """Keep files exactly two directories below the root."""
    # Roots may be named without the scheme and host that listed paths have.
    tail = re.sub(r"^[a-zA-Z][\w+.-]*:/*", "/", root).rstrip("/")
    above = F.regexp_replace("path", "(/[^/]*){3}$", "")
    return files.where(F.endswith(above, F.lit(tail)))


def list_files(
    spark: SparkSession, root: str, excluded: Sequence[str] = k.EXCLUDED_PACKS
) -> DataFrame:
    """Names of all files of a corpus, without their contents; packs in ``excluded`` left out.

    Songs are listed in tasks, and names stay there. Folders that cannot be listed are left out (:func:`scan_texts` tells
    them). Of stores that only Spark reaches the driver holds the listing.
    """
    try:
        opened(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
        return _at_depth(_located(files), root).where(~F.col("pack").isin(*excluded))
    spark.dataSource.register(SongFolders)
    found = spark.read.format(NAME).options(excluded="/".join(excluded), names="true").load(root).where("error is null")
    return _located(found.select(_with_scheme().alias("path")))


def choose_simfile(files: DataFrame) -> DataFrame:
    """S02 - one file per song directory: by format first, then by name."""
    rank = F.array_position(F.array(*[F.lit(s) for s in k.SIMFILE_SUFFIXES]), F.col("suffix"))
    first = Window.partitionBy("directory").orderBy(rank, "file")
    return (
        files.where(rank > 0)
        .withColumn("__n", F.row_number().over(first))
        .where("__n = 1")
        .drop("__n")
    )


@F.pandas_udf(T.StringType())
def _legacy_text(content: pd.Series) -> pd.Series:
    """Text of files that are not UTF-8: the Japanese code page, or one character per byte."""

    def decode(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return bytes(raw).decode("cp932")
        except UnicodeDecodeError:
            return bytes(raw).decode("latin-1")

    return content.map(decode)


def decode_text(content: Column) -> Column:
    """S03 - text of a file. Every row goes by a Python worker, those in UTF-8 without their bytes; see :func:`scan_texts`."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, content.cast("string")).otherwise(
        _legacy_text(F.when(~valid, content))
    )


def resolve_audio(songs: DataFrame, listing: DataFrame, music: str = "music") -> DataFrame:
    """S04 - add ``audio``: the named file, else the same name in another case, else by suffix.

    NULL when the directory has no audio at all. Files of one name count as the one with the smallest path.
    Each way of finding a file is an aggregate of the listing and an equi-join on what it is found by, so no
    song meets all files of its directory, and songs may share one.
    """
    suffix = F.array_position(F.array(*[F.lit(s) for s in k.AUDIO_SUFFIXES]), F.col("suffix"))

    def way(kind: int, name: Column, rank: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), rank.alias("rank"))

    # One pass over the listing: every file under the names it may be found by.
    ways = [way(1, F.col("file"), F.lit(0)), way(2, F.lower("file"), F.lit(0)), F.when(suffix > 0, way(3, F.lit(""), suffix.cast("int")))]
    best = (
        listing.select("directory", "file", "path", F.explode(F.array_compact(F.array(*ways))).alias("__w"))
        .groupBy("directory", F.col("__w.kind").alias("__kind"), F.col("__w.name").alias("__name"))
        .agg(F.min(F.struct("__w.rank", "file", "path")).alias("__best"))
    )
    m, none = F.col(music), F.lit(0)
    wanted = [way(1, m, none), F.when(m != "", way(2, F.lower(m), none)), way(3, F.lit(""), none)]
    asked = songs.select("directory", music).distinct().select("directory", music, F.explode(F.array_compact(F.array(*wanted))).alias("__w"))
    picked = (
        asked.select("directory", music, F.col("__w.kind").alias("__kind"), F.col("__w.name").alias("__name"))
        .join(best, ["directory", "__kind", "__name"])
        .groupBy(F.col("directory").alias("__in"), m.alias("__for"))
        .agg(F.min_by(F.col("__best.path"), F.col("__kind")).alias("audio"))
    )
    return songs.join(
        picked, F.col("directory").eqNullSafe(F.col("__in")) & F.col(music).eqNullSafe(F.col("__for")), "left"
    ).drop("__in", "__for")
