"""Chart text: measures, and the three file formats.

A rendered song is one text value, because that is what a file holds; everything up to the last
assembly step works on rows and measures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import code_text, normalize_difficulty
from tactus.operators.radar import RADAR
from tactus.sources.store import NAME, SongFolders

BLANK = "0" * k.PANELS


def subdivision(position: Column) -> Column:
    """T01 - aggregate: fewest lines a measure can be written on without moving a row."""
    fits = None
    for lines in k.MEASURE_LINES[:-1]:
        whole = F.bool_and(position % (k.SLOTS_PER_MEASURE // lines) == 0)
        fits = F.when(whole, lines) if fits is None else fits.when(whole, lines)
    return fits.otherwise(F.lit(k.MEASURE_LINES[-1]))


def measure_text(
    rows: DataFrame, keys: Sequence[str], *, slot: str = "slot", codes: str = "codes"
) -> DataFrame:
    """T02 - text of every measure that has a row. A measure never holds more than 48 slots."""
    grouped = (
        rows.select(
            *keys,
            F.floor(F.col(slot) / k.SLOTS_PER_MEASURE).cast("int").alias("measure"),
            F.pmod(F.col(slot), F.lit(k.SLOTS_PER_MEASURE)).alias("__pos"),
            code_text(F.col(codes)).alias("__text"),
        )
        .groupBy(*keys, "measure")
        .agg(
            subdivision(F.col("__pos")).alias("lines"),
            F.collect_list(F.struct("__pos", "__text")).alias("__rows"),
        )
    )
    stride = (F.lit(k.SLOTS_PER_MEASURE) / F.col("lines")).cast("int")
    written = F.transform(
        F.sequence(F.lit(0), F.col("lines") - 1),
        lambda i: F.coalesce(
            F.get(F.filter("__rows", lambda r: r["__pos"] == i * stride), F.lit(0))["__text"],
            F.lit(BLANK),
        ),
    )
    return grouped.select(*keys, "measure", "lines", F.array_join(written, "\n").alias("text"))


def _assemble(
    measures: DataFrame, keys: Sequence[str], line, separator: str, blank: Column
) -> DataFrame:
    """Join the measures of a chart in order, writing blank ones where there is no row."""
    listed = measures.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("measure", "text"))).alias("__m")
    )

    def with_gap(m: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get("__m", i - 1)["measure"])
        missing = F.when(
            m["measure"] > before + 1, F.sequence(before + 1, m["measure"] - 1)
        ).otherwise(F.expr("array()").cast("array<int>"))
        return F.concat(
            F.transform(missing, lambda j: line(j, blank)), F.array(line(m["measure"], m["text"]))
        )

    pieces = F.flatten(F.transform("__m", with_gap))
    return listed.select(*keys, F.array_join(pieces, separator).alias("notes"))


def _blank_measure() -> Column:
    return F.lit("\n".join([BLANK] * k.MEASURE_LINES[0]))


def chart_text(rows: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """Measures separated by commas, as the ``.sm`` format has them."""
    measures = measure_text(rows, keys, **columns)
    return _assemble(measures, keys, lambda _, text: text, "\n,\n", _blank_measure())


def measure_block(rows: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """T03 - measures headed by numbered comments, as the ``.ssc`` format has them."""
    measures = measure_text(rows, keys, **columns)

    def line(index: Column, text: Column) -> Column:
        comma = F.when(index == 0, F.lit("")).otherwise(F.lit(",  "))
        return F.concat(comma, F.lit("// measure "), index.cast("string"), F.lit("\n"), text)

    return _assemble(measures, keys, line, "\n", _blank_measure())


def _tag(name: str, value: Column | str) -> Column:
    body = F.lit(value) if isinstance(value, str) else F.coalesce(value, F.lit(""))
    return F.concat(F.lit(f"#{name}:"), body, F.lit(";"))


def _block(name: str, value: Column | str) -> Column:
    body = F.lit(value) if isinstance(value, str) else F.coalesce(value, F.lit(""))
    return F.when(body == "", F.lit(f"#{name}:;")).otherwise(
        F.concat(F.lit(f"#{name}:"), body, F.lit("\n;"))
    )


def _decimal(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def segment_text(
    segments: DataFrame, keys: Sequence[str], value: str, digits: int, *, scale: float = 1.0,
    beat_scale: float = 1.0,
) -> DataFrame:
    """Beat=value list of a song, in beat order."""
    pair = F.concat(
        _decimal(F.col("beat") * F.lit(beat_scale), digits),
        F.lit("="),
        _decimal(F.col(value) * F.lit(scale), digits),
    )
    listed = F.array_sort(F.collect_list(F.struct("beat", value, pair.alias("t"))))
    return segments.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda s: s["t"]), ",").alias("segments")
    )


# Song metadata columns, and the length a preview lasts when nothing is given.
METADATA = (
    "title",
    "subtitle",
    "artist",
    "title_translit",
    "subtitle_translit",
    "artist_translit",
    "genre",
    "credit",
    "banner",
    "background",
    "cdtitle",
    "music",
)
SAMPLE_LENGTH = 15.0


def with_metadata(songs: DataFrame) -> DataFrame:
    """Give a song table every metadata column the formats name, empty where it has none."""
    added = {c: F.lit("") for c in METADATA if c not in songs.columns}
    if "sample_start" not in songs.columns:
        added["sample_start"] = F.lit(0.0)
    if "sample_length" not in songs.columns:
        added["sample_length"] = F.lit(SAMPLE_LENGTH)
    return songs.withColumns(added) if added else songs


def _timing_texts(
    songs: DataFrame, tempo: DataFrame, stops: DataFrame, keys: Sequence[str], digits: int
) -> DataFrame:
    bpms = segment_text(tempo, keys, "bpm", digits).withColumnRenamed("segments", "__bpms")
    held = segment_text(stops, keys, "seconds", digits).withColumnRenamed("segments", "__stops")
    return with_metadata(songs).join(bpms, list(keys), "left").join(held, list(keys), "left")


def _named(charts: DataFrame) -> DataFrame:
    """Charts with a difficulty the formats know; anything else is an edit."""
    name = F.col("difficulty")
    return charts.withColumn(
        "__name", F.when(name.isin(*k.DIFFICULTIES), name).otherwise(F.lit("Edit"))
    )


def _chart_section(sections: DataFrame, keys: Sequence[str], chart: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(chart, "__section")))
    return sections.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda s: s["__section"]), "\n").alias("__charts")
    )


def render_sm(
    songs: DataFrame,
    tempo: DataFrame,
    stops: DataFrame,
    charts: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    *,
    chart: str = "chart",
    credit: str = "tactus",
) -> DataFrame:
    """S09 - one ``.sm`` text per song.

    ``charts`` has the song keys, a chart key, ``difficulty`` and ``meter``; ``rows`` the same keys,
    ``slot`` and ``codes``.
    """
    notes = chart_text(rows, [*keys, chart])
    by = F.coalesce(F.nullif(F.col("credit"), F.lit("")), F.lit(credit))
    head = _timing_texts(songs, tempo, stops, keys, 3)
    parts = (
        _named(charts)
        .join(notes, [*keys, chart], "left")
        .join(with_metadata(songs).select(*keys, "credit"), list(keys))
    )
    sections = parts.withColumn(
        "__section",
        F.concat_ws(
            "\n",
            F.lit("#NOTES:"),
            F.lit("     dance-single:"),
            F.concat(F.lit("     "), by, F.lit(":")),
            F.concat(F.lit("     "), F.col("__name"), F.lit(":")),
            F.concat(F.lit("     "), F.col("meter").cast("string"), F.lit(":")),
            F.lit("     0.000,0.000,0.000,0.000,0.000:"),
            F.coalesce("notes", _blank_measure()),
            F.lit(";"),
            F.lit(""),
        ),
    )
    body = _chart_section(sections, keys, chart)
    text = F.concat_ws(
        "\n",
        _tag("TITLE", F.col("title")),
        _tag("SUBTITLE", F.col("subtitle")),
        _tag("ARTIST", F.col("artist")),
        _tag("TITLETRANSLIT", F.col("title_translit")),
        _tag("SUBTITLETRANSLIT", F.col("subtitle_translit")),
        _tag("ARTISTTRANSLIT", F.col("artist_translit")),
        _tag("GENRE", F.col("genre")),
        _tag("CREDIT", F.col("credit")),
        _tag("BANNER", F.col("banner")),
        _tag("BACKGROUND", F.col("background")),
        _tag("CDTITLE", F.col("cdtitle")),
        _tag("MUSIC", F.col("music")),
        _tag("OFFSET", _decimal(F.col("offset"), 6)),
        _tag("SAMPLESTART", _decimal(F.col("sample_start"), 3)),
        _tag("SAMPLELENGTH", _decimal(F.col("sample_length"), 3)),
        _tag("SELECTABLE", "YES"),
        _tag("BPMS", F.col("__bpms")),
        _tag("STOPS", F.col("__stops")),
        F.lit(""),
        F.col("__charts"),
    )
    return head.join(body, list(keys), "left").select(*keys, text.alias("text"))


# The version an ``.ssc`` file declares, and the tags it writes with set contents.
SSC_VERSION = "0.83"
SSC_EMPTY_BEFORE = ("PREVIEWVID", "JACKET", "CDIMAGE", "DISCIMAGE", "LYRICSPATH")
SSC_TIMING = (
    ("DELAYS", ""),
    ("WARPS", ""),
    ("TIMESIGNATURES", "0.000000=4=4"),
    ("TICKCOUNTS", "0.000000=4"),
    ("COMBOS", "0.000000=1"),
    ("SPEEDS", "0.000000=1.000000=0.000000=0"),
    ("SCROLLS", "0.000000=1.000000"),
    ("XSCROLLS", "0.000000=0.000000"),
    ("FAKES", ""),
    ("LABELS", "0.000000=Song Start"),
)


def render_ssc(
    songs: DataFrame,
    tempo: DataFrame,
    stops: DataFrame,
    charts: DataFrame,
    rows: DataFrame,
    measured: DataFrame,
    keys: Sequence[str],
    *,
    chart: str = "chart",
    credit: str = "tactus",
) -> DataFrame:
    """S10 - one ``.ssc`` text per song.

    ``measured`` carries the radar columns of each chart and ``last_second``, the time of its last
    row; both come from the radar and timing operators.
    """
    from tactus.functions.scalars import chart_hash

    both = [*keys, chart]
    notes = measure_block(rows, both).withColumnRenamed("notes", "__text")
    by = F.coalesce(F.nullif(F.col("credit"), F.lit("")), F.lit(credit))
    values = F.array_join(F.array(*[_decimal(F.coalesce(F.col(c), F.lit(0.0)), 6) for c in RADAR]), ",")
    blank = F.concat(F.lit("// measure 0\n"), _blank_measure())
    block = F.concat(F.lit("\n"), F.coalesce("__text", blank), F.lit("\n"))
    parts = (
        _named(charts)
        .join(notes, both, "left")
        .join(measured, both, "left")
        .join(with_metadata(songs).select(*keys, "credit"), list(keys))
    )
    sections = parts.withColumn(
        "__section",
        F.concat_ws(
            "\n",
            F.lit(""),
            F.concat(F.lit("//---------------dance-single - "), by, F.lit("----------------")),
            _tag("NOTEDATA", ""),
            _tag("CHARTNAME", by),
            _tag("CHARTHASH", chart_hash(block)),
            _tag("CHARTTYPE", "dance-single"),
            _tag("STEPSTYPE", "dance-single"),
            _tag("BANNER", ""),
            _tag("DESCRIPTION", by),
            _tag("CHARTSTYLE", ""),
            _tag("DIFFICULTY", F.col("__name")),
            _tag("METER", F.col("meter").cast("string")),
            _tag("METERF", "0.000000"),
            _tag("LASTSECONDHINT", _decimal(F.coalesce("last_second", F.lit(0.0)), 6)),
            _tag("RADARVALUES", F.concat(values, F.lit(","), values)),
            _tag("CREDIT", by),
            _tag("NOTES", block),
        ),
    )
    body = _chart_section(sections, keys, chart)
    head = _timing_texts(songs, tempo, stops, keys, 6)
    text = F.concat_ws(
        "\n",
        _tag("VERSION", SSC_VERSION),
        _tag("TITLE", F.col("title")),
        _tag("SUBTITLE", F.col("subtitle")),
        _tag("ARTIST", F.col("artist")),
        _tag("TITLETRANSLIT", F.col("title_translit")),
        _tag("SUBTITLETRANSLIT", F.col("subtitle_translit")),
        _tag("ARTISTTRANSLIT", F.col("artist_translit")),
        _tag("GENRE", F.col("genre")),
        _tag("ORIGIN", ""),
        _tag("TAGS", ""),
        _tag("CREDIT", by),
        _tag("BANNER", F.col("banner")),
        _tag("BACKGROUND", F.col("background")),
        *[_tag(name, "") for name in SSC_EMPTY_BEFORE],
        _tag("CDTITLE", F.col("cdtitle")),
        _tag("MUSIC", F.col("music")),
        _tag("OFFSET", _decimal(F.col("offset"), 6)),
        _tag("SAMPLESTART", _decimal(F.col("sample_start"), 6)),
        _tag("SAMPLELENGTH", _decimal(F.col("sample_length"), 6)),
        _tag("SELECTABLE", "YES"),
        _block("BPMS", F.col("__bpms")),
        _block("STOPS", F.col("__stops")),
        *[_block(name, value) for name, value in SSC_TIMING],
        _tag("BGCHANGES", ""),
        F.lit("#ATTACKS:\n;"),
        F.col("__charts"),
        F.lit(""),
    )
    return head.join(body, list(keys), "left").select(*keys, text.alias("text"))


def step_characters(codes: Column) -> Column:
    """DWI character of a row; three or more panels become a group in angle brackets."""
    names = {}
    for char, panels in k.DWI_PANELS.items():
        names[sum(1 << p for p in panels)] = char
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    from tactus.functions.scalars import panel_mask

    stepped = panel_mask(codes, (k.TAP, k.HOLD, k.ROLL, k.TAIL))
    held = panel_mask(codes, k.HOLD_CODES)
    plain = F.concat(
        F.element_at(table, stepped),
        F.when(held > 0, F.concat(F.lit("!"), F.element_at(table, held))).otherwise(F.lit("")),
    )
    singles = []
    for p in range(k.PANELS):
        char = names[1 << p]
        singles.append(
            F.when(held.bitwiseAND(F.lit(1 << p)) != 0, F.lit(f"{char}!{char}"))
            .when(stepped.bitwiseAND(F.lit(1 << p)) != 0, F.lit(char))
            .otherwise(F.lit(""))
        )
    group = F.concat(F.lit("<"), *singles, F.lit(">"))
    return (
        F.when(stepped == 0, F.lit("0")).when(F.bit_count(stepped) <= 2, plain).otherwise(group)
    )


# Grid strides a DWI measure can be written at, with the brackets around each.
DWI_STRIDES = ((6, "", ""), (3, "(", ")"), (2, "[", "]"))
DWI_TICKS = 4


def step_stream(
    rows: DataFrame, keys: Sequence[str], *, slot: str = "slot", codes: str = "codes"
) -> DataFrame:
    """DWI note stream of each chart, one measure per line.

    A measure takes the coarsest stride all its stepped rows fit; failing that, 192nd notes.
    """
    marked = rows.select(
        *keys,
        F.floor(F.col(slot) / k.SLOTS_PER_MEASURE).cast("int").alias("measure"),
        F.pmod(F.col(slot), F.lit(k.SLOTS_PER_MEASURE)).alias("__pos"),
        step_characters(F.col(codes)).alias("__text"),
    )
    stepped = F.col("__text") != "0"
    stride = None
    for slots, _, _ in DWI_STRIDES:
        fits = F.bool_and(~stepped | (F.col("__pos") % slots == 0))
        stride = F.when(fits, slots) if stride is None else stride.when(fits, slots)
    grouped = marked.groupBy(*keys, "measure").agg(
        stride.otherwise(F.lit(0)).alias("__stride"),
        F.collect_list(F.struct("__pos", "__text")).alias("__rows"),
    )

    def at(position: Column) -> Column:
        hit = F.get(F.filter("__rows", lambda r: r["__pos"] == position), F.lit(0))["__text"]
        return F.coalesce(hit, F.lit("0"))

    step = F.greatest("__stride", F.lit(1))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(k.SLOTS_PER_MEASURE) - 1, step),
        lambda s: F.concat(
            at(s), F.when(F.col("__stride") == 0, F.lit("0" * (DWI_TICKS - 1))).otherwise(F.lit(""))
        ),
    )
    opener, closer = F.lit("`"), F.lit("'")
    for slots, left, right in DWI_STRIDES:
        opener = F.when(F.col("__stride") == slots, F.lit(left)).otherwise(opener)
        closer = F.when(F.col("__stride") == slots, F.lit(right)).otherwise(closer)
    measures = grouped.select(
        *keys, "measure", F.concat(opener, F.array_join(cells, ""), closer).alias("text")
    )
    return _assemble(measures, keys, lambda _, text: text, "\n", F.lit("0" * 8))


def render_dwi(
    songs: DataFrame,
    tempo: DataFrame,
    stops: DataFrame,
    charts: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    *,
    chart: str = "chart",
) -> DataFrame:
    """S11 - one ``.dwi`` text per song.

    Change and freeze beats are written in quarter beats, which is what reading them back expects.
    """
    both = [*keys, chart]
    quarter = 4.0
    rank = F.struct("beat", "bpm")
    first = tempo.groupBy(*keys).agg(F.min_by("bpm", rank).alias("__bpm"), F.min(rank).alias("__first"))
    later = tempo.join(first, list(keys)).where(rank > F.col("__first"))
    changes = segment_text(later, keys, "bpm", 3, beat_scale=quarter)
    freezes = segment_text(stops, keys, "seconds", 3, scale=1000.0, beat_scale=quarter)
    names = F.create_map(*[F.lit(x) for pair in k.DWI_NAME.items() for x in pair])
    sections = charts.join(step_stream(rows, both), both, "left").withColumn(
        "__section",
        F.concat_ws(
            "\n",
            F.concat(
                F.lit("#SINGLE:"),
                F.coalesce(F.element_at(names, F.col("difficulty")), F.lit("EDIT")),
                F.lit(":"),
                F.col("meter").cast("string"),
                F.lit(":"),
            ),
            F.coalesce("notes", F.lit("0" * 8)),
            F.lit(";"),
            F.lit(""),
        ),
    )
    body = _chart_section(sections, keys, chart)
    head = (
        with_metadata(songs)
        .join(first.select(*keys, "__bpm"), list(keys))
        .join(changes.withColumnRenamed("segments", "__changes"), list(keys), "left")
        .join(freezes.withColumnRenamed("segments", "__freezes"), list(keys), "left")
    )
    gap = F.bround(-F.col("offset") * F.lit(1000.0)).cast("bigint").cast("string")
    text = F.concat_ws(
        "\n",
        _tag("TITLE", F.col("title")),
        _tag("ARTIST", F.col("artist")),
        _tag("GENRE", F.col("genre")),
        _tag("CDTITLE", F.col("cdtitle")),
        _tag("BPM", _decimal(F.col("__bpm"), 3)),
        _tag("GAP", gap),
        _tag("SAMPLESTART", _decimal(F.col("sample_start"), 3)),
        _tag("SAMPLELENGTH", _decimal(F.col("sample_length"), 3)),
        _tag("FILE", F.col("music")),
        _tag("FREEZE", F.col("__freezes")),
        _tag("CHANGEBPM", F.col("__changes")),
        F.lit(""),
        F.col("__charts"),
    )
    return head.join(body, list(keys), "left").select(*keys, text.alias("text"))


def apply_tags(songs: DataFrame, tags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S13 - fill empty artist, genre and title from a ``(keys, name, value)`` table of tags."""
    # Tag names a field may come from, best first.
    sources = {
        "artist": ("artist", "albumartist", "performer"),
        "genre": ("genre",),
        "title": ("title",),
    }
    clean = F.nullif(F.trim("value"), F.lit(""))
    names = [n for wanted in sources.values() for n in wanted]
    found = (
        tags.where(F.col("name").isin(*names))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("name") == n, clean)).alias(f"__{n}") for n in names])
    )
    filled = {
        field: F.coalesce(
            F.nullif(F.col(field), F.lit("")), *[F.col(f"__{n}") for n in wanted], F.lit("")
        )
        for field, wanted in sources.items()
        if field in songs.columns
    }
    joined = songs.join(found, list(keys), "left")
    return joined.withColumns(filled).select(*songs.columns)


def write_texts(texts: DataFrame, target: str, *, mode: str = "append") -> None:
    """Write rendered songs as files: rows of ``path`` (pack/song/file) and ``text``, perhaps with an ``encoding``.

    Files come into place when all tasks are done; a failed attempt leaves nothing to see. With ``append`` a file
    that is there already fails the job before anything is moved, with ``overwrite`` it is replaced.
    """
    texts.sparkSession.dataSource.register(SongFolders)
    columns = [c for c in ("path", "text", "encoding") if c in texts.columns]
    texts.select(*columns).write.format(NAME).mode(mode).save(target)


__all__ = [
    "apply_tags",
    "chart_text",
    "measure_block",
    "measure_text",
    "normalize_difficulty",
    "render_dwi",
    "render_sm",
    "render_ssc",
    "segment_text",
    "step_stream",
    "subdivision",
    "with_metadata",
    "write_texts",
]
