"""Reading chart text: tags, headers, tempo tables, charts and note rows.

A file is one row, so everything up to the note rows is array work inside that row; nothing here
shuffles. ``tags`` below is an array column of ``struct<tag, params>`` in file order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import (
    lenient_double,
    meter,
    normalize_difficulty,
    parse_float,
    text_strip,
    upper_case,
)

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
NOTE_TAGS = ("NOTES", "NOTES2")


def msd_tags(text: Column) -> Column:
    """P01 - tags of a text. A tag ends at ``;``, at the next ``#`` or with the text."""
    plain = F.regexp_replace(text, r"//[^\r\n]*", "")
    bodies = F.regexp_extract_all(plain, F.lit(r"#([^#;]*)"), F.lit(1))
    filled = F.filter(bodies, lambda b: text_strip(b) != "")

    def tag(parts: Column) -> Column:
        return F.struct(
            upper_case(F.get(parts, F.lit(0))).alias("tag"),
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("params"),
        )

    # Split in a step of its own, so that a body is split and stripped once for all uses of its parts.
    split = F.transform(filled, lambda body: F.transform(F.split(body, ":", -1), text_strip))
    return F.transform(split, tag)


def explode_tags(df: DataFrame, keys: Sequence[str], tags: str = "tags") -> DataFrame:
    """One row per tag: keys, position, name and parameters."""
    return df.select(*keys, F.posexplode(tags).alias("pos", "t")).select(
        *keys, "pos", "t.tag", "t.params"
    )


def tag_value(tags: Column, name: str) -> Column:
    """P02 - first parameter of the first such tag that has one, or an empty string."""
    hits = F.filter(tags, lambda t: (t["tag"] == name) & (F.size(t["params"]) > 0))
    return F.coalesce(F.get(F.get(hits, F.lit(0))["params"], F.lit(0)), F.lit(""))


def has_tag(tags: Column, name: str) -> Column:
    """Whether a tag occurs at all."""
    return F.exists(tags, lambda t: t["tag"] == name)


def beat_values(text: Column) -> Column:
    """P03 - sorted ``beat=value`` pairs; malformed entries are dropped."""
    chunks = F.split(F.regexp_replace(text, r"[\r\n]", ""), ",", -1)

    def pair(chunk: Column) -> Column:
        parts = F.split(chunk, "=", 2)
        return F.struct(
            lenient_double(F.get(parts, F.lit(0))).alias("beat"),
            lenient_double(F.get(parts, F.lit(1))).alias("value"),
        )

    pairs = F.transform(chunks, pair)
    return F.array_sort(
        F.filter(pairs, lambda p: p["beat"].isNotNull() & p["value"].isNotNull())
    )


def song_header(df: DataFrame, file_format: str = "file_format", tags: str = "tags") -> DataFrame:
    """P08 - add the header columns of each file. DWI names music and offset differently."""
    t = F.col(tags)
    dwi = F.col(file_format) == "dwi"
    display = F.get(F.filter(t, lambda x: x["tag"] == "DISPLAYBPM"), F.lit(0))["params"]

    def unless_dwi(column: Column, empty: Column) -> Column:
        return F.when(dwi, empty).otherwise(column)

    return df.withColumns(
        {
            "title": tag_value(t, "TITLE"),
            "subtitle": unless_dwi(tag_value(t, "SUBTITLE"), F.lit("")),
            "artist": tag_value(t, "ARTIST"),
            "music": F.when(dwi, tag_value(t, "FILE")).otherwise(tag_value(t, "MUSIC")),
            "display_bpm": unless_dwi(F.coalesce(F.array_join(display, ":"), F.lit("")), F.lit("")),
            "offset": F.when(dwi, -parse_float(tag_value(t, "GAP")) / F.lit(1000.0)).otherwise(
                parse_float(tag_value(t, "OFFSET"))
            ),
            "offset_declared": F.when(dwi, has_tag(t, "GAP")).otherwise(has_tag(t, "OFFSET")),
            "sample_start": unless_dwi(parse_float(tag_value(t, "SAMPLESTART")), F.lit(0.0)),
            "sample_length": unless_dwi(parse_float(tag_value(t, "SAMPLELENGTH")), F.lit(0.0)),
        }
    )


def _scaled(pairs: Column, by_beat: float, by_value: float) -> Column:
    return F.transform(
        pairs,
        lambda p: F.struct(
            (p["beat"] / F.lit(by_beat)).alias("beat"), (p["value"] / F.lit(by_value)).alias("value")
        ),
    )


def tempo_pairs(tags: Column, file_format: Column) -> Column:
    """P09 - tempo list of a file, in listed order; empty when it declares no usable tempo."""
    listed = F.filter(beat_values(tag_value(tags, "BPMS")), lambda p: p["value"] > 0)
    start = parse_float(tag_value(tags, "BPM"))
    changes = F.filter(
        _scaled(beat_values(tag_value(tags, "CHANGEBPM")), 4.0, 1.0), lambda p: p["value"] > 0
    )
    first = F.struct(F.lit(0.0).alias("beat"), start.alias("value"))
    return F.when(file_format != "dwi", listed).otherwise(
        F.when(start > 0, F.concat(F.array(first), changes)).otherwise(F.slice(changes, 1, 0))
    )


def stop_pairs(tags: Column, file_format: Column) -> Column:
    """P09 - stops and delays of a file."""

    def marked(pairs: Column, delay: bool) -> Column:
        return F.transform(
            pairs,
            lambda p: F.struct(
                p["beat"].alias("beat"), p["value"].alias("seconds"), F.lit(delay).alias("is_delay")
            ),
        )

    listed = F.concat(
        marked(beat_values(tag_value(tags, "STOPS")), False),
        marked(beat_values(tag_value(tags, "FREEZES")), False),
        marked(beat_values(tag_value(tags, "DELAYS")), True),
    )
    frozen = marked(_scaled(beat_values(tag_value(tags, "FREEZE")), 4.0, 1000.0), False)
    return F.when(file_format != "dwi", listed).otherwise(frozen)


def tempo_segments(
    df: DataFrame, keys: Sequence[str], *, tags: str = "tags", file_format: str = "file_format"
) -> DataFrame:
    """P09 - one row per tempo, with its place in the list."""
    pairs = tempo_pairs(F.col(tags), F.col(file_format))
    return df.select(*keys, F.posexplode(pairs).alias("listed", "p")).select(
        *keys, "listed", F.col("p.beat").alias("beat"), F.col("p.value").alias("bpm")
    )


def stop_segments(
    df: DataFrame, keys: Sequence[str], *, tags: str = "tags", file_format: str = "file_format"
) -> DataFrame:
    """P09 - one row per stop."""
    pairs = stop_pairs(F.col(tags), F.col(file_format))
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def _chart(stepstype, description, difficulty, rating, notes) -> Column:
    return F.struct(
        stepstype.alias("stepstype"),
        description.alias("description"),
        difficulty.alias("difficulty"),
        meter(rating).alias("meter"),
        notes.alias("notes"),
    )


def sm_charts(tags: Column) -> Column:
    """P05 - charts of an ``.sm`` file: note tags carry their fields as parameters."""
    found = F.filter(tags, lambda t: (t["tag"] == "NOTES") & (F.size(t["params"]) >= 6))

    def chart(t: Column) -> Column:
        p = [F.get(t["params"], F.lit(i)) for i in range(6)]
        return _chart(p[0], p[1], normalize_difficulty(p[2]), p[3], p[5])

    return F.transform(found, chart)


def ssc_charts(tags: Column) -> Column:
    """P06 - charts of an ``.ssc`` file: each note tag closes the block opened before it.

    A block starts after the latest ``NOTEDATA`` or note tag; within it the last value of a field
    wins.
    """
    places = F.when(F.size(tags) > 0, F.sequence(F.lit(1), F.size(tags)))
    edges = F.coalesce(
        F.filter(places, lambda i: F.element_at(tags, i)["tag"].isin("NOTEDATA", *NOTE_TAGS)),
        F.expr("array()").cast("array<int>"),
    )
    blocks = F.filter(
        F.zip_with(
            edges,
            F.slice(F.concat(F.array(F.lit(0)), edges), 1, F.size(edges)),
            lambda i, before: F.struct(i.alias("at"), before.alias("before")),
        ),
        lambda b: F.element_at(tags, b["at"])["tag"].isin(*NOTE_TAGS),
    )

    def chart(b: Column) -> Column:
        block = F.slice(tags, b["before"] + 1, b["at"] - b["before"] - 1)

        def field(name: str, empty: str = "") -> Column:
            last = F.try_element_at(F.filter(block, lambda t: t["tag"] == name), F.lit(-1))
            given = F.coalesce(F.get(last["params"], F.lit(0)), F.lit(""))
            return F.when(last.isNull(), F.lit(empty)).otherwise(given)

        return _chart(
            field("STEPSTYPE"),
            field("DESCRIPTION"),
            normalize_difficulty(field("DIFFICULTY")),
            field("METER", "0"),
            F.coalesce(F.get(F.element_at(tags, b["at"])["params"], F.lit(0)), F.lit("")),
        )

    return F.transform(blocks, chart)


def dwi_charts(tags: Column) -> Column:
    """Four-panel charts of a ``.dwi`` file; their notes stay a DWI stream (see P07)."""
    found = F.filter(tags, lambda t: (t["tag"] == "SINGLE") & (F.size(t["params"]) >= 3))
    names = F.create_map(*[F.lit(x) for pair in k.DWI_DIFFICULTY.items() for x in pair])

    def chart(t: Column) -> Column:
        p = [F.get(t["params"], F.lit(i)) for i in range(3)]
        name = F.coalesce(F.try_element_at(names, F.upper(p[0])), F.lit("Edit"))
        return _chart(F.lit("dance-single"), F.lit(""), name, p[1], p[2])

    return F.transform(found, chart)


def chart_table(
    df: DataFrame, keys: Sequence[str], *, tags: str = "tags", file_format: str = "file_format"
) -> DataFrame:
    """P05-P07 - one row per chart of any format: keys, ``chart_idx`` and the chart fields."""
    t, f = F.col(tags), F.col(file_format)
    charts = (
        F.when(f == "ssc", ssc_charts(t)).when(f == "dwi", dwi_charts(t)).otherwise(sm_charts(t))
    )
    return df.select(*keys, f.alias("file_format"), F.posexplode(charts).alias("chart_idx", "c")).select(
        *keys, "file_format", "chart_idx", "c.*"
    )


def note_rows(notes: Column) -> Column:
    """P10 - note rows of a measure text, in order: an array of ``(beat, columns)``.

    A measure of n lines spreads them evenly over four beats. Empty measures still take their time;
    rows without any note are left out.
    """

    def lines(measure: Column) -> Column:
        return F.filter(
            F.transform(F.split(measure, LINE_BREAK, -1), text_strip),
            lambda x: (x != "") & ~x.startswith("//"),
        )

    def placed(found: Column, measure: Column) -> Column:
        return F.filter(
            F.transform(
                found,
                lambda x, i: F.struct(
                    (measure * F.lit(4.0) + i * (F.lit(4.0) / F.size(found))).alias("beat"), x.alias("columns")
                ),
            ),
            lambda r: F.ltrim(r["columns"], F.lit("0")) != "",
        )

    return F.flatten(F.transform(F.transform(F.split(notes, ",", -1), lines), placed))


def chart_rows(charts: DataFrame, keys: Sequence[str], notes: str = "notes") -> DataFrame:
    """P10 - note rows of measure text: ``beat`` and the panel characters (see :func:`note_rows`)."""
    return charts.select(*keys, F.explode(note_rows(F.col(notes))).alias("__r")).select(*keys, "__r.beat", "__r.columns")
