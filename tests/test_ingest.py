"""Chart files: scanning, decoding, parsing, rendering back, manifests and increments."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tactus.functions import scalars
from tactus.sources import dwi, files, ledger, manifest, msd, render
from tactus.streaming import live

SM = """#TITLE:Harbour lights;
#ARTIST:Nobody;
#MUSIC:song.ogg;
#OFFSET:-0.250;
#BPMS:0.000=140.000;
#STOPS:;
#SAMPLESTART:7.25;
#NOTES:
     dance-single:
     me:
     challenge:
     11:
     0,0,0,0,0:
0010
0000
1100
0001
,
1000
0000
0100
0000
0010
0000
0001
0011
;
"""
DWI = "#TITLE:Tide;\n#ARTIST:B;\n#FILE:SONG.MP3;\n#GAP:120;\n#BPM:132;\n#CHANGEBPM:96=88;\n#FREEZE:48=250;\n#SINGLE:MANIAC:7:28406;\n"
SSC = """#VERSION:0.83;
#TITLE:Blocks;
#OFFSET:0.5;
#BPMS:0=120,
4=240,x=1,2;
#STOPS:4=0.25;
#DELAYS:8=0.5;
#NOTEDATA:;
#STEPSTYPE:dance-single;
#DIFFICULTY:Easy;
#DIFFICULTY:Hard;
#METER:8;
#NOTES:
1000
0001
M00F
L000
;
#METER:3;
#NOTES2:0100;
"""


def tree(root, songs):
    for path, content in songs.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("data") / "Songs"
    return tree(
        root,
        {
            "PackA/One/one.sm": SM,
            "PackA/One/one.dwi": DWI,
            "PackA/One/song.ogg": "x",
            "PackA/Two/two.dwi": DWI,
            "PackA/Two/song.mp3": "x",
            "PackB/Three/three.SSC": SSC,
            "PackB/Three/a.wav": "x",
            "PackB/Three/b.ogg": "x",
            "PackB/Silent/silent.sm": SM,
            "PackB/NoTempo/x.sm": "#TITLE:x;#BPMS:0=0;",
            "PackB/NoTempo/x.ogg": "x",
            "PackB/BRING THE PAIN/p.sm": SM,
            "PackB/BRING THE PAIN/p.ogg": "x",
            "PackB/Empty/readme.txt": "no chart",
            "PackB/loose.sm": SM,
            "Vertex Minipack/Gone/g.sm": SM,
        },
    )


def test_scan_and_choice(spark, corpus):
    found = files.scan_corpus(spark, corpus)
    chosen = files.choose_simfile(found).select("pack", "song", "file").collect()
    assert {tuple(r) for r in chosen} == {
        ("PackA", "One", "one.sm"),
        ("PackA", "Two", "two.dwi"),
        ("PackB", "Three", "three.SSC"),
        ("PackB", "Silent", "silent.sm"),
        ("PackB", "NoTempo", "x.sm"),
        ("PackB", "BRING THE PAIN", "p.sm"),
    }


def test_deeper_folders_named_like_the_root(spark, tmp_path):
    root = tree(tmp_path / "Songs", {"P/S/a.sm": SM, "P/Songs/Q/T/b.sm": SM, "P/c.sm": SM})
    assert [r["file"] for r in files.scan_corpus(spark, root).collect()] == ["a.sm"]


def test_manifest_and_rejects(spark, corpus, tmp_path):
    found, listing = files.scan_corpus(spark, corpus), files.list_files(spark, corpus)
    songs = {r["title"] + "/" + r["pack"] + "/" + r["audio"].rsplit("/", 1)[1]: r for r in manifest.build_manifest(found, listing).collect()}
    assert set(songs) == {"Harbour lights/PackA/song.ogg", "Tide/PackA/song.mp3", "Blocks/PackB/b.ogg", "Harbour lights/PackB/p.ogg"}
    one = songs["Harbour lights/PackA/song.ogg"]
    assert one["primary_bpm"] == 140 and one["constant_bpm"] and one["offset"] == pytest.approx(-0.25)
    assert one["offset_declared"] and one["sample_start"] == 7.25 and one["file_format"] == "sm"
    assert [tuple(c) for c in one["charts"]] == [("Challenge", 11, 8, "feet")]
    assert songs["Harbour lights/PackB/p.ogg"]["charts"][0]["style"] == "keyboard"
    tide = songs["Tide/PackA/song.mp3"]
    assert tide["offset"] == pytest.approx(-0.12) and tide["stops"] == 1 and not tide["constant_bpm"]
    assert [tuple(b) for b in tide["bpms"]] == [(0.0, 132.0), (24.0, 88.0)]
    assert [tuple(c)[:3] for c in tide["charts"]] == [("Hard", 7, 4)]
    blocks = songs["Blocks/PackB/b.ogg"]
    assert [tuple(b) for b in blocks["bpms"]] == [(0.0, 120.0), (4.0, 240.0)]
    assert [c["difficulty"] for c in blocks["charts"]] == ["Hard"]
    reasons = {(r["song_id"].rsplit("/", 2)[-2 if "." in r["song_id"].rsplit("/", 1)[1] else -1], r["reason"]) for r in manifest.rejects(found, listing).collect()}
    assert ("Silent", "no_audio") in reasons and ("NoTempo", "no_tempo") in reasons
    assert ("Empty", "no_simfile") in reasons
    out = str(tmp_path / "manifest")
    manifest.write_manifest(manifest.build_manifest(found, listing), out)
    assert spark.read.json(out).count() == 4


def test_ssc_blocks(spark):
    df = spark.createDataFrame([(1, SSC, "ssc")], "song int, text string, file_format string")
    tags = df.withColumn("tags", msd.msd_tags(F.col("text")))
    charts = msd.chart_table(tags, ["song"]).orderBy("chart_idx").collect()
    assert [(c["stepstype"], c["difficulty"], c["meter"]) for c in charts] == [("dance-single", "Hard", 8), ("", "", 3)]
    rows = msd.chart_rows(msd.chart_table(tags, ["song"]), ["song", "chart_idx"])
    coded = rows.select("chart_idx", "beat", scalars.panel_codes(F.col("columns")).alias("c")).orderBy("chart_idx", "beat")
    assert [(r["chart_idx"], r["beat"], r["c"]) for r in coded.collect()] == [
        (0, 0.0, [1, 0, 0, 0]),
        (0, 1.0, [0, 0, 0, 1]),
        (0, 2.0, [5, 0, 0, 0]),
        (0, 3.0, [6, 0, 0, 0]),
        (1, 0.0, [0, 1, 0, 0]),
    ]
    stops = msd.stop_segments(tags, ["song"]).orderBy("beat").collect()
    assert [(s["beat"], s["seconds"], s["is_delay"]) for s in stops] == [(4.0, 0.25, False), (8.0, 0.5, True)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("#A:1:2;#B:x;", [("A", ["1", "2"]), ("B", ["x"])]),
        ("#A:1#B:2;", [("A", ["1"]), ("B", ["2"])]),
        ("#A:1", [("A", ["1"])]),
        ("# a :  v ;// #C:no;\n#;#  ;#D;", [("A", ["v"]), ("D", [])]),
        ("#A:\n one\n;junk #B::;", [("A", ["one"]), ("B", ["", ""])]),
    ],
)
def test_tags(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string").select(msd.msd_tags(F.col("text")).alias("t"))
    assert [(t["tag"], t["params"]) for t in df.collect()[0]["t"]] == expected


def test_lenient_numbers(spark):
    texts = ["1.5", " 2 ", "1d", "1_0", "1__0", "", "x", "-3e2", "inf", "+.5", "5."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(scalars.parse_float(F.col("t"))).collect()]
    assert got == [1.5, 2.0, 0.0, 10.0, 0.0, 0.0, 0.0, -300.0, float("inf"), 0.5, 5.0]
    meters = [r[0] for r in df.orderBy("i").select(scalars.meter(F.col("t"))).collect()]
    assert meters[0] == 1 and meters[8] is None


def test_decoding_falls_back(spark):
    texts = ["plain é".encode(), "曲名".encode("cp932"), b"caf\x81"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(texts)], "i int, content binary")
    got = [r[0] for r in df.orderBy("i").select(files.decode_text(F.col("content"))).collect()]
    assert got == ["plain é", "曲名", b"caf\x81".decode("latin-1")]


GRAMMAR = {
    "4266": [(0.0, "1000"), (0.5, "0100"), (1.0, "0001"), (1.5, "0001")],
    "(42)6": [(0.0, "1000"), (0.25, "0100"), (0.5, "0001")],
    "[462]8": [(0.0, "1000"), (1 / 6, "0001"), (1 / 3, "0100"), (0.5, "0010")],
    "7B": [(0.0, "1010"), (0.5, "1001")],
    "<48>6": [(0.0, "1010"), (0.5, "0001")],
    "4)6": [(0.0, "1000"), (0.5, "0001")],
    "4<6": [(0.0, "1000")],
    "4!4604": [(0.0, "2000"), (0.5, "0001"), (1.5, "3000")],
    "4!44!4": [(0.0, "2000"), (0.5, "3000")],
    "4x5?6": [(0.0, "1000"), (0.5, "0001")],
    "<4000>6": [(0.0, "1000"), (4 / 48, "0001")],
    "a": [(0.0, "0110")],
}


def test_dwi_grammar(spark):
    charts = spark.createDataFrame([(i, s) for i, s in enumerate(GRAMMAR)], "chart int, notes string")
    rows = dwi.dwi_rows(charts, ["chart"]).select("chart", "beat", scalars.code_text(F.col("codes")).alias("c"))
    found = {}
    for r in rows.orderBy("chart", "beat").collect():
        found.setdefault(r["chart"], []).append((r["beat"], r["c"]))
    for i, (stream, expected) in enumerate(GRAMMAR.items()):
        assert [c for _, c in found[i]] == [c for _, c in expected], stream
        assert [b for b, _ in found[i]] == pytest.approx([b for b, _ in expected], abs=1e-9), stream


def test_dwi_streams_are_read_without_a_shuffle(spark):
    """Freezes are told in the walk over the stream; a panel stepped twice on one row has its last code."""
    streams = ["4!44!44", "<4!4><4>6!66", "", None, "{4!46!64000}"]
    charts = spark.createDataFrame(list(enumerate(streams)), "chart int, notes string")
    rows = dwi.dwi_rows(charts, ["chart"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in rows.orderBy("chart", "beat").collect():
        found.setdefault(r["chart"], []).append("".join(map(str, r["codes"])))
    assert found[0] == ["2000", "3000", "1000"] and found[1] == ["2000", "3000", "0002", "0003"]
    assert set(found) == {0, 1, 4} and dict(rows.dtypes) == {"chart": "int", "beat": "double", "codes": "array<int>"}


ROWS = [
    (1, 0, 0, [1, 0, 0, 0]), (1, 0, 12, [0, 2, 0, 0]), (1, 0, 30, [0, 3, 0, 1]), (1, 0, 150, [0, 0, 4, 0]),
    (1, 0, 156, [1, 1, 3, 1]), (1, 1, 5, [1, 0, 0, 1]), (1, 1, 100, [0, 1, 0, 0]),
]


def song_tables(spark):
    songs = spark.createDataFrame([(1, "T", -0.048, "m.ogg")], "song int, title string, offset double, music string")
    tempo = spark.createDataFrame([(1, 0.0, 150.0), (1, 8.0, 75.5)], "song int, beat double, bpm double")
    stops = spark.createDataFrame([(1, 4.0, 0.25)], "song int, beat double, seconds double")
    charts = spark.createDataFrame([(1, 0, "Hard", 9), (1, 1, "Weird", 3)], "song int, chart int, difficulty string, meter int")
    rows = spark.createDataFrame(ROWS, "song int, chart int, slot int, codes array<int>")
    return songs, tempo, stops, charts, rows


@pytest.mark.parametrize("kind", ["sm", "ssc", "dwi"])
def test_render_then_parse(spark, kind):
    songs, tempo, stops, charts, rows = song_tables(spark)
    if kind == "sm":
        text = render.render_sm(songs, tempo, stops, charts, rows, ["song"])
    elif kind == "dwi":
        text = render.render_dwi(songs, tempo, stops, charts, rows, ["song"])
    else:
        from tactus.operators.radar import radar

        measured = radar(rows.withColumn("s", F.lit(10.0)), ["song", "chart"], F.col("s")).withColumn("last_second", F.lit(9.5))
        text = render.render_ssc(songs, tempo, stops, charts, rows, measured, ["song"])
    parsed = text.select("song", F.lit(kind).alias("file_format"), msd.msd_tags(F.col("text")).alias("tags"))
    header = msd.song_header(parsed).collect()[0]
    assert header["title"] == "T" and header["offset"] == pytest.approx(-0.048) and header["music"] == "m.ogg"
    read = msd.tempo_segments(parsed, ["song"]).orderBy("listed").collect()
    assert [(r["beat"], r["bpm"]) for r in read] == [(0.0, 150.0), (8.0, 75.5)]
    stopped = msd.stop_segments(parsed, ["song"]).collect()
    assert [(r["beat"], r["seconds"]) for r in stopped] == [(4.0, 0.25)]
    table = msd.chart_table(parsed, ["song"])
    names = {r["chart_idx"]: (r["difficulty"], r["meter"]) for r in table.collect()}
    assert names == {0: ("Hard", 9), 1: ("Edit", 3)}
    if kind == "dwi":
        back = dwi.dwi_rows(table, ["song", "chart_idx"])
    else:
        back = msd.chart_rows(table, ["song", "chart_idx"]).withColumn("codes", scalars.panel_codes(F.col("columns")))
    got = {
        (r["chart_idx"], r["slot"], tuple(r["codes"]))
        for r in back.withColumn("slot", scalars.grid_slot(F.col("beat"))).collect()
    }
    # DWI has no rolls: they come back as freezes.
    want = {(c, s, tuple(2 if kind == "dwi" and x == 4 else x for x in codes)) for _, c, s, codes in ROWS}
    assert got == want


def test_incremental_build(spark, tmp_path):
    target = str(tmp_path / "features")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "simfile string, v int")
    manifest.build_incremental(first, target, "simfile")
    manifest.build_incremental(first.unionByName(spark.createDataFrame([("c", 3)], "simfile string, v int")), target, "simfile")
    found = manifest.read_features(spark, target, ["v"]).collect()
    assert [r["v"] for r in found] == [1, 2, 3]
    assert all(r["key"].startswith(r["prefix"]) and len(r["key"]) == 40 for r in found)


def test_killed_and_racing_runs(spark, tmp_path):
    """What was never committed is not read, and two runs at a time leave one copy of each key."""
    target = str(tmp_path / "features")

    def rows(lo, hi):
        df = spark.createDataFrame([(f"s{i}", i) for i in range(lo, hi)], "simfile string, v int")
        return manifest.with_cache_key(df, "simfile")

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ledger.add(rows(0, 5), target, "key", ["prefix"], killed)
    assert ledger.read(spark, target) is None
    ledger.add(rows(0, 5), target, "key", ["prefix"])
    tries = ledger.add(rows(0, 9), target, "key", ["prefix"], lambda: ledger.add(rows(3, 7), target, "key", ["prefix"]))
    assert tries == 1
    with pytest.raises(KeyboardInterrupt):
        ledger.add(rows(0, 20), target, "key", ["prefix"], killed)
    assert sorted(r["v"] for r in manifest.read_features(spark, target).collect()) == list(range(9))
    assert len(ledger.sweep(spark, target)) == 2
    assert sorted(r["v"] for r in manifest.read_features(spark, target).collect()) == list(range(9))


def test_entries_of_several_rows_are_taken_whole(spark, tmp_path):
    target = str(tmp_path / "features")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "simfile string, v int")
    manifest.build_incremental(first, target, "simfile")
    manifest.build_incremental(spark.createDataFrame([("a", 9), ("c", 4), ("c", 5)], "simfile string, v int"), target, "simfile")
    assert sorted((r["simfile"], r["v"]) for r in manifest.read_features(spark, target).collect()) == [("a", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5)]


def test_scan_reads_texts_once_and_says_what_it_could_not(spark, tmp_path):
    root = tree(
        tmp_path / "Songs",
        {
            "P/Legacy/a.sm": SM.replace("Harbour", "曲名").encode("cp932"), "P/Legacy/a.ogg": "x", "P/Bytes/b.dwi": b"#TITLE:caf\x81;",
            "P/Blank/c.sm": "no tags here", "P/Blank/c.ogg": "x", "P/Fine/d.SSC": SSC, "P/Fine/d.ogg": "x", "P/loose.sm": SM, "Vertex Minipack/G/g.sm": SM,
            "P/Broken/e.ogg": "x", "P/Broken/deep/f.sm": SM,
        },
    )
    # Opening it works, reading it does not.
    os.symlink("/proc/self/mem", f"{root}/P/Broken/e.sm")
    found = files.scan_texts(spark, root)
    got = {r["file"]: r for r in found.collect()}
    assert set(got) == {"a.sm", "b.dwi", "c.sm", "d.SSC", "e.sm"}
    assert got["a.sm"]["encoding"] == "cp932" and "曲名" in got["a.sm"]["text"] and got["b.dwi"]["encoding"] == "latin-1"
    assert got["d.SSC"]["suffix"] == "ssc" and got["d.SSC"]["length"] == len(SSC.encode()) and got["e.sm"]["text"] is None
    assert got["e.sm"]["error"]
    listing = files.list_files(spark, root)
    why = {(r["song_id"].split("/P/")[1], r["reason"]) for r in manifest.rejects(found, listing).collect()}
    assert {("Legacy/a.sm", "not_utf8"), ("Bytes/b.dwi", "not_utf8"), ("Bytes/b.dwi", "no_tempo"), ("Blank/c.sm", "unparsed"), ("Broken/e.sm", "unreadable"), ("Broken", "no_simfile")} <= why
    assert not any("Fine" in path and reason != "bad_meter" for path, reason in why)
    titles = {r["title"] for r in manifest.build_manifest(found, listing).collect()}
    assert titles == {"曲名 lights", "Blocks"}
    assert {tuple(r) for r in found.select("path").where("error is null").collect()} <= {tuple(r) for r in listing.select("path").collect()}


def test_texts_written_as_files(spark, tmp_path):
    songs, tempo, stops, charts, rows = song_tables(spark)
    root = str(tmp_path / "out")
    text = render.render_sm(songs, tempo, stops, charts, rows, ["song"]).select(F.lit("P/T/t.sm").alias("path"), "text")
    render.write_texts(text.withColumn("encoding", F.lit("cp932")), root)
    want = text.first()["text"]
    assert open(f"{root}/P/T/t.sm", "rb").read() == want.encode("cp932")
    assert files.scan_texts(spark, root).first()["text"] == want
    other = spark.createDataFrame([("P/U/u.sm", "b"), ("P/T/t.sm", "c")], "path string, text string").repartition(2)
    with pytest.raises(Exception, match="there already"):
        render.write_texts(other, root)
    assert os.listdir(root) == ["P"] and os.listdir(f"{root}/P") == ["T"]
    render.write_texts(other, root, mode="overwrite")
    assert open(f"{root}/P/T/t.sm").read() == "c" and open(f"{root}/P/U/u.sm").read() == "b"
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 39, "../x").otherwise(F.concat(F.lit("P/V/"), F.col("id"))).alias("path"), F.lit("z").alias("text"))
    with pytest.raises(Exception, match="not a path"):
        render.write_texts(bad, root)
    with pytest.raises(Exception, match="written twice"):
        render.write_texts(bad.withColumn("path", F.lit("P/W/w.sm")), root)
    # A failed write leaves nothing, not even its staging folder.
    assert os.listdir(root) == ["P"] and sorted(os.listdir(f"{root}/P")) == ["T", "U"]


def test_vocabulary_round_trip(spark, tmp_path):
    vocab = spark.createDataFrame([(0, 7, 5), (1, 3, 2)], "token int, pattern int, n int")
    manifest.write_vocab(vocab, str(tmp_path / "v"))
    assert [r["pattern"] for r in manifest.read_vocab(spark, str(tmp_path / "v")).collect()] == [7, 3]


def test_tags_fill_empty_metadata(spark):
    songs = spark.createDataFrame([(1, "", "", "own"), (2, "me", "", "")], "song int, artist string, genre string, title string")
    tags = spark.createDataFrame(
        [(1, "albumartist", " band "), (1, "performer", "p"), (1, "title", "t"), (2, "artist", "x"), (2, "genre", " ")],
        "song int, name string, value string",
    )
    got = {r["song"]: (r["artist"], r["genre"], r["title"]) for r in render.apply_tags(songs, tags, ["song"]).collect()}
    assert got == {1: ("band", "", "own"), 2: ("me", "", "")}


def test_safe_names(spark):
    names = ["a/b: c?", "dots...  ", "", "<>", "x" * 200, "  y "]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(scalars.safe_name(F.col("n"))).collect()]
    assert got == ["ab c", "dots", "Untitled", "Untitled", "x" * 120, "y"]


def test_stream_ingest_equals_batch(spark, corpus, tmp_path):
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    for _ in range(2):
        live.stream_ingest(spark, corpus, target, checkpoint).awaitTermination()
    parsed = manifest.parse_corpus(files.scan_corpus(spark, corpus, excluded=()))
    stored = live.ingested(spark, target)
    for name in ("rows", "tempo", "stops", "charts"):
        assert stored[name].count() == getattr(parsed, name).count(), name
    assert json.dumps(sorted(r["title"] for r in stored["songs"].collect())) == json.dumps(sorted(r["title"] for r in parsed.songs.collect()))


def test_better_format_replaces_a_song(spark, tmp_path):
    root, target, checkpoint = str(tmp_path / "Songs"), str(tmp_path / "t"), str(tmp_path / "c")
    for name, text in (("b.sm", SM), ("a.ssc", SSC), ("c.dwi", DWI)):
        tree(tmp_path / "Songs", {f"P/S/{name}": text, **({"P/R/r.dwi": DWI} if name == "b.sm" else {})})
        live.stream_ingest(spark, root, target, checkpoint).awaitTermination()
        found = live.ingested(spark, target)
        titles = sorted(r["title"] for r in found["songs"].collect())
        assert titles == (["Harbour lights", "Tide"] if name == "b.sm" else ["Blocks", "Tide"])
    assert {r["song_id"].rsplit("/", 1)[1] for r in found["rows"].select("song_id").distinct().collect()} == {"a.ssc", "r.dwi"}
    assert sorted((r["beat"], r["seconds"]) for r in found["stops"].collect()) == [(4.0, 0.25), (8.0, 0.5), (12.0, 0.25)]


def test_songs_of_one_directory_find_their_own_audio(spark):
    songs = spark.createDataFrame(
        [(1, "d", "b.ogg"), (2, "d", "A.MP3"), (3, "d", ""), (4, "d", "gone.ogg"), (5, "empty", "b.ogg"), (6, "d", None), (7, "none", "x")],
        "song int, directory string, music string",
    )
    listing = spark.createDataFrame(
        [("d", "d/" + f, f, f[-3:].lower()) for f in ("a.mp3", "b.ogg", "c.wav", "e.txt")] + [("none", "none/e.txt", "e.txt", "txt")],
        "directory string, path string, file string, suffix string",
    )
    found = files.resolve_audio(songs, listing)
    assert found.columns == ["song", "directory", "music", "audio"]
    by_suffix = "d/b.ogg"
    assert {r["song"]: r["audio"] for r in found.collect()} == {
        1: "d/b.ogg", 2: "d/a.mp3", 3: by_suffix, 4: by_suffix, 5: None, 6: by_suffix, 7: None,
    }


def test_audio_is_found_without_pairing_songs_and_files(spark):
    songs = spark.range(3000).selectExpr("id as song", "'d' as directory", "concat('f', id, '.ogg') as music")
    listing = spark.range(3000).selectExpr("'d' as directory", "concat('d/f', id, '.ogg') as path", "concat('f', id, '.ogg') as file", "'ogg' as suffix")
    found = files.resolve_audio(songs, listing)
    assert found.where("audio = concat('d/', music)").count() == found.count() == 3000


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bodies_are_split_once_and_lines_are_found_once(spark):
    texts = spark.createDataFrame([(1, "#title: a : b;#Straße:x;#Notes:0001,\n0000\n1000;")], "song int, text string")
    tags = texts.select("song", msd.msd_tags(F.col("text")).alias("t"))
    assert optimized(tags).count("split(") == 1
    assert [(t["tag"], t["params"]) for t in tags.head()["t"]] == [("TITLE", ["a", "b"]), ("STRASSE", ["x"]), ("NOTES", ["0001,\n0000\n1000"])]
    rows = msd.chart_rows(texts.select("song", F.lit("0001,\n0000\n1000").alias("notes")), ["song"])
    assert sorted(map(tuple, rows.collect())) == [(1, 0.0, "0001"), (1, 6.0, "1000")]
    lined = texts.select("song", F.expr("substring(text, 1, 4)").alias("notes"))
    assert "Filter" not in optimized(msd.chart_rows(lined, ["song"]))


def test_ssc_texts_are_written_and_parsed_once(spark):
    from tactus.plans.source_queries import ssc_charts

    assert optimized(ssc_charts(spark, "/root/testdata/sf0.001")).count("regexp_extract_all") == 1


def test_white_space_of_every_kind_is_stripped(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    table = spark.createDataFrame([(i, s + "a" + s + "b" + s + s) for i, s in enumerate(spaces)], "i int, v string")
    got = {r[0]: r[1] for r in table.select("i", scalars.text_strip(F.col("v"))).collect()}
    assert got == {i: "a" + s + "b" for i, s in enumerate(spaces)}
    names = spark.createDataFrame([(s,) for s in ("Hard", "ÉTÉ", "straße", "A-1", "", "aB")], "v string")
    both = names.select("v", scalars.upper_case(F.col("v")), scalars.lower_case(F.col("v"))).collect()
    assert all(r[1] == r[0].upper() and r[2] == r[0].lower() for r in both)


def test_names_are_listed_in_tasks_as_by_spark(spark, tmp_path):
    names = ("A/One/one.sm", "A/One/song.ogg", "A/One/.hidden.ogg", "A/One/_x.ogg", "A/One/deep/x.ogg", "A/loose.sm", "A/_Old/a.ogg", "B/Zwei ä#/曲 %41.Ogg", "B/Zwei ä#/none", "Gone/G/g.ogg")
    root = tree(tmp_path / "Songs", dict.fromkeys(names, "x") | {"A/One/empty.ogg": ""})
    columns = ["path", "directory", "pack", "song", "file", "suffix"]
    listed = files.list_files(spark, root, excluded=("Gone",))
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    expected = files._at_depth(files._located(by_spark), root).where("pack <> 'Gone'")
    assert sorted(map(tuple, listed.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))
    # The driver plans tasks, not files: it knows no path below the packs.
    assert "InMemoryFileIndex" not in listed._jdf.queryExecution().toString()
    assert listed.inputFiles() == []


def test_audio_reads_the_listing_once(spark):
    listing = spark.range(3).selectExpr("'d' as directory", "concat('d/f', id) as path", "concat('f', id) as file", "'ogg' as suffix")
    songs = spark.createDataFrame([("d", "f1")], "directory string, music string")
    assert optimized(files.resolve_audio(songs, listing)).count("Range (0, 3") == 1
