"""Continuous forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.operators.ordered import attach, scan
from tactus.operators.play import foot_steps, occupied
from tactus.sources.files import SIMFILES, _at_depth, _located
from tactus.sources.manifest import CHART, parse_corpus

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


TABLES = ("songs", "charts", "rows", "tempo", "stops")


def stream_ingest(spark: SparkSession, root: str, target: str, checkpoint: str):
    """R01 - append the songs, charts, note rows, tempo and stops of chart files as they arrive.

    Every micro-batch overwrites its own ``batch`` directories, so a batch that is run again after a
    failure leaves one copy. Its files are read and parsed once. Returns the started query, which stops when no
    new file is left. :func:`ingested` reads what counts.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", SIMFILES)
        .load(root)
        .select("path", "content")
    )

    def store(batch: DataFrame, number: int) -> None:
        corpus = parse_corpus(_at_depth(_located(batch), root), once=True)
        tables = (
            corpus.songs.drop("tags", "music"),
            corpus.charts.select(*CHART, "difficulty", "meter", "stepstype"),
            corpus.rows,
            corpus.tempo,
            corpus.stops,
        )
        for name, table in zip(TABLES, tables, strict=True):
            table.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingested(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of :func:`stream_ingest` with one file for each song folder, chosen as :func:`choose_simfile` does.

    A file of a better format replaces those that came before it, a worse one that comes later is not taken up, and of two
    versions of a file the later counts.
    """
    songs = spark.read.parquet(f"{target}/songs")
    rank = F.array_position(F.array(*[F.lit(s) for s in k.SIMFILE_SUFFIXES]), F.col("file_format"))
    first = F.struct(rank, F.element_at(F.split("song_id", "/"), -1), -F.col("batch"))
    chosen = songs.groupBy("directory").agg(F.min_by(F.struct("song_id", "batch"), first).alias("c")).select("c.*")
    return {name: spark.read.parquet(f"{target}/{name}").join(chosen, ["song_id", "batch"], "left_semi").drop("batch") for name in TABLES}


Step = Callable[[DataFrame, DataFrame | None, float, bool], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Carried:
    """A stream worked off in event-time order by a batch operator and a table of carried state.

    ``step(rows, carry, mark, ended)`` takes the rows that are due, what the step before carried on (None at
    first) and the watermark in epoch seconds, and returns its output and what it carries on in turn.

    A row is due once the watermark, ``delay`` behind the latest ``ts`` seen, has reached it; until then it is
    pending. So rows that come out of order, however they are dealt into micro-batches, give what the batch
    operator gives for all of them in order. Rows that the watermark had passed before they came, and rows
    without a time, cannot be placed any more; they are kept apart as late ones.

    Every micro-batch reads the state of the one before and writes a directory of its own in each table, its
    clock last. A batch that is run again after a failure overwrites what it had written.
    """

    step: Step
    ts: str
    delay: str

    def start(self, stream: DataFrame, folder: str):
        """Start the query, which stops when its input is used up. Tables and checkpoint lie below ``folder``."""
        spark = stream.sparkSession
        nothing = spark.createDataFrame([], stream.schema)
        nothing.write.mode("ignore").parquet(f"{folder}/pending/batch=-1")
        nothing.write.mode("ignore").parquet(f"{folder}/late/batch=-1")
        _clock(spark, float("-inf")).write.mode("ignore").parquet(f"{folder}/clock/batch=-1")

        def store(batch: DataFrame, number: int) -> None:
            self._advance(batch, folder, number)

        return (
            stream.writeStream.foreachBatch(store)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    def finish(self, spark: SparkSession, folder: str) -> DataFrame:
        """All results once no more rows will come: what is pending is worked off, what is open is closed.

        A stream that goes on after all starts from the state before this and overwrites it.
        """
        done = spark.read.parquet(f"{folder}/clock").agg(F.max("batch")).first()[0]
        pending = spark.read.parquet(f"{folder}/pending/batch={done}")
        carry = spark.read.parquet(f"{folder}/carry/batch={done}") if done >= 0 else None
        out, _ = self.step(pending, carry, float("inf"), True)
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={done + 1}")
        return self.results(spark, folder)

    def results(self, spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/out").drop("batch")

    def late(self, spark: SparkSession, folder: str) -> DataFrame:
        """Rows that came when the watermark had passed them, or without a time."""
        return spark.read.parquet(f"{folder}/late").drop("batch")

    def _advance(self, batch: DataFrame, folder: str, number: int) -> None:
        spark = batch.sparkSession
        kept = lambda name, at: f"{folder}/{name}/batch={at}"
        batch.write.mode("overwrite").parquet(kept("arrived", number))
        arrived = spark.read.schema(batch.schema).parquet(kept("arrived", number))
        at = F.unix_micros(self.ts) / F.lit(1e6)
        delay = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {self.delay}")) / F.lit(1e6)
        passed = spark.read.parquet(kept("clock", number - 1)).first()["mark"]
        pending = spark.read.schema(batch.schema).parquet(kept("pending", number - 1))
        carry = spark.read.parquet(kept("carry", number - 1)) if number > 0 else None
        newest = arrived.agg(F.max(at - delay).alias("mark")).first()["mark"]
        mark = passed if newest is None else max(passed, newest)
        late = F.col(self.ts).isNull() | (at <= F.lit(passed))
        arrived.where(late).write.mode("overwrite").parquet(kept("late", number))
        waiting = arrived.where(~late).unionByName(pending)
        due = at <= F.lit(mark)
        waiting.where(~due).write.mode("overwrite").parquet(kept("pending", number))
        out, carry = self.step(waiting.where(due), carry, mark, False)
        carry.write.mode("overwrite").parquet(kept("carry", number))
        out.write.mode("overwrite").parquet(kept("out", number))
        _clock(spark, mark).write.mode("overwrite").parquet(kept("clock", number))
        # The batch before may still be run again, those before it not.
        _removed(spark, [kept(name, number - 2) for name in ("arrived", "pending", "carry")])


def _clock(spark: SparkSession, mark: float) -> DataFrame:
    return spark.range(1).select(F.lit(mark).cast("double").alias("mark"))


def _removed(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _cut(time: Column, segment: float | None) -> Column | None:
    return None if segment is None else F.floor(time / F.lit(float(segment)))


def live_runs(
    keys: Sequence[str], gap: float, delay: str, *, ts: str = "ts", tiebreak: str = "event_id", segment: float | None = None
) -> Carried:
    """R02 - runs of steps: start, end and number of steps.

    A run is closed by a step ``gap`` seconds or more after its last one, and comes out once the watermark shows
    that none nearer will follow. Only open runs are carried on.
    """
    time = F.unix_micros("__at") / F.lit(1e6)

    def step(rows: DataFrame, carry: DataFrame | None, mark: float, ended: bool) -> tuple[DataFrame, DataFrame]:
        steps = rows.select(*keys, F.col(ts).alias("__at"), tiebreak, F.col(ts).alias("run_start"), F.lit(1).cast("bigint").alias("steps"))
        if carry is not None:
            steps = steps.unionByName(carry.withColumnRenamed("run_end", "__at"))
        order = ["__at", tiebreak]
        seen = scan(steps, keys, order, _cut(time, segment), lag={"__before": F.col("__at")})
        away = (F.unix_micros("__at") - F.unix_micros("__before")) / F.lit(1e6) >= F.lit(gap)
        opens = F.when(F.col("__before").isNull() | away, F.struct(*order))
        named = scan(seen, keys, order, _cut(time, segment), last={"__run": opens})
        found = named.groupBy(*keys, "__run").agg(
            F.min("run_start").alias("run_start"),
            F.max("__at").alias("run_end"),
            F.max_by(tiebreak, F.struct(*order)).alias(tiebreak),
            F.sum("steps").alias("steps"),
        )
        closed = F.lit(ended) | (F.unix_micros("run_end") / F.lit(1e6) + F.lit(gap) <= F.lit(mark))
        out = found.where(closed).select(*keys, "run_start", "run_end", "steps")
        return out, found.where(~closed).select(*keys, "run_end", tiebreak, "run_start", "steps")

    return Carried(step, ts, delay)


def live_peak_rate(
    rows: DataFrame, keys: Sequence[str], window: str, slide: str, watermark: str, *, ts: str = "ts"
) -> DataFrame:
    """R03 - rows per second in sliding windows; late rows are dropped by the watermark."""
    counted = (
        rows.withWatermark(ts, watermark)
        .groupBy(*keys, F.window(ts, window, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    seconds = F.unix_micros("w.end") - F.unix_micros("w.start")
    return counted.select(
        *keys,
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
        "rows",
        (F.col("rows") / (seconds / F.lit(1e6))).alias("rate"),
    )


def live_occupancy(
    keys: Sequence[str],
    delay: str,
    *,
    ts: str = "ts",
    time: str = "t",
    codes: str = "codes",
    tiebreak: str = "event_id",
    gap: float = k.STREAM_GAP,
    ttl: float = 3600.0,
    segment: float | None = None,
) -> Carried:
    """R04 - held panels and foot of each row, as :func:`occupied` and :func:`foot_steps` give them for all rows.

    A key that has been silent for more than ``ttl`` seconds starts anew, with nothing held. What is carried on is one record per
    key: its last row, the panels held after it, its last step and the foot of that; it goes once the
    watermark is ``ttl`` past. ``time`` is ``ts`` in epoch seconds; ``segment`` cuts keys that are dense in a
    micro-batch. ``foot`` is null on rows without a step.
    """
    order = [time, tiebreak]
    left, right = 1 << k.LEFT_PANEL, 1 << k.RIGHT_PANEL
    life = [*keys, "__life"]
    cut = _cut(F.col(time), segment)

    def step(rows: DataFrame, carry: DataFrame | None, mark: float, ended: bool) -> tuple[DataFrame, DataFrame]:
        kinds = dict(rows.dtypes)
        rows = rows.select(*keys, *order, ts, codes, F.lit(False).alias("__carried"))
        if carry is not None:
            # What is held comes in as heads on one row before all others.
            heads = F.when(
                F.size("panels") > 0,
                F.transform(F.sequence(F.lit(0), F.array_max("panels")), lambda p: F.when(F.array_contains("panels", p), k.HOLD).otherwise(0)),
            ).otherwise(F.array().cast("array<int>"))
            opening = carry.select(*keys, *order, ts, heads.cast(kinds[codes]).alias(codes), F.lit(True).alias("__carried"))
            rows = rows.unionByName(opening)
        rows = scan(rows, keys, order, cut, lag={"__before": F.col(time)})
        silent = F.coalesce(F.col(time) - F.col("__before") > F.lit(ttl), F.lit(False)).cast("int")
        rows = scan(rows, keys, order, cut, running={"__life": silent}).drop("__before")
        held = occupied(rows, life, order, codes=codes, segment=cut)
        steps = held.where(~F.col("__carried")).select(*life, *order, "stepped")
        if carry is not None:
            # The last step opens a run of its own on the panel that its foot stands on.
            stood = F.when(F.col("foot") == 1, right).otherwise(left)
            last = carry.where(F.col("step_at").isNotNull())
            # It may lie a while before the key's last row, but belongs to the same life.
            last = last.select(*keys, F.lit(0).cast("bigint").alias("__life"), *[F.col(f"step_at.{c}").alias(c) for c in order], stood.cast("int").alias("stepped"))
            steps = steps.withColumn("__life", F.col("__life").cast("bigint")).unionByName(last)
        walked = foot_steps(steps, life, order, gap=gap, segment=segment)
        feet = walked.select(*life, *order, "in_run", "foot", "crossed")
        out = attach(held.where(~F.col("__carried")).select(*life, *order, "stepped", "held", "occupied"), feet, [*life, *order])
        no = F.lit(False)
        out = out.select(
            *keys, tiebreak, time, "stepped", "held", "occupied", F.coalesce("in_run", no).alias("in_run"), "foot", F.coalesce("crossed", no).alias("crossed")
        )
        at = F.struct(*order)
        ends = rows.groupBy(*life).agg(F.max(at).alias("__end"), F.max(ts).alias(ts))
        ends = ends.groupBy(*keys).agg(F.max(F.struct("__life", "__end", ts)).alias("e"))
        ends = ends.select(*keys, "e.__life", *[F.col(f"e.__end.{c}").alias(c) for c in order], f"e.{ts}")
        notes = rows.select(*life, *order, F.posexplode(codes).alias("__panel", "__code")).where(F.col("__code").isin(*k.HOLD_CODES, k.TAIL))
        pinned = notes.groupBy(*life, "__panel").agg(F.max_by("__code", at).alias("__code")).where(F.col("__code") != k.TAIL)
        # At most as many as there are panels.
        pinned = pinned.groupBy(*life).agg(F.array_sort(F.collect_set("__panel")).alias("panels"))
        stood = walked.groupBy(*life).agg(F.max(at).alias("step_at"), F.max_by("foot", at).alias("foot"))
        carried = attach(attach(ends, pinned, life), stood, life)
        carried = carried.where(F.unix_micros(ts) / F.lit(1e6) + F.lit(ttl) >= F.lit(mark))
        nothing = F.array().cast("array<int>")
        return out, carried.select(*keys, *order, ts, F.coalesce("panels", nothing).alias("panels"), "step_at", "foot")

    return Carried(step, ts, delay)


def drain(stream: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregating stream until its input is used up and read back the last version of each group.

    Every micro-batch adds the groups that it changed, told apart by ``keys``; state goes with the watermark.
    """
    spark = stream.sparkSession
    out = f"{folder}/out"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(store)
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = spark.read.parquet(out)
    values = [c for c in stream.columns if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*[F.col(f"v.{c}").alias(c) if c in values else F.col(c) for c in stream.columns])
