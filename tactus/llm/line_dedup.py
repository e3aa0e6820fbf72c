"""Near-duplicate lines by MinHash: signatures, banding, exact verification, union of what matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm import spans
from tactus.llm.components import components
from tactus.llm.shared import settle, small_batches

#: Characters of a shingle, bands, rows of a band. At a similarity of 0.8 a pair shares a band with
#: probability 1 - (1 - 0.8**ROWS)**BANDS = 0.998.
SHINGLE, BANDS, ROWS = 8, 12, 4
BINS = BANDS * ROWS
LOW = np.uint64((1 << 40) - 1)
#: Lines, and characters, of about one tile of the lines that share a band.
TILE_LINES, TILE_CHARS = 512, 1 << 20
#: Shingles that are compared at a time, as columns of a matrix.
COLUMNS = 4096
#: Bytes of text whose lines are signed or compared at a time. A character takes some 100 bytes of arrays meanwhile.
SIGN_BYTES = 1 << 17


def _trimmed(block: spans.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number in it, start and end of the lines that hold more than white space, without that at their ends."""
    data = block.data
    lo, hi, doc = block.lines()
    # Number of the line inside its text: line ends before it.
    ends = np.flatnonzero(data == 0x0A)
    number = np.searchsorted(ends, lo) - np.searchsorted(ends, block.edges[doc])
    ink = np.flatnonzero(~spans.SPACE[data])
    first, last = np.searchsorted(ink, lo), np.searchsorted(ink, hi)
    some = last > first
    return doc[some], number[some].astype(np.int32), ink[first[some]], ink[last[some] - 1] + 1


class Lines:
    """The lines of a block that hold more than white space, trimmed, as spans of code points."""

    def __init__(self, block: spans.Block):
        data = block.data
        self.doc, self.number, lo, self.hi = _trimmed(block)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        self.points = self._points(data)
        self.begin, self.end = np.searchsorted(starts, lo), np.searchsorted(starts, self.hi)
        size = len(self.points)
        self.inverse = spans.powers(size + 1, int(spans.INVERSE))
        self.sums = np.zeros(size + 1, np.uint64)
        np.multiply(self.points, spans.powers(size, int(spans.BASE)), out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)
        length = (self.end - self.begin).astype(np.uint64)
        self.nodes = spans.mixed((self.sums[self.end] - self.sums[self.begin]) * self.inverse[self.begin] + length * spans.BASE).view(np.int64)

    @staticmethod
    def _points(data: np.ndarray) -> np.ndarray:
        """Code points, A-Z lower-cased."""
        data = data + ((data >= 0x41) & (data <= 0x5A)).view(np.uint8) * np.uint8(32)
        return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)

    def _hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Line and 40 bits of the hash of every shingle, repeats included; a short line is one shingle."""
        size = self.end - self.begin
        count = np.maximum(size - SHINGLE + 1, 1)
        of = np.repeat(np.arange(len(size), dtype=np.int32), count)
        # A shingle begins at each place but a line's last ones; one step between lines is longer.
        step = np.ones(len(of), np.int64)
        heads = np.cumsum(count) - count
        if len(size):
            step[heads[1:]] = self.begin[1:] - (self.begin + count - 1)[:-1]
            step[0] = self.begin[0]
        at = np.cumsum(step)
        upto = at + SHINGLE
        short = np.flatnonzero(size < SHINGLE)
        upto[heads[short]] = self.end[short]
        found = spans.mixed((self.sums[upto] - self.sums[at]) * self.inverse[at])
        return of, found >> np.uint64(24)

    def shingles(self) -> np.ndarray:
        """Sorted distinct (line << 40 | hash) of the shingles."""
        of, low = self._hashes()
        keys = np.sort(of.astype(np.uint64) << np.uint64(40) | low)
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        return keys[fresh]

    def bands(self) -> np.ndarray:
        """One key for each line and band.

        The smallest hash in each of BINS equal parts of the hash range; an empty part borrows from
        the next one that is not.
        """
        of, low = self._hashes()
        none = np.uint64(1 << 63)
        table = np.full(len(self.nodes) * BINS, none)
        np.minimum.at(table, of.astype(np.int64) * BINS + (low * np.uint64(BINS) >> np.uint64(40)).view(np.int64), low)
        table = table.reshape(-1, BINS)
        empty = table == none
        # For each part the next one, itself included, that is not empty, round the end.
        place = np.where(np.concatenate([empty, empty], 1), 2 * BINS, np.arange(2 * BINS))
        place = np.minimum.accumulate(place[:, ::-1], 1)[:, : BINS - 1 : -1]
        steps = (place - np.arange(BINS)).astype(np.uint64) << np.uint64(40)
        table = np.take_along_axis(table, place % BINS, 1) + steps
        out = table.reshape(-1, BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * spans.INVERSE
        for row in range(ROWS):
            key = spans.mixed(key * spans.BASE + out[:, :, row])
        return key.view(np.int64)


def _signatures(docs: DataFrame) -> DataFrame:
    """Per line: its document, number, 64-bit hash ``node`` and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in spans.blocks(batches, "text", SIGN_BYTES):
            lines = Lines(block)
            if not len(lines.nodes):
                continue
            keys = pa.FixedSizeListArray.from_arrays(pa.array(lines.bands().reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            ids = batch.column("doc_id").take(pa.array(lines.doc))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lines.number), pa.array(lines.nodes), keys], ["doc_id", "line", "node", "bands"])

    return docs.mapInArrow(run, "doc_id long, line int, node long, bands array<long>")


def _shared(lines: DataFrame) -> DataFrame:
    """(key, node) of the band keys that two or more different lines have; few rows come more than once."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a line that comes again in the batch is sent once
            nodes, at = np.unique(batch.column("node").to_numpy(), return_index=True)
            keys = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)[at]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(nodes, BANDS))], ["key", "node"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        sent = False  # whether the row carried over from the batch before is given out
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
            if not len(keys):
                continue
            # Spark sorts by the key alone, a long that it can sort by its digits.
            order = np.lexsort((nodes, keys))
            carried = None if not sent else (keys[0], nodes[0])
            keys, nodes = keys[order], nodes[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            keys, nodes = keys[fresh], nodes[fresh]
            same = np.zeros(len(keys) + 1, bool)
            same[1:-1] = keys[1:] == keys[:-1]
            out = same[1:] | same[:-1]
            if carried is not None:
                out &= (keys != carried[0]) | (nodes != carried[1])
            after = bool(same[-2]) or (carried is not None and keys[-1] == carried[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(nodes[out])], ["key", "node"])
            keys, nodes, sent = keys[-1:], nodes[-1:], after

    rows = lines.select("node", "bands").mapInArrow(local, "key long, node long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(runs, "key long, node long")


def _texts(docs: DataFrame) -> DataFrame:
    """(node, text) of the lines whose numbers stand in ``numbers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in spans.blocks(batches, "text", SIGN_BYTES):
            doc, number, lo, hi = _trimmed(block)
            wanted = batch.column("numbers")
            of = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
            wanted = of << 32 | wanted.flatten().to_numpy()
            pick = np.flatnonzero(np.isin(doc << 32 | number, wanted))
            raw = block.data.tobytes()
            texts = pa.array([raw[i:j].decode() for i, j in zip(lo[pick].tolist(), hi[pick].tolist(), strict=True)], pa.string())
            # Each text is one line: white space at its ends is gone, and so are line ends.
            yield pa.RecordBatch.from_arrays([pa.array(Lines(spans.Block(texts)).nodes), texts], ["node", "text"])

    return docs.mapInArrow(run, "node long, text string")


def _alike(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines whose shingle sets have a Jaccard similarity of percent / 100 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                # Each text is one line: white space at its ends is gone, and so are line ends.
                sides = [Lines(spans.Block(batch.column(c).cast(pa.large_string()))) for c in ("text_a", "text_b")]
                sets = [side.shingles() for side in sides]
                sizes = [np.bincount((s >> np.uint64(40)).astype(np.int64), minlength=batch.num_rows) for s in sets]
                both = np.sort(np.concatenate(sets))
                twice = both[1:][both[1:] == both[:-1]] >> np.uint64(40)
                overlap = np.bincount(twice.astype(np.int64), minlength=batch.num_rows)
                good = 100 * overlap >= percent * (sizes[0] + sizes[1] - overlap)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: tuple[int, int]) -> np.ndarray:
    """How many columns each row of ``left`` shares with each row of ``right``; both hold (row, column) of their ones."""
    columns, at = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    sides = [(left[0], at[: len(left[1])]), (right[0], at[len(left[1]) :])]
    both = np.bincount(sides[0][1], minlength=len(columns)).astype(bool) & np.bincount(sides[1][1], minlength=len(columns)).astype(bool)
    place = np.cumsum(both) - 1
    sides = [(row[both[col]], place[col[both[col]]]) for row, col in sides]
    return _product(sides[0], sides[1], rows, int(both.sum()))


def _product(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: tuple[int, int], width: int) -> np.ndarray:
    """``_overlaps`` where the columns are numbered from 0 to ``width``."""
    out = np.zeros(rows, np.float32)
    sides = [left] if left is right else [left, right]
    for start in range(0, width, COLUMNS):
        ones = []
        for (row, col), n in zip(sides, rows, strict=False):
            if width > COLUMNS:
                pick = (col >= start) & (col < start + COLUMNS)
                row, col = row[pick], col[pick] - start
            matrix = np.zeros((n, min(COLUMNS, width - start)), np.float32)
            matrix[row, col] = 1
            ones.append(matrix)
        out += ones[0] @ ones[-1].T
    return out.astype(np.int64)


def _forest(linked: np.ndarray, comps: np.ndarray) -> list[tuple[int, int]]:
    """Links (rows of a symmetric matrix) that join all that ``linked`` joins, at most one a row."""
    out, fresh = [], linked.any(1)
    while fresh.any():
        front = np.flatnonzero(fresh)[:1]
        fresh[front] = False
        while len(front):
            reach = np.flatnonzero(linked[front].any(0) & fresh)
            parent = front[linked[front][:, reach].argmax(0)]
            out += zip(comps[parent].tolist(), comps[reach].tolist(), strict=True)
            fresh[reach] = False
            front = reach
    return out


def _joined(texts: pa.Array, bounds: np.ndarray, first: np.ndarray, comps: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between components of lines in groups, whose rows lie from one bound to the next.

    ``first`` marks the rows of a group's first tile where it holds two tiles, and all rows where it holds one.
    """
    # Each text is one line: white space at its ends is gone, and so are line ends.
    keys = Lines(spans.Block(texts)).shingles()
    of, low = (keys >> np.uint64(40)).view(np.int64), keys & LOW
    sizes = np.bincount(of, minlength=len(texts))
    heads, count = bounds[:-1], np.diff(bounds)
    still = np.minimum.reduceat(comps, heads) != np.maximum.reduceat(comps, heads)
    # Shingles that come twice or more in a group, in order of the groups: one column each.
    group = np.repeat(np.arange(len(heads)), count)[of]
    mine = np.flatnonzero(still[group])
    of, key = of[mine], group[mine].astype(np.uint64) << np.uint64(40) | low[mine]
    order = np.argsort(key)
    of, key = of[order], key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    often = same[1:] | same[:-1]
    of, key, column = of[often], (key[often] >> np.uint64(40)).view(np.int64), np.cumsum(~same[:-1][often]) - 1
    ends = np.searchsorted(key, np.arange(len(heads) + 1))
    out: list[tuple[int, int]] = []
    # A column of a group of two lines is shared by them.
    two = np.flatnonzero(still & (count == 2))
    a, b, shared = heads[two], heads[two] + 1, (ends[two + 1] - ends[two]) // 2
    good = 100 * shared >= percent * (sizes[a] + sizes[b] - shared)
    out += zip(comps[a[good]].tolist(), comps[b[good]].tolist(), strict=True)
    for g in np.flatnonzero(still & (count > 2) & (ends[1:] > ends[:-1])).tolist():
        lo, hi = int(bounds[g]), int(bounds[g + 1])
        own, side = comps[lo:hi], first[lo:hi]
        part = slice(ends[g], ends[g + 1])
        row, col = of[part] - lo, column[part] - column[ends[g]]
        width = int(col[-1]) + 1
        if side.all():
            x = y = np.arange(hi - lo)
            left = right = (row, col)
        else:
            x, y = np.flatnonzero(side), np.flatnonzero(~side)
            rank = np.zeros(hi - lo, np.int64)
            rank[x], rank[y] = np.arange(len(x)), np.arange(len(y))
            in_x = side[row]
            left, right = (rank[row[in_x]], col[in_x]), (rank[row[~in_x]], col[~in_x])
        shared = _product(left, right, (len(x), len(y)), width)
        total = sizes[lo:hi][x][:, None] + sizes[lo:hi][y][None, :] - shared
        good = (100 * shared >= percent * total) & (own[x][:, None] != own[y][None, :])
        if not good.any():
            continue
        linked = np.zeros((hi - lo, hi - lo), bool)
        linked[np.ix_(x, y)] = good
        out += _forest(linked | linked.T, own)
    return out


def _open_links(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that join what alike lines sharing a band ``key`` join.

    ``rows`` holds (key, node, comp). The lines of a key are dealt into tiles, tiles meet in pairs, and a pair
    gives a spanning forest of its links, so rows grow with the tiles of a key and not with its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            bounds = np.append(np.flatnonzero(starts(table)), table.num_rows)
            chars = np.concatenate([[0], np.cumsum(table.column("chars").to_numpy())])
            at = 0
            while at < len(bounds) - 1:  # whole groups of about one block
                upto = max(at + 1, int(np.searchsorted(chars[bounds], chars[bounds[at]] + SIGN_BYTES, "right")) - 1)
                part = table.slice(bounds[at], bounds[upto] - bounds[at]).combine_chunks()
                text = part.column("text").cast(pa.large_string()).combine_chunks()
                text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
                first = part.column("tile").to_numpy() == part.column("i").to_numpy()
                found = _joined(text, bounds[at : upto + 1] - bounds[at], first, part.column("comp").to_numpy(), percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                at = upto

        def starts(table: pa.Table) -> np.ndarray:
            out = np.ones(table.num_rows, bool)
            out[1:] = False
            for name in ("key", "i", "j"):
                value = table.column(name).to_numpy()
                out[1:] |= value[1:] != value[:-1]
            return out

        held = None  # the last group may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = int(np.flatnonzero(starts(table))[-1])
            if last:
                yield from links(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from links(held)

    rows = rows.join(texts.select("node", "text"), "node").withColumn("chars", F.length("text").cast("long"))
    room = rows.groupBy("key").agg(F.greatest(F.count(F.lit(1)) / TILE_LINES, F.sum("chars") / TILE_CHARS).alias("full"))
    tiles = F.ceil("full").cast("int")
    rows = rows.join(room.select("key", tiles.alias("tiles")), "key").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "comp", "chars", "text")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(run, "a long, b long").distinct()


def kept_lines(docs: DataFrame, percent: int = 80, rounds: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Which lines of each document stay: the first one of every group of lines that are alike.

    Lines are compared trimmed and with A-Z lower-cased, by the sets of their runs of SHINGLE
    characters. MinHash signatures in bands find candidates, exact Jaccard similarity decides them, and
    links are joined to components. Of a component, the line with the smallest (id, number) stays.
    Equal lines are one node, told apart by 64-bit hashes. A line without a word is never compared and
    stays. Lines of under SHINGLE characters are only alike when equal.

    One row per document id: ``n_lines`` with a word, ``kept`` the numbers (from 0) of those that stay,
    ``n_kept``. Rows with a null id have no part in it and no row; rows that repeat an id share
    one row. Null and empty texts have no lines. Other columns are not looked at; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).where("doc_id is not null")
    lines = settle(_signatures(docs))
    firsts = settle(lines.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("held")))
    tokens = settle(_shared(lines))
    nodes = tokens.select("node").distinct().join(firsts, "node")
    wanted = nodes.groupBy("first.doc_id").agg(F.collect_set("first.line").alias("numbers"))  # of one document
    texts = settle(_texts(docs.join(wanted, "doc_id")).dropDuplicates(["node"]).join(nodes.select("node", "held"), "node"))

    labels = texts.select("node", F.col("node").alias("comp"), "held")
    for turn in range(rounds + 1):
        own = tokens.join(labels, "node")
        if turn < rounds:
            # The line with most copies is the hub first, then others take their turn.
            chance = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / F.lit(1 << 20)
            hub = F.max(F.struct(F.pow(F.col("held").cast("double"), F.lit(1.0) - turn * chance / rounds).alias("score"), "node", "comp"))
            spread = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), hub.alias("hub")).where("lo < hi")
            near = own.join(spread, "key").where(F.col("comp") != F.col("hub.comp"))
            pairs = near.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
            links = settle(_alike(pairs.distinct(), texts, percent))
            ends = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a")
            ends = ends.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
            ends = ends.select(F.col("x").alias("a"), F.col("y").alias("b"))
        else:
            # All lines of a band that still holds two components are compared.
            spread = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
            ends = _open_links(own.join(spread, "key", "left_semi").select("key", "node", "comp"), texts, percent)
        found = components(ends).select(F.col("node").alias("comp"), F.col("component").alias("to"))
        labels = settle(labels.join(found, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"), "held"))

    groups = firsts.join(labels.select("node", "comp"), "node", "left").groupBy(F.coalesce("comp", "node").alias("comp")).agg(F.min("first").alias("first"))
    kept = groups.groupBy("first.doc_id").agg(F.sort_array(F.collect_set("first.line")).alias("kept"))
    counts = lines.groupBy("doc_id").agg(F.count_distinct("line").alias("n_lines"))
    ids = docs.select("doc_id").distinct()
    out = ids.join(counts, "doc_id", "left").join(kept, "doc_id", "left")
    none = F.array().cast("array<int>")
    return out.select(
        F.col("doc_id").alias(id_column),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.size(F.coalesce("kept", none)).cast("long").alias("n_kept"),
        F.coalesce("kept", none).alias("kept"),
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the lines that ``kept_lines`` drops, and without documents that lose every line.

    Texts whose lines all stay are unchanged, as are rows without an id. Columns stay as they are.
    """
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    found = kept_lines(docs, **options)
    found = found.where("n_kept < n_lines").select(F.col(id_column).alias("__doc"), F.col("kept").alias("__kept"))
    rows = docs.join(found, docs[id_column] == found["__doc"], "left")
    pieces = F.split(docs[text_column], "\n", -1)

    def stays(piece, i):
        return F.array_contains("__kept", i) | ~F.rlike(piece, F.lit(r"[^\x20\x09-\x0D]"))

    text = F.when(F.col("__doc").isNull(), docs[text_column]).otherwise(F.array_join(F.filter(pieces, stays), "\n"))
    rows = rows.where(F.col("__doc").isNull() | (F.size("__kept") > 0))
    return rows.select(*[text.alias(c) if c == text_column else docs[c] for c in docs.columns])
