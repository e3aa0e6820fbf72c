"""Token ids in Re-Pair compressed files: grammar per shard, random access by expansion lengths."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.llm import spans
from tactus.llm.shared import folder

END = 1
#: Tokens of one shard row, about.
SHARD_TOKENS = 2 << 20
#: Pieces that a worker remembers, and the one that stands between pieces that are encoded together.
REMEMBERED, MARK = 1_500_000, "\x02"
#: Kinds of pairs replaced in one pass, passes, and the share of a sequence that a pass must save.
KINDS, PASSES, LEAST_SAVING = 2000, 8, 0.01
#: Cells in which pairs are counted before the frequent ones are told apart.
BINS = 1 << 18
LETTERS, SIGNS = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SIGNS[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True


class WordEncoder:
    """Ids of whole texts from those of their pieces.

    For a tokenizer that lowers case, drops white space and merges neither across it nor between a
    letter and a sign. A piece between white space, or between an ASCII letter and one of SIGNS, is
    then encoded alike wherever it stands; known ones, told apart by 64-bit hashes, need no second look.
    Signs that special tokens and contractions hold are none of SIGNS.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        (self.mark,) = self._ids(MARK)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.known, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces in one go: words of ASCII letters in a row, each to its word end; other
        pieces with a mark after each; those that hold the mark one by one."""
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        letters = np.array([p.isascii() and p.isalpha() for p in pieces], bool)
        odd = np.array([MARK in p for p in pieces], bool)
        held: list[np.ndarray] = []
        total = 0
        for mine, joint in ((letters, " "), (~letters & ~odd, f" {MARK} ")):
            at = np.flatnonzero(mine)
            ids = np.array(self._ids(joint.join([*(pieces[i] for i in at), ""])), np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1 if joint == " " else np.flatnonzero(ids == self.mark)
            skip = 0 if joint == " " else 1  # a mark is no id of the piece
            starts[at] = np.concatenate([[0], ends[:-1] + skip])[: len(at)] + total
            sizes[at] = ends + total - starts[at]
            held.append(ids)
            total += len(ids)
        for i in np.flatnonzero(odd):
            own = np.array(self._ids(pieces[i]), np.int32)
            starts[i], sizes[i] = total, len(own)
            held.append(own)
            total += len(own)
        ids = np.concatenate(held)
        self.start, self.size = np.concatenate([self.start, starts + len(self.flat)]), np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.codes = np.concatenate([self.codes, np.arange(len(self.codes), len(self.codes) + len(hashes))])[order]

    def encode(self, block: spans.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        lo, hi, doc = block.units(LETTERS, SIGNS)
        hashes = block.hashes(lo, hi, spans.LOWER)
        special = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(block.data == 0x3C, out=special[1:])
        cased = special[hi] > special[lo]  # special tokens are found before case is lowered
        if cased.any():
            hashes[cased] = ~block.hashes(lo[cased], hi[cased])
        hashes, at, kind = np.unique(hashes, return_index=True, return_inverse=True)
        if not len(hashes):
            return np.zeros(0, np.int32), np.zeros(block.docs, np.int64)
        place = np.searchsorted(self.known, hashes)
        new = place == len(self.known)
        new[~new] = self.known[place[~new]] != hashes[~new]
        if new.any():
            raw = block.data.tobytes()
            self._learn(hashes[new], [raw[a:b].decode() for a, b in zip(lo[at[new]].tolist(), hi[at[new]].tolist(), strict=True)])
            place = np.searchsorted(self.known, hashes)
        codes = self.codes[place][kind]
        sizes, starts = self.size[codes], self.start[codes]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]
        edges = np.searchsorted(doc, np.arange(block.docs + 1))
        return ids, total[edges[1:]] - total[edges[:-1]]


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def compress(ids: np.ndarray, lengths: np.ndarray, first_free: int, last: int = (1 << 16) - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in passes: (rules, expansion lengths, sequence).

    Each pass counts all neighbouring pairs inside documents and replaces the most frequent kinds by
    new nonterminals, left to right where occurrences overlap, until a pass saves little or the
    symbols from ``first_free`` to ``last`` are used up.
    """
    seq = ids.astype(np.uint32)
    final = np.zeros(len(seq), bool)
    ends = np.cumsum(lengths) - 1
    final[ends[lengths > 0]] = True
    rules: list[np.ndarray] = []
    free = first_free
    for _ in range(PASSES):
        if len(seq) < 2 or free > last:
            break
        key = ((seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(14)).astype(np.int32)
        key[final[:-1]] = BINS
        heavy = np.bincount(key, minlength=BINS + 1)[:BINS]
        kinds = min(KINDS, last - free + 1)
        least = max(8, int(np.partition(heavy, BINS - kinds)[BINS - kinds]))
        hit = np.zeros(BINS + 1, bool)
        hit[:BINS] = heavy >= least
        at = np.flatnonzero(hit[key])
        if not len(at):
            break
        # Few pairs fall into each frequent cell, so sorting their kinds is sorting small numbers.
        both = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        ordered = np.sort(both)
        fresh = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        pairs, counts = ordered[fresh], np.diff(fresh, append=len(ordered))
        chosen = np.argsort(-counts, kind="stable")[:kinds]
        chosen = np.sort(chosen[counts[chosen] >= 8])
        if not len(chosen):
            break
        pairs = pairs[chosen]
        kind = np.searchsorted(pairs, both)
        kind[kind == len(pairs)] = 0
        same = pairs[kind] == both
        at, kind = at[same], kind[same]
        head = np.ones(len(at), bool)
        head[1:] = at[1:] != at[:-1] + 1
        nth = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        take = nth % 2 == 0  # of overlapping occurrences every other one
        at, kind = at[take], kind[take]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.int64))
        seq[at] = free + kind
        free += len(pairs)
        final[at] = final[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        before = len(seq)
        seq, final = seq[stay], final[stay]
        if len(at) < LEAST_SAVING * before:
            break
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    sizes = np.ones(first_free + len(table), np.int32)
    done = first_free
    for part in rules:  # a pass only uses symbols of earlier ones
        sizes[done : done + len(part)] = sizes[part].sum(1)
        done += len(part)
    return table.astype(np.uint16), sizes[first_free:], seq.astype(np.uint16)


def _copied(out: np.ndarray, at: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, start: np.ndarray, flat: np.ndarray, first_free: int) -> None:
    """Write what each symbol stands for to ``out`` from ``at`` on; ``flat`` holds the rules' ids."""
    plain = symbols < first_free
    out[at[plain]] = symbols[plain]
    rule, at = symbols[~plain] - first_free, at[~plain]
    size, begin = sizes[rule].astype(np.int64), start[rule]
    ramp = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + ramp] = flat[np.repeat(begin, size) + ramp]


def expand(rules: np.ndarray, sizes: np.ndarray, seq: np.ndarray, first_free: int) -> np.ndarray:
    """The ids that a sequence of symbols stands for."""
    rules, seq = rules.astype(np.int64), seq.astype(np.int64)
    every = np.concatenate([np.ones(first_free, np.int64), sizes])
    start = np.cumsum(sizes, dtype=np.int64) - sizes
    flat = np.zeros(int(sizes.sum()), np.int32)
    level = np.zeros(first_free + len(rules), np.int32)
    while len(rules):  # a rule is one level above the higher of its two
        new = 1 + level[rules].max(1)
        if (level[first_free:] == new).all():
            break
        level[first_free:] = new
    for depth in range(1, int(level.max()) + 1 if len(level) else 1):
        mine = np.flatnonzero(level[first_free:] == depth)
        left, right = rules[mine, 0], rules[mine, 1]
        _copied(flat, start[mine], left, sizes, start, flat, first_free)
        _copied(flat, start[mine] + every[left], right, sizes, start, flat, first_free)
    count = every[seq]
    out = np.empty(int(count.sum()), np.int32)
    _copied(out, np.cumsum(count) - count, seq, sizes, start, flat, first_free)
    return out


def read_slice(rules: np.ndarray, sizes: np.ndarray, seq: np.ndarray, first_free: int, start: int, size: int) -> np.ndarray:
    """``size`` ids from ``start`` on, expanding only the symbols that cover them."""
    count = np.ones(len(seq), np.int64)
    rule = seq.astype(np.int64) - first_free
    count[rule >= 0] = sizes[rule[rule >= 0]]
    end = np.cumsum(count)
    lo, hi = np.searchsorted(end, [start, start + size - 1], "right")
    found = expand(rules, sizes, seq[lo : hi + 1], first_free)
    begin = start - (int(end[lo - 1]) if lo else 0)
    return found[begin : begin + size]


FORMAT = (
    "shard int, part int, first_free int, doc_ids array<long>, lengths array<long>, rules binary, expansions binary, sequence binary"
)


def write(docs: DataFrame, path: str, tokenizer: str, shards: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode texts and write the ids to ``path`` in ascending id order.

    The table at ``path`` has a row for about ``SHARD_TOKENS`` ids of whole documents: their ids and
    lengths, the pairs that nonterminals stand for, their expansion lengths and the sequence of
    16-bit symbols. Rows are in order of (shard, part). Each document ends with id 1.

    Null texts count as empty (one id, the end), null ids come first, and repeated rows are documents
    of their own, those with one id in order of their texts. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        first_free = encoder.tokenizer.get_vocab_size()
        shard = TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        part = tokens = 0

        def flush() -> pa.RecordBatch:
            names = [i for ids, _, _ in held for i in ids]
            lengths = np.concatenate([x for _, x, _ in held])
            rules, sizes, seq = compress(np.concatenate([x for _, _, x in held]), lengths, first_free)
            columns = [[shard], [part], [first_free], [names], [lengths.tolist()], [rules.tobytes()], [sizes.tobytes()], [seq.tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in FORMAT.split(", ")])

        for batch, block in spans.blocks(batches, "text", 2 << 20):
            ids, sizes = encoder.encode(block)
            whole = np.empty(len(ids) + block.docs, np.int32)
            ends = np.cumsum(sizes + 1) - 1
            body = np.ones(len(whole), bool)
            body[ends] = False
            whole[body], whole[ends] = ids, END
            held.append((batch.column(0).to_pylist(), sizes + 1, whole))
            tokens += len(whole)
            if tokens >= SHARD_TOKENS:
                yield flush()
                held, tokens, part = [], 0, part + 1
        if held:
            yield flush()

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, FORMAT).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a table that ``write`` made: ``doc_id``, ``start`` (ids of all documents
    before it) and ``ids`` as little-endian unsigned 32-bit integers."""
    files = spark.read.schema(FORMAT).parquet(path)
    sizes = files.select("shard", "part", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("shard", "part", before.alias("within"))
    shards = sizes.groupBy("shard").agg(F.sum("size").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.join(shards.select("shard", ahead.alias("ahead")), "shard")
    offsets = offsets.select("shard", "part", (F.col("within") + F.col("ahead")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], np.uint16).reshape(-1, 2)
                sizes = np.frombuffer(row["expansions"], np.int32)
                ids = expand(rules, sizes, np.frombuffer(row["sequence"], np.uint16), row["first_free"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                for i in range(0, len(lengths), 512):  # a batch at a time
                    part = lengths[i : i + 512]
                    begin = ends[i] - lengths[i]
                    edges = np.concatenate([[0], np.cumsum(part)]).astype(np.int32) * 4
                    data = pa.py_buffer(ids[begin : begin + int(part.sum())].tobytes())
                    values = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(edges.tobytes()), data])
                    starts = row["offset"] + (ends - lengths)[i : i + 512]
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][i : i + 512], pa.int64()), pa.array(starts), values], ["doc_id", "start", "ids"])

    # Few rows a batch: each of them is a whole shard row.
    return files.join(offsets, ["shard", "part"]).mapInArrow(run, "doc_id long, start long, ids binary")


def stored(docs: DataFrame, tokenizer: str, shards: int, **columns: str) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = folder(spark)
    write(docs, path, tokenizer, shards, **columns)
    return read(spark, path)
