"""Exact Jaccard join of documents on word n-grams with rare-first prefixes.

Four steps. Equal n-gram sets become one class. A first pass over hash-ordered prefixes counts the
n-grams that each set shares there with any other; with too few it cannot have a partner. For the rest,
n-grams are counted and ordered from rare to common; prefixes in that order, with length and
positional filters, give candidate pairs, and a suffix filter and the exact sets decide each pair.
Pairs inside one component need no look any more, so most of a large group is joined through the
members in its middle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm import spans
from tactus.llm.components import components
from tactus.llm.shared import settle

#: Parts of the hash range whose counts bound the overlap of two sets.
BINS = 16
#: Bits of the map that texts are looked up in before they are moved.
MARKS = 1 << 23


def _needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def _head(n: int, percent: int) -> int:
    """Length of a prefix that shares as many n-grams with a partner's as a set may lack, and one more.

    Two sets that overlap in their needed parts share k n-grams within the first n - needed + k.
    """
    return min(n, 2 * (n - _needed(n, percent)) + 1)


def _sets(block: spans.Block, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text with fewer words is one n-gram."""
    start, end, doc = block.words()
    words = block.hashes(start, end, spans.LOWER)
    keys, at = spans.grams(words, doc, n)
    counts = np.bincount(doc, minlength=block.docs)
    first = np.concatenate([[0], np.cumsum(counts)])
    of = np.searchsorted(doc[at], np.arange(block.docs + 1)) if len(at) else np.zeros(block.docs + 1, np.int64)
    for i in range(block.docs):
        if counts[i] >= n:
            yield np.unique(keys[of[i] : of[i + 1]]).view(np.int64)
        elif counts[i]:
            few = words[first[i] : first[i + 1]].tobytes()
            yield np.frombuffer(hashlib.blake2b(few, digest_size=8).digest(), np.int64)
        else:
            yield np.zeros(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    edges = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=edges[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values))


def _key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _summaries(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: set size, a digest of the set, and its prefix in the order of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in spans.blocks(batches, "text"):
            sets = list(_sets(block, n))
            sizes = [len(s) for s in sets]
            keys = [_key(s) if len(s) else None for s in sets]
            heads = [s[: _head(len(s), percent)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(heads)], ["doc_id", "n", "key", "head"]
            )

    return docs.mapInArrow(run, "doc_id long, n long, key binary, head array<long>")


def _whole(docs: DataFrame, n: int) -> DataFrame:
    """Per row with the digest ``key``: all n-gram hashes and their counts in parts of the hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in spans.blocks(batches, "text"):
            sets = list(_sets(block, n))
            same = np.array([_key(s) == k.as_py() for s, k in zip(sets, batch.column("key"), strict=True)], bool)
            part = batch.select(["doc_id"]).filter(pa.array(same))
            sets = [s for s, ok in zip(sets, same, strict=True) if ok]
            counts = [np.bincount(s.view(np.uint64) >> np.uint64(60), minlength=BINS).astype(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets), _lists(counts)], ["rep", "grams", "bins"])

    return docs.mapInArrow(run, "rep long, grams array<long>, bins array<long>")


def _sharing(heads: DataFrame) -> DataFrame:
    """``doc_id`` and how many of its prefix n-grams (``head``) are in another row's prefix too.

    Tasks first look inside a batch: of rows that share an n-gram there, one goes on to stand for it,
    so a common n-gram sends one row per batch. Sorted runs then show what batches share.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.column("head")
            grams = head.flatten().to_numpy(zero_copy_only=False)
            docs = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), np.diff(head.offsets.to_numpy()))
            order = np.argsort(grams, kind="stable")
            grams, docs = grams[order], docs[order]
            first = np.ones(len(grams), bool)
            first[1:] = grams[1:] != grams[:-1]
            shared = np.zeros(len(grams), bool)
            shared[1:] |= ~first[1:]
            shared[:-1] |= ~first[1:]
            known, times = np.unique(docs[shared], return_counts=True)
            # A row for each n-gram (0: it is counted already) and one for each document's count.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([grams[first], spans.mixed(known.astype(np.uint64)).view(np.int64)])),
                    pa.array(np.concatenate([docs[first], known])),
                    pa.array(np.concatenate([np.where(shared[first], 0, -1), times]).astype(np.int32)),
                ],
                ["gram", "doc_id", "times"],
            )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None  # the n-gram before, and its document if that is not counted yet
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column("times").to_numpy()
            counted = times > 0
            docs = [batch.column("doc_id").to_numpy()[counted]]
            counts = [times[counted].astype(np.int64)]
            grams = batch.column("gram").to_numpy()[~counted]
            mine = batch.column("doc_id").to_numpy()[~counted]
            new = times[~counted] < 0
            if len(grams):
                again = np.zeros(len(grams), bool)
                again[1:] = grams[1:] == grams[:-1]
                out = again.copy()
                out[:-1] |= again[1:]
                if last is not None and grams[0] == last[0]:
                    out[0] = True
                    if last[1] is not None:
                        docs.append(np.array([last[1]], np.int64))
                        counts.append(np.ones(1, np.int64))
                last = (int(grams[-1]), None if out[-1] or not new[-1] else int(mine[-1]))
                found, n = np.unique(mine[out & new], return_counts=True)
                docs.append(found)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(counts))], ["doc_id", "times"])

    rows = heads.mapInArrow(local, "gram long, doc_id long, times int")
    ordered = rows.repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(runs, "doc_id long, times long").groupBy("doc_id").agg(F.sum("times").alias("times"))


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` may be in ``wanted``: all that are, and few others.

    A bitmap of MARKS hashed ids (1 MB, whatever the size of the tables) goes to every task, so texts
    that nobody asks for are dropped where they are read. With very many ids it lets more rows through.
    """
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(mark).alias("__map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("__bits"))
    rows = docs.withColumns({"__map": F.bitmap_bucket_number(mark), "__bit": F.bitmap_bit_position(mark)})
    rows = rows.join(F.broadcast(maps), "__map")  # at most MARKS / 8 bytes
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.where(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1).select(*docs.columns)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough: suffix filter first, then the exact overlap."""
    sides = [sets.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("shared").alias(f"shared_{s}"), F.col("bins").alias(f"bins_{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    sizes = F.col("n_a") + F.col("n_b")
    most = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    both = both.where(most * (100 + percent) >= percent * sizes)
    overlap = F.size(F.array_intersect("shared_a", "shared_b"))
    return both.where(overlap * (100 + percent) >= percent * sizes).select("a", "b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (rep, comp) after bringing together what ``links`` (a, b) of components join."""
    found = components(links).select(F.col("node").alias("comp"), F.col("component").alias("to"))
    return settle(labels.join(found, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")))


def set_join(whole: DataFrame, percent: int, rounds: int, labels: DataFrame | None = None) -> DataFrame:
    """Components (rep, comp) of sets with a Jaccard similarity of ``percent`` / 100 or more.

    ``whole`` has ``rep``, ``grams`` (distinct numbers) and ``bins`` (counts of them by parts of their
    range). ``labels`` (rep, comp) may say what is joined already. A set that is certainly like no other
    has no row.
    """
    postings = whole.select("rep", F.explode("grams").alias("gram"))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = postings.join(counts, "gram").groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("df", "gram"))).alias("ranked"))
    whole_sizes = whole.select("rep", F.size("grams").cast("long").alias("n"), "bins").dropDuplicates(["rep"])
    need = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
    # N-grams of one class only come first in the order; they are no one's candidates.
    sets = ranked.join(whole_sizes, "rep").where(F.size("ranked") >= need)
    alone = F.col("n") - F.size("ranked")
    prefix = F.slice("ranked.gram", F.lit(1), (F.col("n") - need + 1 - alone).cast("int"))
    # A text whose n-grams are common among the others is near the middle of its group.
    middle = F.aggregate("ranked", F.lit(0.0), lambda s, x: s + F.log(x["df"].cast("double"))) / F.col("n")
    sets = settle(sets.select("rep", "n", "bins", F.col("ranked.gram").alias("shared"), prefix.alias("prefix"), alone.alias("alone"), middle.alias("middle")))
    tokens = settle(
        sets.select("rep", "n", "alone", "middle", F.posexplode("prefix").alias("nth", "gram"))
    )

    def fits(a: Column, b: Column) -> Column:
        return (a * 100 >= b * percent) & (b * 100 >= a * percent)

    start = sets.select("rep", F.col("rep").alias("comp"))
    if labels is not None:
        start = start.drop("comp").join(labels.select("rep", "comp"), "rep")
    labels = start
    for turn in range(rounds + 1):
        own = tokens.join(labels, "rep")
        if turn < rounds:
            # Other hubs in each round: the middle of a group first, then others near it.
            chance = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1 << 20)) / F.lit(1 << 20)
            hub = F.max(F.struct((F.col("middle") * (1 - 0.2 * turn * chance)).alias("score"), "rep", "comp", "n"))
            spread = own.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), hub.alias("hub")).where("lo < hi")
            near = own.join(spread, "gram").where((F.col("comp") != F.col("hub.comp")) & fits(F.col("n"), F.col("hub.n")))
            pairs = near.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
        else:
            spread = own.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
            open_ = own.join(spread, "gram", "left_semi").join(sets.select("rep", "prefix"), "rep")
            open_ = settle(open_.select("gram", "rep", "comp", "n", (F.col("alone") + F.col("nth")).alias("at"), F.slice("prefix", F.lit(1), F.col("nth")).alias("before")))
            x, y = (open_.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "comp", "n", "at", "before")]) for side in "ab")
            # A pair comes from the first prefix n-gram that both have; none before it is common.
            reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
            near = x.join(y, "gram").where((F.col("rep_a") < F.col("rep_b")) & (F.col("comp_a") != F.col("comp_b")) & fits(F.col("n_a"), F.col("n_b")))
            near = near.where(reach * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
            pairs = near.where(~F.arrays_overlap("before_a", "before_b")).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        links = settle(_verified(pairs, sets, percent))
        ends = links.join(labels.select(F.col("rep").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("rep").alias("b"), F.col("comp").alias("y")), "b")
        labels = _merged(labels, ends.select(F.col("x").alias("a"), F.col("y").alias("b")))

    return labels


def jaccard_join(
    docs: DataFrame,
    n: int = 4,
    percent: int = 85,
    rounds: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Components of documents whose n-gram sets have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs without ASCII white space, A-Z lower-cased. ``n_shingles`` is the size of the set of
    distinct n-grams; a text with fewer than ``n`` words is one n-gram. ``component_id`` is the
    smallest id reachable over links. N-grams are compared by 64-bit hashes, equal sets by 128 bits.

    One row per input row. Null and empty texts and those without a word have no n-grams and link with
    nothing. A row without an id links with nothing and has no component. If an id comes with several
    texts, the one with the smallest digest stands for it; each row keeps its own count. Other columns
    are not looked at, and an empty table gives an empty result.
    """
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    rows = settle(_summaries(docs, n, percent))
    ids = rows.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("key").alias("key"))
    classes = settle(ids.groupBy("key").agg(F.min("doc_id").alias("rep")))
    # A partner has at least this share of the n-grams, and so at least this many in common in the prefix.
    least = F.ceil(F.col("n") * percent / F.lit(100))
    shared_least = F.floor(least * (100 - percent) / F.lit(100)) + 1
    sizes = rows.where("n > 0").groupBy("doc_id", "key").agg(F.max("n").alias("n"))
    sharing = _sharing(rows.where("doc_id is not null and n > 0").select("doc_id", "head"))
    sharing = sharing.join(classes.select(F.col("rep").alias("doc_id"), "key"), "doc_id").join(sizes, ["doc_id", "key"])
    sharing = settle(sharing.where(F.col("times") >= F.least(shared_least, F.col("n"))).select(F.col("doc_id").alias("rep"), "key"))

    texts = _likely(docs, sharing.select(F.col("rep").alias("doc_id"))).join(sharing.select(F.col("rep").alias("doc_id"), "key"), "doc_id")
    whole = settle(_whole(texts.select("doc_id", "text", "key"), n))
    labels = set_join(whole, percent, rounds)
    named = ids.join(classes, "key").join(labels, "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    return out.select(F.col("doc_id").alias(id_column), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that link to one with a smaller id; columns stay as they are.

    Rows without an id stay, and rows that repeat an id stay or go together.
    """
    found = jaccard_join(docs, id_column=id_column, **options)
    others = found.where(F.col("component_id") != F.col(id_column)).select(F.col(id_column).alias("__doc")).distinct()
    return docs.join(others, docs[id_column] == others["__doc"], "left_anti")
