"""Ranked lexical search: whole tables scored for every item of a query set, exactly.

Documents are dealt into shards, items into blocks, and each pair of them is one group. In a group every item
is searched by a hybrid of term-at-a-time and document-at-a-time evaluation: the postings of its short lists are
summed into accumulators first, and these are then one more list, sorted by document and bounded by its largest
sum, beside the long lists. Lists whose bounds together stay under the k-th best score so far open no document;
they are only looked into for documents that others open and whose bound still reaches that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm import spans
from tactus.llm.shared import settle

#: Bits of the map of the items' terms that documents are read against: half a megabyte, however many items there are.
MARKS = 1 << 22
#: Bytes of one value of Spark's bitmap aggregate.
MAP_BYTES = 4096
#: Postings of a shard and items of a block, about.
SHARD_POSTINGS = 2_000_000
BLOCK_ITEMS = 1000
#: A list is short if it holds at most this share of its shard's documents.
SHORT = 1 / 64
#: Documents of a window that is scored at once.
WINDOW = 4096
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _counted(block: spans.Block, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; and text, term hash and occurrences of its distinct terms whose mark is set."""
    start, end, doc = block.runs(WORD[block.data])
    held = np.bincount(doc, minlength=block.docs)
    ids = block.hashes(start, end, spans.LOWER)
    if marks is not None:
        at = ids & np.uint64(MARKS - 1)
        hit = (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        ids, doc = ids[hit], doc[hit]
    order = np.lexsort((ids, doc))
    ids, doc = ids[order], doc[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return held, doc[at], ids[at].view(np.int64), np.diff(np.append(at, len(ids)))


def _terms(texts: DataFrame, marks: np.ndarray | None = None) -> DataFrame:
    """Per row of (id, text): the id, a row number, terms with repeats ``n``, and distinct terms with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch, block in spans.blocks(batches, "text"):
            held, doc, ids, times = _counted(block, marks)
            edges = pa.array(np.searchsorted(doc, np.arange(block.docs + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(row + np.arange(block.docs)),
                    pa.array(held),
                    pa.ListArray.from_arrays(edges, pa.array(ids)),
                    pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32))),
                ],
                ["id", "row", "n", "terms", "times"],
            )
            row += block.docs

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, row long, n long, terms array<long>, times array<int>")


def _marks(items: DataFrame) -> np.ndarray:
    """The map of the items' terms; its size does not depend on how many there are."""
    # Positions count from 1.
    marks_of = items.select(F.explode("terms").alias("t")).select((F.col("t").bitwiseAND(F.lit(MARKS - 1)) + 1).alias("mark"))
    parts = marks_of.groupBy(F.bitmap_bucket_number("mark").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits"))
    marks = np.zeros(MARKS // 8, np.uint8)
    for r in parts.collect():
        first = (r["part"] - 1) * MAP_BYTES
        marks[first : first + MAP_BYTES] = np.frombuffer(r["bits"], np.uint8)
    return marks


@dataclass
class Lists:
    """A shard's inverted lists: of each term the documents' places in ascending order, and what an occurrence count earns there."""

    places: list[np.ndarray]
    gains: list[np.ndarray]
    docs: int


def best(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best documents, highest first, equal scores by ascending place.

    ``terms`` are numbers of lists, ``weights`` the integers that their gains are multiplied by. Only documents
    with a score above 0 count.
    """
    short, long = [], []
    for t, w in zip(terms, weights, strict=True):
        if w > 0 and len(lists.places[t]):
            (short if len(lists.places[t]) <= lists.docs * SHORT else long).append((t, w))
    # Term at a time: the short lists become one, with a sum for each of its documents.
    if short:
        places = np.concatenate([lists.places[t] for t, _ in short])
        order = np.argsort(places, kind="stable")
        places = places[order]
        at = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        sums = np.add.reduceat(np.concatenate([lists.gains[t] * w for t, w in short])[order], at)
        entries = [(int(sums.max()), places[at], sums)]
    else:
        entries = []
    entries += [(int(lists.gains[t].max()) * int(w), lists.places[t], lists.gains[t] * w) for t, w in long]
    entries.sort(key=lambda e: e[0])
    reach = np.cumsum([0, *(e[0] for e in entries)])
    top_places, top_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # What the accumulators hold is reached already, so their k-th best is a first threshold; other documents may equal it.
    least = 1
    if short and len(sums) >= k:
        least = max(1, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
    ends = [0] * len(entries)
    for lo in range(0, lists.docs, WINDOW):
        hi = min(lists.docs, lo + WINDOW)
        # The first lists together earn less than the threshold: they open no document.
        opening = int(np.searchsorted(reach, least, "left"))
        if opening > len(entries):
            break
        opening = max(opening - 1, 0)
        scores = np.zeros(hi - lo, np.int64)
        opened = np.zeros(hi - lo, bool)
        for i in range(opening, len(entries)):
            _, places, gains = entries[i]
            a, b = np.searchsorted(places, (lo, hi))
            scores[places[a:b] - lo] += gains[a:b]
            opened[places[a:b] - lo] = True
        alive = np.flatnonzero(opened)
        for i in range(opening - 1, -1, -1):
            alive = alive[scores[alive] + reach[i + 1] >= least]
            if not len(alive):
                break
            _, places, gains = entries[i]
            at = np.searchsorted(places, alive + lo)
            inside = at < len(places)
            inside[inside] = places[at[inside]] == alive[inside] + lo
            scores[alive[inside]] += gains[at[inside]]
        alive = alive[scores[alive] >= least]
        if len(alive):
            # Places ascend, so a stable sort by score leaves equal ones in their order.
            top_places, top_scores = np.append(top_places, alive + lo), np.append(top_scores, scores[alive])
            order = np.argsort(-top_scores, kind="stable")[:k]
            top_places, top_scores = top_places[order], top_scores[order]
            if len(order) == k:
                # Later documents have larger places and must do better than the last of the best.
                least = max(least, int(top_scores[-1]) + 1)
    return top_places, top_scores


def _found(docs: pa.Table, items: pa.Table, n_docs: int, n_terms: int, k: int) -> pa.Table:
    """The best documents of a shard for each item of a block."""
    wanted = items.column("terms").combine_chunks()
    vocabulary = np.unique(wanted.flatten().to_numpy(zero_copy_only=False))
    ids = docs.column("id").combine_chunks()
    # Places follow ascending ids, nulls last.
    order = pc.sort_indices(docs.select(["id", "row"]), [("id", "ascending"), ("row", "ascending")])
    docs, ids = docs.take(order), ids.take(order)
    terms = docs.column("terms").combine_chunks()
    edges = terms.offsets.to_numpy()
    place = np.repeat(np.arange(docs.num_rows), np.diff(edges))
    flat = terms.flatten().to_numpy(zero_copy_only=False)
    times = docs.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    at = np.searchsorted(vocabulary, flat)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
    at, place, times = at[known], place[known], times[known].astype(np.int64)
    length = docs.column("n").to_numpy()
    m = 75 + (25 * length * n_docs) // max(n_terms, 1)
    gain = (1_000_000_000 * times) // (1000 * times + 12 * m[place])
    by_term = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[by_term], np.arange(1, len(vocabulary)))
    lists = Lists(np.split(place[by_term], cuts), np.split(gain[by_term], cuts), docs.num_rows)
    weights = items.column("weights").combine_chunks()
    asked = np.searchsorted(vocabulary, wanted.flatten().to_numpy(zero_copy_only=False))
    value = weights.flatten().to_numpy(zero_copy_only=False)
    bounds = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
    rows, places, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, item in enumerate(items.column("row").to_pylist()):
        span = slice(bounds[i], bounds[i + 1])
        p, s = best(lists, asked[span], value[span], k)
        rows += [item] * len(p)
        places.append(p)
        scores.append(s)
    place = pa.array(np.concatenate(places))
    return pa.table({"item": pa.array(rows, pa.int64()), "id": ids.take(place), "row": docs.column("row").take(place), "score": pa.array(np.concatenate(scores))})


def _each(parts: int) -> Column:
    """One row for each of the parts."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item id, ``rank`` from 1, document id and ``score``.

    Terms are maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z as a-z. With N
    documents that have a term, L terms in them with repeats, n of them in the document, df documents holding a term and tf
    occurrences there, a term weighs floor(1000 ln((2N + 2) / (2df + 1))) and a document's score sums weight *
    (10**9 tf div (1000 tf + 12 m)), m = 75 + (25 n N) div L, over the item's terms with repeats. Only scores above 0 are
    returned; equal ones by ascending document id, null ids last.

    Null and empty texts have no terms: as documents they are never found and do not count, as items they find nothing.
    Rows are documents and items of their own even if they repeat an id. Terms are told apart by 64-bit hashes. Other
    columns are not looked at. Empty tables give an empty result.
    """
    asked = items.select(items[item_column].alias("id"), items[item_text_column].alias("text"))
    asked = settle(_terms(asked))
    texts = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    index = settle(_terms(texts, _marks(asked)).where("n > 0"))
    size = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms").cast("long")).alias("postings")).first()
    n_docs, n_terms, postings = (size[c] or 0 for c in ("docs", "terms", "postings"))
    each = asked.select("id", "row", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("id", "row", "x.terms", "x.times")
    df = index.select(F.explode("terms").alias("terms")).groupBy("terms").agg(F.count("*").alias("df"))
    df = df.join(each.select("terms").distinct(), "terms")
    weight = F.floor(1000 * F.ln((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    each = each.join(df, "terms").withColumn("weight", weight)
    # Items stay together with their terms; a block of them meets every shard.
    packed = each.groupBy("row").agg(F.collect_list(F.struct("terms", "weight")).alias("x"))
    shards = max(1, -(-postings // SHARD_POSTINGS))
    blocks = max(1, -(-asked.count() // BLOCK_ITEMS))
    packed = packed.select("row", F.col("x.terms").alias("terms"), F.col("x.weight").alias("weights"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    packed = packed.withColumn("shard", _each(shards))
    dealt = index.withColumns({"shard": F.pmod(F.xxhash64("row"), F.lit(shards)), "block": _each(blocks)})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _found(left, right, n_docs, n_terms, k)

    kind = index.schema["id"].dataType.simpleString()
    found = dealt.groupBy("block", "shard").cogroup(packed.groupBy("block", "shard")).applyInArrow(run, f"item long, id {kind}, row long, score long")
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("item"), F.col("id").alias("__item"))
    return found.join(names, "item").select(F.col("__item").alias(item_column), "rank", F.col("id").alias(id_column), "score")
