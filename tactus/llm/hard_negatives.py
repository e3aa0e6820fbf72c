"""Hard negatives of anchors by exact search in a multiway hyperplane tree with distance ranges.

Vectors are lifted by one coordinate to a common norm M, so that a window of inner products with a query
is a window of distances (an annulus around the query). The tree's split points come from a bounded sample; every
row goes to the nearest split point at each node down to a leaf. For each split point the tree keeps the least and
largest distance to the rows of every sibling subtree. A subtree is passed by if, for any split point, its range
and the annulus cannot meet. What is left is searched exactly, leaf by leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.shared import settle

#: Rows that the tree is fitted on at most, and numbers in them at most (32 MB).
SAMPLE_ROWS = 20_000
SAMPLE_NUMBERS = 4_000_000
#: Children of a node.
WAYS = 8
#: Rows that a leaf is meant to hold and a tile of one holds about; queries of a lot.
TILE = 1500
LOT = 400
#: Components beyond this are not searched: a hundred times their products might not fit a long.
WIDEST = 1 << 23
#: Sums of products up to this are exact in doubles.
EXACT = 1 << 53
#: Added to distances, in parts of M: far above rounding errors and far below distances that matter.
SLACK = 1e-6
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass
class Node:
    """Split points with the lifted coordinate, what lies below each (a node or the number of a leaf), and its ranges.

    ``near[i, j]`` and ``far[i, j]`` are the distances from split point i to the nearest and farthest row below j.
    """

    number: int
    points: np.ndarray
    below: list
    near: np.ndarray
    far: np.ndarray


@dataclass
class Tree:
    radius: float
    root: Node | None = None
    nodes: list[Node] = field(default_factory=list)
    leaves: int = 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        square = np.maximum(self.radius**2 - np.einsum("ij,ij->i", x, x), 0.0)
        return np.hstack([x, np.sqrt(square)[:, None]])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def fit(sample: np.ndarray, radius: float, leaf_rows: int, ways: int = WAYS) -> Tree:
    """A tree whose leaves hold about ``leaf_rows`` of the sample's rows; split points lie far from one another."""
    tree = Tree(radius)
    lifted = tree.lift(sample)
    tree.leaves = 0

    def build(rows: np.ndarray):
        x = lifted[rows]
        chosen = [0]
        nearest = _apart(x, x[:1])[:, 0]
        while len(rows) > leaf_rows and len(chosen) < ways:
            at = int(nearest.argmax())
            if nearest[at] <= SLACK * radius:
                break
            chosen.append(at)
            nearest = np.minimum(nearest, _apart(x, x[at : at + 1])[:, 0])
        if len(chosen) == 1:
            tree.leaves += 1
            return tree.leaves - 1
        points = x[chosen]
        side = _apart(x, points).argmin(1)
        shape = (len(chosen), len(chosen))
        node = Node(len(tree.nodes), points, [], np.full(shape, np.inf), np.full(shape, -np.inf))
        tree.nodes.append(node)
        node.below = [build(rows[side == j]) for j in range(len(chosen))]
        return node

    if len(sample):
        found = build(np.arange(len(sample)))
        tree.root = found if isinstance(found, Node) else None
    tree.leaves = max(tree.leaves, 1)
    return tree


def _routed(tree: Tree, x: np.ndarray, seen: Callable[[Node, int, np.ndarray], None] | None = None) -> np.ndarray:
    """The leaf of each lifted row. ``seen`` gets a node, a child and its rows' distances to the node's split points."""
    leaf = np.zeros(len(x), np.int64)

    def down(node, rows: np.ndarray) -> None:
        if not isinstance(node, Node):
            leaf[rows] = node
            return
        apart = _apart(x[rows], node.points)
        side = apart.argmin(1)
        for j, below in enumerate(node.below):
            mine = side == j
            if mine.any():
                if seen:
                    seen(node, j, apart[mine])
                down(below, rows[mine])

    if tree.root is not None and len(x):
        down(tree.root, np.arange(len(x)))
    return leaf


def reached(tree: Tree, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query numbers and leaves that a query's annulus, from distance ``low`` to ``high``, may meet."""
    if tree.root is None:
        at = np.flatnonzero(low <= high)
        return at, np.zeros(len(at), np.int64)
    q = np.hstack([queries, np.zeros((len(queries), 1))])
    slack = SLACK * tree.radius
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def down(node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not isinstance(node, Node):
            found.append((rows, np.full(len(rows), node)))
            return
        apart = _apart(q[rows], node.points)
        for j, below in enumerate(node.below):
            # From every split point i: the rows below j lie from |d - range| to d + range away from the query.
            nearest = np.maximum(np.maximum(apart - node.far[:, j], node.near[:, j] - apart).max(1), 0.0)
            farthest = (apart + node.far[:, j]).min(1)
            down(below, rows[(nearest - slack <= high[rows]) & (farthest + slack >= low[rows])])

    down(tree.root, np.flatnonzero(low <= high))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    edges = lists.offsets.to_numpy()
    edges = edges - edges[0]
    out = np.zeros((len(lists), size), np.int64)
    held = np.diff(edges)
    row = np.repeat(np.arange(len(lists)), held)
    out[row, np.arange(len(flat)) - np.repeat(edges[:-1], held)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < EXACT else a @ b.T


def _prepared(rows: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, numbered, with whole components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = batch.column("vector")
                held = np.diff(lists.offsets.to_numpy())
                values = lists.flatten()
                bad = ~np.isfinite(x := values.to_numpy(zero_copy_only=False).astype(np.float64)) if len(values) else np.zeros(0, bool)
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * x) if len(values) else np.zeros(0)
                bad |= ~(np.abs(x) < WIDEST)
                total = np.append(0, np.cumsum(bad))
                edges = np.append(0, np.cumsum(held))
                good = total[edges[1:]] == total[edges[:-1]]
                kept = pa.array(good)
                spread = np.repeat(good, held)
                ends = np.append(0, np.cumsum(held[good])).astype(np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(x[spread].astype(np.int32)))
                part = batch.filter(kept)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("anchor"), vectors], ["id", "label", "anchor", "vector"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    part = rows.where("id is not null and label is not null and vector is not null").select("id", "label", "anchor", F.col("vector").cast("array<double>").alias("vector"))
    whole = part.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, anchor boolean, vector array<int>")
    return settle(whole.withColumn("row", F.monotonically_increasing_id()))


def _indexed(rows: DataFrame) -> tuple[DataFrame, Tree, int]:
    """Rows with their leaf, the tree with the ranges of all rows, and the length of the longest vector."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size"), F.max(square).alias("square")).first()
    n, size, radius = known["n"], known["size"] or 0, (known["square"] or 0.0) ** 0.5
    most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(size, 1)))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(most).select("vector").toArrow()
    x = _matrix(sample.column("vector"), size).astype(np.float64) if sample.num_rows else np.zeros((0, size))
    tree = fit(x, radius, max(4, TILE * len(x) // max(n, 1)))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = _routed(tree, tree.lift(_matrix(batch.column("vector"), size).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [np.full_like(n.near, np.inf) for n in tree.nodes]
        far = [np.full_like(n.far, -np.inf) for n in tree.nodes]

        def seen(node: Node, j: int, apart: np.ndarray) -> None:
            near[node.number][:, j] = np.minimum(near[node.number][:, j], apart.min(0))
            far[node.number][:, j] = np.maximum(far[node.number][:, j], apart.max(0))

        for batch in batches:
            _routed(tree, tree.lift(_matrix(batch.column("vector"), size).astype(np.float64)), seen)
        found = [(k, i, j, near[k][i, j], far[k][i, j]) for k in range(len(near)) for i, j in zip(*np.nonzero(far[k] >= 0), strict=True)]
        yield pa.RecordBatch.from_pylist([{"node": k, "i": int(i), "j": int(j), "near": a, "far": b} for k, i, j, a, b in found], pa.schema([("node", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("near", pa.float64()), ("far", pa.float64())]))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = settle(rows.mapInArrow(leaves, f"{fields}, leaf long"))
    # As many rows as the tree has pairs of siblings, which the sample bounds.
    for r in placed.select("vector").mapInArrow(ranges, "node int, i int, j int, near double, far double").groupBy("node", "i", "j").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect():
        tree.nodes[r["node"]].near[r["i"], r["j"]], tree.nodes[r["node"]].far[r["i"], r["j"]] = r["near"], r["far"]
    return placed, tree, size


WINDOWS = "array<struct<window:long,low:long,high:long>>"


def _visits(queries: DataFrame, tree: Tree, size: int, first: bool) -> DataFrame:
    """A row for each query and leaf to look into.

    First the leaves beside the query's own; then those that a window's annulus may meet and that were not among them.
    """
    beside: dict[int, list[int]] = {}
    for node in tree.nodes:
        own = [b for b in node.below if not isinstance(b, Node)]
        beside.update({b: own for b in own})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = _matrix(batch.column("vector"), size).astype(np.float64)
                own = _routed(tree, tree.lift(x))
                if first:
                    seeds = [beside.get(int(leaf), [0]) for leaf in own]
                    row, leaf = np.repeat(np.arange(len(own)), [len(s) for s in seeds]), np.array([s for one in seeds for s in one], np.int64)
                else:
                    windows = batch.column("windows")
                    of = np.repeat(np.arange(batch.num_rows), np.diff(windows.offsets.to_numpy()))
                    flat = windows.flatten()
                    low, high = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("low", "high"))
                    square = tree.radius**2 + np.einsum("ij,ij->i", x, x)
                    inner, outer = (np.sqrt(np.maximum(square[of] - 2 * s, 0.0)) for s in (high, low))
                    # An empty window, and one above the largest product there can be, meets nothing.
                    outer = np.where((low <= high) & (square[of] - 2 * low >= -SLACK * tree.radius**2), outer, -1.0)
                    which, leaf = reached(tree, x[of], inner, outer)
                    pairs = np.unique(np.stack([of[which], leaf]), axis=1)
                    row, leaf = pairs
                    fresh = np.array([b not in beside.get(int(own[a]), [0]) for a, b in zip(row, leaf, strict=True)], bool)
                    row, leaf = row[fresh], leaf[fresh]
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf)], [*taken.schema.names, "leaf"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{fields}, leaf long")


def _looked(visits: DataFrame, rows: DataFrame, sizes: DataFrame, same: bool, k: int, size: int) -> DataFrame:
    """The ``k`` best rows of each window in every leaf tile, of the query's label or of other labels.

    A leaf's rows are cut into tiles and its visitors into lots, so a group is bounded however many there are.
    """
    many = visits.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(LOT)).cast("long").alias("lots")).join(sizes, "leaf")
    many = settle(many)
    of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    guests = visits.join(many, "leaf").withColumn("lot", F.pmod(F.xxhash64("query"), F.col("lots"))).withColumn("tile", of("tiles")).drop("lots", "tiles")
    hosts = rows.join(many, "leaf").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles"))).withColumn("lot", of("lots"))
    hosts = hosts.select("leaf", "tile", "lot", "row", "id", "label", "vector")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("id", "ascending"), ("row", "ascending")])
        scores = _products(_matrix(left.column("vector"), size), _matrix(right.column("vector"), size))
        labels = pa.concat_arrays([left.column("label").combine_chunks(), right.column("label").combine_chunks()]).dictionary_encode().indices.to_numpy()
        ids = pa.concat_arrays([left.column("id").combine_chunks(), right.column("id").combine_chunks()]).dictionary_encode().indices.to_numpy()
        n = left.num_rows
        windows = left.column("windows").combine_chunks()
        of_query = np.repeat(np.arange(n), np.diff(windows.offsets.to_numpy()))
        flat = windows.flatten()
        window, low, high = (flat.field(c).to_numpy() for c in ("window", "low", "high"))
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        for at in range(0, len(window), 128):
            w = slice(at, at + 128)
            s = scores[of_query[w]]
            fits = (s >= low[w, None]) & (s <= high[w, None]) & ((labels[of_query[w], None] == labels[None, n:]) == same)
            fits &= ids[of_query[w], None] != ids[None, n:]
            s = np.where(fits, s, LEAST)
            lines = np.arange(len(s))
            for _ in range(min(k, s.shape[1])):
                # Rows ascend by id, and the first of equal scores is taken.
                best = s.argmax(1)
                value = s[lines, best]
                good = value > LEAST
                out.append((of_query[w][good], window[w][good], best[good], value[good]))
                s[lines, best] = LEAST
        query, number, row, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query": left.column("query").take(pa.array(query)), "window": pa.array(number), "row": right.column("row").take(pa.array(row)), "id": right.column("id").take(pa.array(row)), "score": pa.array(score)})

    kind = rows.schema["id"].dataType.simpleString()
    met = guests.groupBy("leaf", "tile", "lot").cogroup(hosts.groupBy("leaf", "tile", "lot"))
    return met.applyInArrow(run, f"query long, window long, row long, id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query", "window").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _searched(queries: DataFrame, rows: DataFrame, sizes: DataFrame, tree: Tree, size: int, same: bool, k: int) -> DataFrame:
    """Exact best ``k`` rows for every window of every query.

    The leaves beside the query's own are looked into first. Where they fill a window, the worst of what they found
    replaces its lower end, and only leaves that meet what is left follow.
    """
    early = settle(_ranked(_looked(_visits(queries, tree, size, True), rows, sizes, same, k, size), k))
    least = early.where(F.col("rank") == k).select("query", "window", F.col("score").alias("least"))
    flat = queries.select("query", F.explode("windows").alias("w")).select("query", "w.window", "w.low", "w.high").join(least, ["query", "window"], "left")
    narrowed = flat.groupBy("query").agg(F.collect_list(F.struct("window", F.coalesce("least", "low").alias("low"), "high")).cast(WINDOWS).alias("windows"))
    late = _looked(_visits(queries.drop("windows").join(narrowed, "query"), tree, size, False), rows, sizes, same, k, size)
    return settle(_ranked(early.drop("rank").unionByName(late), k))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    least_percent: int = 50,
    most_percent: int = 95,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """Rows of other labels that are nearly as similar to an anchor as its positives are, found exactly.

    Components count as ``floor(scale * x)``; a score is the integer inner product with the anchor. An anchor's positives
    are the ``positives`` best other rows of its label. For each of them the best ``negatives`` rows of other labels with
    ``least_percent * p <= 100 * score <= most_percent * p`` (p: the positive's score) are returned: ``anchor_id``,
    ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score`` and ``negative_score``. Equal scores go by the smaller id.

    ``anchor`` is a condition on the columns of ``vectors``. Rows with a null id, label or vector, or with a null or
    non-finite component take no part, nor do those with a component of 2**23 or more once scaled. A shorter
    vector counts as filled up with zeros. Rows that repeat an id are rows of their own, but no row of the anchor's id
    is its positive or negative. Other columns are not looked at; an empty table gives an empty result.
    """
    rows = _prepared(
        vectors.select(vectors[id_column].alias("id"), vectors[label_column].alias("label"), vectors[vector_column].alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")), scale
    )
    rows, tree, size = _indexed(rows)
    sizes = settle(rows.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("long").alias("tiles")))
    chosen = rows.where("anchor").select(F.col("row").alias("query"), "id", "label", "vector")
    whole = F.array(F.struct(F.lit(0).alias("window"), F.lit(LEAST + 1).alias("low"), F.lit(MOST).alias("high"))).cast(WINDOWS)
    near = _searched(chosen.withColumn("windows", whole), rows, sizes, tree, size, True, positives)
    score = F.col("score")
    ends = near.select("query", "rank", _ceiling(F.lit(least_percent) * score).alias("low"), _floor(F.lit(most_percent) * score).alias("high"))
    windows = ends.where("low <= high").groupBy("query").agg(F.collect_list(F.struct(F.col("rank").cast("long").alias("window"), "low", "high")).cast(WINDOWS).alias("windows"))
    far = _searched(chosen.join(windows, "query"), rows, sizes, tree, size, False, negatives)
    good = near.select("query", F.col("rank").cast("long").alias("window"), F.col("id").alias("positive_id"), score.alias("positive_score"))
    out = far.join(good, ["query", "window"]).join(chosen.select("query", F.col("id").alias("anchor_id")), "query")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", score.alias("negative_score"))


def _floor(x: Column) -> Column:
    """A hundredth of a long, rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _ceiling(x: Column) -> Column:
    return -_floor(-x)
