"""Near duplicates among embeddings by a subspace pigeonhole join.

Unit vectors are rotated and cut into low-dimensional blocks. Two vectors within squared distance D
are within D times the block's share in at least one block, shares adding up to one; so the blocks are
range-joined one by one, on a grid with cells as wide as the block's radius, and what any block
finds is verified by the exact cosine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.components import components
from tactus.llm.shared import settle

BLOCK = 8
#: Of two neighbouring cells one looks into the other; a cell also looks into itself.
LOOKS = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))
#: Rows of a tile, about.
TILE = 1500
#: Added to squared budgets, far above rounding errors and far below distances that matter.
SLACK = 1e-9


@cache
def rotation(size: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _prepared(vectors: DataFrame) -> DataFrame:
    """Per row a digest of label and vector (null where it can link with nothing), the vector and its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys, kept, blocks = [], [], []
                for label, vector in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                    x = np.array([np.nan if v is None else v for v in vector or ()], np.float64)
                    norm = np.linalg.norm(x)
                    if label is None or not np.isfinite(norm) or not norm:
                        keys.append(None), kept.append(None), blocks.append(None)
                        continue
                    keys.append(hashlib.blake2b(repr(label).encode() + b"/" + x.tobytes(), digest_size=16).digest())
                    kept.append(x)
                    turned = (x / norm) @ rotation(len(x))
                    turned = np.concatenate([turned, np.zeros(-len(x) % BLOCK)])
                    blocks.append([{"block": i, "x": b} for i, b in enumerate(turned.reshape(-1, BLOCK))])
                kind = pa.list_(pa.struct([("block", pa.int32()), ("x", pa.list_(pa.float64()))]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(["vec_id", "label"]).columns, pa.array(keys, pa.binary()), pa.array(kept, pa.list_(pa.float64())), pa.array(blocks, kind)],
                    ["vec_id", "label", "key", "vector", "blocks"],
                )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(
        run, f"vec_id long, label {label}, key binary, vector array<double>, blocks array<struct<block:int,x:array<double>>>"
    )


def _linked(cells: DataFrame, least_cosine: float) -> DataFrame:
    """Pairs of keys that are close in a block of theirs and similar as a whole.

    Rows meet in the cells of their blocks. A cell with many rows is cut into tiles, so that a group
    holds at most a pair of tiles however many vectors lie close together.
    """
    cell = ["label", "size", "block", "c0", "c1"]
    looks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in LOOKS]))
    there = cells.withColumn("look", looks)
    there = there.withColumns({"c0": F.col("c0") + F.col("look.i"), "c1": F.col("c1") + F.col("look.j"), "guest": (F.col("look.i") != 0) | (F.col("look.j") != 0)})
    # Of a cell's own rows each is compared with the later ones, so they stand on both sides.
    hosts = cells.withColumn("side", F.lit(0)).withColumn("guest", F.lit(False))
    both = hosts.unionByName(there.drop("look").withColumn("side", F.lit(1)))
    held = both.groupBy(*cell).agg(*[F.ceil(F.sum((F.col("side") == s).cast("long")) / F.lit(TILE)).cast("int").alias(f"tiles_{s}") for s in (0, 1)])
    both = both.join(held.where("tiles_0 > 0"), cell)
    spread = F.xxhash64("key")
    mine = F.pmod(spread, F.when(F.col("side") == 0, F.col("tiles_0")).otherwise(F.col("tiles_1"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("tiles_1")).otherwise(F.col("tiles_0")) - 1))
    both = both.withColumn("mine", mine).withColumn("other", other)
    both = both.withColumns({"t0": F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other")), "t1": F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine"))})

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        guest = table.column("guest").to_numpy()
        keys = np.array(table.column("key").to_pylist(), object)
        size, block, budget = (table.column(c)[0].as_py() for c in ("size", "block", "budget"))
        x = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, size)
        norm = np.linalg.norm(x, axis=1)
        part = (x / norm[:, None]) @ rotation(size)[:, block * BLOCK : (block + 1) * BLOCK]
        hosts, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = [], []
        square = (part**2).sum(1)
        for i in range(0, len(hosts), 256):
            h = hosts[i : i + 256]
            apart = square[h][:, None] + square[others][None, :] - 2 * part[h] @ part[others].T
            at, to = np.nonzero(apart <= budget + SLACK)
            a, b = h[at], others[to]
            fresh = guest[b] | (keys[a] < keys[b])
            a, b = a[fresh], b[fresh]
            for k in range(0, len(a), 20_000):
                u, v = a[k : k + 20_000], b[k : k + 20_000]
                good = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= least_cosine
                left.append(u[good])
                right.append(v[good])
        none = np.zeros(0, np.int64)
        a, b = keys[np.concatenate([none, *left])], keys[np.concatenate([none, *right])]
        swap = a > b
        return pa.table({"a": pa.array(np.where(swap, b, a), pa.binary()), "b": pa.array(np.where(swap, a, b), pa.binary())})

    columns = ["side", "guest", "key", "size", "block", "budget", "vector"]
    return both.select(*cell, "t0", "t1", *[c for c in columns if c not in cell]).groupBy(*cell, "t0", "t1").applyInArrow(run, "a binary, b binary")


def vector_join(
    vectors: DataFrame,
    least_cosine: float = 0.93,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """Links between vectors of one label with a cosine of ``least_cosine`` or more, exactly.

    One row per input row: ``n_links`` other vectors linked directly, ``component_id`` the smallest id
    reachable, ``kept`` whether that is the row's own. Equal vectors of a label are one class and are
    compared once. Vectors of different lengths are not compared.

    A vector that is null, empty, zero or holds a null or non-finite component, or whose label is
    null, links with nothing. A null id takes no part either: no links, no component, not kept. Rows
    that repeat an id are vectors of their own for the counts. Other columns are not looked at. An
    empty table gives an empty result.
    """
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[label_column].alias("label"), vectors[vector_column].alias("vector"))
    rows = settle(_prepared(rows))
    ids = rows.where("vec_id is not null and key is not null")
    classes = settle(ids.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("held"), F.first(F.struct("label", "vector", "blocks")).alias("v")))
    one = classes.select("key", "v.label", "v.vector", F.explode("v.blocks").alias("b"))
    one = one.withColumn("size", F.size("vector")).withColumn("x", F.col("b.x")).withColumn("block", F.col("b.block"))
    squares = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    energy = one.groupBy("size", "block").agg(F.avg(squares).alias("energy"))
    total = energy.groupBy("size").agg(F.sum("energy").alias("all"))
    far = 2.0 - 2.0 * least_cosine
    budgets = energy.join(total, "size").select("size", "block", (F.lit(far) * F.col("energy") / F.col("all") * (1 + SLACK) + SLACK).alias("budget"))
    cells = one.join(budgets, ["size", "block"])
    cells = cells.select("label", "size", "block", "budget", *[F.floor(F.col("x")[i] / F.sqrt("budget")).alias(f"c{i}") for i in (0, 1)], "key", "vector")
    links = _linked(cells, least_cosine).distinct()
    named = classes.select("key", "rep", "held")
    ends = links.join(named.select(F.col("key").alias("a"), F.col("rep").alias("ra"), F.col("held").alias("ha")), "a")
    ends = settle(ends.join(named.select(F.col("key").alias("b"), F.col("rep").alias("rb"), F.col("held").alias("hb")), "b"))
    both = ends.select(F.col("a").alias("key"), F.col("hb").alias("n")).unionByName(ends.select(F.col("b").alias("key"), F.col("ha").alias("n")))
    degrees = both.groupBy("key").agg(F.sum("n").alias("others"))
    # An id may come with several vectors: its classes are one node.
    found = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    per_class = named.join(degrees, "key", "left").join(found, F.col("rep") == F.col("node"), "left")
    per_class = per_class.select("key", (F.coalesce("others", F.lit(0)) + F.col("held") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(per_class, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        F.col("vec_id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
