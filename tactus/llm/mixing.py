"""Mix sources to target weights: temperature, exponent search, budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm import ranks
from tactus.llm.shared import settle

WORDS = r"[^\x20\x09-\x0D]+"
#: Exponents tried in one pass over the sources, and passes; each pass narrows the range 32 times.
GRID, PASSES = 33, 5
AXIS = 1 << 31


def _axis(*of: Column) -> Column:
    """A number from 0 to 2**31 - 1 spread evenly."""
    return F.pmod(F.xxhash64(*of), F.lit(AXIS))


def _search(sources: DataFrame, holds, rising: bool) -> float:
    """Bisect the exponent in 0 to 1 where ``holds`` turns, with sums over sources as the only input.

    ``holds(z, h, top, low)`` gets, for an exponent a, the sum of p**a, the sum of p**a * ln(p**a), and
    the largest and smallest p. Returns the largest exponent that holds (``rising``: the smallest).
    """
    lo, hi = 0.0, 1.0
    p = F.col("share")
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * i / (GRID - 1) for i in range(GRID)]
        sums = [x for i, a in enumerate(grid) for x in (F.sum(F.pow(p, a)).alias(f"z{i}"), F.sum(F.pow(p, a) * F.log(p) * a).alias(f"h{i}"))]
        row = sources.agg(F.max(p).alias("top"), F.min(p).alias("low"), *sums).first()
        good = [holds(row[f"z{i}"], row[f"h{i}"], row["top"], row["low"], a) for i, a in enumerate(grid)]
        if rising:
            at = next((i for i, g in enumerate(good) if g), GRID - 1)
            lo, hi = grid[max(0, at - 1)], grid[at]
        else:
            at = next((i for i in reversed(range(GRID)) if good[i]), 0)
            lo, hi = grid[at], grid[min(GRID - 1, at + 1)]
    return hi if rising else lo


def exponent(sources: DataFrame, target_entropy: float, most_epochs: float, budget: float | None = None) -> float:
    """The exponent for shares p of the sources, weights being p**a over their sum.

    The largest exponent whose weights reach ``target_entropy`` times the entropy of equal weights;
    but no smaller than the least one at which no source repeats over ``most_epochs`` times when
    ``budget`` times all tokens are drawn (None: as many as it takes to draw every source once).
    """
    n = sources.count()
    if n < 2:
        return 1.0
    even = _search(sources, lambda z, h, top, low, a: math.log(z) - h / z >= target_entropy * math.log(n), rising=False)

    def fits(z: float, h: float, top: float, low: float, a: float) -> bool:
        drawn = top ** (1 - a) * z if budget is None else budget
        return drawn * low ** (a - 1) / z <= most_epochs * (1 + 1e-12)

    return max(even, _search(sources, fits, rising=True))


def mix(
    docs: DataFrame,
    target_entropy: float = 0.95,
    most_epochs: float = 4.0,
    budget_tokens: int | None = None,
    block_tokens: int = 1 << 15,
    seed: int = 1,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """The documents drawn from each source, in an order with the target weights throughout.

    Tokens are words. Sources get weights in proportion to a power of their token shares; ``exponent``
    finds the power. A source's budget is its weight times ``budget_tokens`` (None: the least total
    at which every source is drawn whole, so nothing is left out), rounded. It is met by whole epochs
    and a part of another; in each epoch the source's blocks of about ``block_tokens`` stand in an
    order of their own, and so do the documents in a block. A document is drawn in the last epoch if
    it starts before the budget ends.

    One row per drawn document and epoch: ``start`` counts the source's tokens before it, and
    ``place`` is that over the budget, so any beginning of the rows ordered by ``place`` has the target
    weights. Rows are drawn one by one: repeated rows and null ids stay rows of their own, and a null
    source is a source. Null or empty texts have no tokens and are drawn with their source; a source
    without any tokens is drawn once. Other columns are not looked at. No rows give no rows.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    rows = settle(
        docs.select(
            docs[id_column].alias("doc_id"),
            docs[source_column].alias("source"),
            F.xxhash64(text).alias("text_hash"),
            F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_tokens"),
        )
    )
    sizes = settle(rows.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("rows")))
    total = sizes.agg(F.sum("size").alias("t"), F.sum("rows").alias("n")).first()
    all_tokens = float(total["t"] or 0)
    shares = sizes.where("size > 0").withColumn("share", F.col("size") / F.lit(max(all_tokens, 1.0)))
    budget = None if budget_tokens is None else budget_tokens / max(all_tokens, 1.0)
    power = exponent(shares, target_entropy, most_epochs, budget) if all_tokens else 1.0
    sums = shares.agg(F.sum(F.pow("share", F.lit(power))).alias("z"), F.max("share").alias("top")).first()
    z, top = sums["z"] or 1.0, sums["top"] or 1.0
    drawn = all_tokens * (top ** (1 - power) * z if budget is None else budget)

    weight = F.when(F.col("size") > 0, F.pow(F.col("size") / F.lit(max(all_tokens, 1.0)), F.lit(power)) / F.lit(z)).otherwise(0.0)
    plan = sizes.select(
        F.col("source").alias("__source"), "size", F.col("rows").alias("held"), weight.alias("weight"), F.round(weight * F.lit(drawn)).cast("long").alias("budget")
    )
    plan = plan.withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(1))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size")).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(block_tokens))))
    dealt = rows.join(plan, rows["source"].eqNullSafe(plan["__source"])).drop("__source")
    last = F.when(F.col("rest") > 0, F.col("epochs")).otherwise(F.col("epochs") - 1).cast("int")
    dealt = dealt.where(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    block = (_axis(F.lit(seed), F.col("doc_id"), F.col("text_hash")) % F.col("blocks")).cast("long")
    dealt = dealt.withColumn("block", block)
    dealt = dealt.withColumns(
        {
            "__at": _axis(F.lit(seed), F.col("epoch"), F.col("source"), F.col("block")),
            "__in": F.xxhash64(F.lit(seed), F.col("epoch"), F.col("doc_id"), F.col("text_hash")),
        }
    )
    segments = ranks.segments_for(total["n"] or 0)
    dealt = ranks.running(
        dealt, ["source", "epoch"], ["__at", "block", "__in", "doc_id", "text_hash"], segments, "before", F.col("n_tokens"), F.col("__at")
    )
    dealt = dealt.where((F.col("epoch") < F.col("epochs")) | (F.col("before") < F.col("rest")))
    start = F.col("epoch") * F.col("size") + F.col("before")
    return dealt.select(
        F.col("doc_id").alias(id_column),
        F.col("source").alias(source_column),
        "text_hash",
        "epoch",
        "block",
        "n_tokens",
        start.alias("start"),
        "weight",
        "budget",
        (start / F.greatest(F.col("budget"), F.lit(1))).alias("place"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as ``mix`` draws it, and none of its columns changed.

    Rows that are equal in id, source and text share their draws evenly.
    """
    drawn = mix(docs, **options)
    id_column, source_column = options.get("id_column", "doc_id"), options.get("source_column", "source")
    text_column = options.get("text_column", "text")
    counts = drawn.groupBy(
        drawn[id_column].alias("__id"), drawn[source_column].alias("__source"), drawn["text_hash"].alias("__hash")
    ).agg(F.count(F.lit(1)).alias("__draws"), F.sum((F.col("epoch") == 0).cast("long")).alias("__rows"))
    here = docs.select(
        *[docs[c] for c in docs.columns],
        F.xxhash64(docs[id_column], docs[source_column], F.xxhash64(F.coalesce(docs[text_column], F.lit("")))).alias("__key"),
    )
    counts = counts.select(F.xxhash64("__id", "__source", "__hash").alias("__key"), "__draws", "__rows")
    counts = counts.groupBy("__key").agg(F.sum("__draws").alias("__draws"), F.sum("__rows").alias("__rows"))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    found = here.withColumn("__nth", nth).join(counts, "__key")
    times = F.floor(F.col("__draws") / F.col("__rows")) + (F.col("__nth") <= F.col("__draws") % F.col("__rows")).cast("long")
    times = F.when(F.col("__nth") <= F.col("__rows"), times).otherwise(0)
    found = found.withColumn("__times", times.cast("int")).where("__times > 0")
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
