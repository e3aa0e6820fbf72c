"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A term t of weight w has, for each of a number of samples, two independent exponential variables E1 and
E2 (whose sum is a gamma variable r, and whose share E1/r is uniform) and a second gamma variable c, all
derived from hashes of the term and the sample. The term's level is y = floor((ln w + E1) / r), its rank
a = c * exp(-E2 - r * y), and a text's sample is the term and level of least rank. Two texts pick the same one with
probability sum(min(w)) / sum(max(w)), the generalised Jaccard similarity of their weights. The rank is a
function of term, sample and level, so equal samples are found by equal ranks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 64
#: Segments of the ordered ids for each shuffle partition.
SEGMENTS = 4
SEPARATOR = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1


def term_weights(text: Column) -> Column:
    """Array of (t, w): hash and number of occurrences of each word of the text, A-Z as a-z."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, SEPARATOR), lambda w: w != "")
    # Equal hashes stand together once sorted; a term is read off where its run ends.
    return _named(F.sort_array(F.transform(words, lambda w: F.xxhash64(w))), _runs)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value being worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _runs(ids: Column) -> Column:
    # get() counts from 0, so the element after place i, counted from 1, is get(ids, i).
    ends = F.filter(F.transform(ids, lambda x, i: i + 1), lambda i: (i == F.size(ids)) | (F.get(ids, i - 1) != F.get(ids, i)))
    return _named(ends, lambda e: F.transform(e, lambda end, k: F.struct(
        F.get(ids, end - 1).alias("t"), (end - F.when(k > 0, F.get(e, k - 1)).otherwise(0)).alias("w"))))


def _uniform(bits: Column) -> Column:
    return (bits.cast("double") + 0.5) / float(1 << 32)


def _halves(term: Column, salt: int) -> tuple[Column, Column]:
    h = F.xxhash64(term, F.lit(salt))
    return _uniform(F.shiftrightunsigned(h, 32)), _uniform(h.bitwiseAND(F.lit((1 << 32) - 1)))


def rank(term: Column, weight: Column, sample: int) -> Column:
    """The term's rank a in a sample, for a weight of 1 or more."""
    u1, u2 = _halves(term, 2 * sample)
    u3, u4 = _halves(term, 2 * sample + 1)
    first = -F.ln(u3 * u4) * u2
    # Below 1 / w the level is 0, always so for weight 1.
    level = F.floor((F.ln(weight) - F.ln(u1)) / -F.ln(u1 * u2))
    return F.when(u2 * weight < 1.0, first).otherwise(first * F.pow(u1 * u2, level))


def signed(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``codes`` for each distinct value of ``keys``: 16 bits of each sample, of rows with ``t`` and ``w``.

    A text without words comes as one row of nulls; its codes are the hash of null.
    """
    least = terms.groupBy(*keys).agg(*[F.min(rank(F.col("t"), F.col("w"), k)).alias(f"__a{k}") for k in range(samples)])
    codes = F.array(*[F.xxhash64(f"__a{k}").bitwiseAND(F.lit(0xFFFF)).cast("int") for k in range(samples)])
    return least.select(*keys, codes.alias("codes"))


def printed(codes: Column) -> Column:
    """A fingerprint as lowercase hex, four digits a sample."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def _at_most(bounds: list[int], x: Column, strictly: bool) -> Column:
    """How many of the sorted bounds are smaller than ``x`` (or equal), found in blocks of about the root of their number."""
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = (lambda b: b < x) if strictly else (lambda b: b <= x)
    of = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    block = F.size(F.filter(of([b[0] for b in blocks]), below)) - 1
    inside = F.size(F.filter(F.get(F.array(*[of(b) for b in blocks]), block), below))
    return F.when(block < 0, F.lit(0)).otherwise(block * step + inside)


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents in segments of descending ids, each with the text of the one that follows.

    Columns: ``segment`` and ``place`` in it, ``id``, ``text``, ``next`` (after the last the first), and ``guest``:
    each segment ends with a copy of the row that opens the next one, by which its own last row is served.
    Nulls among the ids come last, texts that share an id in the order of their hashes. Null texts are empty.

    Segments are cut at approximate quantiles of the ids; an id that holds several quantiles is cut again by the
    hash of the text. Rows that are equal in both stay in one segment.
    """
    number = docs[id_column].cast("long")
    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(
        docs[id_column].alias("id"), text.alias("text"), F.coalesce(F.bitwise_not(number), F.lit(LAST)).alias("o"), F.xxhash64(text).alias("h")
    )
    parts = SEGMENTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("o", [i / parts for i in range(1, parts)], 10 * parts)
    bounds = sorted(rows.agg(cuts.alias("cuts")).first()["cuts"] or [0])
    under, upto = _at_most(bounds, F.col("o"), True), _at_most(bounds, F.col("o"), False)
    unit = F.col("h") / float(1 << 64) + 0.5
    rows = rows.withColumns({"__under": under, "__held": upto - under})
    within = F.least(F.floor(unit * F.col("__held")), F.col("__held") - 1).cast("int")
    rows = rows.withColumn("segment", F.col("__under") + F.greatest(within, F.lit(0))).drop("__under", "__held")
    # One row for each segment, of which there are at most as many as cuts and one.
    tops = sorted((r["segment"], r["top"]["o"], r["top"]["h"]) for r in rows.groupBy("segment").agg(F.min(F.struct("o", "h")).alias("top")).collect())
    before = {s: (tops[i - 1][0], int(i == 0)) for i, (s, _, _) in enumerate(tops)}
    known = {s: (o, h) for s, o, h in tops}
    served = [F.struct(*[F.lit(v).cast("long") for v in (*known.get(s, (None, None)), *before.get(s, (None, None)))]) for s in range(parts)]
    top = F.get(F.array(*[x.cast("struct<o:long,h:long,to:long,lap:long>") for x in served]), F.col("segment"))
    home = F.struct(F.col("segment").cast("long").alias("segment"), F.lit(0).cast("long").alias("lap"), F.lit(False).alias("guest"))
    guest = F.when((F.col("__top.o") == F.col("o")) & (F.col("__top.h") == F.col("h")), F.struct(F.col("__top.to").alias("segment"), F.col("__top.lap").alias("lap"), F.lit(True).alias("guest")))
    rows = rows.withColumn("__top", top).withColumn("__at", F.explode(F.filter(F.array(home, guest), lambda x: x.isNotNull())))
    placed = rows.select(F.col("__at.segment").alias("segment"), "__at.lap", "__at.guest", "o", "h", "id", "text").repartition("segment")
    along = Window.partitionBy("segment").orderBy("lap", "o", "guest", "h")
    return placed.select("segment", F.row_number().over(along).alias("place"), "guest", "id", "text", F.coalesce(F.lead("text").over(along), F.lit("")).alias("next"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id and ``fingerprint``, four hex digits a sample.

    Weights are numbers of occurrences of words. Null and empty texts and those of white space alone share one
    fingerprint, equal texts have equal ones. Ids may be null or repeated: rows are told apart by id and text, and
    rows equal in both come out once. An empty table gives an empty result.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(docs[id_column].alias(id_column), F.sha2(text, 256).alias("__text"), F.explode_outer(term_weights(text)).alias("x"))
    found = signed(rows.select(id_column, "__text", "x.t", "x.w"), [id_column, "__text"], samples)
    return found.select(id_column, printed(F.col("codes")).alias("fingerprint"))


def edited_likeness(docs: DataFrame, samples: int = SAMPLES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and those of the next document are.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as many of the next
    document's text (all, if that is shorter), in descending order of the ids, the last one's next being the first.
    One row per input row: the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``
    and ``near_next`` (0 to 1). A null text is an empty one; texts without words are wholly alike to one another. Null ids come
    last, repeated ids in the order of their texts' hashes. A single document is its own next. Other columns are not looked at.

    Texts move once, to the segment of their id. All that follows - next text, terms, samples, likeness - happens there.
    """
    rows = with_next(docs, id_column, text_column)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    rows = rows.select("segment", "place", "guest", "id", F.length("text").cast("long").alias("n_chars"), "text", F.when(~F.col("guest"), edited).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.coalesce("edited", F.lit("")), 256))
    # Guests only lend their own fingerprint.
    texts = F.filter(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))), lambda x: x["text"].isNotNull())
    keys = ["segment", "place", "which", "guest", "id", "n_chars", "edited_sha256"]
    rows = rows.withColumn("x", F.explode(texts)).select(*[k for k in keys if k != "which"], "x.which", F.col("x.text").alias("text"))
    terms = rows.select(*keys, F.explode_outer(term_weights(F.col("text"))).alias("x")).select(*keys, "x.t", "x.w")
    codes = signed(terms, keys, samples)
    # A document's two rows stand next to each other, and the next document's first row after them.
    along = Window.partitionBy("segment").orderBy("place", "which")
    codes = codes.withColumns({"edited": F.lead("codes", 1).over(along), "next": F.lead("codes", 2).over(along)})
    codes = codes.where((F.col("which") == 0) & ~F.col("guest"))
    return codes.select(
        F.col("id").alias(id_column),
        "n_chars",
        "edited_sha256",
        printed(F.col("codes")).alias("fingerprint"),
        printed(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next")).alias("near_next"),
    )
