"""Quality by repetition: how much of a text lies inside n-grams and lines that it repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tactus.llm import spans

#: Largest share of characters inside repeated n-grams, for each n, and inside repeated lines.
MOST_IN_GRAMS = {5: 0.20, 7: 0.18, 10: 0.15}
MOST_IN_LINES = 0.20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _measure(block: spans.Block, most_in_grams: dict[int, float], most_in_lines: float) -> dict[str, np.ndarray]:
    data, docs = block.data, block.docs
    ink = ~spans.SPACE[data]
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ink & ((data & 0xC0) != 0x80), out=points[1:])
    chars = points[block.edges[1:]] - points[block.edges[:-1]]
    start, end, doc = block.words()
    letters = points[end] - points[start]
    hashes = block.hashes(start, end)
    n_words = np.bincount(doc, minlength=docs)
    salt = spans.mixed(np.arange(1, docs + 1, dtype=np.uint64))
    covered: dict[int, np.ndarray] = {}
    for n in sorted({5, *most_in_grams}):
        keys, at = spans.grams(hashes, doc, n)
        at = at[spans.repeated(keys ^ salt[doc[at]])]
        edge = np.zeros(len(start) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        covered[n] = np.cumsum(edge[:-1]) > 0
    repeat_words = np.bincount(doc[covered[5]], minlength=docs)
    share = {n: np.bincount(doc[c], weights=letters[c], minlength=docs) / np.maximum(chars, 1) for n, c in covered.items()}

    lo, hi, of = block.lines()
    inked = points[hi] > points[lo]
    lo, hi, of = lo[inked], hi[inked], of[inked]
    keys = block.hashes(lo, hi) ^ salt[of]
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    again = ~first
    dup_lines = np.bincount(of[again], minlength=docs)
    in_lines = np.bincount(of[again], weights=(points[hi] - points[lo])[again], minlength=docs) / np.maximum(chars, 1)

    failed = (n_words < 10) | (100 * repeat_words > 20 * n_words)
    too_much = in_lines > most_in_lines
    for n, most in most_in_grams.items():
        too_much |= share[n] > most
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": block.sums(SYMBOLS[data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": ~failed & ~too_much,
        **{f"share_{n}": share[n] for n in most_in_grams},
        "share_lines": in_lines,
    }


def repetition(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    most_in_grams: dict[int, float] | None = None,
    most_in_lines: float = MOST_IN_LINES,
) -> DataFrame:
    """Repetition measures and a verdict for each row.

    Words are runs of characters other than ASCII white space. Rolling 64-bit hashes find, for each
    n-gram length in ``most_in_grams``, the n-grams that a text holds twice or more; ``share_<n>`` is
    the share of the text's word characters inside them (first occurrences included), and
    ``share_lines`` the share inside lines that equal an earlier line. ``kept`` is false where the
    base rules fail (under 10 words, or over a fifth of the words inside repeated 5-word windows) or
    where a share passes its limit.

    Rows are measured one by one without a shuffle: repeated rows and null ids stay as they are, and
    other columns are not looked at. A null text counts as an empty one: zeros, and not kept. An
    empty table gives an empty result. Memory is bounded by ``spans.BLOCK_BYTES`` or one text.
    """
    limits = dict(MOST_IN_GRAMS if most_in_grams is None else most_in_grams)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in spans.blocks(batches, "text"):
            found = _measure(block, limits, most_in_lines)
            arrays = [batch.column(0), *(pa.array(v if v.dtype != np.dtype(int) else v.astype(np.int64)) for v in found.values())]
            yield pa.RecordBatch.from_arrays(arrays, [id_column, *found])

    shares = "".join(f", share_{n} double" for n in limits)
    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(
        run,
        f"`{id_column}` {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        f"base_failed boolean, kept boolean{shares}, share_lines double",
    )
