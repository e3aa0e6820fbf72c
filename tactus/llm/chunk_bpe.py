"""Byte-level BPE by content-defined chunks: shared chunks are encoded once, joins are repaired.

Texts are cut where a rolling hash of the last bytes says so, so equal passages fall into equal
chunks. Chunks that occur twice or more are encoded by one of their owners and joined to the others;
the rest of a text is encoded where it is. A join may split what the tokenizer keeps together, so
the text around it is encoded again, from a place where both sides certainly begin a token to another.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm import spans
from tactus.llm.shared import settle

#: Bytes that the rolling hash sees, mean and least bytes of a chunk.
WINDOW, MEAN, LEAST = 16, 1024, 128
# Fixed value: how byte-level BPE splits a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank between two ASCII letters: a token ends before it whatever surrounds the three.
SURE = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


class Codec:
    """Encoder and decoder for a tokenizer file of the byte-level kind."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        # Bytes that print stand for themselves, the others for the code points from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {x["content"]: x["id"] for x in content["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()

    def encode(self, text: str) -> np.ndarray:
        try:
            ids = self.fast.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:  # its pattern gives up on very long runs of white space
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@cache
def _codec(path: str) -> Codec:
    return Codec(path)


def _cuts(block: spans.Block) -> list[list[int]]:
    """For each text the byte offsets, in it, where its chunks begin and the last one ends."""
    data, edges = block.data, block.edges
    found = np.zeros(0, np.int64)
    if len(data) > WINDOW:
        at = np.arange(WINDOW, len(data))
        key = block.hashes(at - WINDOW, at)
        found = at[(key & np.uint64(MEAN - 1)) == 0]
        found = found[(data[found] & 0xC0) != 0x80]
    out = []
    first = np.searchsorted(found, edges[:-1] + WINDOW)
    last = np.searchsorted(found, edges[1:])
    for i in range(block.docs):
        start, end = int(edges[i]), int(edges[i + 1])
        cuts, before = [0], start
        for p in found[first[i] : last[i]].tolist():
            if p - before >= LEAST and end - p >= LEAST:
                cuts.append(p - start)
                before = p
        if end > start:
            cuts.append(end - start)
        out.append(cuts)
    return out


def _bytes(block: spans.Block) -> list[bytes]:
    raw = block.data.tobytes()
    return [raw[a:b] for a, b in zip(block.edges[:-1].tolist(), block.edges[1:].tolist(), strict=True)]


def assembled(codec: Codec, text: bytes, cuts: list[int], known: dict[int, np.ndarray]) -> np.ndarray:
    """The ids of a text whose chunks ``known`` are encoded already, exactly as if encoded whole."""
    parts: list[tuple[int, np.ndarray]] = []  # (first byte, ids), exact for all bytes so far
    upto, i, chunks = 0, 0, len(cuts) - 1
    while i < chunks:
        if i in known:
            end, ids = cuts[i + 1], known[i]
            i += 1
        else:
            while i < chunks and i not in known:
                i += 1
            end = cuts[i]
            ids = codec.encode(text[upto:end].decode())
        if parts:
            ids = _repaired(codec, text, parts, upto, end, ids)
        else:
            parts.append((upto, ids))
        upto = end
    return np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int32)


def _repaired(codec: Codec, text: bytes, parts: list[tuple[int, np.ndarray]], at: int, end: int, ids: np.ndarray) -> np.ndarray:
    """Add the ids of ``text[at:end]`` to ``parts``, with the ids around ``at`` made anew.

    Both sides are cut at a sure place; where the ids of a side do not end a token there, the window
    grows to the next one.
    """
    left = at
    while True:
        left = _sure_before(text, left, at)
        while left < parts[-1][0]:  # the part before it ends at a sure place inside
            start, own = parts.pop()
            parts[-1] = (parts[-1][0], np.concatenate([parts[-1][1], own]))
        start, own = parts[-1]
        ends = start + np.cumsum(codec.lengths[own])
        keep = int(np.searchsorted(ends, left, "right"))
        if left == start or (keep and ends[keep - 1] == left):
            break
    parts[-1] = (start, own[:keep] if left > start else own[:0])
    ends = at + np.cumsum(codec.lengths[ids])
    right = at
    while True:
        match = SURE.search(text, right + 1, end)
        right = match.start() if match else end
        drop = int(np.searchsorted(ends, right, "right"))
        if right == end or (drop and ends[drop - 1] == right):
            break
    parts.append((left, codec.encode(text[left:right].decode())))
    if right < end:
        parts.append((right, ids[drop:]))
    return ids


def _sure_before(text: bytes, before: int, at: int) -> int:
    """The last sure place before ``before`` whose next letter is before ``at``, or 0."""
    reach = 64
    while True:
        low = max(0, before - reach)
        found = [m.start() for m in SURE.finditer(text, low, at) if m.start() < before]
        if found or not low:
            return found[-1] if found else 0
        reach *= 4


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``text_key`` and ``ids`` (little-endian unsigned 32-bit integers) of every different text.

    ``text_key(column)`` of a row finds its ids. The ids are those of the tokenizer file's library
    without added special tokens; such tokens in a text count as themselves. A null text counts as an
    empty one without ids. Repeated rows and rows with a null id are texts like any other; other
    columns are not looked at; an empty table gives an empty result.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(docs[id_column].cast("string").alias("id"), text.alias("text"), text_key(docs[text_column]).alias("text_key"))
    row_key = F.unhex(F.md5(F.concat_ws("/", F.hex("text_key"), F.coalesce("id", F.lit(""))).cast("binary")))
    rows = rows.select(row_key.alias("row_key"), "text_key", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in spans.blocks(batches, "text"):
            keys = []
            for raw, cuts in zip(_bytes(block), _cuts(block), strict=True):
                keys.append([hashlib.blake2b(raw[a:b], digest_size=12).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.select(["row_key", "text_key"]).columns, pa.array(keys, pa.list_(pa.binary()))], ["row_key", "text_key", "chunks"])

    def encode_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer)
        for batch, block in spans.blocks(batches, "text"):
            names, ids = [], []
            for raw, cuts, wanted in zip(_bytes(block), _cuts(block), batch.column("wanted").to_pylist(), strict=True):
                for x in wanted:
                    names.append(x["chunk"])
                    ids.append(codec.encode(raw[cuts[x["nth"]] : cuts[x["nth"] + 1]].decode()).astype("<u2" if codec.size <= 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "ids"])

    def encode_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer)
        kind = "<u2" if codec.size <= 1 << 16 else "<u4"
        for batch, block in spans.blocks(batches, "text"):
            out = []
            for raw, cuts, uses in zip(_bytes(block), _cuts(block), batch.column("uses").to_pylist(), strict=True):
                known = {x["nth"]: np.frombuffer(x["ids"], kind).astype(np.int32) for x in uses or ()}
                out.append(assembled(codec, raw, cuts, known).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(out, pa.binary())], ["text_key", "ids"])

    cuts = rows.mapInArrow(cut, "row_key binary, text_key binary, chunks array<binary>")
    # One row speaks for all rows with its text.
    texts = settle(cuts.groupBy("text_key").agg(F.min("row_key").alias("row_key"), F.first("chunks").alias("chunks")))
    pieces = texts.select("row_key", F.posexplode("chunks").alias("nth", "chunk"))
    shared = pieces.groupBy("chunk").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row_key", "nth")).alias("owner")).where("times > 1")
    wanted = shared.groupBy("owner.row_key").agg(F.collect_list(F.struct(F.col("owner.nth").alias("nth"), "chunk")).alias("wanted"))  # of one text
    bodies = rows.select("row_key", "text")
    encoded = bodies.join(wanted, "row_key").mapInArrow(encode_shared, "chunk binary, ids binary").dropDuplicates(["chunk"])
    uses = pieces.join(encoded, "chunk").groupBy("row_key").agg(F.collect_list(F.struct("nth", "ids")).alias("uses"))  # of one text
    every = texts.select("row_key", "text_key").join(uses, "row_key", "left")
    return bodies.join(every, "row_key").mapInArrow(encode_texts, "text_key binary, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (text_key, ids) with ``decoded``, the text of the ids, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [codec.decode(np.frombuffer(x, "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["text_key", "ids", "decoded"])

    return encoded.mapInArrow(run, "text_key binary, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``docs``: number of ids, and digests of the ids and of the text decoded from them."""
    found = decode(encode(docs, tokenizer), tokenizer)
    found = found.select(
        "text_key",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    ).dropDuplicates(["text_key"])
    rows = docs.select("doc_id", text_key(docs["text"]).alias("text_key"))
    return rows.join(found, "text_key").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
