"""Note streams of the DWI format."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.functions import constants as k

ROWS_PER_BEAT = 48
BARE_STEP, TICK_STEP = 1 / 2, 1 / 48
# One alternative per thing a stream can hold: a chord, the opener of 192nd notes, a chord that never
# ends, a bracket, or a step with an optional freeze marker.
TOKEN = re.compile(
    r"<(?P<chord>[^0>]*)>|(?P<tick><)(?=[^>]*0)|(?P<broken><)"
    r"|(?P<opener>[(\[{`])|(?P<closer>[)\]}'>])"
    r"|(?P<step>[0-46-9ABab])(?:!(?P<held>[\s\S]))?"
)
CHORD_STEP = re.compile(r"(?P<step>[\s\S])(?:!(?P<held>[\s\S]))?")
#: Bits of a panel's code, and how many codes a row can have.
BITS = 3
PACKED = 1 << BITS * k.PANELS


def _mask(char: str | None) -> int:
    return sum(1 << p for p in k.DWI_PANELS.get((char or "").upper(), ()))


def _events(stream: str) -> Iterator[dict]:
    """Steps of one stream in order; brackets nest, so this part is sequential."""
    beat, lengths = 0.0, [BARE_STEP]
    for token in TOKEN.finditer(stream):
        kind = token.lastgroup
        if kind == "broken":
            return
        if kind == "tick":
            lengths.append(TICK_STEP)
        elif kind == "opener":
            lengths.append(k.DWI_STEP[token["opener"]])
        elif kind == "closer":
            lengths = lengths[:-1] or [BARE_STEP]
        else:
            parts = [token] if token["step"] else CHORD_STEP.finditer(token["chord"])
            stepped = held = 0
            for part in parts:
                stepped |= _mask(part["step"])
                held |= _mask(part["held"])
            yield {"row": round(beat * ROWS_PER_BEAT), "stepped": stepped, "held": held}
            beat += lengths[-1]


def _rows(stream: str) -> list[int]:
    """``row * PACKED`` plus the codes of each row with a note, the last step of a panel on a row counting."""
    rows: dict[int, int] = {}
    open_panels = 0
    for event in _events(stream):
        touched = event["stepped"] | event["held"]
        if not touched:
            continue
        codes = rows.get(event["row"], 0)
        for p in range(k.PANELS):
            bit = 1 << p
            if touched & bit:
                if open_panels & bit:
                    code = k.TAIL
                    open_panels ^= bit
                elif event["held"] & bit:
                    code = k.HOLD
                    open_panels ^= bit
                else:
                    code = k.TAP
                codes = codes & ~((1 << BITS) - 1 << BITS * p) | code << BITS * p
        rows[event["row"]] = codes
    return [row * PACKED + codes for row, codes in rows.items()]


@F.pandas_udf(T.ArrayType(T.LongType()))
def decode_stream(streams: pd.Series) -> pd.Series:
    """P07 - packed note rows of each stream, whole, one Arrow batch at a time."""
    return streams.map(lambda s: _rows(s or ""))


def dwi_rows(charts: DataFrame, keys: Sequence[str], notes: str = "notes") -> DataFrame:
    """P07 - note rows of DWI charts: ``beat`` and ``codes``. A chart is one row, and nothing is shuffled.

    A freeze marked on a free panel begins one and the next step there ends it. A step without the
    marker always leaves its panel free.
    """
    found = charts.select(*keys, F.explode(decode_stream(F.col(notes))).alias("__row"))
    row = F.shiftright("__row", BITS * k.PANELS)
    codes = F.array(*[F.shiftright("__row", BITS * p).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") for p in range(k.PANELS)])
    return found.select(*keys, (row / F.lit(float(ROWS_PER_BEAT))).alias("beat"), codes.alias("codes"))
