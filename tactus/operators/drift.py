"""Straight pieces of a phase track and the tempo changes they stand for.

A long track is cut into stretches that are fitted side by side. A stretch leaves one summary per
straight piece: power sums for least squares and the convex hull, which holds every point that can be
farthest from a line. Joining pieces, bending the line and measuring its worst miss then needs the
summaries of a song only, however many readings it has.

A stretch border is no place for a boundary of its own: readings near it are kept as they are, and the
song's step places the boundaries among them anew, between the straight pieces on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Readings of one stretch, about; more where `least` is large.
STRETCH = 1000
#: Readings kept on each side of a border, in shortest pieces.
MARGIN = 8


def _chain(t: np.ndarray, y: np.ndarray, side: float) -> list[int]:
    """Corners of the upper (``side`` 1) or lower (-1) hull of points in order of time."""
    out: list[int] = []
    for i in range(len(t)):
        while len(out) > 1:
            a, b = out[-2], out[-1]
            if side * ((t[b] - t[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (t[i] - t[a])) < 0:
                break
            out.pop()
        out.append(i)
    return out


def _narrowest(t: np.ndarray, y: np.ndarray) -> tuple[float, float, list[int]]:
    """Slope and height of the lowest strip that holds all points, and the corners of their hull.

    The height is convex in the slope and bends only at slopes of hull edges, so its minimum is there.
    """
    upper, lower = _chain(t, y, 1.0), _chain(t, y, -1.0)
    corners = sorted({*upper, *lower})
    if len(corners) < 2:
        return 0.0, 0.0, corners
    edges = [np.diff(y[c]) / np.diff(t[c]) for c in (upper, lower) if len(c) > 1]
    slopes = np.concatenate(edges)
    best = (0.0, np.inf)
    for part in np.array_split(slopes, max(1, len(slopes) // 256)):
        rest_up = (y[upper][None, :] - part[:, None] * t[upper][None, :]).max(1)
        rest_low = (y[lower][None, :] - part[:, None] * t[lower][None, :]).min(1)
        at = int(np.argmin(rest_up - rest_low))
        if rest_up[at] - rest_low[at] < best[1]:
            best = (float(part[at]), float(rest_up[at] - rest_low[at]))
    return *best, corners


def _reach(fits, low: int, high: int) -> int:
    """The largest number from ``low`` on, up to ``high``, that fits; what follows a misfit misfits too."""
    step, good = 1, low
    while good + step <= high and fits(good + step):
        good, step = good + step, step * 2
    bad = min(good + step, high + 1)
    while bad - good > 1:
        middle = (good + bad) // 2
        good, bad = (middle, bad) if fits(middle) else (good, middle)
    return good


def _errors(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Squared error of the least-squares line through readings ``start`` to ``end``."""
    n, t, y, tt, ty, yy = sums[:, end] - sums[:, start]
    spread = tt - t * t / n
    slope = np.where(spread > 0, (ty - t * y / n) / np.where(spread > 0, spread, 1.0), 0.0)
    return np.maximum(yy - y * y / n - slope * (ty - t * y / n), 0.0)


def _power_sums(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.array([float(len(t)), t.sum(), y.sum(), t @ t, t @ y, y @ y])


def _moved(sums: np.ndarray, by: float) -> np.ndarray:
    """Power sums of the same readings with times counted from ``by`` earlier."""
    n, t, y, tt, ty, yy = sums
    return np.array([n, t + n * by, y, tt + 2 * by * t + n * by * by, ty + by * y, yy])


def _boundaries(
    t: np.ndarray, y: np.ndarray, tolerance: float, least: int, before: Piece | None = None, after: Piece | None = None
) -> list[int]:
    """E08 - the fewest straight pieces within tolerance, placed for the smallest squared error.

    Part of a piece that fits also fits, so taking each piece as far as it goes needs the fewest. That
    gives the latest place for every boundary; the earliest is as far back as the next piece fits.
    ``before`` and ``after`` are pieces that go on into the readings; each counts as one place.
    """
    zero = before.first if before else t[0]
    moved = t - zero
    columns = np.stack([np.ones(len(t)), moved, y, moved * moved, moved * y, y * y])
    points = np.ones(len(t), int)
    for piece, side in ((before, 0), (after, 1)):
        if piece:
            own = _moved(piece.sums, piece.first - zero)[:, None]
            columns = np.hstack([columns, own] if side else [own, columns])
            t, y = (np.concatenate(x if side else x[::-1]) for x in ((t, piece.t), (y, piece.y)))
            points = np.append(points, len(piece.t)) if side else np.append(len(piece.t), points)
    n = columns.shape[1]
    sums = np.zeros((6, n + 1))
    np.cumsum(columns, axis=1, out=sums[:, 1:])
    held = np.rint(sums[0]).astype(int)
    at = np.concatenate([[0], np.cumsum(points)])
    height = lambda a, b: _narrowest(t[at[a] : at[b]], y[at[a] : at[b]])[1]
    ahead = lambda a: int(np.searchsorted(held, held[a] + least))
    latest = int(np.searchsorted(held, held[n] - least, "right")) - 1
    edges = [0]
    while edges[-1] < n:
        start = edges[-1]
        end = _reach(lambda e, s=start: height(s, e) <= 2 * tolerance, min(ahead(start), n), n)
        if 0 < held[n] - held[end] < least:  # the rest is no piece of its own
            end = latest if latest >= ahead(start) else n
        edges.append(end)
    for i in range(1, len(edges) - 1):
        a, b, c = edges[i - 1 : i + 2]
        first = max(ahead(a), c - _reach(lambda k, c=c: height(c - k, c) <= 2 * tolerance, c - b, c - a))
        places = np.arange(min(first, b), b + 1)
        cost = _errors(sums, np.full(len(places), a), places) + _errors(sums, places, np.full(len(places), c))
        edges[i] = int(places[np.argmax(cost <= cost.min() + 1e-6 * tolerance**2)])  # of equal ones the first
    return edges


@dataclass
class Piece:
    """What is known of a run of readings: its ends, power sums from ``first`` on, and hull corners."""

    first: float
    last: float
    sums: np.ndarray
    t: np.ndarray
    y: np.ndarray

    def __post_init__(self) -> None:
        self.slope, _, corners = _narrowest(self.t, self.y)
        self.t, self.y = self.t[corners], self.y[corners]

    @property
    def span(self) -> float:
        return self.last - self.first

    def joined(self, *others: Piece) -> Piece:
        every = (self, *others)
        return Piece(
            self.first,
            every[-1].last,
            sum(_moved(p.sums, p.first - self.first) for p in every),
            np.concatenate([p.t for p in every]),
            np.concatenate([p.y for p in every]),
        )


def _run(t: np.ndarray, y: np.ndarray) -> Piece:
    return Piece(float(t[0]), float(t[-1]), _power_sums(t - t[0], y), t, y)


def _least(change: np.ndarray, span: np.ndarray, limit: float) -> int | None:
    """The change of tempo that moves the beat least over its span, if by less than the limit."""
    if not len(change):
        return None
    moved = np.abs(change) * np.maximum(span, 1e-6)
    at = int(np.argmin(moved))
    return at if moved[at] < limit else None


def _settled(pieces: list[Piece], tolerance: float) -> tuple[list[Piece], list[float]]:
    """E09 - pieces whose boundaries matter, and the times of splices.

    A boundary matters if the change of slope, over the shorter neighbour, moves the beat by more than
    the tolerance. A piece between two like ones, whose slope goes and comes back, is a splice.
    """
    splices = []
    while len(pieces) > 1:
        slope = np.array([p.slope for p in pieces])
        span = np.array([p.span for p in pieces])
        change = np.diff(slope)
        at = _least(change, np.minimum(span[:-1], span[1:]), tolerance)
        if at is not None:
            pieces[at : at + 2] = [pieces[at].joined(pieces[at + 1])]
            continue
        turns = np.flatnonzero(change[:-1] * change[1:] < 0)  # the piece after each of these
        at = _least((slope[2:] - slope[:-2])[turns], np.minimum(span[:-2], span[2:])[turns], tolerance)
        if at is None:
            break
        i = int(turns[at])
        splices.append((pieces[i + 1].first + pieces[i + 1].last) / 2.0)
        pieces[i : i + 3] = [pieces[i].joined(*pieces[i + 1 : i + 3])]
    return pieces, sorted(splices)


def _bent(pieces: list[Piece]) -> tuple[np.ndarray, float]:
    """E10 - slopes of the least-squares line that bends where pieces meet, and its worst miss.

    On a piece the line is straight, so its normal equations need the power sums alone.
    """
    zero = pieces[0].first
    knots = np.array([p.first - zero for p in pieces[1:]])
    size = 2 + len(knots)
    gram, right = np.zeros((size, size)), np.zeros(size)
    lines = []
    for i, p in enumerate(pieces):
        level, rate = np.zeros(size), np.zeros(size)
        level[0] = rate[1] = 1.0
        level[2 : 2 + i], rate[2 : 2 + i] = -knots[:i], 1.0
        n, t, y, tt, ty, _ = _moved(p.sums, p.first - zero)
        gram += n * np.outer(level, level) + t * (np.outer(level, rate) + np.outer(rate, level)) + tt * np.outer(rate, rate)
        right += y * level + ty * rate
        lines.append((level, rate))
    scale = 1.0 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    found = scale * np.linalg.lstsq(gram * np.outer(scale, scale), right * scale, rcond=1e-13)[0]
    miss = max(float(np.abs(p.y - level @ found - (p.t - zero) * (rate @ found)).max()) for p, (level, rate) in zip(pieces, lines, strict=True))
    return np.array([rate @ found for _, rate in lines]), miss


def _parts(t: np.ndarray, edges: list[int], fits: list[bool], least: int) -> list[tuple[int, int, int, bool]]:
    """Start, end, piece and whether to keep the readings, for each part of a stretch.

    Kept are those within the margin of an end of the stretch, and up to the first and from the last
    piece on that is long and straight: boundaries before it may stand wrong because of the border.
    """
    n, margin = len(t), MARGIN * least
    sure = [i for i, ok in enumerate(fits) if ok and edges[i + 1] - edges[i] >= 4 * least and min(edges[i + 1], n - margin) - max(edges[i], margin) >= 3 * least]
    low = max(margin, edges[sure[0]] + least) if sure else n
    high = min(n - margin, edges[sure[-1] + 1] - least) if sure else n
    cuts = sorted({*edges, low, high})
    return [(a, b, int(np.searchsorted(edges, a, "right")) - 1, b <= low or a >= high) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _pieces(rows: pd.DataFrame, tolerance: float, least: int) -> list[Piece]:
    """Pieces of a song from the parts of its stretches, with boundaries near borders placed anew."""
    parts = [
        (r.stretch, r.piece, r.kept, Piece(r.first, r.last, np.array(r.sums), np.array(r.corner_t), np.array(r.corner_y)), np.array(r.corner_t), np.array(r.corner_y))
        for r in rows.itertuples()
    ]
    ends = parts[0][0], parts[-1][0]
    firm = {s: [i for i, p in enumerate(parts) if p[0] == s and not p[2]] for s in set(ends)}
    head = firm[ends[0]][0] if firm[ends[0]] else 0  # ends of the track are no borders
    tail = firm[ends[1]][-1] if firm[ends[1]] else len(parts)
    out: list[Piece] = []
    loose: list[tuple[np.ndarray, np.ndarray]] = []
    known = None

    def place(after: Piece | None) -> None:
        t, y = (np.concatenate(x) for x in zip(*loose, strict=True))
        loose.clear()
        before = out.pop() if out else None
        units = [*([before] if before else []), *(_run(t[i : i + 1], y[i : i + 1]) for i in range(len(t))), *([after] if after else [])]
        edges = _boundaries(t, y, tolerance, least, before, after)
        out.extend(units[a].joined(*units[a + 1 : b]) for a, b in zip(edges[:-1], edges[1:], strict=True))

    for i, (stretch, piece, kept, part, t, y) in enumerate(parts):
        if kept and head <= i <= tail and ends[0] != ends[1]:
            loose.append((t, y))
            continue
        if loose:
            place(part)
        elif known == (stretch, piece):
            out[-1] = out[-1].joined(part)
        else:
            out.append(part)
        known = stretch, piece
    if loose:
        place(None)
    return out


def fit_warps(
    track: DataFrame,
    keys: Sequence[str],
    bpm: str,
    *,
    tolerance: float = 0.020,
    hop: float = 2.0,
    shortest: float = 20.0,
) -> DataFrame:
    """E08-E10 - tempo changes of each song: ``(keys, seconds, bpm, slack, splices)``.

    ``track`` holds ``centre``, ``phase`` and the reference tempo ``bpm`` of each reading. The first
    row of a song stands at 0 seconds; a track shorter than one piece gives none.
    """
    least = max(int(shortest / hop), 4)
    kinds = [f"`{c}` {kind}" for c, kind in track.select(*keys).dtypes]
    stretch = F.floor(F.col("centre") / F.lit(hop * max(STRETCH, 4 * MARGIN * least))).alias("__stretch")
    names = [*keys, "stretch", "piece", "kept", "first", "last", "reference", "sums", "corner_t", "corner_y"]
    summary = ", ".join(
        [
            *kinds,
            "stretch bigint, piece int, kept boolean, first double, last double, reference double",
            "sums array<double>, corner_t array<double>, corner_y array<double>",
        ]
    )

    def cut(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("centre")
        t, y = part["centre"].to_numpy(float), part["phase"].to_numpy(float)
        edges = _boundaries(t, y, tolerance, least)
        fits = [_narrowest(t[a:b], y[a:b])[1] <= 2 * tolerance for a, b in zip(edges[:-1], edges[1:], strict=True)]
        rows = []
        for a, b, piece, kept in _parts(t, edges, fits, least):
            u, v = t[a:b], y[a:b]
            corners = np.arange(b - a) if kept else _narrowest(u, v)[2]
            sums = _power_sums(u - u[0], v).tolist()
            rows.append((*key, piece, kept, u[0], u[-1], float(part[bpm].iloc[0]), sums, u[corners].tolist(), v[corners].tolist()))
        return pd.DataFrame(rows, columns=names)

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("first")
        reference = float(part["reference"].iloc[0])
        columns = [*keys, "seconds", "bpm", "slack", "splices"]
        if sum(s[0] for s in part["sums"]) < least:
            return pd.DataFrame(columns=columns)
        pieces, splices = _settled(_pieces(part, tolerance, least), tolerance)
        while True:
            slopes, slack = _bent(pieces)
            # The line begins at 0 seconds.
            lengths = np.diff([0.0, *[p.first for p in pieces[1:]], pieces[-1].last])
            spare = _least(np.diff(slopes), np.minimum(lengths[:-1], lengths[1:]), tolerance)
            if spare is None:
                break
            pieces[spare : spare + 2] = [pieces[spare].joined(pieces[spare + 1])]
        starts = [0.0, *[p.first for p in pieces[1:]]]
        rows = [(*key, at, reference * (1.0 - float(s)), slack, splices) for at, s in zip(starts, slopes, strict=True)]
        return pd.DataFrame(rows, columns=columns)

    readings = track.select(*keys, "centre", "phase", bpm, stretch)
    pieces = readings.groupBy(*keys, "__stretch").applyInPandas(cut, summary)
    schema = ", ".join([*kinds, "seconds double, bpm double, slack double, splices array<double>"])
    return pieces.groupBy(*keys).applyInPandas(join, schema)
