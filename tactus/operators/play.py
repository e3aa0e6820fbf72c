"""How a sequence of timed note rows can be performed.

Input rows carry key columns, a time in seconds and an array of panel codes. ``order`` has to be
unique within a key; it starts with the time column. ``segment`` is the width, in seconds, of the
pieces a key is cut into (see :mod:`tactus.operators.ordered`); ``None`` treats each key as small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions import constants as k
from tactus.functions.scalars import count_codes, panel_mask, step_mask
from tactus.operators.ordered import SEGMENT, attach, scan, spread

# Every ordered pair of different panels a left and a right foot can stand on, one bit for each.
STANCES = tuple((a, b) for a in range(k.PANELS) for b in range(k.PANELS) if a != b)


def _bit(stance: tuple[int, int]) -> int:
    return 1 << (stance[0] * k.PANELS + stance[1])


ANY_STANCE = sum(map(_bit, STANCES))


@dataclass(frozen=True)
class Limits:
    """What separates a pad chart from a keyboard chart."""

    burst_window: float = k.BURST_SECONDS
    sustained_window: float = k.SUSTAINED_SECONDS
    max_burst: float = k.MAX_BURST
    max_sustained: float = k.MAX_SUSTAINED
    fast_jack: float = k.FAST_JACK
    stream_gap: float = k.STREAM_GAP


DEFAULT = Limits()


def _cut(time: str, segment: float | None) -> Column | None:
    return None if segment is None else F.floor(F.col(time) / F.lit(float(segment)))


def _within(rows: DataFrame, codes: str, width: int) -> DataFrame:
    wider = F.raise_error(F.lit(f"a row is wider than the {width} panels that were promised"))
    checked = F.when(F.size(codes) > width, wider.cast(rows.schema[codes].dataType)).otherwise(F.col(codes))
    return rows.withColumn(codes, checked)


def _beyond(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], codes: str, panels: int, segment: Column | None
) -> DataFrame:
    """Rows with notes on panels from ``panels`` on: what they add to the panels held there and counted.

    Each such panel is a key of its own, so rows of any width are tracked.
    """
    cut = segment if segment is not None else F.lit(0)
    wide = rows.where(F.size(codes) > panels).withColumn("__cut", cut)
    notes = wide.select(*keys, *order, "__cut", F.posexplode(codes).alias("__panel", "__code"))
    code = F.col("__code")
    notes = notes.where((F.col("__panel") >= panels) & (code != 0))
    heads, tail, struck = code.isin(*k.HOLD_CODES), code == k.TAIL, code.isin(*k.STEP_CODES)
    seen = scan(
        notes,
        [*keys, "__panel"],
        order,
        None if segment is None else F.col("__cut"),
        last_before={"__was": F.when(heads, 1).when(tail, 0)},
    )
    was = F.coalesce(F.col("__was") == 1, F.lit(False))
    blocked = code.isin(k.TAP, k.HOLD, k.ROLL, k.MINE, k.LIFT)
    return seen.groupBy(*keys, *order).agg(
        F.sum(F.when(heads & ~was, 1).when(tail & was, -1).otherwise(0)).alias("__change"),
        F.sum((was & tail).cast("int")).alias("__freed"),
        F.sum((struck & ~was).cast("int")).alias("__onto"),
        F.max(was & blocked).alias("__on_held"),
        F.max(~was & tail).alias("__orphan"),
    )


def occupied(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    codes: str = "codes",
    panels: int = k.PANELS,
    width: int | None = None,
    segment: Column | None = None,
) -> DataFrame:
    """W02 - add the panels stepped on, held from before, and needed on each row, as bit masks.

    ``pinned`` is what was held when the row began, ``held`` what is left of it after its tails. A tail frees its panel before its row is judged and a head pins it only afterwards. A tap on a
    held panel does not free it.

    The masks of ``pinned`` and ``held`` are those of the first ``panels`` panels. ``beyond`` counts the
    panels after these that are pinned, held and occupied, and says whether a note stands ``on_held`` ones
    or a tail is an ``orphan`` there.

    A caller that knows the rows' ``width`` to be ``panels`` at most saves their second pass; a row that is wider
    than that fails the job.
    """
    if width is not None and width <= panels:
        rows = _within(rows, codes, width)
        far = {"change": "bigint", "freed": "bigint", "onto": "bigint", "on_held": "boolean", "orphan": "boolean"}
        rows = rows.withColumns({f"__{n}": F.lit(None).cast(t) for n, t in far.items()})
    else:
        rows = attach(rows, _beyond(rows, keys, order, codes, panels, segment), [*keys, *order])
    at = [F.get(F.col(codes), F.lit(p)) for p in range(panels)]
    state = {
        f"__held{p}": F.when(at[p].isin(*k.HOLD_CODES), 1).when(at[p] == k.TAIL, 0)
        for p in range(panels)
    }
    change = F.coalesce("__change", F.lit(0))
    seen = scan(rows, keys, order, segment, last_before=state, running_before={"__pinned": change})
    held = sum(
        (
            F.when((F.col(f"__held{p}") == 1) & (at[p] != k.TAIL), F.lit(1 << p)).otherwise(F.lit(0))
            for p in range(panels)
        ),
        F.lit(0),
    )
    pinned = sum(
        (F.when(F.col(f"__held{p}") == 1, F.lit(1 << p)).otherwise(F.lit(0)) for p in range(panels)),
        F.lit(0),
    )
    stepped = step_mask(F.col(codes))
    far = F.coalesce("__pinned", F.lit(0)).cast("int")
    far_held = far - F.coalesce("__freed", F.lit(0)).cast("int")
    beyond = F.struct(
        far.alias("pinned"),
        far_held.alias("held"),
        (far_held + F.coalesce("__onto", F.lit(0)).cast("int")).alias("occupied"),
        F.coalesce("__on_held", F.lit(False)).alias("on_held"),
        F.coalesce("__orphan", F.lit(False)).alias("orphan"),
    )
    return seen.withColumns(
        {"stepped": stepped, "pinned": pinned, "held": held, "occupied": stepped.bitwiseOR(held), "beyond": beyond}
    ).drop(*state, "__pinned", "__change", "__freed", "__onto", "__on_held", "__orphan")


def runs(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    gap: float,
    *,
    segment: float | None = None,
) -> DataFrame:
    """W01 - unbroken runs of steps at most ``gap`` apart: start, end and number of steps."""
    time = order[0]
    # Whether a step opens a run only depends on steps within the gap, so a margin is enough.
    placed = spread(rows.select(*keys, *order), F.col(time), segment, behind=gap)
    before = F.lag(time).over(Window.partitionBy(*keys, SEGMENT).orderBy(*order))
    opens = before.isNull() | (F.col(time) - before > F.lit(gap))
    opened = placed.withColumn("__opens", F.when(opens, F.col(time))).where(~F.col("ghost"))
    named = scan(
        opened.drop("ghost", SEGMENT),
        keys,
        order,
        _cut(time, segment),
        last={"run_start": F.col("__opens")},
    )
    return named.groupBy(*keys, "run_start").agg(
        F.max(time).alias("run_end"), F.count(F.lit(1)).alias("steps")
    )


def _quick_move(stances: Column) -> Column:
    """Stances reachable by moving one foot at most: those sharing a left or a right foot."""
    shared = [_row(p) for p in range(k.PANELS)] + [_column(p) for p in range(k.PANELS)]
    near = F.lit(0)
    for group in shared:
        near = near.bitwiseOR(
            F.when(stances.bitwiseAND(F.lit(group)) != 0, F.lit(group)).otherwise(F.lit(0))
        )
    return near


def _row(left: int) -> int:
    return sum(_bit(s) for s in STANCES if s[0] == left)


def _column(right: int) -> int:
    return sum(_bit(s) for s in STANCES if s[1] == right)


def _covering() -> list[int]:
    """Stances that cover the panels of a mask as far as two feet can."""
    table = []
    for mask in range(1 << k.PANELS):
        need = min(mask.bit_count(), 2)
        table.append(sum(_bit(s) for s in STANCES if sum(mask >> p & 1 for p in s) == need))
    return table


def _ints(values: Sequence[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


#: Rows of a block, blocks of a piece, and children of a node above the pieces.
BLOCK, PIECE, FAN = 64, 64, 64
#: Levels above the pieces. Over 10**9 rows of a key can be brought together; with more the job fails.
LEVELS = 3
#: Bits that a row takes in a packed block: whether it is there, whether it follows quickly, and its stances.
ROW_BITS = 2 + k.PANELS * k.PANELS
PACKED = 63 // ROW_BITS
IDENTITY = [_bit(s) for s in STANCES]


def _stances(mask: Column) -> Column:
    """Stances that cover the panels of ``mask`` as far as two feet can; bits from the pad's width on stand for farther panels."""
    within = mask.bitwiseAND(F.lit((1 << k.PANELS) - 1))
    # A panel beyond the pad cannot be stood on, so it leaves a row short of what it needs.
    short = (mask != within) & (F.bit_count(within) < 2)
    return F.when(short, F.lit(0)).otherwise(F.get(_ints(_covering()), within))


def _packed(place: Column, quick: Column, good: Column) -> dict[str, Column]:
    """Aggregates that hold the rows of a block side by side in a few longs."""
    row = good.cast("bigint") + F.when(quick, F.lit(1 << (ROW_BITS - 2))).otherwise(F.lit(0)) + F.lit(1 << (ROW_BITS - 1))
    slot = F.pmod(place, F.lit(BLOCK))
    shifted = row * F.get(F.expr(f"array({', '.join(f'{1 << (ROW_BITS * i)}L' for i in range(PACKED))})"), F.pmod(slot, F.lit(PACKED)).cast("int"))
    word = F.floor(slot / F.lit(PACKED))
    return {f"__w{i}": F.sum(F.when(word == i, shifted)) for i in range(-(-BLOCK // PACKED))}


def _unpacked(words: int) -> Column:
    """The rows of a packed block in order."""
    cells = [
        F.shiftright(F.coalesce(f"__w{i}", F.lit(0).cast("bigint")), ROW_BITS * j).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
        for i in range(words)
        for j in range(PACKED)
    ]
    return F.filter(F.array(*cells), lambda c: c != 0)


def _walked(rows: Column) -> Column:
    """Where a block leads: for every stance before its first row, the set of stances after its last one."""

    def land(before: Column, row: Column) -> Column:
        quick = row.bitwiseAND(F.lit(1 << (ROW_BITS - 2))) != 0
        good = row.bitwiseAND(F.lit((1 << (k.PANELS * k.PANELS)) - 1)).cast("int")
        moved = lambda m: F.when(quick, _quick_move(m)).when(m != 0, F.lit(ANY_STANCE)).otherwise(F.lit(0))
        return F.transform(before, lambda m: moved(m).bitwiseAND(good))

    return F.aggregate(rows, _ints(IDENTITY), land)


def _joined(children: Sequence[Column]) -> Column:
    """One relation for several that follow one another; null ones change nothing."""

    def through(before: Column, child: Column) -> Column:
        def step(m: Column) -> Column:
            met = F.zip_with(child, _ints(IDENTITY), lambda to, bit: F.when(m.bitwiseAND(bit) != 0, to).otherwise(F.lit(0)))
            return F.aggregate(met, F.lit(0), lambda a, b: a.bitwiseOR(b))

        return F.transform(before, step)

    return F.aggregate(F.filter(F.array(*children), lambda c: c.isNotNull()), _ints(IDENTITY), through)


def _merged(rows: DataFrame, by: Sequence[str], place: Column, fan: int, figures: Mapping[str, Callable]) -> DataFrame:
    """Bring ``fan`` neighbours together: their figures by what is named for each, their relations in order of ``place``."""
    slot = F.pmod(place, F.lit(fan))
    held = rows.groupBy(*by).agg(
        *[how(name).alias(name) for name, how in figures.items()],
        *[F.max(F.when(slot == i, F.col("__leads"))).alias(f"__r{i}") for i in range(fan)],
    )
    return held.select(*by, *figures, _joined([F.col(f"__r{i}") for i in range(fan)]).alias("__leads"))


def playability(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    codes: str = "codes",
    limits: Limits = DEFAULT,
    segment: float | None = None,
    panels: int = k.PANELS,
    width: int | None = None,
) -> DataFrame:
    """A02 - one row per key saying how the chart can be performed.

    Rows are cut into ``(key, segment)`` pieces once; each piece is reduced to a summary row there,
    and only the summaries are combined per key. Unused figures are pruned by Catalyst, so the
    narrower operators below are selections from this one. Rows are judged over their full width;
    ``panels`` (30 at most) is how many panels have columns of their own, the others are exploded. ``width``
    is as in :func:`occupied`.
    """
    time = order[0]
    pad = (1 << panels) - 1
    far = F.col("beyond.occupied")
    needed = occupied(
        rows, keys, order, codes=codes, panels=panels, width=width, segment=_cut(time, segment)
    ).withColumns(
        {
            "__struck": count_codes(F.col(codes), k.STEP_CODES),
            "__size": F.bit_count(F.col("occupied").bitwiseAND(F.lit(pad))) + far,
            # Panels beyond the pad cannot be stood on; which of them it is does not matter.
            "occupied": F.col("occupied").bitwiseAND(F.lit(pad)).bitwiseOR(F.when(far > 0, F.lit(1 << 30)).otherwise(F.lit(0))),
        }
    ).where(F.col("__size") > 0)
    reach = max(limits.burst_window, limits.sustained_window, limits.stream_gap, limits.fast_jack)
    placed = spread(
        needed.select(*keys, *order, "stepped", "occupied", "__struck", "__size"),
        F.col(time),
        segment,
        behind=reach,
    )
    own = ~F.col("ghost")
    w = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def within(seconds: float) -> Column:
        by = ", ".join(f"`{c}`" for c in [*keys, SEGMENT])
        return F.expr(
            f"count(1) over (partition by {by} order by `{time}`"
            f" range between {float(seconds)!r}D preceding and current row)"
        )

    t, stepped = F.col(time), F.col("stepped")
    strikes = F.col("__struck") > 0
    panel_bits = [stepped.bitwiseAND(F.lit(1 << p)) != 0 for p in range(panels)]
    seen = {f"__seen{p}": F.when(panel_bits[p], t) for p in range(panels)}
    seen["__before"] = F.when(strikes, t)
    local = placed.withColumns(
        {
            **{n: F.last(e, ignorenulls=True).over(prior) for n, e in seen.items()},
            "__burst": within(limits.burst_window),
            "__sustained": within(limits.sustained_window),
        }
    )
    in_run = strikes & F.col("__before").isNotNull() & (t - F.col("__before") <= limits.stream_gap)
    single = F.col("__struck") == 1
    right, left = stepped == 1 << k.RIGHT_PANEL, stepped == 1 << k.LEFT_PANEL
    turning = F.when(own & in_run, 1).otherwise(0)
    local = local.withColumns({"__run": turning, "__turns": F.sum(turning).over(upto)})
    sets_foot = own & single & (F.col("__run") == 0)
    local = local.withColumn(
        "__set",
        F.last(
            F.when(sets_foot, F.struct(right.cast("int").alias("f"), F.col("__turns").alias("n"))),
            ignorenulls=True,
        ).over(upto),
    )
    # The foot is known once a step has set it inside this piece; before that it depends on which
    # foot the piece starts with, so both answers are counted.
    known = F.col("__set").isNotNull()
    foot = F.when(
        known, F.pmod(F.col("__set.f") + F.col("__turns") - F.col("__set.n"), F.lit(2))
    ).otherwise(F.pmod(F.col("__turns"), F.lit(2)))
    counts_step = (F.col("__run") == 1) & single
    crossed = counts_step & (((foot == 0) & right) | ((foot == 1) & left))
    crossed_if_right = counts_step & (((foot == 1) & right) | ((foot == 0) & left))
    size = F.col("__size")
    gaps = [t - F.col(f"__seen{p}") for p in range(panels)]
    nearest = F.least(*[F.when(panel_bits[p], gaps[p]) for p in range(panels)])
    # How feet get from row to row is a relation of stances. Rows are packed side by side into blocks, blocks are
    # brought together in pieces and those in a tree, so that no task ever lists the rows of a key.
    quick = F.coalesce(t - F.lag(t).over(w) < F.lit(limits.fast_jack), F.lit(False))
    local = local.withColumns({"__quick": quick, "__n": F.row_number().over(w) - 1, "__known": known, "__nearest": nearest})
    local = local.withColumns({"__crossed": crossed, "__crossed_right": crossed_if_right, "__block": F.floor(F.col("__n") / F.lit(BLOCK))})
    figures: dict[str, Callable] = {
        **dict.fromkeys(("rows", "steps", "chord_rows", "impossible_rows", "crossed_known", "crossed_left", "crossed_right", "turns"), F.sum),
        **dict.fromkeys(("first_time", "jack"), F.min),
        **dict.fromkeys(("last_time", "burst", "sustained", "max_simultaneous", "set"), F.max),
        **{f"first{p}": F.min for p in range(panels)},
        **{f"last{p}": F.max for p in range(panels)},
    }
    words = _packed(F.col("__n"), F.col("__quick"), _stances(F.col("occupied")))
    blocks = (
        local.where(own)
        .groupBy(*keys, SEGMENT, "__block")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(strikes.cast("int")).alias("steps"),
            F.min(t).alias("first_time"),
            F.max(t).alias("last_time"),
            F.max("__burst").alias("burst"),
            F.max("__sustained").alias("sustained"),
            F.sum(((size > 2) & (size <= 4)).cast("int")).alias("chord_rows"),
            F.sum((size > 4).cast("int")).alias("impossible_rows"),
            F.max(size).alias("max_simultaneous"),
            F.sum((F.col("__known") & F.col("__crossed")).cast("int")).alias("crossed_known"),
            F.sum((~F.col("__known") & F.col("__crossed")).cast("int")).alias("crossed_left"),
            F.sum((~F.col("__known") & F.col("__crossed_right")).cast("int")).alias("crossed_right"),
            F.sum("__run").alias("turns"),
            # Of the last row that knows its foot: its number, then the turns made when the foot was set, then the foot.
            F.max(F.when(F.col("__known"), F.col("__n") * F.lit(1 << 32) + F.col("__set.n") * 2 + F.col("__set.f"))).alias("set"),
            F.min("__nearest").alias("jack"),
            *[F.min(F.when(panel_bits[p], t)).alias(f"first{p}") for p in range(panels)],
            *[F.max(F.when(panel_bits[p], t)).alias(f"last{p}") for p in range(panels)],
            *[e.alias(n) for n, e in words.items()],
        )
    )
    blocks = blocks.withColumns({"__leads": _walked(_unpacked(len(words))), "__piece": F.floor(F.col("__block") / F.lit(PIECE))})
    pieces = _merged(blocks, [*keys, SEGMENT, "__piece"], F.col("__block"), PIECE, figures)
    across = Window.partitionBy(*keys).orderBy(SEGMENT, "__piece")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    stretch = Window.partitionBy(*keys, SEGMENT).orderBy("__piece")
    chained = pieces.withColumns(
        {
            "__turned": F.coalesce(F.sum("turns").over(earlier), F.lit(0)),
            **{
                f"__last{p}": F.last(f"last{p}", ignorenulls=True).over(earlier)
                for p in range(panels)
            },
        }
    )
    # Turns and feet count from the start of the segment, of which this may be a later piece.
    chained = chained.withColumn("__turned", F.first("__turned").over(stretch))
    then = F.shiftright(F.col("set").bitwiseAND(F.lit((1 << 32) - 1)), 1)
    set_foot = F.struct((F.col("set").bitwiseAND(F.lit(1)) - then - F.col("__turned")).alias("v"))
    chained = chained.withColumn("__foot", F.when(F.col("set").isNotNull(), set_foot))
    base = F.coalesce(F.last("__foot", ignorenulls=True).over(earlier)["v"], F.lit(0))
    chained = chained.withColumn("__base", base).withColumn("__base", F.first("__base").over(stretch))
    start = F.pmod(F.col("__base") + F.col("__turned"), F.lit(2))
    place = F.row_number().over(across).cast("bigint") - 1
    most = FAN**LEVELS
    too_many = F.raise_error(F.lit(f"more than {most * BLOCK * PIECE} rows in a key")).cast("bigint")
    nodes = chained.select(
        *keys,
        *[c for c in ("rows", "steps", "first_time", "last_time", "burst", "sustained", "chord_rows", "impossible_rows", "max_simultaneous")],
        (F.col("crossed_known") + F.when(start == 1, F.col("crossed_right")).otherwise(F.col("crossed_left"))).alias("crossovers"),
        F.least("jack", *[F.col(f"first{p}") - F.col(f"__last{p}") for p in range(panels)]).alias("jack"),
        F.when(place < most, place).otherwise(too_many).alias("__node"),
        "__leads",
    )
    kept = {n: how for n, how in figures.items() if n in nodes.columns} | {"crossovers": F.sum}
    for level in range(1, LEVELS):
        nodes = nodes.withColumn("__above", F.floor(F.col("__node") / F.lit(FAN)))
        nodes = _merged(nodes, [*keys, "__above"], F.col("__node"), FAN, kept).withColumnRenamed("__above", "__node")
    whole = _merged(nodes, keys, F.col("__node"), FAN, kept)
    whole = whole.withColumn("geometrically_possible", F.exists("__leads", lambda m: m != 0))

    if width is not None and width <= panels:
        whole = whole.withColumn("__far_jack", F.lit(None).cast("double"))
    else:
        whole = _with_far_jacks(whole, rows, keys, order, codes, panels, segment)

    def rate(count: str, seconds: float) -> Column:
        long_enough = (F.col("rows") >= 2) & (F.col("last_time") - F.col("first_time") >= seconds)
        return F.when(long_enough, F.col(count) / F.lit(float(seconds))).otherwise(F.lit(0.0))

    measured = whole.select(
        *keys,
        "rows",
        "steps",
        rate("burst", limits.burst_window).alias("burst_nps"),
        rate("sustained", limits.sustained_window).alias("sustained_nps"),
        "chord_rows",
        "impossible_rows",
        "max_simultaneous",
        "crossovers",
        F.least("jack", "__far_jack").alias("fastest_jack"),
        "geometrically_possible",
    )
    return classify(measured, limits)


def _with_far_jacks(
    whole: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], codes: str, panels: int, segment: float | None
) -> DataFrame:
    jacks = fastest_jack(rows.where(F.size(codes) > panels), keys, order, codes=codes, segment=segment, first=panels)
    return attach(whole, jacks.withColumnRenamed("fastest_jack", "__far_jack"), keys)


def classify(measured: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Add the verdict: reasons a pad cannot play it, the style, and whether a pad can."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("impossible_rows") > 0, F.lit("impossible_rows")),
            F.when(~F.col("geometrically_possible"), F.lit("no_two_foot_assignment")),
            F.when(F.col("fastest_jack") < limits.fast_jack, F.lit("fast_jack")),
            F.when(F.col("sustained_nps") > limits.max_sustained, F.lit("sustained_rate")),
            F.when(F.col("burst_nps") > limits.max_burst, F.lit("burst_rate")),
        )
    )
    style = (
        F.when(F.size("reasons") > 0, F.lit("keyboard"))
        .when(F.col("chord_rows") > 0, F.lit("hands"))
        .otherwise(F.lit("feet"))
    )
    return measured.withColumn("reasons", reasons).withColumns(
        {"style": style, "pad_playable": style != "keyboard"}
    )


def peak_rate(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    window: float,
    *,
    codes: str = "codes",
    segment: float | None = None,
    width: int | None = None,
) -> DataFrame:
    """W03 - highest rate of occupied rows over any window of the given length."""
    limits = Limits(burst_window=window, sustained_window=window, stream_gap=0.0)
    report = playability(rows, keys, order, codes=codes, limits=limits, segment=segment, width=width)
    return report.select(*keys, F.col("burst_nps").alias("peak_rate"))


def fastest_jack(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    codes: str = "codes",
    segment: float | None = None,
    first: int = 0,
) -> DataFrame:
    """W04 - shortest time between two strikes of one panel (from ``first`` on); NULL when none repeats.

    Each panel is its own short summary per piece, so only first and last strikes cross an edge.
    """
    time = order[0]
    bits = F.posexplode(F.transform(F.col(codes), lambda c: c.isin(*k.STEP_CODES)))
    strikes = rows.select(*keys, *order, bits.alias("panel", "__on")).where(F.col("__on") & (F.col("panel") >= first))
    cut = _cut(time, segment)
    strikes = strikes.withColumn(SEGMENT, cut if cut is not None else F.lit(0))
    w = Window.partitionBy(*keys, "panel", SEGMENT).orderBy(*order)
    pieces = (
        strikes.withColumn("__gap", F.col(time) - F.lag(time).over(w))
        .groupBy(*keys, "panel", SEGMENT)
        .agg(F.min("__gap").alias("gap"), F.min(time).alias("first"), F.max(time).alias("last"))
    )
    across = Window.partitionBy(*keys, "panel").orderBy(SEGMENT)
    edge = F.col("first") - F.lag("last").over(across)
    return (
        pieces.withColumn("__edge", edge)
        .groupBy(*keys)
        .agg(F.min(F.least("gap", "__edge")).alias("fastest_jack"))
    )


def crossed_steps(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    codes: str = "codes",
    gap: float = k.STREAM_GAP,
    segment: float | None = None,
    width: int | None = None,
) -> DataFrame:
    """W05 - steps that put the left foot on the right panel or the other way round."""
    limits = Limits(burst_window=gap, sustained_window=gap, stream_gap=gap)
    report = playability(rows, keys, order, codes=codes, limits=limits, segment=segment, width=width)
    return report.select(*keys, "steps", "crossovers")


def feet_feasible(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    codes: str = "codes",
    fast: float = k.FAST_JACK,
    segment: float | None = None,
    width: int | None = None,
) -> DataFrame:
    """W06 - whether two feet can cover every row without both moving within a very short gap."""
    limits = Limits(burst_window=0.0, sustained_window=0.0, stream_gap=0.0, fast_jack=fast)
    report = playability(rows, keys, order, codes=codes, limits=limits, segment=segment, width=width)
    return report.select(*keys, "geometrically_possible")


def foot_steps(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    stepped: str = "stepped",
    gap: float = k.STREAM_GAP,
    segment: float | None = None,
) -> DataFrame:
    """Row-level form of W05: rows that step, with ``in_run``, ``foot`` and ``crossed``.

    ``previous`` is the time of the step before.
    """
    time = order[0]
    cut = _cut(time, segment)
    steps = rows.where(F.col(stepped) != 0)
    linked = scan(steps, keys, order, cut, lag={"previous": F.col(time)})
    linked = linked.withColumn(
        "in_run", F.coalesce(F.col(time) - F.col("previous") <= F.lit(gap), F.lit(False))
    )
    single = F.bit_count(F.col(stepped)) == 1
    right = F.col(stepped) == 1 << k.RIGHT_PANEL
    left = F.col(stepped) == 1 << k.LEFT_PANEL
    resets = single & ~F.col("in_run")
    walked = scan(
        linked,
        keys,
        order,
        cut,
        running={"__turns": F.col("in_run").cast("int")},
        last={"__foot": F.when(resets, right.cast("int"))},
        marks={"__turns_then": (resets, "__turns")},
    )
    foot = F.pmod(
        F.coalesce("__foot", F.lit(0))
        + F.col("__turns")
        - F.coalesce("__turns_then", F.lit(0)),
        F.lit(2),
    ).cast("int")
    walked = walked.withColumn("foot", foot)
    crossed = (
        F.col("in_run")
        & single
        & (((F.col("foot") == 0) & right) | ((F.col("foot") == 1) & left))
    )
    return walked.withColumn("crossed", crossed).drop("__turns", "__foot", "__turns_then")


__all__ = [
    "DEFAULT",
    "Limits",
    "classify",
    "crossed_steps",
    "fastest_jack",
    "feet_feasible",
    "foot_steps",
    "occupied",
    "panel_mask",
    "peak_rate",
    "playability",
    "runs",
]
