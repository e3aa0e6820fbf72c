"""Column functions: everything that needs only the row it is on."""

from __future__ import annotations

import math
from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from tactus.functions import constants as k

#: White space of Unicode, and the four separators U+001C to U+001F.
UNICODE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def text_strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(value, F.lit(UNICODE_SPACE))


def upper_case(value: Column) -> Column:
    """Upper case of any text. Most names have it already, and Spark's own mapping is slow to find that out."""
    return F.when(value.rlike(r"^[\x00-\x60\x7B-\x7F]*\z"), value).otherwise(F.upper(value))


def lower_case(value: Column) -> Column:
    """Lower case of any text; ASCII is mapped letter by letter, which is much faster than Spark's own mapping."""
    plain = F.translate(value, ascii_uppercase, ascii_lowercase)
    return F.when(value.rlike(r"^[\x00-\x7F]*\z"), plain).otherwise(F.lower(value))


def lenient_double(value: Column) -> Column:
    """A decimal number, or NULL where the text is not one.

    Spark's cast accepts type suffixes (``1d``) that the formats do not, and the formats accept
    digit groups (``1_0``) that Spark does not, so both are settled before the cast.
    """
    text = text_strip(value)
    plain = F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")
    number = r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
    return F.when(plain.rlike(number), plain.try_cast("double"))


def parse_float(value: Column, default: float = 0.0) -> Column:
    """Read a number, falling back to ``default`` when it is malformed or absent."""
    return F.coalesce(lenient_double(value), F.lit(float(default)))


def meter(value: Column) -> Column:
    """Whole rating of a chart. A rating that is not finite yields NULL."""

    def whole(number: Column) -> Column:
        finite = ~F.isnan(number) & (F.abs(number) < F.lit(2147483647.0))
        return F.when(finite, number.cast("int"))

    # As a variable the number is read once.
    return F.get(F.transform(F.array(parse_float(value)), whole), F.lit(0))


def clamp_meter(value: Column, top: int = 20) -> Column:
    """Rating as a conditioning index."""
    return F.greatest(F.lit(0), F.least(value, F.lit(top)))


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def normalize_difficulty(value: Column) -> Column:
    """Canonical difficulty name, or the stripped original when it is not one of the six."""
    stripped = text_strip(value)
    names = _literal_map({name.lower(): name for name in k.DIFFICULTIES})
    return F.coalesce(F.element_at(names, lower_case(stripped)), stripped)


def difficulty_index(value: Column) -> Column:
    """Position of a difficulty, the last one standing in for anything unknown."""
    found = F.array_position(F.array(*[F.lit(n) for n in k.DIFFICULTIES]), value)
    return F.when(found > 0, found - 1).otherwise(F.lit(len(k.DIFFICULTIES) - 1)).cast("int")


def style_index(value: Column) -> Column:
    """Position of a playing style, unknown styles counting as the first."""
    found = F.array_position(F.array(*[F.lit(n) for n in k.STYLES]), value)
    return F.when(found > 0, found - 1).otherwise(F.lit(0)).cast("int")


def panel_codes(columns: Column, width: int | None = k.PANELS) -> Column:
    """Integer code per panel. ``width`` cuts or pads the row; ``None`` keeps it as written, an empty one without panels."""
    table = _literal_map(k.CODE_BY_CHAR)
    chars = F.when(F.length(columns) > 0, F.split(columns, "")).otherwise(F.array().cast("array<string>"))
    codes = F.transform(
        chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0))
    )
    if width is None:
        return codes
    padded = F.concat(codes, F.array_repeat(F.lit(0), width))
    return F.slice(padded, 1, width)


def code_text(codes: Column) -> Column:
    """Note characters for a row of panel codes."""
    chars = F.array(*[F.lit(c) for c in k.CHAR_BY_CODE])
    return F.array_join(F.transform(codes, lambda c: F.get(chars, c)), "")


def panel_mask(codes: Column, wanted: Sequence[int]) -> Column:
    """Bit per panel, set where the panel carries one of the wanted codes.

    Panels from the 31st on share the last bit; :func:`panel_set` and :func:`count_codes` tell them apart.
    """
    powers = F.expr("array(" + ", ".join(str(1 << i) for i in range(31)) + ")")
    bits = F.transform(
        codes, lambda c, i: F.when(c.isin(*wanted), F.get(powers, F.least(i, F.lit(30)))).otherwise(0)
    )
    return F.aggregate(bits, F.lit(0), lambda a, b: a.bitwiseOR(b))


def step_mask(codes: Column) -> Column:
    """Panels the player strikes on a row."""
    return panel_mask(codes, k.STEP_CODES)


def panel_set(codes: Column, wanted: Sequence[int]) -> Column:
    """Panels that carry one of the wanted codes, in order; the row may have any width."""
    return F.array_compact(F.transform(codes, lambda c, i: F.when(c.isin(*wanted), i)))


def count_codes(codes: Column, wanted: Sequence[int]) -> Column:
    """How many panels carry one of the wanted codes."""
    return F.size(F.filter(codes, lambda c: c.isin(*wanted)))


def encode_row(codes: Column) -> Column:
    """Pack a row into one base-7 integer."""
    return F.aggregate(codes, F.lit(0), lambda a, c: (a * 7 + c).cast("int"))


def decode_row(token: Column) -> Column:
    """Unpack a base-7 integer into its four panel codes."""
    return F.array(
        *[((token / F.lit(7**p)).cast("int") % 7).cast("int") for p in (3, 2, 1, 0)]
    )


def mirror_row(codes: Column, permutation: Sequence[int]) -> Column:
    """Rearrange the panels of a row."""
    return F.array(*[F.get(codes, F.lit(p)) for p in permutation])


def grid_slot(beat: Column) -> Column:
    """Nearest grid slot of a beat; exact halves go to the even slot."""
    return F.bround(beat * F.lit(float(k.SLOTS_PER_BEAT))).cast("int")


def metric_position(slot: Column) -> Column:
    """Position of a slot within its measure."""
    return F.pmod(slot, F.lit(k.SLOTS_PER_MEASURE))


def gap_to_offset(milliseconds: Column) -> Column:
    """Seconds of offset for a gap in milliseconds."""
    return -milliseconds / F.lit(1000.0)


def offset_to_gap(offset: Column) -> Column:
    """Milliseconds of gap for an offset in seconds."""
    return -offset * F.lit(1000.0)


def bar_seconds(bpm: Column) -> Column:
    """Length of a four-beat bar."""
    return F.lit(240.0) / bpm


def phase_of_offset(offset: Column, bpm: Column, bins: int = k.PHASE_BINS) -> Column:
    """Bin of the bar an offset puts the downbeat into."""
    period = bar_seconds(bpm)
    # Whole bars are taken off by one product: a remainder rounds bins' edges to the other side.
    within = -offset - F.floor(-offset / period) * period
    return F.pmod(F.floor(within / period * F.lit(bins)), F.lit(bins)).cast("int")


def offset_for_phase(phase: Column, bpm: Column, bins: int = k.PHASE_BINS) -> Column:
    """Offset that puts the downbeat in the middle of a bin."""
    return -((phase + F.lit(0.5)) / F.lit(float(bins))) * bar_seconds(bpm)


def cyclic_distance(left: Column, right: Column, bins: int = k.PHASE_BINS) -> Column:
    """Distance between two bins, the short way round."""
    apart = F.abs(left - right)
    return F.least(apart, F.lit(bins) - apart)


def tempo_prior(bpm: Column) -> Column:
    """Log-normal preference for middling tempi."""
    octaves = F.log2(bpm / F.lit(k.PRIOR_CENTRE_BPM)) / F.lit(k.PRIOR_WIDTH_OCTAVES)
    return F.exp(F.lit(-0.5) * octaves * octaves)


def snap_bpm(bpm: Column, tolerance: float = 0.25) -> Column:
    """Nearest half beat per minute when it is within the tolerance."""
    rounded = F.bround(bpm * F.lit(2.0)) / F.lit(2.0)
    return F.when(F.abs(rounded - bpm) <= F.lit(tolerance), rounded).otherwise(bpm)


def safe_name(title: Column, fallback: str = "Untitled") -> Column:
    """Directory name that every common filesystem accepts."""
    cleaned = text_strip(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', ""))
    cut = F.substring(F.regexp_replace(cleaned, r"[. ]+$", ""), 1, 120)
    return F.coalesce(F.nullif(text_strip(cut), F.lit("")), F.lit(fallback))


def chart_hash(notes: Column) -> Column:
    """Digest of note text, indifferent to comments and carriage returns."""
    return F.md5(F.regexp_replace(F.replace(notes, F.lit("\r"), F.lit("")), r"//[^\n]*", ""))


#: Bits of a draw: as many as a double holds with room to spare.
DRAW_BITS = 52


def drawn(*parts: Column) -> Column:
    """A whole number from 0 to 2**52 - 1 that the parts decide: the first 13 digits of the MD5 digest of their texts.

    Random starts, picks and samples come from this, so they are the same wherever and however often they are
    computed, and other engines can repeat them. Parts are joined by slashes; nulls count as empty.
    """
    text = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def drawn_share(*parts: Column) -> Column:
    """A number from 0 up to 1 that the parts decide."""
    return drawn(*parts) / F.lit(float(1 << DRAW_BITS))


def hex_modulus(digest: Column, modulus: int) -> Column:
    """Remainder of a hexadecimal number of any length; NULL for one without digits.

    The digits are folded in seven at a time, which stays inside 64-bit arithmetic.
    """
    powers = F.array(*[F.lit(16**n) for n in range(8)])

    def fold(rest: Column, at: Column) -> Column:
        digits = F.substring(digest, at, F.lit(7))
        return (rest * F.get(powers, F.length(digits)) + F.conv(digits, 16, 10).cast("bigint")) % modulus

    starts = F.sequence(F.lit(1), F.length(digest), F.lit(7))
    folded = F.aggregate(starts, F.lit(0).cast("bigint"), fold)
    return F.when(F.length(digest) > 0, folded.cast("int"))


def stem_bucket(stem: Column, modulus: int = 20) -> Column:
    """Stable bucket of a name, from its SHA-1."""
    digest = F.sha1(stem)
    # Forty digits, always: each stretch of seven counts by what its last digit is worth.
    stretches = [(at, min(7, 40 - at)) for at in range(0, 40, 7)]
    worth = [F.conv(F.substring(digest, at + 1, n), 16, 10).cast("bigint") * pow(16, 40 - at - n, modulus) for at, n in stretches]
    return (sum(worth[1:], worth[0]) % modulus).cast("int")


def prefix_bucket(digest: Column, modulus: int = 8) -> Column:
    """Stable bucket from the first eight digits of a digest."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % modulus).cast("int")


def cache_key(simfile: Column) -> Column:
    """Digest naming the features of a song."""
    return F.sha1(simfile)


def round_half_even(value: Column, digits: int) -> Column:
    """Round the way the text formats print numbers."""
    return F.bround(value, digits)


def log_odds(rate: Column, floor: float = 1e-4) -> Column:
    """Log odds of a rate kept away from 0 and 1."""
    kept = F.least(F.greatest(rate, F.lit(floor)), F.lit(1.0 - floor))
    return F.log(kept / (F.lit(1.0) - kept))


def circular_parabola(before: Column, peak: Column, after: Column) -> Column:
    """Sub-bin shift of a peak from its two neighbours."""
    curve = before - F.lit(2.0) * peak + after
    return F.when(curve == 0, F.lit(0.0)).otherwise(F.lit(0.5) * (before - after) / curve)


def frame_rate(sample_rate: float = 22050.0, hop: int = 128) -> float:
    """Frames per second of an envelope."""
    return sample_rate / hop


def tempo_candidates(low: float = 60.0, high: float = 300.0, step: float = 1.002) -> int:
    """How many tempi a scan from ``low`` to ``high`` tries."""
    return int(math.log(high / low) / math.log(step)) + 1
