"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear support vector machine.

The kernel compares words by their letter triples in order, gaps allowed: a triple whose letters span
s places weighs DECAY**s. Letters are folded first (case, accents, look-alikes, digits that stand for
letters); letters that are not Latin then share OTHERS further codes. Other characters fall out of a
word, so inserted characters cost little or nothing. Scripts without spaces are read in windows of
WINDOW characters, of two codes each. Each word begins with a mark. A text is as toxic as its two worst words on average, so that a chance likeness does not
count for much.

The machine is linear in kernel values with landmark words, and these are linear in a word's triples;
so what a trained model needs at scoring time is one weight for each letter triple.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm import spans
from tactus.llm.shared import small_batches

DECAY, REACH = 0.75, 6
#: Labelled rows that a model is fitted on, at most; half of each class as far as there are enough.
FIT_ROWS = 4000
LANDMARKS, NEGATIVES = 240, 10_000
#: Rounds in which each toxic text's witness word is chosen anew.
ROUNDS = 2
#: Codes of letters: 0 is none, 1-26 are a-z, the next OTHERS are shared by the letters of other scripts and
#: the last one stands before every word.
OTHERS = 16
LETTERS, FRONT = 28 + OTHERS, 27 + OTHERS
#: Characters of a word in scripts without spaces.
WINDOW = 4
#: Letters of a stem, and the log ratio from which a stem tells toxic texts from others.
STEMS, LIFT = (4, 5, 6), 1.8

#: Share of toxic texts that scores are meant for.
TOXIC_SHARE = 0.4

#: Letter codes of bytes: 1-26 for a-z, digits and signs as the letters they stand for, else 0.
CODE = np.zeros(256, np.uint8)
CODE[0x61:0x7B] = CODE[0x41:0x5B] = np.arange(1, 27)
for _sign, _letter in zip("0134578@$", "oieastbas", strict=True):
    CODE[ord(_sign)] = ord(_letter) - 96
#: Letter codes of the second byte of U+00C0 to U+00FF.
FOLDED = np.zeros(256, np.uint8)
for _letter, _folds in {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõöø", "s": "ß", "u": "ùúûü", "y": "ýÿ"}.items():
    for _c in _folds + _folds.upper():
        if 0xC0 <= ord(_c) <= 0xFF:
            FOLDED[0x80 + ord(_c) - 0xC0] = ord(_letter) - 96
#: Letters that look like Latin ones or are Latin without a decomposition.
ALIKE = dict(zip("авеёкмнорстухіјѕԁһԛԝαβεικνορτυχγđłħıŧŋøɑɡ", "abeekmhopctyxijsdhqwabeikvoptuxydlhitnoag", strict=True)) | {"œ": "oe", "æ": "ae", "ĳ": "ij"}
#: Scripts without spaces: Thai to Tibetan, Burmese, Khmer, kana and Han.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


@cache
def _folded(point: int) -> tuple[int, int, int, bool]:
    """Up to three letter codes of a character from U+0100 on, and whether its script has no spaces."""
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(point)).casefold())
    first = ord(plain[0]) if plain else 0
    if any(a <= first <= b for a, b in UNSPACED):
        if unicodedata.category(plain[0])[0] not in "LM":
            return 0, 0, 0, False
        return 27 + first % OTHERS, 27 + first // OTHERS % OTHERS, 0, True
    out = []
    for c in "".join(ALIKE.get(c, c) for c in plain):
        kind = unicodedata.category(c)
        if ord(c) < 0x100:
            out.append(int(CODE[ord(c)] if ord(c) < 0xC0 else FOLDED[ord(c) - 0x40]))
        elif kind[0] == "L" and c != "\u0640" or kind in ("Mn", "Mc") and 0x0900 <= ord(c) < 0x1A00:  # signs of vowels
            out.append(27 + ord(c) % OTHERS)
    one, two, three = ([x for x in out if x] + [0, 0, 0])[:3]
    return one, two, three, False


def _others(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Put the codes of characters from U+0100 on into their bytes' places; where a script has no spaces."""
    unspaced = np.zeros(len(data), bool)
    lead = np.flatnonzero(data >= 0xC4)
    if not len(lead):
        return unspaced
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    point = data[lead].astype(np.int64) & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for i in (1, 2, 3):
        more = size > i
        point[more] = point[more] << 6 | data[lead[more] + i] & 0x3F
    kinds, of = np.unique(point, return_inverse=True)
    table = np.array([_folded(int(c)) for c in kinds])
    for i in range(3):
        fits = size > i
        codes[lead[fits] + i] = table[of[fits], i]
        unspaced[lead[fits] + i] = table[of[fits], 3]
    return unspaced


def _windowed(begin: np.ndarray, stop: np.ndarray, doc: np.ndarray, unspaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut where scripts with and without spaces meet; the latter in every window of WINDOW characters."""
    turns = np.flatnonzero(unspaced[1:] != unspaced[:-1]) + 1
    of = np.searchsorted(begin, turns, "right") - 1
    inside = (begin[of] < turns) & (turns < stop[of])
    turns, of = turns[inside], of[inside]
    begin, stop, doc = np.append(begin, turns), np.append(stop, np.zeros(len(turns), stop.dtype)), np.append(doc, doc[of])
    order = np.argsort(begin, kind="stable")
    cut = np.zeros(len(begin), bool)
    cut[len(cut) - len(turns) :] = True
    ends = stop.copy()
    begin, stop, doc, cut = begin[order], ends[order], doc[order], cut[order]
    word = np.maximum.accumulate(np.where(cut, 0, np.arange(len(begin))))
    stop = np.where(np.append(cut[1:], False), np.append(begin[1:], 0), stop[word])
    open_ = unspaced[begin]
    count = np.where(open_, np.maximum(1, (stop - begin) // 2 - WINDOW + 1), 1)
    which = np.repeat(np.arange(len(begin)), count)
    at = begin[which] + 2 * (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
    return at, np.where(open_[which], np.minimum(at + 2 * WINDOW, stop[which]), stop[which]), doc[which]


def _letters(block: spans.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes end to end; start and end of every word in them; the word's text.

    Single letters in a row, such as those of a word spelled out, make one word.
    """
    data = block.data
    codes = CODE[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    codes[after] = FOLDED[data[after]]
    unspaced = _others(data, codes)
    start, end, doc = block.words()
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(codes > 0, out=count[1:])
    begin, stop = count[start], count[end]
    inked = stop > begin
    begin, stop, doc = begin[inked], stop[inked], doc[inked]
    unspaced = unspaced[codes > 0]
    single = stop - begin == 1
    if unspaced.any():
        single |= (stop - begin == 2) & unspaced[begin]
    joins = np.zeros(len(begin), bool)
    joins[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~joins)
    last = np.append(first[1:], len(begin)) - 1
    begin, stop, doc = begin[first], stop[last] if len(begin) else stop, doc[first]
    if unspaced.any():
        begin, stop, doc = _windowed(begin, stop, doc, unspaced)
    return *_fronted(codes[codes > 0], begin, stop), doc


def _fronted(letters: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words end to end, each after the code FRONT."""
    size = stop - begin
    end = np.cumsum(size + 1)
    out = np.full(int(end[-1]) if len(end) else 0, FRONT, np.uint8)
    ramp = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(end - size, size) + ramp] = letters[np.repeat(begin, size) + ramp]
    return out, end - size - 1, end


def _triples(letters: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word number, triple code, weight) for every pattern of gaps within reach."""
    size = stop - begin
    of = np.repeat(np.arange(len(begin)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    room = np.repeat(stop, size) - at
    codes = letters.astype(np.int32)
    for wide in range(2, REACH):
        fits = room > wide
        at, of, room = at[fits], of[fits], room[fits]
        outer = codes[at] * (LETTERS * LETTERS) + codes[at + wide]
        for mid in range(1, wide):
            yield of, outer + codes[at + mid] * LETTERS, DECAY ** (wide + 1)


def _kernel_parts(letters: np.ndarray, begin: np.ndarray, stop: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the weighted sum over its triples, and its norm."""
    total, square = np.zeros(len(begin)), np.zeros(len(begin))
    for of, code, w in _triples(letters, begin, stop):
        total += np.bincount(of, weights[code], len(begin)) * w
        square += np.bincount(of, minlength=len(begin)) * (w * w)
    return total, np.sqrt(square)


def _encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = [np.array([ord(c) - 96 for c in w], np.uint8) for w in words]
    stop = np.cumsum([len(x) for x in lists])
    return _fronted(np.concatenate(lists), stop - [len(x) for x in lists], stop)


def _features(words: list[str]) -> np.ndarray:
    """A row of normed triple weights for each word."""
    letters, begin, stop = _encoded(words)
    out = np.zeros((len(words), LETTERS**3), np.float32)
    for of, code, w in _triples(letters, begin, stop):
        np.add.at(out, (of, code), w)
    square = np.zeros(len(words))
    for of, _, w in _triples(letters, begin, stop):
        square += np.bincount(of, minlength=len(words)) * (w * w)
    out /= np.maximum(np.sqrt(square), 1e-9)[:, None].astype(np.float32)
    return out


def _parts(words: list[str]) -> Iterator[np.ndarray]:
    """The rows of ``_features``, 32 words (11 MB) at a time."""
    for at in range(0, len(words), 32):
        yield _features(words[at : at + 32])


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-6, steps: int = 60) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps that halve until the loss falls; the last column of ``x`` is 1."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9

    def loss(v: np.ndarray) -> float:
        return float(weight @ np.maximum(0, 1 - y * (x @ v)) ** 2 + ridge @ v**2)

    now = loss(w)
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, ya, ca = x[active], y[active], weight[active]
        pulled = (xa * ca[:, None]).T
        step = np.linalg.solve(pulled @ xa + np.diag(ridge), pulled @ ya) - w
        del xa, pulled
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        before, w = now, w + size * step
        now = loss(w)
        if before - now < 1e-6 * before:
            break
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Model:
    """One weight for each letter triple, the bias, and the scale that turns margins to scores."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, letters: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        total, norm = _kernel_parts(letters, begin, stop, self.weights)
        return np.where(norm > 0, total / np.maximum(norm, 1e-9), 0.0) + self.bias

    def text_margins(self, block: spans.Block) -> np.ndarray:
        letters, begin, stop, doc = _letters(block)
        margins = self.margins(letters, begin, stop)
        order = np.lexsort((margins, doc))
        ends = np.searchsorted(doc, np.arange(block.docs), "right")
        worst = np.full(block.docs, self.bias)
        sizes = np.diff(np.concatenate([[0], ends]))
        some, more = sizes > 0, sizes > 1
        worst[some] = (margins[order[ends[some] - 1]] + self.bias) / 2
        worst[more] = (margins[order[ends[more] - 1]] + margins[order[ends[more] - 2]]) / 2
        return worst

    def score(self, block: spans.Block) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.text_margins(block) + self.shift, -30, 30)))


def _blocks(texts: list[str]) -> Iterator[spans.Block]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for _, block in spans.blocks(iter([batch]), "text"):
        yield block


def _words(text: str) -> list[str]:
    letters, begin, stop, _ = _letters(spans.Block(pa.array([text])))
    flat = "".join(map(chr, letters + 96))
    return [flat[a + 1 : b] for a, b in zip(begin, stop, strict=True) if b - a > 3]


def _counted(arrays: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of all arrays and how often each comes, taking in 32 arrays at a time."""
    values = counts = np.zeros(0, np.int64)
    while some := list(islice(arrays, 32)):
        times = np.concatenate([counts, np.ones(sum(map(len, some)), np.int64)])
        values, of = np.unique(np.concatenate([values, *some]), return_inverse=True)
        counts = np.bincount(of, times).astype(np.int64)
    return values, counts


def _telling(bags: list[list[str]], toxic: list[int], sizes: dict[int, int]) -> dict[int, float]:
    """Weight of each stem, by its hash, that sets toxic texts apart: its log ratio times its texts."""
    stems, counts = _counted(np.unique(np.array([hash(p) for w in bag for p in _stems(w)], np.int64)) for bag, y in zip(bags, toxic, strict=True) if y)
    often = counts >= max(4, sizes[1] // 100)
    stems, counts = stems[often], counts[often]
    known = set(stems.tolist())
    clean: Counter = Counter()
    for bag, y in zip(bags, toxic, strict=True):
        if not y:
            clean.update({h for w in bag for p in _stems(w) if (h := hash(p)) in known})
    lift = {h: np.log(n / sizes[1]) - np.log((clean[h] + 0.5) / sizes[0]) for h, n in zip(stems.tolist(), counts.tolist(), strict=True)}
    return {h: float(lift[h] * n) for h, n in zip(stems.tolist(), counts.tolist(), strict=True) if lift[h] > LIFT}


def _diverse(words: list[str], most: int, alike: float = 0.6) -> list[str]:
    """The first words of the list of which none is much like an earlier one."""
    out: list[str] = []
    kept = np.zeros((most, LETTERS**3), np.float32)
    words = words[: -(-20 * most // 200) * 200]
    for word, v in zip(words, (v for part in _parts(words) for v in part), strict=True):
        if len(out) < most and (not out or (kept[: len(out)] @ v).max() < alike):
            kept[len(out)] = v
            out.append(word)
    return out


def _maps(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The triples that the landmarks have, and what each adds to the Nystroem features."""
    some = np.zeros(LETTERS**3, bool)
    for part in _parts(landmarks):
        some |= part.any(0)
    used = np.flatnonzero(some)
    base = np.concatenate([part[:, used] for part in _parts(landmarks)])
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    top = values > 1e-3
    return used, (base.T @ (vectors[:, top] / np.sqrt(values[top]))).astype(np.float32)


def _stems(word: str) -> list[str]:
    """Runs of letters, also those that begin the word; a short word as a whole."""
    word = "^" + word
    return list({word[i : i + n] for n in STEMS for i in range(len(word) - n + 1)}) or [word]


def _gapped(word: str, rng: np.random.Generator) -> list[str]:
    """The word with one and with two letters put in."""
    out = []
    for times in (1, 2):
        w = word
        for _ in range(times):
            at = int(rng.integers(1, len(w)))
            letter = int(rng.integers(26))
            w = w[:at] + chr(97 + letter if max(w) <= "z" else 123 + letter % OTHERS) + w[at:]
        out.append(w)
    return out


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fit a model on texts that are labelled as a whole.

    Words with a stem that sets toxic texts apart are witnesses and, with common words, the landmarks. The machine
    is trained on the witnesses, plain and with letters put in, against words of the other texts. In
    each round, toxic texts without a witness name their worst word, and clean texts name theirs as
    further negatives.
    """
    pool: dict[str, str] = {}  # a word is held once, however many texts have it
    bags = [sorted({pool.setdefault(w, w) for w in _words(t)}) for t in texts]
    del pool
    held = {1: Counter(), 0: Counter()}
    for bag, y in zip(bags, toxic, strict=True):
        held[y].update(bag)
    sizes = {y: max(1, sum(t == y for t in toxic)) for y in (0, 1)}
    telling = _telling(bags, toxic, sizes)
    rank = {w: max((telling.get(hash(p), 0.0) for p in _stems(w)), default=0.0) for w in held[1]}
    marked = sorted((w for w in rank if rank[w] and held[0][w] * sizes[1] * 4 < held[1][w] * sizes[0]), key=lambda w: (-rank[w], -held[1][w], w))
    common = [w for w, _ in sorted(held[0].items(), key=lambda x: (-x[1], x[0])) if not rank.get(w)]
    if not marked or not common:
        return Model(np.zeros(LETTERS**3), -1.0, 4.0, 0.0)
    landmarks = list(dict.fromkeys(_diverse(marked, LANDMARKS // 2) + common[: LANDMARKS // 4]))
    rng = np.random.default_rng(7)
    rest = sorted(w for w in held[0] if w not in held[1])
    negatives = {*common[:2000], *(rest[i] for i in rng.choice(len(rest), min(len(rest), NEGATIVES), replace=False))}
    known = set(marked)
    extra: list[str] = []
    for turn in range(ROUNDS):
        used, maps = _maps(landmarks)
        hits = Counter({w: held[1][w] for w in marked})
        hits.update(extra)
        negatives -= set(hits)
        plain = [w for w, _ in hits.most_common()]
        bent = [v for w in plain[:200] for v in _gapped(w, rng)]
        words = plain + bent + sorted(negatives)
        x = np.ones((len(words), maps.shape[1] + 1))
        for i in range(0, len(words), 128):
            x[i : i + 128, :-1] = np.concatenate([part[:, used] for part in _parts(words[i : i + 128])]) @ maps
        y = np.where(np.arange(len(words)) < len(plain) + len(bent), 1.0, -1.0)
        pull = np.array([float(hits[w]) for w in plain] + [hits[w] / 4.0 for w in plain[:200] for _ in (1, 2)] + [1.0] * len(negatives))
        pull[y > 0] *= (pull[y < 0].sum() / pull[y > 0].sum()) / 4
        w, bias = _machine(x, y, pull / len(words))
        del x
        weights = np.zeros(LETTERS**3)
        weights[used] = maps.astype(np.float64) @ w
        model = Model(weights, bias, 4.0, 0.0)
        if turn < ROUNDS - 1:
            unmarked = [bag for bag, t in zip(bags, toxic, strict=True) if t and bag and not known.intersection(bag)]
            margins = _margins(model, {w for bag in unmarked for w in bag})
            extra = [max(bag, key=lambda w: (margins[w], w)) for bag in unmarked]
            margins = _margins(model, (w for w in held[0] if w not in held[1]))
            worst_first = sorted(margins, key=lambda w: (-margins[w], w))
            negatives.update(worst_first[:3000])
            landmarks = list(dict.fromkeys(landmarks + _diverse(worst_first[:1000], LANDMARKS // 4)))
    top = np.concatenate([model.text_margins(b) for b in _blocks(texts)])
    slope, shift = _scale(top, np.array(toxic, float))
    return Model(model.weights, model.bias, slope, shift)


def _margins(model: Model, words: Iterable[str]) -> dict[str, float]:
    """The margin of each word, taken 4,096 words at a time."""
    words, out = sorted(words), {}
    for at in range(0, len(words), 4096):
        part = words[at : at + 4096]
        out.update(zip(part, model.margins(*_encoded(part)).tolist(), strict=True))
    return out


def _scale(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, toxic texts weighing TOXIC_SHARE in all."""
    weight = np.where(y > 0, TOXIC_SHARE / max(1, y.sum()), (1 - TOXIC_SHARE) / max(1, (1 - y).sum()))
    x = np.stack([margin, np.ones(len(margin))], 1)
    ridge = np.array([1e-4, 1e-6])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge @ v**2)

    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 2 * ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(2 * ridge), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(w[0]), 0.5), float(w[1])


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Train on at most ``fit_rows`` labelled rows that are not held out, chosen by a hash of the id.

    The chosen rows meet in one task, so that neither they nor their words are held by the driver; it gets the
    model (0.7 MB).
    """
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = []
    for y in (1, 0):
        mine = rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2)
        picks.append(mine)
    chosen = F.broadcast(picks[0].unionByName(picks[1]))  # at most fit_rows rows
    found = docs.select("doc_id", "text").join(chosen, "doc_id").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        toxic: list[int] = []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        model = train(texts, [int(y) for y in toxic])
        yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "bias": model.bias, "slope": model.slope, "shift": model.shift}])

    ordered = found.select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions("doc_id", "text")
    models = ordered.mapInArrow(run, "weights binary, bias double, slope double, shift double").collect()
    # Spark may leave out a step over no rows.
    return Model(np.frombuffer(models[0]["weights"]), *models[0][1:]) if models else train([], [])


def toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` (score at or over ``threshold``) for each row.

    Only the text counts. Null and empty texts have the score of the bias. Rows are scored one by one
    without a shuffle: repeated rows and null ids stay, other columns are not looked at, an empty table
    gives an empty result. Memory is bounded by ``spans.BLOCK_BYTES`` or one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in spans.blocks(batches, "text"):
            score = model.score(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_column, "score", "predicted"])

    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column].alias(id_column), docs[text_column].alias("text")).mapInArrow(run, f"`{id_column}` {id_type}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, as they are."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in spans.blocks(batches, text_column):
            yield batch.filter(pa.array(model.score(block) < threshold))

    return docs.mapInArrow(run, docs.schema)
