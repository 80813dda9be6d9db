"""Toxicity by a string-kernel support vector machine.

Two words are alike as far as they share subsequences of three and four signs (letters, begin and end), spread over five places at most and
weighing less for every place skipped: letters put into an insult, taken out or doubled leave most of them. The
kernel is taken to landmark words only (Nystroem), and a linear support vector machine is trained in that space. A
text is as toxic as its most toxic word or pair of words, while labels are known for whole
texts: so training alternates between choosing the telling word of each toxic text and fitting (mi-SVM).

Two words that stand close, with `GAP` others between them at most, are looked at in two ways. As halves of one toxic word
("snot wagon") they are read without their blank, by the same machine, where their letters are those of a telling word cut in two. As an
insult that neither word is alone, pairs have a machine of their own: the kernel of two pairs is the product of the kernels of their first and of their second words, weighing less for
every word between, so that letters and words put in are tolerated. Its landmarks are pairs that toxic texts without a toxic word share.

As every landmark is a weighted sum of subsequences, so is the trained machine: it comes down to one number per
subsequence, and scoring a word is a sum over its own.

The machines are fitted on a bounded sample, at most `per_class` labelled texts of each class, the first by a hash of
their ids, with at most `PAIRS` landmarks of either kind of pair. Scores go to all texts, whole.

Edge cases: null and empty texts, and texts without a word of letters, score as a text of one neutral word. Labels
that are null are ignored; a text with several labels is toxic if one says so. Without texts of both classes every
score is 0.0 (or 1.0, if only toxic ones are labelled). Rows of equal text score equally; an empty table gives no
rows. Blanks between single letters, marks inside words and digits that stand for letters are undone first.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import bounded_batches, strings, whole
from docvec.scratch import staged

PER_CLASS = 2_000
LANDMARKS_TOXIC, LANDMARKS_CLEAN, LANDMARKS_HARD = 192, 64, 128
NEGATIVES = 8_000
DECAY = 0.6
ROUNDS = 3
ENRICHED = 2.5  # logarithm of how many times more often a telling word stands in toxic texts
CUT = 5.0  # the same for words whose halves are looked for
LONGEST = 48  # letters of a word compared at once; a longer one is looked at in overlapping parts
KEPT_WORDS = 50_000  # a worker keeps their margins, some 250 bytes each
BLOCK = 2_000  # words whose features are worked on at once
GAP = 2  # words that may stand between the two of a pair
NEAR = 0.4  # kernel value from which a word counts as one of a landmark pair
PAIRS = 128
CANDIDATES = 1_000
# Digits and signs that are read as letters.
READ_AS = [("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("@", "a"), ("$", "s")]
_OTHER = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]?\s){3,}\w(?!\w)")
_SIGNS = 42  # 0 parts words, 1 begins and ends one, 2-27 are a-z, the rest are shared by all other letters
_STEPS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a + b <= 4] + [(1, 1, 1), (2, 1, 1), (1, 2, 1), (1, 1, 2)]
_SPACE = _SIGNS**3 + _SIGNS**4
_WEIGHTS = DECAY ** np.arange(4)
TOGETHER = (1 << 32) // (4 * _SPACE)  # words whose keys have 32 bits


def read(text: str) -> tuple[list[str], set[str]]:
    """Words as they are written, in order, and distinct ones, with words spelled with blanks read together."""
    plain = text.lower()
    for sign, letter in READ_AS:  # several times faster than str.translate, which takes letters beyond ASCII one at a time
        plain = plain.replace(sign, letter)
    order = plain.split()
    found = set(order)
    for m in _SPACED.finditer(plain):
        found.add("".join(m[0].split()))
    return order, found


def words_of(text: str) -> set[str]:
    return read(text)[1]


def close_pairs(words: list[str]) -> set[tuple[str, str]]:
    """Pairs of bare words with at most GAP words between them."""
    some = [bare(w) for w in words]
    return {p for gap in range(GAP + 1) for p in zip(some, some[gap + 1 :], strict=False) if min(map(len, p)) > 1 and max(map(len, p)) <= LONGEST}


def bare(word: str) -> str:
    return word if word.isalpha() else _OTHER.sub("", word)


def bare_all(words: list[str]) -> list[str]:
    return [w if w.isalpha() else _OTHER.sub("", w) for w in words]


_signs = np.array([0, 1, *((o - 95 if 97 <= o <= 122 else 28 + o % (_SIGNS - 28)) for o in range(2, 128))], dtype=np.int64)


def signs(text: str) -> np.ndarray:
    """The sign of each letter; 0 and 1 stay."""
    if text.isascii():
        return _signs[np.frombuffer(text.encode("ascii"), dtype=np.uint8)]
    o = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where(o < 128, _signs[np.minimum(o, 127)], 28 + o % (_SIGNS - 28))


def parts(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - 4, LONGEST - 4)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, subsequence and weight of all subsequences of all words, each word scaled to length 1."""
    some = [_subsequences(words[s : s + TOGETHER], s) for s in range(0, len(words), TOGETHER)]
    if not some:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*some, strict=True))


def _subsequences(words: list[str], number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of TOGETHER words at most, whose numbers begin with `number`: keys of 32 bits, which stay in the cache."""
    line = signs("\x01" + "\x01\x00\x01".join(words) + "\x01\x00").astype(np.uint32)
    stop = line == 0
    owner = np.cumsum(stop, dtype=np.uint32)
    owner -= stop
    # what the signs at 0, 1, 2 and 3 places from the end of a subsequence add to its number, then the words' part of a key
    power = [line * np.uint32(_SIGNS**i * 4) for i in range(4)]
    owned = owner * np.uint32(_SPACE * 4)
    keys = []
    for steps in _STEPS:
        at = list(accumulate(steps, initial=0))
        n = len(line) - at[-1]
        if n <= 0:
            continue
        key = owned[:n] + np.uint32((_SIGNS**3 if len(steps) == 3 else 0) * 4 + at[-1] - len(steps))
        for i, back in zip(at, range(len(steps), -1, -1), strict=True):
            key += power[back][i : i + n]
        # from a word's sign to one of the same word, whose stop is behind it: no stop lies between
        keys.append(key[(owner[:n] == owner[at[-1] :]) & ~stop[at[-1] :]])
    key = np.concatenate(keys) if keys else np.empty(0, np.uint32)
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    key.sort()
    found = key >> np.uint32(2)
    begin = np.flatnonzero(np.concatenate((np.ones(1, dtype=bool), found[1:] != found[:-1])))
    value = np.add.reduceat(_WEIGHTS[key & np.uint32(3)], begin)
    found = found[begin]
    word = found // np.uint32(_SPACE)
    code = (found - word * np.uint32(_SPACE)).astype(np.int64)
    word = word.astype(np.int64)
    norm = np.sqrt(np.bincount(word, weights=value * value, minlength=len(words)))
    value /= norm[word]
    word += number
    return word, code, value


def sums_of(words: list[str], tables: list[np.ndarray]) -> list[np.ndarray]:
    """What the subsequences of each word weigh in each table, which has a place for every one; words beyond LONGEST are taken as empty."""
    out = [np.zeros(len(words)) for _ in tables]
    for s in range(0, len(words), TOGETHER):
        some = words[s : s + TOGETHER]
        if max(map(len, some)) > LONGEST:
            some = [w if len(w) <= LONGEST else "" for w in some]
        word, code, value = subsequences(some)
        for sums, table in zip(out, tables, strict=True):
            sums[s : s + TOGETHER] = np.bincount(word, weights=value * table[code], minlength=len(some))
    return out


def independent(kernel: np.ndarray) -> np.ndarray:
    """The directions in which landmarks with these kernel values are independent, each scaled to length 1."""
    root, basis = np.linalg.eigh(kernel)
    return basis[:, root > 1e-6] / np.sqrt(root[root > 1e-6])


class Kernel:
    """Words to which kernels are taken."""

    def __init__(self, words: list[str]) -> None:
        word, code, value = subsequences(words)
        self.codes, at = np.unique(code, return_inverse=True)
        self.table = np.zeros((len(self.codes) + 1, len(words)))  # the last row is for all other subsequences
        self.table[at, word] = value

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel values of words with the landmarks."""
        out = np.zeros((len(words), self.table.shape[1]))
        for first in range(0, len(words), 2_000):
            word, code, value = subsequences(words[first : first + 2_000])
            near = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[near] == code
            word, value, near = word[known] + first, value[known], near[known]
            for s in range(0, len(word), 5_000):  # each step holds a row of the table per subsequence
                at = word[s : s + 5_000]
                begin = np.flatnonzero(np.concatenate((np.ones(1, dtype=bool), at[1:] != at[:-1])))
                out[at[begin]] += np.add.reduceat(value[s : s + 5_000, None] * self.table[near[s : s + 5_000]], begin, axis=0)
        return out


class Landmarks(Kernel):
    """Landmark words, and the directions in which they are independent."""

    def __init__(self, words: list[str]) -> None:
        super().__init__(words)
        self.whiten = independent(self.kernel(words))

    def features(self, words: list[str]) -> np.ndarray:
        """A row per word; the last column is 1, for the bias."""
        out = np.ones((len(words), self.whiten.shape[1] + 1))
        for s in range(0, len(words), BLOCK):
            out[s : s + BLOCK, :-1] = self.kernel(words[s : s + BLOCK]) @ self.whiten
        return out

    def collapsed(self, w: np.ndarray) -> np.ndarray:
        """What each subsequence of the landmarks counts in the direction w."""
        return self.table[:-1] @ (self.whiten @ w)


def altered(word: str) -> list[str]:
    """The word with a letter doubled, and with a foreign letter put in, at each inner place."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in (word[i - 1], chr(97 + (7 * i + len(word)) % 26))]


def telling_words(bags: list[list[str]], odds: dict[str, float], cover: int = 3) -> list[str]:
    """Few words that between them stand in every toxic text `cover` times, if they can, most useful first.

    What copies of one toxic text share is not chosen, since the words that they share with other toxic texts
    cover them already.
    """
    where: dict[str, list[int]] = {}
    for i, bag in enumerate(bags):
        for w in bag:
            if odds[w] >= ENRICHED:
                where.setdefault(w, []).append(i)
    left = np.full(len(bags), cover)
    least = max(3, len(bags) // 100)
    gains = [(-len(at), w) for w, at in where.items() if len(at) >= least]
    heapq.heapify(gains)
    chosen = []
    while gains:
        _, w = heapq.heappop(gains)
        now = int((left[where[w]] > 0).sum())  # gains only fall, so the head of the heap is checked again
        if now < least:
            continue
        if gains and (-now, w) > gains[0]:
            heapq.heappush(gains, (-now, w))
            continue
        chosen.append(w)
        left[where[w]] -= 1
    return chosen


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-6) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps on the rows inside the margin; the last column of x is 1, its entry the bias."""
    reg = penalty * weight.sum() * np.eye(x.shape[1])
    reg[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    inside = np.ones(len(x), dtype=bool)
    for _ in range(30):
        square, right = reg.copy(), np.zeros(x.shape[1])
        for s in range(0, len(x), BLOCK):
            within = inside[s : s + BLOCK]
            rows = x[s : s + BLOCK][within]
            a = rows * weight[s : s + BLOCK][within, None]
            square += a.T @ rows
            right += a.T @ y[s : s + BLOCK][within]
        w = np.linalg.solve(square, right)
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


@dataclass
class Near:
    """The landmark pairs whose first and whose second word a word is close to, as bits, and its kernel values."""

    first: int
    second: int
    kernel: np.ndarray


def _bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


class Phrases:
    """Landmark pairs: halves of toxic words, and pairs that are toxic together, with their support vector machine."""

    def __init__(self, halves: list[tuple[str, str]], told: list[tuple[str, str]], weights: np.ndarray | None = None, bias: float = -1.0) -> None:
        self.halves, self.told = halves, told
        self.weights, self.bias = np.zeros(len(told)) if weights is None else weights, bias
        self._kernel: Kernel | None = None
        self.words = list(dict.fromkeys(w for p in told for w in p))
        number = {w: i for i, w in enumerate(self.words)}
        self.first, self.second = np.array([[number[w] for w in p] for p in told], dtype=np.int64).reshape(-1, 2).T
        self._half: dict[str, tuple[int, int]] = {}
        for i, p in enumerate(halves):
            for side, w in enumerate(p):
                bits = list(self._half.get(w, (0, 0)))
                bits[side] |= 1 << i
                self._half[w] = (bits[0], bits[1])

    def __reduce__(self) -> tuple:
        return Phrases, (self.halves, self.told, self.weights, self.bias)

    def bounds(self) -> np.ndarray | None:
        """A bound of each subsequence's part in any kernel value, if there are pairs that are toxic together."""
        if self.told and self._kernel is None:  # made where it is used
            self._kernel = Kernel(self.words)
            self._most = np.zeros(_SPACE, dtype=np.float32)
            self._most[self._kernel.codes] = self._kernel.table[:-1].max(axis=1, initial=0.0)
        return self._most if self.told else None

    def near(self, words: list[str], bound: np.ndarray | None = None) -> list[Near | None]:
        """For each bare word the landmark pairs that it may be half of, None if there are none. Halves of a toxic word are those as they are.

        bound: what the words' subsequences sum up to in `bounds`, if known.
        """
        out: list[Near | None] = [None] * len(words)
        for i, w in enumerate(words):
            if w in self._half:
                out[i] = Near(*self._half[w], np.zeros(len(self.words), dtype=np.float32))
        if not self.told:
            return out
        if bound is None:
            bound = sums_of(words, [self.bounds()])[0]
        some = [(i, words[i]) for i in np.flatnonzero(bound >= NEAR).tolist() if 1 < len(words[i]) <= LONGEST]
        for s in range(0, len(some), 5_000):
            part = some[s : s + 5_000]
            for (i, w), row in zip(part, self._kernel.kernel([w for _, w in part]), strict=True):
                row[row < NEAR] = 0.0
                if row.any():
                    first, second = self._half.get(w, (0, 0))
                    n = len(self.halves)
                    out[i] = Near(first | _bits(row[self.first] > 0) << n, second | _bits(row[self.second] > 0) << n, row.astype(np.float32))
        return out

    def found(self, order: list[str], near: dict[str, Near]) -> set[tuple[str, str, int]]:
        """Distinct pairs of a text, and how many words stand between, that are close to a landmark pair."""
        if not near or near.keys().isdisjoint(order):
            return set()
        out = set()
        hits = [i for i, w in enumerate(order) if w in near]
        for n, i in enumerate(hits):
            first = near[order[i]].first
            for j in hits[n + 1 : n + 2 + GAP]:
                if j - i > GAP + 1:
                    break
                common = first & near[order[j]].second
                if common >> len(self.halves) or (common and j == i + 1):
                    out.add((order[i], order[j], j - i - 1))
        return out

    def half(self, pair: tuple[str, str, int], near: dict[str, Near]) -> int:
        """The halves of toxic words that a pair is, as bits; none if words stand between."""
        common = near[pair[0]].first & near[pair[1]].second if pair[2] == 0 else 0
        return common & ((1 << len(self.halves)) - 1)

    def values(self, a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
        """Kernel values of a pair, given by those of its words, with the pairs that are toxic together."""
        return a[self.first] * b[self.second] * DECAY**gap

    def margin(self, pair: tuple[str, str, int], near: dict[str, Near]) -> float:
        """The margin of a pair, at most 1, so that the curve of scores is not drawn by how exact the pairs of the sample are."""
        if not self.told:
            return -np.inf
        return min(1.0, float(self.values(near[pair[0]].kernel, near[pair[1]].kernel, pair[2]) @ self.weights) + self.bias)

    def trained(self, negatives: list[tuple[str, str, int]], counts: dict[tuple[str, str], float]) -> Phrases:
        """Fit on the telling pairs, altered ones and ones apart, against pairs of clean texts and a pair like no landmark."""
        positive: dict[tuple[str, str, int], float] = {}
        for a, b in self.told:
            bent = [(v, b) for v in altered(a) if len(a) > 4] + [(a, v) for v in altered(b) if len(b) > 4]
            for gap in range(GAP + 1):
                positive[a, b, gap] = counts[a, b] * DECAY**gap
            for p in bent:
                positive[*p, 0] = max(positive.get((*p, 0), 0.0), counts[a, b] / (2 * len(bent)))
        negative = [p for p in negatives if p not in positive]
        rows = [*positive, *negative]
        names = list(dict.fromkeys(w for a, b, _ in rows for w in (a, b)))
        kernel = np.concatenate([Kernel(self.words).kernel(names[s : s + BLOCK]) for s in range(0, len(names), BLOCK)])
        kernel[kernel < NEAR] = 0.0
        at = {w: i for i, w in enumerate(names)}
        values = np.array([self.values(kernel[at[a]], kernel[at[b]], gap) for a, b, gap in rows] + [np.zeros(len(self.told))])
        whiten = independent(np.array([values[rows.index((a, b, 0))] for a, b in self.told]))
        y = np.array([1.0] * len(positive) + [-1.0] * (len(negative) + 1))
        weight = np.concatenate((np.fromiter(positive.values(), float), np.ones(len(negative)), [max(1.0, len(negative) / 4.0)]))
        weight[: len(positive)] *= weight[len(positive) :].sum() / (2.0 * weight[: len(positive)].sum())
        w = linear_svm(np.column_stack((values @ whiten, np.ones(len(values)))), y, weight)
        return Phrases(self.halves, self.told, whiten @ w[:-1], float(w[-1]))


@dataclass
class Model:
    """One number per subsequence, a bias, and the logistic curve that turns a text's margin into its score."""

    codes: np.ndarray
    values: np.ndarray
    bias: float
    slope: float
    shift: float
    telling: dict[str, float] = field(default_factory=dict, repr=False)  # telling words and their odds
    phrases: Phrases | None = field(default=None, repr=False)
    margins: dict[str, float] = field(default_factory=dict, repr=False)
    near: dict[str, Near] = field(default_factory=dict, repr=False)
    before: tuple[dict[str, float], dict[str, Near]] = field(default=({}, {}), repr=False)  # margins and near of words not met of late
    together: dict[tuple[str, str, int], float] = field(default_factory=dict, repr=False)
    spread: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"margins": {}, "near": {}, "before": ({}, {}), "together": {}, "spread": None}

    def word_margins(self, words: list[str]) -> np.ndarray:
        """Margins of bare words; a word of under three letters is neutral, a long one as toxic as its worst part."""
        return self.margins_and_bounds(words)[0]

    def margins_and_bounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        """The same, and bounds for `Phrases.near`, if that needs any."""
        if self.spread is None:  # a place for every subsequence there can be, made where it is used
            self.spread = np.zeros(_SPACE, dtype=np.float32)
            self.spread[self.codes] = self.values
        most = self.phrases.bounds() if self.phrases else None
        out, *rest = sums_of(words, [self.spread] if most is None else [self.spread, most])
        length = np.fromiter(map(len, words), np.int64, len(words))
        out[length < 3] = 0.0
        for i in np.flatnonzero(length > LONGEST).tolist():
            out[i] = sums_of(parts(words[i]), [self.spread])[0].max()
        return out + self.bias, rest[0] if rest else None

    def text_margins(self, texts: list[str]) -> list[float]:
        """The margin of the most toxic word, or two words, of each text."""
        out = []
        for s in range(0, len(texts), 64):
            if len(self.margins) > KEPT_WORDS // 2:  # words that come again soon stay
                self.before, self.margins, self.near = (self.margins, self.near), {}, {}
            known, (earlier, earlier_near) = self.margins, self.before
            lines = [read(t) for t in texts[s : s + 64]]
            new = list(set().union(*(words for _, words in lines)).difference(known))
            if earlier:
                again = [w for w in new if w in earlier]
                new = [w for w in new if w not in earlier]
                known.update((w, earlier[w]) for w in again)
                self.near.update((w, earlier_near[w]) for w in again if w in earlier_near)
            bares = bare_all(new)
            distinct = list(dict.fromkeys(bares))
            margins, bounds = self.margins_and_bounds(distinct)
            margin = dict(zip(distinct, margins.tolist(), strict=True))
            known.update((w, margin[b]) for w, b in zip(new, bares, strict=True))
            best = [max(map(known.__getitem__, words), default=self.bias) for _, words in lines]
            if self.phrases:
                near = {b: n for b, n in zip(distinct, self.phrases.near(distinct, bounds), strict=True) if n}
                if near:
                    self.near.update((w, near[b]) for w, b in zip(new, bares, strict=True) if b in near)
                pairs = [self.phrases.found(order, self.near) for order, _ in lines]
                both = self.pair_margins({p for found in pairs for p in found})
                best = [max(m, max(map(both.__getitem__, found), default=m)) for m, found in zip(best, pairs, strict=True)]
            out += best
            for w in [w for w in new if len(w) > LONGEST]:
                del known[w]
                self.near.pop(w, None)
        return out

    def pair_margins(self, pairs: set[tuple[str, str, int]]) -> dict[tuple[str, str, int], float]:
        """Margins of pairs of close words: as one word, where they are like halves of one, and as a pair."""
        if len(self.together) > KEPT_WORDS:
            self.together.clear()
        new = [p for p in pairs if p not in self.together]
        halves = [p for p in new if self.phrases.half(p, self.near)]
        joined = dict(zip(halves, self.word_margins([bare(a) + bare(b) for a, b, _ in halves]).tolist(), strict=True))
        self.together.update((p, max(self.phrases.margin(p, self.near), joined.get(p, -np.inf))) for p in new)
        return {p: self.together[p] for p in pairs}

    def close(self, text: str) -> set[tuple[str, str, int]]:
        """Pairs of a text that are close to landmark pairs; self.near knows their words afterwards."""
        order, words = read(text)
        self.near = {w: n for w, n in zip(words, self.phrases.near([bare(w) for w in words]), strict=True) if n}
        return self.phrases.found(order, self.near)

    def score(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's curve, with his targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.column_stack((margin, np.ones(len(margin)))), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (t - p))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(texts: list[list[str]], toxic: np.ndarray, words_needed: bool = True) -> Model:
    """Train on texts given as their distinct bare words; where no word tells, on the best there is or, unless needed, on none."""
    nothing = np.zeros(0, dtype=np.int64)
    if not toxic.any() or toxic.all():
        return Model(nothing, nothing, 0.0, 0.0, 500.0 if len(toxic) and toxic.all() else -500.0)
    in_toxic = Counter(w for t, y in zip(texts, toxic, strict=True) if y for w in t)
    in_clean = Counter(w for t, y in zip(texts, toxic, strict=True) if not y for w in t)
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    odds = {w: np.log((c + 0.5) / (n_toxic + 1)) - np.log((in_clean[w] + 0.5) / (n_clean + 1)) for w, c in in_toxic.items()}
    bags = [t for t, y in zip(texts, toxic, strict=True) if y and t]
    picked = telling_words(bags, odds)
    telling = picked[:LANDMARKS_TOXIC]
    telling += sorted((w for w in odds if w not in set(telling)), key=lambda w: (-in_toxic[w] * odds[w], w))[: LANDMARKS_TOXIC - len(telling)]
    usual = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0])) if len(w) > 3][:LANDMARKS_CLEAN]
    clean, all_toxic = sorted(in_clean), sorted(in_toxic)
    spread = clean[:: max(1, len(clean) // NEGATIVES)]
    if not picked and not words_needed:
        return Model(nothing, nothing, -1.0, 1.0, 0.0)
    witness = {w: float(in_toxic[w]) for w in picked or telling[:1]}
    hard: list[str] = []
    hardest: list[str] = []
    of: dict[str, float] = {}
    model = Model(nothing, nothing, 0.0, 1.0, 0.0)
    for _ in range(ROUNDS):
        positive = dict(witness)
        for w, c in witness.items():
            for v in altered(w) if len(w) > 4 else ():
                if v not in in_clean:
                    positive[v] = max(positive.get(v, 0.0), c / (2 * len(w)))
        negative = sorted((set(spread) | set(hard)).difference(positive))
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        weight = np.concatenate((np.fromiter(positive.values(), float), np.ones(len(negative))))
        weight[: len(positive)] *= len(negative) / (4.0 * weight[: len(positive)].sum())
        marks = Landmarks(list(dict.fromkeys([*telling, *usual, *hardest])))
        w = linear_svm(marks.features([*positive, *negative]), y, weight)
        model = Model(marks.codes, marks.collapsed(w[:-1]), float(w[-1]), 1.0, 0.0)
        del marks  # its table is large, and the next round makes another
        margins = model.word_margins(clean)
        order = np.argsort(-margins, kind="stable")
        hardest = [clean[i] for i in order[:LANDMARKS_HARD]]
        hard = sorted(set(hard) | {clean[i] for i in order[: NEGATIVES // 4]})
        of = dict(zip(all_toxic, model.word_margins(all_toxic).tolist(), strict=True)) | dict(zip(clean, margins.tolist(), strict=True))
        for bag in bags:  # the telling word of each toxic text
            told = max((x for x in bag if odds[x] >= ENRICHED and in_toxic[x] >= 3), key=lambda x: (of[x], x), default=None)
            if told is not None:
                witness.setdefault(told, float(in_toxic[told]))
    best = np.array([max((of[w] for w in t), default=model.bias) for t in texts])
    model.slope, model.shift = _logistic(best, np.where(toxic, 1, -1))
    model.telling = {w: odds[w] for w in picked}
    return model


def _halves(telling: dict[str, float]) -> list[tuple[str, str]]:
    """Telling words of six letters or more, cut in two; only such as hardly ever stand in clean texts."""
    return [(w[:i], w[i:]) for w, odds in telling.items() if odds >= CUT and 6 <= len(w) <= LONGEST for i in range(3, len(w) - 2)][:PAIRS]


def telling_pairs(sample: DataFrame, model: Model) -> dict[tuple[str, str], float]:
    """Pairs that toxic texts without a toxic word share, and clean ones don't, with their numbers of such texts."""

    @F.arrow_udf("double")
    def margin(column: pa.Array) -> pa.Array:
        return pa.array(model.text_margins(strings(column)), pa.float64())

    @F.arrow_udf("array<string>")
    def pairs(column: pa.Array) -> pa.Array:
        return pa.array([sorted(" ".join(p) for p in close_pairs(read(t)[0])) for t in strings(column)], pa.list_(pa.string()))

    rest = sample.withColumn("_margin", margin("_text")).where("_toxic <= 0 or _margin < 0").groupBy("_text").agg(F.max("_toxic").alias("_toxic"))
    size = {r["_toxic"] > 0: r["n"] for r in rest.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(True, 0), size.get(False, 0)
    least = max(5, sample.where("_toxic > 0").count() // 100)
    if n_toxic < least:
        return {}
    told = rest.select("_text", "_toxic", F.explode(pairs("_text")).alias("pair"))
    counts = told.groupBy("pair").agg(F.sum(F.expr("int(_toxic > 0)")).alias("n"), F.sum(F.expr("int(_toxic <= 0)")).alias("c"))
    odds = F.log((F.col("n") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    chosen = counts.where(F.col("n") >= least).withColumn("odds", odds).where(F.col("odds") >= ENRICHED)
    chosen = chosen.orderBy(F.desc("n"), F.desc("odds"), "pair").limit(CANDIDATES).collect()
    if not chosen:
        return {}
    # at most per_class texts, with CANDIDATES pairs at most
    kept = told.where("_toxic > 0").join(F.broadcast(sample.sparkSession.createDataFrame([(r["pair"],) for r in chosen], "pair string")), "pair")
    bags = [r["pairs"] for r in kept.groupBy("_text").agg(F.sort_array(F.collect_list("pair")).alias("pairs")).select("pairs").collect()]
    number = {r["pair"]: float(r["n"]) for r in chosen}
    picked = telling_words(bags, {r["pair"]: r["odds"] for r in chosen})[:PAIRS]
    return {tuple(p.split(" ")): number[p] for p in picked}


def _with_phrases(sample: DataFrame, model: Model, told: dict[tuple[str, str], float]) -> Model:
    """The model with landmark pairs, and the curve for the margins that they give."""
    halves = _halves(model.telling)
    if not halves and not told:
        return model
    model.phrases = Phrases(halves, list(told))

    @F.arrow_udf("array<string>")
    def shown(column: pa.Array) -> pa.Array:
        """Halves that a clean text holds as a toxic word would."""
        out = []
        for t in strings(column):
            pairs = model.close(t)
            toxic = [p for p, m in model.pair_margins(pairs).items() if m >= 0.0]
            out.append(sorted({" ".join(h) for p in toxic for i, h in enumerate(halves) if model.phrases.half(p, model.near) >> i & 1}))
        return pa.array(out, pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def like_told(column: pa.Array) -> pa.Array:
        out = []
        for t in strings(column):
            out.append(sorted({f"{bare(a)} {bare(b)} {gap}" for a, b, gap in model.close(t)}))
        return pa.array(out, pa.list_(pa.string()))

    clean = sample.where("_toxic <= 0")
    usual = {r[0] for r in clean.select(F.explode(shown("_text"))).distinct().collect()}  # PAIRS at most
    halves = [h for h in halves if " ".join(h) not in usual]
    model.phrases = Phrases(halves, list(told))
    if told:
        seen = clean.select(F.explode(like_told("_text")).alias("pair")).distinct().orderBy(F.xxhash64("pair"), "pair").limit(NEGATIVES).collect()
        negatives = [(a, b, int(gap)) for a, b, gap in (r["pair"].split(" ") for r in seen)]
        model.phrases = model.phrases.trained(negatives, told)
    if not halves and not told:
        model.phrases = None
        return model
    model.together, model.near = {}, {}

    @F.arrow_udf("double")
    def margin(column: pa.Array) -> pa.Array:
        return pa.array(model.text_margins(strings(column)), pa.float64())

    best = sample.select("_toxic", margin("_text").alias("margin")).toArrow().sort_by("margin")
    model.slope, model.shift = _logistic(best.column("margin").to_numpy(), np.where(best.column("_toxic").to_numpy() > 0, 1, -1))
    return model


def train(
    docs: DataFrame, labels: DataFrame, of_training: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Fit on labelled texts whose id passes `of_training`, a condition on the column doc_id of labels(doc_id, toxic)."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(of_training)
    known = known.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    present = docs.select(F.col(id_col).alias("_id")).distinct().join(known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")), "_id")
    order = [F.xxhash64("_id"), "_id"]
    chosen = present.where("_toxic > 0").orderBy(*order).limit(per_class).unionByName(present.where("_toxic <= 0").orderBy(*order).limit(per_class))

    @F.arrow_udf("array<string>")
    def bare_words(column: pa.Array) -> pa.Array:
        return pa.array([sorted({b for w in words_of(t) for b in parts(bare(w)) if len(b) > 2}) for t in strings(column)], pa.list_(pa.string()))

    # at most 2 * per_class rows of two numbers
    sample = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    with staged(sample.select("_id", "_toxic", "_text"), "toxicity-sample") as sample:
        found = sample.select("_id", "_toxic", bare_words("_text").alias("words")).toArrow().sort_by([("_id", "ascending")])
        words = found.column("words").combine_chunks()
        codes = words.flatten().dictionary_encode()  # so that texts share their words
        names, at = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        end = np.cumsum(words.value_lengths().to_numpy())
        texts = [[names[i] for i in some.tolist()] for some in np.split(at, end[:-1])] if len(end) else []
        toxic = found.column("_toxic").to_numpy() > 0
        del found, words, codes, names, at
        model = fit(texts, toxic, words_needed=False)
        if not toxic.any() or toxic.all():
            return model
        told = telling_pairs(sample, model)
        if not model.telling and not told:
            model = fit(texts, toxic)
        del texts
        return _with_phrases(sample, model, told)


def scored(text: Column, model: Model) -> Column:
    """The score of a text column, 0 to 1."""
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array([model.score(m) for m in model.text_margins(strings(column))], pa.float64())

    return score(F.coalesce(text.cast("string"), F.lit("")))
