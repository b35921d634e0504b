"""Similarity of strings, 0 to 100, by their longest common subsequence; as plain functions and as Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import collapse, title_key, year_of

#: Thresholds of the review rules.
QUOTE_DUPLICATE = 88.0
PAIR_THRESHOLD, QUOTE_FLOOR, DESCRIPTION_FLOOR = 70.0, 55.0, 70.0
TITLE_MATCH, TITLE_PLAUSIBLE = 92.0, 78.0
YEAR_PENALTY, YEAR_TOLERANCE = 25.0, 1


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one bit for each character of a."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """lcs() of each a with its b: the same steps for many pairs at once, in words of 64 bits. Pairs go in lots of like length."""
    sizes = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.zeros(len(a), np.int64)
    order = np.lexsort((sizes[1], (sizes[0] + 63) // 64))
    order = order[(sizes[0][order] > 0) & (sizes[1][order] > 0)]
    at = 0
    while at < len(order):
        words = int(sizes[0][order[at]] + 63) // 64
        own = order[at : at + max(1, 8192 // words)]
        own = own[(sizes[0][own] + 63) // 64 == words]
        at += len(own)
        out[own] = _lcs_lot([a[i] for i in own], [b[i] for i in own], sizes[0][own], sizes[1][own], words)
    return out


def _lcs_lot(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray, words: int) -> np.ndarray:
    codes = np.frombuffer("".join(a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, codes = np.unique(codes, return_inverse=True)
    rows, half = np.arange(len(a)), int(n.sum())
    where = np.zeros((len(a), len(kinds) + 1, words), np.uint64)
    place = np.arange(half) - np.repeat(np.cumsum(n) - n, n)
    np.bitwise_or.at(where, (np.repeat(rows, n), codes[:half], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    other = np.full((len(a), int(m.max())), len(kinds))
    other[np.repeat(rows, m), np.arange(len(codes) - half) - np.repeat(np.cumsum(m) - m, m)] = codes[half:]
    return n - _left_over(n, words, (where[rows, other[:, j]] for j in range(other.shape[1])), len(a))


def _left_over(n: np.ndarray, words: int, hits: Iterable[np.ndarray], lanes: int) -> np.ndarray:
    """How many letters of the first string of each lane are in no longest common subsequence. hits: for each letter of the second
    strings, where it stands in the first."""
    row = np.full((lanes, words), ~np.uint64(0))
    for where in hits:
        hit = row & where
        total = row + hit
        if words > 1:
            over = total < row
            for k in range(1, words):
                total[:, k] += over[:, k - 1]
                over[:, k] |= over[:, k - 1] & (total[:, k] == 0)
        row = total | (row & ~hit)
    bits = np.clip(n[:, None] - 64 * np.arange(words), 0, 64)
    full = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(row & full).sum(1).astype(np.int64)


#: Pairs whose bits are held side by side.
LOT = 16_384


def lcs_pairs(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """lcs() of a[i] with b[j] for pairs of places of two lists: where the letters of each a stand is written once, not for each pair.
    Pairs go fastest in order of i."""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    codes = np.frombuffer("".join(a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, codes = np.unique(codes, return_inverse=True)
    half = int(n.sum())
    return _lcs_coded(codes[:half], n, codes[half:], m, len(kinds) + 1, i, j, LOT)


def _lcs_coded(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, size: int, i: np.ndarray, j: np.ndarray, lot: int) -> np.ndarray:
    """lcs_pairs() of strings of numbers below size - 1, which lie one after the other, n and m long."""
    where = np.zeros((int(n.max(initial=0) + 63) // 64, len(n) * size), np.uint64)
    place = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    np.bitwise_or.at(where, (place // 64, np.repeat(np.arange(len(n)), n) * size + a), np.uint64(1) << (place % 64).astype(np.uint64))
    letters = np.full((int(m.max(initial=0)), len(m)), size - 1)
    letters[np.arange(len(b)) - np.repeat(np.cumsum(m) - m, m), np.repeat(np.arange(len(m)), m)] = b
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), lot):
        own, other = i[at : at + lot], j[at : at + lot]
        base, words = own * size, int(n[own].max() + 63) // 64
        rows = [np.full(len(own), ~np.uint64(0)) for _ in range(words)]
        for step in range(int(m[other].max())):
            spot = letters[step].take(other)
            spot += base
            for k, row in enumerate(rows):
                hit = where[k].take(spot)
                hit &= row
                total = row + hit
                if words > 1:
                    more = total < row
                    if k:
                        total += over
                        more |= over & (total == 0)
                    over = more
                row ^= hit
                row |= total
        for k, row in enumerate(rows):
            bits = np.clip(n[own] - 64 * k, 0, 64)
            full = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
            out[at : at + lot] += bits - np.bitwise_count(row & full)
    return out


#: Share of all letters that a class of letters has at least, and how many letters; pairs that are held side by side from how many
#: on, and up to how many words of 64 bits.
SHARE, LEAST, SIDE_BY_SIDE, WORDS = 0.04, 2, 128, 12


class Texts:
    """Texts of any length of which pairs are to be found that reach a ratio. What sets two texts apart, letters put in and taken
    out, is the sum over classes of letters of what does so within each, and that is at least what sets the texts apart once all
    other letters are left out. Rare letters are read first: most pairs of unlike texts are told apart by some tenth of their
    letters. All bounds are exact."""

    def __init__(self, texts: list[str | None]):
        self.texts = [x or "" for x in texts]
        self.sizes = np.array([len(x) for x in self.texts], np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        often = np.bincount(self.codes, minlength=1)
        top = np.argsort(-often, kind="stable")[:63]
        kind_of = np.full(len(often), 63, np.uint8)
        kind_of[top] = np.arange(len(top))
        self.kinds = kind_of[self.codes]
        self.counts = np.array([np.bincount(self.kinds[s : s + n], minlength=64) for s, n in zip(self.start, self.sizes, strict=True)], np.int32).reshape(-1, 64)
        share = self.counts.sum(0) / max(1, len(self.codes))
        self.classes, own = [], []
        for k in np.argsort(share, kind="stable"):
            own += [k] if share[k] else []
            if len(own) >= LEAST and share[own].sum() >= SHARE:
                self.classes.append(own)
                own = []
        self.classes += [own] if own else []
        self.read: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _of_class(self, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts with only the letters of a class, as numbers, and where each begins and how long it is."""
        if c not in self.read:
            number = np.full(64, 255, np.uint8)
            number[self.classes[c]] = np.arange(len(self.classes[c]))
            flat = number[self.kinds]
            n = self.counts[:, self.classes[c]].sum(1, dtype=np.int64)
            self.read[c] = flat[flat != 255], np.cumsum(n) - n, n
        return self.read[c]

    def _common(self, c: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """lcs() of pairs of texts of which only a class of letters is read: many short pairs of like length side by side, others
        one by one."""
        flat, start, n = self._of_class(c)
        out, kin = np.zeros(len(i), np.int64), (np.log2(n[i] + 1) * 3).astype(int)
        order = np.lexsort((i, kin))
        for rows in np.split(order, np.flatnonzero(np.diff(kin[order])) + 1):
            words = int(n[i[rows]].max(initial=0) + 63) // 64
            if len(rows) >= SIDE_BY_SIDE and words <= WORDS:
                (a, x), (b, y) = (np.unique(side[rows], return_inverse=True) for side in (i, j))
                left, right = (np.concatenate([flat[start[k] : start[k] + n[k]] for k in side]).astype(np.int64) for side in (a, b))
                out[rows] = _lcs_coded(left, n[a], right, n[b], len(self.classes[c]) + 1, x, y, LOT // max(words, 2))
                continue
            last, where = -1, []
            for r in rows:
                if i[r] != last:
                    last, own = i[r], flat[start[i[r]] : start[i[r]] + n[i[r]]]
                    where = [int.from_bytes(np.packbits(own == k, bitorder="little").tobytes(), "little") for k in range(len(self.classes[c]))]
                out[r] = _lcs_bits(where, int(n[last]), flat[start[j[r]] : start[j[r]] + n[j[r]]].tobytes())
        return out

    def open(self, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of places that may reach least, as far as lengths, counts of letters and classes of letters tell."""
        most = (1 - least / 100) * (self.sizes[i] + self.sizes[j]) + 1e-9
        apart = np.concatenate([np.zeros(0, np.int64)] + [np.abs(self.counts[i[k : k + 4096]] - self.counts[j[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(i), 4096)])
        for c in range(-1, len(self.classes)):
            if c >= 0:
                n = self._of_class(c)[2]
                for k in self.classes[c]:
                    apart -= np.abs(self.counts[i, k] - self.counts[j, k])
                apart += n[i] + n[j] - 2 * self._common(c, i, j)
            keep = np.flatnonzero(apart <= most)
            i, j, apart, most = i[keep], j[keep], apart[keep], most[keep]
            if not len(i):
                break
        return i, j

    def reaches(self, i: int, j: int, least: float) -> bool:
        """Whether the ratio of a pair is at least least. What both begin or end with is common and is not looked at."""
        a, b = (self.codes[self.start[k] : self.start[k] + self.sizes[k]] for k in (i, j))
        n = min(len(a), len(b))
        unlike = np.flatnonzero(a[:n] != b[:n])
        head = int(unlike[0]) if len(unlike) else n
        n -= head
        unlike = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        tail = int(unlike[0]) if len(unlike) else n
        common = head + tail + lcs(self.texts[i][head : len(a) - tail], self.texts[j][head : len(b) - tail])
        return 200.0 * common / max(1, len(a) + len(b)) >= least


def _lcs_bits(where: list[int], n: int, other: bytes) -> int:
    """lcs() of a string n long, of which is known where each letter stands, with one of numbers of letters."""
    full = (1 << n) - 1
    row = full
    for k in other:
        hit = row & where[k]
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    return np.where(total == 0, 100.0, 200.0 * lcs_many(a, b) / np.maximum(total, 1))


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Of the words both have (c), those only a has and those only b has: the best of the three ratios between c, c + a's and
    c + b's; 100 if one side has no words of its own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    c = len(" ".join(sorted(both)))
    gap = 1 if c else 0
    apart = len(left) + len(right) - 2 * lcs(left, right)
    found = [100.0 * (1 - apart / (2 * (c + gap) + len(left) + len(right)))]
    if c:
        found += [100.0 * (1 - (gap + len(s)) / (2 * c + gap + len(s))) for s in (left, right)]
    return max(found)


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """token_set_ratio() of each a with its b."""
    ranked = {x: sorted(set(x.split())) for x in {*a, *b}}
    known = {x: frozenset(words) for x, words in ranked.items()}
    left, right, common = [], [], []
    for x, y in zip(a, b, strict=True):
        left.append(" ".join([w for w in ranked[x] if w not in known[y]]))
        right.append(" ".join([w for w in ranked[y] if w not in known[x]]))
        both = known[x] & known[y]
        common.append(sum(map(len, both)) + len(both) - 1 if both else 0)
    m, n, c = (np.array(x, np.float64) for x in ([len(x) for x in left], [len(x) for x in right], common))
    gap, usable = (c > 0).astype(np.float64), np.array([bool(ranked[x]) and bool(ranked[y]) for x, y in zip(a, b, strict=True)], bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        best = 100.0 * (1 - (m + n - 2 * lcs_many(left, right)) / (2 * (c + gap) + m + n))
        for side in (m, n):
            best = np.where(c > 0, np.maximum(best, 100.0 * (1 - (gap + side) / (2 * c + gap + side))), best)
    best = np.where((c > 0) & ((m == 0) | (n == 0)), 100.0, best)
    return np.where(usable, best, 0.0)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of its length in the longer one, or a shorter one at its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = _windows(a, b)
    return max(best, _windows(b, a)) if len(a) == len(b) and best < 100 else best


#: Windows compared at once.
LANES = 65_536


def _windows(a: str, b: str) -> float:
    """The best ratio of a with any stretch of its length in b, or a shorter one at an end of b: all stretches side by side, one
    letter of each at a time."""
    if a in b:
        return 100.0
    n, m, words, best = len(a), len(b), (len(a) + 63) // 64, 0.0
    kinds = {c: i for i, c in enumerate(dict.fromkeys(a))}
    where = np.zeros((len(kinds) + 1, words), np.uint64)
    for i, c in enumerate(a):
        where[kinds[c], i // 64] |= np.uint64(1 << i % 64)
    # letters that a lacks, as those beyond the ends of b, match nothing
    none = np.full(n - 1, len(kinds))
    codes = np.concatenate([none, np.array([kinds.get(c, len(kinds)) for c in b]), none])
    start = np.arange(1 - n, m)
    size = np.minimum(start + n, m) - np.maximum(start, 0)
    for at in range(0, len(start), LANES):
        own = codes[at : at + min(LANES, len(start) - at) + n - 1]
        lanes = len(own) - n + 1
        common = n - _left_over(np.full(lanes, n), words, (where[own[j : j + lanes]] for j in range(n)), lanes)
        best = max(best, float((200.0 * common / (n + size[at : at + lanes])).max()))
    return best


def _each(function):
    return lambda a, b: [function(x, y) for x, y in zip(a, b, strict=True)]


def _udf(name: str, many):
    """A UDF of two strings; many takes the distinct pairs of a batch. Null for null."""

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(dict.fromkeys((x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None))
        known = dict(zip(pairs, many([x for x, _ in pairs], [y for _, y in pairs]), strict=True)) if pairs else {}
        return pd.Series([known.get((x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    batch.__name__ = name
    return F.pandas_udf(batch, T.DoubleType())


def _sorted_words(texts: list[str]) -> list[str]:
    return [" ".join(sorted(x.split())) for x in texts]


ratio_udf, token_set_udf = _udf("ratio", ratios), _udf("token_set_ratio", token_set_ratios)
token_sort_udf, partial_udf = _udf("token_sort_ratio", lambda a, b: ratios(_sorted_words(a), _sorted_words(b))), _udf("partial_ratio", _each(partial_ratio))


def similar(a: Column, b: Column, least: float = QUOTE_DUPLICATE) -> Column:
    """ratio(a, b) >= least. With l = levenshtein and d = len(a) + len(b) - 2 lcs: l <= d <= 2 l, so pairs far apart or close
    together are settled without Python, which sees a pair of nulls for them."""
    allowed = (F.length(a) + F.length(b)) * (1 - least / 100)
    far = F.levenshtein(a, b)
    unsure = (far <= allowed) & (2 * far > allowed)
    return F.when(far > allowed, False).when(2 * far <= allowed, True).otherwise(F.coalesce(ratio_udf(F.when(unsure, a), F.when(unsure, b)) >= least, F.lit(False)))


#: Parts of the quote, the place and the description in a pair's score; of description and place where a quote is empty.
PARTS, WITHOUT_QUOTE = (0.6, 0.15, 0.25), (0.65, 0.35)


def _bounds(a: list[str], b: list[str]) -> np.ndarray:
    """For each a with each b at least their token_set_ratio()."""
    return _bounded(a, b)[0]


def _bounded(a: list[str], b: list[str]) -> tuple[np.ndarray, ...]:
    """_bounds(), and how long what is left of each a and b is, and the words that both have, joined by blanks. How long these words
    are is counted exactly; of what is left of each, in order, the longest common subsequence has no letter more often than both
    have it."""
    distinct = [sorted(set(x.split())) for x in (*a, *b)]
    names = {w: i for i, w in enumerate({w for words in distinct for w in words})}
    size = np.array([len(w) for w in names], np.float32)
    count = np.array([len(words) for words in distinct], np.int32)
    at = np.repeat(np.arange(len(distinct)), count), np.array([names[w] for words in distinct for w in words], np.int64)
    n = len(a)
    # words that only one side has meet nothing; the others are looked at some thousand at a time
    both = np.isin(np.arange(len(names)), at[1][at[0] < n]) & np.isin(np.arange(len(names)), at[1][at[0] >= n])
    number, keep = np.cumsum(both) - 1, both[at[1]]
    row, word, size = at[0][keep], number[at[1][keep]], size[both]
    length, shared = np.zeros((n, len(b)), np.float32), np.zeros((n, len(b)), np.float32)
    for low in range(0, len(size), 4096):
        own = (word >= low) & (word < low + 4096)
        has = np.zeros((len(distinct), min(4096, len(size) - low)), np.float32)
        has[row[own], word[own] - low] = 1
        length += has[:n] * size[low : low + 4096] @ has[n:].T
        shared += has[:n] @ has[n:].T
    letters = np.zeros((len(distinct), 64), np.float32 if max(map(len, (*a, *b)), default=0) > 30_000 else np.int16)
    for i, words in enumerate(distinct):
        if words:
            letters[i] = np.bincount(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64)
    total = np.array([sum(map(len, words)) for words in distinct], np.float32)
    letters = letters[:, letters[:n].any(0) & letters[n:].any(0)]
    out = tuple(np.empty((n, len(b)), np.float32) for _ in range(4))
    for low in range(0, n, 64):  # a slab at a time, which fits a core's cache
        rows = slice(low, min(low + 64, n))
        common = np.zeros((rows.stop - low, len(b)), letters.dtype)
        for own, other in zip(letters[rows].T, letters[n:].T, strict=True):
            common += np.minimum.outer(own, other)
        slab = _slab(length[rows], shared[rows], common, total[rows, None], total[None, n:], count[rows, None], count[None, n:])
        for whole, part in zip(out, slab, strict=True):
            whole[rows] = part
    return out


def _slab(length: np.ndarray, shared: np.ndarray, common: np.ndarray, m: np.ndarray, n: np.ndarray, m_words: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, ...]:
    """What _bounded() gives, from the letters and number of the words both have, the letters in common, and letters and words of each."""
    # c: the common words joined by blanks; left, right: what is left of each
    c = length + np.maximum(shared - 1, 0)
    own = lambda t, k: np.maximum(t - length, 0) + np.maximum(k - shared - 1, 0)
    left, right = own(m, m_words.astype(np.float32)), own(n, n_words.astype(np.float32))
    # letters of common words are common; blanks between what is left may be as well
    blanks = np.minimum(np.maximum(m_words - shared - 1, 0), np.maximum(n_words - shared - 1, 0))
    rest = np.minimum(np.maximum(common - length, 0) + blanks, np.minimum(left, right))
    gap = (shared > 0).astype(np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        best = 100 * (1 - (left + right - 2 * rest) / (2 * (c + gap) + left + right))
        if shared.any():
            for side in (left, right):
                best = np.where(shared > 0, np.maximum(best, 100 * (1 - (gap + side) / (2 * c + gap + side))), best)
            best = np.where((shared > 0) & ((left == 0) | (right == 0)), 100, best)
    return np.where((m_words > 0) & (n_words > 0), np.nan_to_num(best, nan=100.0) + 1e-3, 0), left, right, c


#: Letters of the longest strings whose common subsequence is looked for before the words that both have are taken out.
SHORT = 512


def _closer(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray, bounded: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of places at least their token_set_ratio(), and for which pairs it is that: those that have no word in common. What
    is left of a text is a subsequence of its words in order, so that of two has no longer one in common than these."""
    best, left, right, both = (x[i, j].astype(np.float64) for x in bounded)
    words = [[" ".join(sorted(set(x.split()))) for x in side] for side in (a, b)]
    m, n = (np.array([len(x) for x in own], np.int64)[k] for own, k in zip(words, (i, j), strict=True))
    exact = both == 0
    rows = np.flatnonzero(exact | (np.maximum(m, n) <= SHORT))
    common = lcs_pairs(*words, i[rows], j[rows])
    x, y, c, none = left[rows], right[rows], both[rows], exact[rows]
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where((m[rows] > 0) & (n[rows] > 0), 100.0 * (1 - (m[rows] + n[rows] - 2 * common) / (m[rows] + n[rows])), 0.0)
        some = 100.0 * (1 - (x + y - 2 * np.minimum(common, np.minimum(x, y))) / (2 * (c + 1) + x + y))
        for side in (x, y):
            some = np.maximum(some, 100.0 * (1 - (1 + side) / (2 * c + 1 + side)))
    some = np.where((x == 0) | (y == 0), 100.0, some) + 1e-3
    best[rows] = np.where(none, apart, np.minimum(best[rows], some))
    return best, exact


def scored_blocks(left: list[list[str]], right: list[list[str]], least: float) -> list[tuple[int, int, float]]:
    """(i, j, score) of all pairs of two lists of findings, each as quotes, places and descriptions in small letters, that reach
    least: the quote counts for the most part, then place and description. Strings are compared only where the bounds of what
    they can come to leave it open."""
    (quote_a, place_a, said_a), (quote_b, place_b, said_b) = left, right
    if not quote_a or not quote_b:
        return []
    no_quote = np.array([not x for x in quote_a])[:, None] | np.array([not x for x in quote_b])[None, :]
    of_quotes, of_said = _bounded(quote_a, quote_b), _bounded(said_a, said_b)
    quote, said = of_quotes[0], of_said[0]
    most = np.where(no_quote, WITHOUT_QUOTE[0] * said + 100 * WITHOUT_QUOTE[1], PARTS[0] * quote + 100 * PARTS[1] + PARTS[2] * said)
    open_ = (most >= least) & (no_quote | (quote >= QUOTE_FLOOR) | (said >= DESCRIPTION_FLOOR))
    i, j = np.nonzero(open_)
    plain, q, d, w = no_quote[i, j], quote[i, j].astype(np.float64), said[i, j].astype(np.float64), np.full(len(i), 100.0)

    def keep() -> np.ndarray:
        whole = np.where(plain, WITHOUT_QUOTE[0] * d + WITHOUT_QUOTE[1] * w, PARTS[0] * q + PARTS[1] * w + PARTS[2] * d)
        return (whole >= least) & (plain | ~((q < QUOTE_FLOOR) & (d < DESCRIPTION_FLOOR)))

    def exact(a: list[str], b: list[str], rows: np.ndarray, many) -> np.ndarray:
        found = [(a[x], b[y]) for x, y in zip(i[rows].tolist(), j[rows].tolist(), strict=True)]
        own = list(dict.fromkeys(found))
        known = dict(zip(own, many([x for x, _ in own], [y for _, y in own]), strict=True)) if own else {}
        return np.array([known[x] for x in found], np.float64)

    def narrow() -> None:
        nonlocal i, j, plain, q, d, w, q_known, d_known
        rows = np.flatnonzero(keep())
        i, j, plain, q, d, w, q_known, d_known = (x[rows] for x in (i, j, plain, q, d, w, q_known, d_known))

    # pairs without a common word are settled for all their texts at once, the others pair by pair
    q, q_known = _closer(quote_a, quote_b, i, j, of_quotes)
    q_known |= plain
    d_known = np.zeros(len(i), bool)
    narrow()
    d, d_known = _closer(said_a, said_b, i, j, of_said)
    narrow()
    rows = np.flatnonzero(~q_known)
    q[rows] = exact(quote_a, quote_b, rows, token_set_ratios)
    narrow()
    rows = np.flatnonzero(~d_known)
    d[rows] = exact(said_a, said_b, rows, token_set_ratios)
    narrow()
    told = np.array([bool(place_a[x]) and bool(place_b[y]) for x, y in zip(i, j, strict=True)], bool)
    w = np.full(len(i), 50.0)
    w[told] = exact(place_a, place_b, np.flatnonzero(told), _each(partial_ratio))
    whole = np.where(plain, WITHOUT_QUOTE[0] * d + WITHOUT_QUOTE[1] * w, PARTS[0] * q + PARTS[1] * w + PARTS[2] * d)
    return [(int(x), int(y), float(s)) for x, y, s, k in zip(i, j, whole, keep(), strict=True) if k and s >= least]


def score_match(title: Column, other: Column, year: Column | None = None, other_year: Column | None = None) -> Column:
    """How well a record's title matches a reference's; years far apart cost YEAR_PENALTY."""
    score = token_sort_udf(title_key(title), title_key(other))
    if year is not None and other_year is not None:
        score = score - F.when(F.abs(year_of(year) - year_of(other_year)) > YEAR_TOLERANCE, YEAR_PENALTY).otherwise(0.0)
    return F.when((F.coalesce(title, F.lit("")) == "") | (F.coalesce(other, F.lit("")) == ""), 0.0).otherwise(F.greatest(F.lit(0.0), score))


def register(spark) -> None:
    """The four ratios for use in SQL."""
    for name, udf in (("ratio", ratio_udf), ("token_sort_ratio", token_sort_udf), ("token_set_ratio", token_set_udf), ("partial_ratio", partial_udf)):
        spark.udf.register(name, udf)
