"""String similarities: indel ratio and its partial and token forms, and Jaro-Winkler.

All eight features of a pair come from one Arrow function, so texts cross once, and are found for a whole batch at once: the
different pairs of a batch are put in order of length and cut into chunks; in a chunk a text is a row of code points, the
places where two texts have the same character are bit masks, and a step of the longest common subsequence, of all windows
of a partial match or of Jaro's matching is a few operations on arrays of 64-bit words. Texts of more than 64 characters take
the same steps one by one, on Python integers. Percentages pass through single precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.schemas import FUZZY_FEATURES


def places(text: str) -> dict[str, int]:
    """For each character the bits of its positions."""
    bits: dict[str, int] = {}
    for i, c in enumerate(text):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def lcs(bits: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of the text behind bits (n characters) and other."""
    full = (1 << n) - 1
    row = full
    for c in other:
        match = row & bits.get(c, 0)
        if match:
            row = ((row + match) | (row - match)) & full
    return n - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(places(a), len(a), b) / total


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer, or with one of its shorter ends."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b) if len(a) < len(b) else _windows(b, a)


def _windows(short: str, long: str) -> float:
    bits, n, known = places(short), len(short), set(short)
    best = 0.0
    for start in range(1 - n, len(long)):
        lo, hi = max(0, start), min(len(long), start + n)
        # a window that ends, or for a suffix starts, in a character the shorter text lacks is never the best
        if (long[hi - 1] if start + n <= len(long) else long[lo]) not in known:
            continue
        window = long[lo:hi]
        if 200.0 * len(window) / (n + len(window)) <= best:
            continue
        best = max(best, 200.0 * lcs(bits, n, window) / (n + len(window)))
        if best == 100.0:
            break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = left & right, " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and (not only_a or not only_b):
        return 100.0
    shared = len(" ".join(sorted(both)))
    space = bool(shared)
    n_a, n_b = shared + space * bool(only_a) + len(only_a), shared + space * bool(only_b) + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * lcs(places(only_a), len(only_a), only_b)
    found = [100.0 * (1 - apart / (n_a + n_b))] if n_a + n_b else [100.0]
    if both:  # the shared words against the shared words and the rest
        found += [100.0 * (1 - (n - shared) / (shared + n)) for n in (n_a, n_b)]
    return max(found)


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


#: Characters of a text that fit a word; pairs, and pairs times windows, that are worked on at once.
WORD, CHUNK, CELLS = 64, 2048, 400_000
ONE = np.uint64(1)


def code_points(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row of code points for each text, filled up; lengths)"""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), max(1, int(lengths.max(initial=0)))), fill, np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


class Chunk:
    """Pairs of texts of up to 64 characters on the left, as arrays."""

    def __init__(self, left: list[str], right: list[str]):
        # the fillers are no code points and differ, so they never match
        self.a, self.n_a = code_points(left, 0xFFFFFFFF)
        self.b, self.n_b = code_points(right, 0xFFFFFFFE)

    def places_in_a(self) -> np.ndarray:
        """(pairs, characters of b): the places of each character of b in a, as bits."""
        held = np.zeros(self.b.shape, np.uint64)
        for i in range(self.a.shape[1]):
            held |= (self.a[:, i, None] == self.b).astype(np.uint64) << np.uint64(i)
        return held

    def full(self) -> np.ndarray:
        """All bits of a."""
        n = self.n_a.astype(np.uint64)
        return np.where(self.n_a >= WORD, ~np.uint64(0), (ONE << np.minimum(n, np.uint64(WORD - 1))) - ONE)

    def common(self) -> np.ndarray:
        """Lengths of the longest common subsequences."""
        held, row = self.places_in_a(), np.full(len(self.a), ~np.uint64(0))
        for j in range(held.shape[1]):
            match = row & held[:, j]
            row = (row + match) | (row - match)
        return self.n_a - np.bitwise_count(row & self.full()).astype(np.int64)

    def best_window(self) -> np.ndarray:
        """The best ratio of a, which is not the longer one, with a window of its length of b or with a shorter end of b."""
        held, n, m = self.places_in_a(), self.a.shape[1], self.b.shape[1]
        windows = m + n - 1
        wide = np.zeros((len(self.a), windows + n - 1), np.uint64)
        wide[:, n - 1 : n - 1 + m] = held  # the window at s holds the columns s to s + n_a - 1, s from 1 - n on
        row = np.full((len(self.a), windows), ~np.uint64(0))
        for t in range(n):
            match = row & np.where((t < self.n_a)[:, None], wide[:, t : t + windows], np.uint64(0))
            row = (row + match) | (row - match)
        found = self.n_a[:, None] - np.bitwise_count(row & self.full()[:, None]).astype(np.int64)
        start = np.arange(1 - n, m)[None, :]
        size = np.minimum(self.n_b[:, None], start + self.n_a[:, None]) - np.maximum(0, start)
        return np.where(size > 0, 200.0 * found / np.maximum(1, self.n_a[:, None] + size), 0.0).max(axis=1)

    def jaro_winkler(self) -> np.ndarray:
        """Both texts of up to 64 characters, neither empty."""
        n, m = self.a.shape[1], self.b.shape[1]
        reach = np.maximum(0, np.maximum(self.n_a, self.n_b) // 2 - 1)
        in_b = np.zeros(self.a.shape, np.uint64)
        for j in range(m):
            in_b |= (self.b[:, j, None] == self.a).astype(np.uint64) << np.uint64(j)
        used, matched = np.zeros(len(self.a), np.uint64), np.zeros(len(self.a), np.uint64)
        below = lambda k: np.where(k >= WORD, ~np.uint64(0), (ONE << np.clip(k, 0, WORD - 1).astype(np.uint64)) - ONE)
        for i in range(n):
            free = in_b[:, i] & below(i + reach + 1) & ~below(np.maximum(0, i - reach)) & ~used
            used |= free & (~free + ONE)
            matched |= (free != 0).astype(np.uint64) << np.uint64(i)
        count = np.bitwise_count(matched).astype(np.int64)
        moved, rows = np.zeros(len(self.a), np.int64), np.arange(len(self.a))
        x, y = matched.copy(), used.copy()
        for k in range(int(count.max(initial=0))):
            left, right = x & (~x + ONE), y & (~y + ONE)
            at_a, at_b = np.bitwise_count(left - ONE) % WORD, np.bitwise_count(right - ONE) % WORD
            moved += (k < count) & (self.a[rows, np.minimum(at_a, n - 1)] != self.b[rows, np.minimum(at_b, m - 1)])
            x, y = x ^ left, y ^ right
        some = np.maximum(1, count)
        jaro = np.where(count > 0, (count / np.maximum(1, self.n_a) + count / np.maximum(1, self.n_b) + (count - moved // 2) / some) / 3, 0.0)
        prefix, same = np.zeros(len(self.a), np.int64), np.ones(len(self.a), bool)
        for k in range(min(4, n, m)):
            same &= self.a[:, k] == self.b[:, k]
            prefix += same
        return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def chunked(left: list[str], right: list[str], rows: np.ndarray, work, slow, cells=lambda a, b: 1) -> np.ndarray:
    """work() of the pairs in rows, chunk by chunk in order of length; slow() of those whose left text does not fit a word."""
    out = np.zeros(len(left))
    n_a, n_b = np.array([len(t) for t in left], np.int64), np.array([len(t) for t in right], np.int64)
    short = rows[n_a[rows] <= WORD]
    for i in rows[n_a[rows] > WORD].tolist():
        out[i] = slow(left[i], right[i])
    order = short[np.lexsort((n_a[short], n_b[short]))]
    at = 0
    while at < len(order):
        # as many as are worked on at once, by the longest among them
        take = order[at : at + CHUNK]
        size = max(1, min(len(take), CELLS // max(1, cells(int(n_a[take].max()), int(n_b[take].max())))))
        take = take[:size]
        out[take] = work(Chunk([left[i] for i in take], [right[i] for i in take]))
        at += size
    return out


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """ratio() of each pair."""
    swap = np.array([len(a) > len(b) for a, b in zip(left, right, strict=True)], bool)
    a, b = _swapped(left, right, swap)
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    same = np.array([x == y for x, y in zip(a, b, strict=True)], bool)
    common = chunked(a, b, np.nonzero(~same)[0], Chunk.common, lambda x, y: lcs(places(x), len(x), y))
    return np.where(same, 100.0, 200.0 * common / np.maximum(1, total))


def _swapped(left: list[str], right: list[str], swap: np.ndarray) -> tuple[list[str], list[str]]:
    pairs = [(y, x) if s else (x, y) for x, y, s in zip(left, right, swap.tolist(), strict=True)]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def partial_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """partial_ratio() of each pair."""
    a, b = _swapped(left, right, np.array([len(x) > len(y) for x, y in zip(left, right, strict=True)], bool))
    same = np.array([x == y for x, y in zip(a, b, strict=True)], bool)
    empty = np.array([not x for x in a], bool)
    cells = lambda n, m: n + m
    rest = np.nonzero(~same & ~empty)[0]
    out = chunked(a, b, rest, Chunk.best_window, _windows, cells)
    equal = np.array([len(x) == len(y) for x, y in zip(a, b, strict=True)], bool)
    back = chunked(b, a, rest[equal[rest]], Chunk.best_window, _windows, cells)
    return np.where(same, 100.0, np.maximum(out, back))


def token_set_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """token_set_ratio() of each pair."""
    words = {t: frozenset(t.split()) for t in {*left, *right}}
    out, rest = np.zeros(len(left)), []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        x, y = words[a], words[b]
        if x and y:
            both = x & y
            if both and (len(both) == len(x) or len(both) == len(y)):
                out[i] = 100.0
            else:
                rest.append((i, " ".join(sorted(x - both)), " ".join(sorted(y - both)), sum(map(len, both)) + max(0, len(both) - 1)))
    if rest:
        a, b = [r[1] for r in rest], [r[2] for r in rest]
        a, b = _swapped(a, b, np.array([len(x) > len(y) for x, y in zip(a, b, strict=True)], bool))
        common = chunked(a, b, np.arange(len(a)), Chunk.common, lambda x, y: lcs(places(x), len(x), y))
        at = np.array([r[0] for r in rest])
        shared = np.array([r[3] for r in rest], np.int64)
        l_a, l_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        space = (shared > 0).astype(np.int64)
        n_a, n_b = shared + space * (l_a > 0) + l_a, shared + space * (l_b > 0) + l_b
        whole = n_a + n_b
        best = np.where(whole > 0, 100.0 * (1 - (l_a + l_b - 2 * common) / np.maximum(1, whole)), 100.0)
        for n in (n_a, n_b):  # the shared words against the shared words and the rest
            best = np.where(shared > 0, np.maximum(best, 100.0 * (1 - (n - shared) / np.maximum(1, shared + n))), best)
        out[at] = best
    return out


def token_sort_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """token_sort_ratio() of each pair."""
    in_order = {t: " ".join(sorted(t.split())) for t in {*left, *right}}
    return ratios([in_order[t] for t in left], [in_order[t] for t in right])


def jaro_winklers(left: list[str], right: list[str]) -> np.ndarray:
    """jaro_winkler() of each pair."""
    same = np.array([a == b for a, b in zip(left, right, strict=True)], bool)
    rest = np.array([bool(a) and bool(b) for a, b in zip(left, right, strict=True)], bool) & ~same
    long = rest & np.array([len(b) > WORD for b in right], bool)
    out = chunked(left, right, np.nonzero(rest & ~long)[0], Chunk.jaro_winkler, jaro_winkler)
    for i in np.nonzero(long)[0].tolist():
        out[i] = jaro_winkler(left[i], right[i])
    return np.where(same, 1.0, out)


BATCHED = {"ratio": ratios, "partial": partial_ratios, "token_sort": token_sort_ratios, "token_set": token_set_ratios, "jw": jaro_winklers}


def different(a: pd.Series, b: pd.Series) -> tuple[list[str], list[str], np.ndarray]:
    """(left, right, place): the different pairs of a batch, and which of them each row has."""
    x, names_a = pd.factorize(a.fillna(""))
    y, names_b = pd.factorize(b.fillna(""))
    pairs, place = np.unique(x.astype(np.int64) * max(1, len(names_b)) + y, return_inverse=True)
    return [names_a[p] for p in (pairs // max(1, len(names_b))).tolist()], [names_b[p] for p in (pairs % max(1, len(names_b))).tolist()], place


@F.pandas_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in FUZZY_FEATURES]))
def fuzzy_features(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(title_a, title_b, artist_a, artist_b) to the eight similarities; null counts as ''."""
    for title_a, title_b, artist_a, artist_b in parts:
        given = {"title": different(title_a, title_b), "artist": different(artist_a, artist_b)}
        out = {}
        for feature in FUZZY_FEATURES:
            side, _, scorer = feature.partition("_")
            left, right, place = given[side]
            x = BATCHED[scorer](left, right)[place].astype(np.float32).astype(np.float64)
            out[feature] = x if scorer == "jw" else x / 100
        yield pd.DataFrame(out)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    return _jw(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


@F.pandas_udf(T.DoubleType())
def _jw(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right, place = different(a, b)
    return pd.Series(jaro_winklers(left, right)[place], dtype="float64")
