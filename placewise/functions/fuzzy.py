"""Edit similarity on the 0-100 scale, as small vectorised helpers inside Spark tasks.

``ratio`` is 100 * 2 * LCS / (len a + len b): substitution costs two, so it is
not Spark's ``levenshtein``.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def ratio_at_least(a: str, b: str, threshold: float) -> float:
    """``ratio`` or 0.0 when the lengths alone keep it below the threshold."""
    total = len(a) + len(b)
    if total and 200.0 * min(len(a), len(b)) / total < threshold:
        return 0.0
    return ratio(a, b)


def partial_ratio(a: str, b: str) -> float:
    """Best ``ratio`` of the shorter text against same-length and edge windows of the longer.

    Of two texts of one length either can slide along the other.
    """
    if len(a) == len(b):
        return max(_slide(a, b), _slide(b, a))
    return _slide(a, b) if len(a) < len(b) else _slide(b, a)


def _slide(short: str, long: str) -> float:
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, m = len(short), len(long)
    where: dict[str, int] = {}
    for i, ch in enumerate(short):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << n) - 1
    best = 0.0
    for start in range(1 - n, m):
        lo, hi = max(0, start), min(m, start + n)
        # A window closing (at the end: opening) on a letter the short text lacks loses to its neighbour.
        if (start <= m - n and long[hi - 1] not in where) or (start >= m - n and long[lo] not in where):
            continue
        span = n + hi - lo
        if 200.0 * min(n, hi - lo) / span <= best:
            continue
        row = full
        for ch in long[lo:hi]:
            mask = where.get(ch)
            if mask:
                hit = row & mask
                row = (row + hit) | (row - hit)
        best = max(best, 200.0 * (n - (row & full).bit_count()) / span)
    return best


def lcs_lengths(a: list[str], b: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``lcs_length`` of the pairs (a[one], b[two]): the bit rows of all pairs move on letter by letter together."""
    out = np.zeros(len(one), np.int64)
    long = np.array([len(t) > 63 for t in a])[one]
    for k in np.nonzero(long)[0]:
        out[k] = lcs_length(a[one[k]], b[two[k]])
    place = {ch: n for n, ch in enumerate(sorted(set().union(*a)))}
    at_once = max(1024, 4_000_000 // (len(place) + 1))
    short = np.nonzero(~long)[0]
    for low in range(0, len(short), at_once):
        part = short[low:low + at_once]
        (own, x), (other, y) = (np.unique(side[part], return_inverse=True) for side in (one, two))
        where = np.zeros((len(own), len(place) + 1), np.uint64)
        for n, t in enumerate(own):
            for bit, ch in enumerate(a[t]):
                where[n, place[ch]] |= np.uint64(1 << bit)
        letters = np.full((max(len(b[t]) for t in other), len(other)), len(place))
        for n, t in enumerate(other):
            letters[:len(b[t]), n] = [place.get(ch, len(place)) for ch in b[t]]
        size = np.array([len(a[t]) for t in own], np.uint64)[x]
        full = (np.uint64(1) << size) - np.uint64(1)
        row = full.copy()
        for step in letters:
            hit = row & where[x, step[y]]
            row = (row + hit) | (row - hit)
        out[part] = size.astype(np.int64) - np.bitwise_count(row & full)
    return out


def _distinct(text: np.ndarray, mark: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each distinct (text, marks of a set)."""
    _, first, number = np.unique(mark + 1j * (text * 2.0**43 + other), return_index=True, return_inverse=True)
    return first, number


_WORD_GAP = re.compile(r"[ \t\n\x0b\f\r]+")
_WORDS_AT_ONCE = 2048


def token_sets_reach(a: list[str], b: list[str], least: np.ndarray) -> np.ndarray:
    """Which pairs of the texts ``a`` and ``b`` have a ``token_set_ratio_col`` of ``least`` (one value a pair) or more."""
    known, most, _, rest = _set_bounds(a, b, least.shape)
    reached = known >= least
    i, j = np.nonzero(~reached & (most >= least - 1e-9))
    if len(i):
        reached[i, j] = rest(i, j) >= least[i, j]
    return reached


def token_set_ratios(a: list[str], b: list[str], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, ``token_set_ratio_col`` of the pairs of the texts ``a`` and ``b`` that reach ``least`` (one value a pair)."""
    known, most, fixed, rest = _set_bounds(a, b, least.shape)
    i, j = np.nonzero(most >= least - 1e-9)
    ratio = known[i, j]
    more = np.nonzero(~fixed[i, j])[0]
    if len(more):
        ratio[more] = np.maximum(ratio[more], rest(i[more], j[more]))
    reached = ratio >= least[i, j]
    return i[reached], j[reached], ratio[reached]


def _set_bounds(a: list[str], b: list[str], shape: tuple[int, int]):
    """For all pairs: the least and the most that their ratio can be, which of them are settled by that, and what common letters in order give given pairs."""
    sets = [[frozenset(w for w in _WORD_GAP.split(t) if w) for t in side] for side in (a, b)]
    number = {w: i for i, w in enumerate(sorted(set().union(*sets[0]) & set().union(*sets[1])))}
    letters = np.array([len(w) for w in number], dtype=np.float32)
    at = [np.array([(i, number[w]) for i, s in enumerate(side) for w in s if w in number], dtype=np.int64).reshape(-1, 2) for side in sets]
    both, chars, *marks = (np.zeros(shape) for _ in range(4))
    # Whole numbers below 2 ** 53 in all sums: two independent ones tell sets of common words apart.
    drawn = [np.random.default_rng(seed).integers(1, 2**top, len(number)).astype(np.float64) for seed, top in ((1, 40), (2, 31))]
    for low in range(0, len(number), _WORDS_AT_ONCE):
        own = letters[low:low + _WORDS_AT_ONCE]
        tables = []
        for side, found in zip(sets, at):
            table = np.zeros((len(side), len(own)), np.float32)
            part = found[(found[:, 1] >= low) & (found[:, 1] < low + len(own))]
            table[part[:, 0], part[:, 1] - low] = 1
            tables.append(table)
        both += tables[0] @ tables[1].T
        chars += (tables[0] * own) @ tables[1].T
        for total, codes in zip(marks, drawn):
            total += (tables[0].astype(np.float64) * codes[low:low + len(own)]) @ tables[1].T.astype(np.float64)
    count = [np.array([len(s) for s in side], np.float64) for side in sets]
    size = [np.array([sum(map(len, s)) for s in side], np.float64) for side in sets]
    gaps = lambda n: np.maximum(n - 1, 0)
    shared = chars + gaps(both)
    la = size[0][:, None] - chars + gaps(count[0][:, None] - both)
    lb = size[1] - chars + gaps(count[1] - both)
    gap = shared > 0
    span = np.maximum(2.0 * (shared + gap) + la + lb, 1)
    with_a = 100 - 100 * (gap + la) / np.maximum(2.0 * shared + gap + la, 1)
    with_b = 100 - 100 * (gap + lb) / np.maximum(2.0 * shared + gap + lb, 1)
    # Without a common letter, and with as many as the shorter rest has.
    known = np.where(gap, np.maximum(np.maximum(with_a, with_b), 100 - 100 * (la + lb) / span), 0)
    most = np.maximum(known, 100 - 100 * np.abs(la - lb) / span)
    subset = gap & ((la == 0) | (lb == 0))
    known[subset] = most[subset] = 100
    void = (count[0] == 0)[:, None] | (count[1] == 0)
    known[void] = most[void] = 0

    def rest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # What is left over of a text follows from its common words with the other: equal sets share their sums.
        first, one = _distinct(i, marks[0][i, j], marks[1][i, j])
        lefts = [" ".join(sorted(sets[0][i[k]] - sets[1][j[k]])) for k in first]
        first, two = _distinct(j, marks[0][i, j], marks[1][i, j])
        rights = [" ".join(sorted(sets[1][j[k]] - sets[0][i[k]])) for k in first]
        common = lcs_lengths(lefts, rights, one, two)
        return 100 - 100 * (la[i, j] + lb[i, j] - 2 * common) / span[i, j]

    return known, most, subset | void, rest


@lru_cache(maxsize=1)
def _udfs():
    @F.pandas_udf("double")
    def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    @F.pandas_udf("double")
    def partial_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    @F.pandas_udf("double")
    def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(lcs_length(x, y)) for x, y in zip(a, b)], dtype="float64")

    return ratio_udf, partial_udf, lcs_udf


def ratio_col(a: Column, b: Column) -> Column:
    return _udfs()[0](a, b)


def partial_ratio_col(a: Column, b: Column) -> Column:
    return _udfs()[1](a, b)


def token_set_ratio_col(a: Column, b: Column) -> Column:
    """Best of the three comparisons between shared and leftover tokens; set work stays in the JVM."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))

    ta, tb = words(a), words(b)
    both = F.array_join(F.array_sort(F.array_intersect(ta, tb)), " ")
    only_a = F.array_join(F.array_sort(F.array_except(ta, tb)), " ")
    only_b = F.array_join(F.array_sort(F.array_except(tb, ta)), " ")
    shared, la, lb = F.length(both), F.length(only_a), F.length(only_b)
    gap = F.when(shared > 0, 1).otherwise(0)
    distance = la + lb - 2 * _udfs()[2](only_a, only_b)
    span_a, span_b = shared + gap + la, shared + gap + lb
    rest = 100.0 - 100.0 * distance / F.nullif(span_a + span_b, F.lit(0))
    with_a = 100.0 - 100.0 * (gap + la) / F.nullif(shared + span_a, F.lit(0))
    with_b = 100.0 - 100.0 * (gap + lb) / F.nullif(shared + span_b, F.lit(0))
    empty = (F.size(ta) == 0) | (F.size(tb) == 0)
    subset = (shared > 0) & ((la == 0) | (lb == 0))
    return F.when(empty, 0.0).when(subset, 100.0).when(shared == 0, rest).otherwise(F.greatest(rest, with_a, with_b))
