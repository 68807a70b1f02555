"""Similarity of strings by their longest common subsequence (0 to 100), over Arrow batches of pairs.

A subsequence is found bit-parallel: for all pairs of a batch at once where one of
the strings has up to 64 letters, with Python's long integers beyond that.
Letter counts bound it from above, so what can't reach a limit isn't worked out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64
BINS = 32  # letters are counted by their code modulo this; sharing a bin only loosens the bound
CHUNK = 4096  # pairs worked on at once


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), " ")


# ---- many pairs at once ------------------------------------------------------------------


def _codes(texts: list[str], width: int) -> np.ndarray:
    """A row of letter codes for each text, zeros behind its end."""
    return np.array(texts, f"U{max(1, width)}").view(np.uint32).reshape(len(texts), max(1, width))


def _short_lcs(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Of pairs whose first text has at most 64 letters: one bit for each of them, all pairs a letter of ``b`` at a time."""
    first, second = _codes(a, int(la.max(initial=0))), _codes(b, int(lb.max(initial=0))).copy()
    second[np.arange(second.shape[1]) >= lb[:, None]] = 0xFFFFFFFF  # no letter
    if max(first.max(initial=0), second[second != 0xFFFFFFFF].max(initial=0)) < 255:
        first, second = first.astype(np.uint8), np.where(second == 0xFFFFFFFF, 255, second).astype(np.uint8)
    state = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    hits = np.zeros((len(a), 8), np.uint8)
    for column in second.T:
        bits = np.packbits(first == column[:, None], axis=1, bitorder="little")
        hits[:, : bits.shape[1]] = bits
        hit = state & hits.view(np.uint64)[:, 0]
        state = (state + hit) | (state - hit)
    full = np.where(la >= WORD, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(la, WORD - 1).astype(np.uint64)) - np.uint64(1))
    return la - np.bitwise_count(state & full).astype(np.int64)


def letter_masks(a: str) -> dict[str, int]:
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def lcs(where: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of ``b`` and a text of ``n`` letters with these ``letter_masks``."""
    state = full = (1 << n) - 1
    for x in b:
        if hit := state & where.get(x, 0):
            state = ((state + hit) | (state - hit)) & full
    return n - state.bit_count()


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs."""
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.zeros(len(a), np.int64)
    for at in np.flatnonzero(np.minimum(la, lb) > WORD).tolist():
        out[at] = lcs(letter_masks(a[at]), len(a[at]), b[at])
    short = np.flatnonzero((np.minimum(la, lb) <= WORD) & (np.minimum(la, lb) > 0))
    short = short[np.argsort(np.maximum(la, lb)[short], kind="stable")]  # those of like lengths share a matrix
    for s in range(0, len(short), CHUNK):
        own = short[s : s + CHUNK]
        swap = la[own] > lb[own]
        first = [b[i] if w else a[i] for i, w in zip(own.tolist(), swap.tolist())]
        second = [a[i] if w else b[i] for i, w in zip(own.tolist(), swap.tolist())]
        out[own] = _short_lcs(first, second, np.minimum(la, lb)[own], np.maximum(la, lb)[own])
    return out


def letter_counts(texts: list[str]) -> np.ndarray:
    """Letters of each text by bin."""
    out = np.zeros((len(texts), BINS), np.int32)
    for s in range(0, len(texts), CHUNK):
        some = texts[s : s + CHUNK]
        sizes = np.array([len(x) for x in some])
        codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32) % BINS
        rows = np.repeat(np.arange(len(some)), sizes)
        out[s : s + len(some)] = np.bincount(rows * BINS + codes, minlength=len(some) * BINS).reshape(len(some), BINS)
    return out


def ratio_of(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    """200 times the common letters over both lengths; 100 for two empty texts."""
    return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))


def _lengths(texts: list[str]) -> np.ndarray:
    return np.array([len(x) for x in texts], np.int64)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Indel ratios of many pairs, equal ones worked out once."""
    pairs: dict[tuple[str, str], int] = {}
    at = np.array([pairs.setdefault(p, len(pairs)) for p in zip(a, b)], np.int64)
    if not len(at):
        return np.zeros(0)
    a, b = (list(x) for x in zip(*pairs))
    return ratio_of(lcs_lengths(a, b), _lengths(a) + _lengths(b))[at]


def ratio_bounds(a: list[str], b: list[str]) -> np.ndarray:
    """What the ratios can't exceed, by the letters that both texts have."""
    common = np.minimum(letter_counts(a), letter_counts(b)).sum(1)
    return ratio_of(common, _lengths(a) + _lengths(b))


def reach(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Whether each pair's ratio is ``least`` or more; lengths, then letters leave out most of those that aren't."""
    la, lb = _lengths(a), _lengths(b)
    open_ = np.flatnonzero(ratio_of(np.minimum(la, lb), la + lb) >= least)
    if len(open_):
        open_ = open_[ratio_bounds([a[i] for i in open_], [b[i] for i in open_]) >= least]
    out = np.zeros(len(a), bool)
    if len(open_):
        out[open_] = ratios([a[i] for i in open_], [b[i] for i in open_]) >= least
    return out


# ---- the best stretch ----------------------------------------------------------------------


def _window_bounds(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and ratio bounds of all stretches of ``b`` with the length of ``a``, those cut by an end included.

    Running letter counts of ``b`` give each stretch's counts as a difference.
    """
    own = Counter(a)
    letters = {x: k for k, x in enumerate(own)}
    codes = np.array([letters.get(x, len(letters)) for x in b])
    counts = np.zeros((len(b) + 1, len(letters) + 1), np.int32)
    np.cumsum(codes[:, None] == np.arange(len(letters) + 1), axis=0, out=counts[1:])
    starts = np.arange(1 - len(a), len(b))
    ends = np.minimum(starts + len(a), len(b))
    starts = np.maximum(starts, 0)
    common = np.minimum((counts[ends] - counts[starts])[:, :-1], np.array(list(own.values()))).sum(1)
    return starts, ends, 200.0 * common / (len(a) + ends - starts)


def best_window(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one of at most its length.

    Stretches are tried from the highest bound down, until no bound exceeds what was found.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = 0.0
    for x, y in [(a, b), (b, a)][: 1 + (len(a) == len(b))]:
        where, (starts, ends, bounds) = letter_masks(x), _window_bounds(x, y)
        for k in np.argsort(-bounds, kind="stable").tolist():
            if bounds[k] <= best:
                break
            best = max(best, 200.0 * lcs(where, len(x), y[starts[k] : ends[k]]) / (len(x) + int(ends[k] - starts[k])))
    return best


# ---- columns -------------------------------------------------------------------------------


def indel_ratio(a: Column, b: Column) -> Column:
    """200 times the common subsequence over both lengths; 100 for two empty strings; null counts as ''."""

    @F.pandas_udf("double")
    def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            yield pd.Series(ratios(left.fillna("").tolist(), right.fillna("").tolist()), dtype=float)

    return ratio(a, b)


def ratio_reaches(a: Column, b: Column, least: float) -> Column:
    """Whether ``indel_ratio`` is ``least`` or more, without working out the others."""

    @F.pandas_udf("boolean")
    def reaches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            yield pd.Series(reach(left.fillna("").tolist(), right.fillna("").tolist(), least), dtype=bool)

    return reaches(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def partial_ratio(a: Column, b: Column) -> Column:
    """``best_window`` of two columns; null counts as ''."""

    @F.pandas_udf("double")
    def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            kept: dict[tuple[str, str], float] = {}
            out = []
            for pair in zip(left.fillna(""), right.fillna("")):
                if pair not in kept:
                    kept[pair] = best_window(*pair)
                out.append(kept[pair])
            yield pd.Series(out, dtype=float)

    return ratio(a, b)
