"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

import re

import numpy as np

_CUT = re.compile("[A-Z\\x20\\x09-\\x0d]")  # what ``word_hashes`` changes or cuts at
_seed = np.random.default_rng(20240229)
_BYTE = _seed.integers(0, 1 << 64, 256, np.uint64)
_SHINGLE = _seed.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_LENGTH = _seed.integers(0, 1 << 64, 64, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i for i below n, modulo 2**64."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= 1 << 20:
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


PIECE = 1 << 18  # bytes hashed at a time (one word at least)


def word_hashes(texts: list[str], between: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and how many each text has.

    A word is a run of bytes that don't stand ``between`` words (white space:
    space and 0x09 to 0x0D). Its hash is a polynomial over random values of
    its bytes, modulo 2**64, then mixed. Bytes are worked on in pieces that end
    between words, so that long texts need little memory beside their hashes.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not between[data[end - 1]]:
            gap = np.flatnonzero(between[data[end : end + PIECE]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + PIECE, len(data))
        own, first = _piece_hashes(data[at:end], between)
        hashes.append(own)
        starts.append(first + at)
        at = end
    limits = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(np.concatenate(starts), limits)
    return np.concatenate(hashes), np.diff(upto, prepend=0)


def _piece_hashes(data: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece whose last byte is between words."""
    white = between[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts]), starts


def polynomial_sums(data: np.ndarray) -> np.ndarray:
    """Running sums over the bytes of a text, from which ``part_hashes`` has the hash of any part."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    return total


def part_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all parts of ``length`` bytes, by their first byte."""
    n = len(sums) - length
    return mix((sums[length:] - sums[:n]) * _power(_INVERSE, n))


def whole_hashes(texts: list[str]) -> np.ndarray:
    """The hash of each text as one part."""
    if all(texts) and not _CUT.search("".join(texts)):
        return word_hashes(texts)[0]  # one word each: all at once
    sums = (polynomial_sums(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in texts)
    return mix(np.array([s[-1] for s in sums], np.uint64))


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of every text.

    A text with fewer words is one shingle of all of them; without words the
    set is empty. Sets are compared by 64-bit hashes of whole shingles.
    """
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    rolled = np.full(max(0, n - words + 1), _LENGTH[words], np.uint64)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * _SHINGLE[k]
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            own = rolled[at : at + c - words + 1]
            own = np.sort(own)
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif c:
            out.append(mix(np.array([np.sum(np.append(hashes[at : at + c] * _SHINGLE[:c], _LENGTH[c]))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
