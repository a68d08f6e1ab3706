"""Hashes of word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers[0][:n], _powers[1][:n]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order. Words are runs of bytes other than white space; A-Z count as a-z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = _WHITE[data]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    bounds = np.cumsum([len(x) + 1 for x in texts])
    return mixed(hashes ^ (ends - starts).astype(np.uint64)), np.searchsorted(bounds, starts, side="right")


def shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (hash, text number) pairs of ``size``-word shingles; a shorter text is one shingle, one without words none."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word, of = words(texts)
    counts = np.bincount(of, minlength=len(texts))
    whole = counts >= size
    starts = np.cumsum(counts) - counts
    at = np.flatnonzero(of[: len(of) - size + 1] == of[size - 1 :]) if len(of) >= size else np.zeros(0, np.int64)
    value = np.full(len(at), size, np.uint64)
    for i in range(size):
        value = (value * _STEP) ^ word[at + i]
        value = value * _BASE
    docs = of[at]
    short = np.flatnonzero(~whole & (counts > 0))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for k, d in enumerate(short):
            v = np.array([counts[d]], np.uint64)
            for w in word[starts[d] : starts[d] + counts[d]]:
                v = (v * _STEP) ^ w
                v = v * _BASE
            few[k] = v[0]
        value, docs = np.concatenate([value, few]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        value, docs = value[order], docs[order]
    value = mixed(value)
    order = np.argsort(value, kind="stable")
    value, docs = value[order], docs[order]
    if len(value):
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (docs[1:] != docs[:-1])
        value, docs = value[fresh], docs[fresh]
    return value, docs
