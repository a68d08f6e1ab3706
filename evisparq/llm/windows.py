"""Anchors of fixed-length windows: equal windows have the same anchor at the same offset.

The anchor of a window is its q-gram of the lowest hash, the leftmost of equals. It depends
on the window's bytes alone, so that each window start belongs to one anchor, and starts of equal windows to anchors of
equal hash. A run of neighbouring starts shares an anchor's hash: one anchor in most texts, several where a text is periodic.
"""

from __future__ import annotations

import numpy as np

from .shingles import _upto, mixed

#: Bits of a key that hold the position; the others hold the hash.
PLACE_BITS = 30
GRAM = 64
#: Bytes that are hashed at once (a longer text in overlapping pieces of that many starts), and most starts in a run.
PIECE = 2 << 20
MOST_STARTS = 256


def anchors(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first start, number of starts, and anchor's distance from the first start, of each run."""
    none = np.zeros(0, np.int64)
    sizes = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    gram = min(gram, length)
    if n < length or not (sizes >= length).any():
        return none.astype(np.uint64), none, none, none, none
    if n >= 1 << PLACE_BITS:
        raise ValueError("too much text at once")
    power, inverse = _upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    grams = n - gram + 1
    hashes = mixed((sums[gram:] - sums[:grams]) * inverse[:grams])
    mask = np.uint64((1 << PLACE_BITS) - 1)
    keys = (hashes & ~mask) | np.arange(grams, dtype=np.uint64)
    lowest = _sliding_min(keys, length - gram + 1)
    at = (lowest & mask).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = np.flatnonzero(np.repeat(ends, sizes)[: len(at)] - np.arange(len(at)) >= length)
    if not len(starts):
        return none.astype(np.uint64), none, none, none, none
    mine = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (np.diff(starts) != 1)
    run = np.flatnonzero(new)
    counts = np.diff(np.append(run, len(starts)))
    first, anchor = starts[run], mine[run]
    text = np.searchsorted(ends, first, side="right")
    return hashes[anchor], text, first - (ends - sizes)[text], counts, anchor - first


class Runs:
    """Runs of starts: hash, text number, first start and number of starts, and of each run the anchors' places from its first start on."""

    def __init__(self, length: int, gram: int = GRAM):
        self.length, self.gram = length, gram
        none = np.zeros(0, np.int64)
        self.hashes, self.text, self.first, self.count = none.astype(np.uint64), none, none, none
        self.places, self.bounds = none, np.zeros(1, np.int64)

    def take(self, rows: np.ndarray) -> list[bytes]:
        """The places of some runs, two bytes each."""
        return [self.places[self.bounds[i] : self.bounds[i + 1]].astype("<u2").tobytes() for i in rows.tolist()]

    @property
    def several(self) -> np.ndarray:
        return np.diff(self.bounds) > 1


def runs(texts: list[bytes], length: int, gram: int = GRAM) -> Runs:
    """The runs of all starts of ``texts``. They depend on each text alone, not on those beside it."""
    parts = []
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        hashes, text, first, count, lead = anchors([x[2] for x in group], length, gram)
        base = np.array([x[1] for x in group], np.int64)
        parts.append((hashes, np.array([x[0] for x in group], np.int64)[text], first + base[text], count, lead, text))

    for i, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - length + 1), PIECE):
            piece = raw[at : at + PIECE + length - 1] if len(raw) > PIECE else raw
            group.append((i, at, piece))
            held += len(piece)
            if held >= PIECE:
                flush()
                group, held = [], 0
    if group:
        flush()
    found = Runs(length, gram)
    merged = []
    for hashes, text, first, count, lead, piece in parts:
        if not len(hashes):
            continue
        joins = np.zeros(len(hashes), bool)
        joins[1:] = (hashes[1:] == hashes[:-1]) & (piece[1:] == piece[:-1]) & (first[1:] == first[:-1] + count[:-1])
        # neighbours of one hash are one run, cut where it has enough starts
        begin = np.flatnonzero(~joins)
        since = first - np.repeat(first[begin], np.diff(np.append(begin, len(first))))
        cut = since // (MOST_STARTS // 2)
        joins[1:] &= cut[1:] == cut[:-1]
        at = np.flatnonzero(~joins)
        own = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(first))))
        merged.append((hashes[at], text[at], first[at], np.add.reduceat(count, at), first + lead - first[at][own], np.diff(np.append(at, len(first)))))
    if merged:
        found.hashes, found.text, found.first, found.count, found.places, sizes = (np.concatenate(x) for x in zip(*merged, strict=True))
        found.bounds = np.concatenate([[0], np.cumsum(sizes)])
    return found


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks to either side."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])
