"""Best-fit packing of token sequences by exact complements of lengths.

Only the histogram of piece lengths reaches the driver (at most ``capacity`` numbers). The plan
looks the gap of a sequence up among sums of single lengths, then pairs, then triples, consumes what fills it exactly as far as counts
allow, and places what is left best-fit, where gaps of open sequences are looked up in the same way. Each step of the plan covers as many sequences as
counts allow at once, so that the plan's size follows the number of lengths, not of pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .codec import codec
from .ranks import chunks_for, with_prefix

CAPACITY = 2048
#: A step: the lengths in one sequence, and how many sequences are filled so.
Step = tuple[tuple[int, ...], int]

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Complements:
    """Which lengths fill a gap exactly: an index of single, pair and triple sums over lengths that are still there.

    A sum's pairs are listed when it is first asked for, and a pair whose lengths have run out leaves the list for good, since counts
    only fall. A triple is a length and a pair of the rest.
    """

    def __init__(self, counts: list[int], uneven: bool = True) -> None:
        self.counts, self.uneven = counts, uneven
        self.lengths = [x for x, n in enumerate(counts) if n > 0 and x]
        self.pairs: dict[int, list[int]] = {}

    def _there(self, *parts: int) -> bool:
        return all(self.counts[x] >= parts.count(x) for x in parts)

    def pair(self, total: int) -> tuple[int, int] | None:
        """The most uneven pair of this sum that is there, or the most even one."""
        if total not in self.pairs:
            low = bisect.bisect_left(self.lengths, (total + 1) // 2)
            high = bisect.bisect_left(self.lengths, total)
            found = [x for x in self.lengths[low:high] if self.counts[x] and self.counts[total - x]]
            self.pairs[total] = found if self.uneven else found[::-1]
        listed = self.pairs[total]
        while listed:
            if self._there(listed[-1], total - listed[-1]):
                return listed[-1], total - listed[-1]
            listed.pop()
        return None

    def find(self, gap: int, arity: int = 3, also: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Up to ``arity`` lengths that fill ``gap``, beside the lengths of ``also``, which must be there as well."""
        if gap <= 0:
            return None
        if gap < len(self.counts) and self._there(gap, *also):
            return (gap,)
        if arity >= 2 and (two := self.pair(gap)) and self._there(*two, *also):
            return two
        if arity >= 3:
            self.lengths = [x for x in self.lengths if self.counts[x]]
            for i in range(bisect.bisect_left(self.lengths, gap - 1) - 1, -1, -1):
                x = self.lengths[i]
                if 3 * x < gap:
                    break
                if (two := self.pair(gap - x)) and self._there(x, *two, *also):
                    return (x, *two)
        return None

    def take(self, parts: tuple[int, ...], most: int) -> int:
        """Use up these lengths as often as counts allow, ``most`` times at most."""
        need = {x: parts.count(x) for x in parts}
        n = min(most, *(self.counts[x] // k for x, k in need.items()))
        for x, k in need.items():
            self.counts[x] -= k * n
        return n


def exact_steps(counts: list[int], capacity: int, arity: int, descending: bool, uneven: bool = True) -> list[Step]:
    """Steps that fill sequences exactly: a length and up to ``arity`` others for its gap; ``counts`` is reduced."""
    steps: list[Step] = []
    index = Complements(counts, uneven)
    if counts[capacity]:
        steps.append(((capacity,), index.take((capacity,), counts[capacity])))
    for a in range(capacity - 1, 0, -1) if descending else range(1, capacity):
        while counts[a] and (rest := index.find(capacity - a, arity, (a,))):
            steps.append(((a, *rest), index.take((a, *rest), counts[a])))
    return steps


def best_fit_steps(counts: list[int], capacity: int) -> list[Step]:
    """Best-fit decreasing over counts: bins alike in contents are moved together; ``counts`` is emptied.

    A bin whose gap some of the lengths that are left fill exactly is closed with them at once.
    """
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    gaps: list[int] = []
    closed: list[Step] = []
    index = Complements(counts)

    def put(parts: tuple[int, ...], gap: int, n: int) -> None:
        while n and (rest := index.find(gap)):
            used = index.take(rest, n)
            closed.append((parts + rest, used))
            n -= used
        if not n:
            return
        if gap not in open_bins:
            open_bins[gap] = {}
            bisect.insort(gaps, gap)
        open_bins[gap][parts] = open_bins[gap].get(parts, 0) + n

    for length in range(capacity, 0, -1):
        left, counts[length] = counts[length], 0
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                per = capacity // length
                if left >= per:
                    put((length,) * per, capacity - per * length, left // per)
                if left % per:
                    put((length,) * (left % per), capacity - (left % per) * length, 1)
                break
            gap = gaps[at]
            parts, n = open_bins[gap].popitem()
            if not open_bins[gap]:
                del open_bins[gap], gaps[at]
            fit = gap // length
            used = min(n, left // fit)
            if used:
                put(parts + (length,) * fit, gap - fit * length, used)
                left -= used * fit
            elif left:
                put(parts + (length,) * left, gap - left * length, 1)
                left, used = 0, 1
            if n > used:
                put(parts, gap, n - used)
    return closed + [(parts, n) for gap in open_bins for parts, n in open_bins[gap].items()]


def make_plan(counts: list[int], capacity: int = CAPACITY) -> list[Step]:
    """The best of the orders in which exact complements may be consumed; residuals go best-fit. Ends early at the least number there can be."""
    least = -(-sum(i * n for i, n in enumerate(counts)) // capacity)
    best: list[Step] = []
    for arity, descending, uneven in ((3, True, False), (2, True, False), (3, True, True), (2, True, True), (1, True, True), (3, False, True), (0, True, True)):
        left = list(counts)
        steps = exact_steps(left, capacity, arity, descending, uneven) if arity else []
        steps += best_fit_steps(left, capacity)
        if not best or sum(n for _, n in steps) < sum(n for _, n in best):
            best = steps
        if sum(n for _, n in best) == least:
            break
    return best


class PlanIndex:
    """Looks up, for a length and the rank of a piece among those of its length, the sequence and place."""

    def __init__(self, plan: list[Step], capacity: int = CAPACITY) -> None:
        used = [0] * (capacity + 1)
        rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        base = 0
        for parts, n in plan:
            offset = 0
            for x in parts:
                rows[x].append((used[x], base, offset, n))
                used[x] += n
                offset += x
            base += n
        self.sequences = base
        self.rows = [np.array(x, np.int64).reshape(-1, 4) for x in rows]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            which = np.flatnonzero(length == x)
            table = self.rows[x]
            at = np.searchsorted(table[:, 0], rank[which], side="right") - 1
            sequence[which] = table[at, 1] + rank[which] - table[at, 0]
            offset[which] = table[at, 2]
        return sequence, offset


def _pieces(path: str, end: bytes, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), codec(path).encode(batch.column(1).to_pylist()), strict=True):
                raw = memoryview(ids + end)
                n = len(raw) // 4
                first = n % capacity or min(n, capacity)
                start = 0
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    out.append((doc, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                    start = stop
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = index.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A document is its ids and ``end_id``; null text counts as empty and gives one piece of length 1. Longer ones are cut into
    pieces of ``capacity``, the first of which is the shorter one. Rows with null or repeated ids are packed
    like any other. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.written(docs.mapInArrow(_pieces(tokenizer_path, int(end_id).to_bytes(4, "little"), capacity), PIECE_SCHEMA), "pieces")
    counts = [0] * (capacity + 1)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    index = spark.sparkContext.broadcast(PlanIndex(make_plan(counts, capacity), capacity))
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks_for(sum(counts)))))
    ranked = with_prefix(pieces, ["length"], "chunk", ["doc_id", "piece", "ids_crc32"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(index), PIECE_SCHEMA + ", sequence_id long, offset long")
