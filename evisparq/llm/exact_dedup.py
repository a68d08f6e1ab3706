"""Exact deduplication with a log-structured merge index of text digests.

Memtables collapse the copies among a bounded number of rows; what is left is exchanged by digest range once, and flushed
inside each range as sorted runs of a bounded number of entries with a Bloom filter each. Compaction merges the runs of a
range, looking a digest up in an older run only behind that run's filter, and keeps one identifier of each digest. A digest of several rows is a hit, and the
texts behind hits are compared byte by byte before any row goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Rows a memtable holds before it is flushed.
MEMTABLE_ROWS = 200_000
#: Entries that a digest range of the index is meant to hold.
RANGE_ENTRIES = 100_000
#: Bits and hash functions of a run's filter for each entry.
FILTER_BITS, FILTER_HASHES = 10, 4

ENTRY_SCHEMA = "bucket int, digest binary, id long, count long"
RUN_SCHEMA = "bucket int, n long, digests binary, ids array<long>, counts array<long>, bloom binary"


def bloom_build(digests: np.ndarray) -> bytes:
    """A filter over rows of digest bytes; the digest is uniform, so its own words are the hashes."""
    bits = max(64, -(-len(digests) * FILTER_BITS // 64) * 64)
    out = np.zeros(bits, bool)
    for at in _spots(digests, bits):
        out[at] = True
    return np.packbits(out).tobytes()


def bloom_might_contain(bloom: bytes, digests: np.ndarray) -> np.ndarray:
    """False only for digests that are not in the filter."""
    bits = np.unpackbits(np.frombuffer(bloom, np.uint8)).astype(bool)
    found = np.ones(len(digests), bool)
    for at in _spots(digests, len(bits)):
        found &= bits[at]
    return found


def _spots(digests: np.ndarray, bits: int) -> list[np.ndarray]:
    words = np.ascontiguousarray(digests[:, :16]).view("<u4")
    return [words[:, i % words.shape[1]].astype(np.int64) * (i // words.shape[1] + 1) % bits for i in range(FILTER_HASHES)]


def _binary(rows: np.ndarray) -> pa.Array:
    """An Arrow column of fixed-width rows."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def merge_sorted(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by digest with one identifier and the summed count of each."""
    if not len(digests):
        return digests, ids, counts
    key = digests.view(f"S{digests.shape[1]}").ravel() if digests.shape[1] else None
    # fixed-width byte strings drop trailing zeros when compared, which keeps equal width keys distinct
    order = np.lexsort((-ids if largest else ids, key))
    digests, ids, counts = digests[order], ids[order], counts[order]
    first = np.ones(len(order), bool)
    first[1:] = (digests[1:] != digests[:-1]).any(axis=1)
    starts = np.flatnonzero(first)
    return digests[starts], ids[starts], np.add.reduceat(counts, starts)


def _memtables(width: int, buckets: int, largest: bool, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            digests = np.concatenate([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            digests, ids, counts = merge_sorted(digests, ids, np.ones(len(ids), np.int64), largest)
            bucket = np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64) * buckets >> 32
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), _binary(digests), pa.array(ids), pa.array(counts)], ["bucket", "digest", "id", "count"])

        for batch in batches:
            if not batch.num_rows:
                continue
            digests = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width)
            held.append((digests, np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)))
            n += len(digests)
            if n >= limit:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def _runs(width: int, largest: bool, limit: int):
    def run(table: pa.Table) -> pa.Table:
        digests = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, width)
        ids, counts = table.column("id").to_numpy(), table.column("count").to_numpy()
        bucket, out = table.column("bucket")[0].as_py(), []
        for low in range(0, len(ids), limit):
            part = slice(low, low + limit)
            d, i, c = merge_sorted(digests[part], ids[part], counts[part], largest)
            out.append((bucket, len(i), d.tobytes(), i, c, bloom_build(d)))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "n", "digests", "ids", "counts", "bloom"])

    return run


class Run(NamedTuple):
    """A sorted run of distinct digests (fixed-width byte strings) with its filter."""

    digests: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    bloom: bytes

    def rows(self) -> np.ndarray:
        return np.ascontiguousarray(self.digests).view(np.uint8).reshape(len(self.digests), self.digests.dtype.itemsize)


def merge_runs(older: Run, newer: Run, largest: bool) -> Run:
    """One run of both. Only digests of the newer one that the older one's filter lets through are searched in it."""
    maybe = np.flatnonzero(bloom_might_contain(older.bloom, newer.rows()))
    at = np.minimum(np.searchsorted(older.digests, newer.digests[maybe]), len(older.digests) - 1)
    same = older.digests[at] == newer.digests[maybe]
    at, hit = at[same], maybe[same]
    ids, counts = older.ids.copy(), older.counts.copy()
    ids[at] = np.maximum(ids[at], newer.ids[hit]) if largest else np.minimum(ids[at], newer.ids[hit])
    counts[at] += newer.counts[hit]
    fresh = np.ones(len(newer.digests), bool)
    fresh[hit] = False
    into = np.searchsorted(older.digests, newer.digests[fresh])
    digests = np.insert(older.digests, into, newer.digests[fresh])
    ids, counts = np.insert(ids, into, newer.ids[fresh]), np.insert(counts, into, newer.counts[fresh])
    return Run(digests, ids, counts, bloom_build(np.ascontiguousarray(digests).view(np.uint8).reshape(len(digests), -1)))


def compacted(runs: Iterator[Run], largest: bool) -> Run | None:
    """All runs as one. A run is merged with the one before as soon as it is half its size, so that each digest moves a logarithmic number of times."""
    level: list[Run] = []
    for run in runs:
        level.append(run)
        while len(level) > 1 and 2 * len(level[-1].digests) >= len(level[-2].digests):
            newer, older = level.pop(), level.pop()
            level.append(merge_runs(older, newer, largest))
    while len(level) > 1:
        newer, older = level.pop(), level.pop()
        level.append(merge_runs(older, newer, largest))
    return level[0] if level else None


def _compact(width: int, largest: bool):
    def run(table: pa.Table) -> pa.Table:
        columns = (table.column(c).to_pylist() for c in ("digests", "ids", "counts", "bloom"))
        runs = (Run(np.frombuffer(d, f"S{width}"), np.asarray(i, np.int64), np.asarray(c, np.int64), b) for d, i, c, b in zip(*columns, strict=True))
        one = compacted(runs, largest)
        bucket = table.column("bucket")[0].as_py()
        return pa.table([[bucket], [len(one.ids)], [one.rows().tobytes()], [one.ids.tolist()], [one.counts.tolist()], [one.bloom]], schema=table.schema)

    return run


def flush_runs(keyed: DataFrame, width: int, buckets: int, largest: bool, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Level 0: sorted runs of ``key_id, digest`` rows inside each digest range. Their number follows the rows, however many ranges there are."""
    entries = keyed.select("key_id", "digest").mapInArrow(_memtables(width, buckets, largest, memtable_rows), ENTRY_SCHEMA)
    return entries.groupBy("bucket").applyInArrow(_runs(width, largest, memtable_rows), RUN_SCHEMA)


def compact_runs(runs: DataFrame, width: int, largest: bool) -> DataFrame:
    """Level 1: the runs of each digest range merged into one. A run holds a digest once, however many rows had it."""
    return runs.groupBy("bucket").applyInArrow(_compact(width, largest), RUN_SCHEMA)


def _hits(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digests, ids, counts in zip(batch.column("digests").to_pylist(), batch.column("ids").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keep = np.flatnonzero(np.asarray(counts) > 1)
                if len(keep):
                    rows = np.frombuffer(digests, np.uint8).reshape(-1, width)[keep]
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rows], pa.binary()), pa.array(np.asarray(ids, np.int64)[keep]), pa.array(np.asarray(counts, np.int64)[keep])], ["digest", "index_id", "index_size"])

    return run


def _lookup(width: int):
    def run(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[bytes, int, int]] = []
        wanted = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in asked.column("digests").to_pylist()]
        query = np.unique(np.concatenate(wanted), axis=0) if wanted else np.zeros((0, width), np.uint8)
        for digests, ids, counts, bloom in zip(*(index.column(c).to_pylist() for c in ("digests", "ids", "counts", "bloom")), strict=True):
            # a run is searched only for what its filter lets through
            maybe = query[bloom_might_contain(bloom, query)] if len(query) else query
            have = np.frombuffer(digests, f"V{width}")
            if not len(maybe) or not len(have):
                continue
            names = [x.tobytes() for x in maybe]
            place = {d.tobytes(): i for i, d in enumerate(have)}
            out += [(d, ids[place[d]], counts[place[d]]) for d in names if d in place]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["digest", "index_id", "index_size"])

    return run


def lookup(index: DataFrame, runs: DataFrame, width: int = 32) -> DataFrame:
    """``digest, index_id, index_size`` of the digests in the runs of a new batch that an index of the same ranges holds.

    Both sides are cut by digest range, and each range is searched where its run is, behind the run's filter. Hits still need byte
    verification, as in ``exact_groups``.
    """
    return index.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(_lookup(width), "digest binary, index_id long, index_size long")


def exact_groups(docs: DataFrame, digest: Column | None = None, width: int = 32, largest: bool = True, memtable_rows: int = MEMTABLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal when their bytes are; null counts as empty. The row with the largest id (or the smallest)
    of equal texts stays; null ids lose against all others, and rows that share the winning id are all kept.
    An empty table gives an empty result; other columns of ``docs`` are ignored. ``digest`` may be a
    weaker expression over ``text`` of ``width`` bytes: texts that only share it stay apart.
    """
    low = -(2**63)
    # a null identifier is the worst there is
    null_id = low if largest else 2**63 - 1
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)) if digest is None else digest
    base = base.withColumn("digest", digest)
    n = docs.count()
    keyed = scratch.written(base.select("doc_id", F.coalesce("doc_id", F.lit(null_id)).alias("key_id"), "digest", F.sha2("text", 256).alias("text_sha256")), "digests", n)
    buckets = max(16, -(-n // RANGE_ENTRIES))
    runs = scratch.written(flush_runs(keyed, width, buckets, largest, memtable_rows), "level0")
    index = scratch.written(compact_runs(runs, width, largest), "level1")
    hits = scratch.written(index.select("digests", "ids", "counts").mapInArrow(_hits(width), "digest binary, index_id long, index_size long"), "hits")
    n_hits = hits.count()
    # byte verification: rows behind hits are grouped by their text itself, copies of a task first
    behind = base.join(scratch.sized(hits.select("digest"), n_hits), "digest", "left_semi")
    best = F.max if largest else F.min
    texts = behind.groupBy("digest", "text").agg(best(F.coalesce("doc_id", F.lit(null_id))).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    checked = scratch.written(texts.select("digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "checked")
    groups = checked.select("text_sha256", "digest", F.when(F.col("keep_id") != null_id, F.col("keep_id")).alias("keep_id"), "group_size")
    # texts behind one digest are told apart by their own hash here, having been compared as bytes above
    found = keyed.select("doc_id", "digest", "text_sha256").join(scratch.sized(groups, n_hits), ["digest", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
