"""Sharding by histogram sort: splitters of a key order that cut the bytes evenly, then one exchange.

Keys are a hash of the text. Groups of equal texts that weigh something are set on shards first, the largest first. Bytes of
all others below candidate boundaries are counted exactly over all partitions, in rounds that look only into the
cells that still hold a wanted splitter, until each splitter meets the tolerance.
"""

from __future__ import annotations

import heapq
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .ranks import chunks_for, cuts_below, with_prefix

KEY_BITS = 63
#: Bits that a round of probes adds.
ROUND_BITS = 10
#: A splitter may be off its place by this share of a shard.
TOLERANCE = 0.005
#: Groups of equal texts from this share of a shard (by bytes or by rows) are placed one by one; there are at most twice the shards over the share.
HEAVY = 0.01
#: Low bits of the second key, which tell rows of one id apart.
ROW_BITS = 24


def _hash(*cols: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 1)


def _locate(rows: DataFrame, key: str, wanted: dict[int, int], tolerance: int) -> dict[int, tuple[int, int]]:
    """b: (boundary, bytes below it) in the order of ``key``, with ``wanted[b]`` bytes below each as nearly as ``tolerance`` or single keys allow."""
    found: dict[int, tuple[int, int]] = {}
    # b: (prefix, bytes below the prefix)
    active = {b: (0, 0) for b in wanted}
    bits = 0
    while active:
        step = min(ROUND_BITS, KEY_BITS - bits)
        old, bits = KEY_BITS - bits, bits + step
        shift = KEY_BITS - bits
        cells = rows
        if old < KEY_BITS:
            cells = rows.where(F.shiftright(key, old).isin(sorted({p for p, _ in active.values()})))
        # at most 2^ROUND_BITS cells for each wanted splitter come to the driver
        got = sorted((r[0], r[1]) for r in cells.groupBy(F.shiftright(key, shift).alias("cell")).agg(F.sum("size")).collect())
        inside: dict[int, list[tuple[int, int]]] = {}
        for cell, n in got:
            inside.setdefault(cell >> step, []).append((cell, n))
        for b, (prefix, below) in list(active.items()):
            del active[b]
            cell, n = prefix << step, 0
            for cell, n in inside.get(prefix, []):
                if below + n >= wanted[b]:
                    break
                below += n
            else:
                n = 0
            low, high = wanted[b] - below, below + n - wanted[b]
            if min(low, high) <= tolerance or not shift:
                found[b] = (cell << shift, below) if low <= high else ((cell + 1) << shift, below + n)
            else:
                active[b] = (cell, below)
    return found


def heavy_keys(rows: DataFrame, least_bytes: float, least_rows: float) -> list[tuple[int, int]]:
    """``(key, bytes)`` of the keys that weigh so much; only cells that do are looked into."""
    bits = 14
    heavy = (F.sum("size") >= least_bytes) | (F.count(F.lit(1)) >= least_rows)
    cell = F.shiftright("key", KEY_BITS - bits)
    cells = [r[0] for r in rows.groupBy(cell.alias("cell")).agg(heavy.alias("heavy")).where("heavy").select("cell").collect()]
    if not cells:
        return []
    keys = rows.where(cell.isin(cells)).groupBy("key").agg(F.sum("size").alias("bytes"), heavy.alias("heavy")).where("heavy")
    return sorted((r.key, r.bytes) for r in keys.collect())


def place_heavy(rows: DataFrame, heavy: list[tuple[int, int]], shards: int, mean: float, tolerance: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """``(key, low, high, shard)`` with the range of the second key, and the bytes so placed on each shard.

    A group that fits into a shard's even part stays whole. A larger one is cut by the second key into pieces of that
    size and one smaller piece. Pieces go to the shard that holds least, largest first.
    """
    top = 1 << KEY_BITS
    pieces: list[tuple[int, int, int, int]] = []
    for key, size in heavy:
        if size <= mean:
            pieces.append((size, key, 0, top))
            continue
        wanted = {b: round(b * mean) for b in range(1, math.ceil(size / mean))}
        cuts = sorted(_locate(rows.where(F.col("key") == key), "key2", wanted, tolerance).values())
        cuts = [(0, 0), *cuts, (top, size)]
        pieces += [(n - m, key, low, high) for (low, m), (high, n) in zip(cuts, cuts[1:], strict=False) if high > low]
    loads = [(0, s) for s in range(shards)]
    placed, held = [], [0] * shards
    for size, key, low, high in sorted(pieces, key=lambda x: (-x[0], x[1:])):
        load, s = heapq.heappop(loads)
        placed.append((key, low, min(high, top - 1), s))
        held[s] = load + size
        heapq.heappush(loads, (held[s], s))
    return placed, held


def room(held: list[int], rest: int) -> list[float]:
    """What each shard still takes of ``rest`` bytes, so that all rise to one level if they aren't above it."""
    level, below = 0.0, 0
    order = sorted(held)
    for i, h in enumerate(order):
        below += h
        level = (rest + below) / (i + 1)
        if i + 1 == len(order) or level <= order[i + 1]:
            break
    return [max(0.0, level - h) for h in held]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``.

    The law is ``bytes``: shards are as equal in size (UTF-8 bytes of the text plus 8; null text has
    none) as single rows and whole groups allow. Rows of equal text share a shard whenever the group isn't larger than a
    shard's even part; larger groups are cut into pieces of that size by a hash of the id. ``slot`` is the place in the
    shard, without gaps. Null counts as empty text for the
    key and checksum; null ids and repeated rows each get a slot. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    of_id = F.shiftleft(F.shiftrightunsigned(_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed=11), ROW_BITS), ROW_BITS)
    of_row = F.shiftrightunsigned(_hash(F.monotonically_increasing_id(), seed=13), KEY_BITS - ROW_BITS)
    rows = scratch.written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _hash(text, seed=7).alias("key"),
            of_id.bitwiseOR(of_row).alias("key2"),
        ),
        "keys",
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean, tolerance = total / shards, int(TOLERANCE * total / shards)
    heavy = heavy_keys(rows, HEAVY * mean, HEAVY * n / shards) if n else []
    placed, held = place_heavy(rows, heavy, shards, mean, tolerance)
    # as many rows as there are pieces of heavy groups
    pieces = F.broadcast(spark.createDataFrame(placed, "heavy long, low long, high long, of int"))
    is_heavy = F.col("heavy").isNotNull()
    here = (F.col("key") == F.col("heavy")) & F.col("key2").between(F.col("low"), F.col("high")) & ((F.col("key2") < F.col("high")) | (F.col("high") == (1 << KEY_BITS) - 1))
    rows = rows.join(pieces, here, "left")
    ends = list(accumulate(room(held, total - sum(held))))
    light = rows.where(~is_heavy)
    found = _locate(light, "key", {b: round(e) for b, e in enumerate(ends[:-1])}, tolerance) if n else {}
    cuts = list(accumulate((found[b][0] for b in sorted(found)), max))
    bits = max(0, math.ceil(math.log2(chunks_for(n, 200, most=1 << 20))))
    chunk = F.shiftleft(F.shiftright("key", KEY_BITS - bits), bits + 1)
    # rows of a heavy group are cut further, by the hash of the id
    chunk = F.when(is_heavy, chunk + 1 + F.shiftright("key2", KEY_BITS - bits)).otherwise(chunk)
    rows = rows.select("doc_id", "size", "text_crc32", "key", "key2", F.coalesce("of", cuts_below("key", cuts)).alias("shard"), chunk.alias("chunk"))
    ranked = with_prefix(rows, ["shard"], "chunk", ["key", "key2", "doc_id"], name="slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
