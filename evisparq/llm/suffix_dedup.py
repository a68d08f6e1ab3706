"""Removal of byte strings that repeat, by suffix arrays in linear grouping construction.

Texts are cut at anchors (see ``windows``) into contexts: runs of a bounded number of window starts with the bytes that those windows
cover. Starts of equal windows lie in contexts of the same anchor hash, so that the contexts of one hash are a
search of their own. Hashes that occur once are settled. For the others a suffix array of the
distinct contexts (see ``GroupingSuffixes.java``) with its longest common prefixes tells which starts repeat. Equal whole
texts are held once: all their windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from . import jvm, scratch
from .keys import keyed_rows, whole_copies
from .ranks import table_part
from .windows import runs

LENGTH = 200
#: Bytes of text whose anchors are found at once, and whose anchors go to one part of the index, about.
CHUNK_BYTES = 2 << 20
PART_BYTES = 16 << 20
#: Hashes of more distinct contexts are searched in narrower runs of starts, told apart by the bytes all their windows share, and
#: what is still too many in runs of one start, which then are equal windows.
MOST_CONTEXTS = 1_000
NARROW = (8, 1)
#: Contexts in an Arrow batch.
CONTEXTS = 20_000

ANCHOR_SCHEMA = "part int, chunk long, hashes binary, places binary, starts binary"
FOUND_SCHEMA = "chunk long, kind int, a binary, b binary"
MATCH_SCHEMA = "key long, starts array<int>"
CONTEXT_SCHEMA = "hash long, context binary, key long, first int, places binary"


def _raw(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _spans_of(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values, prepend=-1))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)], strict=False))


def _index(bits: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 28
        keys: list[int] = []
        texts: list[bytes] = []
        held = seq = 0

        def flush() -> pa.RecordBatch:
            chunk = task | seq
            found = runs(texts, length)
            # a run of several anchors may repeat in itself: it counts twice
            rows = np.repeat(np.arange(len(found.hashes)), 1 + found.several)
            rows = rows[np.argsort(found.hashes[rows], kind="stable")]
            hashes, text, first = found.hashes[rows], found.text[rows].astype("<u4"), found.first[rows].astype("<u4")
            low = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :7]
            part = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            rows = [(table_part(chunk), chunk, np.array(keys, "<i8").tobytes(), b"", b"")]
            rows += [(int(part[a]), chunk, low[a:b].tobytes(), text[a:b].tobytes(), first[a:b].tobytes()) for a, b in _spans_of(part)]
            c = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.binary()) for x in c[2:])], ["part", "chunk", "hashes", "places", "starts"])

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), strict=True):
                keys.append(key)
                texts.append(raw)
                held += len(raw)
                if held >= CHUNK_BYTES:
                    yield flush()
                    keys, texts, held, seq = [], [], 0, seq + 1
        if keys:
            yield flush()

    return run


def _repeated(bits: int):
    """Of one part: the places of anchors whose hash occurs twice or more, back to their chunks."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        chunks = table.column("chunk").to_pylist()
        hashes, places, starts = (table.column(x).to_pylist() for x in ("hashes", "places", "starts"))
        if part < 0:
            out = [(c, 0, a, b"") for c, a in zip(chunks, hashes, strict=True)]
        else:
            sizes = np.array([len(x) // 4 for x in places])
            value = np.zeros((int(sizes.sum()), 8), np.uint8)
            value[:, :7] = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 7)
            value[:, 7] = part >> (bits - 8)
            value = value.view("<u8").ravel()
            order = np.argsort(value, kind="stable")
            same = np.zeros(len(value) + 1, bool)
            same[1:-1] = value[order][1:] == value[order][:-1]
            keep = order[same[1:] | same[:-1]]
            source = np.repeat(np.arange(len(chunks)), sizes)[keep]
            again = np.argsort(source, kind="stable")
            keep, source = keep[again], source[again]
            place, start = np.frombuffer(b"".join(places), "<u4")[keep], np.frombuffer(b"".join(starts), "<u4")[keep]
            out = [(chunks[source[a]], 1, place[a:b].tobytes(), start[a:b].tobytes()) for a, b in _spans_of(source)]
        c = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], names=["chunk", "kind", "a", "b"])

    return run


def _matches(table: pa.Table) -> pa.Table:
    """Of one chunk: the repeated anchors' first starts by document."""
    kind = table.column("kind").to_pylist()
    a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
    keys = np.frombuffer(a[kind.index(0)], "<i8")
    rest = [i for i, k in enumerate(kind) if k]
    place = np.frombuffer(b"".join(a[i] for i in rest), "<u4").astype(np.int64)
    start = np.frombuffer(b"".join(b[i] for i in rest), "<u4").astype(np.int32)
    order = np.argsort(place, kind="stable")
    place, start = place[order], start[order]
    spans = _spans_of(place)
    return pa.table([pa.array([int(keys[place[x]]) for x, _ in spans], pa.int64()), pa.array([start[x:y] for x, y in spans], pa.list_(pa.int32()))], names=["key", "starts"])


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), _raw(batch.column(1))
            wanted = [np.asarray(x.values) for x in batch.column(2)]
            low = 0
            while low < len(keys):
                high, held = low, 0
                while high < len(keys) and held < CHUNK_BYTES:
                    held += len(texts[high])
                    high += 1
                found = runs(texts[low:high], length)
                marked = np.concatenate([np.asarray(w, np.int64) + (i << 40) for i, w in enumerate(wanted[low:high])])
                keep = np.flatnonzero(np.isin((found.text << 40) + found.first, marked))
                # in batches that stay small, however long a text is
                for some in np.array_split(keep, max(1, -(-len(keep) // CONTEXTS))):
                    text, first, count = found.text[some], found.first[some], found.count[some]
                    cut = [texts[low + t][f : f + c + length - 1] for t, f, c in zip(text.tolist(), first.tolist(), count.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.hashes[some].view(np.int64)), pa.array(cut, pa.binary()), pa.array([keys[low + t] for t in text.tolist()], pa.int64()), pa.array(first.astype(np.int32)), pa.array(found.take(some), pa.binary())],
                        ["hash", "context", "key", "first", "places"],
                    )
                low = high

    return run


def _narrower(length: int, width: int):
    """Contexts cut into runs of starts at equal distances from their anchor, with the shared bytes in the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, context, key, first, places in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                starts = len(context) - length + 1
                s = 0
                for anchor in np.frombuffer(places, "<u2").tolist():
                    while s <= anchor and s < starts:
                        # distances anchor - s of one run share a multiple of the width
                        low = (anchor - s) // width * width
                        stop = min(starts, anchor - low + 1)
                        core = context[anchor - low : anchor - low - width + 1 + length]
                        digest = hashlib.blake2b(core + h.to_bytes(8, "little", signed=True) + low.to_bytes(8, "little", signed=True), digest_size=8).digest()
                        rows.append((int.from_bytes(digest, "little", signed=True), context[s : stop - 1 + length], key, first + s, (anchor - s).to_bytes(2, "little")))
                        s = stop
            c = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.binary())], ["hash", "context", "key", "first", "places"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests, sizes = [], [], [], []
            for raw, whole, found in zip(_raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                sizes.append(len(raw))
                if whole and len(raw) >= length:
                    spans = [(0, len(raw))]
                elif found:
                    spans = merge_spans(np.concatenate([np.frombuffer(x["spans"], ">i4").reshape(-1, 2).astype(np.int64) + x["first"] for x in found]))
                else:
                    spans = []
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                removed.append(sum(b - a for a, b in spans))
                runs.append(len(spans))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def merge_spans(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of [begin, end) rows; runs that touch are one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return list(zip(spans[at, 0].tolist(), reach[np.append(at[1:], len(spans)) - 1].tolist(), strict=True))


def repeated_spans(contexts: DataFrame, length: int) -> DataFrame:
    """``hash, id, spans`` of each distinct context in which any window repeats among those of its hash."""
    jvm.register(contexts.sparkSession, "evisparq_repeat_spans", "GroupingSuffixes", ArrayType(BinaryType()))
    distinct = contexts.groupBy("hash", "context").agg(F.count(F.lit(1)).alias("n"))
    groups = distinct.groupBy("hash").agg(F.collect_list(F.struct("context", "n")).alias("g"))
    found = groups.select("hash", F.explode(F.arrays_zip(F.col("g.context").alias("context"), F.expr(f"evisparq_repeat_spans(g.context, g.n, {length})").alias("spans"))).alias("x"))
    return found.where(F.length("x.spans") > 0).select("hash", F.unhex(F.md5("x.context")).alias("id"), F.col("x.spans").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same text or another;
    overlaps count, and strings are judged on the input. Null counts as empty; texts shorter than ``length`` stay. Rows of
    one id, or of none, are texts of their own, so that a repeated row removes itself. An empty table gives an empty result;
    other columns are ignored.
    """
    rows, _ = keyed_rows(docs, id_col, text_col)
    total = scratch.input_bytes(rows, "text")
    copies, n_copies = whole_copies(rows, F.col("text"), rows.count())
    copies = copies.withColumn("whole", F.lit(True))
    texts = rows.select("key", F.col("text").cast("binary").alias("text")).join(scratch.sized(copies.where("key <> same").select("key"), n_copies), "key", "left_anti")
    if n_copies > scratch.BROADCAST_ROWS:
        texts = scratch.written(texts, "texts")  # chunks are numbered by task, which must read the same rows when run again
    bits = min(22, max(8, int(np.ceil(np.log2(max(1, total / PART_BYTES))))))
    index = texts.mapInArrow(_index(bits, length), ANCHOR_SCHEMA)
    repeated = index.groupBy("part").applyInArrow(_repeated(bits), FOUND_SCHEMA)
    matches = scratch.written(repeated.groupBy("chunk").applyInArrow(_matches, MATCH_SCHEMA), "matches")
    contexts = texts.join(matches, "key").mapInArrow(_contexts(length), CONTEXT_SCHEMA)
    contexts = scratch.written(contexts.withColumn("id", F.unhex(F.md5("context"))), "contexts")
    for width in NARROW:
        many = scratch.written(contexts.select("hash", "id").distinct().groupBy("hash").count().where(F.col("count") > MOST_CONTEXTS).select("hash"), "many")
        n_many = many.count()
        if not n_many:
            break
        hot = contexts.join(scratch.sized(many, n_many), "hash", "left_semi").drop("id").mapInArrow(_narrower(length, width), CONTEXT_SCHEMA)
        cold = contexts.join(scratch.sized(many, n_many), "hash", "left_anti")
        contexts = scratch.written(cold.unionByName(hot.withColumn("id", F.unhex(F.md5("context")))), "narrow")
    spans = scratch.written(repeated_spans(contexts.select("hash", "context"), length), "spans")
    found = contexts.select("hash", "id", "key", "first").join(spans, ["hash", "id"]).groupBy("key").agg(F.collect_list(F.struct("first", "spans")).alias("found"))
    everyone = rows.join(scratch.sized(copies.select("key", "whole"), n_copies), "key", "left").join(found, "key", "left")
    return everyone.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("whole", F.lit(False)).alias("whole"), "found").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
