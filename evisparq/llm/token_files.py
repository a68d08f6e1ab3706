"""Token ids of a corpus in segment files, ordered by document, and their reader.

Files are Parquet tables whose rows are segments (see ``pfor``), so that Spark's committer
handles lost executors and any file system that Spark reaches. ``shelf`` and ``seq`` order
the segments; within one, documents ascend. Document numbers travel beside the payload.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .codec import codec
from .pfor import decode_segment, encode_segment
from .ranks import cuts_below

#: Ids after which a segment ends with the document at hand.
SEGMENT_IDS = 1 << 18
#: Bytes of input on a shelf, about, and the most shelves; a shelf is a range of document numbers.
SHELF_BYTES, MOST_SHELVES = 1 << 20, 65_536

SEGMENT_SCHEMA = "shelf int, seq int, n_ids long, doc_ids array<long>, data binary"


def _encode(path: str, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            ids = [x + end for x in coder.encode(batch.column(2).to_pylist())]
            if coder.small:  # half the bytes to exchange
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["shelf", "doc_id", "ids"])

    return run


def _segments(segment_ids: int, kind: str):
    width = int(kind[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, seq, docs, parts, n = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            data = encode_segment(np.array([len(x) // width for x in parts], np.int64), np.frombuffer(b"".join(parts), kind).astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([shelf], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["shelf", "seq", "n_ids", "doc_ids", "data"])

        for batch in batches:
            for s, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if docs and (s != shelf or n >= segment_ids):
                    yield flush()
                    seq = seq + 1 if s == shelf else 0
                    docs, parts, n = [], [], 0
                shelf = s
                docs.append(doc)
                parts.append(ids)
                n += len(ids) // width
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write segments in ascending order of ``id_col``.

    Null text counts as empty and gives the end id alone. Null ids come first. Rows of one id
    follow each other in the order of their token ids' bytes, so that reruns agree. An empty table gives a file
    without segments; other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shelves = int(min(MOST_SHELVES, max(16, scratch.input_bytes(docs, "text") // SHELF_BYTES)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / shelves for i in range(1, shelves)], 4 * shelves)).first()[0] or []
    cuts = sorted(set(cuts))
    docs = docs.select(cuts_below("doc_id", cuts).alias("shelf"), "doc_id", "text")
    encoded = docs.mapInArrow(_encode(tokenizer_path, int(end_id).to_bytes(4, "little")), "shelf int, doc_id long, ids binary")
    ordered = encoded.repartition("shelf").sortWithinPartitions("shelf", F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(_segments(segment_ids, "<u2" if codec(tokenizer_path).small else "<u4"), SEGMENT_SCHEMA).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, docs, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lengths, ids = decode_segment(data)
            ends = np.cumsum(lengths, dtype=np.int64)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the number of ids before each; only counts of segments meet in one task for that."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    shelf_sums = files.groupBy("shelf").agg(F.sum("n_ids").alias("n"))
    by_shelf = Window.orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    shelf_base = shelf_sums.select("shelf", F.coalesce(F.sum("n").over(by_shelf), F.lit(0)).alias("shelf_base"))
    in_shelf = Window.partitionBy("shelf").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("shelf", "seq", F.coalesce(F.sum("n_ids").over(in_shelf), F.lit(0)).alias("inner_base")).join(shelf_base, "shelf")
    base = base.select("shelf", "seq", (F.col("shelf_base") + F.col("inner_base")).cast("long").alias("base"))
    return files.join(F.broadcast(base) if base.count() <= 100_000 else base, ["shelf", "seq"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files."""
    return read_segments(spark, path).select("base", "doc_ids", "data").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lengths, ids = decode_segment(data)
            ends = np.cumsum(lengths, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids`` of each document in the files."""
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path).select("doc_ids", "data").mapInArrow(_ids, "doc_id long, ids array<long>")
