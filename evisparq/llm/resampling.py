"""Resampling of documents towards a target distribution, by importance weights of hashed n-grams.

Distinct words get integer ids, n-grams are tuples of those ids, and the bytes of each distinct tuple are put together and hashed once;
its counts and gain are joined back. Texts travel as chunks: the words of a chunk are numbered within it, its
n-grams are numbered too, and a document is its n-grams' numbers with their counts. What is exchanged is a row for each
distinct word or n-gram of a chunk, never one for each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Longest n-gram, number of buckets, seed of the draw, share drawn in percent, and words that a drawn document has at least.
SIZE, BUCKETS, SEED, PERCENT, LEAST = 1, 10_000, 2024, 10, 20

CHUNK_SCHEMA = "ids array<long>, n_words array<long>, n_features array<long>, n_distinct array<long>, codes binary, times binary, words array<binary>, counts array<long>, grams array<array<int>>, gram_counts array<long>"
WEIGHT_SCHEMA = "doc_id long, n_words long, n_features long, weight long"

#: Bytes that separate words become spaces, A-Z become a-z, everything else stays.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _grams(codes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of each n-gram length: the distinct tuples of word codes, each occurrence's tuple and each occurrence's document."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    distinct, numbers, docs = [], [], []
    for n in range(1, size + 1):
        if len(codes) < n:
            break
        at = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
        number = codes[at].astype(np.int64)
        rows = np.arange(number.max() + 1 if len(number) else 0, dtype=np.int64)[:, None]
        for k in range(1, n):
            pair = (number << 32) | codes[at + k]
            found, number = np.unique(pair, return_inverse=True)
            rows = np.concatenate([rows[found >> 32], (found & 0xFFFFFFFF)[:, None]], axis=1)
        distinct.append(rows)
        numbers.append(number)
        docs.append(of[at])
    return distinct, numbers, docs


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []
        numbers, held = _Numbers(), 0

        def flush() -> pa.RecordBatch:
            distinct, number, doc = _grams(np.concatenate(codes), np.array(lengths, np.int64), size)
            base = np.concatenate([[0], np.cumsum([len(x) for x in distinct])]).astype(np.int64)
            pairs = np.concatenate([(d << 32) | (x + b) for d, x, b in zip(doc, number, base, strict=False)]) if number else np.zeros(0, np.int64)
            pairs, times = np.unique(pairs, return_counts=True)
            docs, flat = pairs >> 32, pairs & 0xFFFFFFFF
            total = np.bincount(flat, weights=times, minlength=base[-1]).astype(np.int64)
            longer = [r for rows in distinct[1:] for r in rows.astype(np.int32)]
            of = lambda weights=None: np.bincount(docs, weights=weights, minlength=len(ids)).astype(np.int64)
            row = [ids, lengths, of(times), of(), _planes(flat), _planes(times), list(numbers), total[: len(numbers)], longer, total[len(numbers) :]]
            long = pa.list_(pa.int64())
            kinds = [long, long, long, long, pa.binary(), pa.binary(), pa.list_(pa.binary()), long, pa.list_(pa.list_(pa.int32())), long]
            names = ["ids", "n_words", "n_features", "n_distinct", "codes", "times", "words", "counts", "grams", "gram_counts"]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer()
                raw = raw.to_pybytes().translate(_PLAIN) if raw is not None else b""
                if held and held + len(raw) > CHUNK_BYTES:
                    yield flush()
                    ids, lengths, codes, numbers, held = [], [], [], _Numbers(), 0
                words = raw.split()
                ids.append(i)
                lengths.append(len(words))
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                held += len(raw) + 16
        if ids:
            yield flush()

    return run


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32, all first bytes before all second ones and so on: small numbers leave planes of zeros, which compress."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks with the gains of their n-grams: each document's sum."""
    for batch in batches:
        for ids, words, features, distinct, codes, times, gains in zip(*(batch.column(i) for i in range(7)), strict=True):
            n = np.array(distinct.values, np.int64)
            gain = np.array(gains.values, np.int64) if gains.is_valid else np.zeros(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[_numbers(codes.as_py())] * _numbers(times.as_py()).astype(np.int64))])
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([ids.values, words.values, features.values, pa.array(sums[ends] - sums[ends - n], pa.int64())], ["doc_id", "n_words", "n_features", "weight"])


def _chunk_table(rows: DataFrame, size: int, name: str) -> DataFrame:
    made = rows.mapInArrow(_chunks(size), CHUNK_SCHEMA).withColumn("chunk", F.monotonically_increasing_id())
    return scratch.written(made, name)


def _by_place(rows: DataFrame, value: str) -> DataFrame:
    """``chunk`` and its values in the order of their places."""
    return rows.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda x: x[value]).alias(value + "s"))


def _tuples(chunks: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """``chunk, place, gram, n``: the distinct n-grams of each chunk as tuples of global word ids (a single id if ``size`` is 1), with their counts there."""
    one = chunks.select("chunk", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("place", "x"))
    one = one.select("chunk", "place", F.col("x.word").alias("word"), F.col("x.n").alias("n")).join(words, "word").select("chunk", "place", "id", "n")
    if size == 1:
        return one.withColumnRenamed("id", "gram")
    both = chunks.select("chunk", "grams", "gram_counts").join(_by_place(one, "id"), "chunk")
    # ids are put in before rows are made: a row must not carry its chunk's dictionary
    named = F.transform("grams", lambda g: F.transform(g, lambda c: F.element_at("ids", c + 1)))
    rows = both.select("chunk", F.size("ids").alias("base"), F.arrays_zip(named.alias("gram"), F.col("gram_counts").alias("n")).alias("rows"))
    rows = rows.select("chunk", "base", F.posexplode("rows").alias("i", "x"))
    return one.select("chunk", "place", F.array("id").alias("gram"), "n").unionByName(rows.select("chunk", (F.col("base") + F.col("i")).alias("place"), F.col("x.gram").alias("gram"), F.col("x.n").alias("n")))


def _hashed(grams: DataFrame, words: DataFrame, size: int, buckets: int) -> DataFrame:
    """``grams`` with the ``bucket`` of each tuple's bytes: its words joined by one space."""
    text = None
    for k in range(size):
        named = words.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"word{k}"))
        member = F.col("gram") if size == 1 else F.get("gram", F.lit(k))
        grams = grams.join(named, member == F.col(f"id{k}"), "inner" if k == 0 else "left")
        word = F.col(f"word{k}")
        text = word if text is None else F.concat(text, F.coalesce(F.concat(F.lit(b" "), word), F.lit(b"")))
    return grams.select("gram", "s", "t", (F.crc32(text) % buckets).cast("int").alias("bucket"))


def gains(grams: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` of the buckets that n-grams fall into: a thousand times the log of the smoothed ratio of shares, rounded down. At most ``buckets`` rows."""
    by = grams.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    s, t = by.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    up = (F.col("t") + 1).cast("double") * float(s + buckets)
    down = (F.col("s") + 1).cast("double") * float(t + buckets)
    return by.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def weighted(docs: DataFrame, target: DataFrame, size: int = SIZE, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row of ``docs``, measured against the texts of ``target``."""
    none = F.lit(None).cast("long").alias("doc_id")
    mine = _chunk_table(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), size, "chunks")
    theirs = _chunk_table(target.select(none, F.col(text_col).cast("binary").alias("text")), size, "target")
    distinct = mine.select(F.explode("words").alias("word")).unionByName(theirs.select(F.explode("words").alias("word"))).distinct()
    words = scratch.written(distinct.withColumn("id", F.monotonically_increasing_id()), "words")
    tuples = scratch.written(_tuples(mine, words, size), "tuples")
    counted = tuples.select("gram", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(_tuples(theirs, words, size).select("gram", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counted = counted.groupBy("gram").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    grams = scratch.written(_hashed(counted, words, size, buckets), "grams")
    gain = F.broadcast(gains(grams, buckets))  # a row a bucket, whatever the corpus
    back = tuples.select("chunk", "place", "gram").join(grams.select("gram", "bucket").join(gain, "bucket").select("gram", "gain"), "gram")
    held = ["ids", "n_words", "n_features", "n_distinct", "codes", "times"]
    ready = mine.select("chunk", *held).join(_by_place(back, "gain"), "chunk", "left")
    return ready.select(*held, "gains").mapInArrow(_weights, WEIGHT_SCHEMA)


def score(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """The weight and a Gumbel draw that depends on the id alone, in whole thousandths. A missing id draws as the empty one."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((head + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    size: int = SIZE,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least: int = LEAST,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    Features are the runs of up to ``size`` words; words are runs of letters a-z (A-Z count as a-z), digits and
    characters beyond ASCII. Of the rows with ``least`` words or more, ``percent`` percent with the highest
    scores are drawn; ``rank`` numbers them from 1, ties to the smaller id, rows without an id last, and is null for all others.
    Null and wordless texts have no features, weight 0, and are never drawn unless ``least`` is 0. Rows of one id are rows of their own: they share
    their draw, and equal ones tie in any order. An empty target gives every bucket its share of the smoothing. An empty table gives an
    empty result; other columns are ignored.
    """
    found = weighted(docs, target, size, buckets, id_col, text_col)
    found = scratch.written(found.withColumn("score", score(F.col("doc_id"), F.col("weight"), seed)).withColumn("_row", F.monotonically_increasing_id()), "scores")
    able = found.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    # rows alike in score and id are spread by their number, so that they do not meet in one task
    ranked = scratch.numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.xxhash64("_row")], "_number")
    ranked = ranked.withColumn("rank", F.when(F.col("_number") < drawn, F.col("_number") + 1).cast("long"))
    rest = found.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(rest.select(*names))
