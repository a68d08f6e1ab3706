"""Removal of repeated spans of words through a compacted De Bruijn graph.

An edge is a window of words, from its first words but one to its last but one. Windows of a text are cut into runs that share the
lowest hash of a few words in them: equal windows have equal lowest hashes, so that runs whose hash occurs once are settled, and
runs of equal words are counted before anything is taken apart. The windows of each distinct run that is left are
edges, read where its first occurrence lies in the sources. Edges of two occurrences or more make the graph; paths without
branches are compacted, first along the sources, then by doubling pointers in joins. Occurrences are spans on those paths.
In the end the words at the sources' coordinates are compared: if two that were taken for equal differ, all is done again with
other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .keys import keyed_rows, whole_copies
from .shingles import _WHITE, _upto, mixed
from .windows import _sliding_min

#: Words in a window, words whose hashes tell runs apart, and windows in a run at most.
LENGTH, GRAM, RUN = 35, 16, 64
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 2 << 20

RUN_SCHEMA = "key long, first int, n int, low long, lows int, content long"
EDGE_SCHEMA = "edge long, src long, dst long, content long, offset int, times long, digest long, key long, pos int"
CUT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, checks array<struct<content:long,digest:long>>"


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes other than white space."""
    white = np.ones(len(raw) + 2, bool)
    white[1:-1] = _WHITE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(white[1:] != white[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word, from running sums over no more than a chunk of bytes (or a longer word) at a time."""
    data = np.frombuffer(raw, np.uint8)
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + CHUNK_BYTES, side="right")))
        base = starts[low]
        part = data[base : ends[high - 1]]
        power, inverse = _upto(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = mixed(((sums[e] - sums[s]) * inverse[s]) ^ (e - s).astype(np.uint64))
        low = high
    return mixed(out + np.uint64(seed))


class Sequences:
    """Hashes of runs of neighbouring words."""

    def __init__(self, words: np.ndarray):
        self.power, self.inverse = _upto(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.power[: len(words)], out=self.sums[1:])

    def of(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[first + size] - self.sums[first]) * self.inverse[first])


def runs_of(texts: list[bytes], length: int, gram: int, seed: int) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows, lowest hash, 2 if that occurs in the run more than once (else 1), and content hash of each run."""
    raw = b"\n".join(texts)
    starts, ends = word_places(raw)
    none = np.zeros(0, np.int64)
    if len(starts) < length:
        return (none,) * 6
    sequences = Sequences(word_hashes(raw, starts, ends, seed))
    bounds = np.cumsum([len(x) + 1 for x in texts])
    of = np.searchsorted(bounds, starts, side="right")
    gram = min(gram, length)
    grams = sequences.of(np.arange(len(starts) - gram + 1), gram)
    low = _sliding_min(grams, length - gram + 1)
    valid = np.flatnonzero(of[: len(low)] == of[length - 1 :])
    if not len(valid):
        return (none,) * 6
    low = low[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (low[1:] != low[:-1]) | (np.diff(valid) != 1)
    # a long run of one hash, as periodic texts have, is cut at even distances from its begin
    begin = np.flatnonzero(new)
    place = np.arange(len(valid)) - np.repeat(begin, np.diff(np.append(begin, len(valid))))
    at = np.flatnonzero(place % RUN == 0)
    n = np.diff(np.append(at, len(valid)))
    first = valid[at]
    # one occurrence lies in all windows of its run: others are looked for in the first and in what the last one adds
    width = length - gram + 1
    lowest, again = low[at], np.zeros(len(at), np.int32)
    for k in range(width):
        again += grams[first + k] == lowest
        again += (grams[first + n - 1 + k] == lowest) & (n - 1 + k >= width)
    again = np.where((again > 1) | (n > width), 2, 1).astype(np.int32)
    content = mixed(sequences.of(first, n + length - 1) + n.astype(np.uint64))
    text = of[first]
    base = np.searchsorted(of, np.arange(len(texts)))
    return text, first - base[text], n, lowest.view(np.int64), again, content.view(np.int64)


def _runs(length: int, gram: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column(0), np.int64)
            texts = batch.column(1)
            low = 0
            while low < len(keys):
                held, some = 0, []
                while low + len(some) < len(keys) and held < CHUNK_BYTES:
                    some.append(texts[low + len(some)].as_buffer().to_pybytes())
                    held += len(some[-1])
                text, first, n, lowest, again, content = runs_of(some, length, gram, seed)
                columns = [keys[low + text], first.astype(np.int32), n.astype(np.int32), lowest, again.astype(np.int32), content]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "first", "n", "low", "lows", "content"])
                low += len(some)

    return run


def _digest(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.sha256(b" ".join(words)).digest()[:8], "little", signed=True)


def _edges(length: int, seed: int):
    """The windows of the runs that are listed with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, samples in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                starts, ends = word_places(raw)
                sequences = Sequences(word_hashes(raw, starts, ends, seed))
                n = np.array([x["n"] for x in samples])
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = np.repeat([x["first"] for x in samples], n) + offset
                digests = []
                for x in samples:
                    words = raw[starts[x["first"]] : ends[x["first"] + x["n"] + length - 2]].split()
                    digests += [_digest(words[i : i + length]) for i in range(x["n"])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(sequences.of(pos + a, length - b).view(np.int64)) for a, b in ((0, 0), (0, 1), (1, 1))),
                        pa.array(np.repeat(np.array([x["content"] for x in samples], np.int64), n)),
                        pa.array(offset.astype(np.int32)),
                        pa.array(np.repeat(np.array([x["times"] for x in samples], np.int64), n)),
                        pa.array(digests, pa.int64()),
                        pa.array(np.full(len(pos), key, np.int64)),
                        pa.array(pos.astype(np.int32)),
                    ],
                    ["edge", "src", "dst", "content", "offset", "times", "digest", "key", "pos"],
                )

    return run


def merged(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of the union, in order; spans that touch are one."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(begins), bool)
    new[1:] = begins[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return list(zip(begins[at].tolist(), reach[np.append(at[1:], len(begins)) - 1].tolist(), strict=True))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, whole, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                starts, ends = word_places(raw)
                total, checks, spans = len(starts), [], []
                for x in found or []:
                    first = x["first"]
                    if x["times"] > 1:
                        checks.append({"content": x["content"], "digest": _digest(raw[starts[first] : ends[first + x["n"] + length - 2]].split())})
                    spans += [(first + r["begin"], first + r["begin"] + r["n"] + length - 1) for r in x["runs"] or []]
                if whole and total >= length:
                    spans = [(0, total)]
                elif spans:
                    spans = merged(*np.array(spans, np.int64).T)
                digest, at, fresh = hashlib.sha256(), 0, True
                for a, b in [*spans, (total, total)]:
                    if at < a:
                        # what is kept may be long: in pieces of a bounded number of words
                        for i in range(at, a, 1 << 16):
                            j = min(a, i + (1 << 16))
                            digest.update((b"" if fresh else b" ") + b" ".join(raw[starts[i] : ends[j - 1]].split()))
                            fresh = False
                    at = b
                out.append((total, sum(b - a for a, b in spans), digest.hexdigest(), checks))
            c = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("content", pa.int64()), ("digest", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(c, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "checks"])

    return run


def doubled(parents: DataFrame) -> DataFrame:
    """``head, top, distance`` from ``head, parent, distance``: the end of each chain of parents and the sum of the distances to it; heads without a parent have null and 0.

    Chains that close have no end: their heads stay where they are. Each round halves what is left of a chain and is written.
    """
    state = scratch.written(parents.select("head", F.coalesce("parent", "head").alias("top"), "distance", F.col("parent").isNull().alias("done")), "chains")
    heads, open_ = state.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("done"), 0).otherwise(1)), F.lit(0))).first()
    for _ in range(int(heads).bit_length() + 1):
        if not open_:
            break
        up = state.select(F.col("head").alias("top"), F.col("top").alias("_top"), F.col("distance").alias("_distance"), F.col("done").alias("_done"))
        moved = state.where("NOT done").join(up, "top").select("head", F.col("_top").alias("top"), (F.col("distance") + F.col("_distance")).alias("distance"), F.col("_done").alias("done"))
        state = scratch.written(state.where("done").unionByName(moved), "chains")
        left = state.where("NOT done").count()
        open_ = left
    end = lambda x, other: F.when(F.col("done"), F.col(x)).otherwise(other)
    return state.select("head", end("top", F.col("head")).alias("top"), end("distance", F.lit(0)).alias("distance"))


def compacted(edges: DataFrame) -> DataFrame:
    """``edge, path, place`` from distinct edges ``edge, src, dst, at`` (``at``: key and pos of an occurrence): the nonbranching path of each edge, named by its first one, and the place there."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("edge").alias("edge"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min(F.struct("edge", "at")).alias("before"))
    links = out.where("n_out = 1").join(into.where("n_in = 1"), "node").select("edge", F.col("before.edge").alias("before"), F.col("before.at").alias("before_at"))
    rows = edges.select("edge", "at").join(links, "edge", "left")
    # edges that lie side by side in one source are a segment already
    goes_on = F.coalesce((F.col("before_at.key") == F.col("at.key")) & (F.col("before_at.pos") + 1 == F.col("at.pos")), F.lit(False))
    along = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("edge", "before", F.col("at.key").alias("key"), F.col("at.pos").alias("pos"), (~goes_on).alias("starts"))
    last = lambda c: F.last(F.when(F.col("starts"), F.col(c)), ignorenulls=True).over(along)
    segments = scratch.written(rows.select("edge", last("edge").alias("head"), (F.col("pos") - last("pos")).cast("long").alias("place"), F.when(F.col("starts"), F.col("before")).alias("before"), "starts"), "segments")
    heads = segments.where("starts").select(F.col("edge").alias("head"), "before")
    behind = segments.select(F.col("edge").alias("before"), F.col("head").alias("parent"), (F.col("place") + 1).alias("distance"))
    parents = heads.join(behind, "before", "left").select("head", "parent", F.coalesce("distance", F.lit(0)).cast("long").alias("distance"))
    tops = doubled(parents)
    return segments.select("edge", "head", "place").join(tops, "head").select("edge", F.col("top").alias("path"), (F.col("place") + F.col("distance")).alias("place"))


def _attempt(rows: DataFrame, texts: DataFrame, whole: DataFrame, n_whole: int, length: int, gram: int, seed: int) -> tuple[DataFrame, bool]:
    """The result with the hashes of one seed, written, and whether all words that were taken for equal are."""
    runs = texts.mapInArrow(_runs(length, gram, seed), RUN_SCHEMA)
    lows = scratch.written(runs.groupBy("low").agg(F.sum("lows").alias("c")).where("c > 1").select("low"), "lows")
    runs = scratch.written(runs.join(scratch.sized(lows), "low", "left_semi").select("key", "first", "n", "content"), "runs")
    contents = runs.groupBy("content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "first", "n")).alias("sample"))
    contents = scratch.written(contents, "contents")
    samples = contents.groupBy(F.col("sample.key").alias("key")).agg(F.collect_list(F.struct("sample.first", "sample.n", "content", "times")).alias("samples"))
    edges = scratch.written(texts.join(samples, "key").mapInArrow(_edges(length, seed), EDGE_SCHEMA), "edges")
    graph = edges.groupBy("edge").agg(F.sum("times").alias("times"), F.min("src").alias("src"), F.min("dst").alias("dst"), F.min(F.struct("key", "pos")).alias("at"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    graph = scratch.written(graph.where("times > 1"), "graph")
    if not graph.where("lo <> hi").isEmpty():
        return rows, False
    paths = scratch.written(compacted(graph.select("edge", "src", "dst", "at")), "paths")
    on_path = edges.select("content", "offset", "edge").join(paths, "edge")
    by_offset = Window.partitionBy("content").orderBy("offset")
    before = lambda c: F.lag(c).over(by_offset)
    same = (before("offset") + 1 == F.col("offset")) & (before("path") == F.col("path")) & (before("place") + 1 == F.col("place"))
    spans = on_path.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("span", F.sum("new").over(by_offset))
    spans = spans.groupBy("content", "span").agg(F.min("offset").alias("begin"), F.count(F.lit(1)).cast("int").alias("n"))
    spans = spans.groupBy("content").agg(F.collect_list(F.struct("begin", "n")).alias("runs"))
    told = scratch.written(contents.select("content", "times").join(spans, "content", "left").where("times > 1 OR runs IS NOT NULL"), "told")
    scratch.release(lows, contents, edges, graph, paths)
    found = runs.join(told, "content").groupBy("key").agg(F.collect_list(F.struct("first", "n", "content", "times", "runs")).alias("found"))
    everyone = rows.join(scratch.sized(whole, n_whole), "key", "left").join(found, "key", "left")
    everyone = everyone.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("whole", F.lit(False)).alias("whole"), "found")
    cut = scratch.written(everyone.mapInArrow(_cut(length), CUT_SCHEMA), "cut")
    checks = cut.select(F.explode("checks").alias("c")).groupBy("c.content").agg(F.min("c.digest").alias("lo"), F.max("c.digest").alias("hi"))
    return cut.drop("checks"), checks.where("lo <> hi").isEmpty()


def remove_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs``.

    Words are runs without white space, unchanged. A word goes if a window of ``length`` words that covers it starts anywhere else too, in
    the same text or another; windows are judged on the input. The kept words are joined by one space. Null counts as empty; texts
    of fewer words stay as they are, but for their white space. Rows of one id, or of none, are texts of their own, so that a repeated row removes
    itself. An empty table gives an empty result; other columns are ignored.
    """
    rows, _ = keyed_rows(docs, id_col, text_col)
    copies, n_copies = whole_copies(rows, F.col("text"))
    texts = rows.join(scratch.sized(copies.where("key <> same").select("key"), n_copies), "key", "left_anti").select("key", F.col("text").cast("binary").alias("text"))
    whole = copies.select("key", F.lit(True).alias("whole"))
    for seed in count():
        cut, right = _attempt(rows, texts, whole, n_copies, length, gram, seed)
        if right:
            return cut
