"""Jaccard join of documents on word n-grams, by rare-first prefix filtering.

The order of n-grams is global: ascending document frequency, then hash. A frequency of 1 comes first and
cannot match, so that only n-grams of two documents or more travel on, and a document whose
prefix consists of its own n-grams alone drops out. The rest meets on prefix n-grams, passes length, positional and
suffix filters, and each pair is verified once on the whole sets. Documents that are equal
but for the case of letters are joined as one. Within a posting list, documents first meet a leader; only those
that remain in different components then meet each other, by length class and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .keys import keyed_rows
from .ranks import table_part
from .shingles import shingles

SIZE = 5
#: Least Jaccard similarity in percent.
PERCENT = 80
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 2 << 20
#: Bytes of text whose n-grams go to one part of the index, about.
PART_BYTES = 4 << 20
#: Parts of the hash space in which the suffix filter counts: four halvings, whose bound is that of the smallest parts.
SIGNATURE = 16
#: Length classes between a set and the smallest that can be similar to it.
CLASSES = 4

POSTING_SCHEMA = "part int, chunk long, hashes binary, places binary"
FREQUENT_SCHEMA = "chunk long, kind int, a binary, b binary, c binary"
SET_SCHEMA = "key long, n long, own int, prefix int, hashes array<long>, signature array<int>"


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values, none of which is negative."""
    cuts = np.flatnonzero(np.diff(values, prepend=-1))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)], strict=False))


def _postings(bits: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 28
        keys: list[int] = []
        texts: list[bytes] = []
        held = seq = 0

        def flush() -> pa.RecordBatch:
            chunk = task | seq
            value, docs = shingles(texts, size)
            part = (value >> np.uint64(64 - bits)).astype(np.int64)
            spans = _spans(part)
            low = np.ascontiguousarray(value).view(np.uint8).reshape(-1, 8)[:, :7]  # the part holds the highest byte
            place = docs.astype("<u4")
            counts = np.bincount(docs, minlength=len(keys)).astype("<u4")
            # the chunk's table of documents takes the same way, as a part below 0
            rows = [(table_part(chunk), chunk, np.array(keys, "<i8").tobytes(), counts.tobytes())]
            rows += [(int(part[a]), chunk, low[a:b].tobytes(), place[a:b].tobytes()) for a, b in spans]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["part", "chunk", "hashes", "places"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                keys.append(key)
                texts.append(raw)
                held += len(raw) + 1
                if held >= CHUNK_BYTES:
                    yield flush()
                    keys, texts, held, seq = [], [], 0, seq + 1
        if keys:
            yield flush()

    return run


def _frequent(bits: int):
    """Of one part: the n-grams of two documents or more, back to the chunks they came from."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        chunks = table.column("chunk").to_pylist()
        hashes, places = table.column("hashes").to_pylist(), table.column("places").to_pylist()
        if part < 0:
            out = [(c, 0, a, b, b"") for c, a, b in zip(chunks, hashes, places, strict=True)]
        else:
            sizes = np.array([len(x) // 4 for x in places])
            value = np.zeros((int(sizes.sum()), 8), np.uint8)
            value[:, :7] = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 7)
            value[:, 7] = part >> (bits - 8)
            value = value.view("<u8").ravel()
            place = np.frombuffer(b"".join(places), "<u4")
            source = np.repeat(np.arange(len(chunks)), sizes)
            order = np.argsort(value, kind="stable")
            value = value[order]
            first = np.ones(len(value), bool)
            first[1:] = value[1:] != value[:-1]
            starts = np.flatnonzero(first)
            runs = np.diff(np.append(starts, len(value)))
            df = np.repeat(runs, runs)
            keep = np.flatnonzero(df > 1)
            again = keep[np.argsort(source[order[keep]], kind="stable")]
            at = source[order[again]]
            value, df, place = value[again], np.minimum(df[again], 2**32 - 1).astype("<u4"), place[order[again]]
            out = [(chunks[at[a]], 1, value[a:b].tobytes(), df[a:b].tobytes(), place[a:b].tobytes()) for a, b in _spans(at)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["chunk", "kind", "a", "b", "c"])

    return run


def _sets(percent: int):
    """Of one chunk: each document's frequent n-grams in the global order, if its prefix reaches them."""

    def run(table: pa.Table) -> pa.Table:
        kind = np.array(table.column("kind").to_pylist())
        a, b, c = (table.column(x).to_pylist() for x in "abc")
        head = int(np.flatnonzero(kind == 0)[0])
        keys, n = np.frombuffer(a[head], "<i8"), np.frombuffer(b[head], "<u4").astype(np.int64)
        rest = [i for i in range(len(kind)) if kind[i]]
        value = np.frombuffer(b"".join(a[i] for i in rest), "<u8")
        df = np.frombuffer(b"".join(b[i] for i in rest), "<u4")
        place = np.frombuffer(b"".join(c[i] for i in rest), "<u4")
        order = np.lexsort((value, df, place))
        value, place = value[order], place[order]
        shared = np.bincount(place, minlength=len(keys))
        own = n - shared
        prefix = np.where(n > 0, n - (percent * n + 99) // 100 + 1 - own, 0)
        live = (prefix > 0) & (shared > 0)
        prefix = np.where(live, np.minimum(prefix, shared), 0)
        bounds = np.concatenate([[0], np.cumsum(shared)])
        lists, signatures = [], []
        signed = value.view("<i8")
        for d in range(len(keys)):
            if live[d]:
                mine = slice(bounds[d], bounds[d + 1])
                lists.append(signed[mine])
                signatures.append(np.bincount((value[mine] >> np.uint64(20)) % np.uint64(SIGNATURE), minlength=SIGNATURE).astype(np.int32))
            else:
                lists.append(None)
                signatures.append(None)
        return pa.table([pa.array(keys), pa.array(n), pa.array(own.astype(np.int32)), pa.array(prefix.astype(np.int32)), pa.array(lists, pa.list_(pa.int64())), pa.array(signatures, pa.list_(pa.int32()))], names=["key", "n", "own", "prefix", "hashes", "signature"])

    return run


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of sets of sizes ``n`` and ``m``."""
    return F.ceil(percent * (n + m) / (100 + percent) - 1e-9)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar: suffix filter on signatures, then the whole sets."""
    one = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"), F.col("signature").alias("sa"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"), F.col("signature").alias("sb"))
    narrow = pairs.join(one.select("a", "na", "sa"), "a").join(two.select("b", "nb", "sb"), "b")
    bound = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    narrow = narrow.where(bound >= _needed(F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb")
    full = narrow.join(one.select("a", "ha"), "a").join(two.select("b", "hb"), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return full.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of different components that share a prefix n-gram and pass the length and positional filters.

    A posting list is cut by the smaller set's length class before its rows meet. A place in a set leaves room for partners
    up to some length only, so that the larger set looks into few classes, or none.
    """
    step = np.log(100 / percent) / CLASSES
    length_class = lambda n: F.floor(F.log(n) / step).cast("int")
    rest = F.col("n") - F.col("at")
    rows = postings.withColumn("most", F.floor(rest * (100 + percent) / percent + 1e-9) - F.col("n")).withColumn("least", F.ceil(percent * F.col("n") / 100 - 1e-9))
    smaller = rows.where("most >= n").select("hash", F.col("key").alias("ky"), F.col("n").alias("ny"), F.col("most").alias("my"), F.col("component").alias("cy"), length_class(F.col("n")).alias("class"))
    upto = F.least("n", "most")
    larger = rows.where(F.col("least") <= upto)
    classes = F.sequence(length_class(F.col("least")), length_class(upto))
    larger = larger.select("hash", "key", "n", "most", "least", "component", F.explode(classes).alias("class"))
    fits = F.col("ny").between(F.col("least"), F.least("n", "most")) & (F.col("n") <= F.col("my"))
    once = (F.col("component") != F.col("cy")) & ((F.col("ny") < F.col("n")) | (F.col("ky") < F.col("key")))
    return larger.join(smaller, ["hash", "class"]).where(fits & once).select(F.least("key", "ky").alias("a"), F.greatest("key", "ky").alias("b")).distinct()


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links that make the same components as all similar pairs do."""
    prefix = sets.select("key", "n", "own", F.posexplode(F.slice("hashes", 1, F.col("prefix"))).alias("i", "hash")).select("key", "n", "own", "hash", (F.col("own") + F.col("i")).alias("at"))
    prefix = scratch.written(prefix, "prefixes")
    # documents of similar length have equal or neighbouring length classes
    classed = prefix.withColumn("class", F.floor(F.log("n") / np.log(100 / percent)).cast("int"))
    # a text from which others were made has the fewest n-grams of its own, and is similar to more of them than they are
    leaders = classed.groupBy("hash", "class").agg(F.min(F.struct("own", "key", "n", "at")).alias("leader"))
    meets = classed.select("key", "n", "at", "hash", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("class")).join(leaders, ["hash", "class"])
    other_n, other_at = F.col("leader.n"), F.col("leader.at")
    near = (100 * F.least("n", other_n) >= percent * F.greatest("n", other_n)) & (F.least(F.col("n") - F.col("at"), other_n - other_at) >= _needed(F.col("n"), other_n, percent))
    first = meets.where((F.col("leader.key") != F.col("key")) & near).select(F.least("key", "leader.key").alias("a"), F.greatest("key", "leader.key").alias("b")).distinct()
    first = scratch.written(first, "pairs1")
    n_first = first.count()
    links = scratch.written(_verify(first, sets, percent), "links1", n_first)
    labels = scratch.written(components(links), "components1", 2 * n_first)
    named = prefix.join(labels.select(F.col("id").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    # a posting list within one component has nothing left to link
    mixed = named.groupBy("hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("hash")
    open_lists = scratch.written(named.join(mixed, "hash", "left_semi"), "open")
    second = _candidates(open_lists, percent).join(first, ["a", "b"], "left_anti")
    return links.unionByName(_verify(scratch.written(second, "pairs2"), sets, percent))


def near_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Words are runs without white space, with A-Z as a-z; a set holds the distinct ``size``-word shingles, or the whole of a
    shorter text. Two rows link if 100 times their intersection is at least ``percent`` times their union. Null and
    wordless texts have an empty set and link with nothing. ``component_id`` is the smallest id that links lead to;
    among rows without an id it is null. Rows of one id are rows of their own. An empty table
    gives an empty result; other columns are ignored.
    """
    rows, unique = keyed_rows(docs, id_col, text_col)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digests = scratch.written(rows.select("key", "doc_id", F.unhex(F.sha2(lowered, 256)).alias("digest"), F.octet_length("text").alias("bytes")), "digests")
    total = digests.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    groups = scratch.written(digests.groupBy("digest").agg(F.min("key").alias("same"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "same"), "groups")
    copies = scratch.written(digests.join(scratch.sized(groups), "digest").where("key <> same").select("key", "same"), "copies")
    n_copies = copies.count()
    texts = rows.select("key", "text")
    texts = texts.join(scratch.sized(copies.select("key"), n_copies), "key", "left_anti")
    if n_copies > scratch.BROADCAST_ROWS:
        texts = scratch.written(texts, "texts")  # chunks are numbered by task, which must read the same rows when run again
    bits = min(22, max(8, int(np.ceil(np.log2(max(1, total / PART_BYTES))))))
    postings = texts.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(_postings(bits, size), POSTING_SCHEMA)
    frequent = postings.groupBy("part").applyInArrow(_frequent(bits), FREQUENT_SCHEMA)
    sets = scratch.written(frequent.groupBy("chunk").applyInArrow(_sets(percent), SET_SCHEMA), "sets")
    links = scratch.written(_links(sets.where("hashes IS NOT NULL"), percent), "links")
    labels = components(links).select(F.col("id").alias("same"), "component")
    everyone = digests.select("key", "doc_id").join(copies, "key", "left").select("key", "doc_id", F.coalesce("same", "key").alias("same"))
    named = everyone.join(sets.select(F.col("key").alias("same"), "n"), "same").join(labels, "same", "left")
    named = named.select("key", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.coalesce("component", "same")).alias("component_id"))
    if unique:
        return named.select("doc_id", "n_shingles", "component_id")
    named = scratch.written(named, "named")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
