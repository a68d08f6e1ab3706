"""Okapi BM25 over written postings in runs of documents.

A task turns its documents into runs, each with the postings of some thousand documents in the order of terms, so that no posting is
exchanged when an index is built, and a search reads the row groups and pages of the terms it asks for. All postings of a document are in one
run: a search scores a run's documents in one place, and only its best ones travel. Runs consist of blocks. A block's largest gains bound the score of every document in
it: with too many asked terms for the tasks, a search scores the most promising blocks of each question first, and then those only whose bound reaches the k-th score found there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from ..sources import scratch
from ..sources.tables import sized

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents in a block, about, and blocks that are scored first (more where ``k`` needs them).
BLOCK_DOCS, FIRST_BLOCKS = 64, 4
#: Documents and tokens of a run at most (a longer document is one alone), bits of a block's number inside its run, and of a run's inside its task.
RUN_DOCS, RUN_TOKENS, BLOCK_BITS, RUN_BITS = 8192, 2_000_000, 16, 16
#: Postings handed to Spark at once, and bytes of a row group.
BATCH_POSTINGS, GROUP_BYTES = 100_000, 4 << 20
#: Distinct asked terms that the scan of the postings is given; beyond them it reads all.
SEEK_TERMS = 200
#: Pairs of a question and a posting of its terms up to which all are exchanged and summed; beyond them runs are scored where they lie.
DIRECT_HITS = 20_000_000
#: Rows and bytes of asked terms that every task may hold to score runs, and cells of its table of questions and documents. More terms go by blocks.
TASK_TERMS, TASK_BYTES, TASK_CELLS = 100_000, 16 << 20, 4_000_000
#: Values of one ``IN`` that Spark hands to Parquet as they are.
IN_VALUES = 10
#: Scores are rounded to six digits; bounds are compared with this much to spare.
SLACK = 1e-5

RECIPES = ("title", "abstract", "title_abstract", "boosted_title_abstract_mesh")


def recipe_text(recipe: str) -> Column:
    """The indexed text of a corpus row under one of the field recipes."""
    if recipe == "title":
        return F.col("title")
    if recipe == "abstract":
        return F.col("text")
    if recipe == "title_abstract":
        return F.concat_ws(" ", "title", "text")
    if recipe == "boosted_title_abstract_mesh":
        return F.concat_ws(" ", "title", "title", "text", F.array_join("mesh_terms", " "))
    raise ValueError(f"unknown recipe {recipe!r}")


class SparseIndex(NamedTuple):
    """``postings`` (t, block, doc_id, tf, len) in that order inside a run, ``vocabulary`` (t, df, idf), ``stats`` (one row: n, avg_len, n_blocks), ``blocks`` (t, block, most), made from the postings when read."""

    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame
    blocks: DataFrame


def _clustered(rows: DataFrame, order: list[str], name: str, parts: int = 0) -> DataFrame:
    """``rows`` written in ``order`` inside each file (as they come where it is empty); with ``parts``, in ranges in files of their own. No key need fit into one."""
    path = scratch.new_path(rows.sparkSession, name)
    placed = rows.repartitionByRange(parts, *order) if parts else rows
    placed = placed.sortWithinPartitions(*order) if order else placed
    placed.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _gain(average: float | Column) -> Column:
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / average)
    return F.col("tf") * (K1 + 1) / norm


def _run_postings(held: list[pa.RecordBatch], first: int, block_docs: int) -> Iterator[pa.RecordBatch]:
    """The postings of a run in the order of terms and documents; its blocks are numbered from ``first``."""
    ids, lists = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
    lens, coded = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()
    order, n = pc.sort_indices(coded.dictionary).to_numpy(), len(ids)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key, tf = np.unique(place[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), lens), return_counts=True)
    for low in range(0, len(key), BATCH_POSTINGS):
        term, doc = np.divmod(key[low : low + BATCH_POSTINGS], n)
        columns = [coded.dictionary.take(pa.array(order[term])), pa.array(first + doc // block_docs), ids.take(pa.array(doc)), pa.array(tf[low : low + BATCH_POSTINGS].astype(np.int64)), pa.array(lens[doc].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["t", "block", "doc_id", "tf", "len"])


def _runs(block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's ``doc_id, tokens`` as postings, run after run."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, held, docs, size = TaskContext.get().partitionId(), 0, [], 0, 0
        flush = lambda: _run_postings(held, (part << RUN_BITS | run) << BLOCK_BITS, block_docs)
        for batch in batches:
            ends, at = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))]), 0
            while at < batch.num_rows:
                fit = int(np.searchsorted(ends, ends[at] + RUN_TOKENS - size, "right")) - 1 - at
                n = min(RUN_DOCS - docs, fit, batch.num_rows - at)
                if n < 1 and held:
                    yield from flush()
                    run, held, docs, size = run + 1, [], 0, 0
                    continue
                n = max(n, 1)
                held.append(batch.slice(at, n))
                at, docs, size = at + n, docs + n, size + int(ends[at + n] - ends[at])
        if held:
            yield from flush()

    return build


def bm25_index(corpus: DataFrame, recipe: str = "title_abstract", block_docs: int = BLOCK_DOCS) -> SparseIndex:
    """The index of a corpus, tokenised once and written to the shared folder where its documents are read; of the postings only sums by term are exchanged.

    A term's inverse document frequency below 0 becomes a quarter of the vocabulary's mean.
    """
    n, ids = corpus.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    tokens = corpus.select("doc_id", bm25_tokens(recipe_text(recipe)).alias("tokens"))
    if ids < n:  # rows of one id are one document
        tokens = tokens.groupBy("doc_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    schema = f"t string, block long, doc_id {corpus.schema['doc_id'].dataType.simpleString()}, tf long, len int"
    postings = _clustered(tokens.mapInArrow(_runs(block_docs), schema), [], "postings")
    counted = postings.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))
    raw = scratch.written(counted.select("t", "df", "uses", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "vocabulary")
    total, floor = raw.agg(F.sum("uses"), EPSILON * F.avg("raw")).first()
    average = total / n if total else None
    stats = corpus.sparkSession.createDataFrame([(n, average, max(1, n // block_docs))], "n long, avg_len double, n_blocks long")
    vocabulary = raw.select("t", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf"))
    return SparseIndex(postings, vocabulary, stats, postings.groupBy("t", "block").agg(F.max(_gain(F.lit(average or 1.0))).alias("most")))


def top_k(scored: DataFrame, k: int, order: list[Column], group: str = "question_id") -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; ranks are cut before the exchange as well."""
    if k < 1:
        raise ValueError("k must be positive")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def seek(table: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of a table clustered by ``t`` for a written list of distinct ``t``: while that is short the scan gets it as a filter, and reads only where its terms can be."""
    asked = sorted(r[0] for r in terms.limit(SEEK_TERMS + 1).collect())
    if len(asked) > SEEK_TERMS:
        return table
    if not asked:
        return table.limit(0)
    # neighbours share a list, so that each list spans a narrow range
    found = None
    for low in range(0, len(asked), IN_VALUES):
        some = F.col("t").isin(asked[low : low + IN_VALUES])
        found = some if found is None else found | some
    return table.where(found)


def _weights(index: SparseIndex, questions: DataFrame, text_col: str) -> DataFrame:
    asked = questions.select("question_id", F.explode(bm25_tokens(text_col)).alias("t")).groupBy("question_id", "t").agg(F.count(F.lit(1)).alias("qtf"))
    found = index.vocabulary.join(sized(asked), "t")
    return scratch.written(found.select("question_id", "t", "df", (F.col("qtf") * F.col("idf")).alias("w")), "terms")


def _summed(hits: DataFrame, index: SparseIndex) -> DataFrame:
    gains = hits.join(F.broadcast(index.stats), how="cross").select("question_id", "doc_id", (F.col("w") * _gain(F.col("avg_len"))).alias("s"))
    return gains.groupBy("question_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def _scores(index: SparseIndex, postings: DataFrame, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """``question_id, doc_id, score`` of all documents in the ``blocks`` of each question that hold any of its terms."""
    wanted = terms.join(blocks.select("question_id", "block"), "question_id")
    return _summed(postings.join(sized(scratch.written(wanted, "wanted")), ["t", "block"]), index)


def bounds(index: SparseIndex, terms: DataFrame) -> DataFrame:
    """``question_id, block, bound``: what no document of the block scores above."""
    blocks = seek(index.blocks, terms.select("t").distinct())
    gains = blocks.join(sized(terms), "t").groupBy("question_id", "block")
    return gains.agg(F.sum(F.greatest(F.col("w"), F.lit(0.0)) * F.col("most")).alias("bound"))


def visited(index: SparseIndex, terms: DataFrame, postings: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All blocks with their bounds and order, the scores of each question's first blocks, and the other blocks whose bound reaches the k-th of those."""
    first = max(FIRST_BLOCKS, 2 * -(-k // BLOCK_DOCS))
    order = Window.partitionBy("question_id").orderBy(F.desc("bound"), "block")
    ranked = scratch.written(bounds(index, terms).withColumn("nth", F.row_number().over(order)), "bounds")
    found = scratch.written(_scores(index, postings, terms, ranked.where(F.col("nth") <= first)), "first")
    kth = top_k(found, k, [F.desc("score"), F.asc("doc_id")]).where(F.col("rank") == k).select("question_id", F.col("score").alias("least"))
    rest = ranked.where(F.col("nth") > first).join(sized(scratch.written(kth, "least")), "question_id", "left")
    return ranked, found, scratch.written(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("question_id", "block"), "rest")


def _scorer(asked: pa.Table, terms: pa.Array, average: float, k: int) -> Callable[[pa.Table], pa.Table]:
    """A function from the asked postings of a run to ``question_id, doc_id, s`` of each question's first ``k`` in it, and of what rounding might put among them."""
    coded = asked["question_id"].combine_chunks().dictionary_encode()
    number = pc.index_in(asked["t"].combine_chunks(), terms).to_numpy()
    order = np.argsort(number, kind="stable")
    question, weight = coded.indices.to_numpy()[order], asked["w"].to_numpy()[order]
    starts, names = np.searchsorted(number[order], np.arange(len(terms) + 1)), coded.dictionary

    def score(table: pa.Table) -> pa.Table:
        docs = table["doc_id"].combine_chunks().dictionary_encode()
        ids, doc, nr = docs.dictionary, docs.indices.to_numpy(), table["nr"].to_numpy()
        tf, size = table["tf"].to_numpy().astype(float), table["len"].to_numpy()
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        out, step = [], max(1, TASK_CELLS // len(ids))
        for low in range(0, len(names), step):
            mine = (question >= low) & (question < low + step)
            n, before = min(step, len(names) - low), np.concatenate([[0], np.cumsum(mine)])[starts]
            first, many = before[nr], before[nr + 1] - before[nr]
            row = np.repeat(np.arange(len(nr)), many)
            at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(row))
            cell = (question[mine][at] - low) * len(ids) + doc[row]
            sums = np.bincount(cell, weight[mine][at] * gain[row], n * len(ids)).reshape(n, -1)
            hit = np.bincount(cell, minlength=n * len(ids)).reshape(n, -1) > 0
            sums[~hit] = -np.inf
            if len(ids) > k:
                hit &= sums >= np.partition(sums, len(ids) - k, axis=1)[:, len(ids) - k, None] - SLACK
            q, d = np.nonzero(hit)
            ranked = np.lexsort((place[d], -sums[q, d], q))
            q, d = q[ranked], d[ranked]
            # of equal sums those beyond the k-th place lose to smaller ids
            nth, s = np.arange(len(q)) - np.searchsorted(q, q), sums[q, d]
            kth = s[np.minimum(np.searchsorted(q, q) + k - 1, len(q) - 1)]
            keep = (nth < k) | (s < kth)
            out.append((q[keep] + low, d[keep], s[keep]))
        q, d, s = (np.concatenate(x) for x in zip(*out))
        return pa.table({"question_id": names.take(pa.array(q)), "doc_id": ids.take(pa.array(d)), "s": pa.array(s)})

    return score


def _by_runs(index: SparseIndex, postings: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """``question_id, doc_id, score`` of each question's best documents in every run; each task holds all ``terms``."""
    spark, kinds = terms.sparkSession, dict(terms.dtypes) | dict(postings.dtypes)
    asked = terms.select("question_id", "t", "w").toArrow()
    words = pc.unique(asked["t"])
    numbers = spark.createDataFrame(pa.table({"t": words, "nr": pa.array(range(len(words)), pa.int32())}))
    run = F.shiftright("block", BLOCK_BITS).alias("run")
    hits = postings.join(F.broadcast(numbers), "t").select(run, "doc_id", "tf", "len", "nr")
    score = _scorer(asked, words, index.stats.first()["avg_len"], k)
    found = hits.groupBy("run").applyInArrow(score, f"question_id {kinds['question_id']}, doc_id {kinds['doc_id']}, s double")
    return found.select("question_id", "doc_id", F.round("s", 6).alias("score"))


def bm25_search(index: SparseIndex, questions: DataFrame, k: int = 10, text_col: str = "question", direct_hits: int = DIRECT_HITS) -> DataFrame:
    """Okapi BM25 over matching documents; repeated question tokens count again. Scores are rounded before ranking.

    Up to ``direct_hits`` postings of asked terms are scored at once, beyond them run by run, or by blocks where the terms don't fit into a task; the result is the same.
    """
    if k < 1:
        raise ValueError("k must be positive")
    terms = _weights(index, questions, text_col)
    postings = seek(index.postings, terms.select("t").distinct())
    rows, hits, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if not rows or hits <= direct_hits:
        scored = _summed(postings.join(sized(terms), "t"), index)
    elif rows <= TASK_TERMS and size <= TASK_BYTES:
        scored = _by_runs(index, postings, terms, k)
    else:
        _, found, rest = visited(index, terms, postings, k)
        scored = found.unionByName(_scores(index, postings, terms, rest))
    return top_k(scored, k, [F.desc("score"), F.asc("doc_id")])
