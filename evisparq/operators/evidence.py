"""Evidence from retrieved documents: spans, windows, chunks, ranking, selection and packing.

Offsets are code points into the document's text, and ``text[begin:end]`` is the evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BUDGET_TOKEN, SENTENCE_GAP, bm25_tokens, budget_tokens
from ..sources import scratch
from ..sources.tables import sized
from .sparse import B, EPSILON, K1, top_k

#: Fixed values of the packing protocol.
CONTEXT_BUDGET, LEAST_BUDGET = 1200, 100
WINDOW, EVIDENCE_LIMIT, EVIDENCE_DOCUMENTS = 3, 20, 10
CHUNK_SIZE, CHUNK_OVERLAP = 256, 64

_MARK = "\x01"


def sentence_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, sentence, begin, end`` (from 1); a text without any is one span from 0 to its length."""
    parts = F.split(F.regexp_replace("text", SENTENCE_GAP, f"{_MARK}$1{_MARK}"), _MARK)
    pieces = docs.select("doc_id", F.length("text").alias("n"), F.posexplode(parts).alias("i", "piece"))
    own = Window.partitionBy("doc_id").orderBy("i")
    offset = F.coalesce(F.sum(F.length("piece")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("offset", offset).where("i % 2 = 0")
    left = F.length(F.regexp_extract("piece", r"^\s*", 0))
    right = F.length(F.regexp_replace("piece", r"\s+$", ""))
    empty = F.trim(F.regexp_replace("piece", r"\s+", " ")) == ""
    only = F.max(F.when(empty, 0).otherwise(1)).over(Window.partitionBy("doc_id")) == 0
    rows = placed.select("doc_id", "i", "n", empty.alias("empty"), only.alias("none"), (F.col("offset") + left).alias("begin"), (F.col("offset") + right).alias("end"))
    rows = rows.where("NOT empty OR (none AND i = 0)")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return rows.select("doc_id", number.alias("sentence"), F.when(F.col("none"), 0).otherwise(F.col("begin")).cast("int").alias("begin"), F.when(F.col("none"), F.col("n")).otherwise(F.col("end")).cast("int").alias("end"))


def sentence_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """One window from each sentence over up to ``size``: ``doc_id, sentence, begin, end, snippet``."""
    if not 1 <= size <= 8:
        raise ValueError("a window has 1 to 8 sentences")
    ahead = Window.partitionBy("doc_id").orderBy("sentence").rowsBetween(0, size - 1)
    windows = sentence_spans(docs).withColumn("end", F.max("end").over(ahead))
    return windows.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "sentence", "begin", "end", F.substring("text", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("snippet"))


def fixed_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` budget tokens, each ``overlap`` tokens into the last: ``doc_id, chunk, begin, end, snippet``.

    The text is cut once into strides of tokens; a chunk is a stride and the head of what follows.
    """
    if size < 32 or not 0 <= overlap < size:
        raise ValueError("size must be 32 or more and overlap within [0, size)")
    stride = size - overlap
    token = rf"(?:\s*(?:{BUDGET_TOKEN}))"
    blocks = docs.select("doc_id", budget_tokens("text").alias("n"), F.regexp_extract_all("text", F.lit(f"{token}{{1,{stride}}}"), 0).alias("b"))
    # a chunk begins with its stride's block and ends in the blocks after it
    heads = F.transform("b", lambda x, i: F.struct(x.alias("block"), F.array_join(F.slice("b", i + 1, 1 + -(-overlap // stride)), "").alias("head")))
    each = blocks.select("doc_id", "n", F.posexplode(heads).alias("i", "x")).select("doc_id", "n", "i", "x.block", "x.head")
    own = Window.partitionBy("doc_id").orderBy("i")
    rows = each.withColumn("offset", F.coalesce(F.sum(F.length("block")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the last chunk is the first that reaches the end
    rows = rows.where((F.col("i") == 0) | (F.col("i") * stride - stride + size < F.col("n"))).withColumn("raw", F.regexp_extract("head", f"^{token}{{1,{size}}}", 0))
    lead = F.length(F.regexp_extract("raw", r"^\s*", 0))
    begin, end = F.col("offset") + lead, F.col("offset") + F.length("raw")
    return rows.select("doc_id", F.col("i").alias("chunk"), begin.cast("int").alias("begin"), end.cast("int").alias("end"), F.substring("raw", lead + 1, F.length("raw")).alias("snippet"))


def _found(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """The documents of some hits, written, since windows read them twice."""
    ids = scratch.written(hits.select("doc_id").distinct(), "hits")
    return scratch.written(corpus.select("doc_id", "title", "text").join(sized(ids), "doc_id", "left_semi"), "found")


def candidates(run: DataFrame, corpus: DataFrame, size: int = WINDOW, documents: int = EVIDENCE_DOCUMENTS) -> DataFrame:
    """The pool of a question's first documents: all titles, then all windows, numbered in that order.

    ``question_id, doc_id, doc_rank, section, sentence, begin, end, snippet, ordinal``.
    """
    hits = run.where(F.col("rank") <= documents).select("question_id", "doc_id", F.col("rank").alias("doc_rank"))
    docs = _found(hits, corpus)
    titles = docs.select("doc_id", F.lit("title").alias("section"), F.lit(0).alias("sentence"), F.lit(0).alias("begin"), F.length("title").alias("end"), F.col("title").alias("snippet"))
    windows = sentence_windows(docs, size).select("doc_id", F.lit("abstract").alias("section"), "sentence", "begin", "end", "snippet")
    rows = hits.join(titles.unionByName(windows), "doc_id")
    order = Window.partitionBy("question_id").orderBy(F.desc("section"), "doc_rank", "sentence")
    return rows.withColumn("ordinal", F.row_number().over(order))


def rank_lexical(run: DataFrame, questions: DataFrame, corpus: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """Windows by the share of question terms and a little of the document's rank; ties by document and text."""
    hits = run.select("question_id", "doc_id", F.col("rank").alias("doc_rank")).join(questions.select("question_id", "question"), "question_id")
    rows = hits.join(sentence_windows(_found(hits, corpus)), "doc_id")
    terms = F.array_distinct(bm25_tokens("question"))
    share = F.size(F.array_intersect(terms, bm25_tokens("snippet"))) / F.greatest(F.size(terms), F.lit(1))
    scored = rows.select("question_id", "doc_id", "sentence", "begin", "end", "snippet", F.round(share + 0.01 / F.col("doc_rank"), 6).alias("score"))
    return top_k(scored, limit, [F.desc("score"), F.col("doc_id").cast("string"), F.asc("snippet"), F.asc("sentence")])


def rank_bm25_local(pool: DataFrame, questions: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """BM25 in which each question's candidates are the whole collection; all candidates are ranked, matched or not.

    Document frequencies are exchanged once; of the candidates' tokens only those that their question asks for are.
    """
    empty = F.array(F.lit("__empty__"))
    tokens = bm25_tokens("snippet")
    rows = scratch.written(pool.withColumn("tokens", F.when(F.size(tokens) > 0, tokens).otherwise(empty)), "pool")
    stats = rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
    df = rows.select("question_id", F.explode(F.array_distinct("tokens")).alias("t")).groupBy("question_id", "t").agg(F.count(F.lit(1)).alias("df"))
    asked = questions.select("question_id", F.explode(bm25_tokens("question")).alias("t")).groupBy("question_id", "t").agg(F.count(F.lit(1)).alias("qtf"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = scratch.written(df.join(stats, "question_id").withColumn("raw", raw).join(sized(asked), ["question_id", "t"], "left"), "terms")
    # the floor is a share of the mean over all terms of the pool, asked for or not
    floors = terms.groupBy("question_id").agg((EPSILON * F.avg("raw")).alias("floor"))
    weights = terms.where("qtf IS NOT NULL").join(floors, "question_id").select("question_id", "t", "avg_len", (F.col("qtf") * F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))).alias("w"))
    weights = scratch.written(weights, "weights")
    # only tokens that their question asks for travel
    each = rows.select("question_id", "ordinal", F.size("tokens").alias("len"), F.explode("tokens").alias("t")).join(sized(weights), ["question_id", "t"])
    tf = each.groupBy("question_id", "ordinal", "t").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"), F.first("w").alias("w"), F.first("avg_len").alias("avg_len"))
    gain = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scores = tf.groupBy("question_id", "ordinal").agg(F.sum(gain).alias("score"))
    scored = rows.drop("tokens").join(scores, ["question_id", "ordinal"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    return top_k(scored, limit, [F.desc("score"), F.asc("doc_rank"), F.asc("ordinal")])


def source_diverse(ranked: DataFrame, per_document: int = 1) -> DataFrame:
    """At most so many items of a document, in the order of ``rank``, which is closed up."""
    if per_document < 1:
        raise ValueError("per_document must be positive")
    nth = F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy("rank"))
    kept = ranked.withColumn("nth", nth).where(F.col("nth") <= per_document).drop("nth")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def block_text() -> Column:
    """An evidence block as prompts show it."""
    return F.concat(F.lit("[PMID:"), F.col("pmid"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("snippet"))


def pack(ranked: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """Greedy packing under a token budget: a block that doesn't fit is skipped, later ones may still fit.

    ``ranked`` has ``question_id, rank, pmid, title, snippet``; the result ``question_id, ranks, used, context``. Blocks of one
    question are folded in order within a row; the ranker's limit bounds them.
    """
    if budget < LEAST_BUDGET:
        raise ValueError(f"the budget must be at least {LEAST_BUDGET}")
    items = ranked.select("question_id", F.struct("rank", budget_tokens(block_text()).alias("cost"), block_text().alias("block")).alias("x"))
    rows = items.groupBy("question_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    fits = lambda s, x: s["used"] + x["cost"] <= budget
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("ranks"))
    step = lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["ranks"], F.array(x["rank"])).alias("ranks"))).otherwise(s)
    packed = rows.withColumn("p", F.aggregate("xs", start, step))
    chosen = F.filter("xs", lambda x: F.array_contains(F.col("p.ranks"), x["rank"]))
    return packed.select("question_id", F.col("p.ranks").alias("ranks"), F.col("p.used").alias("used"), F.array_join(F.transform(chosen, lambda x: x["block"]), "\n\n").alias("context"))


def strongest_middle(items: str) -> Column:
    """The first element moved to the middle of the others; fewer than three stay as they are."""
    rest = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    middle = F.floor((F.size(items) - 1) / 2).cast("int")
    moved = F.concat(F.slice(rest, 1, middle), F.slice(items, 1, 1), F.slice(rest, middle + 1, F.size(items)))
    return F.when(F.size(items) < 3, F.col(items)).otherwise(moved)


def frozen_snippets(annotations: DataFrame, corpus: DataFrame) -> DataFrame:
    """Stored annotations ``question_id, position, doc_id, begin, end`` back as evidence; an unknown document is an error.

    The score falls with the position.
    """
    annotations = scratch.written(annotations, "annotations")
    if annotations.join(corpus.select("doc_id"), "doc_id", "left_anti").limit(1).count():
        raise ValueError("an annotation names a document that the corpus lacks")
    n = F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    rows = corpus.select("doc_id", "pmid", "title", "text").join(sized(annotations), "doc_id")
    return rows.select("question_id", "position", "doc_id", "pmid", "title", "begin", "end", F.substring("text", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("snippet"), (n - F.col("position") + 1).cast("double").alias("score"))
