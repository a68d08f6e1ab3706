"""Query expansion from controlled terms and from a generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_tokens
from .retrieval import beside, sized


def term_vocabulary(corpus: DataFrame) -> DataFrame:
    """``key, term, n``: for each normalized term its most frequent surface form, ties by the form."""
    terms = corpus.select(F.explode("mesh_terms").alias("term")).select(F.trim("term").alias("term")).where("term <> ''")
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.array_join(plain_tokens("term"), " ")).where("key <> ''")
    best = counts.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("term"))).alias("b"))
    return best.select("key", F.col("b.term").alias("term"), (-F.col("b.m")).alias("n"))


def mentioned(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``question_id, key``: the n-grams of each question that may be keys of the vocabulary.

    Vocabulary terms are indexed by their first word, with the lengths of the terms that begin with it, so that n-grams are made where a term may begin and of
    those lengths only: one long term costs nothing elsewhere.
    """
    parts = F.split("key", " ")
    first = vocabulary.groupBy(parts[0].alias("word")).agg(F.collect_set(F.size(parts)).alias("lengths"))
    words = questions.select("question_id", plain_tokens("question").alias("w")).where(F.size("w") > 0)
    at = words.select("question_id", F.posexplode("w").alias("i", "word")).join(sized(first), "word")
    # places first, words after: a row of one word must not carry its question
    starts = at.groupBy("question_id").agg(F.collect_list(F.struct("i", "lengths")).alias("at"))
    fits = lambda x: F.filter(x["lengths"], lambda n: x["i"] + n <= F.size("w"))
    grams = F.flatten(F.transform("at", lambda x: F.transform(fits(x), lambda n: F.array_join(F.slice("w", x["i"] + 1, n), " "))))
    return words.join(starts, "question_id").select("question_id", F.explode(F.array_distinct(grams)).alias("key"))


def expand(questions: DataFrame, vocabulary: DataFrame, limit: int = 3) -> DataFrame:
    """``question_id, query``: the question with up to ``limit`` vocabulary terms that it mentions, longest and most frequent first."""
    asked = mentioned(questions, vocabulary)
    found = asked.join(vocabulary, "key")
    order = Window.partitionBy("question_id").orderBy(F.desc(F.size(F.split("key", " "))), F.desc("n"), F.asc("key"))
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    added = best.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ").alias("added"))
    return questions.join(added, "question_id", "left").select("question_id", F.concat_ws(" ", "question", "added").alias("query"))


def hypothetical_expand(questions: DataFrame, generated: DataFrame) -> DataFrame:
    """The question and its generated abstract; questions without one stay as they are. ``generated`` carries its cost."""
    return questions.select("question_id", "question").join(generated, "question_id", "left").select("question_id", F.concat_ws(" ", "question", "ideal_answer").alias("query"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"))


def two_round_expand(questions: DataFrame, seeds: DataFrame, corpus: DataFrame, seed_k: int = 5, terms: int = 3) -> DataFrame:
    """A second query from the first round's documents: the stand-in adds the ``terms`` tokens that most seed excerpts share and the question lacks."""
    texts = beside(seeds.where(F.col("rank") <= seed_k).select("question_id", "doc_id"), corpus.select("doc_id", F.concat_ws(": ", "title", F.substring("text", 1, 500)).alias("excerpt")))
    tokens = texts.select("question_id", F.explode(F.array_distinct(plain_tokens("excerpt"))).alias("t")).where(F.length("t") > 3)
    asked = questions.select("question_id", F.explode(F.array_distinct(plain_tokens("question"))).alias("t"))
    counts = tokens.join(sized(asked), ["question_id", "t"], "left_anti").groupBy("question_id", "t").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("question_id").orderBy(F.desc("n"), F.asc("t"))
    best = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= terms)
    added = best.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " ").alias("added"))
    return questions.join(added, "question_id", "left").select("question_id", F.concat_ws(" ", "question", "added").alias("query"))
