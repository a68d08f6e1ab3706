"""Audits of a corpus and its questions, frozen splits, run hygiene and error codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, stable_order, word_tokens, year_of

#: Error codes.
ERROR_CODES = ("R1", "R2", "CTX1", "CTX2", "G1", "G2", "G3", "CIT1", "CIT2", "S1", "SYS1")
TYPES = ("yesno", "factoid", "list", "summary")
LOW_ROUGE = 0.10


def corpus_audit(corpus: DataFrame) -> DataFrame:
    """One row of counts: rows, unique and repeated ids, missing fields, word and year statistics, duplicate texts."""
    full = F.concat_ws(" ", "title", "text")
    rows = corpus.select("pmid", F.size(word_tokens(full)).alias("words"), year_of("publication_date").alias("year"), F.sha2(normalize(full), 256).alias("norm"), *[(F.coalesce(F.col(c), F.lit("")) == "").alias(f"no_{c}") for c in ("title", "text", "url")])
    main = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("pmid").alias("unique_ids"),
        *[F.count_if(f"no_{c}").alias(f"missing_{c}") for c in ("title", "text", "url")],
        F.min("words").alias("words_min"),
        F.round(F.avg("words"), 3).alias("words_mean"),
        F.max("words").alias("words_max"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
    )
    same = rows.groupBy("norm").count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"))
    return main.withColumn("repeated_ids", F.col("rows") - F.col("unique_ids")).join(same, how="cross")


def qa_audit(questions: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """By type: questions, words, relevant documents, those in the corpus, questions without any."""
    known = qrels.join(corpus.select("doc_id"), "doc_id", "left_semi").groupBy("question_id").agg(F.count(F.lit(1)).alias("reachable"))
    all_ = qrels.groupBy("question_id").agg(F.count(F.lit(1)).alias("gold"))
    rows = questions.select("question_id", "type", F.size(word_tokens("question")).alias("words")).join(all_, "question_id", "left").join(known, "question_id", "left")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("words"), 3).alias("words_mean"), F.coalesce(F.sum("gold"), F.lit(0)).alias("gold_refs"), F.coalesce(F.sum("reachable"), F.lit(0)).alias("reachable_refs"), F.count_if(F.col("reachable").isNull()).alias("without_gold"))


def snippet_audit(annotations: DataFrame, corpus: DataFrame) -> DataFrame:
    """Of ``doc_id, section, begin, end, text``: documents found, sections known, texts contained, offsets exact."""
    rows = annotations.withColumnRenamed("text", "said").join(corpus.select("doc_id", "title", "text"), "doc_id", "left")
    section = F.when(F.lower("section") == "title", F.col("title")).when(F.lower("section") == "abstract", F.col("text"))
    exact = F.substring(section, F.col("begin") + 1, F.col("end") - F.col("begin")) == F.col("said")
    return rows.agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("text").isNotNull()).alias("reachable"), F.count_if(F.col("text").isNotNull() & F.coalesce(section == "", F.lit(True))).alias("unknown_section"), F.count_if(F.contains(section, "said") & (F.col("said") != "")).alias("contained"), F.count_if(exact).alias("exact_offsets"))


def stratified_sample(rows: DataFrame, per_type: int, seed: int) -> DataFrame:
    """The first ``per_type`` ids of each type in the stable order."""
    order = Window.partitionBy("type").orderBy(stable_order("question_id", seed))
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_type).drop("r")


def freeze_splits(dev: DataFrame, seed: int, validation: int, samples: dict[str, tuple[int, int]]) -> DataFrame:
    """``population, question_id``: validation from questions without a normalized twin, the rest as selection, samples of that.

    ``samples`` names (rows a type, seed offset).
    """
    rows = dev.select("question_id", "type", F.sha2(normalize("question"), 256).alias("norm"))
    alone = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("norm"))).where("c = 1")
    held = stratified_sample(alone, validation, seed + 1).select("question_id", "type")
    rest = rows.select("question_id", "type").join(held.select("question_id"), "question_id", "left_anti")
    out = held.select(F.lit("validation").alias("population"), "question_id").unionByName(rest.select(F.lit("selection").alias("population"), "question_id"))
    for name, (n, offset) in samples.items():
        out = out.unionByName(stratified_sample(rest, n, seed + offset).select(F.lit(name).alias("population"), "question_id"))
    return out


def verify_splits(splits: DataFrame, dev: DataFrame) -> DataFrame:
    """One row: ids in both main populations, sample ids outside selection, normalized groups in both."""
    main = splits.where(F.col("population").isin("validation", "selection"))
    overlap = main.groupBy("question_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("overlap"))
    samples = splits.where(~F.col("population").isin("validation", "selection"))
    outside = samples.join(splits.where("population = 'selection'").select("question_id"), "question_id", "left_anti").agg(F.count(F.lit(1)).alias("outside"))
    norm = dev.select("question_id", normalize("question").alias("norm")).join(main, "question_id").groupBy("norm").agg(F.countDistinct("population").alias("c"))
    crossing = norm.agg(F.count_if(F.col("c") > 1).alias("crossing"))
    return overlap.join(outside, how="cross").join(crossing, how="cross")


def merge_shards(shards: DataFrame) -> DataFrame:
    """One row a question from ``question_id, shard, failed, result``: a success replaces failures; two different successes are an error."""
    good = shards.where("NOT failed").groupBy("question_id").agg(F.countDistinct("result").alias("c"))
    if good.where("c > 1").limit(1).count():
        raise ValueError("shards disagree on a successful result")
    order = Window.partitionBy("question_id").orderBy("failed", "shard")
    recovered = F.max(F.col("failed").cast("int")).over(Window.partitionBy("question_id")) == 1
    rows = shards.withColumn("recovered", recovered).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return rows.withColumn("recovered", F.col("recovered") & ~F.col("failed"))


def failure_sequence(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """By key: first failure, successes after it, failures in the unbroken tail; positions from 0."""
    own = Window.partitionBy(*keys).orderBy(order)
    rows = runs.withColumn("i", F.row_number().over(own) - 1)
    first = F.min(F.when(F.col("failed"), F.col("i")))
    last_good = F.max(F.when(~F.col("failed"), F.col("i")))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if("failed").alias("failures"), first.alias("first_failure"), last_good.alias("last_good"))
    after = rows.join(stats.select(*keys, "first_failure"), keys).groupBy(*keys).agg(F.count_if(~F.col("failed") & (F.col("i") > F.col("first_failure"))).alias("successes_after"))
    return stats.join(after, keys).select(*keys, "rows", "failures", "first_failure", "successes_after", (F.col("rows") - 1 - F.coalesce("last_good", F.lit(-1))).alias("tail"))


def context_invariant(left: DataFrame, right: DataFrame, key: str = "question_id", value: str = "hash") -> DataFrame:
    """One row: compared and mismatching keys; a key of one side only mismatches."""
    both = left.select(key, F.col(value).alias("l"), F.lit(True).alias("a")).join(right.select(key, F.col(value).alias("r"), F.lit(True).alias("b")), key, "full")
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("l").eqNullSafe(F.col("r")) | F.col("a").isNull() | F.col("b").isNull()).alias("mismatches"))


def error_codes() -> Column:
    """Codes of a row with ``failed, has_provenance, retrieved_hit, packed_hit, span_f1, answered, type_ok, cited, valid, rouge``."""
    retrieval = F.when(F.col("has_provenance") & ~F.col("retrieved_hit"), "R1").when(F.col("has_provenance") & ~F.col("packed_hit"), "CTX1").when(F.col("has_provenance") & (F.col("span_f1") == 0), "R2")
    return F.array_compact(
        F.array(
            F.when(F.col("failed"), "SYS1"),
            retrieval,
            F.when(F.col("answered") & ~F.col("type_ok"), "G3"),
            F.when(F.col("valid") < F.col("cited"), "CIT2"),
            F.when(~F.col("failed") & (F.col("rouge") < LOW_ROUGE), "G2"),
        )
    )


def check_codes(codes: DataFrame) -> DataFrame:
    """Codes that the taxonomy lacks."""
    return codes.where(~F.col("code").isin(*ERROR_CODES))
