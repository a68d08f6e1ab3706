"""Structured answers: prompts, a provider behind a cache, parsing and validation, and the engine that joins it all.

No model is at hand, so that the default provider is extractive and deterministic: its answers
exercise every later stage, and say nothing about a model's quality.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cited_ids, content_hash
from ..operators import evidence as V
from ..operators import expansion as X
from ..operators import metrics as M
from ..operators import retrieval as R
from ..sources import scratch, store
from . import gateway

ANSWER_SCHEMA = "predicted_type string, exact_answer string, ideal_answer string, citation_pmids array<string>, abstained boolean, evidence_support_score double"
#: Fixed value: the sentence of an abstention.
INSUFFICIENT = "Insufficient evidence in the provided context."
TYPES = ("yesno", "factoid", "list", "summary")
STYLES = ("closed_book", "generic", "citation", "predicted_type_schema", "gold_type")
_KEYS = "Answer with one JSON object of predicted_type, exact_answer, ideal_answer, citation_pmids, abstained and evidence_support_score."


def system_prompt(style: str, gold_type: str | None = None) -> str:
    """The system prompt of a style; texts are this engine's own."""
    if style not in STYLES:
        raise ValueError(f"unknown prompt style {style!r}")
    parts = [_KEYS]
    if style == "closed_book":
        parts.append("No evidence is given; cite nothing.")
    else:
        parts.append("Use the given evidence only.")
    if style in ("citation", "predicted_type_schema", "gold_type"):
        parts.append(f"Copy citations from [PMID:...] labels. Without enough evidence set abstained and answer: {INSUFFICIENT}")
    if style == "predicted_type_schema":
        parts.append("Decide first whether the question is yesno, factoid, list or summary.")
    if style == "gold_type":
        parts.append(f"The question is of type {gold_type}.")
    return "\n".join(parts)


def user_prompt(question: str = "question", context: str = "context") -> Column:
    return F.concat(F.lit("QUESTION\n"), F.col(question), F.lit("\n\nEVIDENCE\n"), F.coalesce(F.nullif(F.col(context), F.lit("")), F.lit("[NO EVIDENCE]")))


def extractive_answer(question: str = "question", context: str = "context", kind: str = "type") -> Column:
    """The stand-in provider's raw response: the first block's first sentence in a fenced JSON object; nothing to quote means abstention."""
    first = F.regexp_extract(F.coalesce(F.col(context), F.lit("")), r"^\[PMID:\d+\] [^\n]*\n([^\n.!?]*[.!?]?)", 1)
    pmid = F.slice(cited_ids(context), 1, 1)
    exact = F.when(F.col(kind) == "yesno", "yes").when(F.col(kind) == "summary", F.lit(None)).otherwise(F.element_at(F.split(F.nullif(first, F.lit("")), " "), 1))
    value = F.struct(
        F.col(kind).alias("predicted_type"),
        exact.alias("exact_answer"),
        F.nullif(F.trim(first), F.lit("")).alias("ideal_answer"),
        pmid.alias("citation_pmids"),
        (F.trim(first) == "").alias("abstained"),
        F.when(F.trim(first) == "", 0.0).otherwise(1.0).alias("evidence_support_score"),
    )
    return F.concat(F.lit("```json\n"), F.to_json(value, {"ignoreNullFields": "false"}), F.lit("\n```"))


def parse_answer(raw: str) -> Column:
    """The answer struct in a response: in a fence or bare, from the first brace to the last. An explicit abstention without
    text gets the standard sentence. Null where there is no object."""
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.regexp_extract(F.coalesce(F.nullif(fenced, F.lit("")), F.col(raw)), r"(?s)\{.*\}", 0)
    value = F.from_json(F.nullif(body, F.lit("")), ANSWER_SCHEMA)
    no_text = F.trim(F.coalesce(value["ideal_answer"], F.lit(""))) == ""
    return F.when(value.isNotNull(), value.withField("ideal_answer", F.when(value["abstained"] & no_text, F.lit(INSUFFICIENT)).otherwise(value["ideal_answer"])))


def valid_answer(answer: str) -> Column:
    """Whether a parsed answer keeps the schema's rules."""
    a = F.col(answer)
    checks = (
        a.isNotNull()
        & a["predicted_type"].isin(*TYPES)
        & F.length(a["ideal_answer"]).between(1, 4000)
        & F.forall(F.coalesce(a["citation_pmids"], F.array().cast("array<string>")), lambda x: x.rlike(r"^\d+$"))
        & F.coalesce(a["evidence_support_score"].between(0, 1), F.lit(True))
    )
    return F.coalesce(checks, F.lit(False))


def generate(prompts: DataFrame, cache_path: str | None, provider: Callable[[], Column] = extractive_answer, model: str = "extractive") -> DataFrame:
    """Responses through a content-addressed cache: only payloads that it lacks reach the provider, each once, and are appended.

    ``prompts`` has ``question_id, question, context, type, system``; the result adds ``payload_hash, raw``.
    """
    spark = prompts.sparkSession
    rows = prompts.withColumn("payload_hash", content_hash(F.lit(model), "system", user_prompt()))
    if cache_path is None:
        return rows.withColumn("raw", provider())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.parquet(cache_path) if exists else spark.createDataFrame([], "payload_hash string, raw string")
    misses = rows.join(known.select("payload_hash"), "payload_hash", "left_anti").dropDuplicates(["payload_hash"])
    misses.select("payload_hash", provider().alias("raw")).write.mode("append").parquet(cache_path)
    full = spark.read.parquet(cache_path)
    return rows.join(full, "payload_hash")


def prepare_contexts(questions: DataFrame, corpus: DataFrame, method: str = "bm25", strategy: str = "lexical", diversity: int | None = None, order: str = "relevance_descending", budget: int = V.CONTEXT_BUDGET, expand: bool = False, vectors: DataFrame | None = None, queries: DataFrame | None = None, documents: int = V.EVIDENCE_DOCUMENTS, index: R.SparseIndex | None = None, run: DataFrame | None = None) -> DataFrame:
    """``question_id, context, context_hash, evidence_set_hash, retrieved`` without any gold column.

    Retrieval sees the expanded question, evidence ranking the original; a ``run`` that is given is taken instead. The order is applied after packing, so that the packed set doesn't depend on it.
    """
    if run is None:
        asked = X.expand(questions, X.term_vocabulary(corpus)).select("question_id", F.col("query").alias("question")) if expand else questions.select("question_id", "question")
        run = R.retrieve(method, asked, corpus, vectors, queries, documents, index=index, asked=questions)
    run = scratch.written(run.where(F.col("rank") <= documents).select("question_id", "doc_id", "score", "rank"), "run")
    if strategy == "lexical":
        ranked = V.rank_lexical(run, questions, corpus)
    elif strategy == "bm25":
        ranked = V.rank_bm25_local(V.candidates(run, corpus), questions)
    elif strategy == "abstract":
        ranked = R.beside(run, corpus.select("doc_id", F.col("text").alias("snippet")))
    else:
        raise ValueError(f"unknown evidence strategy {strategy!r}")
    if diversity is not None:
        ranked = V.source_diverse(ranked, diversity)
    packed = V.pack(R.beside(ranked.select("question_id", "doc_id", "rank", "snippet"), corpus.select("doc_id", "pmid", "title")), budget)
    blocks = F.split("context", "\n\n(?=\\[PMID:)")
    if order == "strongest_middle":
        packed = packed.withColumn("_b", blocks).withColumn("_m", V.strongest_middle("_b")).withColumn("context", F.array_join("_m", "\n\n")).drop("_b", "_m")
    elif order != "relevance_descending":
        raise ValueError(f"unknown context order {order!r}")
    retrieved = run.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r")).select("question_id", F.transform("r", lambda x: x["doc_id"]).alias("retrieved"))
    rows = questions.select("question_id").join(packed, "question_id", "left").join(retrieved, "question_id", "left")
    context = F.coalesce("context", F.lit(""))
    return rows.select("question_id", context.alias("context"), F.sha2(context, 256).alias("context_hash"), F.sha2(F.array_join(F.array_sort(F.split(context, "\n\n(?=\\[PMID:)")), "\n\n"), 256).alias("evidence_set_hash"), "retrieved")


def oracle_contexts(arm: str, questions: DataFrame, annotations: DataFrame, corpus: DataFrame, budget: int = 600) -> DataFrame:
    """Contexts without evidence (``closed_book``) or from annotated snippets (``gold_snippets``)."""
    if arm == "closed_book":
        return questions.select("question_id", F.lit("").alias("context"))
    if arm != "gold_snippets":
        raise ValueError(f"unknown oracle arm {arm!r}")
    frozen = V.frozen_snippets(annotations, corpus).select("question_id", F.col("position").alias("rank"), "pmid", "title", "snippet")
    packed = V.pack(frozen, budget)
    return questions.select("question_id").join(packed, "question_id", "left").select("question_id", F.coalesce("context", F.lit("")).alias("context"))


def oracle_arms(questions: DataFrame, corpus: DataFrame, qrels: DataFrame, annotations: DataFrame, run: DataFrame, budget: int = 600) -> DataFrame:
    """``arm, question_id, context`` of the four oracle arms, from no evidence to the annotated snippets.

    L1 takes the documents that ``run`` found, L2 the relevant ones, both with the evidence that the ranker finds in them. Every arm
    must cover the same questions.
    """
    made = {
        "L0": oracle_contexts("closed_book", questions, annotations, corpus),
        "L1": prepare_contexts(questions, corpus, run=run, budget=budget),
        "L2": prepare_contexts(questions, corpus, run=R.gold_run(qrels), budget=budget),
        "L3": oracle_contexts("gold_snippets", questions, annotations, corpus, budget),
    }
    arms = [df.select(F.lit(arm).alias("arm"), "question_id", "context") for arm, df in made.items()]
    rows = scratch.written(reduce(DataFrame.unionByName, arms), "arms")
    asked = questions.count()
    if rows.groupBy("question_id").agg(F.countDistinct("arm").alias("n")).where(F.col("n") == len(made)).count() != asked or rows.count() != asked * len(made):
        raise ValueError("the arms do not cover the same questions once each")
    return rows


def query_run(questions: DataFrame, corpus: DataFrame, vectors: DataFrame, queries: DataFrame, index: R.SparseIndex, k: int = 100, rerank: bool = True) -> DataFrame:
    """A whole retrieval run without gold columns: term expansion, sparse and dense lists, fusion, then the pair scorer on the original question."""
    rewritten = X.expand(questions, X.term_vocabulary(corpus)).select("question_id", F.col("query").alias("question"))
    fused = R.rrf([R.bm25_search(index, rewritten, k), R.dense_search(queries, vectors, k)], k)
    return R.rerank_indexed(fused, questions, corpus, index, k) if rerank else fused


def answer(questions: DataFrame, contexts: DataFrame, style: str = "predicted_type_schema", cache_path: str | None = None, provider: Callable[[], Column] = extractive_answer) -> DataFrame:
    """One row a question: the validated answer, citations that the evidence has, and whether it failed.

    A response that can't be parsed or breaks the schema's rules fails; the row stays.
    """
    prompts = questions.select("question_id", "question", "type").join(contexts.select("question_id", "context"), "question_id").withColumn("system", F.lit(system_prompt(style, None)))
    rows = generate(prompts, cache_path, provider).withColumn("answer", parse_answer("raw")).withColumn("ok", valid_answer("answer"))
    cited = F.array_distinct(F.coalesce(F.col("answer.citation_pmids"), F.array().cast("array<string>")))
    return rows.select(
        "question_id",
        "type",
        "payload_hash",
        F.when(F.col("ok"), F.col("answer")).alias("answer"),
        F.when(F.col("ok"), F.size(cited)).otherwise(0).alias("citation_count"),
        F.when(F.col("ok"), F.array_intersect(cited, cited_ids("context"))).otherwise(F.array().cast("array<string>")).alias("citations"),
        (~F.col("ok")).alias("failed"),
    )


def context_generation(questions: DataFrame, contexts: DataFrame, provider: gateway.Provider = gateway.extractive, style: str = "predicted_type_schema", model: str = "extractive", cache_path: str | None = None, workers: int = 8, pause: float = gateway.PAUSE) -> DataFrame:
    """Answers to prepared contexts without any gold column: ``question_id, prompt_hash, evidence_hash, answer, citation_count, citations, attempts,
    latency_ms, cached, failed, error_type, error_message``.

    ``contexts`` may have ``failed``: those rows are not asked and fail as upstream failures. An answer that can't be parsed or breaks the schema is tried
    again, then fails. With the style ``gold_type`` the prompt names the question's type; it is the only style that reads it.
    """
    upstream = F.coalesce("failed", F.lit(False)) if "failed" in contexts.columns else F.lit(False)
    rows = questions.select("question_id", "question", "type").join(contexts.select("question_id", "context", upstream.alias("upstream")), "question_id")
    typed = {k: system_prompt(style, k) for k in ("yesno", "factoid", "list", "summary")}
    system = F.create_map(*[F.lit(x) for pair in typed.items() for x in pair])[F.col("type")] if style == "gold_type" else F.lit(system_prompt(style))
    rows = rows.withColumn("system", system).withColumn("user", user_prompt())

    def check(raw: str) -> None:
        value = gateway.json_object(raw)
        said = value.get("ideal_answer") or (INSUFFICIENT if value.get("abstained") is True else "")
        if value.get("predicted_type") not in TYPES or not 1 <= len(said) <= 4000:
            raise ValueError("the answer breaks the schema")

    called = gateway.call(rows.where("NOT upstream"), provider, model, cache_path, check, workers, pause=pause)
    parsed = called.withColumn("answer", parse_answer("raw")).withColumn("ok", valid_answer("answer"))
    cited = F.array_distinct(F.coalesce(F.col("answer.citation_pmids"), F.array().cast("array<string>")))
    names = ("question_id", "prompt_hash", "evidence_hash", "answer", "citation_count", "citations", "attempts", "latency_ms", "cached", "failed", "error_type", "error_message")
    done = parsed.select(
        "question_id",
        F.sha2(F.concat_ws("\n", "system", "user"), 256).alias("prompt_hash"),
        F.sha2("context", 256).alias("evidence_hash"),
        F.when(F.col("ok"), F.col("answer")).alias("answer"),
        F.when(F.col("ok"), F.size(cited)).otherwise(0).alias("citation_count"),
        F.when(F.col("ok"), F.array_intersect(cited, cited_ids("context"))).otherwise(F.array().cast("array<string>")).alias("citations"),
        "attempts",
        "latency_ms",
        "cached",
        (~F.col("ok")).alias("failed"),
        F.when(~F.col("ok"), F.coalesce("error_type", F.lit("InvalidAnswer"))).alias("error_type"),
        F.when(~F.col("ok"), F.coalesce("error_message", F.lit(""))).alias("error_message"),
    )
    never = {"citation_count": F.lit(0), "citations": F.array().cast("array<string>"), "attempts": F.lit(0), "cached": F.lit(False), "failed": F.lit(True), "error_type": F.lit("UpstreamFailure"), "error_message": F.lit("")}
    skipped = rows.where("upstream").select("question_id", F.sha2("context", 256).alias("evidence_hash"))
    skipped = skipped.select(*[never.get(n, F.col(n) if n in ("question_id", "evidence_hash") else F.lit(None)).cast(done.schema[n].dataType).alias(n) for n in names])
    return done.unionByName(skipped)


def score_generation(rows: DataFrame, gold: DataFrame, stemmed: bool = False) -> DataFrame:
    """Inference rows with ``rouge_su4, rouge2_f1, type_correct`` against ``question_id, type, reference``; failures score 0. Gold meets the answers here first. ``stemmed`` is for ROUGE-2."""
    joined = scratch.written(rows.join(gold.select("question_id", F.col("type").alias("gold_type"), "reference"), "question_id"), "scored")
    texts = joined.select("question_id", F.coalesce("answer.ideal_answer", F.lit("")).alias("prediction"), "reference")
    su4 = M.overlap_f1(texts, "question_id").select("question_id", F.col("f1").alias("rouge_su4"))
    two = M.overlap_f1(texts, "question_id", 1, False, stemmed).select("question_id", F.col("f1").alias("rouge2_f1"))
    right = ~F.col("failed") & F.coalesce(F.col("answer.predicted_type") == F.col("gold_type"), F.lit(False))
    return joined.withColumn("type_correct", right).join(su4, "question_id").join(two, "question_id").drop("gold_type", "reference")


def generation_summary(scored: DataFrame) -> DataFrame:
    """One row of a scored run: failures stay in every rate, latencies are those of successes."""
    good = F.when(~F.col("failed"), F.col("latency_ms"))
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    rows = scored.withColumn("good", good)
    nearest = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY good)")
    cited = F.sum("citation_count")
    return rows.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("failed").alias("failures"),
        rate(F.col("failed")).alias("failure_rate"),
        rate(F.col("attempts") > 1).alias("retry_rate"),
        rate(F.col("type_correct")).alias("type_accuracy"),
        F.round(F.when(cited > 0, F.sum(F.size("citations")) / cited).otherwise(0.0), 6).alias("citation_validity"),
        rate(F.size("citations") > 0).alias("citation_coverage"),
        rate(F.coalesce(F.col("answer.abstained"), F.lit(False))).alias("abstention_rate"),
        F.round(F.avg("rouge_su4"), 6).alias("mean_rouge_su4"),
        F.round(F.avg("rouge2_f1"), 6).alias("mean_rouge2"),
        nearest(0.5).alias("p50_ms"),
        nearest(0.95).alias("p95_ms"),
    )


def generation_run(questions: DataFrame, corpus: DataFrame, gold: DataFrame, index: R.SparseIndex | None = None, budget: int = 600, **options) -> DataFrame:
    """A whole run: contexts, sealed inference, then scores: ``generation_summary`` of the answers to ``questions``."""
    contexts = prepare_contexts(questions, corpus, budget=budget, index=index)
    sealed = scratch.written(context_generation(questions, contexts, **options), "inference")
    return generation_summary(score_generation(sealed, gold))


def traces(answers: DataFrame, pipeline_id: str) -> DataFrame:
    """A trace row of each answer, failed or not."""
    return answers.select(F.concat_ws("-", F.lit(pipeline_id), F.col("question_id").cast("string")).alias("trace_id"), F.current_timestamp().alias("created_at"), F.lit(pipeline_id).alias("pipeline_id"), F.to_json(F.struct("question_id", "answer", "citations", "failed")).alias("payload"))


def answer_and_trace(questions: DataFrame, contexts: DataFrame, pipeline_id: str, trace_path: str, **options) -> DataFrame:
    """``answer``, with traces appended to ``trace_path``."""
    rows = answer(questions, contexts, **options)
    store.put_traces(traces(rows, pipeline_id), trace_path)
    return rows

