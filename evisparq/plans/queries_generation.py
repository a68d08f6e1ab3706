"""Registered queries on contexts, generation, parsing, configurations and relational categories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as V
from ..operators import metrics as M
from ..sources import scratch
from ..sources import tables as S
from . import generation as N
from .indexes import sparse_index
from .queries_evidence import PACK_SQL, overlap_sql
from .queries_retrieval import DENSE_SQL, MESH_SQL, METRIC_SQL, PAIRED, RERANK_SQL, RRF_SQL, _bm25, bm25_sql, question_vectors

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def contexts(spark, sf_dir, **options):
    return N.prepare_contexts(S.questions(spark, sf_dir), S.corpus(spark, sf_dir), budget=600, index=sparse_index(spark, sf_dir, "title_abstract"), **options)


CONTEXT_SQL = PACK_SQL + ", full_contexts AS (SELECT question_id, question, type, coalesce(context, '') AS context, docs FROM questions LEFT JOIN contexts USING (question_id))"


@query("prepare_contexts", S.with_sql("corpus", "questions", rest=CONTEXT_SQL) + ", r AS (SELECT question_id, string_agg(doc_id, ',' ORDER BY rank) AS retrieved FROM bm25_run GROUP BY ALL) SELECT question_id, sha256(context) AS context_hash, retrieved FROM full_contexts LEFT JOIN r USING (question_id)")
def prepare_contexts(spark, sf_dir):
    return contexts(spark, sf_dir).select("question_id", "context_hash", F.array_join(F.transform("retrieved", lambda x: x.cast("string")), ",").alias("retrieved"))


@query("context_order_invariant", S.with_sql("corpus", "questions", rest=CONTEXT_SQL) + " SELECT count(*) AS compared, CAST(0 AS BIGINT) AS mismatches FROM questions")
def context_order_invariant(spark, sf_dir):
    """The packed set is the same whatever the order in which it is shown. Both orders show one run."""
    from ..operators.audit import context_invariant

    run = scratch.written(_bm25(spark, sf_dir, "title_abstract", V.EVIDENCE_DOCUMENTS), "run")
    a = contexts(spark, sf_dir, run=run).select("question_id", F.col("evidence_set_hash").alias("hash"))
    b = contexts(spark, sf_dir, run=run, order="strongest_middle").select("question_id", F.col("evidence_set_hash").alias("hash"))
    return context_invariant(a, b)


@query("user_prompt", S.with_sql("corpus", "questions", rest=CONTEXT_SQL) + " SELECT question_id, sha256('QUESTION' || chr(10) || question || chr(10) || chr(10) || 'EVIDENCE' || chr(10) || coalesce(nullif(context, ''), '[NO EVIDENCE]')) AS prompt_hash FROM full_contexts")
def user_prompt(spark, sf_dir):
    rows = contexts(spark, sf_dir).join(S.questions(spark, sf_dir), "question_id")
    return rows.select("question_id", F.sha2(N.user_prompt(), 256).alias("prompt_hash"))


@query("closed_book_contexts", S.with_sql("questions") + " SELECT question_id, sha256('QUESTION' || chr(10) || question || chr(10) || chr(10) || 'EVIDENCE' || chr(10) || '[NO EVIDENCE]') AS prompt_hash FROM questions")
def closed_book_contexts(spark, sf_dir):
    rows = N.oracle_contexts("closed_book", S.questions(spark, sf_dir), None, None).join(S.questions(spark, sf_dir), "question_id")
    return rows.select("question_id", F.sha2(N.user_prompt(), 256).alias("prompt_hash"))


GOLD_SQL = r"""ann AS (SELECT question_id, doc_id, "begin", "end", row_number() OVER (PARTITION BY question_id ORDER BY doc_id) AS rank FROM qrels),
items AS (SELECT question_id, rank, '[PMID:' || pmid || '] ' || title || chr(10) || substr(text, "begin" + 1, "end" - "begin") AS block FROM ann JOIN corpus USING (doc_id)),
costs AS (SELECT question_id, list({'r': CAST(rank AS INTEGER), 'c': CAST(len(regexp_extract_all(block, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS INTEGER)} ORDER BY rank) AS xs FROM items GROUP BY ALL),
folded AS (SELECT question_id, list_reduce(list_prepend({'used': 0, 'ranks': CAST([] AS INTEGER[])}, list_transform(xs, lambda x: {'used': x.c, 'ranks': [x.r]})),
  lambda s, x: CASE WHEN s.used + x.used <= 600 THEN {'used': s.used + x.used, 'ranks': list_concat(s.ranks, x.ranks)} ELSE s END) AS p FROM costs),
goldctx AS (SELECT question_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM items JOIN folded USING (question_id) WHERE list_contains(p.ranks, CAST(rank AS INTEGER)) GROUP BY ALL)"""


def annotations(spark, sf_dir, gold=None):
    from pyspark.sql import Window

    return (S.qrels(spark, sf_dir) if gold is None else gold).withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id")))


@query("oracle_contexts", S.with_sql("corpus", "questions", "qrels", rest=GOLD_SQL) + " SELECT question_id, sha256(coalesce(context, '')) AS context_hash FROM questions LEFT JOIN goldctx USING (question_id)")
def oracle_contexts(spark, sf_dir):
    rows = N.oracle_contexts("gold_snippets", S.questions(spark, sf_dir), annotations(spark, sf_dir), S.corpus(spark, sf_dir))
    return rows.select("question_id", F.sha2("context", 256).alias("context_hash"))


#: The stand-in provider in SQL: the first sentence of the first block.
ANSWER_SQL = CONTEXT_SQL + r""", q AS (SELECT question_id, type, context, trim(regexp_extract(context, '^\[PMID:\d+\] [^\n]*\n([^\n.!?]*[.!?]?)', 1)) AS said, regexp_extract(context, '^\[PMID:(\d+)\]', 1) AS pmid FROM full_contexts),
answered AS (SELECT question_id, type, CASE WHEN said = '' THEN 'Insufficient evidence in the provided context.' ELSE said END AS ideal, said = '' AS abstained, CAST(pmid <> '' AS INTEGER) AS cited FROM q)"""


def answers(spark, sf_dir):
    return N.answer(S.questions(spark, sf_dir), contexts(spark, sf_dir))


@query("answer", S.with_sql("corpus", "questions", rest=ANSWER_SQL) + " SELECT question_id, type AS predicted_type, ideal AS ideal_answer, abstained, cited AS citation_count, cited AS valid_citations, false AS failed FROM answered")
def answer(spark, sf_dir):
    return answers(spark, sf_dir).select("question_id", F.col("answer.predicted_type").alias("predicted_type"), F.col("answer.ideal_answer").alias("ideal_answer"), F.col("answer.abstained").alias("abstained"), "citation_count", F.size("citations").alias("valid_citations"), "failed")


@query("context_generation", S.with_sql("corpus", "questions", rest=ANSWER_SQL) + " SELECT question_id, type AS predicted_type, ideal AS ideal_answer, abstained, cited AS citation_count, cited AS valid_citations, 1 AS attempts, false AS failed FROM answered")
def context_generation(spark, sf_dir):
    """Answers to prepared contexts through the gateway, with its offline provider and the prompt that names the type."""
    rows = N.context_generation(S.questions(spark, sf_dir), contexts(spark, sf_dir), style="gold_type")
    return rows.select("question_id", F.col("answer.predicted_type").alias("predicted_type"), F.col("answer.ideal_answer").alias("ideal_answer"), F.col("answer.abstained").alias("abstained"), "citation_count", F.size("citations").alias("valid_citations"), "attempts", "failed")


def _rouge_sql(distance: int, single: bool) -> str:
    """ROUGE of the stand-in's answers against the questions' own texts."""
    return "(WITH answers AS (SELECT question_id AS qa_id, ideal AS prediction, question AS reference FROM answered JOIN questions USING (question_id))" + overlap_sql(distance, single).removeprefix(S.with_sql("answers")) + ")"


@query("generation_run", S.with_sql("corpus", "questions", rest=ANSWER_SQL) + f""", su4 AS {_rouge_sql(5, True)}, two AS {_rouge_sql(1, False)}
SELECT count(*) AS questions, CAST(0 AS BIGINT) AS failures, 0.0::DOUBLE AS failure_rate, 0.0::DOUBLE AS retry_rate, 1.0::DOUBLE AS type_accuracy, CASE WHEN sum(cited) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS citation_validity, round(avg(cited), 6) AS citation_coverage,
  round(avg(CAST(abstained AS INTEGER)), 6) AS abstention_rate, (SELECT round(avg(f1), 6) FROM su4) AS mean_rouge_su4, (SELECT round(avg(f1), 6) FROM two) AS mean_rouge2 FROM answered""")
def generation_run(spark, sf_dir):
    """A whole run: contexts, inference that is sealed by writing it, then scores against the questions' own texts."""
    q = S.questions(spark, sf_dir)
    gold = q.select("question_id", "type", F.col("question").alias("reference"))
    return N.generation_run(q, S.corpus(spark, sf_dir), gold, sparse_index(spark, sf_dir, "title_abstract"), style="gold_type").drop("p50_ms", "p95_ms")


RAW = "CASE turn % 5 WHEN 0 THEN 'no object' WHEN 1 THEN 'note {\"predicted_type\":\"summary\",\"ideal_answer\":\"t' || turn || '\",\"citation_pmids\":[\"' || conv_id || '\"],\"abstained\":false} end' WHEN 2 THEN '```json' || chr(10) || '{\"predicted_type\":\"yesno\",\"ideal_answer\":null,\"abstained\":true}' || chr(10) || '```' WHEN 3 THEN '{\"predicted_type\":\"poem\",\"ideal_answer\":\"x\"}' ELSE '{\"predicted_type\":\"list\",\"ideal_answer\":\"x\",\"citation_pmids\":[\"12a\"]}' END"


@query("parse_answer", "SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN 'summary' WHEN 2 THEN 'yesno' WHEN 3 THEN 'poem' WHEN 4 THEN 'list' END AS predicted_type, CASE turn % 5 WHEN 1 THEN 't' || turn WHEN 2 THEN 'Insufficient evidence in the provided context.' WHEN 3 THEN 'x' WHEN 4 THEN 'x' END AS ideal_answer FROM conversations")
def parse_answer(spark, sf_dir):
    rows = S.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(RAW).alias("raw")).withColumn("a", N.parse_answer("raw"))
    return rows.select("conv_id", "turn", F.col("a.predicted_type").alias("predicted_type"), F.col("a.ideal_answer").alias("ideal_answer"))


@query("validate_answer", "SELECT conv_id, turn, turn % 5 IN (1, 2) AS valid FROM conversations")
def validate_answer(spark, sf_dir):
    rows = S.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(RAW).alias("raw")).withColumn("a", N.parse_answer("raw"))
    return rows.select("conv_id", "turn", N.valid_answer("a").alias("valid"))


#: Contexts over the relevant documents in place of those that a search found: the same expressions behind another run.
SECOND_SQL = """(WITH bm25_run AS (SELECT question_id, doc_id, 1.0 AS score, rank FROM (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY doc_id) AS rank FROM (SELECT DISTINCT question_id, doc_id FROM qrels)) WHERE rank <= 10)""" + CONTEXT_SQL.removeprefix(bm25_sql("title_abstract", 10)) + " SELECT question_id, context FROM full_contexts)"
ARMS_SQL = S.with_sql("corpus", "questions", "qrels", rest=GOLD_SQL) + f""", first AS (WITH {CONTEXT_SQL} SELECT question_id, context FROM full_contexts), second AS {SECOND_SQL},
arms AS (SELECT 'L0' AS arm, question_id, '' AS context FROM questions UNION ALL SELECT 'L1', question_id, context FROM first UNION ALL SELECT 'L2', question_id, context FROM second
  UNION ALL SELECT 'L3', question_id, coalesce(context, '') FROM questions LEFT JOIN goldctx USING (question_id))"""


@query("oracle_arms", ARMS_SQL + " SELECT arm, question_id, sha256(context) AS context_hash FROM arms")
def oracle_arms(spark, sf_dir):
    """The four oracle arms of every question."""
    gold = scratch.written(S.qrels(spark, sf_dir), "gold")
    args = (S.questions(spark, sf_dir), S.corpus(spark, sf_dir), gold, annotations(spark, sf_dir, gold), _bm25(spark, sf_dir, "title_abstract", 10))
    return N.oracle_arms(*args).select("arm", "question_id", F.sha2("context", 256).alias("context_hash"))


RUN_SQL = MESH_SQL + """, expanded AS (SELECT question_id, concat_ws(' ', question, added) AS question FROM questions LEFT JOIN added USING (question_id)),
""" + bm25_sql("title_abstract", 100, "SELECT question_id, question FROM expanded") + ",\n" + DENSE_SQL.format(q=PAIRED, k=100) + RRF_SQL.format(k=100) + RERANK_SQL.replace("WHERE rank <= 20", "WHERE rank <= 100")


@query("query_retrieval_run", S.with_sql("corpus", "questions", "qrels", rest=RUN_SQL + ",\n" + METRIC_SQL.format(run="rerank_run", k=10)) + """, h AS (SELECT question_id, count(*) AS found FROM rerank_run JOIN (SELECT DISTINCT question_id, doc_id FROM qrels) USING (question_id, doc_id) GROUP BY ALL), g AS (SELECT question_id, count(DISTINCT doc_id) AS n FROM qrels GROUP BY ALL)
SELECT round(avg(ap), 6) AS map_at_10, round(avg(coalesce(found / n, 0)), 6) AS recall_at_100, count(*) AS questions FROM metrics LEFT JOIN g USING (question_id) LEFT JOIN h USING (question_id)""")
def query_retrieval_run(spark, sf_dir):
    """A whole run: transform, fusion and reranking without gold columns, sealed by writing it, then scoring of what it returned."""
    q, corpus = S.questions(spark, sf_dir), S.corpus(spark, sf_dir)
    sealed = scratch.written(N.query_run(q, corpus, S.vectors(spark, sf_dir), question_vectors(spark, sf_dir), sparse_index(spark, sf_dir, "title_abstract")), "run")
    gold = scratch.written(S.qrels(spark, sf_dir), "gold")
    ten = M.retrieval_metrics(sealed, gold, q, 10).select("question_id", "ap")
    hundred = M.retrieval_metrics(sealed, gold, q, 100).select("question_id", "recall")
    return ten.join(hundred, "question_id").agg(F.round(F.avg("ap"), 6).alias("map_at_10"), F.round(F.avg("recall"), 6).alias("recall_at_100"), F.count(F.lit(1)).alias("questions"))


@query("pricing_rollup", "SELECT coalesce(l_returnflag, 'all') AS l_returnflag, coalesce(l_linestatus, 'all') AS l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def pricing_rollup(spark, sf_dir):
    """Star-schema sanity: pushed filter, pruned columns, one partial and one final aggregate."""
    rows = S.read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    sums = rows.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.coalesce("l_returnflag", F.lit("all")).alias("l_returnflag"), F.coalesce("l_linestatus", F.lit("all")).alias("l_linestatus"), "sum_qty", "revenue", "n")


@query("failure_monitor", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1")
def failure_monitor(spark, sf_dir):
    """The streaming monitor's aggregate over the whole table as a batch (an extension; the reference has no streams)."""
    from ..streaming.monitor import hourly

    return hourly(S.read(spark, sf_dir, "events"))
