"""Registered queries on encoders and the final comparison, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import encoders as E
from ..operators import evidence as V
from ..operators.retrieval import bm25_search, recipe_text
from ..sources import scratch, store
from ..sources import tables as S
from . import generation as N
from . import gateway, guards, judging
from .indexes import sparse_index
from .queries_evaluation import SPLIT_SQL, _splits
from .queries_generation import annotations, contexts
from .queries_retrieval import BM25_RX, RUN, RUN_SQL, bm25_sql
from .runs import final_holm as adjust
from .runs import run_status, tracked

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


@query("dense_index_build", S.with_sql("corpus") + f""", t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{BM25_RX}'), lambda x: lower(x))) AS t FROM corpus),
c AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, count(*) AS filled, CAST(arg_max(slot, n * 100 - slot) AS INTEGER) AS strongest, round(max(n) / sqrt(sum(n * n)), 4) AS top FROM c GROUP BY doc_id""")
def dense_index_build(spark, sf_dir):
    """Unit vectors of hashed tokens, summed up by filled dimensions and the strongest."""
    v = E.hashed_vectors(S.corpus(spark, sf_dir), recipe_text("abstract"))
    top = F.array_max("embedding")
    return v.select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("filled"), (F.array_position("embedding", top) - 1).cast("int").alias("strongest"), F.round(top.cast("double"), 4).alias("top"))


@query("bertscore", """WITH v AS (SELECT vec_id // 40 AS pair, vec_id % 2 = 1 AS predicted, vec_id, embedding FROM embeddings),
m AS (SELECT a.pair, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS d FROM v a JOIN v b ON a.pair = b.pair AND a.predicted AND NOT b.predicted),
p AS (SELECT pair, avg(x) AS p FROM (SELECT pair, a, max(d) AS x FROM m GROUP BY ALL) GROUP BY pair), r AS (SELECT pair, avg(x) AS r FROM (SELECT pair, b, max(d) AS x FROM m GROUP BY ALL) GROUP BY pair)
SELECT pair, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM p JOIN r USING (pair)""")
def bertscore(spark, sf_dir):
    """Greedy matching within pairs of 20 token vectors a side, as of a prediction's tokens against a reference's."""
    side = lambda odd: F.collect_list(F.when(F.col("vec_id") % 2 == odd, F.col("embedding")))
    pairs = S.vectors(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 40).alias("pair")).agg(side(1).alias("p"), side(0).alias("r"))
    return E.greedy_f1(pairs.where("size(p) > 0 AND size(r) > 0"), ["pair"])


@query("final_holm", """WITH t AS (SELECT 'contrast ' || user_id % 3 AS name, avg(CASE WHEN user_id % 10 = 0 THEN 1.0 ELSE 0.0 END) / 5 AS p FROM events GROUP BY 1),
s AS (SELECT name, p, row_number() OVER (ORDER BY p, name) AS r, least(1.0, (3 - row_number() OVER (ORDER BY p, name) + 1) * p) AS x FROM t)
SELECT name, round(p, 6) AS p, round(max(x) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING), 6) AS adjusted, round(max(x) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING), 6) <= 0.05 AS significant FROM s""")
def final_holm(spark, sf_dir):
    """Three made contrasts over all events."""
    name = F.concat(F.lit("contrast "), (F.col("user_id") % 3).cast("string")).alias("name")
    return adjust(S.read(spark, sf_dir, "events").groupBy(name).agg((F.avg(F.when(F.col("user_id") % 10 == 0, 1.0).otherwise(0.0)) / 5).alias("p")))


@query("sort_by_id", "SELECT item_id, text, CAST(row_number() OVER (ORDER BY item_id) AS INTEGER) AS position FROM benchmark")
def sort_by_id(spark, sf_dir):
    rows = S.read(spark, sf_dir, "benchmark").select("item_id", "text")
    return scratch.numbered(rows, [F.col("item_id")], "n").select("item_id", "text", (F.col("n") + 1).cast("int").alias("position"))


@query("selected_ids", SPLIT_SQL + " SELECT question_id FROM splits WHERE population = 'query'")
def selected_ids(spark, sf_dir):
    return guards.selected_ids(_splits(spark, sf_dir), "query")


@query("index_save_load", S.with_sql("corpus", "questions", rest=bm25_sql("title", 5)) + f" {RUN_SQL} bm25_run")
def index_save_load(spark, sf_dir):
    """A search of an index that was saved and loaded again."""
    path = scratch.new_path(spark, "saved")
    store.save_index(sparse_index(spark, sf_dir, "title"), path)
    return bm25_search(store.load_index(spark, path), S.questions(spark, sf_dir), 5).select(*RUN)


@query("jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    """Rows written as JSON Lines and scanned strictly; a null field is left out and comes back as null."""
    path = scratch.new_path(spark, "jsonl")
    store.write_jsonl(S.read(spark, sf_dir, "conversations"), path)
    return store.scan_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("trace_round_trip", """SELECT user_id AS trace_id, '{"event":' || event_id || ',"nested":[{"api_key":"[REDACTED]"}],"kind":"' || event_type || '"}' AS payload
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def trace_round_trip(spark, sf_dir):
    """Traces with a secret at depth, appended and read back in their newest version."""
    path = scratch.new_path(spark, "traces")
    secret = F.array(F.struct(F.col("props").alias("api_key")))
    value = F.to_json(F.struct(F.col("event_id").alias("event"), secret.alias("nested"), F.col("event_type").alias("kind")))
    at = F.timestamp_seconds(F.col("event_id"))
    store.put_traces(S.read(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), at.alias("created_at"), F.lit("p").alias("pipeline_id"), value.alias("payload")), path)
    return store.get_traces(spark, path).select("trace_id", "payload")


@query("json_round_trip", "SELECT coalesce(source, 'none') AS source, count(*) AS documents, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY 1")
def json_round_trip(spark, sf_dir):
    """A summary by source written as one JSON file, in place of an older one, and read again."""
    path = scratch.new_path(spark, "summary.json")
    by = S.read(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    store.write_json(spark, {}, path)
    store.write_json(spark, [r.asDict() for r in by.collect()], path)
    return spark.createDataFrame([(x["source"], x["documents"], x["chars"]) for x in store.read_json(spark, path)], "source string, documents long, chars long")


@query(
    "run_log",
    """WITH m AS (SELECT round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS failure_rate, count(*)::DOUBLE AS n FROM events)
SELECT 'events' AS run_id, 'finished' AS status, metric, value FROM (SELECT 'failure_rate' AS metric, failure_rate AS value FROM m UNION ALL SELECT 'rows', n FROM m)""",
)
def run_log(spark, sf_dir):
    """Metrics of a run over all events, logged while it is under way, with its status."""
    path = scratch.new_path(spark, "runs")
    with tracked(spark, "events", {"sf_dir": sf_dir}, path) as run:
        failed = F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)
        m = S.read(spark, sf_dir, "events").agg(F.round(F.avg(failed), 6).alias("failure_rate"), F.count(F.lit(1)).alias("rows")).first()
        run.log(m.asDict())
    return run_status(spark, path).select("run_id", "status").join(spark.read.parquet(f"{path}/metrics"), "run_id")


@query("gateway_call", S.with_sql("questions") + """ SELECT question_id, '{"words": ' || len(string_split(trim(question), ' ')) || '}' AS raw, 1 AS attempts, turn = 2 AS cached FROM questions, (VALUES (1), (2)) t(turn)""")
def gateway_call(spark, sf_dir):
    """Every question put to a provider that counts its words, twice: the second time all answers come from the cache."""
    prompts = S.questions(spark, sf_dir).select("question_id", F.lit("count").alias("system"), F.trim("question").alias("user"))
    cache = scratch.new_path(spark, "calls")
    counted = lambda system, user, attempt: json.dumps({"words": len(user.split(" "))})
    first, second = (gateway.call(prompts, counted, "counter", cache) for _ in range(2))
    return first.unionByName(second).select("question_id", "raw", "attempts", "cached")


def _judged(spark, sf_dir):
    """Ids, questions with their own text as the reference, answers and contexts for a panel."""
    q = S.questions(spark, sf_dir)
    made = scratch.written(contexts(spark, sf_dir), "contexts")
    said = N.context_generation(q, made).select("question_id", F.col("answer.ideal_answer").alias("answer"))
    return q.select("question_id"), q.select("question_id", "question", F.col("question").alias("reference")), scratch.written(said, "answers"), made


JUDGES = {"words": judging.word_judge, "phrases": judging.phrase_judge}


@query("panel_direct_suite")
def panel_direct_suite(spark, sf_dir):
    """Panel scores of the offline provider's answers by the offline judges, which SQL can't ask."""
    ids, q, said, made = _judged(spark, sf_dir)
    return judging.direct_suite(ids, q, said, made, JUDGES)[0]


@query("panel_pairwise_suite")
def panel_pairwise_suite(spark, sf_dir):
    """Those answers against the references."""
    ids, q, said, made = _judged(spark, sf_dir)
    return judging.pairwise_suite(ids, q, said, q.select("question_id", F.col("reference").alias("answer")), made, JUDGES)[0]


@query("judge_sanity_suite")
def judge_sanity_suite(spark, sf_dir):
    """Controls for the offline judges over the annotated snippets."""
    q = S.questions(spark, sf_dir).select("question_id", "question", F.col("question").alias("reference"))
    found = V.frozen_snippets(annotations(spark, sf_dir), S.corpus(spark, sf_dir))
    return judging.sanity_suite(q, found, JUDGES)[0]
