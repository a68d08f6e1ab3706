"""Registered queries on text functions, sources, retrieval and expansion, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import expansion as X
from ..operators import metrics as M
from ..operators import retrieval as R
from ..sources import tables as S
from .indexes import sparse_index, vector_index

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


BM25_RX = r"[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)*"
WORD_RX = r"[\p{L}\p{N}_]+(?:[-_/][\p{L}\p{N}_]+)*"

#: The text of a corpus row under each recipe, in SQL.
RECIPE_SQL = {
    "title": "title",
    "abstract": "text",
    "title_abstract": "title || ' ' || text",
    "boosted_title_abstract_mesh": "title || ' ' || title || ' ' || text || ' ' || array_to_string(mesh_terms, ' ')",
}


def bm25_sql(recipe: str, k: int, questions: str = "SELECT question_id, question FROM questions") -> str:
    """Expressions that end in ``bm25_run`` (question_id, doc_id, score, rank)."""
    return f"""tokens AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all({RECIPE_SQL[recipe]}, '{BM25_RX}'), lambda x: lower(x)) AS t FROM corpus),
each AS MATERIALIZED (SELECT doc_id, unnest(t) AS t FROM tokens),
tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM each GROUP BY ALL),
lens AS (SELECT doc_id, len(t) AS len FROM tokens),
stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
raw AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, stats),
idf AS (SELECT t, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT question_id, t, count(*) AS qtf FROM (SELECT question_id, lower(unnest(regexp_extract_all(question, '{BM25_RX}'))) AS t FROM ({questions})) GROUP BY ALL),
scored AS (SELECT question_id, tf.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM asked JOIN idf USING (t) JOIN tf USING (t) JOIN lens ON lens.doc_id = tf.doc_id, stats GROUP BY ALL),
bm25_run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k})"""


#: Query vectors: the stated set, or one for each question.
STATED = "SELECT vec_id AS question_id, embedding FROM embeddings WHERE vec_id % 50 = 0"
PAIRED = "SELECT question_id, embedding FROM questions JOIN embeddings ON vec_id = question_id % (SELECT count(*) FROM embeddings)"
DENSE_SQL = """dense_run AS (SELECT * FROM (SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.question_id, d.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 5) AS score
  FROM ({q}) q, embeddings d)) WHERE rank <= {k})"""

METRIC_SQL = """gold AS (SELECT DISTINCT question_id, doc_id FROM qrels),
sizes AS (SELECT question_id, count(*) AS n_gold FROM gold GROUP BY ALL),
hits AS (SELECT question_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS nth FROM {run} JOIN gold USING (question_id, doc_id) WHERE rank <= {k}),
sums AS (SELECT question_id, sum(nth / rank) AS ps, count(*) AS n_hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM hits GROUP BY ALL),
metrics AS (SELECT question_id, round(coalesce(ps / least(n_gold, {k}), 0), 6) AS ap, round(coalesce(n_hits / n_gold, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n_gold, {k}) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, CASE WHEN n_hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit
  FROM questions LEFT JOIN sizes USING (question_id) LEFT JOIN sums USING (question_id))"""

RUN = ["question_id", "doc_id", "score", "rank"]
RUN_SQL = "SELECT question_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM "


def _bm25(spark: SparkSession, sf_dir: str, recipe: str, k: int) -> DataFrame:
    return R.bm25_search(sparse_index(spark, sf_dir, recipe), S.questions(spark, sf_dir), k)


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every vector whose id is divisible by 50."""
    return S.vectors(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every question, its number modulo that of the vectors; the pairing is synthetic."""
    vectors = S.vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("q"))
    n = F.broadcast(vectors.agg(F.count(F.lit(1)).alias("n")))
    return S.questions(spark, sf_dir).join(n, how="cross").select("question_id", (F.col("question_id") % F.col("n")).alias("vec_id")).join(vectors, "vec_id").select("question_id", "q")


# --- sources and text functions


@query("scan_corpus", S.with_sql("corpus") + " SELECT doc_id, pmid, title, url, publication_date, array_to_string(mesh_terms, '|') AS mesh_terms, CAST(length(text) AS INTEGER) AS n_chars FROM corpus")
def scan_corpus(spark, sf_dir):
    return S.corpus(spark, sf_dir).select("doc_id", "pmid", "title", "url", "publication_date", F.array_join("mesh_terms", "|").alias("mesh_terms"), F.length("text").alias("n_chars"))


@query("gold_free_view", S.with_sql("questions", "qrels") + " SELECT question_id, question FROM questions WHERE question_id IN (SELECT question_id FROM qrels)")
def gold_free_view(spark, sf_dir):
    """Only the columns that inference may see, for a population of ids."""
    allowed = S.qrels(spark, sf_dir).select("question_id").distinct()
    return S.questions(spark, sf_dir).join(R.sized(allowed), "question_id", "left_semi").select("question_id", "question")


@query("content_hash", "SELECT conv_id, turn, sha256('=' || conv_id || chr(31) || '=' || turn || chr(31) || '=' || role || chr(31) || coalesce('=' || text, '!')) AS hash FROM conversations")
def content_hash(spark, sf_dir):
    return S.read(spark, sf_dir, "conversations").select("conv_id", "turn", T.content_hash("conv_id", "turn", "role", "text").alias("hash"))


@query("tok_bm25", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{BM25_RX}')) AS INTEGER) AS n, md5(array_to_string(list_transform(regexp_extract_all(text, '{BM25_RX}'), lambda x: lower(x)), ' ')) AS digest FROM documents")
def tok_bm25(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", F.size(T.bm25_tokens("text")).alias("n"), F.md5(F.array_join(T.bm25_tokens("text"), " ")).alias("digest"))


@query("tok_word", rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORD_RX}')) AS INTEGER) AS n FROM documents")
def tok_word(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", F.size(T.word_tokens("text")).alias("n"))


@query("tok_mesh", "SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), ' ') AS tokens FROM benchmark")
def tok_mesh(spark, sf_dir):
    return S.read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.plain_tokens("text"), " ").alias("tokens"))


@query("normalize_question", rf"SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '{WORD_RX}'), lambda x: lower(x)), ' ') AS normalized FROM benchmark")
def normalize_question(spark, sf_dir):
    return S.read(spark, sf_dir, "benchmark").select("item_id", T.normalize("text").alias("normalized"))


@query("normalize_question_exact")
def normalize_question_exact(spark, sf_dir):
    """NFKC and full case folding, which SQL does not have."""
    return S.read(spark, sf_dir, "benchmark").select("item_id", T.casefold_normalize(spark)("text").alias("normalized"))


@query("normalize_answer", S.with_sql("answers") + rf" SELECT qa_id, array_to_string(list_transform(regexp_extract_all(prediction, '{WORD_RX}'), lambda x: lower(x)), ' ') AS normalized FROM answers")
def normalize_answer(spark, sf_dir):
    return S.answers(spark, sf_dir).select("qa_id", T.normalize("prediction").alias("normalized"))


for _recipe in R.RECIPES:
    query(f"doc_text_{_recipe}", S.with_sql("corpus") + f" SELECT doc_id, md5({RECIPE_SQL[_recipe]}) AS digest FROM corpus")(
        lambda spark, sf_dir, recipe=_recipe: S.corpus(spark, sf_dir).select("doc_id", F.md5(R.recipe_text(recipe)).alias("digest"))
    )


@query("clean_query", r"SELECT item_id, nullif(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), '') AS query FROM benchmark")
def clean_query(spark, sf_dir):
    return S.read(spark, sf_dir, "benchmark").select("item_id", T.clean_query("text").alias("query"))


@query("pmid_from_value", S.with_sql("corpus") + " SELECT doc_id, list_last(string_split(rtrim(url, '/'), '/')) AS pmid FROM corpus")
def pmid_from_value(spark, sf_dir):
    return S.corpus(spark, sf_dir).select("doc_id", T.last_segment("url").alias("pmid"))


@query("pmid_end", S.with_sql("corpus") + r" SELECT doc_id, regexp_extract(url, '(\d+)/?$', 1) AS pmid FROM corpus")
def pmid_end(spark, sf_dir):
    return S.corpus(spark, sf_dir).select("doc_id", T.trailing_number("url").alias("pmid"))


@query("pmid_labels", "SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg(turn, ',' ORDER BY first) AS cited FROM (SELECT conv_id, turn, min(rn) AS first FROM (SELECT conv_id, turn % 3 AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY ALL) GROUP BY conv_id")
def pmid_labels(spark, sf_dir):
    """Labels of a made answer that cites each turn's number modulo 3."""
    turns = S.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    answer = turns.select("conv_id", F.array_join(F.transform("t", lambda x: F.format_string("claim [PMID:%d]", x % 3)), " and ").alias("a"))
    return answer.select("conv_id", F.size(T.cited_ids("a")).cast("long").alias("n"), F.array_join(T.cited_ids("a"), ",").alias("cited"))


@query("stable_order", "SELECT item_id, sha256('20260713:' || item_id) AS key FROM benchmark")
def stable_order(spark, sf_dir):
    return S.read(spark, sf_dir, "benchmark").select("item_id", T.stable_order("item_id", 20260713).alias("key"))


@query("json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events")
def json_path(spark, sf_dir):
    return S.read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("value"))


@query("year_parse", S.with_sql("corpus") + " SELECT doc_id, TRY_CAST(substr(publication_date, 1, 4) AS INTEGER) AS year FROM corpus")
def year_parse(spark, sf_dir):
    return S.corpus(spark, sf_dir).select("doc_id", T.year_of("publication_date").alias("year"))


# --- projections and limits


@query("pop_filter", S.with_sql("qrels") + " SELECT doc_id, length(text) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM qrels)")
def pop_filter(spark, sf_dir):
    ids = S.qrels(spark, sf_dir).select("doc_id").distinct()
    return S.read(spark, sf_dir, "documents").join(R.sized(ids), "doc_id", "left_semi").select("doc_id", F.length("text").cast("long").alias("n"))


@query("shard_slice", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 15 OFFSET 10")
def shard_slice(spark, sf_dir, offset: int = 10, limit: int = 15):
    """A shard of the population in the order of ids; offsets and limits must make sense."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative, limit must be positive")
    return S.read(spark, sf_dir, "benchmark").select("item_id", "text").orderBy("item_id").offset(offset).limit(limit)


@query("topk", "SELECT event_type, event_id, value, CAST(rank AS INTEGER) AS rank FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 7")
def topk(spark, sf_dir):
    return R.top_k(S.read(spark, sf_dir, "events").select("event_type", "event_id", "value"), 7, [F.desc("value"), F.asc("event_id")], "event_type")


@query("dedupe_ranked", "SELECT user_id AS question_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, doc_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS rank FROM (SELECT user_id, event_id % 5 AS doc_id, min(event_id) AS first FROM events GROUP BY ALL)) WHERE rank <= 3")
def dedupe_ranked(spark, sf_dir):
    run = S.read(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), (F.col("event_id") % 5).alias("doc_id"), F.col("event_id").alias("rank"))
    return R.dedupe_ranked(run, 3)


# --- expansion

VOCAB_SQL = """terms AS (SELECT trim(unnest(mesh_terms)) AS term FROM corpus),
counts AS (SELECT term, count(*) AS n, array_to_string(list_transform(regexp_extract_all(term, '[A-Za-z0-9]+'), lambda x: lower(x)), ' ') AS key FROM terms WHERE term <> '' GROUP BY term),
vocab AS (SELECT key, term, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, term) AS r FROM counts WHERE key <> '') WHERE r = 1)"""


@query("mesh_vocab", S.with_sql("corpus", rest=VOCAB_SQL) + " SELECT key, term, n FROM vocab")
def mesh_vocab(spark, sf_dir):
    return X.term_vocabulary(S.corpus(spark, sf_dir))


#: Expressions that end in ``added`` (question_id, added).
MESH_SQL = VOCAB_SQL + """, words AS (SELECT question_id, question, list_transform(regexp_extract_all(question, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM questions),
grams AS (SELECT DISTINCT question_id, array_to_string(w[i:i + n - 1], ' ') AS key FROM words, range(1, 9) s(n), range(1, 20000) p(i) WHERE i + n - 1 <= len(w)),
best AS (SELECT * FROM (SELECT question_id, term, row_number() OVER (PARTITION BY question_id ORDER BY len(string_split(key, ' ')) DESC, n DESC, key) AS r FROM grams JOIN vocab USING (key)) WHERE r <= 3),
added AS (SELECT question_id, string_agg(term, ' ' ORDER BY r) AS added FROM best GROUP BY ALL)"""


@query("mesh_expand", S.with_sql("corpus", "questions", rest=MESH_SQL) + " SELECT question_id, concat_ws(' ', question, added) AS query FROM questions LEFT JOIN added USING (question_id)")
def mesh_expand(spark, sf_dir):
    return X.expand(S.questions(spark, sf_dir), X.term_vocabulary(S.corpus(spark, sf_dir)))


@query("hyde_expand", S.with_sql("questions") + " SELECT question_id, concat_ws(' ', question, 'A study of ' || question) AS query, CAST(length(question) AS INTEGER) AS input_tokens, 16 AS output_tokens FROM questions")
def hyde_expand(spark, sf_dir):
    """With a stand-in generator; a hit of its cache carries the first call's cost."""
    q = S.questions(spark, sf_dir)
    generated = q.select("question_id", F.concat(F.lit("A study of "), F.col("question")).alias("ideal_answer"), F.length("question").alias("input_tokens"), F.lit(16).alias("output_tokens"))
    return X.hypothetical_expand(q, generated)


@query(
    "two_round_expand",
    S.with_sql("corpus", "questions", rest=bm25_sql("title_abstract", 5))
    + """, seed AS (SELECT question_id, title || ': ' || substr(text, 1, 500) AS excerpt FROM bm25_run JOIN corpus USING (doc_id)),
tok AS (SELECT question_id, unnest(list_distinct(list_transform(regexp_extract_all(excerpt, '[A-Za-z0-9]+'), lambda x: lower(x)))) AS t FROM seed),
qtok AS (SELECT question_id, unnest(list_distinct(list_transform(regexp_extract_all(question, '[A-Za-z0-9]+'), lambda x: lower(x)))) AS t FROM questions),
cnt AS (SELECT question_id, t, count(*) AS n FROM tok WHERE length(t) > 3 AND (question_id, t) NOT IN (SELECT question_id, t FROM qtok) GROUP BY ALL),
best AS (SELECT * FROM (SELECT question_id, t, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, t) AS r FROM cnt) WHERE r <= 3),
added AS (SELECT question_id, string_agg(t, ' ' ORDER BY r) AS added FROM best GROUP BY ALL)
SELECT question_id, concat_ws(' ', question, added) AS query FROM questions LEFT JOIN added USING (question_id)""",
)
def two_round_expand(spark, sf_dir):
    corpus = S.corpus(spark, sf_dir)
    seeds = _bm25(spark, sf_dir, "title_abstract", 5)
    return X.two_round_expand(S.questions(spark, sf_dir), seeds, corpus)


# --- retrieval


@query("bm25_index", S.with_sql("corpus", "questions", rest=bm25_sql("title_abstract", 10)) + " SELECT t, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM df JOIN idf USING (t)")
def bm25_index(spark, sf_dir):
    return sparse_index(spark, sf_dir, "title_abstract").vocabulary.select("t", "df", F.round("idf", 6).alias("idf"))


for _recipe in R.RECIPES:
    query(f"bm25_search_{_recipe}", S.with_sql("corpus", "questions", rest=bm25_sql(_recipe, 10)) + f" {RUN_SQL} bm25_run")(lambda spark, sf_dir, recipe=_recipe: _bm25(spark, sf_dir, recipe, 10).select(*RUN))


@query(
    "sparse_adapter",
    S.with_sql("corpus", "questions", rest=bm25_sql("title", 20))
    + """, spare AS (SELECT question_id, doc_id, 0.0::DOUBLE AS score FROM questions, (SELECT doc_id FROM corpus ORDER BY doc_id LIMIT 40) WHERE (question_id, doc_id) NOT IN (SELECT question_id, doc_id FROM bm25_run)),
filled AS (SELECT question_id, doc_id, score FROM bm25_run UNION ALL SELECT * FROM spare)
SELECT question_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM filled) WHERE rank <= 20""",
)
def sparse_adapter(spark, sf_dir):
    """Always ``k`` rows: unmatched documents of score 0 fill up."""
    corpus, q = S.corpus(spark, sf_dir), S.questions(spark, sf_dir)
    return R.fill_run(_bm25(spark, sf_dir, "title", 20), q, corpus, 20).select(*RUN)


@query("dense_encode", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings")
def dense_encode(spark, sf_dir):
    """Norms of the stored vectors, which an encoder would have brought to unit length."""
    return S.vectors(spark, sf_dir).select("vec_id", F.round(F.sqrt(R.dot("embedding", "embedding")), 4).alias("norm"))


@query("dense_search", "WITH " + DENSE_SQL.format(q=STATED, k=10) + f" {RUN_SQL} dense_run")
def dense_search(spark, sf_dir):
    return R.dense_search(_vector_queries(spark, sf_dir), S.vectors(spark, sf_dir), 10, lambda: vector_index(spark, sf_dir)).select(*RUN)


@query("dense_search_many", "WITH " + DENSE_SQL.format(q=STATED, k=100) + " SELECT question_id, count(*) AS n, max(score) AS best, min(score) AS worst FROM dense_run GROUP BY ALL")
def dense_search_many(spark, sf_dir):
    """Through the cells, as when there are too many products for one pass."""
    run = R.dense_search(_vector_queries(spark, sf_dir), vector_index(spark, sf_dir), 100)
    return run.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min("score").alias("worst"))


RRF_SQL = """,
rrf AS (SELECT question_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT question_id, doc_id, rank FROM bm25_run UNION ALL SELECT question_id, doc_id, rank FROM dense_run) GROUP BY ALL),
rrf_run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM rrf) WHERE rank <= {k})"""
HYBRID_SQL = bm25_sql("title_abstract", 100) + ",\n" + DENSE_SQL.format(q=PAIRED, k=100) + RRF_SQL.format(k=50)


def _hybrid(spark, sf_dir):
    sparse = _bm25(spark, sf_dir, "title_abstract", 100)
    return R.rrf([sparse, R.dense_search(question_vectors(spark, sf_dir), S.vectors(spark, sf_dir), 100, lambda: vector_index(spark, sf_dir))], 50)


@query("rrf", S.with_sql("corpus", "questions", rest=HYBRID_SQL) + f" {RUN_SQL} rrf_run")
def rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir).select(*RUN)


RERANK_SQL = rf""", cand AS (SELECT question_id, r.doc_id, r.rank AS old,
    list_distinct(list_transform(regexp_extract_all(question, '{BM25_RX}'), lambda x: lower(x))) AS q,
    list_transform(regexp_extract_all(title || ' ' || text, '{BM25_RX}'), lambda x: lower(x)) AS d
  FROM rrf_run r JOIN questions USING (question_id) JOIN corpus USING (doc_id)),
rescored AS (SELECT question_id, doc_id, old, round(len(list_intersect(q, d)) / greatest(len(q), 1), 6) AS score FROM cand),
rerank_run AS (SELECT * FROM (SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, old) AS rank FROM rescored) WHERE rank <= 20)"""


@query("rerank", S.with_sql("corpus", "questions", rest=HYBRID_SQL + RERANK_SQL) + f" {RUN_SQL} rerank_run")
def rerank(spark, sf_dir):
    return R.rerank_indexed(_hybrid(spark, sf_dir), S.questions(spark, sf_dir), S.corpus(spark, sf_dir), sparse_index(spark, sf_dir, "title_abstract"), 20).select(*RUN)


@query("retriever_dispatch", S.with_sql("corpus", "questions", rest=bm25_sql("title_abstract", 20)) + f", v AS (SELECT 1), " + DENSE_SQL.format(q=PAIRED, k=20) + " SELECT 'bm25' AS method, count(*) AS n FROM bm25_run UNION ALL SELECT 'dense', count(*) FROM dense_run")
def retriever_dispatch(spark, sf_dir):
    args = (S.questions(spark, sf_dir), S.corpus(spark, sf_dir), S.vectors(spark, sf_dir), question_vectors(spark, sf_dir), 20)
    index = sparse_index(spark, sf_dir, "title_abstract")
    one = lambda m: R.retrieve(m, *args, index=index).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("method"), "n")
    return one("bm25").unionByName(one("dense"))


@query("subset_run", S.with_sql("corpus", "questions", rest=bm25_sql("title", 10)) + f" {RUN_SQL} bm25_run WHERE question_id % 3 = 0")
def subset_run(spark, sf_dir):
    """The run of one third of the questions, taken from that of all."""
    q = S.questions(spark, sf_dir)
    run = _bm25(spark, sf_dir, "title", 10)
    population = run.select("question_id").distinct().where("question_id % 3 = 0")
    return R.subset_run(run, population).select(*RUN)


@query("gold_doc_oracle", S.with_sql("qrels") + " SELECT question_id, doc_id, 1.0::DOUBLE AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY doc_id) AS rank FROM (SELECT DISTINCT question_id, doc_id FROM qrels)) WHERE rank <= 10")
def gold_doc_oracle(spark, sf_dir):
    return R.gold_run(S.qrels(spark, sf_dir)).select(*RUN)


# --- retrieval metrics

_METRICS = S.with_sql("corpus", "questions", "qrels", rest=bm25_sql("title_abstract", 100) + ",\n" + METRIC_SQL.format(run="bm25_run", k=10))


@query("retrieval_metrics", _METRICS + " SELECT question_id, ap, recall, mrr, ndcg, hit FROM metrics")
def retrieval_metrics(spark, sf_dir):
    return M.retrieval_metrics(_bm25(spark, sf_dir, "title_abstract", 10), S.qrels(spark, sf_dir), S.questions(spark, sf_dir))


@query("macro_means", _METRICS + " SELECT round(avg(ap), 6) AS mean_ap, round(avg(recall), 6) AS mean_recall, round(avg(mrr), 6) AS mean_mrr, round(avg(ndcg), 6) AS mean_ndcg, round(avg(hit), 6) AS mean_hit, count(*) AS questions FROM metrics")
def macro_means(spark, sf_dir):
    return M.macro_means(retrieval_metrics(spark, sf_dir), ["ap", "recall", "mrr", "ndcg", "hit"])
