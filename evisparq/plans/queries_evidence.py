"""Registered queries on evidence, packing, citations and answer metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as V
from ..operators import metrics as M
from ..operators import retrieval as R
from ..sources import scratch
from ..sources import tables as S
from .queries_retrieval import BM25_RX, WORD_RX, _bm25, bm25_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def spans_sql(docs: str, size: int = 3) -> str:
    """Expressions that end in ``spans`` (doc_id, s, b, e) and ``windows`` (doc_id, s, b, e, snippet) of ``docs`` (doc_id, text)."""
    return rf"""pieces AS (SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s+)([A-Z0-9])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), chr(1)) AS parts FROM {docs})),
placed AS (SELECT doc_id, i, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM pieces),
real_spans AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s, o + length(piece) - length(ltrim(piece, {WS})) AS b, o + length(rtrim(piece, {WS})) AS e
  FROM placed WHERE i % 2 = 1 AND trim(piece, {WS}) <> ''),
spans AS (SELECT * FROM real_spans UNION ALL SELECT doc_id, 1, 0, length(text) FROM {docs} WHERE doc_id NOT IN (SELECT doc_id FROM real_spans)),
windows AS (SELECT w.doc_id, s, CAST(b AS INTEGER) AS b, CAST(w.e AS INTEGER) AS e, substr(text, CAST(b AS INTEGER) + 1, CAST(w.e - b AS INTEGER)) AS snippet
  FROM (SELECT doc_id, s, b, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS e FROM spans) w JOIN {docs} d USING (doc_id))"""


TOK = rf"list_transform(regexp_extract_all({{x}}, '{BM25_RX}'), lambda x: lower(x))"


@query("sentence_spans", S.with_sql("corpus", rest=spans_sql("corpus")) + " SELECT doc_id, CAST(s AS INTEGER) AS sentence, CAST(b AS INTEGER) AS \"begin\", CAST(e AS INTEGER) AS \"end\" FROM spans")
def sentence_spans(spark, sf_dir):
    return V.sentence_spans(S.corpus(spark, sf_dir))


@query("sentence_windows", S.with_sql("corpus", rest=spans_sql("corpus")) + ' SELECT doc_id, CAST(s AS INTEGER) AS sentence, b AS "begin", e AS "end", md5(snippet) AS digest FROM windows')
def sentence_windows(spark, sf_dir):
    return V.sentence_windows(S.corpus(spark, sf_dir)).select("doc_id", "sentence", "begin", "end", F.md5("snippet").alias("digest"))


@query("chunk_documents", S.with_sql("corpus", rest=spans_sql("corpus", 5)) + ' SELECT doc_id, CAST(s AS INTEGER) AS sentence, b AS "begin", e AS "end" FROM windows')
def chunk_documents(spark, sf_dir):
    return V.sentence_windows(S.corpus(spark, sf_dir), 5).select("doc_id", "sentence", "begin", "end")


@query(
    "fixed_token_chunks",
    S.with_sql("corpus")
    + r""", units AS (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|\s+|[^\s\p{L}\p{N}_]') AS u FROM corpus)),
placed AS (SELECT doc_id, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS o FROM units),
toks AS (SELECT doc_id, x, o, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS k FROM placed WHERE NOT regexp_full_match(x, '\s+')),
sizes AS (SELECT doc_id, count(*) AS n FROM toks GROUP BY ALL),
starts AS (SELECT doc_id, n, c FROM sizes, range(0, 100000) r(c) WHERE c * 192 < n AND (c = 0 OR c * 192 - 192 + 256 < n))
SELECT doc_id, CAST(c AS INTEGER) AS chunk, CAST(min(o) AS INTEGER) AS "begin", CAST(max(o + length(x)) AS INTEGER) AS "end"
FROM starts JOIN toks USING (doc_id) WHERE k >= c * 192 AND k < c * 192 + 256 GROUP BY ALL""",
)
def fixed_token_chunks(spark, sf_dir):
    return V.fixed_chunks(S.corpus(spark, sf_dir)).select("doc_id", "chunk", "begin", "end")


#: The documents that a run retrieved, with their windows.
POOL_SQL = bm25_sql("title_abstract", 10) + ",\nhits AS (SELECT DISTINCT doc_id, title, text FROM corpus WHERE doc_id IN (SELECT doc_id FROM bm25_run)),\n" + spans_sql("hits") + """,
pool AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY section DESC, doc_rank, s) AS ordinal FROM (
  SELECT question_id, r.doc_id, rank AS doc_rank, 'title' AS section, 0 AS s, 0 AS b, length(title) AS e, title AS snippet FROM bm25_run r JOIN hits USING (doc_id)
  UNION ALL SELECT question_id, r.doc_id, rank, 'abstract', s, b, e, snippet FROM bm25_run r JOIN windows USING (doc_id)))"""


def _pool(spark, sf_dir):
    return V.candidates(scratch.written(_bm25(spark, sf_dir, "title_abstract", 10), "run"), S.corpus(spark, sf_dir))


@query("snippet_candidates", S.with_sql("corpus", "questions", rest=POOL_SQL) + ' SELECT question_id, doc_id, section, CAST(ordinal AS INTEGER) AS ordinal, CAST(b AS INTEGER) AS "begin", CAST(e AS INTEGER) AS "end", md5(snippet) AS digest FROM pool')
def snippet_candidates(spark, sf_dir):
    return _pool(spark, sf_dir).select("question_id", "doc_id", "section", "ordinal", "begin", "end", F.md5("snippet").alias("digest"))


LEXICAL_SQL = POOL_SQL + f""",
lex AS (SELECT question_id, p.doc_id, s, b, e, snippet, round(len(list_intersect(list_distinct({TOK.format(x="question")}), {TOK.format(x="snippet")})) / greatest(len(list_distinct({TOK.format(x="question")})), 1) + 0.01 / doc_rank, 6) AS score
  FROM pool p JOIN questions USING (question_id) WHERE section = 'abstract'),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CAST(doc_id AS VARCHAR), snippet, s) AS rank FROM lex) WHERE rank <= 20)"""


def _lexical(spark, sf_dir):
    return V.rank_lexical(scratch.written(_bm25(spark, sf_dir, "title_abstract", 10), "run"), S.questions(spark, sf_dir), S.corpus(spark, sf_dir))


@query("rank_lexical", S.with_sql("corpus", "questions", rest=LEXICAL_SQL) + ' SELECT question_id, doc_id, CAST(b AS INTEGER) AS "begin", CAST(e AS INTEGER) AS "end", score, CAST(rank AS INTEGER) AS rank FROM ranked')
def rank_lexical(spark, sf_dir):
    return _lexical(spark, sf_dir).select("question_id", "doc_id", "begin", "end", "score", "rank")


LOCAL_SQL = POOL_SQL + f""",
ptok AS (SELECT question_id, ordinal, CASE WHEN len(t) > 0 THEN t ELSE ['__empty__'] END AS t FROM (SELECT question_id, ordinal, {TOK.format(x="snippet")} AS t FROM pool)),
pstat AS (SELECT question_id, count(*) AS n, avg(len(t)) AS al FROM ptok GROUP BY ALL),
ptf AS (SELECT question_id, ordinal, t, count(*) AS tf, any_value(l) AS l FROM (SELECT question_id, ordinal, len(t) AS l, unnest(t) AS t FROM ptok) GROUP BY ALL),
pdf AS (SELECT question_id, t, count(*) AS df FROM ptf GROUP BY ALL),
praw AS (SELECT question_id, t, al, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM pdf JOIN pstat USING (question_id)),
pidf AS (SELECT question_id, t, al, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY question_id) ELSE raw END AS idf FROM praw),
pscore AS (SELECT question_id, ordinal, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))) AS score FROM ptf JOIN pidf USING (question_id, t) JOIN asked USING (question_id, t) GROUP BY ALL),
local AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_rank, ordinal) AS rank FROM (
  SELECT pool.*, round(coalesce(score, 0), 6)::DOUBLE AS score FROM pool LEFT JOIN pscore USING (question_id, ordinal))) WHERE rank <= 20)"""


@query("rank_bm25_local", S.with_sql("corpus", "questions", rest=LOCAL_SQL) + " SELECT question_id, doc_id, section, CAST(ordinal AS INTEGER) AS ordinal, score, CAST(rank AS INTEGER) AS rank FROM local")
def rank_bm25_local(spark, sf_dir):
    return V.rank_bm25_local(_pool(spark, sf_dir), S.questions(spark, sf_dir)).select("question_id", "doc_id", "section", "ordinal", "score", "rank")


@query("rank_xenc", S.with_sql("corpus", "questions", rest=POOL_SQL) + f""", x AS (SELECT question_id, ordinal, round(len(list_intersect(list_distinct({TOK.format(x="question")}), {TOK.format(x="snippet")})) / greatest(len(list_distinct({TOK.format(x="question")})), 1), 6) AS score FROM pool JOIN questions USING (question_id))
SELECT question_id, CAST(ordinal AS INTEGER) AS ordinal, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ordinal) AS rank FROM x) WHERE rank <= 20""")
def rank_xenc(spark, sf_dir):
    """The pair scorer's stand-in over the pool; results are mapped back by the candidate's number."""
    rows = _pool(spark, sf_dir).join(R.sized(S.questions(spark, sf_dir)), "question_id")
    scored = rows.select("question_id", "ordinal", R.lexical_score("question", F.col("snippet")).alias("score"))
    return R.top_k(scored, 20, [F.desc("score"), F.asc("ordinal")]).select("question_id", "ordinal", "score", "rank")


@query("rank_fixed256", S.with_sql("corpus", "questions", rest=bm25_sql("title", 3)) + r""", w AS (SELECT question_id, doc_id, rank, len(list_intersect(list_distinct(string_split(lower(question), ' ')), string_split(lower(text), ' '))) AS overlap FROM bm25_run JOIN questions USING (question_id) JOIN corpus USING (doc_id))
SELECT question_id, doc_id, CAST(overlap AS INTEGER) AS overlap, CAST(row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, rank) AS INTEGER) AS place FROM w""")
def rank_fixed256(spark, sf_dir):
    """White-space token overlap, stable on ties."""
    from pyspark.sql import Window

    run = R.beside(_bm25(spark, sf_dir, "title", 3).join(S.questions(spark, sf_dir), "question_id"), S.corpus(spark, sf_dir).select("doc_id", "text"))
    shared = F.size(F.array_intersect(F.split(F.lower("question"), " "), F.split(F.lower("text"), " ")))
    rows = run.select("question_id", "doc_id", "rank", shared.alias("overlap"))
    return rows.select("question_id", "doc_id", "overlap", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("overlap"), "rank")).alias("place"))


@query("full_document_fields", S.with_sql("corpus", "questions", rest=bm25_sql("title", 10)) + """, f AS (SELECT question_id, doc_id, rank, unnest([1, 2]) AS field, unnest([title, text]) AS snippet FROM bm25_run JOIN corpus USING (doc_id))
SELECT question_id, doc_id, CAST(field AS INTEGER) AS field, md5(snippet) AS digest, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank, field) AS INTEGER) AS place FROM f""")
def full_document_fields(spark, sf_dir):
    from pyspark.sql import Window

    run = R.beside(_bm25(spark, sf_dir, "title", 10), S.corpus(spark, sf_dir).select("doc_id", "title", "text"))
    rows = run.select("question_id", "doc_id", "rank", F.posexplode(F.array("title", "text")).alias("i", "snippet"))
    return rows.select("question_id", "doc_id", (F.col("i") + 1).alias("field"), F.md5("snippet").alias("digest"), F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "i")).alias("place"))


@query("full_abstract", S.with_sql("corpus", "questions", rest=bm25_sql("title_abstract", 5)) + " SELECT question_id, doc_id, CAST(rank AS INTEGER) AS rank, md5(text) AS digest FROM bm25_run JOIN corpus USING (doc_id)")
def full_abstract(spark, sf_dir):
    run = R.beside(_bm25(spark, sf_dir, "title_abstract", 5), S.corpus(spark, sf_dir).select("doc_id", "text"))
    return run.select("question_id", "doc_id", "rank", F.md5("text").alias("digest"))


@query("doc_cap", S.with_sql("corpus", "questions", rest=bm25_sql("title_abstract", 25)) + " SELECT question_id, doc_id, CAST(rank AS INTEGER) AS rank FROM bm25_run WHERE rank <= 10")
def doc_cap(spark, sf_dir):
    return _bm25(spark, sf_dir, "title_abstract", 25).where(F.col("rank") <= V.EVIDENCE_DOCUMENTS).select("question_id", "doc_id", "rank")


DIVERSE_SQL = LEXICAL_SQL + """,
diverse AS (SELECT question_id, doc_id, b, e, snippet, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank) AS nth FROM ranked) WHERE nth <= 1)"""


@query("source_diverse", S.with_sql("corpus", "questions", rest=DIVERSE_SQL) + ' SELECT question_id, doc_id, b AS "begin", CAST(rank AS INTEGER) AS rank FROM diverse')
def source_diverse(spark, sf_dir):
    return V.source_diverse(_lexical(spark, sf_dir)).select("question_id", "doc_id", "begin", "rank")


PACK_SQL = LEXICAL_SQL + r""",
items AS (SELECT question_id, doc_id, rank, '[PMID:' || doc_id || '] ' || title || chr(10) || snippet AS block, b, e FROM ranked JOIN (SELECT doc_id, title FROM hits) USING (doc_id)),
costs AS (SELECT question_id, list({'r': CAST(rank AS INTEGER), 'c': CAST(len(regexp_extract_all(block, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS INTEGER)} ORDER BY rank) AS xs FROM items GROUP BY ALL),
folded AS (SELECT question_id, list_reduce(list_prepend({'used': 0, 'ranks': CAST([] AS INTEGER[])}, list_transform(xs, lambda x: {'used': x.c, 'ranks': [x.r]})),
  lambda s, x: CASE WHEN s.used + x.used <= 600 THEN {'used': s.used + x.used, 'ranks': list_concat(s.ranks, x.ranks)} ELSE s END) AS p FROM costs),
packed AS (SELECT question_id, p.used AS used, p.ranks AS ranks FROM folded),
contexts AS (SELECT question_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, list(doc_id ORDER BY rank) AS docs FROM items JOIN packed USING (question_id) WHERE list_contains(ranks, CAST(rank AS INTEGER)) GROUP BY ALL)"""


def packed_items(spark, sf_dir):
    return R.beside(_lexical(spark, sf_dir), S.corpus(spark, sf_dir).select("doc_id", "pmid", "title"))


@query("pack_context", S.with_sql("corpus", "questions", rest=PACK_SQL) + " SELECT question_id, array_to_string(ranks, ',') AS ranks, CAST(used AS INTEGER) AS used FROM packed")
def pack_context(spark, sf_dir):
    packed = V.pack(packed_items(spark, sf_dir), 600)
    return packed.select("question_id", F.array_join(F.transform("ranks", lambda x: x.cast("string")), ",").alias("ranks"), "used")


@query("serialize_context", S.with_sql("corpus", "questions", rest=PACK_SQL) + " SELECT question_id, context, sha256(context) AS hash FROM contexts")
def serialize_context(spark, sf_dir):
    return V.pack(packed_items(spark, sf_dir), 600).select("question_id", "context", F.sha2("context", 256).alias("hash"))


@query("strongest_middle", S.with_sql("corpus", "questions", rest=PACK_SQL) + """, m AS (SELECT question_id, ranks, len(ranks) AS n, CAST(floor((len(ranks) - 1) / 2) AS INTEGER) AS h FROM packed)
SELECT question_id, array_to_string(CASE WHEN n < 3 THEN ranks ELSE list_concat(list_concat(ranks[2:h + 1], ranks[1:1]), ranks[h + 2:]) END, ',') AS ranks FROM m""")
def strongest_middle(spark, sf_dir):
    packed = V.pack(packed_items(spark, sf_dir), 600).select("question_id", V.strongest_middle("ranks").alias("ranks"))
    return packed.select("question_id", F.array_join(F.transform("ranks", lambda x: x.cast("string")), ",").alias("ranks"))


@query("frozen_snippets", S.with_sql("corpus", "qrels") + """, a AS (SELECT question_id, doc_id, "begin", "end", row_number() OVER (PARTITION BY question_id ORDER BY doc_id) AS position, count(*) OVER (PARTITION BY question_id) AS n FROM qrels)
SELECT question_id, doc_id, CAST(position AS INTEGER) AS position, md5(substr(text, "begin" + 1, "end" - "begin")) AS digest, CAST(n - position + 1 AS DOUBLE) AS score FROM a JOIN corpus USING (doc_id)""")
def frozen_snippets(spark, sf_dir):
    from pyspark.sql import Window

    annotations = S.qrels(spark, sf_dir).withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id")))
    return V.frozen_snippets(annotations, S.corpus(spark, sf_dir)).select("question_id", "doc_id", "position", F.md5("snippet").alias("digest"), "score")


CITE_SQL = PACK_SQL + """,
said AS (SELECT question_id, list_distinct([CAST(docs[1] AS VARCHAR), '999999999', CAST(question_id AS VARCHAR)]) AS cited, list_transform(docs, lambda x: CAST(x AS VARCHAR)) AS docs FROM contexts)"""


def cited_answers(spark, sf_dir):
    """A made answer that cites the first packed document, a document that doesn't exist and the question's own number."""
    packed = V.pack(packed_items(spark, sf_dir), 600)
    text = F.concat(F.lit("[PMID:"), F.get(T.cited_ids("context"), F.lit(0)), F.lit("] [PMID:999999999] [PMID:"), F.col("question_id").cast("string"), F.lit("]"))
    return packed.select("question_id", T.cited_ids("context").alias("evidence"), T.cited_ids(text).alias("cited"))


@query("citation_whitelist", S.with_sql("corpus", "questions", rest=CITE_SQL) + " SELECT question_id, CAST(len(cited) AS INTEGER) AS cited, CAST(len(list_intersect(cited, docs)) AS INTEGER) AS valid FROM said")
def citation_whitelist(spark, sf_dir):
    return cited_answers(spark, sf_dir).select("question_id", F.size("cited").alias("cited"), F.size(F.array_intersect("cited", "evidence")).alias("valid"))


@query("citations_from_answer", S.with_sql("corpus", "questions", rest=CITE_SQL) + ", c AS (SELECT question_id, docs, unnest(cited) AS pmid FROM said) SELECT question_id, pmid FROM c WHERE list_contains(docs, pmid)")
def citations_from_answer(spark, sf_dir):
    return cited_answers(spark, sf_dir).select("question_id", F.explode(F.array_intersect("cited", "evidence")).alias("pmid"))


# --- answer metrics


def overlap_sql(distance: int, single: bool) -> str:
    pairs = f"SELECT qa_id, side, a.t || ' ' || b.t AS u FROM tok a JOIN tok b USING (qa_id, side) WHERE b.i > a.i AND b.i <= a.i + {distance}"
    return S.with_sql("answers") + rf""", base AS (SELECT qa_id, 'p' AS side, prediction AS x FROM answers UNION ALL SELECT qa_id, 'r', reference FROM answers),
tok AS (SELECT qa_id, side, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (SELECT qa_id, side, list_transform(regexp_extract_all(x, '{WORD_RX}'), lambda x: lower(x)) AS t FROM base)),
units AS ({"SELECT qa_id, side, t AS u FROM tok UNION ALL " if single else ""}{pairs}),
cnt AS (SELECT qa_id, u, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM units GROUP BY ALL),
s AS (SELECT qa_id, sum(least(p, r)) AS o, sum(p) AS np, sum(r) AS nr FROM cnt GROUP BY ALL),
pr AS (SELECT a.qa_id, CASE WHEN np > 0 THEN o / np ELSE 0 END::DOUBLE AS p, CASE WHEN nr > 0 THEN o / nr ELSE 0 END::DOUBLE AS r FROM answers a LEFT JOIN s USING (qa_id))
SELECT qa_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1 FROM pr"""


@query("rouge_su4", overlap_sql(5, True))
def rouge_su4(spark, sf_dir):
    return M.overlap_f1(S.answers(spark, sf_dir), "qa_id")


@query("rouge2", overlap_sql(1, False))
def rouge2(spark, sf_dir):
    """Without stemming."""
    return M.overlap_f1(S.answers(spark, sf_dir), "qa_id", 1, False)


@query("rouge2_stemmed")
def rouge2_stemmed(spark, sf_dir):
    """ROUGE-2 over Porter stems, which SQL does not have."""
    return M.overlap_f1(S.answers(spark, sf_dir), "qa_id", 1, False, stemmed=True)


SPAN_SQL = S.with_sql("corpus", "questions", "qrels", rest=LEXICAL_SQL) + """,
pc AS (SELECT DISTINCT question_id, doc_id, unnest(range(b, e)) AS o FROM ranked),
gc AS (SELECT DISTINCT question_id, doc_id, unnest(range("begin", "end")) AS o FROM qrels),
np AS (SELECT question_id, count(*) AS np FROM pc GROUP BY ALL), nr AS (SELECT question_id, count(*) AS nr FROM gc GROUP BY ALL),
ov AS (SELECT question_id, count(*) AS o FROM pc JOIN gc USING (question_id, doc_id, o) GROUP BY ALL),
pr AS (SELECT question_id, coalesce(o / np, 0)::DOUBLE AS p, coalesce(o / nr, 0)::DOUBLE AS r FROM questions LEFT JOIN np USING (question_id) LEFT JOIN nr USING (question_id) LEFT JOIN ov USING (question_id)),
spanf AS (SELECT question_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1 FROM pr)"""


def span_scores(ranked, gold, questions):
    """Precision, recall and F1 of ranked spans against judged ones."""
    url = F.concat(F.lit("https://example.org/doc/"), F.col("doc_id").cast("string"), F.lit("/")).alias("document")
    columns = ["question_id", url, F.lit("Abstract").alias("section"), "begin", "end"]
    return M.span_f1(ranked.select(*columns), gold.select(*columns), questions)


@query("snippet_span_f1", SPAN_SQL + " SELECT question_id, precision, recall, f1 FROM spanf")
def snippet_span_f1(spark, sf_dir):
    return span_scores(_lexical(spark, sf_dir), S.qrels(spark, sf_dir), S.questions(spark, sf_dir))


@query("gold_pmid_recall", S.with_sql("corpus", "questions", "qrels", rest=PACK_SQL) + """, g AS (SELECT question_id, list(DISTINCT doc_id) AS gold FROM qrels GROUP BY ALL)
SELECT question_id, round(len(list_intersect(gold, docs)) / len(gold), 6) AS packed_recall FROM g JOIN contexts USING (question_id)""")
def gold_pmid_recall(spark, sf_dir):
    gold = S.qrels(spark, sf_dir).groupBy("question_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("gold"))
    packed = V.pack(packed_items(spark, sf_dir), 600).select("question_id", T.cited_ids("context").alias("docs"))
    return gold.join(packed, "question_id").select("question_id", F.round(F.size(F.array_intersect("gold", "docs")) / F.size("gold"), 6).alias("packed_recall"))


@query("exact_answer", S.with_sql("questions") + r""", n AS (SELECT question_id, type, list_transform(list_transform(string_split(question, ' ')[1:6], lambda w: w || '!'), lambda x: array_to_string(list_transform(regexp_extract_all(x, '[\p{L}\p{N}_]+(?:[-_/][\p{L}\p{N}_]+)*'), lambda y: lower(y)), ' ')) AS p,
  list_transform(string_split(question, ' ')[3:4], lambda x: array_to_string(list_transform(regexp_extract_all(x, '[\p{L}\p{N}_]+(?:[-_/][\p{L}\p{N}_]+)*'), lambda y: lower(y)), ' ')) AS g FROM questions),
k AS (SELECT *, list_filter([1, 2, 3, 4, 5], lambda i: i <= len(p) AND list_contains(g, p[i]))[1] AS first, list_distinct(p) AS d FROM n),
m AS (SELECT *, len(list_filter(g, lambda x: list_contains(d, x))) AS hit FROM k),
f AS (SELECT *, hit / len(d) AS pr, hit / len(g) AS re FROM m)
SELECT question_id, type, CASE WHEN type IN ('yesno', 'factoid') THEN CAST(p[1] = g[1] AS DOUBLE) END AS strict, CASE WHEN type = 'factoid' THEN CAST(first IS NOT NULL AS DOUBLE) END AS lenient,
  CASE WHEN type = 'factoid' THEN round(coalesce(1.0 / first, 0), 6)::DOUBLE END AS mrr, CASE WHEN type = 'list' THEN round(pr, 6) END AS precision, CASE WHEN type = 'list' THEN round(re, 6) END AS recall,
  CASE WHEN type = 'list' THEN round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6)::DOUBLE END AS f1 FROM f""")
def exact_answer(spark, sf_dir):
    """Made answers: the question's first six words against its third and fourth word as gold entities."""
    words = F.split("question", " ")
    rows = S.questions(spark, sf_dir).select("question_id", "type", F.transform(F.slice(words, 1, 6), lambda x: F.concat(x, F.lit("!"))).alias("predicted"), F.transform(F.slice(words, 3, 2), lambda x: F.array(x)).alias("gold"))
    return M.exact_answer(rows)


@query("describe", "SELECT count(n_chars) AS count, CAST(min(n_chars) AS DOUBLE) AS min, CAST(median(n_chars) AS DOUBLE) AS median, round(avg(n_chars), 3) AS mean, CAST(quantile_disc(n_chars, 0.95) AS DOUBLE) AS p95, CAST(max(n_chars) AS DOUBLE) AS max FROM documents")
def describe(spark, sf_dir):
    return M.describe(S.read(spark, sf_dir, "documents"), "n_chars")


@query("percentile_nr", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentile_nr(spark, sf_dir):
    nearest = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return S.read(spark, sf_dir, "events").groupBy("event_type").agg(nearest(0.5).alias("p50"), nearest(0.95).alias("p95"))
