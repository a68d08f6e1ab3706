"""Registered queries on statistics, gates, panels, audits, splits and runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import evidence as V
from ..operators import gates as G
from ..operators import panel as P
from ..operators import stats as ST
from ..sources import scratch
from ..sources import tables as S
from .queries_evidence import SPAN_SQL
from .queries_retrieval import WORD_RX

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def draw_sql(*parts: str) -> str:
    return "CAST('0x' || substr(sha256('20260713:' || " + " || ':' || ".join(parts) + "), 1, 12) AS BIGINT)"


#: Quality and toxicity of a document as two arms, its source as the group.
PAIRS_SQL = "pairs AS (SELECT l.doc_id, coalesce(source, '') AS grp, CAST(quality - toxic AS DOUBLE) AS delta FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def pairs(spark, sf_dir):
    labels, docs = S.read(spark, sf_dir, "labels"), S.read(spark, sf_dir, "documents").select("doc_id", "source")
    return labels.join(docs, "doc_id").select("doc_id", F.coalesce("source", F.lit("")).alias("grp"), (F.col("quality") - F.col("toxic")).cast("double").alias("delta"))


def bootstrap_sql(rows: str, b: int = ST.RESAMPLES) -> str:
    """Expressions that end in ``boot`` (mean_delta, ci95_low, ci95_high) of ``rows`` (grp, delta)."""
    return f"""grps AS (SELECT grp, sum(delta) AS s, count(*) AS n, row_number() OVER (ORDER BY grp) - 1 AS g FROM {rows} GROUP BY grp),
gs AS (SELECT count(*) AS m FROM grps),
drawn AS (SELECT b, {draw_sql("b", "slot")} % m AS g FROM (SELECT m, b, unnest(range(m)) AS slot FROM gs, range({b}) r(b))),
deltas AS (SELECT b, sum(s) / sum(n) AS d FROM drawn JOIN grps USING (g) GROUP BY b),
sorted AS (SELECT list(d ORDER BY d) AS d FROM deltas),
boot AS (SELECT (SELECT round(avg(delta), 6) FROM {rows}) AS mean_delta, round(d[{int(0.025 * (b - 1)) + 1}], 6) AS ci95_low, round(d[{-int(-0.975 * (b - 1) // 1) + 1}], 6) AS ci95_high FROM sorted)"""


@query("group_bootstrap", f"WITH {PAIRS_SQL}, {bootstrap_sql('pairs')} SELECT mean_delta, ci95_low, ci95_high FROM boot")
def group_bootstrap(spark, sf_dir):
    return ST.bootstrap(pairs(spark, sf_dir).select("grp", "delta"))


@query("permutation_p", f"""WITH {PAIRS_SQL}, t AS (SELECT abs(avg(delta)) AS observed, count(*) AS n FROM pairs),
f AS (SELECT b, sum(CASE WHEN {draw_sql("b", "doc_id")} % 2 = 0 THEN delta ELSE -delta END) AS s FROM pairs, range({ST.RESAMPLES}) r(b) GROUP BY b)
SELECT round(any_value(observed), 6) AS observed, count(*) FILTER (abs(s / n) >= observed - 1e-12) AS extreme, round((count(*) FILTER (abs(s / n) >= observed - 1e-12) + 1) / {ST.RESAMPLES + 1}, 6) AS p FROM f, t""")
def permutation_p(spark, sf_dir):
    return ST.permutation_p(pairs(spark, sf_dir).select(F.col("doc_id").alias("i"), "delta"))


@query("mde_80", f"WITH {PAIRS_SQL}, m AS (SELECT avg(delta) AS m FROM pairs GROUP BY grp) SELECT count(*) AS groups, round(CASE WHEN count(*) < 2 THEN 0 ELSE 2.801585218112969 * stddev_samp(m) / sqrt(count(*)) END, 6) AS mde FROM m")
def mde_80(spark, sf_dir):
    return ST.mde_80(pairs(spark, sf_dir))


@query("effect_size", f"WITH {PAIRS_SQL} SELECT round(avg(delta) / stddev_samp(delta), 6) AS effect FROM pairs")
def effect_size(spark, sf_dir):
    return ST.effect_size(pairs(spark, sf_dir))


HOLM_SQL = """tests AS (SELECT event_type AS name, avg(CASE WHEN user_id % 10 = 0 THEN 1.0 ELSE 0.0 END) / 5 AS p FROM events GROUP BY event_type),
scaled AS (SELECT name, p, row_number() OVER (ORDER BY p, name) AS r, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS x FROM tests)"""


@query("holm", f"WITH {HOLM_SQL} SELECT name, round(p, 6) AS p, round(max(x) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM scaled")
def holm(spark, sf_dir):
    tests = S.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg((F.avg(F.when(F.col("user_id") % 10 == 0, 1.0).otherwise(0.0)) / 5).alias("p"))
    return ST.holm(tests)


RATINGS_SQL = "ratings AS (SELECT doc_id AS unit, unnest([quality * 3, toxic * 3, CAST(doc_id % 4 AS INTEGER)]) AS score FROM labels)"


@query("krippendorff", f"""WITH {RATINGS_SQL}, tot AS (SELECT score, count(*) AS c FROM ratings GROUP BY score),
dist AS (SELECT a.score AS a, b.score AS b, a.c AS ca, b.c AS cb, ((SELECT sum(c) FROM tot WHERE score BETWEEN a.score AND b.score) - (a.c + b.c) / 2) ** 2 AS d FROM tot a JOIN tot b ON a.score < b.score),
expected AS (SELECT sum(ca * cb * d) / ((SELECT sum(c * (c - 1) / 2) FROM tot) + sum(ca * cb)) AS e FROM dist),
rc AS (SELECT unit, score, count(*) AS c FROM ratings GROUP BY ALL),
obs AS (SELECT sum(x.c * y.c * d) AS s FROM rc x JOIN rc y ON x.unit = y.unit AND x.score < y.score JOIN dist ON a = x.score AND b = y.score),
n AS (SELECT count(*) * 3 AS n FROM labels) SELECT round(1 - s / n / e, 6) AS alpha FROM obs, n, expected""")
def krippendorff(spark, sf_dir):
    labels = S.read(spark, sf_dir, "labels")
    return ST.krippendorff_ordinal(labels.select(F.col("doc_id").alias("unit"), F.explode(F.array(F.col("quality") * 3, F.col("toxic") * 3, (F.col("doc_id") % 4).cast("int"))).alias("score")))


@query("compare", "SELECT count(*) AS rows, round(avg(toxic - quality), 6) AS mean_delta FROM labels")
def compare(spark, sf_dir):
    labels = S.read(spark, sf_dir, "labels")
    both = ST.paired(labels.select("doc_id", F.col("quality").alias("v")), labels.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("delta"), 6).alias("mean_delta"))


@query("did_2x2", f"""WITH arms AS (SELECT coalesce(source, '') AS grp, CAST((d.doc_id % 3 - d.doc_id % 2) - (toxic - quality) AS DOUBLE) AS delta FROM labels l JOIN documents d ON d.doc_id = l.doc_id), {bootstrap_sql('arms')}
SELECT mean_delta, ci95_low, ci95_high, ci95_low > 0 OR ci95_high < 0 AS material FROM boot""")
def did_2x2(spark, sf_dir):
    labels, docs = S.read(spark, sf_dir, "labels"), S.read(spark, sf_dir, "documents").select("doc_id", "source")
    arms = labels.join(docs, "doc_id").select(F.coalesce("source", F.lit("")).alias("grp"), F.col("quality").alias("a0b0"), F.col("toxic").alias("a0b1"), (F.col("doc_id") % 2).alias("a1b0"), (F.col("doc_id") % 3).alias("a1b1"))
    return ST.did_2x2(arms.select("grp", *[F.col(c).cast("double").alias(c) for c in ("a0b0", "a0b1", "a1b0", "a1b1")]))


# --- gates over one summary row

SUMMARY_SQL = f"""WITH {PAIRS_SQL}, {bootstrap_sql('pairs')},
ev AS (SELECT user_id % 2 AS arm, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS f, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1),
summary AS (SELECT mean_delta, ci95_low, round(b.f - a.f, 6) AS failure_delta, round(b.p95 / a.p95, 6) AS p95_ratio, a.n AS n_left, b.n AS n_right FROM boot, ev a, ev b WHERE a.arm = 0 AND b.arm = 1)"""


def summary(spark, sf_dir):
    ev = S.read(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("f"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))
    wide = ev.groupBy().pivot("arm", [0, 1]).agg(F.first("n").alias("n"), F.first("f").alias("f"), F.first("p95").alias("p95"))
    boot = ST.bootstrap(pairs(spark, sf_dir).select("grp", "delta"))
    return boot.join(wide, how="cross").select("mean_delta", "ci95_low", F.round(F.col("1_f") - F.col("0_f"), 6).alias("failure_delta"), F.round(F.col("1_p95") / F.col("0_p95"), 6).alias("p95_ratio"), F.col("0_n").alias("n_left"), F.col("1_n").alias("n_right"))


@query("superiority_gate", SUMMARY_SQL + " SELECT mean_delta >= 0.01 AS minimum_effect, ci95_low > 0 AS positive_ci, failure_delta <= 0.005 AS failure_guard, p95_ratio <= 2 AS latency_guard, mean_delta >= 0.01 AND ci95_low > 0 AND failure_delta <= 0.005 AND p95_ratio <= 2 AS passed FROM summary")
def superiority_gate(spark, sf_dir):
    return G.superiority(summary(spark, sf_dir)).select("minimum_effect", "positive_ci", "failure_guard", "latency_guard", "passed")


@query("noninferiority_gate", SUMMARY_SQL + " SELECT mean_delta >= -0.01 AS mean_within, ci95_low > -0.01 AS ci_within, mean_delta >= -0.01 AND ci95_low > -0.01 AS passed FROM summary")
def noninferiority_gate(spark, sf_dir):
    return G.noninferiority(summary(spark, sf_dir)).select("mean_within", "ci_within", "passed")


HARM_SQL = "harm AS (SELECT round(avg(CASE WHEN (quality = 1 AND toxic = 0) OR quality - toxic >= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS severe_harm_rate, round(avg(CASE WHEN quality = 0 AND toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS rescue_rate, count(*) AS rows FROM labels)"


def harm(spark, sf_dir):
    return G.harm_and_rescue(S.read(spark, sf_dir, "labels").select(F.col("quality").alias("hit_l"), F.col("toxic").alias("hit_r"), F.col("quality").alias("ap_l"), F.col("toxic").alias("ap_r")))


@query("query_gate", SUMMARY_SQL + f", {HARM_SQL} SELECT severe_harm_rate, rescue_rate, severe_harm_rate < 0.05 AS harm_guard, mean_delta >= 0.01 AND ci95_low > 0 AND severe_harm_rate < 0.05 AND failure_delta <= 0.005 AND p95_ratio <= 2 AS passed FROM summary, harm")
def query_gate(spark, sf_dir):
    return G.query_strategy(summary(spark, sf_dir).join(harm(spark, sf_dir), how="cross")).select("severe_harm_rate", "rescue_rate", "harm_guard", "passed")


@query("evidence_gate", SUMMARY_SQL + " SELECT n_left = n_right AS same_rows, mean_delta >= 0.01 AND ci95_low > 0 AND failure_delta <= 0.005 AND n_left = n_right AS passed FROM summary")
def evidence_gate(spark, sf_dir):
    return G.evidence(summary(spark, sf_dir)).select("same_rows", "passed")


@query("diversity_gate", SUMMARY_SQL + " SELECT mean_delta >= 0.05 AS recall_gain, ci95_low >= -0.02 AS answer_guard, mean_delta >= 0.05 AND ci95_low > 0 AND ci95_low >= -0.02 AND failure_delta <= 0.005 AND mean_delta >= -0.01 AND n_left = n_right AS passed FROM summary")
def diversity_gate(spark, sf_dir):
    rows = summary(spark, sf_dir).withColumns({"recall_delta": F.col("mean_delta"), "recall_ci_low": F.col("ci95_low"), "answer_ci_low": F.col("ci95_low"), "citation_delta": F.col("mean_delta")})
    return G.diversity(rows).select("recall_gain", "answer_guard", "passed")


GENERATION_SQL = """gen AS (SELECT count(*) AS questions, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate, round(avg(CASE WHEN event_id % 11 = 0 THEN 1.0 ELSE 0.0 END), 6) AS retry_rate,
  round(sum(event_id % 4) / sum(event_id % 4 + CAST(event_id % 97 = 0 AS INTEGER)), 6) AS citation_validity, quantile_disc(value, 0.5) FILTER (event_type <> 'error') AS p50_ms, quantile_disc(value, 0.95) FILTER (event_type <> 'error') AS p95_ms FROM events)"""


def generation(spark, sf_dir):
    """Aggregate of run rows: failures stay in every rate, latencies are those of successes."""
    ev = S.read(spark, sf_dir, "events")
    good = F.when(F.col("event_type") != "error", F.col("value"))
    nearest = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY good)")
    rows = ev.select("*", good.alias("good"), (F.col("event_id") % 4).alias("valid"), (F.col("event_id") % 4 + (F.col("event_id") % 97 == 0).cast("int")).alias("cited"))
    return rows.agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("failure_rate"),
        F.round(F.avg((F.col("event_id") % 11 == 0).cast("double")), 6).alias("retry_rate"),
        F.round(F.sum("valid") / F.sum("cited"), 6).alias("citation_validity"),
        nearest(0.5).alias("p50_ms"),
        nearest(0.95).alias("p95_ms"),
    )


@query("generation_aggregate", f"WITH {GENERATION_SQL} SELECT * FROM gen")
def generation_aggregate(spark, sf_dir):
    return generation(spark, sf_dir)


@query("generator_screen", f"WITH {GENERATION_SQL} SELECT failure_rate <= 0.025 AS failure_ok, retry_rate <= 0.1 AS retry_ok, citation_validity >= 0.99 AS citation_ok, p95_ms <= 10000 AS latency_ok, questions >= 40 AS enough_rows, failure_rate <= 0.025 AND retry_rate <= 0.1 AND citation_validity >= 0.99 AND p95_ms <= 10000 AND questions >= 40 AS passed FROM gen")
def generator_screen(spark, sf_dir):
    return G.generator_screen(generation(spark, sf_dir)).select("failure_ok", "retry_ok", "citation_ok", "latency_ok", "enough_rows", "passed")


# --- panels

JUDGES_SQL = f"judged AS (SELECT conv_id, turn, unnest([0, 1, 2]) AS judge FROM conversations), scored AS (SELECT *, CAST({draw_sql('judge', 'conv_id', 'turn')} % 4 AS INTEGER) AS score FROM judged)"


def judged(spark, sf_dir):
    rows = S.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("judge"))
    return rows.withColumn("score", (ST.draw(ST.SEED, F.col("judge"), F.col("conv_id"), F.col("turn")) % 4).cast("int"))


@query("panel_direct", f"WITH {JUDGES_SQL}, l AS (SELECT conv_id, turn, list(score ORDER BY score) AS s FROM scored GROUP BY ALL) SELECT conv_id, turn, s[CAST(floor(len(s) / 2) AS INTEGER) + 1] AS median, list_max(s) - list_min(s) AS spread, list_max(s) - list_min(s) >= 1 AS disagrees, CAST(len(s) AS INTEGER) AS judges FROM l")
def panel_direct(spark, sf_dir):
    return P.direct(judged(spark, sf_dir), ["conv_id", "turn"])


VOTES_SQL = f"""votes AS (SELECT conv_id * 1000 + turn AS qa, judge, {draw_sql('conv_id * 1000 + turn')} % 2 = 1 AS swap, ['A', 'B', 'tie'][score % 3 + 1] AS v1, ['A', 'B', 'tie', 'A'][(score + judge) % 4 + 1] AS v2 FROM scored),
un AS (SELECT qa, judge, CASE WHEN v1 = 'tie' THEN 'tie' WHEN (v1 = 'A') <> swap THEN 'left' ELSE 'right' END AS a, CASE WHEN v2 = 'tie' THEN 'tie' WHEN (v2 = 'A') <> (NOT swap) THEN 'left' ELSE 'right' END AS b FROM votes),
con AS (SELECT qa, judge, CASE WHEN a = b THEN a ELSE 'tie' END AS vote FROM un)"""


def paired_votes(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("qa", F.col("conv_id") * 1000 + F.col("turn"))
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    swap = P.swapped("qa", ST.SEED)
    first, second = pick(["A", "B", "tie"], F.col("score") % 3), pick(["A", "B", "tie", "A"], (F.col("score") + F.col("judge")) % 4)
    return rows.select("qa", "judge", P.consistent(P.unmask(first, swap), P.unmask(second, ~swap)).alias("vote"))


@query("panel_pairwise", f"WITH {JUDGES_SQL}, {VOTES_SQL} SELECT qa, judge, vote FROM con")
def panel_pairwise(spark, sf_dir):
    return paired_votes(spark, sf_dir)


@query("panel_winner", f"WITH {JUDGES_SQL}, {VOTES_SQL}, c AS (SELECT qa, vote, count(*) AS c FROM con GROUP BY ALL), t AS (SELECT qa, max(c) AS top FROM c GROUP BY qa) SELECT qa, CASE WHEN count(*) FILTER (c = top) = 1 THEN min(vote) FILTER (c = top) ELSE 'tie' END AS winner FROM c JOIN t USING (qa) GROUP BY qa")
def panel_winner(spark, sf_dir):
    return P.winner(paired_votes(spark, sf_dir), "qa")


@query("judge_sanity", f"WITH {JUDGES_SQL} SELECT judge, count(*) AS pairs, round(avg(CASE WHEN score >= 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, avg(CASE WHEN score >= 1 THEN 1.0 ELSE 0.0 END) >= 0.9 AS passed FROM scored GROUP BY judge")
def judge_sanity(spark, sf_dir):
    ok = (F.col("score") >= 1).cast("double")
    return judged(spark, sf_dir).groupBy("judge").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(ok), 6).alias("pass_rate"), (F.avg(ok) >= 0.9).alias("passed"))


# --- audits and splits

def norm_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{WORD_RX}'), lambda x: lower(x)), ' ')"



@query("corpus_audit", S.with_sql("corpus") + f""", r AS (SELECT pmid, CAST(len(regexp_extract_all(title || ' ' || text, '{WORD_RX}')) AS INTEGER) AS w, CAST(substr(publication_date, 1, 4) AS INTEGER) AS y, sha256({norm_sql("title || ' ' || text")}) AS n, title, text, url FROM corpus),
d AS (SELECT count(*) AS c FROM r GROUP BY n HAVING count(*) > 1)
SELECT count(*) AS rows, count(DISTINCT pmid) AS unique_ids, count(*) - count(DISTINCT pmid) AS repeated_ids, count(*) FILTER (title = '') AS missing_title, count(*) FILTER (text = '') AS missing_text, count(*) FILTER (url = '') AS missing_url,
 min(w) AS words_min, round(avg(w), 3) AS words_mean, max(w) AS words_max, min(y) AS year_min, max(y) AS year_max, (SELECT count(*) FROM d) AS duplicate_groups, CAST((SELECT coalesce(sum(c), 0) FROM d) AS BIGINT) AS duplicate_rows FROM r""")
def corpus_audit(spark, sf_dir):
    return A.corpus_audit(S.corpus(spark, sf_dir))


@query("qa_audit", S.with_sql("corpus", "questions", "qrels") + f""", g AS (SELECT question_id, count(*) AS gold FROM qrels GROUP BY ALL)
SELECT type, count(*) AS questions, round(avg(len(regexp_extract_all(question, '{WORD_RX}'))), 3) AS words_mean, CAST(coalesce(sum(gold), 0) AS BIGINT) AS gold_refs, CAST(coalesce(sum(gold), 0) AS BIGINT) AS reachable_refs, count(*) FILTER (gold IS NULL) AS without_gold
FROM questions LEFT JOIN g USING (question_id) GROUP BY type""")
def qa_audit(spark, sf_dir):
    return A.qa_audit(S.questions(spark, sf_dir), S.qrels(spark, sf_dir), S.corpus(spark, sf_dir))


@query("snippet_audit", S.with_sql("corpus", "questions", "qrels") + """, a AS (SELECT doc_id + CASE WHEN question_id % 9 = 0 THEN 1000000000 ELSE 0 END AS doc_id, CASE WHEN question_id % 7 = 0 THEN 'sections.0' ELSE 'Abstract' END AS section, "begin" + CAST(question_id % 2 AS INTEGER) AS b, "end" AS e, question AS said FROM qrels JOIN questions USING (question_id)),
j AS (SELECT a.*, text, CASE WHEN section = 'Abstract' THEN text END AS sec FROM a LEFT JOIN corpus USING (doc_id))
SELECT count(*) AS refs, count(text) AS reachable, count(*) FILTER (text IS NOT NULL AND coalesce(sec = '', true)) AS unknown_section, count(*) FILTER (contains(sec, said)) AS contained, count(*) FILTER (substr(sec, b + 1, e - b) = said) AS exact_offsets FROM j""")
def snippet_audit(spark, sf_dir):
    """Annotations with some documents, sections and offsets spoilt."""
    q = S.qrels(spark, sf_dir).join(S.questions(spark, sf_dir), "question_id")
    rows = q.select((F.col("doc_id") + F.when(F.col("question_id") % 9 == 0, 1_000_000_000).otherwise(0)).alias("doc_id"), F.when(F.col("question_id") % 7 == 0, "sections.0").otherwise("Abstract").alias("section"), (F.col("begin") + (F.col("question_id") % 2).cast("int")).alias("begin"), "end", F.col("question").alias("text"))
    return A.snippet_audit(rows, S.corpus(spark, sf_dir))


@query("split_integrity", S.with_sql("questions", "qrels") + f", n AS (SELECT question_id % 2 AS side, {norm_sql('question')} AS norm FROM questions) SELECT (SELECT count(*) FROM (SELECT norm FROM n WHERE side = 0 INTERSECT SELECT norm FROM n WHERE side = 1)) AS shared, (SELECT count(DISTINCT doc_id) FROM qrels) AS inside, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM qrels)) AS outside")
def split_integrity(spark, sf_dir):
    from ..functions.text import normalize

    n = S.questions(spark, sf_dir).select((F.col("question_id") % 2).alias("side"), normalize("question").alias("norm"))
    shared = n.where("side = 0").select("norm").intersect(n.where("side = 1").select("norm")).agg(F.count(F.lit(1)).alias("shared"))
    gold = S.qrels(spark, sf_dir).select("doc_id").distinct()
    inside = gold.agg(F.count(F.lit(1)).alias("inside"))
    outside = S.read(spark, sf_dir, "documents").join(gold, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("outside"))
    return shared.join(inside, how="cross").join(outside, how="cross")


def sample_sql(rows: str, n: int, seed: int) -> str:
    return f"SELECT question_id, type FROM (SELECT question_id, type, row_number() OVER (PARTITION BY type ORDER BY sha256('{seed}:' || question_id)) AS r FROM {rows}) WHERE r <= {n}"


@query("stratified_sample", S.with_sql("questions") + " " + sample_sql("questions", 4, 20260715))
def stratified_sample(spark, sf_dir):
    return A.stratified_sample(S.questions(spark, sf_dir), 4, ST.SEED + 2).select("question_id", "type")


SPLIT_SQL = S.with_sql("questions") + f""", nq AS (SELECT question_id, type, {norm_sql('question')} AS norm FROM questions),
alone AS (SELECT question_id, type FROM nq WHERE norm IN (SELECT norm FROM nq GROUP BY norm HAVING count(*) = 1)),
held AS ({sample_sql('alone', 2, 20260714)}),
rest AS (SELECT question_id, type FROM nq WHERE question_id NOT IN (SELECT question_id FROM held)),
splits AS (SELECT 'validation' AS population, question_id FROM held UNION ALL SELECT 'selection', question_id FROM rest
  UNION ALL SELECT 'smoke', question_id FROM ({sample_sql('rest', 1, 20260715)}) UNION ALL SELECT 'query', question_id FROM ({sample_sql('rest', 3, 20260716)}))"""


def _splits(spark, sf_dir):
    return A.freeze_splits(S.questions(spark, sf_dir), ST.SEED, 2, {"smoke": (1, 2), "query": (3, 3)})


@query("freeze_splits", SPLIT_SQL + " SELECT population, question_id FROM splits")
def freeze_splits(spark, sf_dir):
    return _splits(spark, sf_dir)


@query("verify_splits", SPLIT_SQL + " SELECT 0::BIGINT AS overlap, (SELECT count(*) FROM splits WHERE population IN ('smoke', 'query') AND question_id NOT IN (SELECT question_id FROM rest)) AS outside, (SELECT count(*) FROM (SELECT norm FROM nq JOIN splits USING (question_id) WHERE population IN ('validation', 'selection') GROUP BY norm HAVING count(DISTINCT population) > 1)) AS crossing")
def verify_splits(spark, sf_dir):
    return A.verify_splits(_splits(spark, sf_dir), S.questions(spark, sf_dir))


# --- runs


@query("merge_shards", "WITH s AS (SELECT user_id AS question_id, event_id AS shard, event_type = 'error' AS failed FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY failed, shard) AS r, max(CAST(failed AS INTEGER)) OVER (PARTITION BY question_id) = 1 AS any_failed FROM s) SELECT question_id, shard, failed, any_failed AND NOT failed AS recovered FROM r WHERE r = 1")
def merge_shards(spark, sf_dir):
    rows = S.read(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").alias("shard"), (F.col("event_type") == "error").alias("failed"), F.col("user_id").cast("string").alias("result"))
    return A.merge_shards(rows).select("question_id", "shard", "failed", "recovered")


@query("failure_sequence", """WITH r AS (SELECT user_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
s AS (SELECT user_id, count(*) AS rows, count(*) FILTER (failed) AS failures, min(i) FILTER (failed) AS f, max(i) FILTER (NOT failed) AS g FROM r GROUP BY user_id)
SELECT user_id, rows, failures, CAST(f AS INTEGER) AS first_failure, (SELECT count(*) FROM r WHERE r.user_id = s.user_id AND NOT failed AND i > f) AS successes_after, CAST(rows - 1 - coalesce(g, -1) AS BIGINT) AS tail FROM s""")
def failure_sequence(spark, sf_dir):
    rows = S.read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return A.failure_sequence(rows, ["user_id"], "event_id")


@query("context_invariant", "SELECT count(*) AS compared, count(*) FILTER (doc_id % 10 = 0) AS mismatches FROM documents")
def context_invariant(spark, sf_dir):
    docs = S.read(spark, sf_dir, "documents")
    left = docs.select("doc_id", F.sha2("text", 256).alias("hash"))
    right = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("changed")).otherwise(F.sha2("text", 256)).alias("hash"))
    return A.context_invariant(left, right, "doc_id")


@query("error_audit", SPAN_SQL + """, r AS (SELECT q.question_id, q.question_id % 13 = 0 AS failed, EXISTS (SELECT 1 FROM bm25_run b JOIN qrels g USING (question_id, doc_id) WHERE b.question_id = q.question_id) AS hit,
  EXISTS (SELECT 1 FROM ranked b JOIN qrels g USING (question_id, doc_id) WHERE b.question_id = q.question_id) AS packed, f1 FROM questions q JOIN spanf USING (question_id)),
c AS (SELECT question_id, list_filter([CASE WHEN failed THEN 'SYS1' END, CASE WHEN NOT hit THEN 'R1' WHEN NOT packed THEN 'CTX1' WHEN f1 = 0 THEN 'R2' END, CASE WHEN question_id % 5 = 0 THEN 'G3' END, CASE WHEN question_id % 3 < 1 THEN 'CIT2' END, CASE WHEN NOT failed AND question_id / 100.0 < 0.1 THEN 'G2' END], lambda x: x IS NOT NULL) AS codes FROM r)
SELECT question_id, array_to_string(codes, ',') AS codes FROM c""")
def error_audit(spark, sf_dir):
    """Codes from the retrieval and evidence of each question, with made answer fields."""
    from .queries_evidence import _bm25, span_scores

    # what several columns are made from is found once
    asked, gold = S.questions(spark, sf_dir), scratch.written(S.qrels(spark, sf_dir), "gold")
    run = scratch.written(_bm25(spark, sf_dir, "title_abstract", 10), "run")
    ranked = scratch.written(V.rank_lexical(run, asked, S.corpus(spark, sf_dir)).select("question_id", "doc_id", "begin", "end"), "ranked")
    has = lambda df, name: df.select("question_id", "doc_id").join(gold, ["question_id", "doc_id"], "left_semi").select("question_id", F.lit(True).alias(name)).distinct()
    rows = asked.join(span_scores(ranked, gold, asked).select("question_id", F.col("f1").alias("span_f1")), "question_id")
    rows = rows.join(has(run, "retrieved_hit"), "question_id", "left").join(has(ranked, "packed_hit"), "question_id", "left")
    q = F.col("question_id")
    rows = rows.withColumns({"retrieved_hit": F.coalesce("retrieved_hit", F.lit(False)), "packed_hit": F.coalesce("packed_hit", F.lit(False)), "failed": q % 13 == 0, "has_provenance": F.lit(True), "answered": F.lit(True), "type_ok": q % 5 != 0, "cited": F.lit(1), "valid": (q % 3).cast("int"), "rouge": q / 100})
    return rows.select("question_id", F.array_join(A.error_codes(), ",").alias("codes"))


@query("error_code_check", "SELECT event_type AS code, count(*) AS n FROM events WHERE event_type NOT IN ('R1', 'R2', 'CTX1', 'CTX2', 'G1', 'G2', 'G3', 'CIT1', 'CIT2', 'S1', 'SYS1') GROUP BY event_type")
def error_code_check(spark, sf_dir):
    return A.check_codes(S.read(spark, sf_dir, "events").select(F.col("event_type").alias("code"))).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("heldout_ledger", "SELECT event_type AS stage, sha256(CAST(user_id % 7 AS VARCHAR)) AS artifact_sha256, min(event_id) AS first_event FROM events GROUP BY ALL")
def heldout_ledger(spark, sf_dir):
    """Each access once by stage and artifact: the first stays."""
    rows = S.read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.sha2((F.col("user_id") % 7).cast("string"), 256).alias("artifact_sha256"), "event_id")
    return rows.groupBy("stage", "artifact_sha256").agg(F.min("event_id").alias("first_event"))


@query("trace_get", "SELECT user_id AS trace_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def trace_get(spark, sf_dir):
    """The newest version of each trace in an append-only table."""
    rows = S.read(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), "ts", "event_id", "event_type")
    newest = Window.partitionBy("trace_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("r", F.row_number().over(newest)).where("r = 1").select("trace_id", "event_id", "event_type")
