"""Verbs of the command line: each is a list of options and a function from options to a table. Runs are Parquet folders."""

from __future__ import annotations

from argparse import Namespace
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize
from .operators import audit, encoders, evidence, gates, stats
from .operators import retrieval as R
from .plans import catalog, gateway, generation, guards, judging, registry, runs
from .plans.engine import Engine
from .plans.indexes import sparse_index
from .sources import store, tables


class Verb(NamedTuple):
    options: tuple[str, ...]
    run: Callable[[SparkSession, Namespace], DataFrame]
    help: str


#: Option: keyword arguments of the parser. A name with ! in a verb's list is required there.
OPTIONS: dict[str, dict] = {
    "population": {"help": "name of a population; without it all questions"},
    "splits": {"help": "folder of population, question_id"},
    "frozen": {"help": "file written by freeze-final; held-out populations need it"},
    "limit": {"type": int},
    "offset": {"type": int, "default": 0},
    "recipe": {"default": "title_abstract", "choices": R.RECIPES},
    "method": {"choices": ("dense", "rrf", "rrf_rerank")},
    "k": {"type": int, "default": 100},
    "serial_latency": {"action": "store_true", "help": "time one question after the other"},
    "pipeline": {"choices": sorted(registry.PIPELINES)},
    "arm": {},
    "budget": {"type": int, "default": 600},
    "order": {"default": "relevance_descending", "choices": ("relevance_descending", "strongest_middle")},
    "diversity": {"type": int, "help": "snippets a document at most"},
    "strategy": {"default": "lexical", "choices": ("lexical", "bm25", "abstract")},
    "transform": {"default": "original", "choices": ("original", "mesh")},
    "style": {"default": "predicted_type_schema", "choices": generation.STYLES},
    "workers": {"type": int, "default": 4},
    "model": {"default": "extractive"},
    "cache": {"help": "folder of responses"},
    "run": {"help": "folder of a retrieval run"},
    "contexts": {},
    "generation": {},
    "gold": {"help": "folder of question_id, type, reference"},
    "left": {},
    "right": {},
    "metric": {"default": "ap"},
    "require_equal_evidence": {"action": "store_true"},
    "source": {"action": "append", "help": "may be given several times"},
    "summary": {"help": "folder with the gate's columns"},
    "key": {"default": "evidence_set_hash", "choices": ("evidence_set_hash", "context_hash")},
    "a0b0": {},
    "a0b1": {},
    "a1b0": {},
    "a1b1": {},
    "verify": {"action": "store_true"},
    "file": {},
    "name": {"help": "a registered query"},
}


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _configs() -> dict[str, str]:
    return {arm: registry.PIPELINES[arm].config_hash for arm in runs.FINAL_ARMS}


def _ids(spark: SparkSession, a: Namespace) -> DataFrame:
    """The ids of the population, behind the held-out guard."""
    if not a.population:
        ids = tables.questions(spark, a.data).select("question_id")
        if a.limit is not None and a.limit < 1:
            raise ValueError("limit must be positive")
        return ids if a.limit is None else ids.orderBy("question_id").limit(a.limit)
    frozen = store.read_json(spark, a.frozen) if getattr(a, "frozen", None) else None
    guards.heldout_guard(a.population, frozen, _configs())
    if not a.splits:
        raise ValueError("a population needs --splits")
    return guards.selected_ids(_read(spark, a.splits), a.population, a.limit)


def _questions(spark: SparkSession, a: Namespace) -> DataFrame:
    rows = tables.questions(spark, a.data).join(_ids(spark, a), "question_id", "left_semi")
    if getattr(a, "offset", 0):
        if a.offset < 0:
            raise ValueError("offset must not be negative")
        rows = rows.orderBy("question_id").offset(a.offset)
    return rows


def _gold(spark: SparkSession, a: Namespace) -> DataFrame:
    """References of answers: those given, or the question's own text, which the test tables have as the passage."""
    if getattr(a, "gold", None):
        return _read(spark, a.gold)
    return tables.questions(spark, a.data).select("question_id", "type", F.col("question").alias("reference"))


def _search(spark: SparkSession, a: Namespace, method: str) -> Callable[[DataFrame], DataFrame]:
    from .plans.queries_retrieval import question_vectors

    corpus, index = tables.corpus(spark, a.data), sparse_index(spark, a.data, a.recipe)
    vectors, queries = (tables.vectors(spark, a.data), question_vectors(spark, a.data)) if method != "bm25" else (None, None)
    mine = lambda q: None if queries is None else queries.join(q.select("question_id"), "question_id", "left_semi")
    return lambda q: R.retrieve(method, q, corpus, vectors, mine(q), a.k, a.recipe, index)


def _retrieval(spark: SparkSession, a: Namespace, method: str) -> DataFrame:
    q, search = _questions(spark, a), _search(spark, a, method)
    return runs.serial_latencies(q, search) if a.serial_latency else search(q)


def _query(spark: SparkSession, a: Namespace) -> DataFrame:
    from .plans.queries_retrieval import question_vectors

    q, corpus, index = _questions(spark, a), tables.corpus(spark, a.data), sparse_index(spark, a.data, a.recipe)
    if a.transform == "mesh":
        return generation.query_run(q, corpus, tables.vectors(spark, a.data), question_vectors(spark, a.data), index, a.k)
    return _search(spark, a, "rrf_rerank")(q)


def _evidence(spark: SparkSession, a: Namespace) -> DataFrame:
    """An evidence arm over the documents of a run that is there, so that arms differ in evidence alone."""
    q, corpus, run = _questions(spark, a), tables.corpus(spark, a.data), _read(spark, a.run)
    run = run.join(q.select("question_id"), "question_id", "left_semi")
    pool = lambda: evidence.candidates(run, corpus)
    made = {
        "full_document_fields": lambda: run.join(corpus, "doc_id").select("question_id", "doc_id", "rank", F.posexplode(F.array("title", "text")).alias("field", "snippet")),
        "fixed256_bm25": lambda: evidence.rank_bm25_local(_chunk_pool(run, corpus), q),
        "sentence3_bm25": lambda: evidence.rank_bm25_local(pool(), q),
        "sentence3_cross_encoder": lambda: R.top_k(pool().join(q.select("question_id", "question"), "question_id").withColumn("score", R.lexical_score("question", F.col("snippet"))), evidence.EVIDENCE_LIMIT, [F.desc("score"), F.asc("ordinal")]),
    }
    if a.arm not in made:
        raise ValueError(f"the arm is one of {sorted(made)}")
    return made[a.arm]()


def _chunk_pool(run: DataFrame, corpus: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    hits = run.where(F.col("rank") <= evidence.EVIDENCE_DOCUMENTS).select("question_id", "doc_id", F.col("rank").alias("doc_rank"))
    chunks = evidence.fixed_chunks(corpus.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text"))
    order = Window.partitionBy("question_id").orderBy("doc_rank", "chunk")
    return hits.join(chunks, "doc_id").withColumn("section", F.lit("abstract")).withColumn("ordinal", F.row_number().over(order))


def _contexts(spark: SparkSession, a: Namespace) -> DataFrame:
    corpus = tables.corpus(spark, a.data)
    run = _read(spark, a.run) if a.run else None
    index = None if run is not None else sparse_index(spark, a.data, "title_abstract")
    return generation.prepare_contexts(_questions(spark, a), corpus, "bm25", a.strategy, a.diversity, a.order, a.budget, a.transform == "mesh", index=index, run=run)


def _generate(spark: SparkSession, a: Namespace) -> DataFrame:
    contexts = _read(spark, a.contexts)
    q = _questions(spark, a)
    guards.covers(q.select("question_id"), contexts=contexts.join(q.select("question_id"), "question_id", "left_semi"))
    rows = generation.context_generation(q, contexts, gateway.extractive, a.style, a.model, a.cache, a.workers)
    return generation.score_generation(rows, _gold(spark, a), stemmed=True)


def _annotations(spark: SparkSession, a: Namespace) -> DataFrame:
    from .plans.queries_generation import annotations

    return annotations(spark, a.data)


def _oracle(spark: SparkSession, a: Namespace) -> DataFrame:
    q, corpus = _questions(spark, a), tables.corpus(spark, a.data)
    run = R.bm25_search(sparse_index(spark, a.data, "title_abstract"), q, evidence.EVIDENCE_DOCUMENTS)
    return generation.oracle_arms(q, corpus, tables.qrels(spark, a.data).join(q.select("question_id"), "question_id", "left_semi"), _annotations(spark, a).join(q.select("question_id"), "question_id", "left_semi"), run, a.budget)


def _summarize_oracle(spark: SparkSession, a: Namespace) -> DataFrame:
    """Summaries of scored runs, one a source in the order given; all must have the same questions."""
    arms = [_read(spark, path) for path in a.source or []]
    if len(arms) != 4:
        raise ValueError("the four arms are given with --source, from closed book to annotated snippets")
    for other in arms[1:]:
        guards.covers(arms[0].select("question_id"), arm=other)
    return reduce(DataFrame.unionByName, [generation.generation_summary(df).withColumn("arm", F.lit(f"L{i}")) for i, df in enumerate(arms)])


def _compare(spark: SparkSession, a: Namespace) -> DataFrame:
    left, right = _read(spark, a.left), _read(spark, a.right)
    if a.require_equal_evidence and audit.context_invariant(left, right, value="evidence_hash").first().mismatches:
        raise ValueError("the runs were not given the same evidence")
    both = stats.paired(left, right, "question_id", a.metric)
    groups = tables.questions(spark, a.data).select("question_id", normalize("question").alias("grp"))
    rows = both.join(groups, "question_id", "left").select(F.coalesce("grp", F.col("question_id").cast("string")).alias("grp"), F.col("question_id").alias("i"), F.col("delta").cast("double").alias("delta"))
    parts = [stats.bootstrap(rows), stats.effect_size(rows), stats.mde_80(rows), stats.permutation_p(rows)]
    return reduce(lambda x, y: x.join(y, how="cross"), parts)


def _interaction(spark: SparkSession, a: Namespace) -> DataFrame:
    cells = [_read(spark, getattr(a, c)).select("question_id", F.col(a.metric).cast("double").alias(c)) for c in ("a0b0", "a0b1", "a1b0", "a1b1")]
    for other in cells[1:]:
        guards.covers(cells[0].select("question_id"), cell=other)
    return stats.did_2x2(reduce(lambda x, y: x.join(y, "question_id"), cells).withColumnRenamed("question_id", "grp"))


def _merge(spark: SparkSession, a: Namespace) -> DataFrame:
    """Shards of ``question_id, failed`` and results as one run: a success replaces failures, and every id must have one."""
    shards = [_read(spark, path).withColumn("shard", F.lit(i)) for i, path in enumerate(a.source or [])]
    if not shards:
        raise ValueError("shards are given with --source")
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), shards)
    if "failed" not in rows.columns:
        rows = rows.withColumn("failed", F.lit(False))
    results = [c for c in rows.columns if c not in ("question_id", "shard", "failed", "latency_ms")]
    one = rows.groupBy("question_id", "shard", "failed").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*results)))), 256).alias("result"))
    merged = audit.merge_shards(one)
    if not merged.where("failed").isEmpty():
        raise ValueError("some questions failed in every shard")
    guards.covers(_ids(spark, a), shards=merged)
    return rows.join(merged.select("question_id", "shard", "recovered"), ["question_id", "shard"])


def _panel(spark: SparkSession, a: Namespace, sides: tuple[str, ...]) -> DataFrame:
    ids = _ids(spark, a)
    of = lambda df: df.join(ids, "question_id", "left_semi")
    said = [of(_read(spark, getattr(a, s))).select("question_id", F.col("answer.ideal_answer").alias("answer")) for s in sides]
    q = of(tables.questions(spark, a.data)).join(_gold(spark, a).select("question_id", "reference"), "question_id")
    suite = judging.direct_suite if len(sides) == 1 else judging.pairwise_suite
    return suite(ids, q, *said, of(_read(spark, a.contexts)), {a.model: judging.word_judge}, cache_path=a.cache, workers=a.workers)[1]


def _sanity(spark: SparkSession, a: Namespace) -> DataFrame:
    q = _questions(spark, a).join(_gold(spark, a).select("question_id", "reference"), "question_id")
    found = evidence.frozen_snippets(_annotations(spark, a), tables.corpus(spark, a.data))
    return judging.sanity_suite(q, found, {a.model: judging.word_judge}, a.limit or judging.SANITY_LIMIT, workers=a.workers)[1]


def _error_audit(spark: SparkSession, a: Namespace) -> DataFrame:
    """Counts of error codes over ``question_id`` rows that have the audit's fields, joined from contexts and generation."""
    rows = _read(spark, a.contexts).join(_read(spark, a.generation), "question_id")
    return rows.select(F.explode(audit.error_codes()).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _bertscore(spark: SparkSession, a: Namespace) -> DataFrame:
    """Greedy matching of hashed token vectors of answers and references."""
    rows = _read(spark, a.generation).select("question_id", F.coalesce("answer.ideal_answer", F.lit("")).alias("p")).join(_gold(spark, a).select("question_id", F.col("reference").alias("r")), "question_id")
    return encoders.greedy_f1(rows.select("question_id", encoders.token_vectors("p").alias("p"), encoders.token_vectors("r").alias("r")), ["question_id"])


def _freeze_final(spark: SparkSession, a: Namespace) -> DataFrame:
    if a.verify:
        runs.verify_freeze(store.read_json(spark, a.file), _configs())
    else:
        store.write_json(spark, runs.freeze_finalists(_configs()), a.file)
    return spark.createDataFrame(sorted(_configs().items()), "arm string, config_hash string")


def _gate(check: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, Namespace], DataFrame]:
    return lambda spark, a: check(_read(spark, a.summary))


_WHO = ("population", "splits", "frozen", "limit")
EXPERIMENT: dict[str, Verb] = {
    "bm25": Verb((*_WHO, "recipe", "k", "serial_latency"), lambda s, a: _retrieval(s, a, "bm25"), "a sparse run"),
    "retrieval": Verb((*_WHO, "offset", "method!", "recipe", "k", "serial_latency"), lambda s, a: _retrieval(s, a, a.method), "a dense, fused or reranked run"),
    "query": Verb((*_WHO, "offset", "transform", "recipe", "k"), _query, "a run behind a query transform"),
    "subset-retrieval": Verb((*_WHO, "run!"), lambda s, a: R.subset_run(_read(s, a.run), _ids(s, a)), "the run of a sub-population"),
    "merge-retrieval": Verb((*_WHO, "source!"), _merge, "shards of a run as one"),
    "merge-evidence": Verb((*_WHO, "source!"), _merge, "shards of evidence as one"),
    "gold-retrieval-oracle": Verb(_WHO, lambda s, a: R.gold_run(tables.qrels(s, a.data).join(_ids(s, a), "question_id", "left_semi")), "relevant documents as a run"),
    "evidence": Verb((*_WHO, "offset", "arm!", "run!"), _evidence, "an evidence arm over a run"),
    "prepare-contexts": Verb((*_WHO, "run", "strategy", "transform", "diversity", "order", "budget"), _contexts, "contexts without gold"),
    "prepare-oracle-contexts": Verb((*_WHO, "arm!", "budget"), lambda s, a: generation.oracle_contexts(a.arm, _questions(s, a), _annotations(s, a), tables.corpus(s, a.data), a.budget), "closed_book or gold_snippets"),
    "oracle": Verb((*_WHO, "budget"), _oracle, "contexts of the four oracle arms"),
    "summarize-oracle": Verb(("source!",), _summarize_oracle, "four scored runs side by side"),
    "generation": Verb((*_WHO, "pipeline!", "gold"), lambda s, a: generation.score_generation(Engine(s, a.data, registry.PIPELINES[a.pipeline]).answer(_questions(s, a)), _gold(s, a), stemmed=True), "a pipeline's answers, scored"),
    "generate-contexts": Verb((*_WHO, "contexts!", "style", "model", "cache", "workers", "gold"), _generate, "answers to prepared contexts, scored"),
    "summarize": Verb(("generation!",), lambda s, a: generation.generation_summary(_read(s, a.generation)), "one row of a scored run"),
    "compare": Verb(("left!", "right!", "metric", "require_equal_evidence"), _compare, "paired statistics of two runs"),
    "interaction": Verb(("a0b0!", "a0b1!", "a1b0!", "a1b1!", "metric"), _interaction, "difference in differences"),
    "final-holm": Verb(("summary!",), _gate(runs.final_holm), "three contrasts, adjusted"),
    "freeze-final": Verb(("file!", "verify"), _freeze_final, "hashes of the final configurations"),
    "gate": Verb(("summary!",), _gate(gates.superiority), "superiority"),
    "noninferiority-gate": Verb(("summary!",), _gate(gates.noninferiority), "noninferiority"),
    "query-gate": Verb(("summary!",), _gate(gates.query_strategy), "query strategies"),
    "evidence-gate": Verb(("summary!",), _gate(gates.evidence), "evidence strategies"),
    "diversity-gate": Verb(("summary!",), _gate(gates.diversity), "source diversity"),
    "generator-screen-gate": Verb(("summary!",), _gate(gates.generator_screen), "generators"),
    "verify-context-invariant": Verb(("left!", "right!", "key"), lambda s, a: audit.context_invariant(_read(s, a.left), _read(s, a.right), value=a.key), "equal hashes in two context runs"),
    "error-audit": Verb(("contexts!", "generation!"), _error_audit, "counts of error codes"),
    "audit-failures": Verb(("run!",), lambda s, a: audit.failure_sequence(_read(s, a.run).withColumn("run", F.lit(a.run)), ["run"], "question_id"), "where failures lie in a run"),
    "panel-direct": Verb((*_WHO, "generation!", "contexts!", "model", "cache", "workers", "gold"), lambda s, a: _panel(s, a, ("generation",)), "judges' scores"),
    "panel-pairwise": Verb((*_WHO, "left!", "right!", "contexts!", "model", "cache", "workers", "gold"), lambda s, a: _panel(s, a, ("left", "right")), "judges' votes"),
    "judge-sanity": Verb(("name",), lambda s, a: catalog.queries()[a.name or "judge_sanity"](s, a.data), "ordering checks of judges"),
    "judge-sanity-suite": Verb((*_WHO, "model", "workers", "gold"), _sanity, "controls for judges"),
    "bertscore": Verb(("generation!", "gold"), _bertscore, "greedy matching of token vectors"),
    "run": Verb(("name!",), lambda s, a: catalog.queries()[a.name](s, a.data), "any registered query"),
}
