"""A configured answering pipeline: retrieval, evidence, packing, generation and traces for a table of questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encoders as E
from ..operators import retrieval as R
from ..sources import scratch, store, tables
from . import gateway
from . import generation as N
from .indexes import sparse_index
from .registry import PipelineConfig

#: Evidence strategies of configurations, and the rankers that carry them out here.
STRATEGIES = {"sentence3": "lexical", "sentence3_cross_encoder": "lexical", "sentence3_bm25": "bm25", "full_abstract": "abstract"}


class Engine:
    """One pipeline over a folder of tables. The dense retrievers use hashed token vectors, the offline encoder."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: PipelineConfig, provider: gateway.Provider = gateway.extractive, cache_path: str | None = None) -> None:
        if config.pipeline_id == "gold_evidence_oracle":
            raise ValueError("the oracle pipeline needs annotated evidence, which questions from outside don't have")
        self.spark, self.sf_dir, self.config, self.provider, self.cache_path = spark, sf_dir, config, provider, cache_path
        self.corpus = tables.corpus(spark, sf_dir)
        self.closed_book = config.pipeline_id == "closed_book"
        self.index = None if self.closed_book else sparse_index(spark, sf_dir, config.bm25_recipe)
        self.vectors: DataFrame | None = None

    def _vectors(self) -> DataFrame:
        if self.vectors is None:
            with scratch.scope(lasting=True):  # the engine outlives the request that asks first
                self.vectors = scratch.written(E.hashed_vectors(self.corpus, R.recipe_text("title_abstract")).withColumnRenamed("doc_id", "vec_id"), "vectors")
        return self.vectors

    def contexts(self, questions: DataFrame) -> DataFrame:
        """See ``generation.prepare_contexts``."""
        c = self.config
        if self.closed_book:
            return N.oracle_contexts("closed_book", questions, None, None)
        run = None
        if c.retriever != "bm25":
            queries = E.hashed_vectors(questions.withColumnRenamed("question_id", "doc_id"), F.col("question")).select(F.col("doc_id").alias("question_id"), F.col("embedding").alias("q"))
            run = R.retrieve(c.retriever, questions, self.corpus, self._vectors(), queries, c.retrieval_k, c.bm25_recipe, self.index)
        return N.prepare_contexts(questions, self.corpus, "bm25", STRATEGIES[c.evidence_strategy], 1 if c.diversity == "source" else None, c.context_order, c.context_token_budget, c.query_strategy == "mesh", index=self.index, run=run)

    def answer(self, questions: DataFrame) -> DataFrame:
        """``context_generation`` rows of ``question_id, question`` with the documents retrieved; nothing of them is gold."""
        asked = questions.select("question_id", "question", F.lit("summary").alias("type"))
        contexts = scratch.written(self.contexts(asked), "contexts")
        rows = N.context_generation(asked, contexts, self.provider, "closed_book" if self.closed_book else "predicted_type_schema", self.config.generator_model, self.cache_path)
        found = contexts.select("question_id", "retrieved") if "retrieved" in contexts.columns else contexts.select("question_id", F.array().cast("array<bigint>").alias("retrieved"))
        return rows.join(found, "question_id")

    def answer_one(self, question: str, trace_path: str) -> dict:
        """The response to one question; a trace is appended whether it succeeds or fails, and a failure is raised after that."""
        trace_id = uuid.uuid4().hex
        asked = self.spark.createDataFrame([(0, question)], "question_id long, question string")
        row = self.answer(asked).first().asDict(recursive=True)
        row.pop("question_id")
        value = {"trace_id": trace_id, "pipeline_id": self.config.pipeline_id, "config_hash": self.config.config_hash, "question": question, **row}
        trace = self.spark.createDataFrame([(trace_id, self.config.pipeline_id, store.as_json(value))], "trace_id string, pipeline_id string, payload string")
        store.put_traces(trace.withColumn("created_at", F.current_timestamp()), trace_path)
        if row["failed"]:
            raise RuntimeError(f"{row['error_type']}: trace {trace_id}")
        return value
