"""The corpus pipeline: five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return
the columns of documents. Decisions travel as narrow tables of ids and text hashes; the documents that go are joined
as a broadcast list only while that is small, else by a shuffle.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisparq.llm import scratch
from evisparq.llm.exact_dedup import exact_groups
from evisparq.llm.mixing import mix, row_key
from evisparq.llm.ngram_join import near_groups
from evisparq.llm.packing import pack
from evisparq.llm.quality import scored

#: SQL has no form of the fitted rules, the shuffled mix or the packing; tests compare with brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """``docs`` without the rows listed in ``gone``, compared null-safely on columns that ``docs`` has as well."""
    listed = scratch.written(gone, "gone").distinct()
    listed = scratch.sized(listed.select(*[F.col(c).alias(f"_evisparq_gone_{c}") for c in on]))
    same = None
    for c in on:
        equal = F.col(c).eqNullSafe(F.col(f"_evisparq_gone_{c}"))
        same = equal if same is None else same & equal
    return docs.join(listed, same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The verdict depends on the text, so that rejected texts are listed by their hash."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("_evisparq_sha")
    gone = scored(docs.select(digest, "text"), carried=["_evisparq_sha"]).where("NOT kept").select("row._evisparq_sha")
    return _without(docs.withColumn("_evisparq_sha", digest), gone, ["_evisparq_sha"]).select(*docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a ``_evisparq_key`` of its own for each row, and whether that is the id, as it is where ids are unique; else rows are numbered and written."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    if ids.where("id IS NULL OR c > 1").isEmpty():
        return docs.withColumn("_evisparq_key", F.col("doc_id").cast("long")), True
    return scratch.written(docs.withColumn("_evisparq_key", F.monotonically_increasing_id()), "numbered"), False


def _others(keyed: DataFrame, groups: DataFrame, largest: bool) -> DataFrame:
    """The keys of all rows of ``groups`` (key, of) but one of each ``of``: that with the largest id (or the smallest), rows without an id last."""
    groups = scratch.written(groups, "groups")
    rows = keyed.select(F.col("_evisparq_key").alias("key"), F.col("doc_id").cast("long").alias("id")).join(groups, "key")
    order = F.struct(F.col("id").isNull() != F.lit(largest), "id", "key")
    stays = rows.groupBy("of").agg((F.max if largest else F.min)(order)["key"].alias("key"))
    return groups.join(stays.select("key"), "key", "left_anti").select(F.col("key").alias("_evisparq_key"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest id. A row without an id stays only if none of its text has one, and then one row does."""
    keyed, unique = _keyed(docs)
    groups = exact_groups(keyed, id_col="_evisparq_key")
    if unique:
        gone = groups.where("NOT kept").select(F.col("doc_id").alias("_evisparq_key"))
    else:
        gone = _others(keyed, groups.where("group_size > 1").select(F.col("doc_id").alias("key"), F.col("text_sha256").alias("of")), True)
    return _without(keyed, gone, ["_evisparq_key"]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: that with the smallest id, or any if none has one."""
    keyed, unique = _keyed(docs)
    groups = near_groups(keyed, id_col="_evisparq_key")
    if unique:
        gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_evisparq_key"))
    else:
        gone = _others(keyed, groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("of")), False)
    return _without(keyed, gone, ["_evisparq_key"]).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the words taken over its size, rounded; a repeat is a row of its own.

    Rows lie in the order of the schedule, each repeat at the slot of its own. Documents without words and those that their source's target leaves no room for go.
    """
    taken = mix(docs, with_key=True).where("size > 0 AND taken > 0")
    laps = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")
    # rows that are alike in id and text share their key, and are taken alike
    times = taken.groupBy(F.col("key").alias("_evisparq_key")).agg(F.max(F.struct(laps, "slots")).alias("_evisparq_laps")).where("_evisparq_laps.times > 0")
    rows = docs.withColumn("_evisparq_row", row_key("doc_id", "text")).join(times, F.col("_evisparq_row") == F.col("_evisparq_key"))
    rows = rows.withColumn("_evisparq_slot", F.explode(F.slice("_evisparq_laps.slots", F.lit(1), F.col("_evisparq_laps.times"))))
    return rows.orderBy("_evisparq_slot", "_evisparq_row").select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return docs
