"""The test tables in the roles of a corpus, questions, relevance judgements and vectors.

Each reader has its SQL twin in ``SQL``, so that queries and their checks start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: The first words of a text, which make its title.
TITLE_WORDS = 12
HEAD = rf"^[ \n]*((?:[^ \n]+[ \n]+){{0,{TITLE_WORDS - 1}}}[^ \n]+)"
#: Rows of a narrow table that may be broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of such a table, about.
BROADCAST_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, pmid, title, text, url, publication_date, mesh_terms``."""
    head = F.regexp_extract(F.coalesce("text", F.lit("")), HEAD, 1)
    words = F.when(head == "", F.array().cast("array<string>")).otherwise(F.split(head, "[ \n]+"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), words.alias("w"))
    pairs = F.filter(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 3, 2), " ")), lambda x: x != "")
    return rows.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("pmid"),
        F.array_join("w", " ").alias("title"),
        "text",
        F.concat(F.lit("https://example.org/doc/"), F.col("doc_id").cast("string"), F.lit("/")).alias("url"),
        F.concat((1990 + F.col("doc_id") % 35).cast("string"), F.lit("-01")).alias("publication_date"),
        pairs.alias("mesh_terms"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question_id, question, type``: the gold-free view of the benchmark."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("yesno", "factoid", "list", "summary")]), (F.col("item_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), kind.alias("type"))


def _width(df: DataFrame) -> Column:
    """Bytes of a row's texts, and eight for each other value."""
    total = F.lit(0)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind == "array<string>":
            total = total + F.coalesce(F.octet_length(F.array_join(name, "")), F.lit(0))
        elif kind.startswith("array"):
            total = total + 8 * F.greatest(F.size(name), F.lit(0))
        else:
            total = total + 8
    return total.cast("long")


def sized(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if no more than ``limit`` rows with ``most_bytes`` are found, else as it is, to be shuffled."""
    rows, size = df.select(_width(df).alias("w")).limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= most_bytes else df


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question_id, doc_id, begin, end``: documents that contain the question's text, and where.

    A question's longest inner word stands whole in every text that contains it, so that texts and questions meet on that
    word before texts are searched. Questions of fewer than three words have none, and are compared with every text.
    """
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle")).where("needle <> ''")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = F.split("needle", "[ \n]")
    inner = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = items.select("item_id", "needle", longest.alias("word"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \n]"))).alias("word"))
    pairs = scratch.written(words.join(sized(keyed.where("word IS NOT NULL")), "word").select("doc_id", "item_id", "needle"), "pairs")
    long = docs.join(sized(pairs), "doc_id").where(F.contains("text", "needle"))
    few = keyed.where("word IS NULL").select("item_id", "needle")
    found = long.select("doc_id", "text", "item_id", "needle")
    if not few.isEmpty():
        found = found.unionByName(docs.join(sized(few), F.contains("text", "needle")))
    begin = F.instr("text", F.col("needle")) - 1
    return found.select(F.col("item_id").alias("question_id"), "doc_id", begin.cast("int").alias("begin"), (begin + F.length("needle")).cast("int").alias("end"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qa_id, prediction, reference``: an assistant's turn and the user's turn before it."""
    turns = read(spark, sf_dir, "conversations")
    said = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"))
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return said.join(asked, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), F.coalesce("prediction", F.lit("")).alias("prediction"), F.coalesce("reference", F.lit("")).alias("reference"))


#: The same roles in DuckDB, as common table expressions.
SQL = {
    "corpus": r"""corpus AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, array_to_string(w, ' ') AS title, text,
         'https://example.org/doc/' || doc_id || '/' AS url, (1990 + doc_id % 35) || '-01' AS publication_date,
         list_filter([array_to_string(w[1:2], ' '), array_to_string(w[3:4], ' ')], lambda x: x <> '') AS mesh_terms
  FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(regexp_extract(coalesce(text, ''), '^[ \n]*((?:[^ \n]+[ \n]+){0,11}[^ \n]+)', 1), '[^ \n]+') AS w FROM documents))""",
    "questions": """questions AS (
  SELECT item_id AS question_id, text AS question, (['yesno', 'factoid', 'list', 'summary'])[item_id % 4 + 1] AS type FROM benchmark)""",
    "qrels": """qrels AS (
  SELECT b.item_id AS question_id, d.doc_id, CAST(instr(d.text, b.text) - 1 AS INTEGER) AS "begin",
         CAST(instr(d.text, b.text) - 1 + length(b.text) AS INTEGER) AS "end"
  FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text))""",
    "answers": """answers AS (
  SELECT a.conv_id * 1000 + a.turn AS qa_id, coalesce(a.text, '') AS prediction, coalesce(u.text, '') AS reference
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE a.role = 'assistant' AND u.role = 'user')""",
}


def with_sql(*names: str, rest: str = "") -> str:
    """A WITH clause of the named roles and further expressions."""
    return "WITH " + ",\n".join([SQL[n] for n in names] + ([rest] if rest else []))
