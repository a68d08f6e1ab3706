"""Panels of judges over finished runs: direct scores, paired comparisons and a sanity suite.

A judge is a provider (see ``gateway``) under a name. The offline judges compare words and phrases and say nothing about a model's judgement.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import stats as ST
from ..sources import scratch
from . import gateway, guards

#: What is scored, the scale, and the share of control answers that must be judged rightly.
DIMENSIONS = ("correctness", "completeness", "evidence_faithfulness")
LEAST, MOST = 0, 3
GOOD_FROM, BAD_UPTO, REQUIRED_PASS_RATE = 2, 1, 0.90
SANITY_LIMIT, SANITY_EVIDENCE = 40, 6
IRRELEVANT = "The answer is about the orbits of planets and has nothing to do with what was asked."

DIRECT_SCHEMA = "supported_claims array<string>, unsupported_claims array<string>, reference_discrepancies array<string>, justification string, correctness double, completeness double, evidence_faithfulness double"
PAIR_SCHEMA = "evidence_comparison string, justification string, winner string"

DIRECT_PROMPT = (
    "You judge an answer without knowing who wrote it. List its claims that the evidence supports and those that it does not, and where it differs "
    f"from the reference. Then score {', '.join(DIMENSIONS)} from {LEAST} to {MOST}. Faithfulness is judged on the evidence alone. Reply with one JSON object of "
    "supported_claims, unsupported_claims, reference_discrepancies, justification, correctness, completeness, evidence_faithfulness."
)
PAIR_PROMPT = "Compare answers A and B on the evidence; length is no merit. Reply with one JSON object of evidence_comparison, justification and winner, which is A, B or tie."

_PART = re.compile(r"(?:\A|\n\n)(QUESTION|REFERENCE|EVIDENCE|ANSWER(?: [AB])?)\n")
_WORD = re.compile(r"[^\W_]+")


def _parts(user: str, units: Callable[[list[str]], set[str]]) -> dict[str, set[str]]:
    cuts = _PART.split(user)
    return {name: units(_WORD.findall(text.lower())) for name, text in zip(cuts[1::2], cuts[2::2], strict=True)}


def _judgement(user: str, units: Callable[[list[str]], set[str]]) -> str:
    parts = _parts(user, units)
    evidence, reference = parts.get("EVIDENCE", set()), parts.get("REFERENCE", set())
    share = lambda a, b: len(a & b) / len(a) if a else 0.0
    if "ANSWER A" in parts:
        a, b = share(parts["ANSWER A"], evidence), share(parts["ANSWER B"], evidence)
        return json.dumps({"evidence_comparison": f"{a:.3f} against {b:.3f}", "justification": "shares", "winner": "tie" if a == b else "A" if a > b else "B"})
    answer = parts.get("ANSWER", set())
    grade = lambda x: LEAST + round((MOST - LEAST) * min(1.0, x))
    scores = {"correctness": grade(share(answer, reference | evidence)), "completeness": grade(2 * share(reference, answer)), "evidence_faithfulness": grade(share(answer, evidence | reference))}
    return json.dumps({"supported_claims": sorted(answer & evidence)[:2], "unsupported_claims": sorted(answer - evidence)[:2], "reference_discrepancies": [], "justification": "shares", **scores})


def word_judge(system: str, user: str, attempt: int) -> str:
    """An offline judge: shares of an answer's words in the evidence and the reference."""
    return _judgement(user, set)


def phrase_judge(system: str, user: str, attempt: int) -> str:
    """Another one: shares of an answer's pairs of neighbouring words, which it finds less often."""
    return _judgement(user, lambda words: {" ".join(x) for x in zip(words, words[1:], strict=False)})


def _check_direct(raw: str) -> None:
    value = gateway.json_object(raw)
    if any(not LEAST <= float(value[d]) <= MOST for d in DIMENSIONS):
        raise ValueError("a score is off the scale")


def _check_pair(raw: str) -> None:
    if gateway.json_object(raw)["winner"] not in ("A", "B", "tie"):
        raise ValueError("no winner")


def _asked(prompts: DataFrame, judges: dict[str, gateway.Provider], check, cache_path: str | None, workers: int, pause: float) -> DataFrame:
    """The prompts' rows once a judge, with its response."""
    if not judges:
        raise ValueError("a panel has at least one judge")
    each = [gateway.call(prompts.withColumn("judge", F.lit(name)), provider, name, cache_path, check, workers, pause=pause) for name, provider in judges.items()]
    body = F.regexp_extract("raw", r"(?s)\{.*\}", 0)
    return reduce(DataFrame.unionByName, each).withColumn("body", F.nullif(body, F.lit("")))


def _lines(**parts: Column) -> Column:
    return F.concat_ws("\n\n", *[F.concat(F.lit(name.replace("_", " ").upper() + "\n"), F.coalesce(c, F.lit(""))) for name, c in parts.items()])


def direct(rows: DataFrame, judges: dict[str, gateway.Provider], cache_path: str | None = None, workers: int = 8, pause: float = gateway.PAUSE) -> DataFrame:
    """Judgements of ``question_id, question, answer, reference, evidence``: by question and judge ``judge, correctness, completeness, evidence_faithfulness,
    unsupported_rate, failed, error_type``. A null answer is an upstream failure and isn't judged."""
    ready = rows.where("answer IS NOT NULL")
    user = _lines(question=F.col("question"), reference=F.col("reference"), evidence=F.col("evidence"), answer=F.col("answer"))
    said = _asked(ready.select("question_id", F.lit(DIRECT_PROMPT).alias("system"), user.alias("user")), judges, _check_direct, cache_path, workers, pause).withColumn("j", F.from_json("body", DIRECT_SCHEMA))
    supported, unsupported = (F.size(F.coalesce(F.col(f"j.{c}"), F.array().cast("array<string>"))) for c in ("supported_claims", "unsupported_claims"))
    rate = F.when(supported + unsupported > 0, unsupported / (supported + unsupported)).otherwise(0.0)
    return said.select("question_id", "judge", *[F.col(f"j.{d}").alias(d) for d in DIMENSIONS], F.when(F.col("raw").isNotNull(), rate).alias("unsupported_rate"), F.col("raw").isNull().alias("failed"), "error_type")


def direct_panel(rows: DataFrame, judgements: DataFrame) -> DataFrame:
    """One row a question of ``rows``: upper medians by dimension, the largest range, disagreement, exact agreement, the median share of unsupported claims, ``failed``.

    A question fails if its answer is missing or any judge failed on it.
    """
    by = judgements.groupBy("question_id").agg(
        F.max("failed").alias("judge_failed"),
        *[F.array_sort(F.collect_list(d)).alias(d) for d in (*DIMENSIONS, "unsupported_rate")],
    )
    upper = lambda c: F.get(c, F.floor(F.size(c) / 2).cast("int"))
    spread = F.greatest(*[F.array_max(d) - F.array_min(d) for d in DIMENSIONS])
    failed = F.coalesce("judge_failed", F.lit(True))
    value = lambda c: F.when(~failed, c)
    return rows.select("question_id").join(by, "question_id", "left").select(
        "question_id",
        *[value(upper(d)).alias(f"median_{d}") for d in DIMENSIONS],
        value(upper("unsupported_rate")).alias("median_unsupported_rate"),
        value(spread).alias("spread"),
        value(spread >= 1).alias("disagrees"),
        value(spread == 0).alias("agree_exactly"),
        failed.alias("failed"),
    )


def direct_suite(ids: DataFrame, questions: DataFrame, generated: DataFrame, contexts: DataFrame, judges: dict[str, gateway.Provider], **options) -> tuple[DataFrame, DataFrame]:
    """Panel rows by question, and a summary row with agreement rates and an ordinal alpha for each dimension.

    ``questions`` has ``question_id, question, reference``, ``generated`` ``question_id, answer`` (null if it failed), ``contexts`` ``question_id, context``; all
    must have exactly the ids asked for.
    """
    guards.covers(ids, questions=questions, generated=generated, contexts=contexts)
    rows = ids.join(questions, "question_id").join(generated.select("question_id", "answer"), "question_id").join(contexts.select("question_id", F.col("context").alias("evidence")), "question_id")
    judged = scratch.written(direct(rows, judges, **options), "judged")
    panel = scratch.written(direct_panel(rows, judged), "panel")
    good = panel.where("NOT failed")
    none = ids.sparkSession.createDataFrame([(0.0,)], "alpha double")
    known = not good.isEmpty()
    alphas = [ST.krippendorff_ordinal(judged.join(good.select("question_id"), "question_id", "left_semi").select(F.col("question_id").alias("unit"), F.col(d).alias("score"))) if known else none for d in DIMENSIONS]
    alphas = [a.select(F.col("alpha").alias(f"alpha_{d}")) for a, d in zip(alphas, DIMENSIONS, strict=True)]
    rate = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6)
    summary = panel.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("failed").alias("failures"),
        *[F.coalesce(F.median(f"median_{d}"), F.lit(0.0)).alias(f"median_{d}") for d in DIMENSIONS],
        F.round(F.coalesce(F.avg("median_unsupported_rate"), F.lit(1.0)), 6).alias("mean_unsupported_rate"),
        rate("disagrees").alias("disagreement_rate"),
        rate("agree_exactly").alias("exact_agreement_rate"),
    )
    return panel, reduce(lambda a, b: a.join(b, how="cross"), alphas, summary)


def pairwise(rows: DataFrame, judges: dict[str, gateway.Provider], seed: int = ST.SEED, cache_path: str | None = None, workers: int = 8, pause: float = gateway.PAUSE) -> DataFrame:
    """Votes on ``question_id, question, left, right, evidence``: by question and judge ``vote`` (left, right or tie), null if the judge failed in either order."""
    swap = P.swapped("question_id", seed)
    first, second = F.when(swap, F.col("right")).otherwise(F.col("left")), F.when(swap, F.col("left")).otherwise(F.col("right"))
    shown = lambda a, b: _lines(question=F.col("question"), evidence=F.col("evidence"), answer_a=a, answer_b=b)
    ready = rows.where("left IS NOT NULL AND right IS NOT NULL")
    orders = ready.select("question_id", swap.alias("swap"), F.explode(F.array(F.struct(F.lit(False).alias("turned"), shown(first, second).alias("user")), F.struct(F.lit(True).alias("turned"), shown(second, first).alias("user")))).alias("x"))
    prompts = orders.select("question_id", "swap", "x.turned", "x.user", F.lit(PAIR_PROMPT).alias("system"))
    said = _asked(prompts, judges, _check_pair, cache_path, workers, pause).withColumn("winner", F.from_json("body", PAIR_SCHEMA)["winner"])
    side = F.when(F.col("raw").isNotNull(), P.unmask(F.col("winner"), F.col("swap") != F.col("turned")))
    both = said.withColumn("side", side).groupBy("question_id", "judge").agg(F.max(F.when(~F.col("turned"), F.col("side"))).alias("a"), F.max(F.when(F.col("turned"), F.col("side"))).alias("b"))
    return both.select("question_id", "judge", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), P.consistent(F.col("a"), F.col("b"))).alias("vote"))


def pairwise_suite(ids: DataFrame, questions: DataFrame, left: DataFrame, right: DataFrame, contexts: DataFrame, judges: dict[str, gateway.Provider], **options) -> tuple[DataFrame, DataFrame]:
    """``question_id, winner, failed`` and a summary row of winners; ``left`` and ``right`` have ``question_id, answer``."""
    guards.covers(ids, questions=questions, left=left, right=right, contexts=contexts)
    name = lambda df, c: df.select("question_id", F.col("answer").alias(c))
    rows = ids.join(questions.select("question_id", "question"), "question_id").join(name(left, "left"), "question_id").join(name(right, "right"), "question_id").join(contexts.select("question_id", F.col("context").alias("evidence")), "question_id")
    votes = scratch.written(pairwise(rows, judges, **options), "votes")
    whole = votes.groupBy("question_id").agg(F.count_if(F.col("vote").isNull()).alias("lost")).where("lost = 0")
    won = P.winner(votes.join(whole.select("question_id"), "question_id", "left_semi"), "question_id")
    panel = scratch.written(ids.join(won, "question_id", "left").withColumn("failed", F.col("winner").isNull()), "panel")
    summary = panel.agg(F.count(F.lit(1)).alias("questions"), F.count_if("failed").alias("failures"), *[F.count_if(F.col("winner") == w).alias(f"{w}_wins") for w in ("left", "right", "tie")])
    return panel, summary


def sanity_suite(questions: DataFrame, annotations: DataFrame, judges: dict[str, gateway.Provider], limit: int = SANITY_LIMIT, **options) -> tuple[DataFrame, DataFrame]:
    """Controls in turn: the reference as the answer must score high in every dimension, an irrelevant answer low.

    ``questions`` has ``question_id, question, reference``, ``annotations`` ``question_id, position, pmid, snippet``, of which the first few are the evidence. The
    result: ``question_id, expected, passed, failed`` and a summary row with the verdict.
    """
    if not 1 <= limit <= SANITY_LIMIT:
        raise ValueError(f"the limit must be 1 to {SANITY_LIMIT}")
    ids = scratch.written(scratch.numbered(questions.select("question_id"), [F.col("question_id").cast("string")], "i").where(F.col("i") < limit), "controls")
    block = F.concat(F.lit("[PMID:"), F.coalesce("pmid", F.lit("unknown")), F.lit("] "), F.col("snippet"))
    evidence = annotations.where(F.col("position") <= SANITY_EVIDENCE).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("evidence"))
    good = F.col("i") % 2 == 0
    rows = ids.join(questions, "question_id").join(evidence, "question_id", "left").select("question_id", "question", "reference", F.coalesce("evidence", F.lit("")).alias("evidence"), F.when(good, F.col("reference")).otherwise(IRRELEVANT).alias("answer"), F.when(good, "good").otherwise("bad").alias("expected"))
    panel = direct_panel(rows, scratch.written(direct(rows, judges, **options), "judged"))
    medians = [F.col(f"median_{d}") for d in DIMENSIONS]
    right = F.when(F.col("expected") == "good", F.least(*medians) >= GOOD_FROM).otherwise(F.greatest(*medians) <= BAD_UPTO)
    told = scratch.written(rows.select("question_id", "expected").join(panel, "question_id").select("question_id", "expected", F.coalesce(~F.col("failed") & right, F.lit(False)).alias("passed"), "failed"), "sanity")
    share = F.avg(F.col("passed").cast("double"))
    return told, told.agg(F.count(F.lit(1)).alias("questions"), F.round(share, 6).alias("pass_rate"), F.round(F.avg(F.col("failed").cast("double")), 6).alias("failure_rate"), (share >= REQUIRED_PASS_RATE).alias("passed"))
