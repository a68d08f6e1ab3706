"""The registered queries that SQL cannot express, against plain Python over the same tables."""

import hashlib
import json
import re
import unicodedata
from collections import Counter

import pytest

from evisparq.functions.stem import stem
from evisparq.operators import evidence
from evisparq.plans import catalog, judging, queries_runs
from evisparq.plans.queries_generation import annotations
from evisparq.sources import tables

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_normalize_question_exact(spark):
    word = re.compile(r"[\w]+(?:[-_/][\w]+)*")
    want = {r.item_id: " ".join(word.findall(unicodedata.normalize("NFKC", r.text or "").casefold())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {r.item_id: r.normalized for r in rows_of(spark, "normalize_question_exact")} == want


def test_rouge2_stemmed(spark):
    stems = lambda t: [stem(w) if len(w) > 3 else w for w in re.findall(r"[a-z0-9]+", re.sub("[Kİ]", " ", t).lower())]
    got = {r.qa_id: r for r in rows_of(spark, "rouge2_stemmed")}
    pairs = tables.answers(spark, SF).collect()
    assert len(pairs) == len(got) > 20
    for r in pairs:
        a, b = (Counter(zip(x, x[1:], strict=False)) for x in (stems(r.prediction), stems(r.reference)))
        o, na, nb = sum((a & b).values()), sum(a.values()), sum(b.values())
        p, q = (o / na if na else 0.0), (o / nb if nb else 0.0)
        assert (got[r.qa_id].precision, got[r.qa_id].recall, got[r.qa_id].f1) == tuple(pytest.approx(x, abs=1.1e-6) for x in (p, q, 2 * p * q / (p + q) if p + q else 0.0))


def shown(**parts):
    return "\n\n".join(f"{k.replace('_', ' ').upper()}\n{v or ''}" for k, v in parts.items())


def upper_median(values):
    return sorted(values)[len(values) // 2]


def scores(question, reference, context, answer):
    said = [json.loads(j("", shown(question=question, reference=reference, evidence=context, answer=answer), 1)) for j in queries_runs.JUDGES.values()]
    return [[float(x[d]) for x in said] for d in judging.DIMENSIONS]


def inputs(spark):
    ids, q, said, made = queries_runs._judged(spark, SF)
    by = lambda df, c: {r.question_id: r[c] for r in df.collect()}
    return by(q, "question"), by(q, "reference"), by(said, "answer"), by(made, "context")


def test_panel_direct_suite(spark):
    question, reference, answer, context = inputs(spark)
    got = {r.question_id: r for r in rows_of(spark, "panel_direct_suite")}
    assert set(got) == set(question)
    spreads = []
    for i, r in got.items():
        if answer[i] is None:
            assert r.failed and r.median_correctness is None
            continue
        by = scores(question[i], reference[i], context[i], answer[i])
        assert [r[f"median_{d}"] for d in judging.DIMENSIONS] == [upper_median(x) for x in by]
        spread = max(max(x) - min(x) for x in by)
        assert (r.spread, r.disagrees, r.agree_exactly, r.failed) == (spread, spread >= 1, spread == 0, False)
        spreads.append(spread)
    # the judges are two: they don't agree by construction
    assert len(set(spreads)) > 1


def test_panel_pairwise_suite(spark):
    question, reference, answer, context = inputs(spark)
    got = {r.question_id: r.winner for r in rows_of(spark, "panel_pairwise_suite")}
    assert set(got) == set(question)
    for i, won in got.items():
        if answer[i] is None:
            assert won is None
            continue
        swap = int(hashlib.sha256(f"{judging.ST.SEED}:{i}".encode()).hexdigest()[:12], 16) % 2 == 1
        votes = []
        for judge in queries_runs.JUDGES.values():
            sides = []
            for turned in (False, True):
                a, b = (answer[i], reference[i]) if swap == turned else (reference[i], answer[i])
                w = json.loads(judge("", shown(question=question[i], evidence=context[i], answer_a=a, answer_b=b), 1))["winner"]
                sides.append("tie" if w == "tie" else ("left" if (w == "A") == (swap == turned) else "right"))
            votes.append(sides[0] if sides[0] == sides[1] else "tie")
        counts = Counter(votes).most_common()
        assert won == (counts[0][0] if len(counts) == 1 or counts[0][1] > counts[1][1] else "tie")


def test_judge_sanity_suite(spark):
    q = {r.question_id: r.question for r in tables.questions(spark, SF).collect()}
    found = evidence.frozen_snippets(annotations(spark, SF), tables.corpus(spark, SF)).where("position <= 6").collect()
    got = {r.question_id: r for r in rows_of(spark, "judge_sanity_suite")}
    controls = sorted(q, key=str)[: judging.SANITY_LIMIT]
    assert set(got) == set(controls)
    for n, i in enumerate(controls):
        mine = sorted((r for r in found if r.question_id == i), key=lambda r: r.position)
        context = "\n\n".join(f"[PMID:{r.pmid or 'unknown'}] {r.snippet}" for r in mine)
        good = n % 2 == 0
        medians = [upper_median(x) for x in scores(q[i], q[i], context, q[i] if good else judging.IRRELEVANT)]
        assert got[i].expected == ("good" if good else "bad")
        assert got[i].passed == (min(medians) >= judging.GOOD_FROM if good else max(medians) <= judging.BAD_UPTO)
