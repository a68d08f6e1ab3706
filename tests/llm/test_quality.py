import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from evisparq.llm import registry
from evisparq.llm.quality import RULES, fit, quality, scored


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if three[(w[i], w[i + 1], w[i + 2])] > 1 for k in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c"), (5, "x x x x"), (6, "one\ntwo\none\n\n \n \none "), (7, "a # b $ | <> é ü 日本"), (None, "w " * 60), (8, "a b"), (8, "a b"), (9, "a b c"), (10, "a\x0bb\x0cc\rd"), (11, "the end of all the end of it the end of"), (12, " ".join(f"w{i % 4000}" for i in range(20_000)))]


def test_counts(spark):
    docs = spark.createDataFrame([(*r, 5, "z") for r in ROWS], "doc_id long, text string, n_words int, row string").repartition(3)
    got = [tuple(r)[:7] for r in quality(docs).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *counts(t))) for i, t in ROWS)
    assert quality(docs.limit(0)).count() == 0


def plain_fit(patterns, rules):
    """The same model, document by document: class shares and vote shares of soft labels, until they settle."""
    docs = [p for p, n in patterns.items() for _ in range(n)]
    bad = [sum(v < 0 for v in p) / sum(v != 0 for v in p) if any(p) else 0.5 for p in docs]
    for _ in range(200):
        share = (sum(bad) + 1) / (len(docs) + 2)
        table = {}
        for j in range(rules):
            for name, weights, prior in (("bad", bad, {-1: 1.0, 0: 0.5, 1: 0.25}), ("good", [1 - b for b in bad], {-1: 0.25, 0: 0.5, 1: 1.0})):
                counts = {v: prior[v] + sum(w for w, p in zip(weights, docs, strict=True) if p[j] == v) for v in (-1, 0, 1)}
                for v in counts:
                    table[name, j, v] = counts[v] / sum(counts.values())
        new = []
        for p in docs:
            b, g = share, 1 - share
            for j, v in enumerate(p):
                b, g = b * table["bad", j, v], g * table["good", j, v]
            new.append(b / (b + g))
        settled = max(abs(x - y) for x, y in zip(bad, new, strict=True)) < 1e-6
        bad = new
        if settled:
            break
    return dict(zip(docs, bad, strict=True))


def posterior(fitted, p):
    prior, ratios = fitted
    return 1 / (1 + math.exp(prior + sum(r[v] for r, v in zip(ratios, p, strict=True))))


PATTERNS = {(1, 1, 1, 1): 900, (0, 1, 1, 1): 50, (-1, 1, 1, 1): 60, (1, -1, -1, 1): 40, (1, -1, -1, -1): 30, (-1, -1, 1, -1): 20, (0, 1, -1, -1): 15, (0, 0, 0, 0): 3}


def test_fit_equals_plain_model_and_outvotes_one_weak_vote():
    fitted = fit(PATTERNS, 4)
    want = plain_fit(PATTERNS, 4)
    assert all(abs(posterior(fitted, p) - want[p]) < 1e-4 for p in PATTERNS)
    # the first rule's bad votes come with good votes of the others, and don't reject; those that go together do
    assert want[(-1, 1, 1, 1)] < 0.5 and want[(1, 1, 1, 1)] < 0.05
    assert all(want[p] > 0.5 for p in ((1, -1, -1, 1), (1, -1, -1, -1), (-1, -1, 1, -1), (0, 1, -1, -1)))
    assert fit({}, 4)[1][0][-1] is not None


def test_one_weak_bad_vote_is_outvoted(spark):
    draw = random.Random(2)
    prose = lambda n: " ".join(draw.choice(("the", "of", "and", "to")) + f" word{draw.randint(1, 5000)} text{draw.randint(1, 5000)}" + ("." if i % 4 == 0 else "") for i in range(n // 3))
    rows = [(i, prose(240)) for i in range(300)]
    rows += [(1000 + i, prose(66)) for i in range(30)]  # short, and otherwise good
    rows += [(2000 + i, " | ".join(f"item{draw.randint(1, 10_000)}" for _ in range(150))) for i in range(30)]
    rows += [(3000 + i, " ".join(f"w{draw.randint(1, 10_000)}###" for _ in range(150))) for i in range(30)]
    got = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (i < 2000) for i in got)


def test_query(spark):
    at = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registry.queries()["op10_quality"](spark, at).collect()}
    rows = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        assert tuple(got[i])[1:7] == counts(t)
    votes = scored(spark.read.parquet(f"{at}/documents.parquet"), carried=["doc_id"])
    one_bad = sum((F.col(r) == -1).cast("int") for r in RULES) >= 1
    assert votes.where(one_bad & F.col("kept")).count() > 0  # not a conjunction of rules
    labels = spark.read.parquet(f"{at}/labels.parquet").collect()
    judged = [(r.quality, got[r.doc_id].kept) for r in labels if not got[r.doc_id].base_failed]
    good = [k for q, k in judged if q]
    bad = [k for q, k in judged if not q]
    assert sum(good) / len(good) >= 0.99 and sum(bad) / len(bad) <= 0.02, (sum(good), len(good), sum(bad), len(bad))
