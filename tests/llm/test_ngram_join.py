import random
import re

import numpy as np

from evisparq.llm import ngram_join, registry
from evisparq.llm.ngram_join import near_groups
from evisparq.llm.shingles import shingles


def sets_of(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(str((k, len(sets[i]), least.get(root(i)))) for i, (k, _) in enumerate(rows))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def make(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        elif kind < 0.6:
            texts.append(" ".join(passage + rng.choices(vocab, k=rng.randint(0, 30))))
        else:
            texts.append(" ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 4, 5, 6, 20, 50, 120]))))
    return texts


def test_shingles_are_distinct_sets():
    texts = make(1, 200) + ["", "A b", "a B", " x\x0b y\t", "é" * 9]
    value, docs = shingles([t.encode() for t in texts])
    assert np.bincount(docs, minlength=len(texts)).tolist() == [len(sets_of(t)) for t in texts]
    names = {}
    mine = [set(value[docs == i].tolist()) for i in range(len(texts))]
    for i, t in enumerate(texts):
        names.setdefault(frozenset(sets_of(t)), set()).add(frozenset(mine[i]))
    assert all(len(x) == 1 for x in names.values())
    assert len(set().union(*mine)) == len(set().union(*map(sets_of, texts)))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 4000)
    for seed in (1, 2):
        rows = list(enumerate(make(seed, 400)))
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n int").repartition(5)
        assert got(near_groups(docs)) == brute(rows)
    odd = [(None, "a b c d e f g"), (None, None), (4, "a b c d e f g"), (4, "A b c d e f g"), (4, "zz"), (2, ""), (2, ""), (9, "q " * 30_000), (8, "q " * 29_000)]
    assert got(near_groups(spark.createDataFrame(odd, "doc_id long, text string"))) == brute(odd)
    assert near_groups(docs.limit(0)).count() == 0


def test_group_just_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for d in range(400):
        w = list(base)
        for i in rng.sample(range(0, 200, 5), 8):
            w[i] = f"own{d}x{i}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join(base[:190] + [f"end{d}y{i}" for i in range(10)])) for d in range(30)]
    counted = {}
    plain = ngram_join.scratch.written

    def keep(df, name, rows=None):
        counted[name] = plain(df, name, rows)
        return counted[name]

    monkeypatch.setattr(ngram_join.scratch, "written", keep)
    assert got(near_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert counted["pairs1"].count() < 20 * len(rows) and counted["pairs2"].count() < 20 * len(rows)


def test_query(spark):
    at = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.queries()["op6_ngram_join"](spark, at)) == brute(rows)


def test_query_equals_sql(compare):
    compare("op6_ngram_join")
