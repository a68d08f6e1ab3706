import hashlib
import random
from collections import Counter

import pytest

from evisparq.llm import debruijn, registry
from evisparq.llm.debruijn import compacted, doubled, remove_spans


def brute(rows, length=35):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(t[s : s + length]) for t in texts for s in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = set()
        for s in range(len(t) - length + 1):
            if seen[tuple(t[s : s + length])] > 1:
                gone.update(range(s, s + length))
        kept = [w for k, w in enumerate(t) if k not in gone]
        out.append(str((i, len(t), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())))
    return sorted(out)


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def make(seed, n):
    rng = random.Random(seed)
    words = lambda k, letters="abcdefgh\xe9": [("".join(rng.choices(letters, k=rng.randint(1, 4)))) for _ in range(k)]
    passages = [words(rng.randint(30, 90)) for _ in range(5)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 2)):
                t.insert(rng.randint(0, len(t)), "new")
            texts.append(rng.choice([" ", "  ", "\n"]).join(t))
        elif kind < 0.6:
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            texts.append(" ".join(words(rng.randint(0, 60)) + p[a : rng.randint(a + 5, len(p))] + words(rng.randint(0, 60))))
        elif kind < 0.7:
            texts.append(" ".join(words(rng.randint(1, 40), "ab") * rng.randint(1, 6)))
        elif kind < 0.75:
            texts.append(rng.choice(["a ", "a b ", "a b b "]) * rng.randint(1, 200))
        else:
            texts.append(" ".join(words(rng.randint(0, 200))))
    return texts


@pytest.mark.parametrize("gram", [16, 2])
def test_against_brute_force(spark, monkeypatch, gram):
    monkeypatch.setattr(debruijn, "CHUNK_BYTES", 3000)
    rows = list(enumerate(make(gram, 250)))
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_words int").repartition(4)
    assert got(remove_spans(docs, gram=gram)) == brute(rows)


def test_odd_rows(spark):
    odd = [(None, None), (None, "a " * 40), (1, "b " * 35), (2, "c " * 34), (2, "c " * 34), (3, "z " * 5000), (4, "a b " * 3000 + "q"), (4, ""), (5, "\t \n"), (6, "x" * 300_000), (7, "x" * 300_000)]
    odd += [(8, " ".join(map(str, range(80)))), (8, "\n".join(map(str, range(80)))), (9, "0 " + " ".join(map(str, range(20, 70))) + " é")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    assert got(remove_spans(docs)) == brute(odd)
    assert remove_spans(docs.limit(0)).count() == 0


def test_hashes_that_collide_are_noticed(spark, monkeypatch):
    seeds = []
    plain, attempt = debruijn.word_hashes, debruijn._attempt

    def clumsy(raw, starts, ends, seed):
        # with the first seed all words of one length are taken for equal
        return plain(b"x" * len(raw) if seed == 0 else raw, starts, ends, seed)

    monkeypatch.setattr(debruijn, "word_hashes", clumsy)
    monkeypatch.setattr(debruijn, "_attempt", lambda *a: (seeds.append(a[-1]), attempt(*a))[1])
    rng = random.Random(4)
    passages = [" ".join("".join(rng.choices("abc", k=2)) for _ in range(60)) for _ in range(3)]
    rows = [(i, f"{'w' * i} {p} {i}") for i, p in enumerate([*passages, *passages])]
    assert got(remove_spans(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert seeds == [0, 1]


def test_paths(spark):
    # 1 -> 2 -> 3 -> 4, 3 -> 5 -> 6, a ring 7 -> 8 -> 7; at: sources of each edge
    edges = [(12, 1, 2, (0, 0)), (23, 2, 3, (0, 1)), (34, 3, 4, (0, 2)), (35, 3, 5, (4, 9)), (56, 5, 6, (3, 1)), (78, 7, 8, (1, 1)), (87, 8, 7, (1, 2))]
    rows = spark.createDataFrame(edges, "edge long, src long, dst long, at struct<key:long,pos:int>")
    found = {r.edge: (r.path, r.place) for r in compacted(rows).collect()}
    assert found[12] == (12, 0) and found[23] == (12, 1)
    assert found[34] == (34, 0)
    assert found[35] == (35, 0) and found[56] == (35, 1)
    assert set(found) == {12, 23, 34, 35, 56, 78, 87}


def test_pointers_double(spark):
    chain = [(i, i - 1 if i else None, 2 if i else 0) for i in range(37)] + [(50, 51, 1), (51, 50, 1)]
    found = {r.head: (r.top, r.distance) for r in doubled(spark.createDataFrame(chain, "head long, parent long, distance long")).collect()}
    assert found == {i: (0, 2 * i) for i in range(37)} | {50: (50, 0), 51: (51, 0)}


def test_query_equals_sql(compare):
    compare("op13_debruijn")
