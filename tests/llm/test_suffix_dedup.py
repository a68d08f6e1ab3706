import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, BinaryType

from evisparq.llm import jvm, registry, suffix_dedup, windows
from evisparq.llm.suffix_dedup import remove_repeats
from evisparq.llm.windows import anchors


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter()
    for t in texts:
        seen.update(t[s : s + length] for s in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        gone = gone[: len(t)]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append(str((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_suffix_spans_against_brute_force(spark):
    jvm.register(spark, "repeat_spans", "GroupingSuffixes", ArrayType(BinaryType()))
    rng = random.Random(5)
    rows = []
    for _ in range(1500):
        letters = rng.choice(["a", "ab", "abc", "abcd\x00\xff"])
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))).encode("latin1") for _ in range(rng.randint(1, 5))]
        rows.append((texts, [rng.choice([1, 1, 1, 2]) for _ in texts], rng.randint(1, 5)))
    for r in spark.createDataFrame(rows, "t array<binary>, n array<long>, l int").selectExpr("t", "n", "l", "repeat_spans(t, n, l) s").collect():
        seen = Counter()
        for t, n in zip(r.t, r.n, strict=True):
            for s in range(len(t) - r.l + 1):
                seen[bytes(t[s : s + r.l])] += n
        for t, spans in zip(r.t, r.s, strict=True):
            want, have = np.zeros(len(t), bool), np.zeros(len(t), bool)
            for s in range(len(t) - r.l + 1):
                want[s : s + r.l] |= seen[bytes(t[s : s + r.l])] > 1
            for a, b in np.frombuffer(bytes(spans), ">i4").reshape(-1, 2):
                have[a:b] = True
            assert (want == have).all()


def test_every_start_has_one_anchor():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 300))).encode() for _ in range(60)]
    _, text, first, count, lead = anchors(texts, 50, 20)
    starts = sorted((t, f + k) for t, f, c in zip(text, first, count, strict=True) for k in range(c))
    assert starts == [(t, s) for t, x in enumerate(texts) for s in range(len(x) - 49)]
    assert ((lead >= count - 1) & (lead <= 30)).all()


def make(seed, n):
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choices("abcdefgh\xe9", k=rng.randint(1, 9))) for _ in range(k))
    passages = [words(60) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            t = rng.choice(texts)
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(0, len(t))
                t = t[:at] + rng.choice(["", "x", " new "]) + t[at + rng.randint(0, 3) :]
            texts.append(t)
        elif kind < 0.6:
            texts.append(words(rng.randint(0, 60)) + rng.choice(["", " "]) + rng.choice(passages) + words(rng.randint(0, 60)))
        elif kind < 0.65:
            texts.append(rng.choice(["ab", "xyz ", "q"]) * rng.randint(1, 400))
        else:
            texts.append(words(rng.randint(0, 150)))
    return texts


@pytest.mark.parametrize("most", [5000, 2])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    rows = list(enumerate(make(most, 250)))
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_bytes int").repartition(4)
    assert got(remove_repeats(docs)) == brute(rows)
    odd = [(None, None), (None, "a" * 201), (1, "b" * 200), (2, "c" * 199), (2, "c" * 199), (3, "z" * 5000), (4, "ab" * 3000 + "q"), (4, ""), (5, "b" * 199 + "\xe9")]
    assert got(remove_repeats(spark.createDataFrame(odd, "doc_id long, text string"))) == brute(odd)
    assert remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["a", "ab", " ", "-----+" * 40 + "\n", "abc " * 60 + "x"])
def test_long_periodic_texts(spark, part):
    n = 3_000_000 // len(part)
    rows = [(1, part * n), (2, part * (600 // len(part) + 1)), (3, "other text " + part)]
    began = time.time()
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 30
    # every string of a text of more than a period and 200 bytes starts again one period on, but for none
    assert got[1].n_bytes == got[1].n_removed == len(part) * n and got[1].n_spans == 1
    assert got[2].n_removed == got[2].n_bytes


def test_runs_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 400))).encode() for _ in range(30)] + [b"a" * 2500, b"ab" * 600]
    monkeypatch.setattr(windows, "PIECE", 300)
    found = windows.runs(texts, 50, 20)
    starts = sorted((int(t), int(f) + k) for t, f, c in zip(found.text, found.first, found.count, strict=True) for k in range(c))
    assert starts == [(t, s) for t, x in enumerate(texts) for s in range(len(x) - 49)]
    assert found.count.max() <= 2 * windows.MOST_STARTS
    # equal windows have equal hashes and lie equally far from their anchors
    seen = {}
    for i, places in enumerate(found.take(np.arange(len(found.hashes)))):
        at = np.frombuffer(places, "<u2")
        for k in range(found.count[i]):
            f = found.first[i] + k
            told = (found.hashes[i], at[np.searchsorted(at, k)] - k)
            assert seen.setdefault(texts[found.text[i]][f : f + 50], told) == told


def test_query(spark):
    at = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.queries()["op7_suffix_dedup"](spark, at)) == brute(rows)


def test_query_equals_sql(compare):
    compare("op7_suffix_dedup")
