import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from evisparq.llm import resampling
from evisparq.llm.resampling import resample


def brute(docs, target, size=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, size + 1) for i in range(len(w) - n + 1)]

    mine, theirs = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = Counter(b for _, f in mine for b in f), Counter(b for _, f in theirs for b in f)
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for (i, _), (n, f) in zip(docs, mine, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    rank = {id(r): k + 1 for k, r in enumerate(able[:drawn])}
    return sorted(str((*r[:4], rank.get(id(r)))) for r in rows)


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def texts(seed, n, top):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a1", "é", "ÀB", "x_y", "z\x7fq", "日本", *(f"w{i}" for i in range(60))]
    return [rng.choice([" ", "-", ", "]).join(rng.choices(vocabulary[:top], k=rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 3])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 2000)
    docs = list(enumerate(texts(size, 300, 60))) + [(500, None), (501, ""), (502, "!!"), (503, "long " * 30_000)]
    target = texts(9, 20, 20)
    made = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, score int").repartition(4)
    theirs = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample(made, theirs, size=size, buckets=500, percent=30)) == brute(docs, target, size, 500, 30)


def test_odd_tables(spark):
    docs = [(None, "one two " * 12), (None, "one two " * 12), (3, "one two " * 12), (3, "One Two " * 12), (4, None), (5, "one")]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(resample(made, none, percent=60)) == brute(docs, [], percent=60)
    assert got(resample(made, spark.createDataFrame([(1, None)], none.schema), percent=60)) == brute(docs, [None], percent=60)
    assert got(resample(made, none, percent=60, least=0)) == brute(docs, [], percent=60, least=0)
    assert resample(made.limit(0), none).collect() == []


def test_query_equals_sql(compare):
    compare("op12_resampling")
