import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evisparq.llm import registry
from evisparq.llm.packing import Complements, best_fit_steps, exact_steps, make_plan, pack


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_uses_every_piece_once(lengths):
    counts = [0] * 41
    for x in lengths:
        counts[x] += 1
    used = Counter()
    for parts, n in make_plan(counts, 40):
        assert sum(parts) <= 40 and n > 0
        for x in parts:
            used[x] += n
    assert used == Counter(lengths)


def test_plan_is_tight_and_small():
    rng = random.Random(3)
    counts = [0] * 2049
    for _ in range(100_000):
        counts[min(2048, int(rng.expovariate(1 / 500)) + 1)] += 1
    plan = make_plan(counts)
    total = sum(i * c for i, c in enumerate(counts))
    assert sum(n for _, n in plan) <= 1.003 * total / 2048 + 1
    assert len(plan) < 20_000
    exact = exact_steps([0, 2, 1, 1, 0, 1], 5, 3, True)
    assert exact == [((5,), 1), ((3, 2), 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=13), st.integers(1, 12), st.booleans())
def test_complements_are_found_if_there_are_any(counts, gap, uneven):
    counts = [0, *counts[1:]]
    there = [x for x, n in enumerate(counts) for _ in range(n)]
    index = Complements(counts, uneven)
    for arity in (1, 2, 3):
        found = index.find(gap, arity)
        possible = any(sum(c) == gap for k in range(1, arity + 1) for c in combinations(there, k))
        assert (found is not None) == possible
        if found:
            assert sum(found) == gap and len(found) <= arity and not Counter(found) - Counter(there)
    if found:
        before = list(counts)
        n = index.take(found, 2)
        assert n >= 1 and all(before[x] - counts[x] == n * found.count(x) for x in range(13))


def test_gaps_of_open_sequences_are_filled_exactly():
    counts = [0] * 101
    for x, n in ((60, 3), (30, 3), (5, 4), (2, 1), (1, 1), (7, 1)):
        counts[x] = n
    # 60 + 30 leaves 10: 5 + 5, twice, and 7 + 2 + 1
    assert sum(n for _, n in best_fit_steps(counts, 100)) == 3 and not any(counts)


def check(rows, got):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert want == Counter(tuple(r)[:5] for r in got)
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(at), total / 2048


def test_small(spark):
    rows = [(1, "a b c"), (2, None), (None, ""), (3, "word " * 5000), (4, "x"), (4, "x"), (5, "y " * 2047)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    check(rows, pack(docs, path).collect())
    assert pack(docs.limit(0), path).count() == 0


def test_query(spark):
    at = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check(rows, registry.queries()["op2_packing"](spark, at).collect())
    assert used == math.ceil(least)
