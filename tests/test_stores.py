"""Files, digests, traces, the call journal and encoders."""

import hashlib
import json
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from evisparq.functions import text as T
from evisparq.operators import encoders, expansion, metrics
from evisparq.plans import gateway
from evisparq.sources import scratch, store


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "pad": "x" * (i % 90)}) for i in range(4000)]
    for i, raw in ((0, "broken"), (1777, "[1]"), (1778, ""), (2500, '{"id":'), (3999, "end")):
        lines[i] = raw
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\n\nnothing")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(f"file://{tmp_path}/a.jsonl").rdd.getNumPartitions() > 8
        got = sorted((r.path[-7:], r.line, r.raw) for r in store.bad_lines(spark, f"file://{tmp_path}", "id string, pad string").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [("a.jsonl", 1, "broken"), ("a.jsonl", 1778, "[1]"), ("a.jsonl", 2501, '{"id":'), ("a.jsonl", 4000, "end"), ("b.jsonl", 3, "nothing")]


def test_digests_of_files_beyond_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "big", "wb") as file:
        file.truncate(size)
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "none").write_bytes(b"")
    want = hashlib.sha256()
    block = bytes(1 << 24)
    for _ in range(size >> 24):
        want.update(block)
    want.update(bytes(size & (1 << 24) - 1))
    got = {r.path.rpartition("/")[2]: (r.length, r.sha256) for r in store.file_digests(spark, f"file://{tmp_path}").collect()}
    assert got == {"big": (size, want.hexdigest()), "small": (3, hashlib.sha256(b"abc").hexdigest()), "none": (0, hashlib.sha256(b"").hexdigest())}


def test_json_is_never_missing(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    store.write_json(spark, [1], path)
    before = (tmp_path / "x.json").stat().st_ino
    store.write_json(spark, [2], path)
    assert store.read_json(spark, path) == [2] and (tmp_path / "x.json").stat().st_ino != before
    assert [x.name for x in tmp_path.iterdir() if x.suffix == ".part"] == []


def traces(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, created_at int, pipeline_id string, payload string").withColumn("created_at", F.timestamp_seconds("created_at"))


def test_trace_lookup_opens_one_bucket(spark, tmp_path):
    at = f"file://{tmp_path}/traces"
    for version in range(3):
        store.put_traces(traces(spark, [(f"t{i}", 10 * version + i % 2, "p", json.dumps({"v": version, "api_key": "s"})) for i in range(200)]), at)
    found = store.get_traces(spark, at, "t17")
    assert [json.loads(r.payload) for r in found.collect()] == [{"v": 2, "api_key": "[REDACTED]"}]
    buckets = {f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(at).where((F.col("bucket") == store._bucket(F.lit("t17")))).inputFiles()}
    assert len(buckets) >= 1 and "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()
    everything = {r.trace_id: json.loads(r.payload)["v"] for r in store.get_traces(spark, at).collect()}
    assert everything == {f"t{i}": 2 for i in range(200)}
    assert store.get_traces(spark, at, "nobody").collect() == []


def test_compaction_keeps_the_newest(spark, tmp_path):
    at = f"file://{tmp_path}/traces"
    for version in (2, 0, 1):
        store.put_traces(traces(spark, [(f"t{i}", version, "p", json.dumps(version)) for i in range(40)]).coalesce(1), at)
    before = len(spark.read.parquet(at).inputFiles())
    assert store.compact_traces(spark, at, most_files=2) > 10
    assert len(spark.read.parquet(at).inputFiles()) < before / 2
    assert {r.trace_id: r.payload for r in store.get_traces(spark, at).collect()} == {f"t{i}": "2" for i in range(40)}
    assert store.compact_traces(spark, at, most_files=2) == 0


def test_a_killed_worker_loses_no_answer(spark, tmp_path):
    calls, dead = tmp_path / "calls", tmp_path / "dead"
    calls.mkdir()

    def provider(system, user, attempt):
        import os
        import pathlib
        import uuid

        pathlib.Path(str(calls), uuid.uuid4().hex).write_text(user)
        if user == "u13" and not pathlib.Path(str(dead)).exists():
            pathlib.Path(str(dead)).write_text("")
            os._exit(7)
        return json.dumps({"user": user})

    rows = spark.createDataFrame([(i, "s", f"u{i}") for i in range(30)], "id long, system string, user string")
    cache = f"file://{tmp_path}/cache"
    with pytest.raises(Exception):  # noqa: B017  a local master gives a task one try
        gateway.call(rows, provider, "m", cache, workers=2).collect()
    got = {r.user: r.raw for r in gateway.call(rows, provider, "m", cache, workers=2).collect()}
    assert got == {f"u{i}": json.dumps({"user": f"u{i}"}) for i in range(30)}
    asked = sorted(x.read_text() for x in calls.iterdir())
    assert asked == sorted([f"u{i}" for i in range(30)] + ["u13"])
    assert not (tmp_path / "cache.journal").exists()
    assert gateway.call(rows, provider, "m", cache, workers=2).where("cached").count() == 30


def test_exact_normalizer_on_all_code_points(spark):
    import re

    word = re.compile(r"[\w]+(?:[-_/][\w]+)*")
    plain = lambda t: " ".join(word.findall(unicodedata.normalize("NFKC", t or "").casefold()))
    known = [chr(c) for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    rows = [(i, f"A{c}b-{c}/c {c}") for i, c in enumerate(known)] + [(-1, None), (-2, ""), (-3, "a--b a-/b -a- a_-b x/y/z"), (-4, "ẞﬃ İİ é Ａ-Ｂ"), (-5, "a-"), (-6, "/"), (-7, "_-_")]
    made = spark.createDataFrame(rows, "i long, t string").repartition(8).select("i", T.casefold_normalize(spark)("t").alias("n"))
    got = {r.i: r.n for r in made.collect()}
    wrong = [t for i, t in rows if got[i] != plain(t)]
    assert not wrong, (len(wrong), wrong[:5])


def test_mentions_are_bounded_by_matches(spark):
    corpus = spark.createDataFrame([(["alpha beta", "beta", "gamma " + " ".join(f"x{i}" for i in range(60)), "Alpha"],)], "mesh_terms array<string>")
    vocabulary = expansion.term_vocabulary(corpus)
    q = spark.createDataFrame([(1, "alpha " + "noise " * 500 + "alpha beta"), (2, "gamma"), (3, ""), (4, None)], "question_id long, question string")
    assert sorted(tuple(r) for r in expansion.mentioned(q, vocabulary).collect()) == [(1, "alpha"), (1, "alpha beta"), (1, "alpha noise"), (1, "beta")]
    assert {r.question_id: r.query for r in expansion.expand(q, vocabulary).collect()}[2] == "gamma"


def test_batches_are_halved_when_memory_runs_out(spark):
    sizes = []

    def encoder(texts):
        sizes.append(len(texts))
        if sum(map(len, texts)) > 40:
            raise RuntimeError("CUDA out of memory. Tried to allocate")
        return [[float(len(t)), 1.0] for t in texts]

    texts = ["x" * n for n in (5, 9, 9, 9, 9, 9, 9, 9, 30, 30, 1)]
    found = [v for part, _ in encoders.in_batches(texts, encoder, 8) for v in part]
    assert [v[0] for v in found] == [float(len(t)) for t in texts] and sizes[0] == 8 and max(sizes[1:]) == 4
    with pytest.raises(RuntimeError):
        list(encoders.in_batches(["x" * 50], encoder, 8))
    with pytest.raises(ZeroDivisionError):
        list(encoders.in_batches(["x"], lambda t: 1 // 0, 8))
    assert encoders.cut("one two, three", 3) == "one two," and encoders.cut("a b", 64) == "a b"
    docs = spark.createDataFrame([(i, "w " * i) for i in range(1, 60)] + [(99, None)], "doc_id long, text string")

    def small(texts):
        if len(texts) > 3:
            raise MemoryError
        return [[float(len(t.split())), 0.0] for t in texts]

    got = {r.doc_id: r.embedding for r in encoders.encode(docs, small, limit=20).collect()}
    assert len(got) == 60 and got[59] == [1.0, 0.0] and got[99] == [0.0, 0.0]


def test_stems_come_from_a_dictionary(spark):
    from evisparq.functions.stem import stem

    rows = [(i, f"running quickly {w} connected connections", f"runs quick {w} connection") for i, w in enumerate(["ponies", "caresses", "", "hopping cats"])]
    got = {r.qa: r.f1 for r in metrics.overlap_f1(spark.createDataFrame(rows, "qa long, prediction string, reference string"), "qa", 1, False, stemmed=True).collect()}
    for i, p, r in rows:
        s = lambda t: [stem(w) if len(w) > 3 else w for w in t.split()]
        a, b = ([*zip(x, x[1:], strict=False)] for x in (s(p), s(r)))
        o = sum(min(a.count(u), b.count(u)) for u in set(a))
        assert got[i] == pytest.approx(2 * o / (len(a) + len(b)) if o else 0.0, abs=1e-6)


def test_scopes_remove_what_they_made(spark):
    rows = spark.range(3).toDF("id")
    with scratch.scope():
        inner = scratch.written(rows, "inner").inputFiles()[0]
        with scratch.scope(lasting=True):
            kept = scratch.written(rows, "kept")
        assert scratch.exists(spark, inner)
    assert not scratch.exists(spark, inner) and kept.count() == 3
    scratch.release(kept)
    assert not scratch.exists(spark, kept.inputFiles()[0])
