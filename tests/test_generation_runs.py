"""Gateway, generation runs, panels, guards and storage."""

import json

import pytest
from pyspark.sql import functions as F

from evisparq.plans import gateway, generation, guards, judging, registry, runs
from evisparq.sources import scratch, store


def prompts(spark, users):
    return spark.createDataFrame([(i, "s", u) for i, u in enumerate(users)], "id long, system string, user string")


def flaky(folder):
    """A provider that fails on its first attempts, for good on some prompts; it notes calls in a folder that all workers share."""

    def provider(system, user, attempt):
        import pathlib
        import uuid

        pathlib.Path(folder, uuid.uuid4().hex).write_text(user)
        if user == "never" or user == "second" and attempt < 2:
            raise TimeoutError("too slow")
        return "nothing" if user == "no object" else json.dumps({"user": user})

    return provider


def test_gateway_attempts_cache_and_errors(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = prompts(spark, ["first", "second", "never", "no object", "first"])
    cache = f"file://{tmp_path}/cache"
    seen = lambda: sorted(x.read_text() for x in calls.iterdir())
    for turn in range(2):
        got = {r.id: r for r in gateway.call(rows, flaky(str(calls)), "m", cache, pause=0.0, workers=3).collect()}
        assert len(got) == 5 and got[0].raw == got[4].raw == '{"user": "first"}'
        assert got[0].cached == got[1].cached == (turn == 1) and not got[2].cached
        assert (got[1].attempts, got[2].attempts) == (2, 3)
        assert (got[2].raw, got[2].error_type, got[2].error_message) == (None, "TimeoutError", "too slow") and got[3].error_type == "ValueError"
    # a cached answer is not asked for again, a failure is
    assert seen() == sorted(["first"] + ["second"] * 2 + ["never"] * 6 + ["no object"] * 6)
    with pytest.raises(ValueError):
        gateway.call(rows, flaky(str(calls)), "m", workers=17)
    assert gateway.call(rows.limit(0), flaky(str(calls)), "m").count() == 0


def questions(spark, n=6):
    kinds = ("yesno", "factoid", "list", "summary")
    return spark.createDataFrame([(i, f"What is fact {i}?", kinds[i % 4]) for i in range(n)], "question_id long, question string, type string")


def contexts(spark, n=6):
    rows = [(i, "" if i == 1 else f"[PMID:{i}] T\nFact {i} is known. More.", i == 2) for i in range(n)]
    return spark.createDataFrame(rows, "question_id long, context string, failed boolean")


def broken():
    def provider(system, user, attempt):
        if "fact 3" in user:
            return '{"predicted_type": "poem", "ideal_answer": "x"}'
        if "fact 4" in user:
            return json.dumps({"predicted_type": "summary", "ideal_answer": "a", "citation_pmids": ["4", "999"], "abstained": False})
        return gateway.extractive(system, user, attempt)

    return provider


def test_context_generation_and_scores(spark):
    q = questions(spark)
    rows = generation.context_generation(q, contexts(spark), broken(), pause=0.0)
    got = {r.question_id: r for r in rows.collect()}
    assert len(got) == 6
    assert got[0].answer.ideal_answer == "Fact 0 is known." and got[0].citations == ["0"] and not got[0].failed
    assert got[1].answer.abstained and got[1].answer.ideal_answer == generation.INSUFFICIENT and got[1].citations == []
    assert (got[2].failed, got[2].error_type, got[2].attempts) == (True, "UpstreamFailure", 0)
    assert got[3].failed and got[3].attempts == 3 and got[3].answer is None
    assert got[4].citation_count == 2 and got[4].citations == ["4"]
    typed = {r.question_id: r.answer.predicted_type for r in generation.context_generation(q, contexts(spark), style="gold_type").collect() if not r.failed}
    assert typed == {0: "yesno", 1: "factoid", 3: "summary", 4: "yesno", 5: "factoid"}
    gold = q.select("question_id", "type", F.concat(F.lit("Fact "), "question_id", F.lit(" is known.")).alias("reference"))
    scored = {r.question_id: r for r in generation.score_generation(rows, gold).collect()}
    assert scored[0].rouge_su4 == 1.0 and scored[0].rouge2_f1 == 1.0 and scored[2].rouge_su4 == 0.0 and not scored[2].type_correct
    summary = generation.generation_summary(generation.score_generation(rows, gold)).first()
    assert (summary.questions, summary.failures) == (6, 2) and summary.citation_validity == pytest.approx(3 / 4)


def test_panels(spark):
    ids = questions(spark, 4).select("question_id")
    q = questions(spark, 4).select("question_id", "question", F.lit("Fact is well known here").alias("reference"))
    answers = spark.createDataFrame([(0, "Fact is well known here"), (1, "planets and moons"), (2, None), (3, "Fact is known")], "question_id long, answer string")
    ctx = ids.select("question_id", F.lit("[PMID:1] T\nFact is well known here").alias("context"))
    bad = lambda system, user, attempt: '{"correctness": 9}'
    rows, summary = judging.direct_suite(ids, q, answers, ctx, {"a": judging.word_judge, "b": judging.word_judge}, pause=0.0)
    got = {r.question_id: r for r in rows.collect()}
    assert got[0].median_correctness == 3 and got[1].median_correctness == 0 and got[2].failed and not got[3].failed
    s = summary.first()
    assert (s.questions, s.failures, s.exact_agreement_rate, s.disagreement_rate) == (4, 1, 1.0, 0.0) and s.alpha_correctness == 1.0
    assert judging.direct_suite(ids, q, answers, ctx, {"a": judging.word_judge, "bad": bad}, pause=0.0)[1].first().failures == 4
    with pytest.raises(ValueError, match="cover"):
        judging.direct_suite(ids, q, answers.where("question_id < 3"), ctx, {"a": judging.word_judge})
    other = ids.select("question_id", F.lit("planets").alias("answer"))
    first = lambda system, user, attempt: '{"winner": "A"}'
    rows, summary = judging.pairwise_suite(ids, q, answers, other, ctx, {"a": judging.word_judge}, pause=0.0)
    assert {r.question_id: r.winner for r in rows.collect()} == {0: "left", 1: "tie", 2: None, 3: "left"}
    assert judging.pairwise_suite(ids, q, answers, other, ctx, {"always first": first}, pause=0.0)[1].first().tie_wins == 3
    found = ids.select("question_id", F.lit(1).alias("position"), F.lit("7").alias("pmid"), F.lit("Fact is well known here").alias("snippet"))
    rows, verdict = judging.sanity_suite(q, found, {"a": judging.word_judge}, pause=0.0)
    assert [r.expected for r in rows.orderBy("question_id").collect()] == ["good", "bad", "good", "bad"] and verdict.first().passed
    assert not judging.sanity_suite(q, found, {"bad": bad}, pause=0.0)[1].first().passed
    with pytest.raises(ValueError):
        judging.sanity_suite(q, found, {"a": judging.word_judge}, 41)


def test_guards(spark, tmp_path):
    configs = {arm: registry.PIPELINES[arm].config_hash for arm in runs.FINAL_ARMS}
    frozen = runs.freeze_finalists(configs)
    guards.heldout_guard("validation200", None, None)
    guards.heldout_guard("heldout340", frozen, configs)
    with pytest.raises(PermissionError):
        guards.heldout_guard("judge160", None, configs)
    with pytest.raises(ValueError):
        guards.heldout_guard("heldout340", frozen, configs | {"best_rag": "changed"})
    assert guards.source_of("heldout340") == "eval" and guards.source_of("smoke40") == "dev"
    splits = spark.createDataFrame([("smoke", x) for x in (9, 10, 2)] + [("other", 1)], "population string, question_id long")
    assert [r[0] for r in guards.selected_ids(splits, "smoke").collect()] == [10, 2, 9]
    assert [r[0] for r in guards.selected_ids(splits, "smoke", 1).collect()] == [10]
    with pytest.raises(ValueError):
        guards.selected_ids(splits, "smoke", 0)
    ledger = f"file://{tmp_path}/ledger"
    first = guards.record_access(spark, "panel", "ab", ledger)
    assert guards.record_access(spark, "panel", "ab", ledger) == first and guards.record_access(spark, "panel", "cd", ledger)["entries"] == 2
    assert len(guards.git_sha("/root/repo")) in (7, 40) and guards.git_sha("/") == "unknown"
    (tmp_path / "model").mkdir()
    (tmp_path / "model" / "w.bin").write_bytes(b"1")
    before = guards.model_revision(str(tmp_path / "model"))
    (tmp_path / "model" / "w.bin").write_bytes(b"2")
    assert guards.model_revision(str(tmp_path / "model")) != before
    (tmp_path / "model" / "REVISION").write_text("abc\n")
    assert guards.model_revision(str(tmp_path / "model")) == "abc"


def test_redaction_is_recursive(spark):
    rows = [
        '{"api_key": {"a": "s1", "b": "s2"}, "n": 1}',
        '{"list": [{"my_SECRET": ["s1"]}, {"x": [{"KeyName": "s2"}]}], "text": "key: \\"s\\" é"}',
        "not json with s1",
        None,
    ]
    got = [r.p for r in spark.createDataFrame([(r,) for r in rows], "payload string").select(store.redact("payload").alias("p")).collect()]
    assert json.loads(got[0]) == {"api_key": "[REDACTED]", "n": 1}
    assert json.loads(got[1]) == {"list": [{"my_SECRET": "[REDACTED]"}, {"x": [{"KeyName": "[REDACTED]"}]}], "text": 'key: "s" é'}
    assert json.loads(got[2]) == "[REDACTED]" and got[3] is None


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1"}\n\n[1]\n{"id":"2"}\nbroken\n')
    (tmp_path / "b.jsonl").write_text('{"id":"3"}\n')
    with pytest.raises(ValueError, match=r"a\.jsonl:3: .*a\.jsonl:5: "):
        store.scan_jsonl(spark, f"file://{tmp_path}", "id string")
    assert sorted(r.id for r in store.scan_jsonl(spark, f"file://{tmp_path}/b.jsonl", "id string").collect()) == ["3"]


def test_json_is_written_whole(spark, tmp_path):
    path = f"file://{tmp_path}/deep/x.json"
    for value in ({"a": [1, "é"]}, {"b": None}):
        store.write_json(spark, value, path)
        assert store.read_json(spark, path) == value and (tmp_path / "deep" / "x.json").read_text().endswith("}\n")
    assert not (tmp_path / "deep" / "x.json.part").exists()


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(f"{i * 7919 % 1000:04}",) for i in range(1000)], "k string").repartition(7)
    assert [(r.k, r.number) for r in scratch.numbered(rows, [F.col("k")]).orderBy("k").collect()] == [(f"{i:04}", i) for i in range(1000)]


def test_run_log_and_serial_latency(spark, tmp_path):
    runs.log_run_full(spark, "r1", {"ap": 0.5}, {"k": 10}, {"run": "sha"}, f"file://{tmp_path}/log")
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/log/params").collect()] == [("r1", "k", "10")]
    asked = []
    rows = runs.serial_latencies(questions(spark, 3), lambda q: asked.append(q.first().question_id) or q).collect()
    assert asked == [0, 0, 1, 2] and [r.question_id for r in rows] == [0, 1, 2] and all(r.latency_ms > 0 for r in rows)


def test_runs_have_a_start_and_an_end(spark, tmp_path):
    at = f"file://{tmp_path}/runs"
    with runs.tracked(spark, "good", {"k": 10}, at) as run:
        run.log({"ap": 0.5}, artifacts={"run": "sha"})
        assert {r.run_id: (r.status, r.seconds) for r in runs.run_status(spark, at).collect()} == {"good": ("running", None)}
    with pytest.raises(KeyError), runs.tracked(spark, "bad", {}, at) as run:
        run.log({"ap": 0.1})
        raise KeyError("lost")
    got = {r.run_id: r for r in runs.run_status(spark, at).collect()}
    assert got["good"].status == "finished" and got["good"].seconds >= 0 and got["good"].error_type is None
    assert (got["bad"].status, got["bad"].error_type) == ("failed", "KeyError") and "lost" in got["bad"].error_message
    assert {r.run_id for r in spark.read.parquet(f"{at}/metrics").collect()} == {"good", "bad"}
    assert runs.out_dir(spark).endswith("/evisparq-out")
