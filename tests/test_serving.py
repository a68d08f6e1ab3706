"""Handlers, the server and the command line over the smallest tables."""

import json
import threading
import urllib.request

import pytest

from evisparq import cli, verbs
from evisparq.plans import registry
from evisparq.serving.app import KEPT_PIPELINES, Service, server

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    return Service(spark, SF, f"file://{tmp_path_factory.mktemp('serving')}/traces")


@pytest.fixture(scope="module")
def question(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").first().text[:200]


def test_answers_and_traces(service, question):
    for pipeline in ("bm25_rag", "best_rag", "closed_book"):
        status, got = service.handle("POST", "/v1/answer", {"question": f"  {question} ", "pipeline_id": pipeline})
        assert status == 200 and got["pipeline_id"] == pipeline and got["question"] == question.strip()
        assert got["answer"]["abstained"] == (pipeline == "closed_book") and bool(got["citations"]) == (pipeline != "closed_book")
        assert service.handle("GET", f"/v1/traces/{got['trace_id']}")[1]["answer"] == got["answer"]
    assert service.handle("GET", "/v1/traces/none")[0] == 404
    assert service.handle("GET", "/v1/traces/x' OR '1'='1")[0] == 404


def test_requests_leave_no_tables_behind(service, spark, question):
    from evisparq.sources import scratch

    for _ in range(2):  # what an engine keeps must outlive the first request
        status, got = service.handle("POST", "/v1/answer", {"question": question, "pipeline_id": "dense_rag"})
        assert status == 200, got
        before = len(scratch._made)
    assert len(scratch._made) == before
    service.handle("POST", "/v1/answer", {"question": question, "pipeline_id": "bm25_rag"})
    assert len(scratch._made) == before


def test_errors_have_a_status(spark, tmp_path):
    broken = Service(spark, SF, f"file://{tmp_path}/traces")
    broken.ready = lambda: 1 / 0
    assert broken.handle("GET", "/ready") == (500, {"detail": "internal error"})


def test_requests_are_checked(service, question):
    for body in (None, [], {}, {"question": "ab"}, {"question": "x" * 2001}, {"question": 5}, {"question": question, "gold": 1}, {"question": question, "pipeline_id": "Bad"}, {"question": question, "pipeline_id": "unknown"}, {"question": question, "pipeline_id": "gold_evidence_oracle"}):
        assert service.handle("POST", "/v1/answer", body)[0] == 422, body
    for ids in (None, ["bm25_rag"], ["bm25_rag", "bm25_rag"], ["bm25_rag", "unknown"]):
        assert service.handle("POST", "/v1/compare", {"question": question, "pipeline_ids": ids})[0] == 422
    status, got = service.handle("POST", "/v1/compare", {"question": question, "pipeline_ids": ["bm25_rag", "closed_book"]})
    assert status == 200 and [x["pipeline_id"] for x in got["answers"]] == ["bm25_rag", "closed_book"]
    assert service.handle("GET", "/nothing")[0] == service.handle("GET", "/v1/answer")[0] == 404


def test_a_failing_provider_leaves_a_trace(spark, question, tmp_path):
    def slow(system, user, attempt):
        raise TimeoutError("too slow")

    service = Service(spark, SF, f"file://{tmp_path}/traces", slow)
    assert service.handle("POST", "/v1/answer", {"question": question, "pipeline_id": "bm25_rag"}) == (502, {"detail": "upstream generation failed"})
    row = spark.read.parquet(f"file://{tmp_path}/traces").first()
    assert json.loads(row.payload)["failed"] is True and service.handle("GET", f"/v1/traces/{row.trace_id}")[1]["error_type"] == "TimeoutError"


def test_status_and_pipelines_in_memory(spark, service, tmp_path):
    assert service.handle("GET", "/health") == (200, {"status": "ok"})
    assert service.handle("GET", "/ready")[1]["ready"] and not Service(spark, str(tmp_path), "x", None).handle("GET", "/ready")[1]["ready"]
    arms = service.handle("GET", "/v1/experiments")[1]
    assert arms["validation"] == {"core": 41, "stretch": 13} and len(arms["arms"]) == 54
    many = {f"p{i}": registry.PipelineConfig(f"p{i}") for i in range(KEPT_PIPELINES + 2)}
    few = Service(spark, SF, "x", pipelines=many)
    for name in many:
        few.engine(name)
    assert list(few.engines) == list(many)[2:]
    first = few.engine("p2")
    assert few.engine("p2") is first and list(few.engines)[-1] == "p2"


def test_server(service):
    httpd = server(service, port=0)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{httpd.server_address[1]}"
    assert json.loads(urllib.request.urlopen(f"{at}/health").read()) == {"status": "ok"}
    assert b"/v1/answer" in urllib.request.urlopen(f"{at}/").read()
    request = urllib.request.Request(f"{at}/v1/answer", data=b"not json", method="POST")
    with pytest.raises(urllib.error.HTTPError, match="422"):
        urllib.request.urlopen(request)
    httpd.shutdown()


def run(args):
    cli.main(["--data", SF, *args])


def test_every_verb_parses():
    for name, verb in verbs.EXPERIMENT.items():
        given = ["experiment", name]
        for option in verb.options:
            key = option.rstrip("!")
            if option.endswith("!"):
                given += ["--" + key.replace("_", "-"), str((verbs.OPTIONS[key].get("choices") or ["x"])[0])]
        assert cli.parser().parse_args(given).action == name


def test_a_study_on_the_command_line(spark, tmp_path, capsys):
    at = lambda x: f"file://{tmp_path}/{x}"
    run(["data", "freeze", "--out", at("splits")])
    who = ["--population", "query", "--splits", at("splits")]
    run(["experiment", "bm25", *who, "--k", "20", "--out", at("bm25")])
    run(["experiment", "query", *who, "--transform", "mesh", "--k", "20", "--out", at("mesh")])
    ids = {r.question_id for r in spark.read.parquet(at("splits")).where("population = 'query'").collect()}
    assert {r.question_id for r in spark.read.parquet(at("bm25")).collect()} == ids
    run(["experiment", "evidence", *who, "--arm", "fixed256_bm25", "--run", at("bm25"), "--out", at("fixed")])
    run(["experiment", "evidence", *who, "--arm", "sentence3_bm25", "--run", at("bm25"), "--out", at("three")])
    assert spark.read.parquet(at("fixed")).count() > 0 and spark.read.parquet(at("three")).count() > 0
    for name, order in (("c1", "relevance_descending"), ("c2", "strongest_middle")):
        run(["experiment", "prepare-contexts", *who, "--run", at("bm25"), "--order", order, "--out", at(name)])
        run(["experiment", "generate-contexts", *who, "--contexts", at(name), "--out", at("g" + name)])
    run(["experiment", "verify-context-invariant", "--left", at("c1"), "--right", at("c2"), "--out", at("same")])
    assert spark.read.parquet(at("same")).first().mismatches == 0
    run(["experiment", "compare", "--left", at("gc1"), "--right", at("gc2"), "--metric", "rouge_su4", "--out", at("cmp")])
    got = spark.read.parquet(at("cmp")).first()
    assert got.ci95_low <= got.mean_delta <= got.ci95_high and 0 < got.p <= 1
    run(["experiment", "panel-direct", *who, "--generation", at("gc1"), "--contexts", at("c1"), "--out", at("panel")])
    run(["experiment", "panel-pairwise", *who, "--left", at("gc1"), "--right", at("gc2"), "--contexts", at("c1"), "--out", at("pairs")])
    assert spark.read.parquet(at("panel")).first().questions == len(ids) == spark.read.parquet(at("pairs")).first().questions
    run(["experiment", "bertscore", "--generation", at("gc1"), "--out", at("bert")])
    assert spark.read.parquet(at("bert")).count() == len(ids)
    run(["experiment", "freeze-final", "--file", at("frozen.json")])
    run(["experiment", "freeze-final", "--file", at("frozen.json"), "--verify"])
    with pytest.raises(PermissionError):
        run(["experiment", "bm25", "--population", "heldout340", "--splits", at("splits")])
    with pytest.raises(ValueError):
        run(["experiment", "compare", "--left", at("gc1"), "--right", at("gc2"), "--metric", "rouge_su4", "--require-equal-evidence"])
    run(["data", "audit", "--html", str(tmp_path / "audit.html")])
    assert "corpus_audit" in (tmp_path / "audit.html").read_text()
    run(["index", "build-bm25", "--out", at("index")])
    run(["index", "build-dense", "--out", at("dense")])
    assert spark.read.parquet(at("dense")).count() > 0
    run(["experiment", "validate"])
    assert '"core": 41' in capsys.readouterr().out
