"""HTTP handlers as functions of method, path and body, and a small server around them."""

from __future__ import annotations

import json
import logging
import re
from collections import OrderedDict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from threading import Lock

from pyspark.sql import SparkSession

from ..plans import gateway, registry
from ..plans.engine import Engine
from ..sources import scratch, store

log = logging.getLogger(__name__)

#: Fixed values of the interface.
DEFAULT_PIPELINE, PIPELINE_ID = "best_rag", re.compile(r"[a-z0-9_-]{1,64}")
QUESTION_CHARS = (3, 2000)
KEPT_PIPELINES = 8
TABLES = ("documents", "benchmark", "embeddings")


class Refused(Exception):
    """A request that gets a status other than 200."""

    def __init__(self, status: int, detail: str) -> None:
        super().__init__(detail)
        self.status = status


class Service:
    """Pipelines (the last few stay in memory) and one trace table over a folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, trace_path: str, provider: gateway.Provider | None = gateway.extractive, pipelines: dict[str, registry.PipelineConfig] | None = None) -> None:
        self.spark, self.sf_dir, self.trace_path, self.provider = spark, sf_dir, trace_path, provider
        self.configs = registry.PIPELINES if pipelines is None else pipelines
        self.engines: OrderedDict[str, Engine] = OrderedDict()
        self.lock = Lock()

    def engine(self, pipeline_id: str) -> Engine:
        with self.lock:
            if pipeline_id not in self.engines:
                if pipeline_id not in self.configs:
                    raise ValueError(f"unknown pipeline {pipeline_id!r}")
                if self.provider is None:
                    raise ValueError("no answer provider is configured")
                self.engines[pipeline_id] = Engine(self.spark, self.sf_dir, self.configs[pipeline_id], self.provider)
            self.engines.move_to_end(pipeline_id)
            while len(self.engines) > KEPT_PIPELINES:
                self.engines.popitem(last=False)
            return self.engines[pipeline_id]

    @staticmethod
    def _fields(body: object, known: dict[str, object]) -> dict:
        if not isinstance(body, dict) or set(body) - set(known):
            raise Refused(422, f"the body is an object of {sorted(known)}")
        value = known | body
        question = value["question"]
        if not isinstance(question, str) or not QUESTION_CHARS[0] <= len(question.strip()) <= QUESTION_CHARS[1]:
            raise Refused(422, f"question has {QUESTION_CHARS[0]} to {QUESTION_CHARS[1]} characters")
        return value | {"question": question.strip()}

    def _answer(self, question: str, pipeline_id: object) -> dict:
        if not isinstance(pipeline_id, str) or not PIPELINE_ID.fullmatch(pipeline_id):
            raise Refused(422, "pipeline_id has 1 to 64 of a-z, 0-9, _ and -")
        try:
            return self.engine(pipeline_id).answer_one(question, self.trace_path)
        except (ValueError, OSError) as error:
            raise Refused(422, str(error)) from error
        except Exception as error:  # noqa: BLE001
            raise Refused(502, "upstream generation failed") from error

    def answer(self, body: object) -> dict:
        value = self._fields(body, {"question": None, "pipeline_id": DEFAULT_PIPELINE})
        return self._answer(value["question"], value["pipeline_id"])

    def compare(self, body: object) -> dict:
        value = self._fields(body, {"question": None, "pipeline_ids": None})
        ids = value["pipeline_ids"]
        if not isinstance(ids, list) or len(ids) != 2 or ids[0] == ids[1]:
            raise Refused(422, "select two distinct pipelines")
        return {"answers": [self._answer(value["question"], x) for x in ids]}

    def trace(self, trace_id: str) -> dict:
        rows = store.get_traces(self.spark, self.trace_path, trace_id).collect() if re.fullmatch(r"[0-9a-zA-Z-]+", trace_id) and scratch.exists(self.spark, self.trace_path) else []
        if not rows:
            raise Refused(404, "trace not found")
        return json.loads(rows[0].payload)

    def experiments(self) -> dict:
        families = registry.load_registry()
        return {"validation": registry.validate_registry(families), "registry_hash": store.stable_hash(families), "arms": registry.resolve_arms(families)}

    def ready(self) -> dict:
        checks = {"tables_present": all(scratch.exists(self.spark, f"{self.sf_dir}/{t}.parquet") for t in TABLES), "provider_configured": self.provider is not None}
        return {"ready": all(checks.values()), "default_pipeline": DEFAULT_PIPELINE, "checks": checks}

    def handle(self, method: str, path: str, body: object = None) -> tuple[int, dict]:
        """Status and JSON value of a request."""
        try:
            with scratch.scope():
                return self._handled(method, path, body)
        except Refused as refused:
            return refused.status, {"detail": str(refused)}
        except Exception:  # noqa: BLE001  whatever goes wrong, a request has an answer
            log.exception("%s %s", method, path)
            return 500, {"detail": "internal error"}

    def _handled(self, method: str, path: str, body: object) -> tuple[int, dict]:
        match method, path.rstrip("/").split("/")[1:]:
            case "GET", ["health"]:
                return 200, {"status": "ok"}
            case "GET", ["ready"]:
                return 200, self.ready()
            case "POST", ["v1", "answer"]:
                return 200, self.answer(body)
            case "POST", ["v1", "compare"]:
                return 200, self.compare(body)
            case "GET", ["v1", "experiments"]:
                return 200, self.experiments()
            case "GET", ["v1", "traces", trace_id]:
                return 200, self.trace(trace_id)
        raise Refused(404, "not found")


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't started yet; ``/`` is the client page."""
    page = (Path(__file__).parent / "client.html").read_bytes()

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, data: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _reply(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else None
            except ValueError:
                body = None
            status, value = service.handle(method, self.path, body)
            self._send(status, "application/json", json.dumps(value, ensure_ascii=False, default=str).encode())

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/":
                self._send(200, "text/html; charset=utf-8", page)
            else:
                self._reply("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._reply("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
