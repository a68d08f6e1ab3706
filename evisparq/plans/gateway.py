"""Calls of a text provider behind a content-addressed cache: attempts with growing pauses, errors as rows, bounded workers.

A provider is a function of (system prompt, user prompt, attempt) that returns text or raises. It runs in Arrow batches on as many
tasks as there may be callers at once. Each answer is noted in a journal as soon as it is there, in a file of its own under its payload's hash, so that a
task that runs again, or a run after a failed one, asks only for what isn't noted.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..sources import scratch

Provider = Callable[[str, str, int], str]

#: Attempts of a call, and seconds before the second one; each pause doubles.
ATTEMPTS, PAUSE = 3, 1.0
MOST_WORKERS = 16
ERROR_CHARS = 300
CACHE_SCHEMA = "payload_hash string, raw string, attempts int, latency_ms double"
_OUTCOME = "payload_hash string, raw string, attempts int, latency_ms double, error_type string, error_message string"


def json_object(raw: str) -> dict:
    """The object from the first brace to the last; raises where there is none."""
    begin, end = raw.find("{"), raw.rfind("}")
    if begin < 0 or end < begin:
        raise ValueError(f"no JSON object in a response of {len(raw)} characters")
    return json.loads(raw[begin : end + 1])


class Journal:
    """Answers by payload hash, a file each, on any file system that Arrow opens by URI."""

    def __init__(self, uri: str) -> None:
        self.files, self.path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))

    def _at(self, payload: str) -> str:
        return f"{self.path}/{payload[:2]}/{payload}.json"

    def get(self, payload: str) -> tuple | None:
        at = self._at(payload)
        if self.files.get_file_info(at).type != pyarrow.fs.FileType.File:
            return None
        with self.files.open_input_stream(at) as file:
            return tuple(json.loads(file.read()))

    def put(self, payload: str, outcome: tuple) -> None:
        at = self._at(payload)
        self.files.create_dir(at.rpartition("/")[0])
        partial = f"{at}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(partial) as file:
            file.write(json.dumps(outcome).encode())
        self.files.move(partial, at)


def _attempt(provider: Provider, check: Callable[[str], object], system: str, user: str, attempts: int, pause: float) -> tuple:
    began = time.perf_counter()
    for number in range(1, attempts + 1):
        try:
            raw = provider(system, user, number)
            check(raw)
            return raw, number, (time.perf_counter() - began) * 1000, None, None
        except Exception as error:  # noqa: BLE001  any failure of a provider is a row, not the end of the run
            if number == attempts:
                return None, number, (time.perf_counter() - began) * 1000, type(error).__name__, str(error)[:ERROR_CHARS]
            time.sleep(pause * 2 ** (number - 1))
    raise AssertionError("unreachable")


def call(prompts: DataFrame, provider: Provider, model: str, cache_path: str | None = None, check: Callable[[str], object] = json_object, workers: int = 8, attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    """``prompts`` (any columns with ``system, user``) with ``payload_hash, raw, attempts, latency_ms, cached, error_type, error_message``.

    Payloads that the cache lacks are called once each, by up to ``workers`` tasks; answers that pass ``check`` are appended, failures
    are not, so that a later run tries them again. A failed row has no ``raw`` and names its error. Between calls and cache stands a
    journal beside the cache (see ``Journal``), which goes when the answers are in the cache.
    """
    if not 1 <= workers <= MOST_WORKERS:
        raise ValueError(f"workers must be 1 to {MOST_WORKERS}")
    spark = prompts.sparkSession
    rows = scratch.written(prompts.withColumn("payload_hash", content_hash(F.lit(model), "system", "user")), "prompts")
    known = spark.createDataFrame([], CACHE_SCHEMA)
    if cache_path and scratch.exists(spark, cache_path):
        known = scratch.written(spark.read.schema(CACHE_SCHEMA).parquet(cache_path).join(rows.select("payload_hash").distinct(), "payload_hash", "left_semi").dropDuplicates(["payload_hash"]), "known")
    misses = rows.select("payload_hash", "system", "user").dropDuplicates(["payload_hash"]).join(known.select("payload_hash"), "payload_hash", "left_anti")

    noted = f"{cache_path.rstrip('/')}.journal" if cache_path else scratch.new_path(spark, "journal")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        journal = Journal(noted)

        def outcome(payload: str, system: str, user: str) -> tuple:
            found = journal.get(payload)
            if found is None:
                found = _attempt(provider, check, system, user, attempts, pause)
                if found[0] is not None:
                    journal.put(payload, found)
            return found

        for pdf in batches:
            got = [(h, *outcome(h, s, u)) for h, s, u in zip(pdf["payload_hash"], pdf["system"], pdf["user"], strict=True)]
            yield pd.DataFrame(got, columns=["payload_hash", "raw", "attempts", "latency_ms", "error_type", "error_message"])

    # written at once: a provider must not be asked again because a plan is
    fresh = scratch.written(misses.repartition(workers, "payload_hash").mapInPandas(run, _OUTCOME), "outcomes")
    if cache_path:
        fresh.where("raw IS NOT NULL").select("payload_hash", "raw", "attempts", "latency_ms").write.mode("append").parquet(cache_path)
    scratch.remove(spark, noted)
    none = F.lit(None).cast("string")
    told = known.select("*", F.lit(True).alias("cached"), none.alias("error_type"), none.alias("error_message")).unionByName(fresh.withColumn("cached", F.lit(False)))
    return rows.join(told, "payload_hash")


_EVIDENCE = re.compile(r"\n\nEVIDENCE\n(.*)\Z", re.DOTALL)
_BLOCK = re.compile(r"\A\[PMID:(\d+)\] [^\n]*\n([^\n.!?]*[.!?]?)")


def extractive(system: str, user: str, attempt: int) -> str:
    """The offline provider: the first sentence of the first evidence block, or an abstention."""
    evidence = _EVIDENCE.search(user)
    block = _BLOCK.search(evidence.group(1)) if evidence else None
    said = block.group(2).strip(" ") if block else ""
    kind = re.search(r"of type (yesno|factoid|list|summary)", system)
    kind = kind.group(1) if kind else "summary"
    exact = {"yesno": "yes", "summary": None}.get(kind, said.split(" ")[0] if said else None)
    return "```json\n" + json.dumps({"predicted_type": kind, "exact_answer": exact, "ideal_answer": said or None, "citation_pmids": [block.group(1)] if block else [], "abstained": not said, "evidence_support_score": 1.0 if said else 0.0}) + "\n```"
