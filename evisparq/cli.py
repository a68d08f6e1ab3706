"""Command line: the engine's verbs over a folder of tables."""

from __future__ import annotations

import argparse
import json

from . import verbs


def _add(parsers, name: str, verb: verbs.Verb) -> None:
    sub = parsers.add_parser(name, help=verb.help)
    sub.add_argument("--out", help="Parquet folder; without it the first rows are printed")
    for option in verb.options:
        key = option.rstrip("!")
        sub.add_argument("--" + key.replace("_", "-"), required=option.endswith("!"), **verbs.OPTIONS[key])


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="evisparq", description="Retrieval, evidence and evaluation on Spark")
    out.add_argument("--data", default="/root/testdata/sf0.01", help="folder of the Parquet tables")
    top = out.add_subparsers(dest="verb", required=True)
    data = top.add_parser("data").add_subparsers(dest="action", required=True)
    audit = data.add_parser("audit")
    audit.add_argument("--html", help="page of the audit's cards")
    freeze = data.add_parser("freeze")
    freeze.add_argument("--seed", type=int, default=20_260_713)
    freeze.add_argument("--out")
    data.add_parser("verify")
    index = top.add_parser("index").add_subparsers(dest="action", required=True)
    bm25 = index.add_parser("build-bm25")
    bm25.add_argument("--recipe", default="title_abstract")
    bm25.add_argument("--out", required=True)
    dense = index.add_parser("build-dense")
    dense.add_argument("--out", required=True)
    dense.add_argument("--force", action="store_true")
    experiment = top.add_parser("experiment").add_subparsers(dest="action", required=True)
    experiment.add_parser("validate")
    for name, verb in verbs.EXPERIMENT.items():
        _add(experiment, name, verb)
    report = top.add_parser("report")
    report.add_argument("summaries", help="JSON Lines of flat summaries")
    report.add_argument("--out", required=True)
    serve = top.add_parser("serve")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--traces", required=True, help="folder of the trace table")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.verb == "experiment" and args.action == "validate":
        from .plans import registry

        print(json.dumps(registry.validate_registry(registry.load_registry())))
        return
    from .operators import audit, encoders, retrieval
    from .plans import catalog, report
    from .session import local_session
    from .sources import store, tables

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    rows, out = None, getattr(args, "out", None)
    if args.verb == "data":
        if args.action == "freeze":
            rows = audit.freeze_splits(tables.questions(spark, args.data), args.seed, 2, {"smoke": (1, 2), "query": (3, 3)})
        elif args.action == "audit" and args.html:
            names = ("corpus_audit", "qa_audit", "snippet_audit", "split_integrity")
            report.write_page([{"audit": n, **r.asDict()} for n in names for r in queries[n](spark, args.data).collect()], args.html)
        else:
            rows = queries[{"audit": "corpus_audit", "verify": "verify_splits"}[args.action]](spark, args.data)
    elif args.verb == "index" and args.action == "build-bm25":
        store.save_index(retrieval.bm25_index(tables.corpus(spark, args.data), args.recipe), out)
    elif args.verb == "index":
        encoders.build_index(encoders.hashed_vectors(tables.corpus(spark, args.data), retrieval.recipe_text("title_abstract")), out, args.force)
    elif args.verb == "report":
        report.write(args.summaries, out)
    elif args.verb == "serve":
        from .serving.app import Service, server

        server(Service(spark, args.data, args.traces), port=args.port).serve_forever()
    else:
        rows = verbs.EXPERIMENT[args.action].run(spark, args)
    if rows is not None:
        rows.write.mode("overwrite").parquet(out) if out and args.verb != "report" else rows.show(200, truncate=80)
