"""Commands: ingest, ask, chat, serve, parse, triage, stats."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paperlode.operators import ingest, text
from paperlode.plans.pipeline import Library
from paperlode.server import Service, serve
from paperlode.settings import Settings
from paperlode.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperlode")
    p.add_argument("--data-dir")
    s = p.add_subparsers(dest="command", required=True)
    c = s.add_parser("ingest")
    c.add_argument("paths", nargs="+")
    c.add_argument("--type")
    c.add_argument("--force", action="store_true")
    c = s.add_parser("ask")
    c.add_argument("question")
    c.add_argument("-k", type=int, default=5)
    for name in ("--source", "--category"):
        c.add_argument(name)
    c.add_argument("--model-only", action="store_true")
    s.add_parser("chat")
    c = s.add_parser("serve")
    c.add_argument("--host")
    c.add_argument("--port", type=int)
    for name in ("parse", "triage"):
        s.add_parser(name).add_argument("path")
    s.add_parser("stats")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout, lines: Iterable[str] = sys.stdin) -> int:
    """Run one command; 1 if an ingest failed for every file. ``chat`` answers each of ``lines`` until an empty one."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("paperlode").getOrCreate()
    settings = Settings.load(data_dir=a.data_dir, host=getattr(a, "host", None), port=getattr(a, "port", None))
    library = Library(spark, settings.data_dir)
    show = lambda r: print(json.dumps(r, default=str, ensure_ascii=False), file=out)
    if a.command == "ingest":
        report = [r.asDict() for r in library.ingest(*a.paths, doc_type=a.type, force=a.force).collect()]
        for r in report:
            show(r)
        return int(bool(report) and all(r["status"] == "failed" for r in report))
    if a.command == "ask":
        for event in library.ask(a.question, k=a.k, model_only=a.model_only, source=a.source, category=a.category):
            show(event)
    elif a.command == "chat":
        for line in lines:
            if not line.strip():
                break
            for event in library.ask(line.strip(), k=settings.top_k):
                show(event)
    elif a.command == "serve":
        server = serve(Service(library, settings), settings.host, settings.port)
        print(f"http://{settings.host}:{server.server_port}", file=out)
        server.serve_forever()
    elif a.command in ("parse", "triage"):
        pages = files.extract(files.discover(spark, a.path), lambda: files.plain_text).where("page_no is not null")
        if a.command == "parse":
            for r in text.assemble(pages).collect():  # one document's text is the command's output
                print(r.markdown, file=out)
        else:
            kinds = ingest.triage(ingest.page_stats(pages).withColumn("image_coverage", F.lit(0.0)))
            for r in ingest.plan_shards(kinds.select("doc_id", "page_no", "kind")).orderBy("start").collect():
                show(r.asDict())
    else:
        d = library.listing()
        for r in d.collect() if d is not None else ():
            show(r.asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
