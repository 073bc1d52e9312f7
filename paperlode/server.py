"""The library over HTTP: uploads become jobs that run one at a time, questions are answered as a stream of events."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import functions as F

from paperlode.operators import answers, listing
from paperlode.operators.ingest import SUFFIXES
from paperlode.plans.pipeline import ChatModel, Library
from paperlode.settings import Settings

#: Jobs a listing shows.
SHOWN = 50


class Refused(Exception):
    """A request that cannot be served: status and message."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


@dataclass
class Question:
    """What is asked, and in which scope."""

    question: str
    k: int = 5
    category: str | None = None
    doc_type: str | None = None
    doc_id: str | None = None
    year: str | None = None
    use_model: bool = False

    @classmethod
    def read(cls, body: bytes) -> Question:
        try:
            given = json.loads(body or b"{}")
            q = cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__})
        except (ValueError, TypeError, AttributeError) as e:
            raise Refused(400, f"no such request: {e}") from e
        if not isinstance(q.question, str) or not q.question.strip():
            raise Refused(400, "empty question")
        if not isinstance(q.k, int) or not 1 <= q.k <= 50:
            raise Refused(400, "k is a number from 1 to 50")
        return q


class Service:
    """What the routes do; jobs are kept in memory and run one after another."""

    def __init__(self, library: Library, settings: Settings, model: ChatModel | None = None, finance_model: ChatModel | None = None) -> None:
        self.library, self.settings, self.model, self.finance_model = library, settings, model, finance_model
        self.jobs: dict[str, dict] = {}
        self.queue = ThreadPoolExecutor(1, thread_name_prefix="jobs")

    def meta(self) -> dict:
        types = [{"key": k, "category": c, "label": label} for k, c, label in listing.DOC_TYPES]
        return {"types": types, "accept": sorted(SUFFIXES), "finance_model": self.finance_model is not None}

    def documents(self) -> list[dict]:
        d = self.library.listing()
        if d is None:
            return []
        accounts, returns = self.library.accounts.read(), self.library.returns.read()
        spark = self.library.spark
        a = accounts if accounts is not None else spark.createDataFrame([], "doc_id string, bank string, account_number string, page_start int")
        r = returns if returns is not None else spark.createDataFrame([], "doc_id string, form string, assessment_year string, return_no bigint, name string")
        years = r.groupBy("doc_id").agg(F.array_sort(F.collect_set("assessment_year")).alias("years"))
        out = d.join(answers.summaries(a, r), "doc_id", "left").join(years, "doc_id", "left").orderBy(F.lower("source"), "doc_id")
        return [x.asDict() for x in out.toLocalIterator()]

    def delete(self, doc_id: str) -> dict:
        for store in (self.library.chunks, self.library.accounts, self.library.returns):
            store.delete(doc_id)
        return {"deleted": doc_id}

    def upload(self, name: str, length: int, body: Callable[[int], bytes], doc_type: str, force: bool) -> dict:
        """Keep a file and queue its ingest."""
        name = re.sub(r"[^\w.\- ()]", "_", os.path.basename(name) or "upload")
        suffix = name.rpartition(".")[2].lower()
        if doc_type not in {k for k, *_ in listing.DOC_TYPES}:
            raise Refused(400, f"unknown doc_type {doc_type!r}")
        if suffix not in SUFFIXES:
            raise Refused(400, f"{name}: unsupported file type")
        if length > self.settings.upload_max_mb << 20:
            raise Refused(413, f"{name}: larger than {self.settings.upload_max_mb} MB")
        job = uuid.uuid4().hex[:12]
        folder = os.path.join(self.library.folder, "uploads", job)
        os.makedirs(folder)
        with open(os.path.join(folder, name), "wb") as f:
            while length > 0 and (part := body(min(length, 1 << 20))):
                f.write(part)
                length -= len(part)
        self.jobs[job] = {"id": job, "status": "queued", "file": name, "doc_type": doc_type, "created": time.time(), "reports": []}
        self.queue.submit(self._run, job, folder, doc_type, force)
        return self.jobs[job]

    def _run(self, job: str, folder: str, doc_type: str, force: bool) -> None:
        state = self.jobs[job]
        state["status"] = "running"
        try:
            state["reports"] = [r.asDict() for r in self.library.ingest(folder, doc_type=doc_type, force=force).collect()]
            state["status"] = "failed" if state["reports"] and all(r["status"] == "failed" for r in state["reports"]) else "done"
        except Exception as e:  # noqa: BLE001 - a job's failure is its own
            state.update(status="failed", error=str(e)[:500])

    def recent(self) -> list[dict]:
        return sorted(self.jobs.values(), key=lambda j: -j["created"])[:SHOWN]

    def ask(self, q: Question) -> Iterator[dict]:
        filters = {k: v for k, v in (("category", q.category), ("doc_type", q.doc_type), ("doc_id", q.doc_id)) if v}
        try:
            yield from self.library.ask(q.question, self.model, q.k, q.use_model, self.finance_model, q.year, **filters)
        except Exception as e:  # noqa: BLE001 - the stream has begun, so the error is its last event
            yield {"event": "error", "message": str(e)[:500]}


def serve(service: Service, host: str, port: int) -> ThreadingHTTPServer:
    """A server for the service, ready for ``serve_forever``; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

        def reply(self, value: object, status: int = 200) -> None:
            body = json.dumps(value, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def events(self, found: Iterator[dict]) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "application/x-ndjson; charset=utf-8")
            self.end_headers()
            for e in found:
                self.wfile.write(json.dumps(e, default=str, ensure_ascii=False).encode() + b"\n")
                self.wfile.flush()

        def route(self, method: str) -> None:
            url = urlparse(self.path)
            parts = [unquote(p) for p in url.path.strip("/").split("/")]
            query = {k: v[-1] for k, v in parse_qs(url.query).items()}
            length = int(self.headers.get("Content-Length") or 0)
            try:
                match (method, *parts):
                    case ("GET", "api", "meta"):
                        self.reply(service.meta())
                    case ("GET", "api", "documents"):
                        self.reply(service.documents())
                    case ("DELETE", "api", "documents", doc_id):
                        self.reply(service.delete(doc_id))
                    case ("POST", "api", "documents"):
                        self.reply(service.upload(query.get("name", ""), length, self.rfile.read, query.get("doc_type", "other"), query.get("force") == "true"), 202)
                    case ("GET", "api", "jobs"):
                        self.reply(service.recent())
                    case ("GET", "api", "jobs", job) if job in service.jobs:
                        self.reply(service.jobs[job])
                    case ("POST", "api", "ask"):
                        self.events(service.ask(Question.read(self.rfile.read(length))))
                    case _:
                        raise Refused(404, "no such route")
            except Refused as e:
                self.reply({"error": str(e)}, e.status)

        def do_GET(self) -> None:  # noqa: N802
            self.route("GET")

        def do_POST(self) -> None:  # noqa: N802
            self.route("POST")

        def do_DELETE(self) -> None:  # noqa: N802
            self.route("DELETE")

    return ThreadingHTTPServer((host, port), Handler)
