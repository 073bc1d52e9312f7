"""Settings, the server's routes and jobs, the chat command, and extraction in two passes."""

from __future__ import annotations

import io
import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from paperlode.cli import main
from paperlode.plans.pipeline import Library
from paperlode.server import Service, serve
from paperlode.settings import Settings
from paperlode.sources import files

STATEMENT = "EXAMPLE BANK\nAccount Number : 1234567890\n| Date | Narration | Debit | Credit | Balance |\n|---|---|---|---|---|\n| 01/04/2021 | open |  | 100.00 | 100.00 |\n| 05/04/2021 | rent | 40.00 |  | 60.00 |\n"


def test_settings():
    s = Settings.load({"PAPERLODE_TOP_K": "9", "PAPERLODE_DATA_DIR": "x"}, data_dir="y", port=None)
    assert (s.top_k, s.data_dir, s.port) == (9, "y", 8000)
    with pytest.raises(ValueError, match="top_k"):
        Settings.load({"PAPERLODE_TOP_K": "many"})


def test_routes(spark, tmp_path):
    service = Service(Library(spark, str(tmp_path / "lib")), Settings(upload_max_mb=1))
    server = serve(service, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", body, method=method)) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert len(json.loads(call("GET", "/api/meta")[1])["types"]) == 16 and call("GET", "/api/documents") == (200, "[]")
        assert call("POST", "/api/documents?name=a.exe", b"x")[0] == 400 and call("POST", "/api/documents?name=a.pdf&doc_type=odd", b"x")[0] == 400
        assert call("POST", "/api/documents?name=a.pdf", b"x" * (1 << 20 | 1))[0] == 413
        assert call("POST", "/api/ask", b"{}")[0] == 400 and call("POST", "/api/ask", b"[")[0] == 400 and call("GET", "/api/jobs/none")[0] == 404 and call("GET", "/x")[0] == 404
        status, job = call("POST", "/api/documents?name=..%2Fs.pdf&doc_type=bank_statement", STATEMENT.encode())
        assert status == 202
        for _ in range(240):
            state = json.loads(call("GET", "/api/jobs/" + json.loads(job)["id"])[1])
            if state["status"] not in ("queued", "running"):
                break
            time.sleep(0.5)
        assert state["status"] == "done" and state["file"] == "s.pdf" and len(json.loads(call("GET", "/api/jobs")[1])) == 1
        (doc,) = json.loads(call("GET", "/api/documents")[1])
        assert doc["doc_type"] == "bank_statement" and "…7890" in doc["summary"]
        events = [json.loads(x) for x in call("POST", "/api/ask", json.dumps({"question": "closing balance", "doc_id": doc["doc_id"]}).encode())[1].splitlines()]
        assert events[-1]["route"] == "facts" and "| 60 |" in events[-1]["text"]
        out = io.StringIO()
        assert main(["--data-dir", str(tmp_path / "lib"), "chat"], spark, out, ["closing balance\n", "\n", "never\n"]) == 0 and out.getvalue().count('"event"') == 1
        assert json.loads(call("DELETE", "/api/documents/" + doc["doc_id"])[1]) == {"deleted": doc["doc_id"]} and call("GET", "/api/documents")[1] == "[]"
    finally:
        server.shutdown()
        service.queue.shutdown(wait=False, cancel_futures=True)


def test_two_passes(spark):
    d = spark.createDataFrame([("a", "p", bytearray(b"fine\f\f1 2\f9")), ("b", "bad", bytearray(b"x"))], "doc_id string, path string, content binary")

    def first():
        def run(content, path):
            if path == "bad":
                raise ValueError("broken")
            return files.plain_text(content, path)

        return run

    got = {(r.doc_id, r.page_no): (r.md, r.error, r.second) for r in files.extract_in_passes(d, first, lambda: lambda c, p, pages: [(n, f"again {n}") for n in pages if n != 4], lambda md: md[0].isdigit()).collect()}
    assert got == {("a", 1): ("fine", None, False), ("a", 2): ("again 2", None, True), ("a", 3): ("again 3", None, True), ("a", 4): ("9", None, False), ("b", None): (None, "broken", False)}
