"""Answers from stored facts, facts before passages, rerank and embedding hooks, stores that grow, streams that end."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from paperlode.operators import retrieval
from paperlode.plans.pipeline import FACTS_MARK, NOTE, Library, numbered_lines
from paperlode.sources import stores
from paperlode.streaming import streams

BANK = "EXAMPLE BANK\nAccount Number : {}\n| Date | Narration | Debit | Credit | Balance |\n|---|---|---|---|---|\n| 01/04/2021 | open |  | 100.00 | 100.00 |\n| 05/04/2021 | rent | 40.00 |  | 60.00 |\n"


class Words:
    def documents(self, texts):
        return [retrieval.embed_query(t) for t in texts]

    def query(self, text):
        return retrieval.embed_query(text)


def test_facts_answer_and_lead_the_prompt(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(7):
        (folder / f"s{i}.pdf").write_text(BANK.format(1234567890 + i) + f"\f# Notes {i}\nThe monthly rent of flat {i} is 9,50{i}.\n")
    lib = Library(spark, str(tmp_path / "lib"), make_embedder=Words, judge=lambda q, texts: [float("flat 3" in t) for t in texts])
    lib.ingest(str(folder), doc_type="bank_statement").collect()
    quick = lib.instant("closing balance of each account")
    assert len(quick) == 7 and all(any(f"| {1234567890 + i} |" in q for q in quick) for i in range(7))
    (answer,) = lib.ask("Largest debits by bank")
    assert answer["text"].endswith(NOTE) and answer["text"].count("**Largest debits**") == 7 and "Largest credits" not in answer["text"]
    one = lib.chunks.read().where("source like '%s2.pdf'").first()["doc_id"]
    assert len(lib.instant("closing balance", doc_id=one)) == 1
    assert lib.instant("closing balance", category="property") == [] and lib.instant("why is the balance low") == []
    told = []
    events = list(lib.ask("Explain the rent of flat 3", model=lambda m: told.append(m) or iter(["9,503 and 60"]), finance_model=lambda m: told.append("finance") or iter(["9,503 and 60"])))
    assert told == ["finance"] and events[0]["route"] == "finance" and events[-1]["unverified"] == []
    list(lib.ask("Explain the rent of flat 3", model=lambda m: told.append(m) or iter(["x"])))
    prompt = told[-1][1][1]
    assert prompt.startswith(FACTS_MARK) and prompt.count(" account(s) in this file") == 3 and "flat 3" in prompt.split("[1]")[1].split("[2]")[0]


def test_line_numbers_follow_the_page(spark):
    pages = spark.createDataFrame([("d", 30_000, "\n".join(["x"] * 3)), ("d", 1, "y")], "doc_id string, page_no int, md string")
    got = [r.text for r in numbered_lines(pages).orderBy("line_no").collect()]
    assert got == ["y", "x", "x", "x"]


def test_a_store_deals_its_rows_out_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "BUCKETS", 2)
    monkeypatch.setattr(stores, "FOLDER_ROWS", 3)
    s = stores.ChunkStore(spark, str(tmp_path / "c"))
    s.upsert(spark.createDataFrame([(f"d{i}", "x") for i in range(20)], "doc_id string, text string"))
    assert s.buckets() == 8 and s.count() == 20
    s.upsert(spark.createDataFrame([("d3", "new")], "doc_id string, text string"))
    s.delete("d4")
    assert s.count() == 19 and s.read().where("doc_id = 'd3'").first().text == "new"


def test_facts_are_replaced_and_forgotten(spark, tmp_path):
    f = stores.FactStore(spark, str(tmp_path / "f"), "kind string")
    assert f.all().count() == 0
    for kind in ("itr", "bank_statement"):
        f.put(spark.createDataFrame([("a", kind), ("b", kind)], "doc_id string, kind string"))
    assert {r.facts.kind for r in f.all().collect()} == {"bank_statement"} and f.get("a").count() == 1
    f.delete("a")
    f.compact()
    assert [r.doc_id for r in f.all().collect()] == ["b"]


def test_a_session_that_ends_shows_what_was_held(spark, tmp_path):
    src = tmp_path / "pieces"
    src.mkdir()
    rows = [{"session_id": "a", "seq": 0, "piece": "done <th", "last": False}, {"session_id": "a", "seq": 1, "piece": None, "last": True}]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("session_id string, seq int, piece string, last boolean").json(str(src))
    q = streams.filter_pieces(stream).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert "".join(r.shown for r in spark.table("ended").orderBy("seq").collect()) == "done <th"


def test_rerank_and_embedder_on_odd_rows(spark):
    d = spark.createDataFrame([("a", "rent"), ("b", None), ("c", "")], "chunk_id string, text string")
    e = retrieval.embedded(d, "text", Words)
    assert e.where(F.size("embedding") == 256).count() == 3 and retrieval.embedded(d.limit(0), "text", Words).count() == 0
    got = retrieval.reranked(d, "q", lambda q, texts: [float(len(t)) for t in texts], 2).collect()
    assert [r.chunk_id for r in got] == ["a", "b"] and retrieval.reranked(d.limit(0), "q", lambda q, t: [], 2).count() == 0
