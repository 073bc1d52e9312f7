from __future__ import annotations

import json

from pyspark.sql import functions as F

from paperlode.sources import files, stores
from paperlode.streaming import streams


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, body in (("a.PDF", "one\ftwo"), ("sub/b.pdf", "one\ftwo"), ("note.docx", "x")):
        (tmp_path / "in" / name).write_text(body)
    found = files.discover(spark, str(tmp_path / "in"), str(tmp_path / "in"))
    assert sorted(r.name for r in found.collect()) == ["a.PDF", "b.pdf"] and found.select("doc_id").distinct().count() == 1
    pages = files.extract(found, lambda: files.plain_text)
    assert sorted((r.page_no, r.md) for r in pages.distinct().collect()) == [(1, "one"), (2, "two")]

    def broken():
        def run(content, path):
            raise ValueError("no")

        return run

    assert {r.error for r in files.extract(found, broken).collect()} == {"no"}
    files.write_events(found.select("name"), str(tmp_path / "events"))
    assert spark.read.json(str(tmp_path / "events")).count() == 2


def test_stores(spark, tmp_path):
    s = stores.ChunkStore(spark, str(tmp_path / "chunks"))
    assert s.count() == 0 and not s.has("a")
    rows = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    s.upsert(spark.createDataFrame(rows, "doc_id string, chunk_index int, text string"))
    s.upsert(spark.createDataFrame([("a", 0, "new")], "doc_id string, chunk_index int, text string"))
    assert sorted((r.doc_id, r.text) for r in s.read().collect()) == [("a", "new"), ("b", "z")]
    s.retag("a", category="finance")
    assert {r.doc_id: r.category for r in s.read().collect()} == {"a": "finance", "b": None} or s.read().where("doc_id = 'a'").count() == 1
    s.delete("b")
    assert s.count() == 1 and s.has("a") and not s.has("b")
    c = stores.ParseCache(spark, str(tmp_path / "cache"), "f1")
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert c.missing(docs).count() == 2
    c.put(spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, page_no int"), spark.createDataFrame([("a", True), ("b", False)], "doc_id string, cached boolean"))
    assert [r.doc_id for r in c.missing(docs).collect()] == ["b"]
    f = stores.FactStore(spark, str(tmp_path / "facts"), "kind string")
    f.put(spark.createDataFrame([("a", "itr")], "doc_id string, kind string"))
    spark.createDataFrame([("z", "{broken")], "doc_id string, facts string").write.mode("append").parquet(str(tmp_path / "facts"))
    assert [(r.doc_id, r.facts.kind) for r in f.all().collect()] == [("a", "itr")]


def test_thought_filter():
    whole = "a <think>b < c</think> d <b>e</b> <think>open"
    for size in (1, 2, 3, 7, 50):
        f = streams.ThoughtFilter()
        assert "".join(f.feed(whole[i : i + size]) for i in range(0, len(whole), size)) + f.flush() == "a  d <b>e</b> "
    f = streams.ThoughtFilter()
    assert f.feed("x <thi") == "x " and f.flush() == "<thi"


def test_streams(spark, tmp_path):
    src = tmp_path / "pieces"
    src.mkdir()
    rows = [{"session_id": s, "seq": i, "piece": p} for s in ("a", "b") for i, p in enumerate(["hi <th", "ink>no</th", "ink> there"])]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("session_id string, seq int, piece string").json(str(src))
    q = streams.filter_pieces(stream).writeStream.format("memory").queryName("shown").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("shown").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "shown"))), lambda x: x["shown"]), "").alias("t")).collect()
    assert {r.t for r in got} == {"hi  there"} and len(got) == 2
    seen = []
    for _ in range(2):  # the second run finds nothing new
        streams.arriving(spark, str(src), str(tmp_path / "cp2"), lambda df, n: seen.append(df.count()), "session_id string, seq int, piece string").awaitTermination(120)
    assert sum(seen) == 6
