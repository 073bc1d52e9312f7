"""Queries of ranking, prompts, answers and layout, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.functions.scalars import column_kind, keywords
from paperlode.operators import answers, facts, layout, retrieval
from paperlode.plans import sqltext as x
from paperlode.plans.statements import _TX
from paperlode.tables import table

QUESTION = "monthly rent of the lease and security deposit"
QUESTIONS = (
    (1, "What is the closing balance of each account?"), (2, "Largest credits by bank"), (3, "Why did the balance fall?"), (4, "Total income for AY 2021-22"), (5, "Who received 500 on 03/04/2021?"), (6, "Tell me about the lease"), (7, ""), (8, "Which bank and PAN?"),
)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for a question by keywords."""
    r = retrieval.bm25_topk(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", QUESTION, 10)
    return r.select("doc_id", F.round("bm25", 6).alias("score"))


def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and documents of every keyword."""
    w = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(keywords(F.coalesce("text", F.lit("")))).alias("term"))
    by_doc = w.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors most similar to the one of the smallest vec_id, among those of the labels up to 4, as its
    SQL does; :func:`knn_cosine_all` has every query row against all rows."""
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    q = v.orderBy("vec_id").limit(1).first()  # the query itself
    return retrieval.nearest(v, "vec_id", "embedding", q.embedding, 10, F.col("label") <= 4).select("vec_id", F.round("similarity", 6).alias("similarity"))


def knn_cosine_all(spark: SparkSession, d: str) -> DataFrame:
    """For every row whose vec_id is divisible by 50, the ten most similar of all rows."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    return retrieval.nearest_of_each(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


def knn_cosine_labels(spark: SparkSession, d: str) -> DataFrame:
    """The same among the rows of the labels up to 4."""
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return retrieval.nearest_of_each(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, F.col("label") <= 4)


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks by similarity and keywords together."""
    return retrieval.hybrid(_chunks(spark, d), QUESTION).select("chunk_id", F.round("score", 6).alias("score"))


def filtered_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same among leases."""
    return retrieval.hybrid(_chunks(spark, d), QUESTION, cond=retrieval.where(doc_type="lease", source=None, category="all")).select("chunk_id", F.round("score", 6).alias("score"))


def context_budget_cut(spark: SparkSession, d: str) -> DataFrame:
    """The first chunks of every document that fit 2,000 tokens."""
    c = _chunks(spark, d).where("text is not null")
    return retrieval.budget_cut(c, [F.col("doc_id")], [F.col("chunk_index"), F.col("chunk_id")], "text", 2000).select("chunk_id", "rn", "spent")


def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    """How chunks are cited."""
    return _chunks(spark, d).select("chunk_id", retrieval.source_label(F.col("source"), F.col("page_start"), F.col("page_end"), F.coalesce("account", "return_no"), F.col("heading_path")).alias("label"))


def question_intents(spark: SparkSession, d: str) -> DataFrame:
    """What each question asks of facts."""
    q = spark.createDataFrame(list(QUESTIONS), "q_id int, question string")
    debit, credit = answers.wants(F.col("question"))
    return q.select("q_id", answers.intent(F.col("question")).alias("intent"), debit.alias("debits"), credit.alias("credits"), answers.year_asked(F.col("question"), F.lit("2020-21")).alias("year"))


def model_routes(spark: SparkSession, d: str) -> DataFrame:
    """The model for whole documents, by the category of their first chunk (B9 by hits: ``routes_by_hits``)."""
    c = _chunks(spark, d)
    best = c.groupBy("doc_id").agg(F.min_by("category", "chunk_index").alias("best"))
    return best.select("doc_id", F.when(F.col("best") == "finance", "finance").otherwise("general").alias("route"))


def quick_bank_answers(spark: SparkSession, d: str) -> DataFrame:
    """The account table of every statement."""
    lines = table(spark, d, "doc_lines", "doc_id", "line_no", "page", "text", "cells", "loaded_at")
    names = table(spark, d, "doc_lines", "doc_id", "source").groupBy("doc_id").agg(F.min("source").alias("source"))
    return answers.bank_tables(facts.statement_facts(facts.distinct_lines(lines)), names)


def quick_return_answers(spark: SparkSession, d: str) -> DataFrame:
    """The table of every file of returns."""
    lines = table(spark, d, "doc_lines", "doc_id", "line_no", "page", "text", "cells", "loaded_at")
    return answers.return_tables(facts.returns(facts.distinct_lines(lines)))


def facts_rendered(spark: SparkSession, d: str) -> DataFrame:
    """The facts of every document as text for a prompt."""
    lines = facts.distinct_lines(table(spark, d, "doc_lines", "doc_id", "line_no", "page", "text", "cells", "loaded_at"))
    names = table(spark, d, "doc_lines", "doc_id", "source").groupBy("doc_id").agg(F.min("source").alias("source"))
    return answers.rendered_returns(facts.returns(lines), names).unionByName(answers.rendered_accounts(facts.statement_facts(lines), names))


def fact_summaries(spark: SparkSession, d: str) -> DataFrame:
    """One line for every document with facts."""
    lines = facts.distinct_lines(table(spark, d, "doc_lines", "doc_id", "line_no", "page", "text", "cells", "loaded_at"))
    parts = facts.sections(lines)
    return answers.summaries(parts.join(facts.banks(facts.section_lines(lines, parts)), ["doc_id", "account_number"], "left"), facts.returns(lines))


def hits_facts(spark: SparkSession, d: str) -> DataFrame:
    """The first three documents with chunks of every source (C2 by hits: ``hits_to_facts``)."""
    from pyspark.sql import Window

    c = _chunks(spark, d).select("source", "doc_id").distinct()
    return c.withColumn("rank", F.dense_rank().over(Window.partitionBy("source").orderBy("doc_id"))).where("rank <= 3")


# --- layout: words made from events -----------------------------------------------------------------------------
_COLS = (("Date", "date", 20.0, 60.0), ("Details", "text", 80.0, 200.0), ("Debit", "debit", 250.0, 300.0), ("Credit", "credit", 330.0, 380.0), ("Balance", "balance", 420.0, 480.0))


def _words(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    text = F.when(F.col("event_type") == "purchase", F.format_string("%d.00", F.floor("value"))).when(F.col("event_type") == "signup", "Cr").when(F.col("event_type") == "error", "INR").when(F.col("event_type") == "click", F.concat(F.lit("click"), F.col("event_id").cast("string"))).otherwise("Txn")
    x0 = ((F.col("event_id") * 37) % 500).cast("double")
    return e.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("event_id").alias("word_no"), text.alias("text"), x0.alias("x0"), (x0 + 24).alias("x1"), ((F.col("event_id") * 7) % 9973).cast("double").alias("top"), "event_type", "value")


def _columns() -> Column:
    return F.array(*(F.struct(F.lit(a).alias("label"), F.lit(k).alias("kind"), F.lit(p).alias("x0"), F.lit(r).alias("x1")) for a, k, p, r in _COLS))


def nearest_column(spark: SparkSession, d: str) -> DataFrame:
    """The column of every word."""
    w = _words(spark, d)
    return w.select("word_no", layout.assign(F.col("text"), F.col("x0"), F.col("x1"), _columns()).alias("col"))


def asof_record(spark: SparkSession, d: str) -> DataFrame:
    """The record of every line: the last purchase at or above it."""
    w = _words(spark, d).withColumn("anchor", F.col("event_type") == "purchase")
    return layout.record_above(w, ["doc_id"], "top", "anchor").select("word_no", "record")


def nearest_record(spark: SparkSession, d: str) -> DataFrame:
    """The nearest purchase of every line, within the usual step."""
    w = _words(spark, d).select("doc_id", "word_no", "top", "event_type")
    anchors = w.where("event_type = 'purchase'")
    gap = layout.median_gap(anchors.select("doc_id", "top"), ["doc_id"], "top")
    return layout.record_nearest(w, anchors.select("doc_id", "top"), ["doc_id"], "top", gap).select("word_no", "record_y")


def median_gap(spark: SparkSession, d: str) -> DataFrame:
    """The usual step between records."""
    w = _words(spark, d).where("event_type = 'purchase'").select("doc_id", "top")
    return layout.median_gap(w, ["doc_id"], "top")


def header_labels(spark: SparkSession, d: str) -> DataFrame:
    """Words joined to labels with their kinds."""
    w = _words(spark, d).withColumn("x0", F.col("word_no") % 97 * 28.0 + F.floor(F.col("word_no") / 97) * 3000).withColumn("x1", F.col("x0") + 24)
    return layout.merge_labels(w.where("event_type <> 'view'"), ["doc_id"]).select("doc_id", "pos", "label", "kind")


def column_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of every header-like cell."""
    c = table(spark, d, "doc_lines", "cells").select(F.posexplode("cells").alias("pos", "label")).where("label rlike '^[A-Za-z ./]+$'").distinct()
    return c.select("pos", "label", column_kind("label", F.col("pos")).alias("kind"))


def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Heading levels of lines by their size."""
    w = _words(spark, d).select("doc_id", "word_no", "text", F.col("value").alias("size"), F.when(F.col("word_no") % 3 == 0, 1.0).otherwise(0.0).alias("bold"))
    return layout.heading_level(w, ["doc_id"]).select("word_no", "level")


def words_outside(spark: SparkSession, d: str) -> DataFrame:
    """K6: words whose centre lies in no box."""
    w = _words(spark, d).withColumn("bottom", F.col("top") + 8)
    boxes = w.where("event_type = 'signup'").select("doc_id", (F.col("x0") - 40).alias("x0"), (F.col("x1") + 40).alias("x1"), (F.col("top") - 60).alias("top"), (F.col("bottom") + 60).alias("bottom"))
    return layout.inside(w, boxes, ["doc_id"]).select("word_no")


def fallback_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with many lines of figures outside tables."""
    lines = facts.distinct_lines(table(spark, d, "doc_lines")).where("cells is null")
    return layout.needs_fallback(lines, ["doc_id", "page"])


def geometry_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """How far the rows of an account bear out their balances, in the better direction."""
    lines = facts.distinct_lines(table(spark, d, "doc_lines", "doc_id", "line_no", "page", "text", "cells", "loaded_at"))
    tx = facts.transactions(facts.section_lines(lines, facts.sections(lines)))
    r = layout.reconcile_rate(tx, ["doc_id", "account_number"], "line_no")
    return r.select("doc_id", "account_number", F.round("rate", 6).alias("rate"))


def tables_markdown(spark: SparkSession, d: str) -> DataFrame:
    """K3, K4: the rows of every page of a return as a pipe table."""
    lines = facts.distinct_lines(table(spark, d, "doc_lines")).where("cells is not null").join(table(spark, d, "doc_lines", "doc_id", "doc_type").where("doc_type = 'itr'").select("doc_id").distinct(), "doc_id", "left_semi")
    g = lines.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "cells"))), lambda r: r["cells"]).alias("rows"))
    return g.select("doc_id", "page", layout.to_markdown(F.col("rows")).alias("md"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, keyword_counts, knn_cosine_topk, knn_cosine_all, knn_cosine_labels, hybrid_topk, filtered_hybrid_topk, context_budget_cut, citation_labels, question_intents, model_routes, quick_bank_answers, quick_return_answers, facts_rendered, fact_summaries, hits_facts,
        nearest_column, asof_record, nearest_record, median_gap, header_labels, column_kinds, heading_levels, words_outside, fallback_pages, geometry_reconcile, tables_markdown,
    )
}

_TEXT_WORDS = x.keywords("coalesce(text, '')")
_TERMS = sorted({w for w in retrieval._words(QUESTION)})
_TERM_SQL = "(VALUES " + ", ".join(f"('{t}')" for t in _TERMS) + ") q(term)"


def _bm25(src: str, key: str) -> str:
    return (
        f"tk AS (SELECT {key} AS k, {_TEXT_WORDS} AS t FROM {src}), st AS (SELECT count(*) AS n, CASE WHEN avg(len(t)) > 0 THEN avg(len(t)) ELSE 1 END AS av FROM tk), "
        f"tf AS (SELECT k, len(t) AS dl, term, len(list_filter(t, lambda y: y = term)) AS tf FROM tk, {_TERM_SQL}), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1), "
        f"bm AS (SELECT k, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av)) ELSE 0 END) AS bm25 FROM tf LEFT JOIN df USING (term), st GROUP BY 1)"
    )


_CHUNK1 = "c1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id) AS rn FROM chunks) WHERE rn = 1)"
_SLOTS = {i: v for i, v in enumerate(retrieval.embed_query(QUESTION)) if v}


def _hybrid(cond: str) -> str:
    words = x.keywords("coalesce(text, '')")
    dot = " + ".join(f"len(list_filter(s, lambda y: y = {i})) * {v!r}::DOUBLE" for i, v in sorted(_SLOTS.items()))
    return (
        f"WITH {_CHUNK1}, sl AS (SELECT chunk_id, text, list_transform({words}, lambda w: CAST('0x' || right(md5(w), 2) AS INT)) AS s FROM c1 WHERE {cond}), "
        f"si AS (SELECT chunk_id, text, CASE WHEN len(s) > 0 THEN ({dot}) / sqrt(list_sum(list_transform(list_distinct(s), lambda i: pow(len(list_filter(s, lambda y: y = i)), 2)))) ELSE 0 END AS sim FROM sl), "
        f"ca AS (SELECT * FROM si ORDER BY round(sim, 12) DESC, chunk_id LIMIT 20), {_bm25('ca', 'chunk_id')} "
        "SELECT chunk_id, round(0.6 * sim + 0.4 * bm25 / CASE WHEN max(bm25) OVER () > 0 THEN max(bm25) OVER () ELSE 1 END, 6) AS score FROM ca JOIN bm ON ca.chunk_id = bm.k ORDER BY 0.6 * sim + 0.4 * bm25 / CASE WHEN max(bm25) OVER () > 0 THEN max(bm25) OVER () ELSE 1 END DESC, chunk_id LIMIT 5"
    )


_WORDS = (
    "w AS (SELECT user_id AS doc_id, event_id AS word_no, event_type, value, CASE event_type WHEN 'purchase' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.00' WHEN 'signup' THEN 'Cr' WHEN 'error' THEN 'INR' WHEN 'click' THEN 'click' || event_id ELSE 'Txn' END AS text, "
    "CAST((event_id * 37) % 500 AS DOUBLE) AS x0, CAST((event_id * 37) % 500 AS DOUBLE) + 24 AS x1, CAST((event_id * 7) % 9973 AS DOUBLE) AS top FROM events)"
)
_MIDS = [(a + b) / 2 for _, _, a, b in _COLS]
_BOUNDS = [(a + b) / 2 for a, b in zip(_MIDS, _MIDS[1:], strict=False)]
_BY_EDGE = "CASE WHEN least(abs(300 - x1), abs(380 - x1), abs(480 - x1)) = abs(300 - x1) THEN 3 WHEN least(abs(300 - x1), abs(380 - x1), abs(480 - x1)) = abs(380 - x1) THEN 4 ELSE 5 END"
_PLACED = f"CASE WHEN (x0 + x1) / 2 <= {_BOUNDS[0]} THEN 1 ELSE 2 END"
ORACLES = {
    "bm25_topk": f"WITH {_bm25('documents', 'doc_id')} SELECT k AS doc_id, round(bm25, 6) AS score FROM bm WHERE bm25 > 0 ORDER BY bm25 DESC, k LIMIT 10",
    "keyword_counts": f"SELECT term, sum(n)::BIGINT AS occurrences, count(*) AS documents FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TEXT_WORDS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1",
    "knn_cosine_topk": "WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)) * list_sum(list_transform(q, lambda e: e::DOUBLE * e::DOUBLE))) AS s FROM embeddings, q WHERE label <= 4) SELECT vec_id, round(s, 6) AS similarity FROM d ORDER BY s DESC, vec_id LIMIT 10",
    "hybrid_topk": _hybrid("true"),
    "filtered_hybrid_topk": _hybrid("doc_type = 'lease'"),
    "context_budget_cut": f"WITH {_CHUNK1}, s AS (SELECT chunk_id, row_number() OVER w AS rn, sum({x.tokens('text')}) OVER (w ROWS UNBOUNDED PRECEDING) AS spent FROM c1 WHERE text IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index, chunk_id)) SELECT chunk_id, rn, spent::BIGINT AS spent FROM s WHERE rn = 1 OR spent <= 2000",
    "citation_labels": f"WITH {_CHUNK1} SELECT chunk_id, concat_ws(', ', concat_ws(' ', source, CASE WHEN page_end > page_start THEN 'pp.' || page_start || '-' || page_end ELSE 'p.' || page_start END), coalesce(account, return_no), heading_path[-1]) AS label FROM c1",
    "model_routes": f"WITH {_CHUNK1} SELECT doc_id, CASE WHEN arg_min(category, chunk_index) = 'finance' THEN 'finance' ELSE 'general' END AS route FROM c1 GROUP BY 1",
    "hits_facts": f"WITH {_CHUNK1} SELECT * FROM (SELECT source, doc_id, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM (SELECT DISTINCT source, doc_id FROM c1)) WHERE rank <= 3",
    "nearest_column": f"WITH {_WORDS} SELECT word_no, CASE WHEN upper(text) = 'INR' THEN NULL WHEN upper(text) = 'CR' THEN {_BY_EDGE} WHEN event_type = 'purchase' AND least(abs(300 - x1), abs(380 - x1), abs(480 - x1)) <= 45 THEN {_BY_EDGE} ELSE {_PLACED} END AS col FROM w",
    "asof_record": f"WITH {_WORDS} SELECT word_no, CASE WHEN n > 0 THEN n END AS record FROM (SELECT word_no, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY doc_id ORDER BY top RANGE UNBOUNDED PRECEDING) AS n FROM w)",
    "median_gap": f"WITH {_WORDS}, s AS (SELECT doc_id, top - lag(top) OVER (PARTITION BY doc_id ORDER BY top) AS s FROM w WHERE event_type = 'purchase') SELECT doc_id, coalesce(median(s), 20.0) AS gap FROM s GROUP BY 1",
    "nearest_record": f"WITH {_WORDS}, s AS (SELECT doc_id, top - lag(top) OVER (PARTITION BY doc_id ORDER BY top) AS s FROM w WHERE event_type = 'purchase'), g AS (SELECT doc_id, coalesce(median(s), 20.0) AS gap FROM s GROUP BY 1), "
    "n AS (SELECT w.word_no, any_value(w.top) AS y, any_value(gap) AS gap, arg_min(a.top, (abs(a.top - w.top), a.top)) AS record_y FROM w JOIN w a ON a.doc_id = w.doc_id AND a.event_type = 'purchase' JOIN g ON g.doc_id = w.doc_id GROUP BY 1) SELECT word_no, record_y FROM n WHERE abs(record_y - y) <= gap + 1",
    "heading_levels": f"WITH {_WORDS}, b AS (SELECT doc_id, coalesce(median(value), 10.0) AS body FROM w GROUP BY 1) SELECT word_no, CASE WHEN length(text) > 120 OR length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 3 THEN 0 WHEN value >= body * 1.45 THEN 2 WHEN value >= body * 1.15 THEN 3 WHEN word_no % 3 = 0 AND NOT regexp_matches(text, '\\d[\\d,]*\\.\\d{{2}}|\\d{{4,}}') THEN 3 ELSE 0 END AS level FROM w JOIN b USING (doc_id)",
    "words_outside": f"WITH {_WORDS} SELECT word_no FROM w WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.doc_id = w.doc_id AND b.event_type = 'signup' AND (w.x0 + w.x1) / 2 BETWEEN b.x0 - 41 AND b.x1 + 41 AND w.top + 4 BETWEEN b.top - 61 AND b.top + 69)",
    "fallback_pages": f"WITH {x.LINES} SELECT doc_id, page, count(*) FILTER (len(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?')) >= 2) >= 6 AS needs_fallback FROM l WHERE cells IS NULL GROUP BY 1, 2",
}
_K = x.squash("label")
ORACLES["column_kinds"] = (
    f"SELECT pos, label, CASE WHEN {_K} LIKE '%balance%' OR {_K} IN ('bal', 'closingbal') THEN 'balance' WHEN {_K} LIKE '%debit%' OR {_K} LIKE '%withdrawal%' OR {_K} = 'dr' THEN 'debit' WHEN {_K} LIKE '%credit%' OR {_K} LIKE '%deposit%' OR {_K} = 'cr' THEN 'credit' WHEN {_K} LIKE '%value%' THEN 'text' "
    f"WHEN {_K} LIKE '%date%' OR (pos = 0 AND {_K} IN ('transaction', 'txn', 'tran', 'txndt', 'trandate')) THEN 'date' ELSE 'text' END AS kind FROM (SELECT DISTINCT pos, label FROM (SELECT unnest(range(len(cells))) AS pos, unnest(cells) AS label FROM doc_lines WHERE cells IS NOT NULL) WHERE regexp_matches(label, '^[A-Za-z ./]+$'))"
)
_OK = "CASE WHEN {p} IS NOT NULL THEN CAST(abs({p} - coalesce(debit, 0) + coalesce(credit, 0) - balance) < 0.015 AS INT) END"
ORACLES["geometry_reconcile"] = f"WITH {_TX}, f AS (SELECT doc_id, account_number, {_OK.format(p='lag(balance) OVER w')} AS f, {_OK.format(p='lead(balance) OVER w')} AS b FROM tx WINDOW w AS (PARTITION BY doc_id, account_number ORDER BY line_no)) SELECT doc_id, account_number, round(greatest(coalesce(avg(f), 0), coalesce(avg(b), 0)), 6) AS rate FROM f GROUP BY 1, 2"
_HEADERS = f"{_WORDS}, h AS (SELECT doc_id, text, word_no % 97 * 28.0 + (word_no // 97) * 3000 AS x0, word_no % 97 * 28.0 + (word_no // 97) * 3000 + 24 AS x1 FROM w WHERE event_type <> 'view'), g AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x0) < 6 THEN 0 ELSE 1 END AS new FROM h), n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY x0 ROWS UNBOUNDED PRECEDING) - 1 AS pos FROM g), labels AS (SELECT doc_id, pos, string_agg(text, ' ' ORDER BY x0) AS label FROM n GROUP BY 1, 2)"
_CASES = ORACLES["column_kinds"].split(" AS kind FROM")[0].split("label, ", 1)[1]
ORACLES["header_labels"] = f"WITH {_HEADERS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, label, {_CASES} AS kind FROM labels"
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x.q(t)})" for i, t in QUESTIONS) + ") t(q_id, question))"
_HAS = lambda p: f"regexp_matches(question, {x.q(p)})"
_YEAR = "\\b(20\\d{2})\\s*[-/]\\s*(20\\d{2}|\\d{2})\\b"
ORACLES["question_intents"] = (
    f"WITH {_Q} SELECT q_id, CASE WHEN {_HAS(answers.MODEL_ONLY)} OR trim(question) = '' THEN 'model' WHEN {_HAS(answers.BANK)} AND {_HAS(answers.TAX)} THEN 'both' WHEN {_HAS(answers.BANK)} THEN 'bank' WHEN {_HAS(answers.TAX)} THEN 'tax' ELSE 'none' END AS intent, "
    f"{_HAS(answers.TOP)} AND (regexp_matches(question, '(?i)debit|withdraw|spent|paid') OR NOT regexp_matches(question, '(?i)credit|deposit')) AS debits, {_HAS(answers.TOP)} AND (regexp_matches(question, '(?i)credit|deposit|receiv') OR NOT regexp_matches(question, '(?i)debit|withdraw')) AS credits, "
    f"CASE WHEN regexp_matches(question, '{_YEAR}') THEN regexp_extract(question, '{_YEAR}', 1) || '-' || right(regexp_extract(question, '{_YEAR}', 2), 2) ELSE '2020-21' END AS year FROM q"
)
