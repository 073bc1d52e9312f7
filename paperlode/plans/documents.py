"""Queries of text, pages, listings and ingest, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.functions.scalars import ascii_digits, assessment_year, clean_cell, est_tokens, page_span, shorten, signed, suffix_of_tag, without_thoughts
from paperlode.operators import facts, grounding, ingest, listing, text
from paperlode.plans import sqltext as x
from paperlode.tables import table

THOUGHT = "<think>"


def doc_content_id(spark: SparkSession, d: str) -> DataFrame:
    """A2: content ids."""
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", ingest.content_id(F.col("text").cast("binary")).alias("content_id"))


def doc_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Repeated documents and the one they repeat."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("name"), ingest.content_id(F.col("text").cast("binary")).alias("doc_id"))
    return ingest.duplicates(t).select(F.col("pos").alias("doc_id"), "status", "error")


def doc_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of every document."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", est_tokens("text").cast("bigint").alias("tokens"))


def chunk_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """I1 over chunks, summed by document."""
    c = table(spark, d, "chunks", "chunk_id", "doc_id", "text").dropDuplicates(["chunk_id"])
    return c.groupBy("doc_id").agg(F.sum(est_tokens("text")).alias("tokens"))


def page_triage(spark: SparkSession, d: str) -> DataFrame:
    """The kind of every page by its text."""
    p = _pages(spark, d)
    return ingest.triage(ingest.page_stats(p).withColumn("image_coverage", (F.col("page_no") % 3) * 0.2)).select("doc_id", "page_no", "text_chars", "kind")


def doc_garbage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Garbage ratio of every document."""
    s = ingest.page_stats(table(spark, d, "documents", "doc_id", "text").withColumnRenamed("text", "md"))
    return s.select("doc_id", F.round("garbage_ratio", 6).alias("garbage_ratio"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages_in", "doc_id", "page_no", "md")
    return p.where("md is not null").groupBy("doc_id", "page_no").agg(F.max(F.struct(F.length("md"), "md")).alias("x")).select("doc_id", "page_no", F.col("x.md").alias("md"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines and cells of all pages."""
    return text.lines(table(spark, d, "pages_in", "doc_id", "page_no", "md"))


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Headings, tables and paragraphs of all pages."""
    return text.blocks(table(spark, d, "pages_in", "doc_id", "page_no", "md"))


def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with the headings over them."""
    return text.breadcrumbs(page_blocks(spark, d)).select("doc_id", "page", "block", "path")


def chunks_packed(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed into chunks."""
    return text.chunks(page_blocks(spark, d))


def markdown_assembled(spark: SparkSession, d: str) -> DataFrame:
    """The text of every document."""
    return text.assemble(table(spark, d, "pages_in", "doc_id", "page_no", "md"))


def embed_text_trim(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded of every chunk."""
    c = table(spark, d, "chunks", "chunk_id", "text", "heading_path", "has_table").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", text.embed_text(F.coalesce("text", F.lit("")), F.col("heading_path"), F.col("has_table")).alias("embedded"))


def doc_numbers(spark: SparkSession, d: str) -> DataFrame:
    """H4, H9: distinct numbers of every document."""
    return grounding.numbers(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", "value")


def unverified_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of every chunk that the chunk after it does not hold."""
    c = table(spark, d, "chunks", "chunk_id", "doc_id", "chunk_index", "text").dropDuplicates(["chunk_id"])
    # the numbers of every text are found once: as contexts they are the same rows under the key of the chunk before
    n = grounding.numbers(c.select(F.struct("doc_id", "chunk_index").alias("at"), "text"), "at", "text")
    key = lambda shift: F.concat_ws(":", "at.doc_id", (F.col("at.chunk_index") - shift).cast("string")).alias("key")
    own, before = (n.select(key(shift), "value", "raw", "pos") for shift in (0, 1))
    return grounding.flagged(own, before, "key").select("key", "value")


def cells_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """K1: table cells cleaned."""
    c = table(spark, d, "doc_lines", "text").where("text is not null").distinct()
    return c.select("text", clean_cell("text").alias("cleaned"))


def cells_signed(spark: SparkSession, d: str) -> DataFrame:
    """H3: the signed number inside a cell of 1 to 16 characters, as its SQL does; :func:`cells_signed_all` takes every cell."""
    c = table(spark, d, "doc_lines", "cells").select(F.explode("cells").alias("cell")).where(F.length("cell").between(1, 16)).distinct()
    return c.select("cell", signed("cell").alias("number"))


def cells_signed_all(spark: SparkSession, d: str) -> DataFrame:
    """H3: the signed number inside every distinct cell, of any length and with digits of any script."""
    c = table(spark, d, "doc_lines", "cells").select(F.explode("cells").alias("cell")).where("cell is not null").distinct()
    return c.select("cell", signed(ascii_digits("cell")).alias("number"))


def texts_shortened(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to 48 characters."""
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", shorten("text").alias("short"))


def years_named(spark: SparkSession, d: str) -> DataFrame:
    """The first assessment year a document names."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", assessment_year("text").alias("year")).where("year is not null")


def think_filter(spark: SparkSession, d: str) -> DataFrame:
    """M1: answers without the thoughts put into them."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    cut = F.floor(F.length("text") / 3).cast("int")
    said = F.concat(F.substr("text", F.lit(1), cut), F.lit(THOUGHT), F.substr("text", cut + 1, cut), F.when(F.col("doc_id") % 5 == 0, "").otherwise("</think>"), F.substr("text", 2 * cut + 1, F.lit(2**30)))
    return t.select("doc_id", without_thoughts(said).alias("answer"))


def tag_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """How much of a tag a cut-off answer ends with."""
    t = table(spark, d, "documents", "doc_id")
    return t.select("doc_id", suffix_of_tag(F.concat(F.lit("so "), F.substr(F.lit(THOUGHT), F.lit(1), (F.col("doc_id") % 8).cast("int"))), THOUGHT).alias("held"))


def page_spans(spark: SparkSession, d: str) -> DataFrame:
    """Page spans as text."""
    return table(spark, d, "bank_accounts", "doc_id", "account_number", "page_start", "page_end").distinct().select("doc_id", "account_number", page_span("page_start", "page_end").alias("pages"))


def documents_listing(spark: SparkSession, d: str) -> DataFrame:
    """Documents with chunks, pages, source."""
    return listing.documents(table(spark, d, "chunks").dropDuplicates(["chunk_id"])).select("doc_id", "chunks", "pages", "source", "category", "doc_type")


def docs_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by source."""
    return listing.by_source(table(spark, d, "chunks", "chunk_id", "source").dropDuplicates(["chunk_id"]))


def kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    """D3: kinds of pages by document, one row each."""
    h = listing.kind_histogram(page_triage(spark, d))
    return h.select("doc_id", F.explode("kinds").alias("kind", "n"))


def years_and_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct years and names of returns."""
    return listing.years(table(spark, d, "tax_returns", "assessment_year", "name"))


def year_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of returns by year."""
    return listing.year_pivot(table(spark, d, "tax_returns", "assessment_year", "acknowledgement_number", "amounts").dropDuplicates(["acknowledgement_number"]), ["gross_total_income", "total_income", "total_deductions"], ["2019-20", "2020-21", "2021-22", "2022-23"])


def chunk_types(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the label of their type."""
    return listing.with_type(table(spark, d, "chunks", "chunk_id", "doc_type").dropDuplicates(["chunk_id"]), listing.doc_types(spark)).groupBy("type_label").agg(F.count(F.lit(1)).alias("n"))


def type_options(spark: SparkSession, d: str) -> DataFrame:
    """Types by category."""
    return listing.type_options(listing.doc_types(spark))


def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    """The account of every chunk's first page, from stored accounts."""
    a = table(spark, d, "bank_accounts", "doc_id", "account_number", "page_start", "page_end").distinct().where("page_start is not null and page_end >= page_start")
    return listing.tagged_chunks(table(spark, d, "chunks", "chunk_id", "doc_id", "page_start").dropDuplicates(["chunk_id"]), a).select("chunk_id", "section_account")


def page_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive pages that came."""
    return ingest.page_runs(table(spark, d, "pages_in", "doc_id", "page_no"))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.pmod(F.floor(F.col("page_no") / 3), F.lit(4)) == 2, "scanned").when(F.pmod(F.floor(F.col("page_no") / 3), F.lit(4)) == 3, "hybrid").otherwise("digital")
    return table(spark, d, "doc_lines", "doc_id", F.col("page").alias("page_no")).distinct().withColumn("kind", k)


def shard_plan(spark: SparkSession, d: str) -> DataFrame:
    """Shards of every document's pages."""
    return ingest.plan_shards(_kinds(spark, d))


def shard_schedule(spark: SparkSession, d: str) -> DataFrame:
    """L4: shards by cost."""
    return ingest.schedule(shard_plan(spark, d)).select("doc_id", "start", "cost")


def shard_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of shards by their number in the file."""
    return ingest.absolute_pages(table(spark, d, "shard_results")).select("doc_id", "shard_no", "page_no", F.length("md").alias("n"))


def shard_outcome(spark: SparkSession, d: str) -> DataFrame:
    """What came of every document's shards."""
    return ingest.shard_outcome(table(spark, d, "shard_results")).select("doc_id", "pages", "fallback_pages", "status", "cached")


def batch_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents by outcome, whether all failed, pages in all."""
    o = shard_outcome(spark, d)
    return o.agg(F.count_if(F.col("status") == "failed").alias("failed"), F.bool_and(F.col("status") == "failed").alias("all_failed"), F.sum("pages").alias("pages"))


def new_docs_anti(spark: SparkSession, d: str) -> DataFrame:
    """C4: documents with pages but no chunks."""
    return ingest.new_documents(table(spark, d, "pages_in", "doc_id").distinct(), table(spark, d, "chunks", "doc_id"))


def indexed_semi(spark: SparkSession, d: str) -> DataFrame:
    """C4: documents of lines that have chunks."""
    return ingest.known_documents(table(spark, d, "doc_lines", "doc_id").distinct(), table(spark, d, "chunks", "doc_id"))


def latest_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line once."""
    return facts.distinct_lines(table(spark, d, "doc_lines")).select("doc_id", "line_no", "page")


def latest_loads(spark: SparkSession, d: str) -> DataFrame:
    """L3: the fifty records loaded last."""
    return table(spark, d, "bank_accounts", "account_number", "loaded_at").orderBy(F.desc("loaded_at"), "account_number").limit(50).select("account_number")


QUERIES = {
    f.__name__: f
    for f in (
        doc_content_id, doc_exact_duplicates, doc_token_estimate, chunk_token_estimate, page_triage, doc_garbage_ratio, page_lines, page_blocks, heading_paths, chunks_packed, markdown_assembled, embed_text_trim,
        doc_numbers, unverified_numbers, cells_cleaned, cells_signed, cells_signed_all, texts_shortened, years_named, think_filter, tag_suffixes, page_spans, documents_listing, docs_by_source, kind_histogram, years_and_names,
        year_pivot, chunk_types, type_options, chunk_sections, page_runs, shard_plan, shard_schedule, shard_pages, shard_outcome, batch_report, new_docs_anti, indexed_semi, latest_lines, latest_loads,
    )
}

_WS = "[" + x.SPACES + "\\x{1C}-\\x{1F}\\x{180E}]+"
_PAGES = "pg AS (SELECT doc_id, page_no, arg_max(md, (length(md), md)) AS md FROM pages_in WHERE md IS NOT NULL GROUP BY 1, 2)"
_RAW = f"{_PAGES}, rw AS (SELECT doc_id, page_no AS page, unnest(range(len(string_split_regex(md, '\\r?\\n')))) AS pos, unnest(string_split_regex(md, '\\r?\\n')) AS raw FROM pg)"
_KINDS = "kd AS (SELECT DISTINCT doc_id, page AS page_no, CASE WHEN (page // 3) % 4 = 2 THEN 'scanned' WHEN (page // 3) % 4 = 3 THEN 'hybrid' ELSE 'digital' END AS kind FROM doc_lines)"
_SHARDS = (
    f"{_KINDS}, k2 AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY page_no) THEN 1 ELSE 0 END AS new, count(*) OVER (PARTITION BY doc_id) AS total FROM kd), "
    "k3 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS run FROM k2), "
    "rn AS (SELECT doc_id, run, kind, min(page_no) AS first, count(*) AS length, least(24, greatest(4, (any_value(total) + 3) // 4)) AS lim FROM k3 GROUP BY 1, 2, 3), "
    "nn AS (SELECT *, CASE WHEN kind <> 'digital' THEN greatest((length + lim - 1) // lim, least(4, greatest(length // 2, 1))) ELSE greatest(1, least((length + lim - 1) // lim, length // 4)) END AS n FROM rn), "
    "jj AS (SELECT *, length // n AS base, length % n AS extra, unnest(range(n)) AS j FROM nn), "
    "sh AS (SELECT doc_id, kind, CAST(first + j * base + least(j, extra) AS INT) AS start, CAST(first + j * base + least(j, extra) + base + CASE WHEN j < extra THEN 1 ELSE 0 END - 1 AS INT) AS \"end\" FROM jj)"
)
_NUM = "\\(?-?[$€£₹¥]?\\s?\\d[\\d,]*(?:\\.\\d+)?\\)?%?"
_CITE = "\\[\\d+(?:\\s*[,\\-–]\\s*\\d+)*\\]"


def _values(src: str, key: str) -> str:
    t = "regexp_replace(raw, '[$€£₹¥\\s]', '', 'g')"
    dg = f"regexp_replace({t}, '[^\\d.]', '', 'g')"
    return (
        f"SELECT DISTINCT {key}, CASE WHEN regexp_matches({dg}, '^(\\d+\\.?\\d*|\\.\\d+)$') THEN CASE WHEN ({t} LIKE '(%' AND {t} LIKE '%)') OR {t} LIKE '-%' OR {t} LIKE '(-%' THEN -try_cast({dg} AS DOUBLE) ELSE try_cast({dg} AS DOUBLE) END END AS value "
        f"FROM (SELECT {key}, rtrim(trim(unnest(regexp_extract_all(regexp_replace(text, '{_CITE}', ' ', 'g'), '{_NUM}'))), ',') AS raw FROM {src})"
    )


_SIGNED_T = "upper(replace(cell, ' ', ''))"
_SIGNED_R = f"regexp_extract({_SIGNED_T}, '\\(?-?[\\d,]+(?:\\.\\d+)?\\)?')"
_SIGNED_V = f"try_cast(replace(trim({_SIGNED_R}, '()-'), ',', '') AS DECIMAL(18,2))"
_CHUNK1 = "c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id) AS rn FROM chunks) WHERE rn = 1)"
ORACLES = {
    "doc_content_id": "SELECT doc_id, substr(sha256(text), 1, 24) AS content_id FROM documents WHERE text IS NOT NULL",
    "doc_exact_duplicates": "SELECT doc_id, CASE WHEN n = 1 THEN 'new' ELSE 'skipped' END AS status, CASE WHEN n > 1 THEN 'duplicate of ' || first END AS error FROM (SELECT doc_id, row_number() OVER w AS n, first_value(doc_id) OVER w AS first FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY substr(sha256(text), 1, 24) ORDER BY doc_id))",
    "doc_token_estimate": f"SELECT doc_id, {x.tokens('text')} AS tokens FROM documents",
    "chunk_token_estimate": f"WITH {_CHUNK1} SELECT doc_id, sum({x.tokens('text')}) AS tokens FROM c1 GROUP BY 1",
    "page_triage": f"WITH {_PAGES}, s AS (SELECT doc_id, page_no, length(regexp_replace(md, '{_WS}', '', 'g')) AS text_chars, len(regexp_extract_all(regexp_replace(md, '{_WS}', '', 'g'), '[\\p{{Co}}\\p{{Cc}}\\x{{FFFD}}]')) AS bad FROM pg) SELECT doc_id, page_no, text_chars, CASE WHEN text_chars < 40 OR bad > 0.3 * text_chars THEN 'scanned' WHEN (page_no % 3) * 0.2 > 0.35 THEN 'hybrid' ELSE 'digital' END AS kind FROM s",
    "page_lines": f"WITH {_RAW}, s AS (SELECT doc_id, page, pos, trim(regexp_replace(regexp_replace(raw, '\\(cid:\\d+\\)', ' ', 'g'), '[ \\t]+', ' ', 'g')) AS s FROM rw) SELECT doc_id, page, pos, trim(ltrim(s, '#')) AS text, CASE WHEN s LIKE '|%' THEN list_transform(string_split(trim(s, '|'), '|'), lambda c: trim(c)) END AS cells FROM s WHERE s <> '' AND NOT regexp_matches(s, {x.q(text.TABLE_RULE)}) AND NOT regexp_matches(s, {x.q(text.PAGE_MARK)})",
    "page_blocks": f"WITH {_RAW}, k AS (SELECT *, trim(raw) AS s, CASE WHEN trim(raw) = '' THEN 'blank' WHEN regexp_matches(trim(raw), {x.q(text.HEADING)}) THEN 'heading' WHEN trim(raw) LIKE '|%' THEN 'table' ELSE 'text' END AS kind FROM rw), "
    "a AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id, page ORDER BY pos) AS pk FROM k), f AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id, page ORDER BY pos) AS bk FROM a WHERE kind <> 'blank'), "
    "m AS (SELECT *, sum(CASE WHEN bk IS NULL OR kind <> bk OR kind = 'heading' OR (kind = 'text' AND pk = 'blank') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM f), "
    f"g AS (SELECT doc_id, page, block, kind, max(CASE WHEN kind = 'heading' THEN length(regexp_extract(s, {x.q(text.HEADING)}, 1)) ELSE 0 END) AS level, trim(string_agg(CASE WHEN kind = 'heading' THEN regexp_extract(s, {x.q(text.HEADING)}, 2) ELSE rtrim(raw) END, chr(10) ORDER BY pos)) AS text FROM m GROUP BY 1, 2, 3, 4) SELECT *, {x.tokens('text')} AS tokens FROM g",
    "markdown_assembled": f"WITH {_PAGES} SELECT doc_id, string_agg('<!-- page: ' || page_no || ' -->' || chr(10) || chr(10) || trim(md), chr(10) || chr(10) ORDER BY page_no) || chr(10) AS markdown FROM pg GROUP BY 1",
    "doc_numbers": f"SELECT doc_id, value FROM ({_values('documents', 'doc_id')}) WHERE value IS NOT NULL",
    "unverified_numbers": f"WITH {_CHUNK1}, a AS (SELECT doc_id || ':' || chunk_index AS key, text FROM c1), b AS (SELECT doc_id || ':' || (chunk_index - 1) AS key, text FROM c1), av AS ({_values('a', 'key')}), bv AS ({_values('b', 'key')}) SELECT key, value FROM av WHERE value IS NOT NULL AND NOT (abs(value) < 10 AND value = floor(value)) AND NOT EXISTS (SELECT 1 FROM bv WHERE bv.key = av.key AND abs(bv.value) = abs(av.value))",
    "cells_cleaned": "SELECT DISTINCT text, trim(regexp_replace(replace(regexp_replace(text, '\\(cid:\\d+\\)', ' ', 'g'), '|', '/'), '[\\s\\x0B]+', ' ', 'g')) AS cleaned FROM doc_lines WHERE text IS NOT NULL",
    "cells_signed": f"SELECT cell, CASE WHEN regexp_matches({_SIGNED_R}, '\\d') THEN CASE WHEN regexp_matches({_SIGNED_R}, '^[(-]') OR regexp_matches({_SIGNED_T}, 'DR\\.?$') THEN -{_SIGNED_V} ELSE {_SIGNED_V} END END AS number FROM (SELECT DISTINCT cell FROM (SELECT unnest(cells) AS cell FROM doc_lines) WHERE length(cell) BETWEEN 1 AND 16)",
    "texts_shortened": "SELECT doc_id, CASE WHEN length(t) <= 48 THEN t ELSE left(t, 47) || '…' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)",
    "years_named": "SELECT doc_id, regexp_extract(text, p, 1) || '-' || right(regexp_extract(text, p, 2), 2) AS year FROM (SELECT doc_id, text, '\\b(20\\d{2})\\s*[-/]\\s*(20\\d{2}|\\d{2})\\b' AS p FROM documents) WHERE regexp_matches(text, '\\b(20\\d{2})\\s*[-/]\\s*(20\\d{2}|\\d{2})\\b')".replace("regexp_extract(text, p, 1)", "regexp_extract(text, '\\b(20\\d{2})\\s*[-/]\\s*(20\\d{2}|\\d{2})\\b', 1)").replace("regexp_extract(text, p, 2)", "regexp_extract(text, '\\b(20\\d{2})\\s*[-/]\\s*(20\\d{2}|\\d{2})\\b', 2)"),
    "think_filter": "SELECT doc_id, regexp_replace(left(text, c) || '<think>' || substr(text, c + 1, c) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '</think>' END || substr(text, 2 * c + 1), '(?s)<think>.*?(?:</think>|\\z)', '', 'g') AS answer FROM (SELECT doc_id, text, length(text) // 3 AS c FROM documents WHERE text IS NOT NULL)",
    "tag_suffixes": "SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN 0 ELSE doc_id % 8 END AS held FROM documents",
    "page_spans": "SELECT DISTINCT doc_id, account_number, CASE WHEN page_end > page_start THEN page_start || '-' || page_end ELSE CAST(page_start AS VARCHAR) END AS pages FROM bank_accounts",
    "documents_listing": f"WITH {_CHUNK1} SELECT doc_id, count(*) AS chunks, coalesce(max(page_end), 0) AS pages, coalesce(arg_min(source, chunk_index), '?') AS source, coalesce(arg_min(category, chunk_index), 'other') AS category, coalesce(arg_min(doc_type, chunk_index), 'other') AS doc_type FROM c1 GROUP BY 1",
    "docs_by_source": f"WITH {_CHUNK1} SELECT coalesce(source, '?') AS source, count(*) AS chunks FROM c1 GROUP BY 1",
    "years_and_names": "SELECT list_sort(list(DISTINCT assessment_year) FILTER (assessment_year IS NOT NULL)) AS years, list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)) AS names FROM tax_returns",
    "year_pivot": "WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY acknowledgement_number) AS n FROM tax_returns) WHERE n = 1), e AS (SELECT assessment_year, acknowledgement_number, unnest(map_entries(amounts)) AS x FROM r), f AS (SELECT x.key AS field, assessment_year AS y, arg_min(x.value, acknowledgement_number) AS v FROM e WHERE x.key IN ('gross_total_income', 'total_income', 'total_deductions') GROUP BY 1, 2) SELECT field, "
    + ", ".join(f"coalesce(max(v) FILTER (y = '{y}'), '—') AS ay_{y.replace('-', '_')}" for y in ("2019-20", "2020-21", "2021-22", "2022-23")) + " FROM f GROUP BY 1",
    "chunk_types": f"WITH {_CHUNK1} SELECT CASE doc_type " + " ".join(f"WHEN '{k}' THEN '{label}'" for k, _, label in listing.DOC_TYPES) + " ELSE 'Other document' END AS type_label, count(*) AS n FROM c1 GROUP BY 1",
    "chunk_sections": f"WITH {_CHUNK1}, a AS (SELECT DISTINCT doc_id, account_number, page_start, page_end FROM bank_accounts WHERE page_start IS NOT NULL AND page_end >= page_start) SELECT chunk_id, (SELECT arg_min(account_number, (a.page_start, account_number)) FROM a WHERE a.doc_id = c1.doc_id AND c1.page_start BETWEEN a.page_start AND a.page_end) AS section_account FROM c1",
    "page_runs": "SELECT doc_id, min(page_no) AS first, max(page_no) AS last FROM (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i FROM (SELECT DISTINCT doc_id, page_no FROM pages_in)) GROUP BY doc_id, i",
    "shard_plan": f"WITH {_SHARDS} SELECT * FROM sh",
    "shard_schedule": f"WITH {_SHARDS} SELECT doc_id, start, (\"end\" - start + 1) * CASE kind WHEN 'scanned' THEN 8 WHEN 'hybrid' THEN 4 ELSE 1 END AS cost FROM sh",
    "shard_pages": "SELECT doc_id, shard_no, p.page_no + CASE WHEN ok THEN 0 ELSE page_start - 1 END AS page_no, length(p.md) AS n FROM (SELECT doc_id, shard_no, page_start, len(list_filter(pages, lambda q: NOT (q.page_no BETWEEN page_start AND page_end))) = 0 AS ok, unnest(pages) AS p FROM shard_results)",
    "shard_outcome": "SELECT *, CASE WHEN pages = 0 THEN false ELSE status = 'done' END AS cached FROM (SELECT doc_id, sum(CASE WHEN len(pages) > 0 THEN len(pages) ELSE 0 END) AS pages, sum(coalesce(len(fallback), 0)) AS fallback_pages, CASE WHEN sum(CASE WHEN len(pages) > 0 THEN len(pages) ELSE 0 END) = 0 THEN 'failed' WHEN count(*) FILTER (error IS NOT NULL AND error <> '') > 0 THEN 'partial' ELSE 'done' END AS status FROM shard_results GROUP BY 1)",
    "new_docs_anti": "SELECT DISTINCT doc_id FROM pages_in WHERE doc_id NOT IN (SELECT doc_id FROM chunks)",
    "indexed_semi": "SELECT DISTINCT doc_id FROM doc_lines WHERE doc_id IN (SELECT doc_id FROM chunks)",
    "latest_lines": f"WITH {x.LINES} SELECT doc_id, line_no, page FROM l",
    "latest_loads": "SELECT account_number FROM bank_accounts ORDER BY loaded_at DESC, account_number LIMIT 50",
    "type_options": "SELECT category, list(key ORDER BY pos) AS types FROM (VALUES " + ", ".join(f"('{k}', '{c}', {i})" for i, (k, c, _) in enumerate(listing.DOC_TYPES)) + ") t(key, category, pos) GROUP BY 1",
}
ORACLES["kind_histogram"] = f"SELECT doc_id, kind, count(*) AS n FROM ({ORACLES['page_triage']}) GROUP BY 1, 2"
ORACLES["batch_report"] = f"SELECT count(*) FILTER (status = 'failed') AS failed, bool_and(status = 'failed') AS all_failed, sum(pages) AS pages FROM ({ORACLES['shard_outcome']})"
