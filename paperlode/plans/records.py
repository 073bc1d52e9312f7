"""Queries of records field by field, and of what joins hits, questions and documents, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlode.functions.scalars import keywords
from paperlode.operators import facts, ingest, listing, text
from paperlode.plans import documents, search, statements
from paperlode.plans import sqltext as x
from paperlode.tables import table

#: Documents a question or a hit list is joined to.
FIRST = 3


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return facts.distinct_lines(table(spark, d, "doc_lines", "doc_id", "line_no", "page", "text", "cells", "loaded_at"))


def account_fact_fields(spark: SparkSession, d: str) -> DataFrame:
    """The record of every account, its plain fields."""
    f = facts.statement_facts(_lines(spark, d))
    return f.select("doc_id", "account_number", "page_start", "page_end", "bank", "holder", "period", "transactions", "first_transaction", "last_transaction", "closing_balance", "total_debits", "total_credits")


def account_fact_largest(spark: SparkSession, d: str) -> DataFrame:
    """The largest rows in the record of every account, one a row."""
    f = facts.statement_facts(_lines(spark, d))
    one = lambda kind: f.select("doc_id", "account_number", F.posexplode(f"largest_{kind}s").alias("pos", "t")).select("doc_id", "account_number", (F.col("pos") + 1).alias("rank"), "t.tx_date", "t.amount", "t.narration", F.lit(kind).alias("kind"))
    return one("debit").unionByName(one("credit"))


def return_form_fields(spark: SparkSession, d: str) -> DataFrame:
    """Form and filing date of every return."""
    return facts.returns(_lines(spark, d)).select("doc_id", "return_no", "form", "date_of_filing")


def hits_to_facts(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents whose chunks were hit, the first three in order of their hits that have facts: accounts and
    returns that their chunks name and the tables know."""
    hits = table(spark, d, "hits", "vec_id", "hit_rank", "hit_vec_id").where("hit_vec_id is not null").distinct()
    chunk_of = table(spark, d, "vector_store", "vec_id", "chunk_id").distinct().withColumnRenamed("vec_id", "hit_vec_id")
    chunks = table(spark, d, "chunks", "chunk_id", "doc_id", "account", "return_no").dropDuplicates(["chunk_id"])
    accounts = table(spark, d, "bank_accounts", "account_number").distinct().withColumnRenamed("account_number", "account")
    returns = table(spark, d, "tax_returns", "acknowledgement_number").distinct().withColumnRenamed("acknowledgement_number", "return_no")
    a = chunks.select("doc_id", "account").distinct().join(accounts, "account").groupBy("doc_id").agg(F.count(F.lit(1)).alias("accounts"))
    r = chunks.select("doc_id", "return_no").distinct().join(returns, "return_no").groupBy("doc_id").agg(F.count(F.lit(1)).alias("returns"))
    known = a.join(r, "doc_id", "full").na.fill(0, ["accounts", "returns"])
    seen = hits.join(chunk_of, "hit_vec_id").join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("vec_id", "doc_id").agg(F.min("hit_rank").alias("seen")).join(known, "doc_id")
    order = Window.partitionBy("vec_id").orderBy("seen", "doc_id")
    return seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST)


def question_documents(spark: SparkSession, d: str) -> DataFrame:
    """For every question the three documents that share most of its keywords. The questions' words are a fixed
    handful, so they are broadcast and every document is read once for all questions."""
    q = spark.createDataFrame(list(search.QUESTIONS), "q_id int, question string")
    asked = q.select("q_id", F.explode(F.array_distinct(keywords("question"))).alias("term"))
    words = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.array_distinct(keywords(F.coalesce("text", F.lit(""))))).alias("term"))
    shared = words.join(F.broadcast(asked), "term").groupBy("q_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy("q_id").orderBy(F.desc("shared"), "doc_id")
    return shared.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST)


def routes_by_hits(spark: SparkSession, d: str) -> DataFrame:
    """The model that answers for each hit list: finance where the best hit's chunk is of that category."""
    hits = table(spark, d, "hits", "vec_id", "hit_rank", "hit_vec_id").where("hit_vec_id is not null").groupBy("vec_id").agg(F.min_by("hit_vec_id", "hit_rank").alias("hit_vec_id"))
    chunk_of = table(spark, d, "vector_store", "vec_id", "chunk_id").distinct().withColumnRenamed("vec_id", "hit_vec_id")
    chunks = table(spark, d, "chunks", "chunk_id", "category").dropDuplicates(["chunk_id"])
    best = hits.join(chunk_of, "hit_vec_id", "left").join(chunks, "chunk_id", "left")
    return best.select("vec_id", F.when(F.col("category") == "finance", "finance").otherwise("general").alias("route"))


def _all_pages(spark: SparkSession, d: str) -> DataFrame:
    two = table(spark, d, "shard_results", "doc_id", "pages").select("doc_id", F.inline("pages")).select("doc_id", "page_no", "md")
    return table(spark, d, "pages_in", "doc_id", "page_no", "md").unionByName(two)


def all_page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of the pages of both tables."""
    return text.blocks(_all_pages(spark, d))


def all_pages_assembled(spark: SparkSession, d: str) -> DataFrame:
    """The marked text of the documents of both tables."""
    return text.assemble(_all_pages(spark, d))


def pages_from_marks(spark: SparkSession, d: str) -> DataFrame:
    """The pages of all documents read back from their marked texts."""
    return text.pages_of(text.assemble(_all_pages(spark, d)))


def chunk_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tags and prefix of every chunk of statements and returns, by the sections of their files."""
    lines = _lines(spark, d)
    parts = facts.sections(lines)
    accounts = parts.join(facts.banks(facts.section_lines(lines, parts)), ["doc_id", "account_number"], "left")
    pages = lines.select("doc_id", F.col("page").alias("page_start")).where("page_start is not null").distinct()
    return listing.section_tags(pages, accounts, facts.returns(lines)).select("doc_id", "page_start", "account", "prefix")


def kinds_and_fallback(spark: SparkSession, d: str) -> DataFrame:
    """D3: pages by kind of shard, and those read a second time."""
    results = table(spark, d, "shard_results", "doc_id", "kind", "pages", "fallback")
    return listing.kinds_with_fallback(results.select("doc_id", "kind", F.explode("pages")).select("doc_id", "kind"), results)


def shard_texts(spark: SparkSession, d: str) -> DataFrame:
    """The pages of shards by number in the file; a shard without pages gives its error text as its first page."""
    results = table(spark, d, "shard_results", "doc_id", "shard_no", "page_start", "page_end", "pages", "error")
    return ingest.shard_texts(results, "error").select("doc_id", "page_no", F.length("md").alias("n"))


_BOTH = "FROM (SELECT doc_id, page_no, md FROM pages_in UNION ALL SELECT doc_id, p.page_no, p.md FROM (SELECT doc_id, unnest(pages) AS p FROM shard_results))"
_PARTS = "doc_id, account_number"
_STATEMENT = statements.ORACLES
_FORMS = f"regexp_extract_all(replace(l.text, 'ITR', ' ITR'), {x.q(facts.FORM)}, 1)"
_EVERY = "ROWS UNBOUNDED PRECEDING"
QUERIES = {
    f.__name__: f for f in (account_fact_fields, account_fact_largest, return_form_fields, hits_to_facts, question_documents, routes_by_hits, all_page_blocks, all_pages_assembled, pages_from_marks, chunk_tags, kinds_and_fallback, shard_texts)
}
ORACLES = {
    "account_fact_fields": f"SELECT {_PARTS}, s.page_start, s.page_end, b.bank, h.holder, p.period, t.transactions, t.first_transaction, t.last_transaction, t.closing_balance, t.total_debits, t.total_credits FROM ({_STATEMENT['statement_sections']}) s "
    + " ".join(f"LEFT JOIN ({_STATEMENT[k]}) {n} USING ({_PARTS})" for k, n in (("statement_banks", "b"), ("statement_holders", "h"), ("statement_periods", "p"), ("statement_totals", "t"))),
    "account_fact_largest": f"SELECT {_PARTS}, CAST(rank AS INTEGER) AS rank, tx_date, amount, narration, kind FROM ({_STATEMENT['statement_top3']})",
    "return_form_fields": f"WITH {statements._RETURNS}, fl AS (SELECT l.doc_id, sp.return_no, l.line_no, l.text, {_FORMS} AS forms FROM l JOIN p3 ON l.doc_id = p3.doc_id AND l.page = p3.page JOIN sp ON sp.doc_id = p3.doc_id AND sp.return_no = p3.return_no WHERE l.page = sp.page_start) "
    "SELECT doc_id, return_no, 'ITR-' || coalesce(arg_min(forms[1], line_no) FILTER (regexp_matches(text, '(?i)form\\s*number') AND len(forms) > 0), arg_min(forms[1], line_no) FILTER (len(forms) = 1)) AS form, "
    f"regexp_extract(arg_min(text, line_no) FILTER (regexp_matches(text, {x.q(facts.FILED)})), {x.q(facts.FILED)}, 1) AS date_of_filing FROM fl GROUP BY 1, 2",
    "hits_to_facts": "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id) AS rn FROM chunks) WHERE rn = 1), "
    "a AS (SELECT doc_id, count(DISTINCT account) AS accounts FROM c WHERE account IN (SELECT account_number FROM bank_accounts) GROUP BY 1), r AS (SELECT doc_id, count(DISTINCT return_no) AS returns FROM c WHERE return_no IN (SELECT acknowledgement_number FROM tax_returns) GROUP BY 1), "
    "k AS (SELECT doc_id, coalesce(accounts, 0) AS accounts, coalesce(returns, 0) AS returns FROM a FULL JOIN r USING (doc_id)), "
    "s AS (SELECT h.vec_id, c.doc_id, min(h.hit_rank) AS seen FROM hits h JOIN vector_store v ON h.hit_vec_id = v.vec_id JOIN c ON c.chunk_id = v.chunk_id GROUP BY 1, 2) "
    f"SELECT * FROM (SELECT vec_id, doc_id, seen, accounts, returns, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY seen, doc_id) AS INTEGER) AS place FROM s JOIN k USING (doc_id)) WHERE place <= {FIRST}",
    "question_documents": "WITH q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x.q(t)})" for i, t in search.QUESTIONS) + f") t(q_id, question)), a AS (SELECT DISTINCT q_id, unnest({x.keywords('question')}) AS term FROM q), "
    f"w AS (SELECT DISTINCT doc_id, unnest({x.keywords("coalesce(text, '')")}) AS term FROM documents), s AS (SELECT q_id, doc_id, count(*) AS shared FROM w JOIN a USING (term) GROUP BY 1, 2) "
    f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY shared DESC, doc_id) AS INTEGER) AS place FROM s) WHERE place <= {FIRST}",
    "routes_by_hits": "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id) AS rn FROM chunks) WHERE rn = 1), h AS (SELECT vec_id, arg_min(hit_vec_id, hit_rank) AS best FROM hits GROUP BY 1) "
    "SELECT h.vec_id, CASE WHEN c.category = 'finance' THEN 'finance' ELSE 'general' END AS route FROM h LEFT JOIN (SELECT DISTINCT vec_id, chunk_id FROM vector_store) v ON v.vec_id = h.best LEFT JOIN c USING (chunk_id)",
    "chunk_tags": f"WITH sec AS ({_STATEMENT['statement_sections']}), bk AS ({_STATEMENT['statement_banks']}), a AS (SELECT doc_id, page_start, page_end, coalesce(bank, 'Bank') || ' ' || account_number AS v FROM sec LEFT JOIN bk USING (doc_id, account_number)), "
    f"rs AS ({_STATEMENT['return_segments']}), ri AS ({_STATEMENT['return_identity']}), fm AS (@forms), r AS (SELECT doc_id, page_start, page_end, coalesce(form, 'ITR') || ' AY ' || assessment_year AS v FROM rs JOIN ri USING (doc_id, return_no) JOIN fm USING (doc_id, return_no) WHERE assessment_year IS NOT NULL), "
    f"{x.LINES}, pg AS (SELECT DISTINCT doc_id, page AS page_start FROM l WHERE page IS NOT NULL), "
    "t AS (SELECT doc_id, page_start, (SELECT arg_min(v, (a.page_start, a.page_end, v)) FROM a WHERE a.doc_id = pg.doc_id AND pg.page_start BETWEEN a.page_start AND a.page_end) AS account, (SELECT arg_min(v, (r.page_start, r.page_end, v)) FROM r WHERE r.doc_id = pg.doc_id AND pg.page_start BETWEEN r.page_start AND r.page_end) AS filed FROM pg) "
    "SELECT doc_id, page_start, account, coalesce('[' || coalesce(account, filed) || '] ', '') AS prefix FROM t",
    "kinds_and_fallback": "SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, kind, unnest(pages) AS p FROM shard_results) GROUP BY 1, 2 UNION ALL SELECT doc_id, 'fallback', count(*) FROM (SELECT DISTINCT doc_id, unnest(fallback) AS page FROM shard_results) GROUP BY 1",
    "shard_texts": "SELECT doc_id, p.page_no + CASE WHEN ok THEN 0 ELSE page_start - 1 END AS page_no, length(p.md) AS n FROM (SELECT doc_id, page_start, len(list_filter(pages, lambda q: NOT (q.page_no BETWEEN page_start AND page_end))) = 0 AS ok, unnest(pages) AS p FROM shard_results) "
    "UNION ALL SELECT doc_id, page_start, length(error) FROM shard_results WHERE coalesce(len(pages), 0) = 0 AND length(trim(error)) > 0",
    "all_page_blocks": documents.ORACLES["page_blocks"].replace("FROM pages_in", _BOTH),
    "all_pages_assembled": documents.ORACLES["markdown_assembled"].replace("FROM pages_in", _BOTH),
    "pages_from_marks": f"SELECT doc_id, page_no, regexp_replace(arg_max(md, (length(md), md)), '^\\s+|\\s+$', '', 'g') AS md {_BOTH} WHERE md IS NOT NULL GROUP BY 1, 2 HAVING regexp_replace(arg_max(md, (length(md), md)), '^\\s+|\\s+$', '', 'g') <> ''",
}
ORACLES["chunk_tags"] = ORACLES["chunk_tags"].replace("@forms", ORACLES["return_form_fields"])
# Titles over a block: per level the last heading of that level, unless one of a higher level came after it.
documents.ORACLES["heading_paths"] = (
    f"WITH b AS ({documents.ORACLES['page_blocks']}), w AS (SELECT *, "
    + ", ".join(
        f"last_value(CASE WHEN kind = 'heading' AND level = {k} THEN {{'at': page * 1000000 + block, 't': text}} END IGNORE NULLS) OVER (o {_EVERY}) AS t{k}, "
        f"last_value(CASE WHEN kind = 'heading' AND level < {k} THEN page * 1000000 + block END IGNORE NULLS) OVER (o {_EVERY}) AS c{k}"
        for k in range(1, 7)
    )
    + " FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY page, block)) SELECT doc_id, page, block, list_filter(["
    + ", ".join(f"CASE WHEN t{k} IS NOT NULL AND (c{k} IS NULL OR t{k}.at > c{k}) THEN t{k}.t END" for k in range(1, 7))
    + "], lambda e: e IS NOT NULL) AS path FROM w"
)
