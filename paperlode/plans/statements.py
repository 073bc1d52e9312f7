"""Queries of statement and return facts over doc_lines, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.functions.scalars import ascii_digits, inr, parse_amount, parse_date
from paperlode.operators import facts
from paperlode.plans import sqltext as x
from paperlode.tables import table

KEYS = ["doc_id", "account_number"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return facts.distinct_lines(table(spark, d, "doc_lines", "doc_id", "line_no", "page", "text", "cells", "loaded_at"))


def _sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = _lines(spark, d)
    return lines, facts.sections(lines)


def _transactions(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = _sections(spark, d)
    return facts.transactions(facts.section_lines(lines, parts))


def statement_sections(spark: SparkSession, d: str) -> DataFrame:
    """E5: account sections."""
    return _sections(spark, d)[1]


def page_section_join(spark: SparkSession, d: str) -> DataFrame:
    """The section of every page."""
    lines, parts = _sections(spark, d)
    return facts.section_of_pages(lines.select("doc_id", "page").distinct(), parts)


def statement_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Transaction rows under their headers, in order of time."""
    return _transactions(spark, d)


def statement_totals(spark: SparkSession, d: str) -> DataFrame:
    """Figures of every account."""
    return facts.totals(_transactions(spark, d))


def statement_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three largest debits and credits of every account."""
    return facts.largest(_transactions(spark, d))


def statement_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """How far balances follow from the rows before them."""
    return facts.row_check(_transactions(spark, d)).select(*KEYS, "reconciled", "checked")


def statement_periods(spark: SparkSession, d: str) -> DataFrame:
    """The first printed period of every section."""
    lines, parts = _sections(spark, d)
    return facts.periods(facts.section_lines(lines, parts))


def statement_holders(spark: SparkSession, d: str) -> DataFrame:
    """The holder of every section."""
    lines, parts = _sections(spark, d)
    return facts.holders(facts.section_lines(lines, parts))


def statement_banks(spark: SparkSession, d: str) -> DataFrame:
    """The bank of every section."""
    lines, parts = _sections(spark, d)
    return facts.banks(facts.section_lines(lines, parts))


def statement_facts(spark: SparkSession, d: str) -> DataFrame:
    """All facts of every account."""
    return facts.statement_facts(_lines(spark, d))


def return_segments(spark: SparkSession, d: str) -> DataFrame:
    """The returns of every file."""
    return facts.returns(_lines(spark, d)).select("doc_id", "return_no", "page_start", "page_end")


def return_facts(spark: SparkSession, d: str) -> DataFrame:
    """All facts of every return."""
    return facts.returns(_lines(spark, d))


def return_identity(spark: SparkSession, d: str) -> DataFrame:
    """PAN, acknowledgement number and year of every return."""
    return facts.returns(_lines(spark, d)).select("doc_id", "return_no", "pan", "acknowledgement_number", "assessment_year")


def dates_parsed(spark: SparkSession, d: str) -> DataFrame:
    """H5: filing dates and date cells read by the eleven printed forms."""
    r = table(spark, d, "tax_returns", "date_of_filing").select(F.col("date_of_filing").alias("printed"))
    c = table(spark, d, "doc_lines", "cells").select(F.explode("cells").alias("printed"))
    return r.unionByName(c).where(F.length("printed") > 0).distinct().select("printed", parse_date("printed").alias("day"))


def amounts_parsed(spark: SparkSession, d: str) -> DataFrame:
    """H2: the cells of 1 to 18 characters read as amounts, as its SQL does; :func:`amounts_all` reads every cell."""
    c = table(spark, d, "doc_lines", "cells").select(F.explode("cells").alias("printed")).where(F.length("printed").between(1, 18)).distinct()
    return c.select("printed", parse_amount("printed").alias("amount"))


def amounts_all(spark: SparkSession, d: str) -> DataFrame:
    """H2: every distinct printed cell, of any length and with digits of any script, read as an amount."""
    c = table(spark, d, "doc_lines", "cells").select(F.explode("cells").alias("printed")).where("printed is not null").distinct()
    return c.select("printed", parse_amount(ascii_digits("printed")).alias("amount"))


def amounts_formatted_inr(spark: SparkSession, d: str) -> DataFrame:
    """H1: balances and totals in Indian grouping."""
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", inr(F.col("o_totalprice").cast("decimal(18,2)") * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        statement_sections, page_section_join, statement_transactions, statement_totals, statement_top3, statement_reconcile, statement_periods,
        statement_holders, statement_banks, statement_facts, return_segments, return_facts, return_identity, dates_parsed, amounts_parsed, amounts_all, amounts_formatted_inr,
    )
}

_ACCOUNT = x.q(facts.ACCOUNT)
_SECTIONS = (
    f"{x.LINES}, h AS (SELECT doc_id, regexp_extract(text, {_ACCOUNT}, 1) AS account_number, min(line_no) AS line_no, arg_min(page, line_no) AS page_start FROM l WHERE regexp_matches(text, {_ACCOUNT}) GROUP BY 1, 2), "
    "lastp AS (SELECT doc_id, max(page) AS last_page FROM l GROUP BY 1), "
    "sec AS (SELECT doc_id, account_number, page_start, greatest(coalesce(lead(page_start) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, last_page), page_start) AS page_end FROM h JOIN lastp USING (doc_id)), "
    "sl AS (SELECT l.*, sec.account_number, sec.page_start FROM l JOIN sec ON l.doc_id = sec.doc_id AND l.page BETWEEN sec.page_start AND sec.page_end)"
)
_PERIODS = (
    f"per AS (SELECT doc_id, account_number, regexp_extract(t, {x.q(facts.PERIOD_FIRST)}, 1) AS a, regexp_extract(t, {x.q(facts.PERIOD_FIRST)}, 2) AS b FROM "
    f"(SELECT doc_id, account_number, arg_min(text, line_no) AS t FROM sl WHERE regexp_matches(text, {x.q(facts.PERIOD_FIRST)}) GROUP BY 1, 2)), "
    f"win AS (SELECT doc_id, account_number, {x.day('a')} AS lo, {x.day('b')} AS hi FROM per)"
)
_KIND = (
    f"CASE WHEN {x.squash('c')} LIKE '%balance%' OR {x.squash('c')} IN ('closingbal', 'bal') THEN 'balance' WHEN {x.squash('c')} LIKE '%date%' AND {x.squash('c')} NOT LIKE '%value%' THEN 'date' "
    f"WHEN {x.squash('c')} LIKE '%withdrawal%' OR {x.squash('c')} LIKE '%debit%' OR {x.squash('c')} = 'dr' THEN 'debit' WHEN {x.squash('c')} LIKE '%deposit%' OR {x.squash('c')} LIKE '%credit%' OR {x.squash('c')} = 'cr' THEN 'credit' "
    f"WHEN regexp_matches({x.squash('c')}, 'narration|description|particular|remark|details') THEN 'narration' ELSE '' END"
)
_TX = (
    f"{_SECTIONS}, {_PERIODS}, k AS (SELECT *, list_transform(cells, lambda c: {_KIND}) AS kinds, list_transform(cells, lambda c: {x.squash('c')} LIKE '%date%' OR {x.squash('c')} IN ('valuedt', 'txndt')) AS anydate FROM sl WHERE cells IS NOT NULL), "
    "k2 AS (SELECT *, CASE WHEN list_position(kinds, 'balance') > 0 AND (list_position(kinds, 'date') > 0 OR list_position(anydate, true) > 0) THEN {'w': len(cells), 'balance': list_position(kinds, 'balance'), "
    "'date': coalesce(nullif(list_position(kinds, 'date'), 0), list_position(anydate, true)), 'debit': list_position(kinds, 'debit'), 'credit': list_position(kinds, 'credit'), 'narration': list_position(kinds, 'narration')} END AS own FROM k), "
    "k3 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id, account_number ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS hd FROM k2), "
    "k4 AS (SELECT doc_id, account_number, line_no, cells[hd.date] AS d, CASE WHEN hd.debit > 0 THEN cells[hd.debit] END AS dr, CASE WHEN hd.credit > 0 THEN cells[hd.credit] END AS cr, cells[hd.balance] AS b, coalesce(left(CASE WHEN hd.narration > 0 THEN cells[hd.narration] END, 80), '') AS narration FROM k3 WHERE own IS NULL AND hd IS NOT NULL AND len(cells) = hd.w), "
    f"k5 AS (SELECT doc_id, account_number, line_no, {x.day('d')} AS tx_date, {x.amount('dr')} AS debit, {x.amount('cr')} AS credit, {x.amount('b')} AS balance, narration FROM k4), "
    "k6 AS (SELECT k5.* FROM k5 LEFT JOIN win USING (doc_id, account_number) WHERE tx_date IS NOT NULL AND balance IS NOT NULL AND CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN tx_date BETWEEN lo - 45 AND hi + 45 ELSE tx_date BETWEEN DATE '2000-01-01' AND DATE '2026-12-31' END), "
    "k7 AS (SELECT *, CASE WHEN first_value(tx_date) OVER w > last_value(tx_date) OVER w THEN -line_no ELSE line_no END AS key FROM k6 WINDOW w AS (PARTITION BY doc_id, account_number ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
    "tx AS (SELECT * EXCLUDE (key), row_number() OVER (PARTITION BY doc_id, account_number ORDER BY tx_date, key) AS seq FROM k7)"
)


def _top(kind: str) -> str:
    return f"SELECT doc_id, account_number, rank, tx_date, amount, narration, '{kind}' AS kind FROM (SELECT *, abs({kind}) AS amount, row_number() OVER (PARTITION BY doc_id, account_number ORDER BY abs({kind}) DESC, seq) AS rank FROM tx WHERE {kind} IS NOT NULL AND {kind} <> 0) WHERE rank <= 3"


_FITS = "CASE WHEN {p} IS NOT NULL AND (debit IS NOT NULL OR credit IS NOT NULL) THEN CAST(abs({p} - coalesce(abs(debit), 0) + coalesce(abs(credit), 0) - balance) < 0.015 AS INT) END"
_RETURNS = (
    f"{x.LINES}, docs AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM l) WHERE pos <= 80 AND regexp_matches(text, {x.q(facts.RETURN_MARK)})), "
    f"p AS (SELECT doc_id, page, regexp_extract(arg_min(text, line_no) FILTER (regexp_matches(text, {x.q(facts.ACKNOWLEDGEMENT)})), {x.q(facts.ACKNOWLEDGEMENT)}, 1) AS ack, bool_or(coalesce(regexp_matches(text, {x.q(facts.RETURN_MARK)}), false)) AS mark FROM l WHERE doc_id IN (SELECT doc_id FROM docs) GROUP BY 1, 2), "
    "p2 AS (SELECT *, last_value(ack IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS rn FROM p), "
    "p3 AS (SELECT doc_id, page, sum(CASE WHEN rn = 1 OR (ack IS NOT NULL AND ack IS DISTINCT FROM prev) OR (mark AND ack IS NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS return_no FROM p2), "
    "sp AS (SELECT doc_id, return_no, min(page) AS page_start, max(page) AS page_end FROM p3 GROUP BY 1, 2)"
)
ORACLES = {
    "statement_sections": f"WITH {_SECTIONS} SELECT * FROM sec",
    "page_section_join": f"WITH {_SECTIONS} SELECT p.doc_id, p.page, (SELECT arg_min(account_number, (page_start, account_number)) FROM sec WHERE sec.doc_id = p.doc_id AND p.page BETWEEN sec.page_start AND sec.page_end) AS account_number FROM (SELECT DISTINCT doc_id, page FROM l) p",
    "statement_transactions": f"WITH {_TX} SELECT * FROM tx",
    "statement_totals": f"WITH {_TX} SELECT doc_id, account_number, count(*) AS transactions, min(tx_date) AS first_transaction, max(tx_date) AS last_transaction, arg_max(balance, seq) AS closing_balance, CAST(coalesce(sum(abs(debit)), 0) AS DECIMAL(28,2)) AS total_debits, CAST(coalesce(sum(abs(credit)), 0) AS DECIMAL(28,2)) AS total_credits FROM tx GROUP BY 1, 2",
    "statement_top3": f"WITH {_TX} {_top('debit')} UNION ALL {_top('credit')}",
    "statement_reconcile": f"WITH {_TX}, f AS (SELECT doc_id, account_number, {_FITS.format(p='lag(balance) OVER w')} AS f, {_FITS.format(p='lead(balance) OVER w')} AS b FROM tx WINDOW w AS (PARTITION BY doc_id, account_number ORDER BY line_no)), "
    "g AS (SELECT doc_id, account_number, sum(f) AS fs, count(f) AS fn, sum(b) AS bs, count(b) AS bn FROM f GROUP BY 1, 2) SELECT doc_id, account_number, CAST(CASE WHEN bn > 0 AND (fn = 0 OR bs * fn > fs * bn) THEN bs ELSE fs END AS BIGINT) AS reconciled, CASE WHEN bn > 0 AND (fn = 0 OR bs * fn > fs * bn) THEN bn ELSE fn END AS checked FROM g",
    "statement_periods": f"WITH {_SECTIONS}, {_PERIODS} SELECT doc_id, account_number, per.a || ' to ' || per.b AS period, lo, hi FROM per JOIN win USING (doc_id, account_number)",
    "statement_holders": f"WITH {_SECTIONS} SELECT doc_id, account_number, arg_min(holder, line_no) AS holder FROM (SELECT *, CASE WHEN regexp_matches(text, {x.q(facts.HOLDER)}) THEN trim(regexp_extract(text, {x.q(facts.HOLDER)}, 1), ' ,') WHEN contains(text, account_number) AND regexp_matches(text, {x.q(facts.HOLDER_AFTER_NUMBER)}) THEN trim(regexp_extract(text, {x.q(facts.HOLDER_AFTER_NUMBER)}, 1)) END AS holder FROM sl) WHERE holder IS NOT NULL GROUP BY 1, 2",
    "return_segments": f"WITH {_RETURNS} SELECT * FROM sp",
    "return_identity": f"WITH {_RETURNS}, fl AS (SELECT l.doc_id, sp.return_no, l.line_no, l.text FROM l JOIN p3 ON l.doc_id = p3.doc_id AND l.page = p3.page JOIN sp ON sp.doc_id = p3.doc_id AND sp.return_no = p3.return_no WHERE l.page = sp.page_start), "
    f"y AS (SELECT *, CASE WHEN regexp_matches(text, {x.q(facts.YEAR)}) THEN regexp_extract(text, {x.q(facts.YEAR)}, 1) || '-' || right(regexp_extract(text, {x.q(facts.YEAR)}, 2), 2) END AS yr, regexp_extract_all(replace(text, 'ITR', ' ITR'), {x.q(facts.FORM)}, 1) AS forms FROM fl), "
    "a AS (SELECT doc_id, return_no, arg_min({'y': yr}, line_no) FILTER (len(forms) = 1) AS lone, bool_or(regexp_matches(text, '(?i)form\\s*number') AND len(forms) > 0) AS form_row, arg_min(yr, line_no) FILTER (regexp_matches(text, '(?i)assessment\\s*year') AND yr IS NOT NULL) AS ly, arg_min(yr, line_no) FILTER (yr IS NOT NULL) AS ay, "
    f"regexp_extract(arg_min(text, line_no) FILTER (regexp_matches(text, {x.q(facts.PAN)})), {x.q(facts.PAN)}, 1) AS pan, regexp_extract(arg_min(text, line_no) FILTER (regexp_matches(text, {x.q(facts.ACKNOWLEDGEMENT)})), {x.q(facts.ACKNOWLEDGEMENT)}, 1) AS acknowledgement_number FROM y GROUP BY 1, 2) "
    "SELECT doc_id, return_no, pan, acknowledgement_number, coalesce(CASE WHEN NOT coalesce(form_row, false) THEN lone.y END, ly, ay) AS assessment_year FROM a",
    "dates_parsed": f"SELECT printed, {x.day('printed')} AS day FROM (SELECT DISTINCT printed FROM (SELECT date_of_filing AS printed FROM tax_returns UNION ALL SELECT unnest(cells) FROM doc_lines) WHERE length(printed) > 0)",
    "amounts_parsed": f"SELECT printed, {x.amount('printed')} AS amount FROM (SELECT DISTINCT printed FROM (SELECT unnest(cells) AS printed FROM doc_lines) WHERE length(printed) BETWEEN 1 AND 18)",
    "amounts_formatted_inr": f"SELECT o_orderkey, {x.inr('CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END')} AS text FROM orders",
}
_BANK_OF = "CASE {} " + " ".join(f"WHEN {x.q(k)} THEN {x.q(v)}" for k, v in facts.IFSC_BANKS.items()) + " END"
_NAMES = [*facts.BANK_NAMES.items(), ("ICICI", "ICICI Bank"), ("HDFC", "HDFC Bank")]
_LABELLED = f"left(regexp_extract(text, {x.q(facts.IFSC_LABELLED)}, 1), 4)"
ORACLES["statement_banks"] = (
    f"WITH {_SECTIONS}, b AS (SELECT *, page = page_start AND cells IS NULL AS head, regexp_replace(upper(text), '[^A-Z]', '', 'g') AS caps, {_BANK_OF.format(f'regexp_extract(text, {x.q(facts.IFSC_ANY)}, 1)')} AS loose FROM sl), "
    f"a AS (SELECT doc_id, account_number, arg_min({_LABELLED}, line_no) FILTER (head AND regexp_matches(text, {x.q(facts.IFSC_LABELLED)})) AS lab, arg_min(loose, line_no) FILTER (head AND loose IS NOT NULL) AS loose, "
    + ", ".join(f"bool_or(head AND contains(caps, '{k}')) AS on_{i}" for i, k in enumerate(facts.BANK_NAMES)) + ", "
    + ", ".join(f"sum((length(caps) - length(replace(caps, '{k}', ''))) // {len(k)}) AS n_{i}" for i, (k, _) in enumerate(_NAMES))
    + f" FROM b GROUP BY 1, 2) SELECT doc_id, account_number, coalesce({_BANK_OF.format('lab')}, lab, CASE "
    + " ".join(f"WHEN on_{i} THEN {x.q(v)}" for i, v in enumerate(facts.BANK_NAMES.values()))
    + " END, loose, CASE "
    + " ".join(f"WHEN n_{i} > 0 AND n_{i} = greatest({', '.join(f'n_{j}' for j in range(len(_NAMES)))}) THEN {x.q(v)}" for i, (_, v) in enumerate(_NAMES))
    + " END) AS bank FROM a"
)
