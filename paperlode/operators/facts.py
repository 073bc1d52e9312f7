"""Facts of bank statements and tax returns from lines, by windows and aggregates.

``lines`` are rows (doc_id, line_no, page, text, cells); null cells mark a line of text. Sections are joined to lines
by page rather than by range, so that a document of any size spreads over tasks.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.functions.scalars import DATE_TEXT, inr, last_number, page_span, parse_amount, parse_date, squash
from paperlode.operators.statement_rows import block_of
from paperlode.session import checkpoint

# Patterns of the printed forms.
ACCOUNT = r"(?i)\b(?:account\s*(?:number|no)\.?|a/c\s*(?:number|no)\.?)\s*[:\-]?\s*([0-9Xx*]{6,20})\b"
HOLDER = r"(?i)account\s*(?:holder\s*)?name\s*[:\-]?\s*([A-Za-z][A-Za-z .,&']{2,80})"
HOLDER_AFTER_NUMBER = r"[0-9]{6,20}\s*(?:\([A-Z]{3}\))?\s*-\s*([A-Z][A-Z .]{2,60})"
PERIOD_FIRST = rf"(?i)(?:from|period)\s*:?\s*({DATE_TEXT})\s*(?:to|-)\s*:?\s*({DATE_TEXT})"
IFSC_LABELLED = r"(?i)IFSC\s*(?:code)?\s*[:\-]?\s*([A-Z]{4}0[A-Z0-9]{6})"
IFSC_ANY = r"\b([A-Z]{4})0[A-Z0-9]{6}\b"
AMOUNT_TOKEN = r"\(?-?\d{1,3}(?:,\d{2,3})*\.\d{2}\)?(?:\s*(?:Cr|Dr|CR|DR))?"
RETURN_MARK = r"(?i)INDIAN\s+INCOME\s+TAX\s+RETURN"
ACKNOWLEDGEMENT = r"(?i)Acknowledgement\s*Number\s*:?\s*(\d{10,20})"
FILED = r"(?i)Date\s*of\s*Filing\s*:?\s*(\d{1,2}-[A-Za-z]{3}-\d{4})"
PAN = r"\b([A-Z]{5}\d{4}[A-Z])\b"
YEAR = r"\b(20\d{2})\s*-\s*(20\d{2}|\d{2})\b"
FORM = r"\bITR\s*-?\s*([1-7])\b"

# The bank that the first four letters of an IFSC name.
IFSC_BANKS = {
    "SBIN": "State Bank of India", "HDFC": "HDFC Bank", "ICIC": "ICICI Bank", "UTIB": "Axis Bank", "KKBK": "Kotak Mahindra Bank",
    "PUNB": "Punjab National Bank", "BARB": "Bank of Baroda", "CNRB": "Canara Bank", "UBIN": "Union Bank of India", "IDIB": "Indian Bank",
    "BKID": "Bank of India", "YESB": "Yes Bank", "INDB": "IndusInd Bank", "IDFB": "IDFC First Bank", "FDRL": "Federal Bank",
    "MAHB": "Bank of Maharashtra", "IOBA": "Indian Overseas Bank", "UCBA": "UCO Bank", "CBIN": "Central Bank of India", "PSIB": "Punjab & Sind Bank",
    "RATN": "RBL Bank", "AUBL": "AU Small Finance Bank", "HSBC": "HSBC", "SCBL": "Standard Chartered", "CITI": "Citibank", "DBSS": "DBS Bank",
    "KARB": "Karnataka Bank", "SIBL": "South Indian Bank", "KVBL": "Karur Vysya Bank", "TMBL": "Tamilnad Mercantile Bank", "CSBK": "CSB Bank",
    "DLXB": "Dhanlaxmi Bank", "JAKA": "J&K Bank",
}
# Banks by their names in capitals without blanks, in order of precedence.
BANK_NAMES = {
    "STATEBANKOFINDIA": "State Bank of India", "HDFCBANK": "HDFC Bank", "ICICIBANK": "ICICI Bank", "AXISBANK": "Axis Bank", "KOTAKMAHINDRA": "Kotak Mahindra Bank",
    "PUNJABNATIONALBANK": "Punjab National Bank", "BANKOFBARODA": "Bank of Baroda", "CANARABANK": "Canara Bank", "UNIONBANKOFINDIA": "Union Bank of India",
    "YESBANK": "Yes Bank", "INDUSINDBANK": "IndusInd Bank", "IDFCFIRST": "IDFC First Bank", "FEDERALBANK": "Federal Bank",
}
# Amounts of a return and the labels of their rows.
RETURN_AMOUNTS = {
    "gross_total_income": r"(?i)Gross Total Income", "total_deductions": r"(?i)\bTotal deductions\b", "total_income": r"(?<!Gross )(?<!GROSS )Total Income",
    "tax_on_total_income": r"(?i)Tax payable on total income", "total_tax_and_cess": r"(?i)Total Tax,? and Cess", "total_taxes_paid": r"(?i)Total Taxes Paid",
    "refund": r"(?i)\bRefund\s*\(", "tax_payable": r"(?i)\bAmount payable\s*\(", "deduction_80C": r"\b80C\s*-", "deduction_80D": r"\b80D\s*-",
}


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each line once, the first loaded: doc_id, line_no, page, text, cells. Lines without doc_id or line_no go."""
    d = lines.where(F.col("doc_id").isNotNull() & F.col("line_no").isNotNull())
    w = Window.partitionBy("doc_id", "line_no").orderBy("loaded_at")
    return d.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "line_no", "page", "text", "cells")


def sections(lines: DataFrame) -> DataFrame:
    """Account sections: doc_id, account_number, page_start, page_end.

    A section starts where a number first appears; it ends before the next one's page, at least on its own page. Two
    that begin on one page overlap there. Documents without an account number have none.
    """
    number = F.regexp_extract("text", ACCOUNT, 1)
    first = (
        lines.where(F.lower("text").contains("a") & F.col("text").rlike(ACCOUNT))
        .groupBy("doc_id", number.alias("account_number"))
        .agg(F.min(F.struct("line_no", "page")).alias("at"))
        .select("doc_id", "account_number", F.col("at.line_no").alias("line_no"), F.col("at.page").alias("page_start"))
    )
    last = lines.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    nxt = F.lead("page_start").over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return first.withColumn("next", nxt).join(last, "doc_id").select("doc_id", "account_number", "page_start", F.greatest(F.coalesce("next", "last_page"), "page_start").alias("page_end"))


def section_lines(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Lines with the section of their page (twice where two sections share it)."""
    pages = parts.select("doc_id", "account_number", "page_start", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return lines.join(pages, ["doc_id", "page"])


def header_columns(cells: Column) -> Column:
    """Places (from 1) of balance, date, debit, credit and narration in a header row; null where it is none.

    The first matching kind of each cell counts, in the order balance, date (not a value date), debit, credit,
    narration; any date serves where there is no other.
    """

    def kind(c: Column) -> Column:
        n = squash(c)
        return (
            F.when(n.contains("balance") | n.isin("closingbal", "bal"), "balance")
            .when(n.contains("date") & ~n.contains("value"), "date")
            .when(n.contains("withdrawal") | n.contains("debit") | (n == "dr"), "debit")
            .when(n.contains("deposit") | n.contains("credit") | (n == "cr"), "credit")
            .when(n.rlike("narration|description|particular|remark|details"), "narration")
            .otherwise("")
        )

    kinds = F.transform(cells, kind)
    place = lambda k: F.nullif(F.array_position(kinds, k).cast("int"), F.lit(0))
    other = F.nullif(F.array_position(F.transform(cells, lambda c: squash(c).contains("date") | squash(c).isin("valuedt", "txndt")), True).cast("int"), F.lit(0))
    made = F.struct(F.size(cells).alias("width"), place("balance").alias("balance"), F.coalesce(place("date"), other).alias("date"), place("debit").alias("debit"), place("credit").alias("credit"), place("narration").alias("narration"))
    possible = F.lower(F.array_join(cells, "|")).contains("bal")
    return F.when(possible, F.when(place("balance").isNotNull() & F.coalesce(place("date"), other).isNotNull(), made))


def periods(sl: DataFrame) -> DataFrame:
    """The first printed period of each section: text, and the two days it names."""
    hit = sl.where(F.col("text").rlike(PERIOD_FIRST)).groupBy("doc_id", "account_number").agg(F.min(F.struct("line_no", "text")).alias("x"))
    a, b = F.regexp_extract("x.text", PERIOD_FIRST, 1), F.regexp_extract("x.text", PERIOD_FIRST, 2)
    return hit.select("doc_id", "account_number", F.concat_ws(" to ", a, b).alias("period"), parse_date(a).alias("lo"), parse_date(b).alias("hi"))


def transactions(sl: DataFrame, as_of: date = date(2025, 12, 31)) -> DataFrame:
    """Transaction rows of sections: doc_id, account_number, line_no, tx_date, debit, credit, balance, narration, seq.

    A row counts if it is as wide as the last header before it, its date and balance can be read, and the day lies
    within 45 days of the section's period (without one, from 2000 to the end of the year after ``as_of``). ``seq``
    orders rows by time; rows of a day keep their order, turned round where the statement runs newest first.
    """
    keys = ["doc_id", "account_number"]
    at = lambda k: F.when(F.col(f"h.{k}").isNotNull(), F.try_element_at("cells", F.col(f"h.{k}")))
    printed = F.when(F.col("text").rlike(PERIOD_FIRST), F.struct(parse_date(F.regexp_extract("text", PERIOD_FIRST, 1)).alias("lo"), parse_date(F.regexp_extract("text", PERIOD_FIRST, 2)).alias("hi")))
    # a section may hold any number of lines: headers are filled within blocks of line numbers, and what a block begins
    # with (the last header before it, the section's first period) comes from windows over one row a block
    rows = (
        sl.select(*keys, block_of(F.col("line_no")).alias("block"), "line_no", "cells", F.when(F.col("cells").isNotNull(), header_columns(F.col("cells"))).alias("own"), printed.alias("printed"))
        .where(F.col("cells").isNotNull() | F.col("printed").isNotNull())
        .repartition(*keys, "block")
    )
    order = Window.partitionBy(*keys, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct("line_no", c))
    edges = rows.groupBy(*keys, "block").agg(F.max(known("own"))["own"].alias("last"), F.min(known("printed"))["printed"].alias("first"))
    section = Window.partitionBy(*keys).orderBy("block")
    carried = edges.select(
        *keys, "block", F.last("last", ignorenulls=True).over(section.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.first("first", ignorenulls=True).over(section.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("period"),
    )
    under = (
        rows.withColumn("h", F.last("own", ignorenulls=True).over(order))
        .where(F.col("cells").isNotNull() & F.col("own").isNull())
        .join(carried, [*keys, "block"])
        .withColumn("h", F.coalesce("h", "carried"))
        .where(F.size("cells") == F.col("h.width"))
    )
    read = under.select(*keys, "line_no", "period", parse_date(at("date")).alias("tx_date"), parse_amount(at("debit")).alias("debit"), parse_amount(at("credit")).alias("credit"), parse_amount(at("balance")).alias("balance"), F.coalesce(F.substring(at("narration"), 1, 80), F.lit("")).alias("narration"))
    lo, hi = F.col("period.lo"), F.col("period.hi")
    kept = read.where(F.col("tx_date").isNotNull() & F.col("balance").isNotNull()).where(
        F.when(lo.isNotNull() & hi.isNotNull(), F.col("tx_date").between(F.date_sub(lo, 45), F.date_add(hi, 45))).otherwise(
            F.col("tx_date").between(F.lit(date(2000, 1, 1)), F.lit(date(as_of.year + 1, 12, 31)))
        )
    ).drop("period")
    kept = checkpoint(kept)
    # places in order of time: the rows of earlier days, summed over one row a day, and the place within the day
    days = kept.groupBy(*keys, "tx_date").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "tx_date")).alias("a"), F.max(F.struct("line_no", "tx_date")).alias("z"))
    by_day, every = Window.partitionBy(*keys).orderBy("tx_date"), Window.partitionBy(*keys)
    placed = days.select(
        *keys, "tx_date", F.coalesce(F.sum("n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), (F.min("a").over(every)["tx_date"] > F.max("z").over(every)["tx_date"]).alias("turned"),
    )
    key = F.when(F.col("turned"), -F.col("line_no")).otherwise(F.col("line_no"))
    within = F.row_number().over(Window.partitionBy(*keys, "tx_date").orderBy("key"))
    return kept.join(placed, [*keys, "tx_date"]).withColumn("key", key).select(*keys, "line_no", "tx_date", "debit", "credit", "balance", "narration", (F.col("earlier") + within).cast("int").alias("seq"))


def beside(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with ``before`` and ``after``: the value of the row before and after each in order of line_no within its
    keys. Neighbours are found within blocks of line numbers; over a block's edge they come from a window over one row
    a block."""
    d = rows.withColumn("block", block_of(F.col("line_no"))).repartition(*keys, "block")
    order, section = Window.partitionBy(*keys, "block").orderBy("line_no"), Window.partitionBy(*keys).orderBy("block")
    one = F.struct(value)
    edges = d.groupBy(*keys, "block").agg(F.min(F.struct("line_no", value)).alias("a"), F.max(F.struct("line_no", value)).alias("z"))
    outer = edges.select(*keys, "block", F.lag(F.struct(F.col(f"z.{value}").alias(value))).over(section).alias("_b"), F.lead(F.struct(F.col(f"a.{value}").alias(value))).over(section).alias("_a"))
    inner = d.withColumn("_lag", F.lag(one).over(order)).withColumn("_lead", F.lead(one).over(order)).join(outer, [*keys, "block"])
    return inner.withColumn("before", F.coalesce("_lag", "_b")[value]).withColumn("after", F.coalesce("_lead", "_a")[value]).drop("block", "_lag", "_lead", "_a", "_b")


def totals(tx: DataFrame) -> DataFrame:
    """Per account: count, first and last day, closing balance, sums of debits and credits (absolute values)."""
    return tx.groupBy("doc_id", "account_number").agg(
        F.count(F.lit(1)).alias("transactions"), F.min("tx_date").alias("first_transaction"), F.max("tx_date").alias("last_transaction"),
        F.max_by("balance", "seq").alias("closing_balance"),
        F.coalesce(F.sum(F.abs("debit")), F.lit(0)).cast("decimal(28,2)").alias("total_debits"), F.coalesce(F.sum(F.abs("credit")), F.lit(0)).cast("decimal(28,2)").alias("total_credits"),
    )


def largest(tx: DataFrame, n: int = 3) -> DataFrame:
    """The n largest debits and credits of every account, ties in order of time: kind, rank, tx_date, amount, narration."""
    each = tx.select("doc_id", "account_number", "seq", "tx_date", "narration", F.explode(F.array(F.struct(F.lit("debit").alias("kind"), F.abs("debit").alias("amount")), F.struct(F.lit("credit").alias("kind"), F.abs("credit").alias("amount")))).alias("x"))
    rows = each.select("doc_id", "account_number", "seq", "tx_date", "narration", "x.kind", "x.amount").where(F.col("amount") != 0)
    w = Window.partitionBy("doc_id", "account_number", "kind").orderBy(F.desc("amount"), "seq")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("doc_id", "account_number", "kind", "rank", "tx_date", "amount", "narration")


def row_check(tx: DataFrame) -> DataFrame:
    """Per account: how many rows follow from the row before (or, read backwards, after) them, and of how many.

    Pairs whose later row has neither debit nor credit do not count; the better direction does, forward at a tie.
    """

    def fits(before: Column) -> Column:
        moved = before - F.coalesce(F.abs("debit"), F.lit(0)) + F.coalesce(F.abs("credit"), F.lit(0)) - F.col("balance")
        counted = before.isNotNull() & (F.col("debit").isNotNull() | F.col("credit").isNotNull())
        return F.when(counted, (F.abs(moved) < 0.015).cast("int"))

    near = beside(tx.select("doc_id", "account_number", "line_no", "debit", "credit", "balance"), ["doc_id", "account_number"], "balance")
    checked = near.select("doc_id", "account_number", fits(F.col("before")).alias("f"), fits(F.col("after")).alias("b"))
    g = checked.groupBy("doc_id", "account_number").agg(F.sum("f").alias("fs"), F.count("f").alias("fn"), F.sum("b").alias("bs"), F.count("b").alias("bn"))
    better = (F.col("bn") > 0) & ((F.col("fn") == 0) | (F.col("bs") * F.col("fn") > F.col("fs") * F.col("bn")))
    ok, n = F.when(better, F.col("bs")).otherwise(F.col("fs")), F.when(better, F.col("bn")).otherwise(F.col("fn"))
    text = F.concat(F.round(ok * 100 / n).cast("int").cast("string"), F.lit("% of "), n.cast("string"), F.lit(" rows reconcile (previous balance - debit + credit = balance)"))
    return g.select("doc_id", "account_number", ok.cast("bigint").alias("reconciled"), n.alias("checked"), F.when(n > 0, text).alias("row_check"))


def holders(sl: DataFrame) -> DataFrame:
    """The first holder named in each section, by label or behind the account number."""
    by_label = F.when(F.col("text").rlike(HOLDER), F.btrim(F.regexp_extract("text", HOLDER, 1), F.lit(" ,")))
    behind = F.when(F.expr("contains(text, account_number)") & F.col("text").rlike(HOLDER_AFTER_NUMBER), F.trim(F.regexp_extract("text", HOLDER_AFTER_NUMBER, 1)))
    return sl.withColumn("holder", F.coalesce(by_label, behind)).where(F.col("holder").isNotNull()).groupBy("doc_id", "account_number").agg(F.min_by("holder", "line_no").alias("holder"))


def banks(sl: DataFrame) -> DataFrame:
    """The bank of each section: by labelled IFSC on its first page, name on that page, any known IFSC there, or the
    name mentioned most in the section (ties by the order of ``BANK_NAMES``); null if there is no sign of one."""
    known = F.create_map(*(F.lit(x) for kv in IFSC_BANKS.items() for x in kv))
    head = (F.col("page") == F.col("page_start")) & F.col("cells").isNull()
    labelled = F.when(head & F.col("text").rlike(IFSC_LABELLED), F.substring(F.regexp_extract("text", IFSC_LABELLED, 1), 1, 4))
    loose = F.when(head & F.col("text").rlike(IFSC_ANY), F.try_element_at(known, F.regexp_extract("text", IFSC_ANY, 1)))
    capitals = F.regexp_replace(F.upper("text"), "[^A-Z]", "")
    names = {**{k: (k, v) for k, v in BANK_NAMES.items()}, "~I": ("ICICI", "ICICI Bank"), "~H": ("HDFC", "HDFC Bank")}
    d = sl.withColumn("lab", labelled).withColumn("loose", loose).withColumn("caps", capitals)
    agg = d.groupBy("doc_id", "account_number").agg(
        F.min(F.when(F.col("lab").isNotNull(), F.struct("line_no", "lab")))["lab"].alias("lab"),
        F.min(F.when(F.col("loose").isNotNull(), F.struct("line_no", "loose")))["loose"].alias("loose"),
        *(F.max(F.when(head, F.col("caps").contains(k))).alias(f"on_{i}") for i, k in enumerate(BANK_NAMES)),
        *(F.sum(F.regexp_count("caps", F.lit(k))).alias(f"n_{i}") for i, (k, _) in enumerate(names.values())),
    )
    on_page = F.coalesce(*(F.when(F.col(f"on_{i}"), F.lit(v)) for i, v in enumerate(BANK_NAMES.values())))
    counts = F.array(*(F.struct((F.col(f"n_{i}")).alias("n"), F.lit(-i).alias("o"), F.lit(v).alias("name")) for i, (_, v) in enumerate(names.values())))
    most = F.array_max(F.filter(counts, lambda x: x["n"] > 0))["name"]
    return agg.select("doc_id", "account_number", F.coalesce(F.coalesce(F.try_element_at(known, F.col("lab")), F.col("lab")), on_page, F.col("loose"), most).alias("bank"))


def printed_summary(sl: DataFrame) -> DataFrame:
    """Figures a statement prints itself, per account, as a map of formatted amounts.

    A line that names opening and closing balances with a line of as many amounts after it counts first; else single
    lines "opening (or closing) balance: amount".
    """
    order = Window.partitionBy("doc_id", "account_number").orderBy("line_no")
    names = F.transform(
        F.regexp_extract_all(squash("text"), F.lit("(opening|totaldebit|totalcredit|closing|debits|credits)"), 1),
        lambda x: F.when(x == "opening", "opening_balance").when(x == "closing", "closing_balance").when(x.isin("totaldebit", "debits"), "total_debits").otherwise("total_credits"),
    )
    d = sl.select("doc_id", "account_number", "line_no", "text", F.lead("text").over(order).alias("below"))
    both = squash("text").contains("opening") & squash("text").contains("closing")
    block = (
        d.where(both & F.col("below").isNotNull())
        .withColumn("labels", F.array_distinct(names))
        .withColumn("amounts", F.regexp_extract_all("below", F.lit(f"({AMOUNT_TOKEN})"), 1))
        .where((F.size("labels") >= 2) & (F.size("amounts") >= F.size("labels")))
        .groupBy("doc_id", "account_number")
        .agg(F.min(F.struct("line_no", "labels", "amounts")).alias("x"))
        .select("doc_id", "account_number", F.map_from_arrays("x.labels", F.transform(F.slice("x.amounts", 1, F.size("x.labels")), lambda a: inr(parse_amount(a)))).alias("block"))
    )
    single = lambda word: F.when(F.col("text").rlike(rf"(?i){word} balance\s*:?\s*({AMOUNT_TOKEN})"), inr(parse_amount(F.regexp_extract("text", rf"(?i){word} balance\s*:?\s*({AMOUNT_TOKEN})", 1))))
    lines = (
        d.withColumn("o", single("opening")).withColumn("c", single("closing")).where("o is not null or c is not null")
        .groupBy("doc_id", "account_number")
        .agg(F.min(F.when(F.col("o").isNotNull(), F.struct("line_no", "o")))["o"].alias("o"), F.min(F.when(F.col("c").isNotNull(), F.struct("line_no", "c")))["c"].alias("c"))
        .select("doc_id", "account_number", F.map_filter(F.create_map(F.lit("opening_balance"), "o", F.lit("closing_balance"), "c"), lambda k, v: v.isNotNull()).alias("loose"))
    )
    return block.join(lines, ["doc_id", "account_number"], "full").select("doc_id", "account_number", F.coalesce("block", "loose").alias("statement_summary"))


def statement_facts(lines: DataFrame, as_of: date = date(2025, 12, 31)) -> DataFrame:
    """One row per account of every statement; figures null where a section has no transactions.

    Sections may overlap on a page two accounts share. Warnings name figures that differ from the printed summary,
    and accounts whose debit and credit columns cannot be read.
    """
    parts = sections(lines)
    sl = checkpoint(section_lines(lines, parts))  # read by eight branches
    tx = checkpoint(transactions(sl, as_of))
    keys = ["doc_id", "account_number"]

    def top(kind: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "tx_date", "amount", "narration"))))
        return F.transform(rows, lambda x: F.struct(x["tx_date"], x["amount"], x["narration"])).alias(f"largest_{kind}s")

    tops = largest(tx).groupBy(*keys).agg(top("debit"), top("credit"))

    out = parts
    for side in (banks(sl), holders(sl), periods(sl).drop("lo", "hi"), totals(tx), row_check(tx).select(*keys, "row_check"), printed_summary(sl), tops):
        out = out.join(side, keys, "left")
    differs = lambda k: F.when((F.col("statement_summary")[k] != inr(k)), F.lit(k.replace("_", " ")))
    names = F.filter(F.array(*(differs(k) for k in ("closing_balance", "total_debits", "total_credits"))), lambda x: x.isNotNull())
    warnings = F.filter(
        F.array(
            F.when(F.size(names) > 0, F.concat(F.lit("computed "), F.array_join(names, ", "), F.lit(" differ from the printed summary"))),
            F.when((F.col("transactions") > 0) & F.col("row_check").isNull(), F.lit("debit and credit columns could not be read")),
        ),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("pages", page_span("page_start", "page_end")).withColumn("warnings", warnings)


def returns(lines: DataFrame) -> DataFrame:
    """Tax returns: doc_id, return_no (from 1), page_start, page_end, form, assessment_year, pan, name,
    acknowledgement_number, date_of_filing, amounts (as printed).

    A file holds returns if its first 80 lines name one. A page begins a new one if it is the first, shows another
    acknowledgement number than the pages before, or names a return without a number.
    """
    numbered = lines.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    docs = numbered.where((F.col("pos") <= 80) & F.col("text").rlike(RETURN_MARK)).select("doc_id").distinct()
    d = lines.join(docs, "doc_id", "left_semi")
    by_page = d.groupBy("doc_id", "page").agg(
        F.min(F.when(F.col("text").rlike(ACKNOWLEDGEMENT), F.struct("line_no", F.regexp_extract("text", ACKNOWLEDGEMENT, 1).alias("ack"))))["ack"].alias("ack"),
        F.max(F.coalesce(F.col("text").rlike(RETURN_MARK), F.lit(False))).alias("mark"),
    )
    order = Window.partitionBy("doc_id").orderBy("page")
    before = F.last("ack", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.row_number().over(order) == 1) | (F.col("ack").isNotNull() & ~F.col("ack").eqNullSafe(before)) | (F.col("mark") & F.col("ack").isNull())
    marked = by_page.withColumn("new", new.cast("int")).withColumn("return_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("doc_id", "return_no").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    sl = d.join(marked.select("doc_id", "page", "return_no"), ["doc_id", "page"]).join(spans, ["doc_id", "return_no"])
    first = F.col("page") == F.col("page_start")
    t = F.col("text")
    spaced = F.replace(t, F.lit("ITR"), F.lit(" ITR"))
    forms = F.regexp_extract_all(spaced, F.lit(FORM), 1)
    dash_year = F.when(t.rlike(YEAR), F.concat_ws("-", F.regexp_extract(t, YEAR, 1), F.right(F.regexp_extract(t, YEAR, 2), F.lit(2))))

    def earliest(cond: Column, value: Column, name: str) -> Column:
        return F.min(F.when(cond & value.isNotNull(), F.struct("line_no", value.alias("v"))))["v"].alias(name)

    part = lambda p: F.when(t.rlike(rf"{p} Name\s+([A-Z][A-Z .]*?)\s*(?:\||\(|$)"), F.trim(F.regexp_extract(t, rf"{p} Name\s+([A-Z][A-Z .]*?)\s*(?:\||\(|$)", 1)))
    filled = F.filter("cells", lambda c: c != "")
    plain = F.when((F.size(filled) >= 2) & (F.lower(filled[0]) == "name") & filled[1].rlike(r"^[A-Z][A-Z .]{2,60}$"), filled[1])
    agg = sl.groupBy("doc_id", "return_no", "page_start", "page_end").agg(
        earliest(first & t.rlike(r"(?i)form\s*number"), F.try_element_at(forms, F.lit(1)), "form_row"),
        F.min(F.when(first & (F.size(forms) == 1), F.struct("line_no", forms[0].alias("v"), dash_year.alias("y")))).alias("lone"),
        earliest(first & t.rlike(r"(?i)assessment\s*year"), dash_year, "labelled_year"), earliest(first, dash_year, "any_year"),
        earliest(first, F.when(t.rlike(PAN), F.regexp_extract(t, PAN, 1)), "pan"), earliest(first, F.when(t.rlike(ACKNOWLEDGEMENT), F.regexp_extract(t, ACKNOWLEDGEMENT, 1)), "acknowledgement_number"),
        earliest(first, F.when(t.rlike(FILED), F.regexp_extract(t, FILED, 1)), "date_of_filing"),
        *(earliest(first, part(p), p) for p in ("First", "Middle", "Last")), earliest(first, plain, "plain_name"),
        *(earliest(t.rlike(rx), last_number(F.col("cells"), t, rx), f"a_{k}") for k, rx in RETURN_AMOUNTS.items()),
    )
    parts = F.nullif(F.trim(F.concat_ws(" ", "First", "Middle", "Last")), F.lit(""))
    return agg.select(
        "doc_id", "return_no", "page_start", "page_end",
        F.concat(F.lit("ITR-"), F.coalesce("form_row", "lone.v")).alias("form"),
        F.coalesce(F.when(F.col("form_row").isNull(), F.col("lone.y")), "labelled_year", "any_year").alias("assessment_year"),
        "pan", F.coalesce(parts, "plain_name").alias("name"), "acknowledgement_number", "date_of_filing",
        F.map_filter(F.create_map(*(x for k in RETURN_AMOUNTS for x in (F.lit(k), F.col(f"a_{k}")))), lambda k, v: v.isNotNull()).alias("amounts"),
    )


def section_of_pages(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """The first section (by page_start, then name) that holds each page: a left join on single pages."""
    each = parts.select("doc_id", "account_number", "page_start", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    first = each.groupBy("doc_id", "page").agg(F.min(F.struct("page_start", "account_number")).alias("x")).select("doc_id", "page", F.col("x.account_number").alias("account_number"))
    return pages.join(first, ["doc_id", "page"], "left")

