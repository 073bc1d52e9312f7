"""Answers straight from facts: which questions they serve, and the rendered tables. No model is involved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions.scalars import assessment_year, inr, page_span, shorten

# Questions that facts cannot answer, and those of statements, of the largest rows, and of returns.
MODEL_ONLY = (
    r"(?i)\b(why|explain|reason|how come|analy[sz]e|compare|trend|pattern|suspicious|unusual|should|advice|recommend|predict|summari[sz]e the transactions|narration|to whom|from whom|which transaction|"
    r"on \d{1,2}[/\-.]|between|after|before|salary from|paid to|received from)\b|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{1,2} (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
)
BANK = r"(?i)\b(accounts?|a/cs?|banks?|closing balance|balances?|top|largest|biggest|highest|major|total debits?|total credits?|debits?|credits?|withdrawals?|deposits?|statement period|period|holders?|how many)\b"
TOP = r"(?i)\b(top|largest|biggest|highest|major|maximum|max)\b"
TAX = r"(?i)\b(income|tax|refund|deductions?|80c|80d|returns?|itr|assessment year|ay|pan|filing|filed|acknowledg\w*|taxable|taxes paid|payable)\b"
# Labels of a return's amounts.
LABELS = {
    "gross_total_income": "Gross total income", "total_deductions": "Total deductions", "total_income": "Total (taxable) income", "tax_on_total_income": "Tax on total income",
    "total_tax_and_cess": "Total tax and cess", "total_taxes_paid": "Total taxes paid", "refund": "Refund", "tax_payable": "Tax payable", "deduction_80C": "80C deduction", "deduction_80D": "80D deduction",
}


def intent(question: Column) -> Column:
    """Model, bank, tax, both or none: what a question asks of facts."""
    bank, tax = question.rlike(BANK), question.rlike(TAX)
    return F.when(question.rlike(MODEL_ONLY) | (F.trim(question) == ""), "model").when(bank & tax, "both").when(bank, "bank").when(tax, "tax").otherwise("none")


def wants(question: Column) -> tuple[Column, Column]:
    """Whether largest debits, and largest credits, are asked for (both where neither is named)."""
    top = question.rlike(TOP)
    debit, credit = question.rlike(r"(?i)debit|withdraw"), question.rlike(r"(?i)credit|deposit")
    spent, received = question.rlike(r"(?i)spent|paid"), question.rlike(r"(?i)receiv")
    return top & (debit | spent | ~credit), top & (credit | received | ~debit)


def _table(head: list[str], rows: Column) -> Column:
    return F.concat(F.lit("| " + " | ".join(head) + " |\n|" + "---|" * len(head) + "\n"), F.array_join(rows, "\n"))


def _cell(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("—"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(_cell(c) for c in cells)), F.lit(" |"))


def bank_tables(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """G12 for statements: doc_id and the table of its accounts. A printed figure stands before a computed one."""
    printed = lambda k: F.col("statement_summary")[k]
    figure = lambda k: F.when(printed(k).isNotNull(), F.concat(printed(k), F.lit(" (printed)"))).otherwise(inr(k))
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct("page_start", "account_number", F.col("cells").alias("c")))), lambda x: x["c"]
    )
    d = facts.withColumn(
        "cells",
        _row(F.coalesce("bank", F.lit("Unknown")), F.col("account_number"), F.col("holder"), F.col("period"), F.col("transactions"), figure("closing_balance"), figure("total_debits"), figure("total_credits"), F.substring_index("row_check", " (", 1), page_span("page_start", "page_end")),
    )
    head = ["Bank", "Account no.", "Holder", "Period", "Txns", "Closing balance", "Total debits", "Total credits", "Row check", "Pages"]
    g = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), _table(head, rows).alias("table"))
    title = F.concat(F.lit("**"), F.coalesce("source", "doc_id"), F.lit("** has **"), F.col("n").cast("string"), F.when(F.col("n") == 1, " account**:").otherwise(" accounts**:"))
    return g.join(sources, "doc_id", "left").select("doc_id", F.concat(title, F.lit("\n\n"), F.col("table")).alias("answer"))


def largest_table(facts: DataFrame, kind: str) -> DataFrame:
    """The largest debits or credits of all accounts of a document as a table."""
    who = F.concat(F.coalesce("bank", F.lit("Unknown")), F.lit(" …"), F.right("account_number", F.lit(4)))
    d = facts.select("doc_id", "page_start", "account_number", who.alias("who"), F.posexplode(kind).alias("pos", "t"))
    line = _row(F.col("who"), F.date_format("t.tx_date", "dd MMM yyyy"), inr("t.amount"), shorten("t.narration"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("page_start", "account_number", "pos", line.alias("c")))), lambda x: x["c"])
    return d.groupBy("doc_id").agg(_table(["Account", "Date", "Amount", "Description"], rows).alias("answer"))


def return_tables(returns: DataFrame, year: str | None = None) -> DataFrame:
    """G12 for returns: doc_id and its fields by assessment year (all, or one), as rows of label and values."""
    r = returns.where(F.col("assessment_year") == year) if year else returns
    fields = [("Form", F.col("form")), ("Name", F.col("name")), ("PAN", F.col("pan")), ("Date of filing", F.col("date_of_filing")), *((LABELS[k], F.col("amounts")[k]) for k in LABELS), ("Pages in file", page_span("page_start", "page_end"))]
    each = r.select("doc_id", "assessment_year", "return_no", F.posexplode(F.array(*(F.struct(F.lit(n).alias("label"), v.cast("string").alias("value")) for n, v in fields))).alias("pos", "f"))
    values = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("assessment_year", F.lit("")).alias("y"), "return_no", _cell(F.col("f.value")).alias("v")))), lambda x: x["v"])
    g = each.groupBy("doc_id", "pos", F.col("f.label").alias("label")).agg(values.alias("v")).where(F.exists("v", lambda v: v != "—") | (F.col("pos") < 4))
    line = F.concat(F.lit("| "), F.col("label"), F.lit(" | "), F.array_join("v", " | "), F.lit(" |"))
    return g.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("answer"))


def bank_answers(accounts: DataFrame, debits: bool = False, credits: bool = False) -> DataFrame:
    """doc_id and the answer of its statements: the table of accounts, and the largest rows where they are asked
    for. ``accounts`` carry the source of their document."""
    names = accounts.groupBy("doc_id").agg(F.min("source").alias("source"))
    d = bank_tables(accounts.drop("source"), names)
    for wanted, kind, title in ((debits, "largest_debits", "Largest debits"), (credits, "largest_credits", "Largest credits")):
        if wanted:
            more = largest_table(accounts, kind).withColumnRenamed("answer", "more")
            d = d.join(more, "doc_id", "left").select("doc_id", F.concat("answer", F.coalesce(F.concat(F.lit(f"\n\n**{title}**\n\n"), "more"), F.lit(""))).alias("answer"))
    return d


def return_answers(returns: DataFrame, year: str | None = None) -> DataFrame:
    """doc_id and the answer of its returns (of one year, if given): a table with a column for each return."""
    r = returns.where(F.col("assessment_year") == year) if year else returns
    years = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("assessment_year", F.lit("")).alias("y"), "return_no"))), lambda x: F.coalesce(F.nullif(x["y"], F.lit("")), F.lit("—")))
    heads = r.groupBy("doc_id").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("n"), years.alias("years"))
    scope = F.lit(f"AY {year}") if year else F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " return").otherwise(" returns"))
    head = F.concat(F.lit("| | "), F.array_join(F.transform("years", lambda y: F.concat(F.lit("AY "), y)), " | "), F.lit(" |\n|---|"), F.repeat(F.lit("---|"), F.size("years")), F.lit("\n"))
    title = F.concat(F.lit("**"), F.coalesce("source", "doc_id"), F.lit("** · "), scope, F.lit(":\n\n"))
    return return_tables(r.drop("source")).join(heads, "doc_id").select("doc_id", F.concat(title, head, F.col("answer")).alias("answer"))


def _named(name: str, value: Column) -> Column:
    """``name: value``, null where there is no value, so that ``concat_ws`` passes it over."""
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(f"{name}: "), value.cast("string")))


def rendered_accounts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """G11 for statements: doc_id and a compact text of its accounts for a prompt; what is not known is left out."""
    day = lambda c: F.date_format(c, "dd MMM yyyy")
    summary = F.array_join(F.transform(F.map_entries("statement_summary"), lambda e: F.concat(F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit(" "), e["value"])), ", ")

    def largest(kind: str) -> Column:
        one = lambda t: F.concat(inr(t["amount"]), F.lit(" on "), F.date_format(t["tx_date"], "dd MMM yyyy"), F.when(t["narration"] != "", F.concat(F.lit(" ("), t["narration"], F.lit(")"))).otherwise(""))
        return F.when(F.size(kind) > 0, F.concat(F.lit(f"\n     {kind.replace('_', ' ')}: "), F.array_join(F.transform(kind, one), "; ")))

    bits = F.concat_ws(
        "; ", F.concat(F.coalesce("bank", F.lit("Unknown bank")), F.lit(" a/c "), F.col("account_number")), F.concat(F.lit("pages "), page_span("page_start", "page_end")),
        _named("holder", F.col("holder")), _named("period", F.col("period")), _named("transactions", F.col("transactions")), _named("first transaction", day("first_transaction")), _named("last transaction", day("last_transaction")),
        _named("printed summary", summary), _named("computed closing balance", inr("closing_balance")), _named("computed total debits", inr("total_debits")), _named("computed total credits", inr("total_credits")), _named("row check", F.col("row_check")),
    )
    notes = F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("\n     WARNING: "), w)), "")
    d = facts.withColumn("t", F.concat(bits, notes, F.coalesce(largest("largest_debits"), F.lit("")), F.coalesce(largest("largest_credits"), F.lit(""))))
    return _numbered(d, ["page_start", "account_number"], sources, " account(s) in this file")


def rendered_returns(returns: DataFrame, sources: DataFrame, year: str | None = None) -> DataFrame:
    """G11 for returns: doc_id and a compact text of its returns, of one year if given (then files without it have none)."""
    amounts = F.array_join(F.filter(F.array(*(_named(label, F.col("amounts")[k]) for k, label in LABELS.items())), lambda x: x.isNotNull()), "; ")
    names = ("form", "assessment_year", "name", "pan", "date_of_filing", "acknowledgement_number")
    head = F.concat_ws("; ", F.concat(F.lit("pages "), page_span("page_start", "page_end")), *(_named(n.replace("_", " "), F.col(n)) for n in names))
    d = returns.withColumn("t", F.concat(head, F.when(amounts != "", F.concat(F.lit("\n     "), amounts)).otherwise("")))
    return _numbered(d.where(F.col("assessment_year") == year) if year else d, ["return_no"], sources, " income tax return(s) in this file")


def _numbered(d: DataFrame, order: list[str], sources: DataFrame, what: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, "t"))), lambda x: x["t"])
    g = d.groupBy("doc_id").agg(rows.alias("r")).join(sources, "doc_id", "left")
    lines = F.array_join(F.transform("r", lambda t, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), t)), "\n")
    return g.select("doc_id", F.concat(F.coalesce("source", "doc_id"), F.lit(":\n  "), F.size("r").cast("string"), F.lit(what + "\n"), lines).alias("text"))


def summaries(accounts: DataFrame, returns: DataFrame) -> DataFrame:
    """One line for every document with facts; returns go before accounts where a file has both."""
    who = F.concat(F.coalesce("bank", F.lit("Unknown bank")), F.lit(" …"), F.right("account_number", F.lit(4)))
    a = accounts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_start", "account_number", who.alias("w")))), lambda x: x["w"]), ", ").alias("t"))
    a = a.select("doc_id", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " account: ").otherwise(" accounts: "), "t").alias("summary"))
    what = F.concat(F.coalesce("form", F.lit("ITR")), F.lit(" AY "), F.coalesce("assessment_year", F.lit("?")))
    r = returns.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("return_no", what.alias("w")))), lambda x: x["w"]), ", ").alias("t"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    r = r.select("doc_id", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " return: ").otherwise(" returns: "), F.col("t"), F.when(F.col("names") != "", F.concat(F.lit(" · "), "names")).otherwise("")).alias("summary"))
    return r.unionByName(a.join(r, "doc_id", "left_anti"))


def year_asked(question: Column, given: Column) -> Column:
    """The year a question names, else the one given."""
    return F.coalesce(assessment_year(question), given)
