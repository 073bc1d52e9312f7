"""Listings of what is stored: documents, sources, kinds, years, document types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Document types by category, with their labels, in order.
DOC_TYPES = (
    ("bank_statement", "finance", "Bank statement"),
    ("ais", "finance", "Annual Information Statement (AIS / TIS)"),
    ("form16", "finance", "Form 16 / 16A (TDS certificate)"),
    ("form26as", "finance", "Form 26AS (tax credit statement)"),
    ("itr", "finance", "Income tax return"),
    ("salary_slip", "finance", "Salary slip"),
    ("invoice", "finance", "Invoice"),
    ("annual_report", "finance", "Annual report / financial statements"),
    ("finance_other", "finance", "Other finance document"),
    ("sale_deed", "property", "Sale deed"),
    ("land_record", "property", "Land record"),
    ("lease", "property", "Lease"),
    ("encumbrance", "property", "Encumbrance certificate"),
    ("property_tax", "property", "Property tax receipt / assessment"),
    ("property_other", "property", "Other property document"),
    ("other", "other", "Other document"),
)


def doc_types(spark: SparkSession) -> DataFrame:
    """The dimension of document types: key, category, label, pos."""
    return spark.createDataFrame([(k, c, label, i) for i, (k, c, label) in enumerate(DOC_TYPES)], "key string, category string, label string, pos int")


def type_options(types: DataFrame) -> DataFrame:
    """The types of each category in declared order."""
    return types.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("types"))


def with_type(rows: DataFrame, types: DataFrame, column: str = "doc_type") -> DataFrame:
    """Rows with the label of their type; an unknown or missing type is ``other``."""
    t = F.broadcast(types.select(F.col("key").alias(column), F.col("label").alias("type_label")))  # a fixed handful of rows
    return rows.join(t, column, "left").withColumn("type_label", F.coalesce("type_label", F.lit("Other document")))


def documents(chunks: DataFrame) -> DataFrame:
    """Chunks, pages and first source, type and category of every document."""
    first = lambda c, default: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chunk_index"))), F.lit(default)).alias(c)
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.max("page_end"), F.lit(0)).alias("pages"), first("source", "?"), first("category", "other"), first("doc_type", "other")).orderBy(F.lower("source"), "doc_id")


def by_source(chunks: DataFrame) -> DataFrame:
    """Chunks of every source."""
    return chunks.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count(F.lit(1)).alias("chunks"))


def kind_histogram(kinds: DataFrame) -> DataFrame:
    """D3: pages of each kind of every document, as a map."""
    return kinds.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def years(returns: DataFrame) -> DataFrame:
    """Distinct years and names, sorted."""
    return returns.agg(F.array_sort(F.collect_set("assessment_year")).alias("years"), F.array_sort(F.collect_set("name")).alias("names"))


def year_pivot(returns: DataFrame, fields: list[str], years: list[str]) -> DataFrame:
    """Fields as rows, years as columns, a dash where a year has none. Of several returns of a year the first
    acknowledgement number counts."""
    each = returns.select("assessment_year", "acknowledgement_number", F.explode("amounts").alias("field", "amount")).where(F.col("field").isin(fields))
    p = each.groupBy("field").pivot("assessment_year", years).agg(F.min_by("amount", "acknowledgement_number"))
    return p.select("field", *(F.coalesce(F.col(f"`{y}`"), F.lit("—")).alias(f"ay_{y.replace('-', '_')}") for y in years))


def tagged_chunks(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with the account of their first page; a chunk without page has none."""
    each = sections.select("doc_id", "account_number", "page_start", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    first = each.groupBy("doc_id", "page").agg(F.min(F.struct("page_start", "account_number")).alias("x")).select("doc_id", F.col("page").alias("page_start"), F.col("x.account_number").alias("section_account"))
    return chunks.join(first, ["doc_id", "page_start"], "left")


def section_tags(chunks: DataFrame, accounts: DataFrame, returns: DataFrame) -> DataFrame:
    """Chunks with ``account`` (bank and number), ``year`` and ``return`` (form and year) of the section that
    holds their first page, and ``prefix``, what goes before their text for embedding. Of several sections on a page
    the first counts; chunks without page or section have no tags and an empty prefix."""

    def by_page(parts: DataFrame, value: Column, name: str) -> DataFrame:
        each = parts.select("doc_id", F.struct("page_start", "page_end", value.alias("v")).alias("x"), F.explode(F.sequence("page_start", "page_end")).alias("page"))
        return each.groupBy("doc_id", "page").agg(F.min("x")["v"].alias(name)).withColumnRenamed("page", "page_start")

    account = by_page(accounts, F.concat_ws(" ", F.coalesce("bank", F.lit("Bank")), "account_number"), "account")
    year = F.struct(F.col("assessment_year").alias("year"), F.concat(F.coalesce("form", F.lit("ITR")), F.lit(" AY "), F.col("assessment_year")).alias("return"))
    filed = by_page(returns.where("assessment_year is not null"), year, "filed")
    d = chunks.join(account, ["doc_id", "page_start"], "left").join(filed, ["doc_id", "page_start"], "left")
    tag = F.coalesce("account", "filed.return")
    return d.select(*(F.col(c) for c in chunks.columns), "account", "filed.year", "filed.return", F.coalesce(F.concat(F.lit("["), tag, F.lit("] ")), F.lit("")).alias("prefix"))


def kinds_with_fallback(kinds: DataFrame, results: DataFrame) -> DataFrame:
    """D3: doc_id, kind, n: pages of each kind, and as kind ``fallback`` those that were read a second time."""
    again = results.select("doc_id", F.explode("fallback").alias("page")).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n")).unionByName(again.select("doc_id", F.lit("fallback").alias("kind"), "n"))


def reports(skipped: DataFrame, done: DataFrame) -> DataFrame:
    """One report of what was skipped and what was worked on; columns one side lacks are null there."""
    return skipped.unionByName(done, allowMissingColumns=True)


def throughput(report: DataFrame, seconds: float) -> DataFrame:
    """Failed files, whether all failed, pages, and pages a second (null for no time)."""
    return report.agg(
        F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.every(F.col("status") == "failed"), F.lit(False)).alias("all_failed"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"),
    ).withColumn("pages_per_second", F.col("pages") / F.lit(seconds) if seconds > 0 else F.lit(None).cast("double"))
