"""Queries of pages rebuilt from words, with the SQL that checks them. Words are the cells of statement rows set out on
a page: money stands at the right edge of its column, all else at the left edge, a line every twelve points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlode.operators import layout
from paperlode.tables import table

#: Points from one line to the next, and of a column's width.
LINE, WIDTH = 12.0, 100.0


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of statements, each line once: doc_id, page_no, line_no, cells."""
    lines = table(spark, d, "doc_lines", "doc_id", "line_no", "page", "cells", "doc_type").where("doc_type = 'bank_statement' and cells is not null and page is not null and line_no is not null")
    return lines.groupBy("doc_id", F.col("page").alias("page_no"), "line_no").agg(F.min("cells").alias("cells"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """The cells that are not blank as words."""
    cells = _rows(spark, d).select("doc_id", "page_no", "line_no", F.posexplode("cells").alias("c", "text")).where("trim(text) <> ''")
    left, right = F.col("c") * WIDTH, (F.col("c") + 1) * WIDTH - 10
    money = F.col("text").rlike(r"^[(-]?[\d,]+\.\d{2}\)?(?: ?[CcDd]r)?$|(?i)^(debit|credit|balance|dr|cr|withdrawal|deposit|closing)")
    return cells.select(
        "doc_id", "page_no", "line_no", "c", "text", F.when(money, right - 60).otherwise(left).alias("x0"), F.when(money, right).otherwise(left + 60).alias("x1"),
        (F.col("line_no") * LINE + F.col("c") * 0.1).alias("top"), (F.col("line_no") * LINE + 8).alias("bottom"),
    )


def line_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The words of every page as lines."""
    w = _words(spark, d).withColumnRenamed("line_no", "printed")
    return layout.line_numbers(w).select("doc_id", "page_no", "printed", "c", "line_no")


def unruled_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of pages without rules."""
    return layout.unruled_tables(_words(spark, d))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables in threes as one ruled row, for threes of one width and with a first cell each."""
    order = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    three = _rows(spark, d).withColumn("g", F.floor((F.row_number().over(order) - 1) / 3))
    r = three.groupBy("doc_id", "page_no", "g").agg(F.array_sort(F.collect_list(F.struct("line_no", "cells"))).alias("r"))
    whole = r.where((F.size("r") == 3) & (F.size(F.array_distinct(F.transform("r", lambda x: F.size(x["cells"])))) == 1) & F.forall("r", lambda x: F.coalesce(F.trim(x["cells"][0]), F.lit("")) != ""))
    line = lambda i: F.filter(F.transform("r", lambda x: F.struct((x["line_no"] * LINE).cast("double").alias("top"), F.coalesce(F.get(x["cells"], i), F.lit("")).alias("text"))), lambda x: x["text"] != "")
    return whole.select("doc_id", "page_no", "g", F.transform(F.sequence(F.lit(0), F.size(F.col("r")[0]["cells"]) - 1), line).alias("row"))


def merged_rows_split(spark: SparkSession, d: str) -> DataFrame:
    """K2, K3: ruled rows that hold several records, as one row each."""
    split = _merged(spark, d).withColumn("rows", layout.split_row(F.col("row"))).where("rows is not null")
    return split.select("doc_id", "page_no", "g", F.posexplode("rows").alias("n", "cells")).select("doc_id", "page_no", "g", "n", F.array_join("cells", "\x1f").alias("cells"))


def pages_extracted(spark: SparkSession, d: str) -> DataFrame:
    """K7, K8: the text of every page of statements, its table read from words where it looks like one."""
    w = _words(spark, d)
    lines = w.groupBy("doc_id", "page_no", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
    ).withColumns({"size": F.lit(10.0), "bold": F.lit(0.0)})
    none = spark.createDataFrame([], "doc_id string, page_no int, x0 double, x1 double, top double, bottom double, rows array<array<array<struct<top:double,text:string>>>>")
    return layout.extract_pages(w, lines, none)


_ROWS = "r AS (SELECT doc_id, page AS page_no, line_no, min(cells) AS cells FROM doc_lines WHERE doc_type = 'bank_statement' AND cells IS NOT NULL AND page IS NOT NULL AND line_no IS NOT NULL GROUP BY 1, 2, 3)"

QUERIES = {f.__name__: f for f in (line_clusters, unruled_tables, merged_rows_split, pages_extracted)}
ORACLES = {
    "line_clusters": f"WITH {_ROWS}, w AS (SELECT doc_id, page_no, line_no AS printed, i - 1 AS c FROM r, range(1, 100) t(i) WHERE i <= len(cells) AND trim(cells[i]) <> '') SELECT doc_id, page_no, printed, CAST(c AS INTEGER) AS c, CAST(dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY printed) - 1 AS INTEGER) AS line_no FROM w",
    "merged_rows_split": f"WITH {_ROWS}, t AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1) // 3 AS g, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1) % 3 AS n FROM r), "
    "k AS (SELECT doc_id, page_no, g FROM t GROUP BY 1, 2, 3 HAVING count(*) = 3 AND min(len(cells)) = max(len(cells)) AND bool_and(coalesce(trim(cells[1]), '') <> '')), "
    "u AS (SELECT t.doc_id, t.page_no, t.g, t.n, i, coalesce(t.cells[i], '') AS x FROM t JOIN k USING (doc_id, page_no, g), range(1, 100) s(i) WHERE i <= len(t.cells)), "
    "m AS (SELECT doc_id, page_no, g FROM (SELECT doc_id, page_no, g, i FROM u GROUP BY 1, 2, 3, 4 HAVING count_if(x <> '') > 1) GROUP BY 1, 2, 3 HAVING count(*) >= 2) "
    "SELECT doc_id, page_no, g, CAST(n AS INTEGER) AS n, string_agg(x, chr(31) ORDER BY i) AS cells FROM u JOIN m USING (doc_id, page_no, g) GROUP BY doc_id, page_no, g, n",
}
