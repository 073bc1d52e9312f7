"""Transaction rows with the header that governs them.

``lines -> rows`` is a forward fill of the last header inside a document. One document may hold a third of all
lines, so the fill runs over blocks of ``BLOCK`` line numbers: each block fills itself, and takes its first header
from the last header of the blocks before it, which is a window over one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Line numbers per block: the most lines a task must hold in order.
BLOCK = 4096


def _first(cells: Column, test) -> Column:
    """0-based index of the first cell that passes, or -1."""
    return F.array_position(F.transform(cells, lambda c: F.coalesce(test(c), F.lit(False))), True).cast("int") - 1


def _dated(c: Column) -> Column:
    return c.contains("Date")


def _balance(c: Column) -> Column:
    return F.lower(c).contains("balance")


#: Joins the cells of a row in ``record``; in no cell (control characters are blanked).
UNIT = "\x1f"


def record(cells: Column) -> Column:
    """The cells as one text, null cells blank, line breaks and the joining mark blanked."""
    joined = F.array_join(cells, UNIT, "")
    # cells that hold the mark themselves are rare, so the costlier way is taken only for them
    clash = F.length(joined) - F.length(F.replace(joined, F.lit(UNIT))) != F.size(cells) - 1
    safe = F.when(clash & (F.size(cells) > 0), F.array_join(F.transform(cells, lambda c: F.translate(c, UNIT, " ")), UNIT, "")).otherwise(joined)
    return F.translate(safe, "\n\r\x1e\x00", "    ")


def layout(cells: Column) -> Column:
    """Width of the header and 0-based places of its date, debit, credit, balance and text cells (-1 where absent)."""
    return F.struct(
        F.size(cells).alias("width"),
        _first(cells, _dated).alias("date_at"),
        _first(cells, lambda c: c.rlike(r"(?i)^\s*(debit|withdrawal|dr\b)")).alias("debit_at"),
        _first(cells, lambda c: c.rlike(r"(?i)^\s*(credit|deposit|cr\b)")).alias("credit_at"),
        _first(cells, _balance).alias("balance_at"),
        _first(cells, lambda c: c.rlike(r"(?i)narration|particulars|description|details|remarks")).alias("text_at"),
    )


def block_of(line_no: Column) -> Column:
    """The block of a line number; a null one is in block 0."""
    return F.coalesce(F.floor(line_no / BLOCK).cast("int"), F.lit(0))


def order_shown(text: Column, before: str = "") -> Column:
    """The numeric order (dmy, mdy) that a date at the beginning of a text (or after the mark ``before``) can only be
    in, as one of its first two numbers is no month; null for all other texts."""
    at = rf"(?:^|{before})" if before else "^"
    day_first, month_first = rf"{at}\W*(?:1[3-9]|2\d|3[01])([-/.])(?:0?[1-9]|1[0-2])\1\d\d", rf"{at}\W*(?:0?[1-9]|1[0-2])([-/.])(?:1[3-9]|2\d|3[01])\1\d\d"
    return F.when(text.rlike(day_first), "dmy").when(text.rlike(month_first), "mdy")


def carried_order(marks: DataFrame) -> DataFrame:
    """The numeric order last shown before a block of a document: doc_id, block, entry, from (doc_id, block, line_no,
    shown); one row a block, where one is known."""
    last = marks.groupBy("doc_id", "block").agg(F.max(F.when(F.col("shown").isNotNull(), F.struct("line_no", "shown"))).alias("m"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("doc_id", "block", F.last("m.shown", ignorenulls=True).over(before).alias("entry")).where("entry is not null")


def transaction_rows(lines: DataFrame) -> DataFrame:
    """Each distinct transaction row of bank statements with its header's layout.

    In: doc_id, line_no, cells, source, doc_type, loaded_at; further columns are ignored. Out: doc_id, block,
    line_no, source, record, head (null if no header stands before the row), entry (the numeric order of dates last
    shown before the block, null if none is), in order of (doc_id, block, line_no) within partitions. Copies of a line (same doc_id and line_no) count once, the first loaded stays. Rows without
    doc_id, line_no or cells are no transaction rows; a null cell is blank. A header row names a date and a balance
    column. An empty table gives no rows.
    """
    statement = lines.where((F.col("doc_type") == "bank_statement") & F.col("doc_id").isNotNull() & F.col("line_no").isNotNull())
    block = F.floor(F.col("line_no") / BLOCK).cast("int").alias("block")
    headed = F.col("record").contains("Date") & F.lower("record").contains("balance")
    rows = (
        statement.where(F.col("cells").isNotNull())
        .select("doc_id", block, "line_no", "source", "cells", "loaded_at", record(F.col("cells")).alias("record"))
        .withColumn("own", F.when(headed, layout(F.col("cells"))))
        .drop("cells")
    )
    by_block = Window.partitionBy("doc_id", "block").orderBy("line_no", "loaded_at")
    filled = (
        rows.withColumn("before", F.lag("line_no").over(by_block))
        .withColumn("head", F.last("own", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("before").isNull() | (F.col("before") != F.col("line_no"))) & F.col("own").isNull())
        .drop("before", "own", "loaded_at")
    )
    # One row per block after a document's first, and one per block that has headers: what each block begins with.
    later = statement.where((F.col("line_no") >= BLOCK) | (F.col("line_no") < 0)).select("doc_id", block).distinct()
    marks = rows.select("doc_id", "block", "line_no", "own", order_shown(F.col("record"), UNIT).alias("shown")).where("own is not null or shown is not null")
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("line_no", c)))
    heads = marks.groupBy("doc_id", "block").agg(latest("own").alias("o"), latest("shown").alias("s")).select("doc_id", "block", F.col("o.own").alias("last"), F.col("s.shown").alias("shown"))
    edge = Window.partitionBy("doc_id").orderBy("block", "is_head").rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        heads.withColumn("is_head", F.lit(1))
        .unionByName(later.withColumn("is_head", F.lit(0)), allowMissingColumns=True)
        .withColumn("carried", F.last("last", ignorenulls=True).over(edge))
        .withColumn("entry", F.last("shown", ignorenulls=True).over(edge))
        .where((F.col("is_head") == 0) & (F.col("carried").isNotNull() | F.col("entry").isNotNull()))
        .select("doc_id", "block", "carried", "entry")
    )
    return (
        filled.join(carried, ["doc_id", "block"], "left")
        .select("doc_id", "block", "line_no", "source", "record", F.coalesce("head", "carried").alias("head"), "entry")
        .sortWithinPartitions("doc_id", "block", "line_no")
    )
