"""Dates and times printed in many ways, each as one ISO day or one UTC instant."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.functions.timestamps import choose, ends, folded, norm, readings
from paperlode.operators.rejects import load_statement_rows
from paperlode.operators.statement_rows import order_shown

FOUND = "origin string, doc_id string, item string, side string, norm string"
_SCHEMA = pa.schema([(c, pa.string()) for c in ("origin", "doc_id", "item", "side", "norm")])


#: Records of a source in one chain, on the average; a source of more is cut into as many chains as that takes.
CHAIN = 4096


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one source and chain, over the batches' edges."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["source"], r["chain"]) != (held[0]["source"], held[0]["chain"]):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of every chain, in record order."""
    for rows in _chains(batches):
        sides: list[tuple[dict, str, str]] = []
        for r in rows:
            if r["side"] is None:
                if (two := ends(r["printed"])) is not None:
                    sides += [(r, "start", two[0]), (r, "end", two[1])]
            else:
                sides.append((r, r["side"], r["printed"]))
        picked = choose([folded(readings(v), r["tz"]) for r, _, v in sides], [r["date_order"] for r, _, _ in sides], rows[0]["entry"])
        out: dict[str, list] = {f.name: [] for f in _SCHEMA}
        for (r, side, _), p in zip(sides, picked, strict=True):
            if (text := norm(p, r["tz"])) is not None:
                for name, value in (("origin", r["origin"]), ("doc_id", r["doc_id"]), ("item", r["item"]), ("side", side), ("norm", text)):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)


def read_dates(lines: DataFrame, accounts: DataFrame, returns: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per date read: origin, doc_id, item, side, norm.

    Cells of statement rows come through :func:`load_statement_rows` (rows with a reason are left out); periods of
    accounts and filing dates of returns are read here, in chains of a source's records in order of loading. A source
    of many records is cut into chains by the hash of its documents, each in order, so that no task holds a source.
    Null, blank and non-date values give no row; copies of a record give one; a source that is not listed has zone UTC
    and no numeric order, so that its chains decide.
    """
    cells = load_statement_rows(lines, sources).where("reason is null and norm is not null").select(
        "origin", "doc_id", F.col("line_no").cast("string").alias("item"), F.lit("cell").alias("side"), "norm"
    )
    known = F.broadcast(sources.select("source", "tz", "date_order").dropDuplicates(["source"]))

    def staged(df: DataFrame, origin: str, item: str, printed: str, side: str | None) -> DataFrame:
        return (
            df.where(F.col(printed).isNotNull())
            .groupBy("doc_id", F.col(item).alias("item"), F.col(printed).alias("printed"), "source")
            .agg(F.min("loaded_at").alias("loaded_at"))
            .join(known, "source", "left")
            .select(F.lit(origin).alias("origin"), "doc_id", "item", F.lit(side).cast("string").alias("side"), "printed", "source", "tz", "date_order", "loaded_at")
        )

    printed = staged(accounts, "account", "account_number", "period", None).unionByName(staged(returns, "return", "acknowledgement_number", "date_of_filing", "filed"))
    # what most of a source's dates show is the order in force where each of its chains begins
    shown = order_shown(F.col("printed"))
    counts = printed.groupBy("source").agg(
        F.ceil(F.count(F.lit(1)) / CHAIN).cast("int").alias("chains"),
        F.when(F.count_if(shown == "dmy") > F.count_if(shown == "mdy"), "dmy").when(F.count_if(shown == "dmy") < F.count_if(shown == "mdy"), "mdy").alias("entry"),
    )
    chained = printed.join(counts, printed["source"].eqNullSafe(counts["source"])).drop(counts["source"]).withColumn("chain", F.pmod(F.xxhash64("doc_id"), F.col("chains")))
    read = chained.repartition("source", "chain").sortWithinPartitions("source", "chain", "loaded_at", "doc_id", "item", "printed").mapInArrow(_read, FOUND)
    return cells.unionByName(read).distinct()
