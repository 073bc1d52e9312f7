"""Page text as lines, blocks and chunks.

Lines and blocks are window expressions. Chunk packing is a greedy fold whose every step depends on the one before: it
runs over the ordered blocks of a partition as a chain of generators (``mapInArrow``) that holds one chunk at a time,
so a document may have any number of blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.functions.scalars import est_tokens
from paperlode.session import spread

# The page mark, a heading, and the rule under a table's header.
PAGE_MARK = r"^<!--\s*page:\s*(\d+)\s*-->$"
HEADING = r"^(#{1,6})\s+(.*?)\s*#*$"
TABLE_RULE = r"^\|?(\s*:?-{2,}:?\s*\|)+\s*:?-*:?\s*\|?$"
#: Limits of a chunk's cost: most, least before a heading closes it, most for a table.
MAX_TOKENS, MIN_TOKENS, TABLE_TOKENS = 700, 150, 1000


def assemble(pages: DataFrame) -> DataFrame:
    """The text of each document: pages in order, each behind its mark. Repeated pages keep their longest text."""
    one = pages.where(F.col("md").isNotNull()).groupBy("doc_id", "page_no").agg(F.max(F.struct(F.length("md"), "md")).alias("x")).select("doc_id", "page_no", "x.md")
    part = F.struct("page_no", F.concat(F.lit("<!-- page: "), F.col("page_no").cast("string"), F.lit(" -->\n\n"), F.trim("md")).alias("t"))
    return one.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("markdown"))


def raw_lines(pages: DataFrame) -> DataFrame:
    """Every line of every page: doc_id, page, pos (in the page, from 0), raw. Pages count once, the longest text."""
    one = pages.where(F.col("md").isNotNull()).groupBy("doc_id", "page_no").agg(F.max(F.struct(F.length("md"), "md")).alias("x")).select("doc_id", "page_no", "x.md")
    return one.select("doc_id", F.col("page_no").alias("page"), F.posexplode(F.split("md", r"\r?\n")).alias("pos", "raw"))


def lines(pages: DataFrame) -> DataFrame:
    """G1: doc_id, page, pos, text, cells. Glyph marks become blanks, blanks are evened out; blank lines and rules of
    tables go. A line that begins with a pipe is a row: all outer pipes are stripped before it is cut into cells."""
    s = F.trim(F.regexp_replace(F.regexp_replace("raw", r"\(cid:\d+\)", " "), r"[ \t]+", " "))
    d = raw_lines(pages).withColumn("s", s).where((F.col("s") != "") & ~F.col("s").rlike(TABLE_RULE) & ~F.col("s").rlike(PAGE_MARK))
    cells = F.when(F.col("s").startswith("|"), F.transform(F.split(F.btrim("s", F.lit("|")), r"\|"), F.trim))
    return d.select("doc_id", "page", "pos", F.trim(F.ltrim("s", F.lit("#"))).alias("text"), cells.alias("cells"))


def blocks(pages: DataFrame) -> DataFrame:
    """Headings, tables and paragraphs in order: doc_id, page, block, kind, level, text, tokens.

    A blank line ends a paragraph but no table; a page ends every block.
    """
    stripped = F.trim("raw")
    kind = F.when(stripped == "", "blank").when(stripped.rlike(HEADING), "heading").when(stripped.startswith("|"), "table").otherwise("text")
    order = Window.partitionBy("doc_id", "page").orderBy("pos")
    d = raw_lines(pages).withColumn("kind", kind)
    # a blank line matters only behind text
    d = d.withColumn("held", F.last(F.when(F.col("kind") != "blank", F.col("kind")), ignorenulls=True).over(order)).withColumn("after_blank", F.lag("kind").over(order) == "blank")
    filled = d.where("kind <> 'blank'").withColumn("before", F.lag("kind").over(order))
    new = F.col("before").isNull() | (F.col("kind") != F.col("before")) | (F.col("kind") == "heading") | ((F.col("kind") == "text") & F.coalesce("after_blank", F.lit(False)))
    marked = filled.withColumn("block", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.struct("pos", F.when(F.col("kind") == "heading", F.regexp_extract(stripped, HEADING, 2)).otherwise(F.rtrim("raw")).alias("t"))
    g = marked.groupBy("doc_id", "page", "block", "kind").agg(
        F.max(F.when(F.col("kind") == "heading", F.length(F.regexp_extract(stripped, HEADING, 1))).otherwise(0)).alias("level"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n")).alias("text"),
    )
    return g.withColumn("tokens", est_tokens("text"))


def breadcrumbs(b: DataFrame) -> DataFrame:
    """Blocks with the titles of the headings over them, ``path``; a heading ends those of its level and below."""
    order = Window.partitionBy("doc_id").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, 0)
    d = b.withColumn("at", F.struct("page", "block"))
    heading = F.col("kind") == "heading"
    for k in range(1, 7):
        d = d.withColumn(f"t{k}", F.last(F.when(heading & (F.col("level") == k), F.struct("at", "text")), ignorenulls=True).over(order))
        d = d.withColumn(f"c{k}", F.last(F.when(heading & (F.col("level") < k), F.col("at")), ignorenulls=True).over(order))
    title = lambda k: F.when(F.col(f"t{k}").isNotNull() & (F.col(f"c{k}").isNull() | (F.col(f"t{k}.at") > F.col(f"c{k}"))), F.col(f"t{k}.text"))
    path = F.filter(F.array(*(title(k) for k in range(1, 7))), lambda x: x.isNotNull())
    return d.withColumn("path", path).drop("at", *(f"{p}{k}" for p in "tc" for k in range(1, 7)))


# ---------------------------------------------------------------------------------------------------------------
_UNITS = re.compile(r"[A-Za-z]{1,4}|[^A-Za-z\s]")
_RULE = re.compile(TABLE_RULE)


def cost(text: str) -> int:
    """The estimate of :func:`est_tokens` in Python, for the folds."""
    return len(_UNITS.findall(text))


def fill(prices: Iterable[int], room: int) -> list[int]:
    """Packs of items in order, each as full as ``room`` allows: the number of every item's pack."""
    packs: list[int] = []
    used = 0
    for price in prices:
        used += price
        if packs and used > room:
            packs.append(packs[-1] + 1)
            used = price
        else:
            packs.append(packs[-1] if packs else 0)
    return packs


def _joined(items: list[str], packs: list[int], by: str) -> list[str]:
    return [by.join(x for _, x in g) for _, g in groupby(zip(packs, items, strict=True), key=itemgetter(0))]


def split_table(text: str, limit: int) -> list[str]:
    """Rows packed under the limit, the header (through the first rule of the first four lines) on each."""
    rows = text.split("\n")
    rules = [i for i, r in enumerate(rows[:4], 1) if _RULE.match(r.strip())]
    head, body = rows[: min(rules, default=0)], rows[min(rules, default=0) :]
    packs = fill((cost(r) + 1 for r in body), max(limit - cost("\n".join(head)), 1))
    return ["\n".join([*head, pack]) for pack in _joined(body, packs, "\n")] or ["\n".join(head)]


def split_sentences(text: str, limit: int) -> list[str]:
    """Sentences packed under the limit; one that is longer stays whole."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    return _joined(sentences, fill(map(cost, sentences), limit), " ")


class Piece(NamedTuple):
    """A block, or a part of one that is too large for a chunk with others; then it stands alone."""

    kind: str
    level: int
    page: int
    text: str
    tokens: int
    alone: bool = False
    part: int = 0


Block = tuple[str, str, int, int, int]  # kind, text, page, level, tokens


def _pieces(blocks: Iterable[Block], most: int, table_most: int) -> Iterator[Piece]:
    for kind, text, page, level, tokens in blocks:
        if kind == "heading" or tokens <= most:
            yield Piece(kind, level, page, text, tokens)
        else:
            parts = split_sentences(text, most) if kind == "text" else [text] if tokens <= table_most else split_table(text, table_most)
            for i, t in enumerate(parts):
                yield Piece(kind, level, page, t, cost(t), True, i)


def _numbered(pieces: Iterable[Piece], most: int, least: int, table_most: int) -> Iterator[tuple[int, Piece]]:
    """Every piece with the number of its chunk. A heading begins a chunk where the one before has ``least`` tokens; a
    piece that stands alone begins one and ends it, but a table's first part may follow what leads to it if both fit
    into ``table_most``; any other begins one where it would take the chunk over ``most``."""
    number, held, ended = 0, 0, False
    for p in pieces:
        together = held + p.tokens
        if p.kind == "heading":
            begins = held >= least
        elif p.alone:
            begins = p.kind == "text" or p.part > 0 or together > table_most
        else:
            begins = held > 0 and together > most
        if begins or ended:
            number, together = number + 1, p.tokens
        held, ended = together, p.alone
        yield number, p


def packed(blocks: Iterable[Block], most: int = MAX_TOKENS, least: int = MIN_TOKENS, table_most: int = TABLE_TOKENS) -> Iterator[dict]:
    """The chunks of one document's blocks in order, holding no more than one chunk at a time. A chunk's path
    is that over its first block that is no heading (all parts of a block share one); chunks of headings only are left
    out."""
    index, over = 0, []  # headings over the block at hand: level, title
    shared: list[str] = []
    for _, group in groupby(_numbered(_pieces(blocks, most, table_most), most, least, table_most), key=itemgetter(0)):
        members, path = [], None
        for _, p in group:
            members.append(p)
            if p.kind == "heading":
                over = [*(t for t in over if t[0] < p.level), (p.level, p.text)]
            elif path is None:
                path = shared = shared if p.part else [title for _, title in over]
        if path is None:
            continue
        pages = [p.page for p in members]
        yield {
            "chunk_index": index, "text": "\n\n".join(f"{'#' * p.level} {p.text}" if p.kind == "heading" else p.text for p in members), "heading_path": path,
            "page_start": min(pages), "page_end": max(pages), "has_table": any(p.kind == "table" for p in members),
        }
        index += 1


def pack(parts: list[tuple[str, str, int, int]], most: int = MAX_TOKENS, least: int = MIN_TOKENS, table_most: int = TABLE_TOKENS) -> list[dict]:
    """The chunks of blocks (kind, text, page, level) given as a list."""
    return list(packed(((kind, text, page, level, cost(text)) for kind, text, page, level in parts), most, least, table_most))


_CHUNKS = pa.schema([
    ("doc_id", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("heading_path", pa.list_(pa.string())), ("page_start", pa.int32()), ("page_end", pa.int32()), ("has_table", pa.bool_()),
])
#: Chunks of a batch that goes back.
_BATCH = 500


def _packs(most: int, least: int, table_most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found = ({"doc_id": doc, **c} for doc, own in groupby(rows, key=itemgetter(0)) for c in packed((r[1:] for r in own), most, least, table_most))
        while part := list(islice(found, _BATCH)):
            yield pa.RecordBatch.from_pylist(part, schema=_CHUNKS)

    return run


def chunks(b: DataFrame, most: int = MAX_TOKENS, least: int = MIN_TOKENS, table_most: int = TABLE_TOKENS) -> DataFrame:
    """Chunks of documents from their blocks (see :func:`blocks`): one pass over blocks in document order."""
    ordered = b.where("text <> ''").repartition(spread(b.sparkSession), "doc_id").sortWithinPartitions("doc_id", "page", "block")
    ddl = "doc_id string, chunk_index int, text string, heading_path array<string>, page_start int, page_end int, has_table boolean"
    return ordered.select("doc_id", "kind", "text", "page", "level", "tokens").mapInArrow(_packs(most, least, table_most), ddl)


def embed_text(text: Column, path: Column, has_table: Column) -> Column:
    """What is embedded of a chunk: its breadcrumb, and of a table only the words."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?<![A-Za-z])\d[\d,./:\-]*(?![A-Za-z])|\|+|-{2,}", " "), r"\s+", " "))
    body = F.when(F.coalesce(has_table, F.lit(False)), bare).otherwise(text)
    return F.when(F.size(F.coalesce(path, F.array())) > 0, F.concat(F.lit("["), F.array_join(path, " > "), F.lit("]\n"), body)).otherwise(body)



def pages_of(documents: DataFrame) -> DataFrame:
    """The pages of documents given as one text with page marks: doc_id, page_no, md. A mark holds for all lines up
    to the next; lines before the first are on page 1. White space around a page's text goes, empty pages too."""
    each = documents.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "raw"))
    mark = F.regexp_extract(F.trim("raw"), PAGE_MARK, 1)
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = each.withColumn("mark", F.nullif(mark, F.lit("")).cast("int"))
    d = d.withColumn("page_no", F.coalesce(F.last("mark", ignorenulls=True).over(order), F.lit(1))).where("mark is null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n")
    return d.groupBy("doc_id", "page_no").agg(F.regexp_replace(joined, r"^\s+|\s+\z", "").alias("md")).where("md <> ''")
