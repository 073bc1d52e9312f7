"""Oversized texts cut into overlapping pieces at natural boundaries, by ranges.

A text of more than ``RANGE`` characters is handled in ranges with halos. One pass over its bytes deals them out to the
workers, which count the cost of every range; letter runs over a range's edge are stitched, and a prefix sum over the
counts alone gives each range the cost before it. The cuts of a text of cost ``total`` are spread evenly: the i-th lies
in the cost window ``(i * step - slack, i * step]``, at the best boundary there (page or paragraph, line, sentence,
word), so that every range finds its cuts alone, and what two ranges found for one window is stitched. Pieces are
emitted by offset from the ranges they touch.
"""

from __future__ import annotations

import bisect
import codecs
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.session import checkpoint

#: Characters of a range, and of its halo on either side (the left one must hold the overlap).
RANGE, HALO = 32_768, 2_048
#: Limits of the cost of a piece, for texts and for texts with a table; the most two pieces share; the cost window.
LIMIT, TABLE_LIMIT, OVERLAP, SLACK = 700, 1_800, 60, 180

#: One match is one unit of cost: up to four letters of a run, or any other character that is not white space.
UNIT = r"[A-Za-z]{1,4}|[^A-Za-z\s\u0085   -     　]"
_UNIT = re.compile(UNIT)
_MARK = r"<!-- page: (\d+) -->"
_SENTENCE_END = re.compile(r"[.!?।;]['\")\]]*$")


def _edge(text: Column, at: int | Column, count: int | Column) -> Column:
    return F.substr(text, F.lit(at) if isinstance(at, int) else at, F.lit(count) if isinstance(count, int) else count)


def _slice(size: int, halo: int):
    """The ranges of each text, dealt out in one pass over its bytes: no text is decoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                one = b.slice(row, 1)
                data = memoryview(one.column(2).cast(pa.large_binary())[0].as_buffer())
                decoder, at, held, base, no = codecs.getincrementaldecoder("utf-8")("replace"), 0, "", 0, 0
                while True:
                    # held begins at character base: the left halo of range no, the range and its right halo
                    while at < len(data) and base + len(held) < (no + 1) * size + halo:
                        held += decoder.decode(data[at : at + 4 * size], at + 4 * size >= len(data))
                        at += 4 * size
                    start = no * size
                    if start >= base + len(held):
                        break
                    left = min(start, halo)
                    body = held[start - left - base : start + size + halo - base]
                    own = min(size, base + len(held) - start)
                    yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), *(pa.array([x], t) for x, t in ((no, pa.int32()), (start, pa.int64()), (left, pa.int32()), (own, pa.int32()), (body, pa.string()))), *one.columns[3:]], schema=_SLICES)
                    no += 1
                    cut = max(0, no * size - halo - base)
                    held, base = held[cut:], base + cut

    return run


_SLICES = pa.schema([
    ("chunk_id", pa.string()), ("digest", pa.int64()), ("no", pa.int32()), ("start", pa.int64()), ("halo_left", pa.int32()), ("own", pa.int32()), ("body", pa.string()),
    ("has_table", pa.bool_()), ("heading_path", pa.list_(pa.string())), ("page_start", pa.int32()), ("page_end", pa.int32()),
])
_SLICED = "chunk_id string, digest bigint, no int, start bigint, halo_left int, own int, body string, has_table boolean, heading_path array<string>, page_start int, page_end int"
_KEY = ("chunk_id", "digest", "no")


def _sliced(chunks: DataFrame, size: int, halo: int) -> DataFrame:
    """The ranges of texts of more than ``size`` characters with their bodies, dealt out over all workers; copies once."""
    d = chunks.where(F.length("text") > size).select("chunk_id", "digest", "text", "has_table", "heading_path", "page_start", "page_end")
    return d.mapInArrow(_slice(size, halo), _SLICED).repartition(*_KEY).dropDuplicates(list(_KEY))


def _counted(d: DataFrame) -> DataFrame:
    """The ranges (without bodies) with their costs stitched and summed, windows over counts alone."""
    core = _edge(F.col("body"), F.col("halo_left") + 1, F.col("own"))
    d = d.select(
        *_KEY, "start", "own", "has_table", "page_start", F.regexp_count(core, F.lit(UNIT)).alias("counted"),
        F.length(F.regexp_extract(core, r"^[A-Za-z]*", 0)).alias("lead"), F.length(F.regexp_extract(core, r"[A-Za-z]*\z", 0)).alias("trail"),
        # marks count where they end, so that one over an edge belongs to the range that holds its end
        F.try_element_at(F.regexp_extract_all(_edge(F.col("body"), F.greatest(F.col("halo_left") - 32, F.lit(0)) + 1, F.least(F.col("halo_left"), F.lit(32)) + F.length(core)), F.lit(_MARK), 1), F.lit(-1)).cast("int").alias("mark"),
    )
    by = Window.partitionBy("chunk_id", "digest").orderBy("no")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("all", F.col("lead") == F.col("own"))
    # ranges that are one run of letters hand the run on: an island of them ends at each range that is not
    d = d.withColumn("island", F.coalesce(F.sum(F.when(F.col("all"), 0).otherwise(1)).over(before), F.lit(0)))
    inside = Window.partitionBy("chunk_id", "digest", "island").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.when(F.col("all"), F.col("own")).otherwise(0)).over(inside), F.lit(0))
    first = F.coalesce(F.last(F.when(~F.col("all"), F.col("trail")), ignorenulls=True).over(before), F.lit(0))
    d = d.withColumn("phase", F.when(F.col("lead") > 0, first + run).otherwise(0).cast("bigint"))
    up = lambda c: F.ceil(c / 4)
    stitched = F.col("counted") + up(F.col("phase") + F.col("lead")) - up(F.col("phase")) - up(F.col("lead"))
    d = d.withColumn("cost", stitched.cast("bigint"))
    d = d.withColumn("before", F.coalesce(F.sum("cost").over(before), F.lit(0)))
    d = d.withColumn("page", F.coalesce(F.last("mark", ignorenulls=True).over(before), "page_start"))
    return d.withColumn("total", F.sum("cost").over(Window.partitionBy("chunk_id", "digest")))


def ranges(chunks: DataFrame, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """The ranges of every text with their costs: chunk_id, digest (of the text), no, start (offset of the range), own
    (its length), cost, before (cost of the text before it), total, phase (letters of a run already begun before it),
    page (the page in force at its start, null where none is known), has_table.

    Texts of one range are counted where they lie, row by row; copies of a text stay then.
    """
    d = chunks if "digest" in chunks.columns else _chunks(chunks)
    whole = d.where(F.length("text") <= size).select(
        "chunk_id", "digest", F.lit(0).alias("no"), F.lit(0).cast("bigint").alias("start"), F.length("text").alias("own"), F.regexp_count("text", F.lit(UNIT)).cast("bigint").alias("cost"),
        F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("phase"), F.col("page_start").alias("page"), "has_table",
    )
    parts = _counted(_sliced(d, size, halo)).select(*(c for c in whole.columns), "total")
    return whole.withColumn("total", F.col("cost")).unionByName(parts)


def grid(total: int, limit: int, overlap: int = OVERLAP, slack: int = SLACK) -> tuple[int, float]:
    """Number of cuts of a text of that cost, and the cost from one to the next."""
    slack = min(slack, (limit - overlap) // 3)
    step = limit - overlap - slack
    cuts = max(1, math.ceil(total / step) - 1)
    return cuts, total / (cuts + 1)


def cuts_in(body: str, halo_left: int, own: int, before: int, phase: int, total: int, limit: int, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int, int, int, int]]:
    """The cuts a range finds: (number, rank of its boundary, offset in the body, start of the overlap, shared cost).

    A boundary stands after a unit; its rank is 4 before a page mark, heading or blank line, 3 at a line's end, 2 at
    a sentence's, 1 at a word's and 0 elsewhere. The overlap starts at the earliest boundary of rank 1 or more of
    which no more than ``overlap`` lies before the cut, at the cut itself if there is none.
    """
    slack = min(slack, (limit - overlap) // 3)
    cuts, step = grid(total, limit, overlap, slack)
    # units of the body: where each ends and what the text costs up to there
    run = phase % 4 if halo_left else 0  # letters of the first unit already counted before the range
    at = halo_left
    if halo_left and run:
        m = re.compile(r"[A-Za-z]{1,%d}" % (4 - run)).match(body, at)
        if m:
            at = m.end()
    ends = [m.end() for m in _UNIT.finditer(body, at)]
    every = [m.end() for m in _UNIT.finditer(body, 0, at)] + ends
    base = before  # the unit begun before the range is counted there
    edge = halo_left + own
    found = []
    low = before
    for i in range(max(1, math.ceil(low / step)), cuts + 1):
        top = i * step
        if top - slack > low + bisect.bisect_right(ends, edge):
            break
        first, last = math.floor(top - slack) + 1, math.floor(top)  # costs at which the cut may lie
        best = None
        for cost in range(last, first - 1, -1):
            k = cost - base - 1
            if not 0 <= k < len(ends) or ends[k] > edge:
                continue
            end = ends[k]
            gap_end = ends[k + 1] if k + 1 < len(ends) else len(body)
            gap = body[end:gap_end]
            blank = gap[: len(gap) - len(gap.lstrip())]
            following = body[end + len(blank) : end + len(blank) + 5]
            if blank.count("\n") > 1 or ("\n" in blank and following[:1] == "#") or (blank and following == "<!-- "):
                rank = 4
            elif "\n" in blank:
                rank = 3
            elif blank:
                rank = 2 if _SENTENCE_END.search(body[max(0, end - 4) : end]) else 1
            else:
                rank = 0
            if rank == 0 and body[end - 1 : end].isalpha() and body[end : end + 1].isalpha() and best is not None:
                continue
            if best is None or rank > best[0]:
                best = (rank, end + len(blank), k)
                if rank == 4:
                    break
        if best is None:
            continue
        rank, cut, k = best
        start, shared = cut, 0
        here = bisect.bisect_left(every, ends[k])  # units before the cut, from the left halo on
        for s in range(max(0, here - overlap), here):
            gap = body[every[s] : every[s + 1]]
            if gap[:1].isspace():
                start, shared = every[s] + len(gap) - len(gap.lstrip()), here - s
                break
        if start >= cut:
            start, shared = cut, 0
        found.append((i, rank, cut, start, shared))
    return found


_CUTS = pa.schema([("chunk_id", pa.string()), ("i", pa.int64()), ("rank", pa.int32()), ("cut", pa.int64()), ("start", pa.int64()), ("shared", pa.int32())])


def _find(limits: tuple[int, int], overlap: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in _CUTS}
            for r in b.to_pylist():
                shift = r["start"] - r["halo_left"]
                for i, rank, cut, start, shared in cuts_in(r["body"], r["halo_left"], r["own"], r["before"], r["phase"], r["total"], limits[1] if r["has_table"] else limits[0], overlap, slack):
                    for name, value in (("chunk_id", r["chunk_id"]), ("i", i), ("rank", rank), ("cut", cut + shift), ("start", start + shift), ("shared", shared)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_CUTS)

    return run


def costs(chunks: DataFrame) -> DataFrame:
    """chunk_id, total cost and limit of every distinct chunk, the dearest of its texts; null and blank texts cost
    nothing."""
    return ranges(chunks).groupBy("chunk_id").agg(F.max("total").alias("total"), F.max(_limit()).alias("limit"))


def _limit(limits: tuple[int, int] = (LIMIT, TABLE_LIMIT)) -> Column:
    return F.when(F.coalesce("has_table", F.lit(False)), limits[1]).otherwise(limits[0])


def _chunks(chunks: DataFrame) -> DataFrame:
    """The columns used here, with a digest of the text; rows without id or text are left out."""
    d = chunks.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
    return d.select("chunk_id", "text", "heading_path", "page_start", "page_end", "has_table", F.xxhash64("text", F.coalesce("has_table", F.lit(False))).alias("digest"))


def oversized(chunks: DataFrame, limits: tuple[int, int] = (LIMIT, TABLE_LIMIT)) -> DataFrame:
    """The ranges of texts over their limit. A text costs no more than its length, so shorter ones are not counted."""
    d = _chunks(chunks)
    return ranges(d.where(F.length("text") > _limit(limits))).where(F.col("total") > _limit(limits))


def _bodies(chunks: DataFrame, limits: tuple[int, int]) -> DataFrame:
    """The ranges of texts over their limit with bodies and halos, each once: those of one range straight from their
    rows, the others joined to their counts by range. Of several texts of one chunk_id the longest is cut."""
    size, halo = ranges.__defaults__
    d = _chunks(chunks).where(F.length("text") > _limit(limits))
    kept = ["chunk_id", "digest", "no", "start", "own", "before", "phase", "total", "page", "halo_left", "body", "has_table", "heading_path", "page_start", "page_end"]
    zero = F.lit(0).cast("bigint")
    whole = (
        d.where(F.length("text") <= size)
        .select(
            "chunk_id", "digest", F.lit(0).alias("no"), zero.alias("start"), F.length("text").alias("own"), zero.alias("before"), zero.alias("phase"), F.regexp_count("text", F.lit(UNIT)).cast("bigint").alias("total"),
            F.col("page_start").alias("page"), F.lit(0).alias("halo_left"), F.col("text").alias("body"), "has_table", "heading_path", "page_start", "page_end",
        )
        .where(F.col("total") > _limit(limits)).dropDuplicates(["chunk_id", "digest"])
    )
    sliced = _sliced(d, size, halo)
    counts = _counted(sliced).where(F.col("total") > _limit(limits)).select(*_KEY, "before", "phase", "total", "page")
    both = whole.unionByName(sliced.join(counts.hint("merge"), list(_KEY)).select(*kept))
    both = checkpoint(both)
    chosen = both.groupBy("chunk_id", "digest").agg(F.sum("own").alias("n")).groupBy("chunk_id").agg(F.max(F.struct("n", "digest")).alias("x")).select("chunk_id", F.col("x.digest").alias("digest"))
    return both.join(chosen.hint("merge"), ["chunk_id", "digest"]).drop("digest")


def pieces(chunks: DataFrame, limits: tuple[int, int] = (LIMIT, TABLE_LIMIT), overlap: int = OVERLAP, slack: int = SLACK) -> DataFrame:
    """The pieces of every text over its limit.

    Out: chunk_id, piece_no (from 0), char_start, char_end, text, overlap_tokens (shared with the piece before),
    heading_path, page_start, page_end. Pieces cost no more than the limit, cover the text in order, and consecutive
    ones share at most ``overlap``. Pages follow the ``<!-- page: N -->`` marks inside a text; before the first they
    are the chunk's own (null if that is null). Null and blank texts and those within the limit give no pieces;
    copies of a chunk count once, of several texts of one chunk_id the longest is cut; a null has_table is false.
    """
    big = checkpoint(_bodies(chunks, limits))
    found = big.select("chunk_id", "start", "halo_left", "body", "own", "before", "phase", "total", F.coalesce("has_table", F.lit(False)).alias("has_table")).mapInArrow(
        _find(limits, overlap, slack), "chunk_id string, i bigint, rank int, cut bigint, start bigint, shared int"
    )
    cuts = found.groupBy("chunk_id", "i").agg(F.max(F.struct("rank", "cut", "start", "shared")).alias("c")).select("chunk_id", "i", "c.*")
    whole = big.groupBy("chunk_id").agg(F.max(F.col("start") + F.col("own")).alias("length"))
    starts = cuts.select("chunk_id", "i", F.col("start").alias("char_start"), F.col("cut").alias("at"), F.col("shared").alias("overlap_tokens")).unionByName(
        whole.select("chunk_id", F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("char_start"), F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("overlap_tokens"))
    )
    spans = (
        starts.withColumn("char_end", F.lead("at").over(Window.partitionBy("chunk_id").orderBy("i")))
        .join(whole, "chunk_id")
        .select("chunk_id", (F.row_number().over(Window.partitionBy("chunk_id").orderBy("i")) - 1).alias("piece_no"), "char_start", F.coalesce("char_end", "length").alias("char_end"), "overlap_tokens")
    )
    touched = spans.withColumn("no", F.explode(F.sequence(F.floor(F.col("char_start") / RANGE).cast("int"), F.floor((F.col("char_end") - 1) / RANGE).cast("int"))))
    core = big.select("chunk_id", "no", "start", "own", "page", "page_start", "page_end", "heading_path", F.substr("body", F.col("halo_left") + 1, F.col("own")).alias("core"), F.substr("body", F.lit(1), F.col("halo_left") + F.col("own")).alias("upto"), "halo_left")
    j = touched.join(core, ["chunk_id", "no"])
    lo, hi = F.greatest(F.col("char_start") - F.col("start"), F.lit(0)).cast("int"), F.least(F.col("char_end") - F.col("start"), F.col("own")).cast("int")
    # the page in force at an offset of a range: that of the last mark that begins at or before it
    def page_at(offset: Column) -> Column:
        seen = F.substr("upto", F.greatest(F.col("halo_left") - 32, F.lit(0)) + 1, F.least(F.col("halo_left"), F.lit(32)) + offset)
        return F.coalesce(F.try_element_at(F.regexp_extract_all(seen, F.lit(_MARK), 1), F.lit(-1)).cast("int"), F.col("page"))

    fragment = F.struct("no", F.substr("core", lo + 1, hi - lo).alias("s"), page_at(F.least(lo + 24, hi)).alias("p0"), page_at(lo).alias("p00"), page_at(hi).alias("p1"))
    out = j.groupBy("chunk_id", "piece_no").agg(
        F.first("char_start").alias("char_start"), F.first("char_end").alias("char_end"), F.first("overlap_tokens").alias("overlap_tokens"),
        F.array_sort(F.collect_list(fragment)).alias("f"), F.first("heading_path").alias("heading_path"), F.first("page_end").alias("chunk_end"),
    )
    begins_with_mark = F.col("text").rlike(r"^\s*<!-- page: \d+ -->")
    return out.withColumn("text", F.array_join(F.transform("f", lambda x: x["s"]), "")).select(
        "chunk_id", "piece_no", "char_start", "char_end", "text", "overlap_tokens", "heading_path",
        F.when(begins_with_mark, F.regexp_extract("text", _MARK, 1).cast("int")).otherwise(F.col("f")[0]["p00"]).alias("page_start"),
        F.element_at("f", -1)["p1"].alias("page_end"),
    )
