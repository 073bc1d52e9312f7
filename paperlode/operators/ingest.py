"""From files and pages to work: discovery, content ids, triage, runs, shards and what is new."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.functions.scalars import garbage_ratio, page_kind

# Suffixes of documents that can be read.
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def content_id(content: Column) -> Column:
    """A2: the first 24 hexadecimal digits of the SHA-256 of the bytes."""
    return F.substring(F.sha2(content, 256), 1, 24)


def fingerprint(**settings: object) -> str:
    """Twelve digits that change with any setting of the parser."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:12]


def duplicates(files: DataFrame, key: str = "doc_id", order: str = "pos", name: str = "name") -> DataFrame:
    """Files with ``status`` (new or skipped) and, for repeated content, the first file it repeats."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.first(name).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = files.withColumn("n", F.row_number().over(w))
    return d.withColumn("status", F.when(F.col("n") == 1, "new").otherwise("skipped")).withColumn("error", F.when(F.col("n") > 1, F.concat(F.lit("duplicate of "), first))).drop("n")


def page_stats(pages: DataFrame) -> DataFrame:
    """Characters without white space and garbage ratio of each page's text."""
    t = F.coalesce("md", F.lit(""))
    return pages.withColumn("text_chars", F.length(F.regexp_replace(t, r"(?U)\s+", ""))).withColumn("garbage_ratio", garbage_ratio(t))


def image_coverage(images: DataFrame, area: Column, background: int = 100) -> DataFrame:
    """Share of each page under images, at most 1; images with ``background`` characters over them do not count."""
    size = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    counted = F.sum(F.when(F.col("overlaid_chars") < background, size).otherwise(0.0))
    return images.groupBy("doc_id", "page_no").agg(F.least(counted / F.greatest(F.max(area), F.lit(1.0)), F.lit(1.0)).alias("image_coverage"))


def triage(stats: DataFrame) -> DataFrame:
    """B1: the kind of every page."""
    return stats.withColumn("kind", page_kind("text_chars", "garbage_ratio", "image_coverage"))


def page_runs(pages: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Runs of consecutive pages: first and last. A page counts once."""
    w = Window.partitionBy(doc).orderBy(page)
    d = pages.select(doc, page).distinct().withColumn("island", F.col(page) - F.row_number().over(w))
    return d.groupBy(doc, "island").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("island")


def plan_shards(kinds: DataFrame, max_pages: int = 24, workers: int = 4, min_pages: int = 4) -> DataFrame:
    """Shards (kind, start, end) of every document's pages (doc_id, page_no, kind).

    Runs of one kind are cut evenly. A shard has at most ``max_pages`` pages, or a worker's even share if that is less
    (though at least ``min_pages``); runs that need recognition are spread over all workers, two pages each or more.
    """
    w = Window.partitionBy("doc_id").orderBy("page_no")
    new = F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(1))
    d = kinds.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = kinds.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    runs = d.groupBy("doc_id", "run", "kind").agg(F.min("page_no").alias("first"), F.count(F.lit(1)).cast("int").alias("length")).join(total, "doc_id")
    most = F.lit(max_pages) if max_pages > 0 else F.col("total")
    limit = F.least(most, F.greatest(F.lit(min_pages), F.ceil(F.col("total") / workers))) if workers > 1 else most
    even = F.ceil(F.col("length") / limit)
    if workers > 1:
        spread_out = F.greatest(even, F.least(F.lit(workers), F.greatest(F.floor(F.col("length") / 2), F.lit(1))))
        n = F.when(F.col("kind") != "digital", spread_out).otherwise(F.greatest(F.lit(1), F.least(even, F.floor(F.col("length") / min_pages))))
    else:
        n = even
    cut = runs.withColumn("n", n.cast("int")).withColumn("base", F.floor(F.col("length") / F.col("n")).cast("int")).withColumn("extra", (F.col("length") % F.col("n")).cast("int"))
    j = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.col("first") + F.col("j") * F.col("base") + F.least("j", "extra")
    size = F.col("base") + F.when(F.col("j") < F.col("extra"), 1).otherwise(0)
    return j.select("doc_id", "kind", start.cast("int").alias("start"), (start + size - 1).cast("int").alias("end"))


def schedule(shards: DataFrame) -> DataFrame:
    """L4: shards with their cost (pages, times 8 for scanned, 4 for hybrid), dearest first."""
    weight = F.when(F.col("kind") == "scanned", 8).when(F.col("kind") == "hybrid", 4).otherwise(1)
    return shards.withColumn("cost", (F.col("end") - F.col("start") + 1) * weight).orderBy(F.desc("cost"), "doc_id", "start")


def new_documents(found: DataFrame, indexed: DataFrame, key: str = "doc_id") -> DataFrame:
    """C4: documents that are not indexed."""
    return found.join(indexed.select(key).distinct(), key, "left_anti")


def known_documents(found: DataFrame, indexed: DataFrame, key: str = "doc_id") -> DataFrame:
    """C4: documents that are."""
    return found.join(indexed.select(key).distinct(), key, "left_semi")


def absolute_pages(results: DataFrame) -> DataFrame:
    """Pages of a shard with numbers in the file: kept if all lie in the shard's range, else counted from its start."""
    inside = F.forall("pages", lambda p: p["page_no"].between(F.col("page_start"), F.col("page_end")))
    shifted = F.transform("pages", lambda p: F.struct((p["page_no"] + F.when(inside, 0).otherwise(F.col("page_start") - 1)).alias("page_no"), p["md"].alias("md")))
    return results.where(F.size("pages") > 0).select("doc_id", "shard_no", F.explode(shifted).alias("p")).select("doc_id", "shard_no", "p.page_no", "p.md")


def shard_texts(results: DataFrame, whole: str) -> DataFrame:
    """doc_id, page_no, md of shards; one that came without pages gives its text in column ``whole``, if it has any,
    as its first page."""
    pages = absolute_pages(results).select("doc_id", "page_no", "md")
    rest = results.where((F.coalesce(F.size("pages"), F.lit(0)) <= 0) & (F.length(F.trim(whole)) > 0))
    return pages.unionByName(rest.select("doc_id", F.col("page_start").alias("page_no"), F.col(whole).alias("md")))


def shard_outcome(results: DataFrame) -> DataFrame:
    """Per document failed (no page came), partial (some shard had an error) or done; only done is cached."""
    pages = F.sum(F.when(F.size("pages") > 0, F.size("pages")).otherwise(0))
    errors = F.sort_array(F.collect_set(F.when(F.col("error").isNotNull() & (F.col("error") != ""), F.col("error"))))
    g = results.groupBy("doc_id").agg(pages.alias("pages"), errors.alias("errors"), F.sum(F.size(F.coalesce("fallback", F.array()))).alias("fallback_pages"))
    status = F.when(F.col("pages") == 0, "failed").when(F.size("errors") > 0, "partial").otherwise("done")
    return g.select("doc_id", "pages", "fallback_pages", status.alias("status"), (status == "done").alias("cached"), F.when(status == "partial", F.concat(F.lit("partial: "), F.array_join("errors", "; "))).alias("error"))
