"""Files in and out: discovery, page text, markdown, events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.operators.ingest import SUFFIXES, content_id


def discover(spark: SparkSession, *paths: str) -> DataFrame:
    """A1, A2: readable files under folders, or given directly: path, name, length, mtime, content, doc_id.

    Suffixes count in any case; other files are left out; a path given twice counts once.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(dict.fromkeys(paths)))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return d.where(suffix.isin(*SUFFIXES)).dropDuplicates(["path"]).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("mtime"), "content", content_id(F.col("content")).alias("doc_id"))


class Extractor(Protocol):
    """Turns the bytes of a document into its pages: (page number, markdown). PDF and OCR libraries plug in here."""

    def __call__(self, content: bytes, path: str) -> list[tuple[int, str]]: ...


def plain_text(content: bytes, path: str) -> list[tuple[int, str]]:
    """The extractor without libraries: UTF-8 text, pages parted by form feeds."""
    del path
    return list(enumerate(content.decode("utf-8", "replace").split("\f"), 1))


def extract(files: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """doc_id, page_no, md, error of every page; the extractor is made once a partition, a document
    that fails gives one row with its error and no page."""
    schema = pa.schema([("doc_id", pa.string()), ("page_no", pa.int32()), ("md", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = make()
        for b in batches:
            rows = []
            for doc, path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows += [{"doc_id": doc, "page_no": n, "md": md, "error": None} for n, md in extractor(content, path)]
                except Exception as e:  # noqa: BLE001 - any failure of a library is the document's, not the job's
                    rows.append({"doc_id": doc, "page_no": None, "md": None, "error": str(e)[:200]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("doc_id", "path", "content").mapInArrow(run, "doc_id string, page_no int, md string, error string")


class SecondExtractor(Protocol):
    """Reads the given pages of a document again, by another way than the first."""

    def __call__(self, content: bytes, path: str, pages: list[int]) -> list[tuple[int, str]]: ...


def extract_in_passes(files: DataFrame, make_first: Callable[[], Extractor], make_second: Callable[[], SecondExtractor], doubtful: Callable[[str], bool]) -> DataFrame:
    """doc_id, page_no, md, error, second: as :func:`extract`, with a second pass over the pages that are empty
    or ``doubtful``. What the second pass does not give, or fails to, stays as the first read it."""
    schema = pa.schema([("doc_id", pa.string()), ("page_no", pa.int32()), ("md", pa.string()), ("error", pa.string()), ("second", pa.bool_())])

    def read(first: Extractor, second: SecondExtractor, doc: str, path: str, content: bytes) -> list[dict]:
        try:
            pages = dict(first(content, path))
        except Exception as e:  # noqa: BLE001 - any failure of a library is the document's, not the job's
            return [{"doc_id": doc, "page_no": None, "md": None, "error": str(e)[:200], "second": False}]
        error, again = None, {}
        if wanted := sorted(n for n, md in pages.items() if not (md or "").strip() or doubtful(md)):
            try:
                again = {n: md for n, md in second(content, path, wanted) if n in pages and (md or "").strip()}
            except Exception as e:  # noqa: BLE001
                error = str(e)[:200]
        return [{"doc_id": doc, "page_no": n, "md": again.get(n, md), "error": error if n in wanted else None, "second": n in again} for n, md in pages.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = make_first(), make_second()
        for b in batches:
            for doc, path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_pylist(read(first, second, doc, path, content), schema=schema)

    return files.select("doc_id", "path", "content").mapInArrow(run, "doc_id string, page_no int, md string, error string, second boolean")


def write_markdown(assembled: DataFrame, path: str) -> None:
    """One folder of text a document."""
    assembled.select("doc_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_events(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
