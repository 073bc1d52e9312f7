"""Tables kept between runs: parsed pages by fingerprint, facts, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Folders a new store begins with, and rows a folder should hold; a rewrite touches only the folders of its documents.
BUCKETS, FOLDER_ROWS = 64, 1_000_000


def _bucket(doc: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


class ParseCache:
    """Pages of documents that parsed in full, by the parser's fingerprint."""

    def __init__(self, spark: SparkSession, path: str, fingerprint: str) -> None:
        self.spark, self.path, self.fingerprint = spark, path, fingerprint

    def pages(self) -> DataFrame | None:
        return _read(self.spark, f"{self.path}/fingerprint={self.fingerprint}")

    def missing(self, documents: DataFrame) -> DataFrame:
        """Documents without cached pages."""
        have = self.pages()
        return documents if have is None else documents.join(have.select("doc_id").distinct(), "doc_id", "left_anti")

    def put(self, pages: DataFrame, outcome: DataFrame) -> None:
        """Keep the pages of documents whose outcome is ``cached``; partial parses are never kept, nor pages of
        documents that are kept already."""
        whole = self.missing(outcome.where("cached").select("doc_id"))
        pages.join(whole, "doc_id", "left_semi").write.mode("append").parquet(f"{self.path}/fingerprint={self.fingerprint}")


class ChunkStore:
    """Chunks (or other rows) with their tags, in folders by document. Rewrites replace whole folders at
    once. The number of folders is kept beside the store and grows with it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def buckets(self) -> int:
        kept = _read(self.spark, f"{self.path}.buckets")
        return BUCKETS if kept is None else kept.first()["n"]

    def grow(self) -> bool:
        """Four times as many folders, all rows dealt out anew, where folders hold too many rows on the average."""
        old, n = self.read(), self.buckets()
        if old is None or old.count() <= n * FOLDER_ROWS:
            return False
        self._replace(old.withColumn("bucket", _bucket(F.col("doc_id"), 4 * n)), whole=True)
        self.spark.createDataFrame([(4 * n,)], "n int").write.mode("overwrite").parquet(f"{self.path}.buckets")
        return True

    def read(self) -> DataFrame | None:
        return _read(self.spark, self.path)

    def _replace(self, rows: DataFrame, whole: bool = False) -> None:
        # the rows may come from the folders they replace, so they are written beside them first
        staged = f"{self.path}.staged"
        rows.write.mode("overwrite").parquet(staged)
        self.spark.read.parquet(staged).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("bucket").parquet(self.path)

    def upsert(self, chunks: DataFrame) -> None:
        """All chunks of the given documents, in place of those there."""
        fresh = chunks.withColumn("bucket", _bucket(F.col("doc_id"), self.buckets()))
        old = self.read()
        if old is not None:
            touched = fresh.select("bucket").distinct()
            kept = old.join(touched, "bucket", "left_semi").join(fresh.select("doc_id").distinct(), "doc_id", "left_anti")
            fresh = fresh.unionByName(kept, allowMissingColumns=True)
        self._replace(fresh)
        self.grow()

    def delete(self, *doc_ids: str) -> None:
        """Forget documents; a folder left empty keeps no rows."""
        old = self.read()
        if old is None or not doc_ids:
            return
        numbers = [r.b for r in self.spark.createDataFrame([(d,) for d in doc_ids], "d string").select(_bucket(F.col("d"), self.buckets()).alias("b")).distinct().collect()]
        kept = old.where(F.col("bucket").isin(numbers) & ~F.col("doc_id").isin(list(doc_ids)))
        gone = set(numbers) - {r.bucket for r in kept.select("bucket").distinct().collect()}
        self._replace(kept)
        jvm = self.spark._jvm
        for b in gone:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def retag(self, doc_id: str, **tags: str) -> None:
        """New tags on every chunk of a document."""
        old = self.read()
        if old is None:
            return
        number = self.spark.range(1).select(_bucket(F.lit(doc_id), self.buckets()).alias("b")).first().b
        rows = old.where(F.col("bucket") == number)
        for k, v in tags.items():
            rows = rows.withColumn(k, F.when(F.col("doc_id") == doc_id, F.lit(v)).otherwise(F.col(k) if k in old.columns else F.lit(None)))
        self._replace(rows)

    def has(self, doc_id: str) -> bool:
        old = self.read()
        return old is not None and not old.where(F.col("doc_id") == doc_id).isEmpty()

    def count(self) -> int:
        old = self.read()
        return 0 if old is None else old.count()


class FactStore:
    """Facts as JSON, one row a document; rows that cannot be read are passed over. Every change is appended, the
    latest row of a document holds; ``compact`` drops the others."""

    ROWS = "doc_id string, facts string, stored timestamp"

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def put(self, facts: DataFrame) -> None:
        """Keep the facts of documents, in place of those kept before."""
        self._append(facts.select("doc_id", F.to_json(F.struct(*[c for c in facts.columns if c != "doc_id"])).alias("facts")))

    def delete(self, *doc_ids: str) -> None:
        """Forget the facts of documents."""
        self._append(self.spark.createDataFrame([(d, None) for d in doc_ids], "doc_id string, facts string"))

    def _append(self, rows: DataFrame) -> None:
        rows.withColumn("stored", F.current_timestamp()).write.mode("append").parquet(self.path)

    def _latest(self) -> DataFrame:
        try:
            d = self.spark.read.schema(self.ROWS).parquet(self.path)
        except AnalysisException:  # nothing is stored yet
            d = self.spark.createDataFrame([], self.ROWS)
        # null of all times is the earliest, so that a row without a time holds only where there is no other
        return d.groupBy("doc_id").agg(F.max(F.struct("stored", "facts")).alias("x")).select("doc_id", "x.facts").where("facts is not null")

    def _read(self, d: DataFrame) -> DataFrame:
        return d.withColumn("facts", F.from_json("facts", self.schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("facts is not null and facts._bad is null")

    def all(self) -> DataFrame:
        return self._read(self._latest())

    def get(self, doc_id: str) -> DataFrame:
        """The facts of one document; the filter reaches the scan."""
        return self._read(self._latest().where(F.col("doc_id") == doc_id))

    def compact(self) -> None:
        """Only the latest rows, in one rewrite."""
        staged = f"{self.path}.staged"
        self._latest().withColumn("stored", F.current_timestamp()).write.mode("overwrite").parquet(staged)
        self.spark.read.parquet(staged).write.mode("overwrite").parquet(self.path)
