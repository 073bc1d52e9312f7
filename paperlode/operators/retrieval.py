"""Ranking of passages: keywords (BM25), vectors (exact cosine), both together, and what fits a prompt."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlode.functions.scalars import est_tokens, keywords, let
from paperlode.session import checkpoint, widen

K1, B = 1.5, 0.75
#: Share of similarity in the joint score; candidates per wanted hit.
ALPHA, CANDIDATES = 0.6, 4
DIMENSIONS = 256


def where(**filters: str | None) -> Column:
    """B2: equality on every given filter; none, empty and ``all`` filter nothing. A null never matches."""
    cond = F.lit(True)
    for name, value in filters.items():
        if value not in (None, "", "all"):
            cond = cond & (F.col(name) == value)
    return cond


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """``key`` and score (bm25) of every row; statistics are those of the rows given. No query terms score 0.

    Term counts are columns beside each row, so nothing is exploded or shuffled.
    """
    terms = sorted(set(_words(query)))

    def times(word: str) -> Column:
        return F.size("t") - F.size(F.array_remove("t", word))

    # generating the one list keeps projections from being merged, which would cut each text once a term
    d = widen(docs.select(key, text)).select(key, F.explode(F.array(keywords(F.coalesce(text, F.lit(""))))).alias("t")).select(key, F.size("t").alias("len"), *(times(w).alias(f"tf{i}") for i, w in enumerate(terms)))
    if not terms:
        return d.select(key, F.lit(0.0).alias("bm25"))
    # one row of statistics comes to the driver and goes back as literals: no join
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms)))).first()
    n, avg = stats["n"], stats["avg"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        seen = stats[f"df{i}"] or 0
        idf = math.log(1 + (n - seen + 0.5) / (seen + 0.5))
        tf = F.col(f"tf{i}")
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / avg))).otherwise(0.0)
    return d.select(key, score.alias("bm25"))


def _words(query: str) -> list[str]:
    import re

    from paperlode.functions.scalars import KEYWORD, STOP_WORDS

    return [w for w in re.findall(KEYWORD, query.lower()) if w not in STOP_WORDS]


def bm25_topk(docs: DataFrame, key: str, text: str, query: str, k: int = 10) -> DataFrame:
    """L1: the k best rows by BM25, ties by key."""
    return bm25(docs, key, text, query).where("bm25 > 0").orderBy(F.desc("bm25"), key).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; null for a null or all-zero one."""
    dot = lambda p, r: F.aggregate(F.zip_with(p, r, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, cond: Column | None = None) -> DataFrame:
    """The k rows most similar to one query vector among those the filter admits; exact, ties by key."""
    q = F.array(*(F.lit(float(v)) for v in query))
    d = vectors.where(cond) if cond is not None else vectors
    return d.withColumn("similarity", cosine(F.col(vector), q)).where("similarity is not null").orderBy(F.desc("similarity"), key).limit(k)


#: Vectors a block of an exact search holds on either side.
BLOCK = 2048


def nearest_of_each(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, cond: Column | None = None) -> DataFrame:
    """query_id, vec_id, similarity: for every row of ``queries``, the k rows of ``vectors`` most similar to it
    among those the filter admits (itself too, if it is one of them). Exact, in matrix products of block by block;
    similarities equal to 12 decimals are ties, won by the smaller key. Null, empty and all-zero vectors and ones with
    a null or NaN in them take no part; only vectors of one length are compared. Copies of a row count once."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(d: DataFrame, side: str) -> tuple[DataFrame, int]:
        bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
        usable = d.where(F.col(key).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0))
        v = usable.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["id"])
        # rows of about one block each; the block of a row follows from its key alone
        n = max(1, -(-v.count() // BLOCK))
        grouped = v.groupBy(F.size("v").alias(f"{side}_dim"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"))
        return grouped.agg(F.collect_list(F.struct("id", "v")).alias("rows")).select(f"{side}_dim", F.col("rows.id").alias(f"{side}_ids"), F.flatten("rows.v").alias(f"{side}_values")), n

    q, nq = blocks(queries, "q")
    v, nv = blocks(vectors.where(cond) if cond is not None else vectors, "v")
    # no equality the engine could shuffle by: nearly all vectors have one length
    pairs = q.join(v, F.col("q_dim") - F.col("v_dim") == 0).select("q_dim", "q_ids", "q_values", "v_ids", "v_values")
    pairs = pairs.repartition(max(parts, spark.sparkContext.defaultParallelism, nq * nv // 8))  # a few pairs a task, as a pair is some MB
    best = pairs.mapInArrow(_best_of_blocks(k), "query_id bigint, vec_id bigint, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "vec_id")
    return best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _best_of_blocks(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def unit(flat, dim):
            x = flat.values.to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, nor a length of zero
            return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

        for b in batches:
            for i in range(b.num_rows):
                dim, qi, qv, vi, vv = (b.column(c)[i] for c in range(5))
                q, v = unit(qv, dim.as_py()), unit(vv, dim.as_py())
                q_ids, v_ids = (x.values.to_numpy(zero_copy_only=False) for x in (qi, vi))
                s = np.round(q @ v.T, 12)
                n = min(k, len(v_ids))
                # all that reach the n-th best similarity, so that ties are settled by key
                least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
                rows, at = np.nonzero(s >= least[:, None])
                o = np.lexsort((v_ids[at], -s[rows, at], rows))
                rows, at = rows[o], at[o]
                starts = np.searchsorted(rows, np.arange(len(q_ids)))
                keep = np.arange(len(rows)) - starts[rows] < n
                rows, at = rows[keep], at[keep]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[rows], pa.int64()), "vec_id": pa.array(v_ids[at], pa.int64()), "similarity": pa.array(s[rows, at], pa.float64())})

    return run


def hash_embedding(text: Column) -> Column:
    """An offline stand-in for an embedding model: keywords hashed into 256 counts, scaled to unit length."""
    words = keywords(F.coalesce(text, F.lit("")))
    slots = F.transform(words, lambda w: F.conv(F.right(F.md5(w.cast("binary")), F.lit(2)), 16, 10).cast("int"))
    counts = lambda s: F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))
    unit = lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return let(slots, lambda s: let(counts(s), unit))


def embed_query(query: str) -> list[float]:
    """The stand-in embedding of a query."""
    import hashlib
    import math

    counts = [0.0] * DIMENSIONS
    for w in _words(query):
        counts[hashlib.md5(w.encode()).digest()[-1]] += 1
    n = math.sqrt(sum(c * c for c in counts)) or 1.0
    return [c / n for c in counts]


def sparse_similarity(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """``key`` and the cosine of the stand-in embeddings of each text and a query; texts without keywords are left out.

    Keywords are counted by slot before the shuffle, which carries at most 256 counts a text.
    """
    q = {i: v for i, v in enumerate(embed_query(query)) if v}
    digest = F.md5(F.col("w").cast("binary"))
    digit = lambda at: F.instr(F.lit("0123456789abcdef"), F.substring(digest, at, 1)) - 1
    slots = docs.select(key, F.explode(keywords(F.coalesce(text, F.lit("")))).alias("w")).select(key, (digit(31) * 16 + digit(32)).alias("slot"))
    counts = slots.groupBy(key, "slot").agg(F.count(F.lit(1)).cast("double").alias("n"))
    weight = F.lit(0.0)
    for i, v in sorted(q.items()):
        weight = F.when(F.col("slot") == i, F.lit(v)).otherwise(weight)
    g = counts.groupBy(key).agg(F.sum(weight * F.col("n")).alias("dot"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    return g.select(key, (F.col("dot") / F.sqrt("sq")).alias("similarity"))


class Embedder(Protocol):
    """An embedding model: unit vectors of texts, and of a query."""

    def documents(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...


def embedded(rows: DataFrame, text: str, make: Callable[[], Embedder], name: str = "embedding") -> DataFrame:
    """Rows with the vectors of their texts; the model is made once a task. Null texts are embedded as empty ones."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            yield f.assign(**{name: list(model.documents(f[text].fillna("").tolist()))})

    return rows.mapInPandas(run, schema)


def reranked(hits: DataFrame, query: str, judge: Callable[[str, list[str]], list[float]], k: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """The k best of a few candidates by another model's scores of (query, texts); ties go by key."""
    schema = T.StructType([f for f in hits.schema.fields if f.name != "score"] + [T.StructField("score", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(score=[float(x) for x in judge(query, f[text].fillna("").tolist())])[[c.name for c in schema]]

    return hits.coalesce(1).mapInPandas(run, schema).orderBy(F.desc("score"), key).limit(k)


def hybrid(chunks: DataFrame, query: str, k: int = 5, cond: Column | None = None, key: str = "chunk_id", text: str = "text", alpha: float = ALPHA, vector: str | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """The k best of the 4k most similar rows by alpha * similarity + (1 - alpha) * BM25 / its maximum.

    Keyword statistics are those of the candidates; ties go by key. Nothing but the candidates leaves the first
    stage, which is one top-k. Similarity is that of ``vector`` to ``query_vector`` where a model has made them, else
    that of the stand-in embeddings.
    """
    d = chunks.where(cond) if cond is not None else chunks
    if vector:
        similar = nearest(d, key, vector, query_vector, k * CANDIDATES).select(key, "similarity")
    else:
        similar = sparse_similarity(d, key, text, query)
    best = similar.orderBy(F.round("similarity", 12).desc(), key).limit(k * CANDIDATES)
    found = checkpoint(d.join(F.broadcast(best), key))  # 4k rows, read twice
    scored = found.join(bm25(found, key, text, query), key)
    top = F.max("bm25").over(Window.partitionBy())  # at most 4k rows
    score = alpha * F.col("similarity") + (1 - alpha) * F.col("bm25") / F.when(top > 0, top).otherwise(1.0)
    return scored.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


def source_label(source: Column, first: Column, last: Column, section: Column, path: Column) -> Column:
    """A citation: source and pages, section, last heading."""
    pages = F.when(last > first, F.concat(F.lit("pp."), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(F.concat(F.lit("p."), first.cast("string")))
    return F.concat_ws(", ", F.concat_ws(" ", source, pages), section, F.try_element_at(path, F.lit(-1)))


def budget_cut(hits: DataFrame, by: list[Column], order: list[Column], text: str, budget: int) -> DataFrame:
    """Hits in order until the budget is spent; the first always fits, and the first that does not ends the list.

    Costs are positive, so the running sum alone decides.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    d = hits.withColumn("cost", est_tokens(text)).withColumn("rn", F.row_number().over(w)).withColumn("spent", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where((F.col("rn") == 1) | (F.col("spent") <= budget))
