"""The most similar vectors for every vector, by cross-polytope hashing.

Unit vectors are turned by pseudo-random rotations (three rounds of sign flips and a fast Hadamard transform) and
assigned to the nearest signed axis. ``TABLES`` tables of ``K`` such hashes collect candidates; every vector also
probes, for each hash in turn, its second axis. Candidates are ranked exactly, in blocks of matrix products inside a
bucket. Equal vectors are one class, so a group of copies of any size costs one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlode.session import checkpoint, spread

#: Hash tables where a table joins one hash, doubled with each further hash; axes a vector tries per hash (its nearest
#: and the next).
TABLES, AXES = 4, 2
#: Vectors wanted in a bucket; the number of hashes a table joins follows from it and the number of classes.
BUCKET = 1024
#: Most vectors one side of a block product holds; larger buckets are cut into a grid of such blocks.
BLOCK = 4096
SEED = 20240501


def rotations(dim: int, count: int, seed: int = SEED) -> list[np.ndarray]:
    """Pseudo-random rotations of vectors padded to a power of two: three rounds of sign flips and Hadamard."""
    size = 1 << max(1, (dim - 1).bit_length())
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    h /= math.sqrt(size)
    out = []
    for k in range(count):
        rng = np.random.default_rng(seed + k)
        m = np.eye(size)
        for _ in range(3):
            m = (m * rng.choice([-1.0, 1.0], size)) @ h
        out.append(m[:dim].astype(np.float32))
    return out


def axes(unit: np.ndarray, rotation: np.ndarray, tries: int = AXES) -> np.ndarray:
    """The nearest signed axes of each vector, nearest first."""
    y = unit.astype(np.float32) @ rotation
    o = np.argpartition(-np.abs(y), range(tries), axis=1)[:, :tries]
    return o * 2 + (np.take_along_axis(y, o, 1) < 0)


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys():
    """Usable vectors as bytes with the key of their class (the digest of the unit vector)."""
    import hashlib

    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, raws = [], [], []
            for i, e in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not e.is_valid:
                    continue
                values = e.values
                if values is None or len(values) == 0 or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float32)
                norm = math.sqrt(float((x.astype(np.float64) ** 2).sum()))
                if not math.isfinite(norm) or norm == 0:
                    continue
                ids.append(i)
                keys.append(hashlib.blake2b((x.astype(np.float64) / norm + 0.0).tobytes(), digest_size=16).digest())
                raws.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], schema=schema)

    return run


def tables_for(hashes: int) -> int:
    """Tables for so many hashes a table: a longer key parts near vectors more often, so more tables make up for it."""
    return TABLES << (hashes - 1)


def _hash(hashes: int):
    """The buckets of each class, as one list: for every table its own bucket, then those it probes. With no hashes
    all vectors of a length share one bucket."""
    tables = tables_for(hashes) if hashes else 1
    schema = pa.schema([("rid", pa.int64()), ("raw", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, list[np.ndarray]] = {}
        for b in batches:
            raws = b.column(1).to_pylist()
            widths = np.array([len(r) for r in raws])
            for width in np.unique(widths) if len(raws) else ():
                at = np.flatnonzero(widths == width)
                dim = int(width) // 4
                x = _units(np.frombuffer(b"".join(raws[i] for i in at), dtype=np.float32).reshape(len(at), dim))
                if dim not in turns:
                    turns[dim] = rotations(dim, max(1, tables * hashes))
                base = np.int64(2 * turns[dim][0].shape[1])
                columns = []
                for t in range(tables):
                    codes = [axes(x, turns[dim][t * hashes + k]).astype(np.int64) for k in range(hashes)]
                    home = sum((c[:, 0] * base**k for k, c in enumerate(codes)), np.full(len(at), np.int64(dim) << 40))
                    columns += [home] + [home + (c[:, p] - c[:, 0]) * base**k for k, c in enumerate(codes) for p in range(1, c.shape[1])]
                flat = np.stack(columns, axis=1)
                offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([raws[i] for i in at], pa.binary()), lists], schema=schema)

    return run


def _rank(k: int):
    """The k best of each bucket's block for every vector in it; partitions come sorted by block."""
    schema = pa.schema([("rid", pa.int64()), ("near", pa.list_(pa.struct([("sim", pa.float64()), ("cid", pa.int64())])))])

    def block(rows: list[tuple]) -> pa.RecordBatch:
        index = sorted({(r[2], r[3]) for r in rows if r[0]})
        seekers = sorted({(r[2], r[3]) for r in rows if r[1]})
        ids = np.array([i for i, _ in index], np.int64)
        x = _units(np.frombuffer(b"".join(v for _, v in index), np.float32).reshape(len(index), -1))
        rids, near = [], []
        for s in range(0, len(seekers), 512):
            part = seekers[s : s + 512]
            q = _units(np.frombuffer(b"".join(v for _, v in part), np.float32).reshape(len(part), -1))
            sims = np.round(q @ x.T, 12)
            m = min(k + 1, len(index))
            # ids ascend, so a stable order gives ties to the smaller id; only those at or above the m-th matter
            floor = np.partition(sims, len(index) - m, axis=1)[:, len(index) - m]
            for r, (rid, _) in enumerate(part):
                at = np.flatnonzero(sims[r] >= floor[r])
                at = at[np.argsort(-sims[r][at], kind="stable")]
                best = [{"sim": float(sims[r, j]), "cid": int(ids[j])} for j in at[: k + 1] if ids[j] != rid][:k]
                if best:
                    rids.append(rid)
                    near.append(best)
        return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(near, schema.field("near").type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for t, bucket, cell, index, seeks, rid, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (t, bucket, cell) != now:
                    if any(r[0] for r in rows):
                        yield block(rows)
                    now, rows = (t, bucket, cell), []
                rows.append((index, seeks, rid, raw))
        if any(r[0] for r in rows):
            yield block(rows)

    return run


def nearest(vectors: DataFrame, k: int = 5, exact: bool = False) -> DataFrame:
    """For every usable vector its k most similar others: vec_id, hit_rank, hit_vec_id, similarity (cosine).

    In: vec_id, embedding; further columns are ignored. Null and all-zero embeddings, embeddings with null or
    non-finite values and null ids take no part; vectors are compared only with those of their length. Similarities
    equal to 12 decimals are ties, won by the smaller id. A repeated vec_id with one embedding counts once. The
    similarity is exact; a neighbour is missed only if no table joins the two (recall is measured in the tests). For
    collections without near neighbours, where hashing finds few, ``exact`` compares all rows with all, block by block.
    Fewer than k neighbours come out where there are fewer vectors. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    usable = checkpoint(vectors.select("vec_id", "embedding").mapInArrow(_keys(), "vec_id bigint, key binary, raw binary"))
    # the k + 1 smallest ids of a class answer for all of it; the rank limit is applied before the shuffle
    first = usable.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = checkpoint(
        first.groupBy("key").agg(F.min("vec_id").alias("rid"), F.array_sort(F.collect_set("vec_id")).alias("members"), F.min(F.when(F.col("n") == 1, F.col("raw"))).alias("raw"))
    )
    total = classes.count()
    hashes = 0 if exact else max(1, math.ceil(math.log(max(2, total / BUCKET)) / math.log(128)))
    tries = 1 + hashes * (AXES - 1)
    coded = checkpoint(classes.select("rid", "raw").repartition(spread(spark)).mapInArrow(_hash(hashes), "rid bigint, raw binary, buckets array<bigint>"))

    def placed(*columns: str) -> DataFrame:
        each = coded.select(*columns, F.posexplode("buckets").alias("pos", "bucket"))
        return each.select(F.floor(F.col("pos") / tries).cast("int").alias("t"), "bucket", (F.col("pos") % tries == 0).alias("home"), *columns)

    # how full buckets are: those over a block are cut into a grid of blocks, so that no task holds more than two
    full = (
        placed().groupBy("t", "bucket")
        .agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.lit(1)).alias("seekers"))
        .where((F.col("homes") > BLOCK) | (F.col("seekers") > 2 * BLOCK))
        .select("t", "bucket", F.ceil(F.col("homes") / BLOCK).cast("int").alias("cuts"), F.ceil(F.col("seekers") / (2 * BLOCK)).cast("int").alias("strips"))
    )
    h = F.xxhash64("rid")
    cut = placed("rid", "raw").join(full, ["t", "bucket"], "left").withColumns({"cuts": F.greatest(F.coalesce("cuts", F.lit(1)), F.lit(1)), "strips": F.greatest(F.coalesce("strips", F.lit(1)), F.lit(1))})
    row, column = F.pmod(h, F.col("strips")).cast("int"), F.pmod(h, F.col("cuts")).cast("int")
    as_seeker = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda c: F.struct((row * F.col("cuts") + c).alias("cell"), F.lit(False).alias("index"), F.lit(True).alias("seeks")))
    as_index = F.transform(F.sequence(F.lit(0), F.col("strips") - 1), lambda r: F.struct((r * F.col("cuts") + column).alias("cell"), F.lit(True).alias("index"), F.lit(False).alias("seeks")))
    both = F.array(F.struct(F.lit(0).alias("cell"), F.col("home").alias("index"), F.lit(True).alias("seeks")))
    cells = F.when((F.col("cuts") == 1) & (F.col("strips") == 1), both).when(F.col("home"), F.concat(as_seeker, as_index)).otherwise(as_seeker)
    blocks = cut.select("t", "bucket", F.explode(cells).alias("c"), "rid", "raw").select("t", "bucket", "c.cell", "c.index", "c.seeks", "rid", "raw")
    near = (
        blocks.repartition(spread(spark), "t", "bucket", "cell")
        .sortWithinPartitions("t", "bucket", "cell")
        .mapInArrow(_rank(k), "rid bigint, near array<struct<sim:double,cid:bigint>>")
    )
    best = near.select("rid", F.explode("near").alias("x")).select("rid", "x.sim", "x.cid").groupBy("rid", "cid").agg(F.max("sim").alias("sim"))
    by_sim = Window.partitionBy("rid").orderBy(F.desc("sim"), "cid")
    best = best.withColumn("n", F.row_number().over(by_sim)).where(F.col("n") <= k).drop("n")
    # classes become vectors: each candidate class gives its first members, the own class its others
    members = classes.select(F.col("rid").alias("cid"), "members")
    spelled = best.join(members.hint("merge"), "cid").select("rid", F.explode(F.transform("members", lambda v: F.struct((-F.col("sim")).alias("far"), v.alias("id")))).alias("x"))
    own = classes.select("rid", F.explode(F.transform("members", lambda v: F.struct(F.lit(-1.0).alias("far"), v.alias("id")))).alias("x"))
    lists = spelled.unionByName(own).groupBy("rid").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k + 1).alias("found"))
    return (
        usable.select("vec_id", "key").distinct()
        # the side of the vectors may be skewed by copies of one; a sort-merge join lets its partitions be split
        .join(classes.select("key", "rid").join(lists.hint("merge"), "rid").select("key", "found").hint("merge"), "key")
        .select("vec_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("found"))
        .select("vec_id", F.posexplode("found").alias("hit_rank", "x"))
        .select("vec_id", (F.col("hit_rank") + 1).alias("hit_rank"), F.col("x.id").alias("hit_vec_id"), (-F.col("x.far")).alias("similarity"))
    )


def pairs(hits: DataFrame) -> DataFrame:
    """Unordered pairs of :func:`nearest`: vec_a < vec_b."""
    return hits.select(F.least("vec_id", "hit_vec_id").alias("vec_a"), F.greatest("vec_id", "hit_vec_id").alias("vec_b")).distinct()
