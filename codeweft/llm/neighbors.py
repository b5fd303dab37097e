"""Most similar vectors by block matrix products.

Vectors are scaled to length 1 and quantised to int8 with their own scale; the
length of what the rounding left over is kept. For two vectors the product of
the int8 parts is then off by at most e1 + e2 + e1*e2, so a tile of products
tells which pairs can reach a threshold (or a k-th place). Only those are
computed in floating point. The int8 products run as a float32 matrix product
of whole numbers below 2**24, which is exact and uses the vector units.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut, partitions

#: Side of a tile.
TILE = 2048
#: Buckets are this many times the root of the number of vectors, within bounds that limit what is sent to each task (4 MB at 64 dimensions).
PIVOTS_PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 4.0, 16, 16_384

#: Up to so many surviving pairs (24 bytes each, twice) are broadcast; more are joined by shuffling.
SENT_PAIRS = 500_000


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, v): one vector of ``dim`` finite components, not all zero, per id.

    ``vectors``: (id, embedding). Null ids take no part; repeated rows count
    once; of several different vectors of one id the smallest is taken.
    """
    big = 3.4e38
    fine = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big)) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & F.col("embedding").isNotNull()).where(fine).groupBy("id").agg(F.min("embedding").alias("v"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, error) of unit rows: x = q * scale + rest, |rest| = error."""
    x = np.asarray(x, dtype=np.float64)
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None])
    err = np.linalg.norm(x - q * scale[:, None], axis=1)
    # Rounded up, so that the bound also covers single precision.
    return q.astype(np.int8), scale.astype(np.float32), (err + 1e-6).astype(np.float32)


def _unit(v) -> np.ndarray:
    x = np.vstack(v).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def reaching(qa, sa, ea, qb, sb, eb, least: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a tile whose product may reach ``least``."""
    b = qb.astype(np.float32)
    for at in range(0, len(qa), step):
        cut_ = slice(at, at + step)
        g = (qa[cut_].astype(np.float32) @ b.T) * (sa[cut_, None] * sb[None, :])
        i, j = np.nonzero(g + (ea[cut_, None] + eb[None, :] * (1 + ea[cut_, None])) >= least)
        yield i + at, j


def _nearest(x: np.ndarray, pivots: np.ndarray, probes: int) -> np.ndarray:
    if probes >= len(pivots):
        return np.tile(np.arange(len(pivots)), (len(x), 1))
    return np.argpartition(x @ -pivots.T, probes - 1, axis=1)[:, :probes]


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in double precision."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similar_pairs(vectors: DataFrame, least: float = 0.9, dim: int = 64, probes: int = 8, tile: int = TILE) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b, of the pairs with a cosine of at least ``least``.

    Equal vectors form a class and are compared as one; their members come
    back at the end. Which blocks of the product are formed: every class goes
    to the ``probes`` buckets whose pivots (a hash sample of the vectors, at
    most MAX_PIVOTS) are most similar to it, and each bucket's tiles are
    multiplied. Buckets larger than a tile are cut into tiles that meet pair
    by pair, so no task holds more than two, and nothing is dropped. Pairs
    that meet in no bucket are lost; the README gives the measured recall.
    """
    spark = vectors.sparkSession
    clean = cut(usable(vectors, dim).select("id", "v", F.monotonically_increasing_id().alias("rid")))
    classes = cut(clean.groupBy("v").agg(F.min("rid").alias("rid"), F.count("*").alias("n")))
    n = classes.count()
    want = min(MAX_PIVOTS, max(MIN_PIVOTS, 2 ** math.ceil(math.log2(max(1.0, PIVOTS_PER_ROOT * math.sqrt(max(n, 1)))))))
    sample = classes.select("v", F.xxhash64("v").alias("h"), "rid").orderBy("h", "rid").limit(want).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "id_a string, id_b string, cosine double")
    pivots = _unit([r["v"] for r in sample]).astype(np.float32)
    probes = min(probes, len(pivots))
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            q, s, e = quantise(x)
            # Few rows at a time: each is compared with all pivots.
            top = np.concatenate([_nearest(x[at : at + 512].astype(np.float32), p, probes) for at in range(0, len(x), 512)])
            who = np.repeat(np.arange(len(x)), probes)
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(top.ravel().astype(np.int32)), pa.array(rid[who]), pa.array([x.tobytes() for x in q], pa.binary()).take(pa.array(who)),
                    pa.array(s[who]), pa.array(e[who]),
                ],
                names=["bucket", "rid", "q", "s", "e"],
            )

    placed = classes.select("v", "rid").mapInArrow(assign, "bucket int, rid bigint, q binary, s float, e float")
    # Assigned twice, once to count: cheaper than keeping every vector once per probe on disk.
    many = placed.groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))  # at most MAX_PIVOTS rows
    placed = placed.join(F.broadcast(many), "bucket", "left").fillna(1, ["tiles"]).withColumn("t", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
    block = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("t", o).alias("i"), F.greatest("t", o).alias("j"))))
    tiles = placed.withColumn("x", block).select("bucket", "x.i", "x.j", F.when(F.col("t") == F.col("x.i"), 0).otherwise(1).alias("side"), "rid", "q", "s", "e")
    tiles = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["bucket", "i", "j"]):
            rid = t.column("rid").to_numpy()
            q = np.frombuffer(b"".join(t.column("q").to_pylist()), dtype=np.int8).reshape(len(rid), -1)
            s, e, side = t.column("s").to_numpy(), t.column("e").to_numpy(), t.column("side").to_numpy()
            same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
            a = np.arange(len(rid)) if same else np.nonzero(side == 0)[0]
            b = a if same else np.nonzero(side == 1)[0]
            for i, j in reaching(q[a], s[a], e[a], q[b], s[b], e[b], least):
                x, y = rid[a[i]], rid[b[j]]
                keep = x < y if same else x != y
                if keep.any():
                    x, y = x[keep], y[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    met = cut(tiles.mapInArrow(multiply, "a bigint, b bigint").distinct())
    # Float products of what is left. Few pairs are sent to the vectors; beyond that every vector moves once, with the pairs it is part of.
    ends = met.select("a", "b", F.explode(F.array("a", "b")).alias("rid"))
    if met.count() <= SENT_PAIRS:
        ends = F.broadcast(ends)
    both = ends.join(classes.select("rid", "v"), "rid").groupBy("a", "b").agg(F.min_by("v", "rid").alias("va"), F.max_by("v", "rid").alias("vb"))
    close = both.select("a", "b", cosine("va", "vb").alias("cosine")).where(F.col("cosine") >= least)

    copies = classes.where("n > 1").select("v", F.col("rid").alias("cls"))
    more = clean.join(copies, "v").where("rid <> cls").select("cls", "id")
    member = clean.select(F.col("rid").alias("cls"), "id").unionByName(more)
    across = close.join(member.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a").join(member.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b").select("x", "y", "cosine")
    twin = copies.select("cls").join(member, "cls").select("cls", F.col("id").alias("x"))
    within = twin.join(twin.withColumnRenamed("x", "y"), "cls").where("x < y").select("x", "y", F.lit(1.0).alias("cosine"))
    pairs = across.unionByName(within)
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "cosine")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
        cuts = [0, *(np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1), len(k)]
        for x, y in zip(cuts, cuts[1:]):
            key = tuple(k[x])
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(x, y - x))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, dim: int = 64, query_block: int = 1024, shard_rows: int = 50_000) -> DataFrame:
    """(query_id, id, cosine, place): the ``k`` most similar other vectors of each query, by full scan in tiles.

    Both inputs: (id, embedding). Exact: a vector is left out only if the int8
    bound shows that k others are closer. Blocks of queries meet shards of the
    vectors; each meeting keeps k per query, and the shards' heaps are merged.
    Ties go to the smaller id. Fewer than k usable vectors give fewer rows.
    """
    q, v = usable(queries, dim), usable(vectors, dim)
    q, v = cut(q), cut(v)
    n_q, n_v = q.count(), v.count()
    g, h = max(1, -(-n_q // query_block)), max(1, -(-n_v // shard_rows))
    left = q.select(F.pmod(F.xxhash64("id"), F.lit(g)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"), F.lit(0).alias("side"), "id", "v")
    right = v.select(F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("g"), F.pmod(F.xxhash64("id"), F.lit(h)).cast("int").alias("h"), F.lit(1).alias("side"), "id", "v")
    tiles = left.unionByName(right).repartition(max(partitions(q.sparkSession), 1), "g", "h").sortWithinPartitions("g", "h", "side")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["g", "h"]):
            side = t.column("side").to_numpy()
            ids = np.array(t.column("id").to_pylist(), dtype=object)
            x = _unit(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
            a, b = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
            if not len(a) or not len(b):
                continue
            qa, sa, ea = quantise(x[a])
            qb, sb, eb = quantise(x[b])
            out_q, out_i, out_c = [], [], []
            for at in range(0, len(a), 128):
                sl = slice(at, at + 128)
                approx = (qa[sl].astype(np.float32) @ qb.astype(np.float32).T) * (sa[sl, None] * sb[None, :])
                err = ea[sl, None] + eb[None, :] * (1 + ea[sl, None])
                m = min(k + 1, len(b))  # the query itself may be among them
                floor_ = -np.partition(-(approx - err), m - 1, axis=1)[:, m - 1]
                for r in range(len(approx)):
                    some = np.nonzero(approx[r] + err[r] >= floor_[r])[0]
                    some = some[ids[b[some]] != ids[a[at + r]]]
                    c = x[b[some]] @ x[a[at + r]]
                    best = sorted(zip(-c, ids[b[some]]))[:k]
                    out_q += [ids[a[at + r]]] * len(best)
                    out_i += [i for _, i in best]
                    out_c += [-d for d, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.string()), pa.array(out_i, pa.string()), pa.array(out_c, pa.float64())], names=["query_id", "id", "cosine"])

    kept = tiles.mapInArrow(scan, "query_id string, id string, cosine double")
    heap = kept.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "id"))), 1, k).alias("x"))  # k from each shard
    return heap.select("query_id", F.posexplode("x").alias("p", "x")).select("query_id", "x.id", (-F.col("x.d")).alias("cosine"), (F.col("p") + 1).alias("place"))
