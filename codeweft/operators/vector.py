"""Exact vector search by inner product, upsert and delete by key, a hashing embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.graph import top_per
from codeweft.session import cut

#: Queries that go to the vectors in one scan.
QUERY_BLOCK = 1_000


def dot(a: str, b: str) -> Column:
    """Inner product in double precision."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    return F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, min_score: float | None = 0.2, shards: int = 16) -> DataFrame:
    """(query_id, id, score, place): per query the ``k`` best of ``vectors``, in exact order.

    ``queries``: (query_id, q); ``vectors``: (id, embedding, ...), filtered by
    the caller on its scalars, which reach the scan. Queries go to the vectors
    in blocks of QUERY_BLOCK, each with a scan of its own; each task keeps k
    rows per query before anything is shuffled. Null, empty
    or differently long vectors score nothing; blank ids are left out. Ties go
    to the smaller id; scores are rounded to 9 digits first, so that equal vectors tie.
    """
    k = max(1, min(100, k))
    some = queries.where("q is not null and size(q) > 0").select("query_id", "q")
    n = some.count()
    if n > QUERY_BLOCK:
        blocks = -(-n // QUERY_BLOCK)
        # Twice as many parts as blocks, so that hashing fills none beyond the bound but with negligible chance; a part that is too full is split again.
        part = F.pmod(F.xxhash64("query_id", F.lit(n)), F.lit(2 * blocks))
        some = cut(some.dropDuplicates(["query_id"]).withColumn("_part", part))
        return reduce(DataFrame.unionByName, (search(some.where(F.col("_part") == i).drop("_part"), vectors, k, min_score, shards) for i in range(2 * blocks)))
    rows = some.collect()
    if not rows:
        return vectors.select(F.lit(None).cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("place")).limit(0)
    ids = [r["query_id"] for r in rows]
    by_size: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_size.setdefault(len(r["q"]), []).append(i)
    blocks = {n: (at, np.array([rows[i]["q"] for i in at], dtype=np.float64)) for n, at in by_size.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            emb = b["embedding"].to_numpy()
            sizes = np.fromiter((len(e) if e is not None else 0 for e in emb), dtype=int, count=len(emb))
            for n, (at, q) in blocks.items():
                some = np.nonzero(sizes == n)[0]
                if not len(some):
                    continue
                s = np.round(np.vstack(emb[some]).astype(np.float64) @ q.T, 9)
                name = b["id"].to_numpy()[some]
                for j, i in enumerate(at):
                    col = s[:, j]
                    fine = np.nonzero(np.isfinite(col) & (col >= (-np.inf if min_score is None else min_score)))[0]
                    best = _best(fine, col, name, k)
                    if not best:
                        continue
                    yield pd.DataFrame({"qi": i, "id": list(best), "score": list(best.values())})

    kept = vectors.where(F.trim("id") != "").select("id", "embedding").mapInPandas(run, "qi int, id string, score double")
    names = vectors.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"qi int, query_id {dict(queries.dtypes)['query_id']}")
    top = top_per(kept.groupBy("qi", "id").agg(F.max("score").alias("score")), ["qi"], [F.desc("score"), "id"], k)
    ranked = top.groupBy("qi").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "id"))).alias("x"))
    return ranked.select("qi", F.posexplode("x").alias("p", "x")).join(F.broadcast(names), "qi").select("query_id", F.col("x.id").alias("id"), (-F.col("x.d")).alias("score"), (F.col("p") + 1).alias("place"))


def _best(rows: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> dict[str, float]:
    """The ``k`` best distinct names among ``rows``; tries the best few rows before it sorts all."""
    few = rows
    if len(rows) > 50 * k:
        few = rows[score[rows] >= np.partition(score[rows], len(rows) - 25 * k)[len(rows) - 25 * k]]
    best: dict[str, float] = {}
    for x in sorted(few, key=lambda x: (-score[x], name[x])):
        best.setdefault(name[x], score[x])
        if len(best) == k:
            return best
    return best if few is rows else _best_all(rows, score, name, k)


def _best_all(rows: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> dict[str, float]:
    best: dict[str, float] = {}
    for x in sorted(rows, key=lambda x: (-score[x], name[x])):
        best.setdefault(name[x], score[x])
        if len(best) == k:
            break
    return best


def hits_to_seeds(hits: DataFrame, nodes: DataFrame, has_method: DataFrame) -> DataFrame:
    """(seed): METHOD hits themselves, TYPE hits by their methods, other kinds not at all."""
    h = hits.select("id").distinct().join(nodes.select("id", F.upper("node_type").alias("t")).distinct(), "id")
    own = has_method.select(F.col("src").alias("id"), F.col("dst").alias("seed"))
    return h.where("t = 'METHOD'").select(F.col("id").alias("seed")).unionByName(h.where("t = 'TYPE'").join(own, "id").select("seed")).distinct()


def hashed(text: str | None, dim: int = 64) -> list[float] | None:
    """A deterministic unit vector from the words of a text; null or blank text has none."""
    words = (text or "").split()
    if not words:
        return None
    v = np.zeros(dim)
    for w in words:
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else np.eye(1, dim)[0]).tolist()


def embed(df: DataFrame, text: str = "text", dim: int = 64) -> DataFrame:
    """``df`` plus ``embedding`` of its text column, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([hashed(t, dim) for t in s], dtype=object)

    return df.withColumn("embedding", run(F.col(text)))


def embedding_texts(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(node_id, node_type, text): types as ``KIND name``, methods by signature; blank texts are left out."""
    t = types.select(F.col("qualified_name").alias("node_id"), F.lit("TYPE").alias("node_type"), F.concat_ws(" ", "kind", "qualified_name").alias("text"))
    m = methods.select(F.col("id").alias("node_id"), F.lit("METHOD").alias("node_type"), F.col("signature").alias("text"))
    return t.unionByName(m).where(F.col("node_id").rlike(r"\S") & F.col("text").rlike(r"\S")).distinct()
