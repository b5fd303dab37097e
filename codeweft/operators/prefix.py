"""Running sums over groups of any size, without a task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_SHARD = 100_000


def running_start(df: DataFrame, by: Sequence[str], order: str, value: str, n_rows: int | None = None, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``df`` plus ``start``: the sum of ``value`` over the earlier rows of the group ``by``.

    Rows are ordered by the hash of ``order`` (a unique key per group), which
    also deals them into shards of about ``rows_per_shard``: only shard totals
    meet per group, and no window holds more than one shard, however many rows
    a group has. Null values count as 0.
    """
    n = df.count() if n_rows is None else n_rows
    shards = max(1, -(-n // rows_per_shard))
    # Hash order: shifting gives the shard, so shards follow each other in that order.
    h = F.xxhash64(order)
    df = df.withColumn("_h", h).withColumn("_s", F.floor((h.cast("double") / 2.0**64 + 0.5) * shards).cast("int"))
    v = F.coalesce(F.col(value), F.lit(0))
    totals = df.groupBy(*by, "_s").agg(F.sum(v).alias("_t"))
    before = W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_s", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    within = W.partitionBy(*by, "_s").orderBy("_h", order).rowsBetween(W.unboundedPreceding, -1)
    inner = df.withColumn("_w", F.coalesce(F.sum(v).over(within), F.lit(0)))
    keys = [F.col(f"i.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*by, "_s")]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    out = inner.alias("i").join(totals.alias("t"), cond, "left")
    cols = [c for c in df.columns if c not in ("_h", "_s")]
    return out.select(*(F.col(f"i.{c}").alias(c) for c in cols), (F.col("t._b") + F.col("i._w")).alias("start"))
