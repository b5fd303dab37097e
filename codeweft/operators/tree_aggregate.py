"""Per-key aggregation that no hot key can unbalance: multi-level fan-in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class State:
    """One mergeable aggregate: ``name`` <- ``merge(of)``, merged again in every round.

    ``merge`` is ``sum``, ``min``, ``max`` or ``count`` (counts merge by sum).
    """

    name: str
    merge: str
    of: Column

    def first(self) -> Column:
        return getattr(F, self.merge)(self.of).alias(self.name)

    def again(self) -> Column:
        return getattr(F, "sum" if self.merge == "count" else self.merge)(self.name).alias(self.name)


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: Sequence[State], fan_in: int = 8) -> DataFrame:
    """One row per key with the merged ``states``.

    Every input split (a chunk of at most ``maxPartitionBytes``) is combined
    locally first: its task holds one partial state per key. The partials of
    ``fan_in`` neighbouring chunks meet in one reducer, those of ``fan_in``
    such groups in the next round, and so on: after about
    log(chunks)/log(fan_in) rounds one state per key is left. No reducer gets
    more than ``fan_in`` partials of any key, however hot the key is, and
    nothing is sampled or dropped.

    Null keys form one group like any other value; an empty input gives an
    empty result; repeated rows count as often as they occur; further columns,
    whatever their names, are ignored.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    names = [f"k{i}" for i in range(len(keys))]
    inputs = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    raw = [State(f"v{i}", s.merge, F.col(f"v{i}")) for i, s in enumerate(states)]
    level = df.select(*inputs, *(s.of.alias(f"v{i}") for i, s in enumerate(states)), F.spark_partition_id().alias("chunk"))
    groups = df.rdd.getNumPartitions()
    merge = [s.first() for s in raw]
    while groups > fan_in:
        level = level.groupBy(*names, F.floor(F.col("chunk") / fan_in).cast("int").alias("chunk")).agg(*merge)
        merge = [s.again() for s in raw]
        groups = -(-groups // fan_in)
    out = level.groupBy(*names).agg(*merge)
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), *(F.col(r.name).alias(s.name) for r, s in zip(raw, states)))


def heavy_keys(df: DataFrame, key: str, share: float, fan_in: int = 8) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of ``df``, with their count ``n``.

    All rows count towards the total; null and blank keys are not reported.
    """
    total = df.count()
    counts = tree_aggregate(df, [key], [State("n", "count", F.lit(1))], fan_in)
    return counts.where(F.col(key).rlike(r"\S") & (F.col("n") >= F.lit(share * total)))
