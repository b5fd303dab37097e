"""Trails: paths that use no edge twice, the shortest first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.graph import top_per
from codeweft.session import cut, filled


def trails(seeds: DataFrame, edges: DataFrame, depth: int, most: int = 80, up: bool = False) -> DataFrame:
    """(seed, hop, nodes, types): per seed the ``most`` shortest trails of 1..depth edges, ties by path.

    A seed is expanded further only while it has fewer than ``most`` trails;
    until then it has fewer than ``most``, so of each level only the ``most``
    smallest paths of a seed are kept: a hub does not pass on more.
    """
    a, b = ("dst", "src") if up else ("src", "dst")
    links = edges.select(F.col(a).alias("at"), F.col(b).alias("to"), "rel_type", F.concat_ws("|", "src", "rel_type", "dst").alias("edge")).distinct()
    front = seeds.where(filled("seed")).select("seed", F.col("seed").alias("at"), F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("types"), F.array().cast("array<string>").alias("used")).distinct()
    levels: list[DataFrame] = []
    for h in range(1, depth + 1):
        nxt = front.join(links, "at").where(~F.array_contains("used", F.col("edge"))).select(
            "seed", F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("types", F.array("rel_type")).alias("types"), F.concat("used", F.array("edge")).alias("used")
        )
        nxt = cut(top_per(nxt, ["seed"], ["nodes", "types"], most))
        levels.append(nxt.withColumn("hop", F.lit(h)))
        if h == depth or nxt.isEmpty():
            break
        full = reduce(DataFrame.unionByName, levels).groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("seed")
        front = nxt.join(full, "seed", "left_anti")
    found = reduce(DataFrame.unionByName, levels).select("seed", "hop", "nodes", "types")
    return top_per(found, ["seed"], ["hop", "nodes", "types"], most)


def sample_paths(seeds: DataFrame, edges: DataFrame, depth: int, most: int) -> DataFrame:
    """The ``most`` (at most 80) shortest trails over all seeds."""
    most = min(most, 80)
    return trails(seeds, edges, depth, most).orderBy("hop", "nodes", "seed", "types").limit(most)
