"""Forests of unknown depth from parent links, by tree contraction.

Contraction alternates two moves until no link is left: *rake* takes away all
leaves, *compress* splices out an independent set of nodes that have exactly
one child. Every removed node is recorded together with the link it had when
it went. The records are then replayed backwards: when a node comes back, the
node it hung on is already resolved. A chain of any length shrinks by a third
per round, a bushy tree loses its whole fringe, so the number of rounds is
logarithmic. Links on a cycle are never raked; compression shrinks each cycle
to a link of a node to itself, which is the proof that it is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut, filled

ON_CYCLE, BELOW_CYCLE = -1, -2


def _prio(node: str, round_no: int) -> Column:
    return F.xxhash64(F.col("h"), F.col(node), F.lit(round_no))


def resolve(links: DataFrame, paths: bool = False, max_rounds: int = 400) -> DataFrame:
    """Root, depth and state of every node that has a parent.

    ``links`` has (h, child, parent): hierarchy, node, parent. Links with a
    null or blank end are ignored, repeated ones count once, and where a node
    has several parents the smallest one (by code point) is its parent.

    Gives (h, node_id, root_id, depth) and, with ``paths``, ``path``: the nodes
    from the root down to the node. On a cycle depth is -1, in a chain that
    runs up into one it is -2; root_id is then the smallest node of the cycle
    and the path is null. Empty input, empty result.
    """
    live = (
        links.where(filled("h") & filled("child") & filled("parent"))
        .groupBy("h", F.col("child").alias("c"))
        .agg(F.min("parent").alias("p"))
        .select("h", "c", "p", F.lit(1).alias("w"), F.col("c").alias("lo"), *([F.array().cast("array<string>").alias("via")] if paths else []))
    )
    live = cut(live)
    records: list[DataFrame] = []
    cores: list[DataFrame] = []
    for r in range(max_rounds):
        if live.isEmpty():
            break
        loops = live.where("c = p").select("h", "c", "lo")
        rest = live.where("c <> p")
        below = rest.groupBy("h", F.col("p").alias("c")).agg(F.count("*").alias("k"), F.min("c").alias("u"))
        marked = rest.join(below, ["h", "c"], "left")
        pick = (F.col("k") == 1) & (_prio("c", r) < _prio("u", r)) & (_prio("c", r) < _prio("p", r))
        marked = marked.withColumn("go", F.when(F.col("k").isNull(), "R").when(pick, "C"))
        marked = cut(marked.unionByName(loops.withColumn("go", F.lit("L")), allowMissingColumns=True))
        cores.append(marked.where("go = 'L'").select("h", "c", "lo"))
        gone = marked.where("go in ('R', 'C')").select("h", "c", "p", "w", "u", "go", *(["via"] if paths else []))
        records.append(gone)
        splice = marked.where("go = 'C'").select("h", F.col("u").alias("c"), F.col("p").alias("p2"), F.col("w").alias("w2"), F.least("lo", "c").alias("lo2"), *([F.concat(F.array("c"), "via").alias("via2")] if paths else []))
        kept = marked.where("go is null").join(splice, ["h", "c"], "left")
        live = cut(
            kept.select(
                "h", "c", F.coalesce("p2", "p").alias("p"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.least("lo", "lo2").alias("lo"),
                *([F.when(F.col("via2").isNull(), F.col("via")).otherwise(F.concat("via", "via2")).alias("via")] if paths else []),
            )
        )
    else:
        raise RuntimeError("contraction did not end")

    nopath = F.lit(None).cast("array<string>")
    state = reduce(DataFrame.unionByName, cores).select("h", F.col("c").alias("node_id"), F.col("lo").alias("root_id"), F.lit(ON_CYCLE).alias("depth"), *([nopath.alias("path")] if paths else [])) if cores else None
    if state is None:
        schema = "h string, node_id string, root_id string, depth int" + (", path array<string>" if paths else "")
        return links.sparkSession.createDataFrame([], schema)
    for back in reversed(records):
        # Spliced nodes first: a leaf may have been raked off a node that was spliced in the same round.
        spliced = back.where("go = 'C'")
        # A spliced node lies on a cycle exactly if its only child does.
        ring = state.where(F.col("depth") == ON_CYCLE).select("h", F.col("node_id").alias("u"), F.lit(True).alias("ring"))
        state = state.unionByName(_back(spliced.join(ring, ["h", "u"], "left"), state, paths))
        raked = back.where("go = 'R'").withColumn("ring", F.lit(None).cast("boolean"))
        state = cut(state.unionByName(_back(raked, state, paths)))
    return state


def _back(gone: DataFrame, state: DataFrame, paths: bool) -> DataFrame:
    """The state of removed nodes, each from the node it hung on; one without state is a root."""
    up = state.select("h", F.col("node_id").alias("p"), F.col("root_id").alias("pr"), F.col("depth").alias("pd"), *([F.col("path").alias("pp")] if paths else []))
    depth = F.when(F.col("ring"), ON_CYCLE).when(F.col("pd") < 0, BELOW_CYCLE).otherwise(F.coalesce("pd", F.lit(0)) + F.col("w"))
    path = F.when(F.coalesce("pd", F.lit(0)) >= 0, F.concat(F.coalesce("pp", F.array("p")), F.reverse("via"), F.array("c"))) if paths else None
    return gone.join(up, ["h", "p"], "left").select(
        "h", F.col("c").alias("node_id"), F.coalesce("pr", "p").alias("root_id"), depth.cast("int").alias("depth"), *([path.alias("path")] if paths else [])
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor_id, node_id, distance) of a forest resolved with paths.

    As many rows as the depths add up to; nodes on or below a cycle have none.
    """
    up = resolved.where("path is not null").select("h", "node_id", F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor_id"))
    return up.where("at < n - 1").select("h", "ancestor_id", "node_id", (F.col("n") - 1 - F.col("at")).alias("distance"))


def with_counts(resolved: DataFrame) -> DataFrame:
    """``resolved`` plus ``n_descendants``; partial counts are formed before the shuffle."""
    n = descendants(resolved).groupBy("h", F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n_descendants"))
    return resolved.join(n, ["h", "node_id"], "left").fillna(0, ["n_descendants"])
