"""Bounded traversal and typed neighbourhoods over edges (src, rel_type, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.schema import DEFAULT_GROUPS
from codeweft.session import cut, filled

CONTEXT_HOPS, IMPACT_HOPS = 8, 5


def edge_view(edges: DataFrame, *types: str) -> DataFrame:
    """Distinct relations (src, rel_type, dst), both ends filled; the identity of an edge is these three."""
    e = edges.where(F.col("rel_type").isin(*types)) if types else edges
    return e.where(filled("src") & filled("dst")).select("src", "rel_type", "dst").distinct()


def hops(seeds: DataFrame, edges: DataFrame, most: int, up: bool = False) -> DataFrame:
    """(seed, node, hop): fewest links from each seed, 1..most; a seed on a cycle reaches itself.

    ``seeds``: (seed). Level by level; a pair that an earlier level reached is
    not expanded again, so the work is bounded by the reached pairs.
    """
    a, b = ("dst", "src") if up else ("src", "dst")
    links = _links(edges, a, b, most)
    level = seeds.where(filled("seed")).select("seed", F.col("seed").alias("at")).distinct()
    done: DataFrame | None = None
    for h in range(1, most + 1):
        nxt = level.join(links, "at").select("seed", "node").distinct()
        if done is not None:
            nxt = nxt.join(done.select("seed", "node"), ["seed", "node"], "left_anti")
        nxt = cut(nxt.withColumn("hop", F.lit(h)))
        done = nxt if done is None else done.unionByName(nxt)
        if nxt.isEmpty():
            break
        level = nxt.select("seed", F.col("node").alias("at"))
    return seeds.select("seed", F.col("seed").alias("node"), F.lit(1).alias("hop")).limit(0) if done is None else done


def _links(edges: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """(at, node): the distinct links, written down where several levels read them."""
    links = edges.select(F.col(a).alias("at"), F.col(b).alias("node")).distinct()
    return cut(links) if most > 1 else links


def reachable(seeds: DataFrame, edges: DataFrame, most: int, up: bool = False) -> DataFrame:
    """(node): everything within ``most`` links of any seed."""
    one = seeds.select("seed")
    a, b = ("dst", "src") if up else ("src", "dst")
    links = _links(edges, a, b, most)
    level = one.where(filled("seed")).select(F.col("seed").alias("at")).distinct()
    done: DataFrame | None = None
    for _ in range(most):
        nxt = level.join(links, "at").select("node").distinct()
        if done is not None:
            nxt = nxt.join(done, "node", "left_anti")
        nxt = cut(nxt)
        done = nxt if done is None else done.unionByName(nxt)
        if nxt.isEmpty():
            break
        level = nxt.select(F.col("node").alias("at"))
    return done


def attribution(up: DataFrame, down: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per node: primary seed (fewest hops, then name), its hop, tie flag, direction and {seed: hop}.

    Seeds count with hop 0. Direction to the primary seed: seed, lateral (up
    and down), upstream or downstream.
    """
    zero = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct()
    rows = up.withColumn("way", F.lit("u")).unionByName(down.withColumn("way", F.lit("d"))).unionByName(zero.withColumn("way", F.lit("s")))
    per = rows.groupBy("node", "seed").agg(F.min("hop").alias("hop"), F.max(F.col("way") == "u").alias("is_up"), F.max(F.col("way") == "d").alias("is_down"), F.max(F.col("way") == "s").alias("is_seed"))
    best = per.groupBy("node").agg(
        F.min(F.struct("hop", "seed", "is_up", "is_down", "is_seed")).alias("b"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("seed", "hop")))).alias("min_hops"),
    )
    tie = F.size(F.filter(F.map_values("min_hops"), lambda h: h == F.col("b.hop"))) > 1
    way = F.when(F.col("b.is_seed"), "seed").when(F.col("b.is_up") & F.col("b.is_down"), "lateral").when(F.col("b.is_up"), "upstream").otherwise("downstream")
    return best.select("node", F.col("b.seed").alias("primary_seed"), F.col("b.hop").alias("hop"), tie.alias("tie"), way.alias("direction"), "min_hops")


def edge_attribution(calls: DataFrame, up: DataFrame, down: DataFrame) -> DataFrame:
    """Per call edge the seed it is closest to: (src, dst, reference_seed, hop_from_seed, direction).

    Closest is the smallest of the four distances of its ends, then the seed's
    name. Downstream edges are those whose ends are reached downstream, their
    hop is that of dst; upstream ones take the hop of src. Edges that no seed
    reaches have no row.
    """
    # The closest seed of an edge is the closest of one of its ends, so ends are reduced to one candidate before edges meet them.
    near = up.unionByName(down).groupBy("node").agg(F.min(F.struct("hop", "seed")).alias("b"))
    e = calls.select("src", "dst").distinct()
    for side in ("src", "dst"):
        e = e.join(near.select(F.col("node").alias(side), F.col("b").alias(f"b_{side}")), side, "left")
    e = e.withColumn("b", F.least("b_src", "b_dst")).where("b is not null").select("src", "dst", F.col("b.seed").alias("seed"))
    for name, df, side in (("u_src", up, "src"), ("d_src", down, "src"), ("d_dst", down, "dst")):
        e = e.join(df.select("seed", F.col("node").alias(side), F.col("hop").alias(name)), ["seed", side], "left")
    below = F.col("d_dst").isNotNull() & (F.col("d_src").isNotNull() | (F.col("src") == F.col("seed")))
    return e.select("src", "dst", F.col("seed").alias("reference_seed"), F.when(below, F.col("d_dst")).otherwise(F.col("u_src")).alias("hop_from_seed"), F.when(below, "downstream").otherwise("upstream").alias("direction"))


def truncate(nodes: DataFrame, most: int) -> DataFrame:
    """All seeds, then the nearest nodes up to ``most`` in all; needs (node, hop), seeds have hop 0."""
    ranked = nodes.select("node", "hop").orderBy("hop", "node").limit(most)
    seeds = nodes.where("hop = 0").select("node", "hop")
    return ranked.unionByName(seeds).distinct()


def induced(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """Edges with both ends in ``scope`` (node)."""
    s = scope.select("node").distinct()
    return edges.join(s.withColumnRenamed("node", "src"), "src", "left_semi").join(s.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "rel_type", "dst")


def touching(edges: DataFrame, scope: DataFrame, compat: bool = False) -> DataFrame:
    """Edges with an end in ``scope``: a union of two equi-joins. ``compat`` keeps an edge twice that has both ends there."""
    s = scope.select("node").distinct()
    both = edges.join(s.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(s.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    both = both.select("src", "rel_type", "dst")
    return both if compat else both.distinct()


def field_coupling(access: DataFrame) -> DataFrame:
    """Readers and writers per field, from READS_FIELD and WRITES_FIELD edges.

    Sets per (field, bucket of readers) are formed first, so a field that
    everything reads is not gathered from raw rows by one task.
    """
    part = access.groupBy("dst", "rel_type", F.pmod(F.xxhash64("src"), F.lit(64)).alias("b")).agg(F.collect_set("src").alias("s"))
    side = lambda t: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rel_type") == t, F.col("s"))))))
    return part.groupBy(F.col("dst").alias("field")).agg(side("READS_FIELD").alias("readers"), side("WRITES_FIELD").alias("writers"))


def through_hub(access: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, field, other, first_type, second_type): methods that share a field with a seed method."""
    mine = access.join(F.broadcast(seeds.select(F.col("seed").alias("src")).distinct()), "src").select(F.col("src").alias("seed"), F.col("dst").alias("field"), F.col("rel_type").alias("first_type"))
    theirs = access.select(F.col("src").alias("other"), F.col("dst").alias("field"), F.col("rel_type").alias("second_type"))
    return mine.join(theirs, "field").where("other <> seed").select("seed", "field", "other", "first_type", "second_type")


def top_per(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark limits groups before the shuffle, so hot groups stay small."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def edge_attribution_compat(calls: DataFrame, up: DataFrame, down: DataFrame) -> DataFrame:
    """``edge_attribution`` with the original labels: an edge is downstream if its end is reached no later than its start.

    A seed is reached at 0, so an edge that leaves it is called upstream, as
    are all that lead away from it. Nothing reached counts as infinitely far:
    an edge with neither end downstream is called downstream, with the largest
    integer as its hop.
    """
    far = F.lit(2**31 - 1)
    zero = up.unionByName(down).select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    down = down.unionByName(zero).groupBy("seed", "node").agg(F.min("hop").alias("hop"))
    e = edge_attribution(calls, up, down.where("hop > 0")).select("src", "dst", F.col("reference_seed").alias("seed"))
    for name, side in (("d_src", "src"), ("d_dst", "dst")):
        e = e.join(down.select("seed", F.col("node").alias(side), F.col("hop").alias(name)), ["seed", side], "left")
    a, b = F.coalesce("d_src", far), F.coalesce("d_dst", far)
    hop = F.least(b, F.when(a == far, b).otherwise(a + 1))
    return e.select("src", "dst", F.col("seed").alias("reference_seed"), hop.alias("hop_from_seed"), F.when(b <= a, "downstream").otherwise("upstream").alias("direction"))


def rank_compat(up: DataFrame, down: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, hop) for ``truncate`` with the original ranking: only seeds that reach a node upstream count, others leave it at 9999."""
    u = up.select("node", "seed", F.col("hop").alias("u"))
    d = down.select("node", "seed", F.col("hop").alias("d"))
    both = u.join(d, ["node", "seed"], "full_outer").groupBy("node").agg(F.min(F.when(F.col("u").isNotNull(), F.least("u", "d"))).alias("hop"))
    zero = seeds.select(F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct()
    return both.join(zero.select("node"), "node", "left_anti").select("node", F.coalesce("hop", F.lit(9999)).alias("hop")).unionByName(zero)


#: The order in which groups of edges fill the cap.
EDGE_ORDER = ("CALL_CHAIN", "FIELD_ACCESS", "TYPE_DEPENDS", "IMPORTS", "STRUCTURE")
MOST_IMPORTS, MOST_STRUCTURE = 200, 500


def group_edges(nodes: DataFrame, owners: DataFrame, edges: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(group_ord, src, rel_type, dst) of the chosen groups around the methods ``nodes`` (node) and their types ``owners`` (node), distinct.

    Imports and structure are those of the first MOST_IMPORTS and
    MOST_STRUCTURE rows in order of their keys.
    """
    methods = nodes.select("node").distinct()
    types = owners.select("node").distinct()
    none = edges.select("src", "rel_type", "dst").limit(0)
    imported, struct = none, none
    if "IMPORTS" in groups:
        df = edge_view(edges, "DEFINES_TYPE").join(types.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src").distinct()
        imported = edge_view(edges, "IMPORTS").join(df, "src", "left_semi").orderBy("src", "dst").limit(MOST_IMPORTS)
    if "STRUCTURE" in groups:
        hm = edge_view(edges, "HAS_METHOD").join(methods.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("t"), F.col("dst").alias("m"))
        rows = hm.join(edge_view(edges, "DEFINES_TYPE").select(F.col("src").alias("f"), F.col("dst").alias("t")), "t")
        rows = rows.join(edge_view(edges, "CONTAINS_FILE").select(F.col("src").alias("p"), F.col("dst").alias("f")), "f", "left")
        rows = rows.orderBy("m", "t", "f", F.col("p").asc_nulls_last()).limit(MOST_STRUCTURE)
        link = lambda a, rel, b: F.struct(F.col(a).alias("src"), F.lit(rel).alias("rel_type"), F.col(b).alias("dst"))
        struct = rows.select(F.inline(F.array(link("f", "DEFINES_TYPE", "t"), link("t", "HAS_METHOD", "m"), link("p", "CONTAINS_FILE", "f")))).where("src is not null").distinct()
    parts = {
        "CALL_CHAIN": lambda: induced(edge_view(edges, "CALLS"), methods),
        "FIELD_ACCESS": lambda: edge_view(edges, "READS_FIELD", "WRITES_FIELD").join(methods.withColumnRenamed("node", "src"), "src", "left_semi"),
        "TYPE_DEPENDS": lambda: touching(edge_view(edges, "DEPENDS_ON"), types), "IMPORTS": lambda: imported, "STRUCTURE": lambda: struct,
    }
    out = none.select(F.lit(0).alias("group_ord"), "src", "rel_type", "dst")
    for i, g in enumerate(EDGE_ORDER):
        if g in groups:
            out = out.unionByName(parts[g]().select(F.lit(i).alias("group_ord"), "src", "rel_type", "dst"))
    return out


def capped_edges(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of ``group_edges`` over all groups, in the order of EDGE_ORDER."""
    return rows.orderBy("group_ord", "src", "rel_type", "dst").limit(most)


def side_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): ends of ``edges`` that ``nodes`` (node) does not have yet."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti")


def expand(
    seeds: DataFrame, edges: DataFrame, up_hops: int = 3, down_hops: int = 3, max_nodes: int = 500, max_edges: int = 2000, groups: tuple[str, ...] | None = None,
) -> dict[str, DataFrame]:
    """The context sub-graph of ``seeds`` for relation groups: nodes, edges, inheritance, coupling, types, side_nodes, warnings.

    The node cap bounds methods only; types, fields, files and packages of
    edges are added afterwards as side nodes. One cap bounds calls, field
    accesses, dependencies, imports and structure together, in this order;
    inheritance is outside of it. ``calls`` and ``depends`` are those parts of
    the capped edges. Groups that were not asked for have no rows.
    """
    groups = groups or DEFAULT_GROUPS
    up_hops, down_hops = (max(1, min(CONTEXT_HOPS, h)) for h in (up_hops, down_hops))
    calls = edge_view(edges, "CALLS")
    up, down = hops(seeds, calls, up_hops, up=True), hops(seeds, calls, down_hops)
    attr = cut(attribution(up, down, seeds))
    nodes = cut(truncate(attr, max_nodes))
    owners = edge_view(edges, "HAS_METHOD").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    all_edges = cut(group_edges(nodes, owners, edges, groups))
    chosen = cut(capped_edges(all_edges, max_edges))
    hierarchy = touching(edge_view(edges, "EXTENDS", "IMPLEMENTS"), owners) if "TYPE_HIERARCHY" in groups else all_edges.select("src", "rel_type", "dst").limit(0)
    access = edge_view(edges, "READS_FIELD", "WRITES_FIELD").join(nodes.select(F.col("node").alias("src")), "src", "left_semi") if "FIELD_ACCESS" in groups else all_edges.select("src", "rel_type", "dst").limit(0)
    plain = chosen.select("src", "rel_type", "dst")
    over = all_edges.agg((F.count("*") > max_edges).alias("hit")).select(F.lit("more edges than the cap").alias("warning"), "hit")
    over = over.unionByName(attr.agg((F.count("*") > max_nodes).alias("hit")).select(F.lit("more nodes than the cap").alias("warning"), "hit")).where("hit").select("warning")
    return {
        "nodes": nodes.join(attr.drop("hop"), "node"), "edges": plain, "calls": plain.where("rel_type = 'CALLS'"), "depends": plain.where("rel_type = 'DEPENDS_ON'"),
        "inheritance": hierarchy, "coupling": field_coupling(access), "types": owners, "side_nodes": side_nodes(nodes, plain.unionByName(hierarchy)), "warnings": over,
    }
