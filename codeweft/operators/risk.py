"""Risk propagation: chains of six kinds per seed under one greedy budget."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.graph import edge_view, top_per
from codeweft.operators.trails import trails
from codeweft.schema import effective_depth

MAX_NODES, MAX_HOPS, PER_CATEGORY = 500, 2000, 80
CHAINS = "seed string, category string, cat_ord int, hop int, nodes array<string>, types array<string>, keys array<string>"
# Kinds of the nodes of a chain, by category; the last one goes on.
_KINDS = {
    "CALLS_UP": ("METHOD",), "CALLS_DOWN": ("METHOD",), "FIELD_SHARED": ("METHOD", "FIELD", "METHOD"), "FIELD_ACCESS": ("METHOD", "FIELD"), "MEMBER_METHODS": ("TYPE", "METHOD"), "MEMBER_FIELDS": ("TYPE", "FIELD"),
    "SUBTYPES": ("TYPE",), "SUPERTYPES": ("TYPE",), "DEPENDS_OUT": ("TYPE",), "DEPENDS_IN": ("TYPE",), "FIELD_ACCESSORS": ("FIELD", "METHOD"), "METHOD_OWNER": ("METHOD", "TYPE"), "FIELD_OWNER": ("FIELD", "TYPE"),
}


def accept(chains: Iterable[tuple[int, list[str]]], max_nodes: int = MAX_NODES, max_hops: int = MAX_HOPS) -> list[bool]:
    """Greedy in order: a chain that does not fit is skipped, later smaller ones may still fit."""
    seen: set[str] = set()
    used, out = 0, []
    for hop, nodes in chains:
        fresh = set(nodes) - seen
        ok = len(seen) + len(fresh) <= max_nodes and used + hop <= max_hops
        if ok:
            seen |= fresh
            used += hop
        out.append(ok)
    return out


def budget(chains: DataFrame, by: list[str], max_nodes: int = MAX_NODES, max_hops: int = MAX_HOPS) -> DataFrame:
    """``chains`` with ``accepted``, per request ``by``: needs seed_pos, cat_ord, hop, nodes, and keys where nodes of different kinds may share a name.

    Order: seed position, category, hop, path. A request's chains are bounded
    by its seeds times categories times PER_CATEGORY, so one task can hold them.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in chains.dtypes) + ", accepted boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_p=[tuple(x) for x in pdf["nodes"]]).sort_values(["seed_pos", "cat_ord", "hop", "_p"], kind="stable").drop(columns="_p")
        return pdf.assign(accepted=accept(zip(pdf["hop"], map(list, pdf["keys" if "keys" in pdf else "nodes"])), max_nodes, max_hops))

    return chains.groupBy(*by).applyInPandas(run, schema)


def chains(seeds: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """All chain categories of ``seeds`` (seed, kind), in budget order: see CHAINS.

    METHOD: calls up, calls down, fields shared, fields used, owner. TYPE:
    methods, fields, subtypes, supertypes, depends out, depends in. FIELD:
    accessors, owner. Other kinds have none.
    """
    d = effective_depth(depth)
    of = lambda k: seeds.where(F.upper("kind") == k).select("seed").distinct()
    method, type_, fld = of("METHOD"), of("TYPE"), of("FIELD")
    calls, hier, dep = edge_view(edges, "CALLS"), edge_view(edges, "EXTENDS", "IMPLEMENTS"), edge_view(edges, "DEPENDS_ON")
    access, own = edge_view(edges, "READS_FIELD", "WRITES_FIELD"), edge_view(edges, "HAS_METHOD", "HAS_FIELD")
    out: list[DataFrame] = []

    def add(name: str, ordinal: int, rows: DataFrame, kinds: str | None = None) -> None:
        ks = _KINDS[kinds or name]
        keys = F.transform("nodes", lambda x, i: F.concat(F.get(F.array(*map(F.lit, ks)), F.least(i, F.lit(len(ks) - 1))), F.lit("|"), x))
        out.append(rows.select("seed", F.lit(name).alias("category"), F.lit(ordinal).alias("cat_ord"), "hop", "nodes", "types", keys.alias("keys")))

    def one(name: str, ordinal: int, some: DataFrame, e: DataFrame, up: bool, most: int = 200, kinds: str | None = None) -> None:
        a, b = ("dst", "src") if up else ("src", "dst")
        rows = e.join(some.select(F.col("seed").alias(a)), a).select(F.col(a).alias("seed"), F.lit(1).alias("hop"), F.array(a, b).alias("nodes"), F.array("rel_type").alias("types"))
        add(name, ordinal, top_per(rows, ["seed"], ["nodes", "types"], most), kinds)

    add("CALLS_UP", 0, trails(method, calls, d, PER_CATEGORY, up=True))
    add("CALLS_DOWN", 1, trails(method, calls, d, PER_CATEGORY))
    first = access.join(method.withColumnRenamed("seed", "src"), "src").select(F.col("src").alias("seed"), F.col("dst").alias("f"), F.col("rel_type").alias("t1"))
    second = access.select(F.col("dst").alias("f"), F.col("src").alias("o"), F.col("rel_type").alias("t2"))
    shared = first.join(second, "f").where("o <> seed").select("seed", F.lit(2).alias("hop"), F.array("seed", "f", "o").alias("nodes"), F.array("t1", "t2").alias("types"))
    add("FIELD_SHARED", 2, top_per(shared, ["seed"], ["nodes", "types"], 200))
    one("FIELD_ACCESS", 3, method, access, False)
    one("OWNER", 4, method, own, True, 1, "METHOD_OWNER")
    one("MEMBER_METHODS", 0, type_, edge_view(edges, "HAS_METHOD"), False)
    one("MEMBER_FIELDS", 1, type_, edge_view(edges, "HAS_FIELD"), False)
    add("SUBTYPES", 2, trails(type_, hier, d, PER_CATEGORY, up=True))
    add("SUPERTYPES", 3, trails(type_, hier, d, PER_CATEGORY))
    add("DEPENDS_OUT", 4, trails(type_, dep, d, PER_CATEGORY))
    add("DEPENDS_IN", 5, trails(type_, dep, d, PER_CATEGORY, up=True))
    one("FIELD_ACCESSORS", 0, fld, access, True, 300)
    one("OWNER", 1, fld, own, True, 1, "FIELD_OWNER")
    return reduce(DataFrame.unionByName, out)


def propagate(request: DataFrame, edges: DataFrame, known: DataFrame, depth: int | None = None, max_nodes: int = MAX_NODES, max_hops: int = MAX_HOPS) -> tuple[DataFrame, DataFrame]:
    """(accepted chains, seeds with ``matched`` and ``warning``) of requests (seed_pos, kind, seed), each with its own budget.

    Rows may carry a ``request``; without one they are a single request.
    ``known``: (label, key) of the nodes in the graph. Seeds without a name,
    of an unknown kind or not in the graph become warnings. Chains are found
    once per seed, however many requests name it.
    """
    if "request" not in request.columns:
        request = request.withColumn("request", F.lit(0))
    kinds = {"METHOD": "Method", "TYPE": "Type", "FIELD": "Field"}
    label = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.upper(F.trim("kind")))
    r = request.select("request", "seed_pos", F.upper(F.trim("kind")).alias("kind"), F.trim("seed").alias("seed")).withColumn("label", label)
    k = known.select("label", F.col("key").alias("seed"), F.lit(True).alias("hit")).distinct()
    r = r.join(k, ["label", "seed"], "left")
    warning = F.when(F.coalesce("seed", F.lit("")) == "", "name missing").when(F.col("label").isNull(), "unknown kind").when(F.col("hit").isNull(), "not in graph")
    r = r.select("request", "seed_pos", "kind", "seed", F.coalesce("hit", F.lit(False)).alias("matched"), warning.alias("warning"))
    good = r.where("matched").groupBy("request", "kind", "seed").agg(F.min("seed_pos").alias("seed_pos"))
    all_ = chains(good.select("seed", "kind").distinct(), edges, depth).join(good.select("request", "seed", "seed_pos").distinct(), "seed")
    done = budget(all_, ["request"], max_nodes, max_hops)
    return done.where("accepted").drop("accepted"), r
