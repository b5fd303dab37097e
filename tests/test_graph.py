"""Traversal, trails, budget and store on small hand-made graphs."""

import random

import pytest
from pyspark.sql import functions as F

from codeweft import errors
from codeweft.operators import context, graph, risk, store, trails
from codeweft.schema import clamp, effective_depth, relation_types

G = {
    "chain": ["ab", "bc", "cd"], "cycle": ["ab", "bc", "ca", "cd"], "self_loop": ["aa", "ab"], "diamond": ["ab", "ac", "bd", "cd"],
}


def edges(spark, pairs, rel="CALLS"):
    return spark.createDataFrame([(p[0], rel, p[1]) for p in pairs], "src string, rel_type string, dst string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_hops(spark):
    assert as_set(graph.hops(seeds(spark, "a"), edges(spark, G["chain"]), 2), "node", "hop") == {("b", 1), ("c", 2)}
    assert as_set(graph.hops(seeds(spark, "a"), edges(spark, G["cycle"]), 5), "node", "hop") == {("b", 1), ("c", 2), ("a", 3), ("d", 3)}
    assert as_set(graph.hops(seeds(spark, "d"), edges(spark, G["diamond"]), 5, up=True), "node", "hop") == {("b", 1), ("c", 1), ("a", 2)}
    assert as_set(graph.reachable(seeds(spark, "a", None, ""), edges(spark, G["self_loop"]), 3), "node") == {("a",), ("b",)}
    assert graph.hops(seeds(spark).limit(0) if False else seeds(spark, "zz"), edges(spark, G["chain"]), 3).count() == 0


def test_trails(spark):
    got = trails.trails(seeds(spark, "a"), edges(spark, G["cycle"]), 4)
    assert {("".join(r["nodes"]), r["hop"]) for r in got.collect()} == {("ab", 1), ("abc", 2), ("abca", 3), ("abcd", 3)}
    got = trails.trails(seeds(spark, "a"), edges(spark, G["self_loop"]), 5)
    assert {"".join(r["nodes"]) for r in got.collect()} == {"aa", "ab", "aab"}
    assert {"".join(r["nodes"]) for r in trails.trails(seeds(spark, "d"), edges(spark, G["diamond"]), 3, up=True).collect()} == {"db", "dc", "dba", "dca"}
    capped = trails.trails(seeds(spark, "a"), edges(spark, [("a", f"x{i}") for i in range(9)]), 3, most=4)
    assert ["".join(r["nodes"]) for r in capped.orderBy("nodes").collect()] == ["ax0", "ax1", "ax2", "ax3"]


def test_min_hop_is_the_shortest_trail(spark):
    rnd = random.Random(3)
    e = edges(spark, {(f"v{rnd.randrange(9)}", f"v{rnd.randrange(9)}") for _ in range(16)})
    s = seeds(spark, "v0", "v1")
    t = trails.trails(s, e, 4, most=10_000).groupBy("seed", F.element_at("nodes", -1).alias("node")).agg(F.min("hop").alias("hop"))
    assert as_set(t, "seed", "node", "hop") == as_set(graph.hops(s, e, 4), "seed", "node", "hop")


def test_attribution(spark):
    s = seeds(spark, "s1", "s2")
    e = edges(spark, [("s1", "x"), ("s2", "x")])
    a = {r["node"]: r for r in graph.attribution(graph.hops(s, e, 2, up=True), graph.hops(s, e, 2), s).collect()}
    assert (a["x"]["primary_seed"], a["x"]["tie"], a["x"]["direction"], a["x"]["min_hops"]) == ("s1", True, "downstream", {"s1": 1, "s2": 1})
    assert a["s1"]["direction"] == "seed"
    s, e = seeds(spark, "s"), edges(spark, [("p", "s"), ("s", "q"), ("q", "p")])
    a = {r["node"]: r["direction"] for r in graph.attribution(graph.hops(s, e, 3, up=True), graph.hops(s, e, 3), s).collect()}
    assert a == {"s": "seed", "p": "lateral", "q": "lateral"}


def test_edge_attribution(spark):
    s, e = seeds(spark, "s", "t"), edges(spark, [("s", "x"), ("x", "y"), ("p", "s"), ("t", "x"), ("far", "away")])
    got = graph.edge_attribution(e, graph.hops(s, e, 2, up=True), graph.hops(s, e, 2))
    assert as_set(got, "src", "dst", "reference_seed", "hop_from_seed", "direction") == {
        ("s", "x", "s", 1, "downstream"), ("x", "y", "s", 2, "downstream"), ("p", "s", "s", 1, "upstream"), ("t", "x", "s", None, "upstream"),
    }


def test_truncate_keeps_seeds(spark):
    n = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2)], "node string, hop int")
    assert as_set(graph.truncate(n, 1), "node") == {("a",), ("b",)}
    assert as_set(graph.truncate(n, 3), "node") == {("a",), ("b",), ("c",)}


def test_scope_and_hub(spark):
    e = edges(spark, ["ab", "bc", "cd"])
    scope = spark.createDataFrame([("a",), ("b",)], "node string")
    assert as_set(graph.induced(e, scope), "src", "dst") == {("a", "b")}
    assert graph.touching(e, scope).count() == 2 and graph.touching(e, scope, compat=True).count() == 3
    acc = edges(spark, [("m1", "f")], "READS_FIELD").unionByName(edges(spark, [("m2", "f"), ("m1", "f")], "WRITES_FIELD"))
    assert as_set(graph.through_hub(acc, seeds(spark, "m1")), "other", "first_type", "second_type") == {("m2", "READS_FIELD", "WRITES_FIELD"), ("m2", "WRITES_FIELD", "WRITES_FIELD")}
    f = graph.field_coupling(acc).first()
    assert (f["readers"], f["writers"]) == (["m1"], ["m1", "m2"])


def test_budget():
    assert risk.accept([(5, ["a", "b"]), (1, ["c"])], max_hops=4) == [False, True]
    assert risk.accept([(1, ["a", "b"]), (1, ["a", "c"]), (1, ["a"])], max_nodes=2) == [True, False, True]


def test_budget_is_never_exceeded(spark):
    rnd = random.Random(1)
    rows = [(0, i % 7, i % 3, rnd.randrange(1, 6), [f"n{rnd.randrange(40)}" for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "request int, seed_pos int, cat_ord int, hop int, nodes array<string>")
    got = risk.budget(df, ["request"], 20, 60).where("accepted").collect()
    assert sum(r["hop"] for r in got) <= 60 and len({n for r in got for n in r["nodes"]}) <= 20 and got


def test_propagate(spark):
    e = edges(spark, ["ab", "bc"]).unionByName(edges(spark, [("T", "a")], "HAS_METHOD"))
    known = spark.createDataFrame([("Method", "a"), ("Type", "T")], "label string, key string")
    req = spark.createDataFrame([(1, "method", "a"), (2, "METHOD", "zz"), (3, "ODD", "a"), (4, "TYPE", None)], "seed_pos int, kind string, seed string")
    got, seen = risk.propagate(req, e, known, 2)
    assert as_set(got, "category", "hop") == {("CALLS_DOWN", 1), ("CALLS_DOWN", 2), ("OWNER", 1)}
    assert {r["seed_pos"]: r["warning"] for r in seen.collect()} == {1: None, 2: "not in graph", 3: "unknown kind", 4: "name missing"}


@pytest.mark.parametrize("asked,want", [(None, 30), (100, 30), (30, 30), (5, 5), (1, 1), (0, 30), (-3, 30)])
def test_depth(asked, want):
    assert effective_depth(asked) == want


def test_groups_and_clamp():
    assert relation_types(None) == ("CALLS", "EXTENDS", "IMPLEMENTS", "READS_FIELD", "WRITES_FIELD", "DEPENDS_ON")
    assert clamp(None, 10, 1, 100) == 10 and clamp(999, 10, 1, 100) == 100 and clamp(-1, 10, 1, 100) == 1


def test_store(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, o int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", None, 1)], old.schema)
    once = store.upsert(old, new, ["k"], ["o"])
    assert as_set(once, "k", "v") == {("a", 3), ("b", 1), ("c", None)}
    assert as_set(store.upsert(once, new, ["k"], ["o"]), "k", "v") == as_set(once, "k", "v")
    assert as_set(store.delete(old, spark.createDataFrame([("a",), (None,), (" ",)], "k string"), "k"), "k") == {("b",)}
    e = edges(spark, [("f", "T")], "DEFINES_TYPE").unionByName(edges(spark, [("T", "m")], "HAS_METHOD")).unionByName(edges(spark, [("x", "m"), ("m", "y"), ("x", "y")]))
    p = spark.createDataFrame([("f",)], "path string")
    assert as_set(store.delete_files(e, p), "src", "dst") == {("x", "y")}
    assert as_set(store.delete_outgoing(e, p), "src", "dst") == {("x", "m"), ("x", "y")}
    ends = spark.createDataFrame([("x",), ("y",)], "key string")
    assert as_set(store.known_ends(e, ends), "src", "dst") == {("x", "y")}


def test_context_contract(spark):
    with pytest.raises(errors.EngineError) as x:
        context.Request("  ", queries=("q",)).check()
    assert x.value.code == 100001
    with pytest.raises(errors.EngineError) as x:
        context.Request("r").check()
    assert x.value.code == 100005
    a, b = seeds(spark, "m", "n", None, " "), seeds(spark, "n", "o")
    assert as_set(context.seed_union(("request", a), ("semantic", b)), "seed", "provenance") == {("m", "request"), ("n", "request"), ("o", "semantic")}


def test_context_assembly(spark):
    e = edges(spark, ["ab", "bc"]).unionByName(edges(spark, [("T", "a")], "HAS_METHOD")).unionByName(edges(spark, [("F", "T")], "DEFINES_TYPE"))
    f = spark.createDataFrame([("F", "rel/F")], "path string, relative_path string")
    v = spark.createDataFrame([("c", "METHOD", "r", [1.0] * 64), ("z", "METHOD", "other", [1.0] * 64)], "id string, node_type string, repo_id string, embedding array<float>")
    got = context.assemble(context.Request("r", file_paths=("rel/F",), queries=("x y",), min_score=-10.0), e, f, v)
    assert as_set(got["seeds"], "seed", "provenance") == {("a", "request"), ("c", "semantic")}
    assert as_set(got["calls"], "src", "dst") == {("a", "b"), ("b", "c")}
    assert {r["what"]: r["n"] for r in got["counts"].collect()}["hits"] == 1
    none = context.assemble(context.Request("r", queries=("x",), hits_as_seeds=False), e, f, v)
    assert none["nodes"].count() == 0 and none["seeds"].count() == 0
