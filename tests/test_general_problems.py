"""Hot keys, hierarchies and orphans against brute force, with nulls, ties, repeats, empty input and clashing names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeweft.operators.hierarchy import descendants, resolve, with_counts
from codeweft.operators.orphans import orphan_references, orphan_report
from codeweft.operators.prefix import running_start
from codeweft.operators.tree_aggregate import State, heavy_keys, tree_aggregate


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# Tree aggregation


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_tree_aggregate_equals_group_by(spark, fan_in):
    data = [(("hot" if i % 3 else f"k{i % 17}") if i % 50 else None, i, "x") for i in range(2000)]
    df = spark.createDataFrame(data, "dst string, v int, chunk string").repartition(13)
    states = [State("n", "count", F.lit(1)), State("s", "sum", F.col("v")), State("lo", "min", F.col("v")), State("hi", "max", F.col("v"))]
    got = tree_aggregate(df, ["dst"], states, fan_in)
    want = df.groupBy("dst").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert rows(got, "dst", "n", "s", "lo", "hi") == rows(want, "dst", "n", "s", "lo", "hi")


def test_tree_aggregate_clashing_names_and_empty(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k0 string, chunk int")
    assert rows(tree_aggregate(df, ["k0"], [State("chunk", "sum", F.col("chunk"))], 2), "k0", "chunk") == [("a", 3)]
    assert tree_aggregate(df.limit(0), ["k0"], [State("n", "count", F.lit(1))]).count() == 0
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k0"], [], 1)


def test_heavy_keys_ignore_blank_but_count_all_rows(spark):
    df = spark.createDataFrame([("a",)] * 10 + [(None,)] * 80 + [("  ",)] * 9 + [("b",)], "dst string")
    assert rows(heavy_keys(df, "dst", 0.1), "dst", "n") == [("a", 10)]
    assert rows(heavy_keys(df, "dst", 0.01), "dst", "n") == [("a", 10), ("b", 1)]


# Hierarchies


def brute(links):
    parent = {}
    for h, c, p in links:
        if all(x and x.strip() for x in (h, c, p)):
            parent[h, c] = min(p, parent.get((h, c), p))
    out = []
    for h, c in parent:
        seen, x = [], c
        while (h, x) in parent and x not in seen:
            seen.append(x)
            x = parent[h, x]
        if x in seen:
            ring = seen[seen.index(x):]
            out.append((h, c, min(ring), -1 if c in ring else -2))
        else:
            out.append((h, c, x, len(seen)))
    return sorted(out, key=repr)


CASES = {
    "chain": [("t", f"n{i:03}", f"n{i + 1:03}") for i in range(60)],
    "star": [("t", f"c{i}", "root") for i in range(30)],
    "ring with trees": [("t", "a", "b"), ("t", "b", "c"), ("t", "c", "a"), ("t", "d", "a"), ("t", "e", "d"), ("t", "f", "d"), ("t", "z", "y")],
    "self": [("t", "a", "a"), ("t", "b", "a"), ("t", "c", "b")],
    "pair": [("t", "a", "b"), ("t", "b", "a")],
    "dirty": [("t", "a", "b"), ("t", "a", "b"), ("t", None, "b"), ("t", "c", None), ("t", " ", "b"), ("t", "c", ""), ("u", "b", "a"), ("t", "x", "q"), ("t", "x", "p"), (None, "a", "b")],
    "caterpillar": [("t", f"s{i:02}", f"s{i + 1:02}") for i in range(25)] + [("t", f"l{i:02}", f"s{i:02}") for i in range(0, 25, 3)],
}


@pytest.mark.parametrize("name", CASES)
def test_resolve(spark, name):
    df = spark.createDataFrame(CASES[name], "h string, child string, parent string")
    assert rows(resolve(df), "h", "node_id", "root_id", "depth") == brute(CASES[name])


def test_resolve_random_functional_graphs(spark):
    rnd = random.Random(7)
    links = [(f"g{g}", f"v{i:03}", f"v{rnd.randrange(90):03}") for g in range(6) for i in range(90) if rnd.random() < 0.9]
    df = spark.createDataFrame(links, "h string, child string, parent string")
    assert rows(resolve(df), "h", "node_id", "root_id", "depth") == brute(links)


def test_paths_descendants_counts(spark):
    links = CASES["caterpillar"] + CASES["ring with trees"]
    df = spark.createDataFrame(links, "h string, child string, parent string")
    r = resolve(df, paths=True)
    parent = {c: p for _, c, p in links}
    for x in r.collect():
        if x["depth"] < 0:
            assert x["path"] is None
        else:
            walk = [x["node_id"]]
            while walk[-1] in parent:
                walk.append(parent[walk[-1]])
            assert x["path"] == walk[::-1] and x["depth"] == len(walk) - 1
    d = descendants(r)
    assert d.where("ancestor_id = 's25'").count() == 25 + 9
    assert d.where("distance < 1").count() == 0
    assert {x["node_id"]: x["n_descendants"] for x in with_counts(r).collect()}["s01"] == 1 + 1


def test_resolve_empty(spark):
    df = spark.createDataFrame([], "h string, child string, parent string")
    assert resolve(df).count() == 0
    assert resolve(df, paths=True).columns == ["h", "node_id", "root_id", "depth", "path"]


# Orphans


def t(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_orphans(spark):
    parents = [
        ("type", "a", t(5), t(10)), ("type", "a", t(5), t(10)), ("type", "a", t(20), None), ("type", "b", t(9), t(9)), ("type", "lib", None, None),
        ("type", "over", t(1), t(6)), ("type", "over", t(4), t(8)), ("method", "a", t(0), None), ("type", None, t(0), None), ("type", "bad", t(9), t(3)),
    ]
    kids = [
        (1, "src", "type", "a", t(4)), (2, "src", "type", "a", t(5)), (3, "dst", "type", "a", t(10)), (4, "dst", "type", "a", t(30)), (5, "src", "type", "b", t(9)), (6, "src", "type", "lib", t(0)),
        (7, "src", "type", "nope", t(0)), (8, "src", "type", None, t(0)), (9, "src", "type", " ", t(0)), (10, "src", "type", "over", t(5)), (11, "src", "type", "over", t(7)), (12, "src", "type", "over", t(8)),
        (13, "src", "other", "a", t(6)), (14, "src", "type", "a", None), (15, "src", "type", "lib", None), (16, "src", "type", "bad", t(5)),
    ]
    p = spark.createDataFrame(parents, "tbl string, key string, since timestamp_ntz, until timestamp_ntz")
    c = spark.createDataFrame(kids, "ref_id bigint, side string, tbl string, key string, at timestamp_ntz")
    got = orphan_references(c, p)
    assert [x[0] for x in rows(got, "ref_id")] == sorted([1, 3, 5, 7, 12, 13, 14, 16], key=lambda x: repr((x,)))
    # The same with one key so hot that it is salted.
    many = spark.createDataFrame([(100 + i, "src", "type", "a", t(i % 40)) for i in range(3000)], c.schema)
    n = orphan_references(c.unionByName(many), p).where("ref_id >= 100").count()
    assert n == sum(not (5 <= i % 40 < 10 or i % 40 >= 20) for i in range(3000))
    rep = {(r["tbl"], r["side"], r["period"]): r["n_orphans"] for r in orphan_report(got).collect()}
    assert rep["type", "src", None] == 1 and rep["type", "dst", "2024-01"] == 1


def test_orphans_empty(spark):
    p = spark.createDataFrame([], "tbl string, key string, since timestamp_ntz, until timestamp_ntz")
    c = spark.createDataFrame([], "ref_id bigint, side string, tbl string, key string, at timestamp_ntz")
    assert orphan_references(c, p).count() == 0
    one = spark.createDataFrame([(1, "src", "type", "a", t(0))], c.schema)
    assert orphan_references(one, p).count() == 1


def test_running_start(spark):
    data = [(i, "a" if i % 3 else None, None if i % 11 == 0 else i % 7) for i in range(500)]
    df = spark.createDataFrame(data, "id bigint, g string, v int")
    for per in (10, 1000):
        got = running_start(df, ["g"], "id", "v", rows_per_shard=per).collect()
        assert len(got) == 500
        for g in ("a", None):
            part = sorted((r for r in got if r["g"] == g), key=lambda r: r["start"])
            total = 0
            assert sum(r["v"] or 0 for r in part) == max(r["start"] + (r["v"] or 0) for r in part)
            assert sorted(r["start"] for r in part)[0] == total
    a = {r["id"]: r["start"] for r in running_start(df, ["g"], "id", "v", rows_per_shard=10).collect()}
    b = {r["id"]: r["start"] for r in running_start(df, ["g"], "id", "v", rows_per_shard=1000).collect()}
    assert a == b
