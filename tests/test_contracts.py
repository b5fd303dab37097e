"""Blocks on request, notes, groups under one cap, ports, signatures, snippets of nodes."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from codeweft import ports
from codeweft.functions import jsonio, text
from codeweft.operators import context, diff, graph, vector
from codeweft.sources import files


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, rel_type string, dst string")


E = [
    ("a", "CALLS", "b"), ("b", "CALLS", "c"), ("T", "HAS_METHOD", "a"), ("F", "DEFINES_TYPE", "T"), ("P", "CONTAINS_FILE", "F"), ("F", "IMPORTS", "I"), ("T", "DEPENDS_ON", "D"), ("a", "READS_FIELD", "f"), ("S", "EXTENDS", "T"), (None, "CALLS", "a"), ("x", "CALLS", " "),
]


def test_groups_and_cap(spark):
    seeds = spark.createDataFrame([("a",)], "seed string")
    g = graph.expand(seeds, edges(spark, E), groups=graph.EDGE_ORDER + ("TYPE_HIERARCHY",), max_edges=3)
    assert [tuple(r) for r in g["edges"].orderBy("rel_type", "src").collect()] == [("a", "CALLS", "b"), ("b", "CALLS", "c"), ("a", "READS_FIELD", "f")]
    assert [r["warning"] for r in g["warnings"].collect()] == ["more edges than the cap"]
    g = graph.expand(seeds, edges(spark, E), groups=graph.EDGE_ORDER)
    assert {r["rel_type"] for r in g["edges"].collect()} == {"CALLS", "READS_FIELD", "DEPENDS_ON", "IMPORTS", "DEFINES_TYPE", "HAS_METHOD", "CONTAINS_FILE"}
    assert {r["node"] for r in g["side_nodes"].collect()} == {"f", "T", "D", "F", "I", "P"} and g["inheritance"].count() == 0 and g["coupling"].count() == 1
    assert {r["rel_type"] for r in graph.expand(seeds, edges(spark, E))["edges"].collect()} == {"CALLS", "READS_FIELD", "DEPENDS_ON"}
    empty = graph.expand(seeds.limit(0), edges(spark, E).limit(0), groups=graph.EDGE_ORDER)
    assert empty["edges"].count() == 0 and empty["nodes"].count() == 0


def test_compat_labels(spark):
    s, e = spark.createDataFrame([("s",)], "seed string"), edges(spark, [("s", "CALLS", "x"), ("p", "CALLS", "s"), ("x", "CALLS", "y")])
    up, down = graph.hops(s, e, 2, up=True), graph.hops(s, e, 2)
    got = {(r["src"], r["dst"]): (r["hop_from_seed"], r["direction"]) for r in graph.edge_attribution_compat(e, up, down).collect()}
    assert got == {("s", "x"): (1, "upstream"), ("x", "y"): (2, "upstream"), ("p", "s"): (0, "downstream")}
    assert {tuple(r) for r in graph.rank_compat(up, down, s).collect()} == {("s", 0), ("p", 1), ("x", 9999), ("y", 9999)}


def test_blocks_and_notes(spark):
    f = spark.createDataFrame([("F", "rel/F")], "path string, relative_path string")
    v = spark.createDataFrame([("c", "METHOD", "r", [1.0] * 64)], "id string, node_type string, repo_id string, embedding array<float>")
    ask = lambda **k: context.assemble(context.Request("r", method_ids=("a",), queries=("x y",), min_score=-10.0, hits_as_seeds=False, **k), edges(spark, E), f, v)
    assert set(ask(include=frozenset({"summary"}))) == {"seeds", "counts"}
    r = ask(include=frozenset({"semantic"}))["hits"].first()
    assert (r["in_graph"], r["note"]) == (False, "the request has no graph")
    full = ask()
    assert full["hits"].first()["in_graph"] and full["hits"].first()["note"] is None and full["histogram"].count() > 0
    none = spark.createDataFrame([], "node string")
    hit = spark.createDataFrame([("q",)], "id string")
    assert "cut" in context.noted(hit, none, True).first()["note"] and "no seed" in context.noted(hit, none, False).first()["note"]


def test_commit_seeds(spark):
    ci = spark.createDataFrame([("T", "c1"), ("m9", "c1"), ("T", "c2"), ("zz", "c3")], "node string, commit string")
    hm = spark.createDataFrame([("T", "m1"), ("U", "m9")], "type string, method string")
    d = spark.createDataFrame([("c1", "m5"), ("c2", "m6"), ("c3", "m7")], "commit string, method string")
    named = spark.createDataFrame([("c2", "m1")], "commit string, seed string")
    got = {tuple(r) for r in context.commit_seeds(ci, hm, d, named).select("commit", "seed", "source").collect()}
    assert got == {("c1", "m1", "graph"), ("c1", "m9", "graph"), ("c2", "m1", "graph"), ("c2", "m6", "diff"), ("c3", "m7", "diff")}


def test_ports(spark, tmp_path):
    store = ports.Folder(spark, str(tmp_path))
    assert isinstance(store, ports.GraphStore)
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    store.write("Method", df)
    store.write("Method", store.nodes("Method").unionByName(df.withColumn("id", F.lit("b"))))
    assert store.nodes("Method").count() == 2
    store.append("commits", df)
    store.append("commits", df)
    assert spark.read.parquet(f"{tmp_path}/commits").count() == 2
    names = ports.register(spark)
    assert spark.sql(f"select {names[2]}('java.util.List<X>[]') as t, {names[3]}('class A {{ void m(int x) {{}} }}') as m").first() == ("List", ["A#m(int)"])


def test_signed(spark):
    body = b"payload"
    good = "sha256=" + hmac.new(b"k", body, hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(body, good), (body, good[:-1] + "x"), (body, None), (None, good), (body, good[7:])], "b binary, s string")
    assert [r["x"] for r in df.select(text.signed("b", "s", "k").alias("x")).collect()] == [True, False, False, False, False]
    assert not any(r["x"] for r in df.select(text.signed("b", "s", None).alias("x")).collect())


def test_strict_list(spark):
    kind = "array<struct<kind:string>>"
    one = lambda s: spark.createDataFrame([(s,)], "t string").select(jsonio.strict_list(F.col("t"), kind).alias("x")).first()["x"]
    assert one(" ") == [] and one(None) == [] and [r["kind"] for r in one('[{"kind":"METHOD"}]')] == ["METHOD"]
    with pytest.raises(Exception, match="100012"):
        one("{broken")


def test_payloads_of_other_kinds(spark):
    rows = ["", None, "[1]", "nonsense", '{"meta": 3, "nodes": "[{\\"a\\": 1}]", "changedFiles": [1, {"p": 2}], "truncation": {"warnings": ["w"]}}']
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(jsonio.change_payload(F.col("t")).alias("p")).collect()]
    assert all((p["meta"], p["nodes"], p["changedFiles"], p["truncation"], p["repoId"]) == ("{}", [], [], "{}", "") for p in got[:4])
    assert (got[4]["meta"], got[4]["nodes"], len(got[4]["changedFiles"])) == ("{}", ['{"a":1}'], 2) and "w" in got[4]["truncation"]


def test_snippets_of_nodes(spark):
    d = "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n-x\n+y\n@@ -50,2 +50,2 @@\n-p\n+q"
    n = spark.createDataFrame([("f", "n1", 1, 2), ("f", "n2", 50, 51), ("g", "n3", 1, 2), ("f", "n4", None, 2)], "path string, id string, line_start int, line_end int")
    got = {r["id"]: r["snippet"] for r in diff.node_snippets(n, spark.createDataFrame([("f", d)], "path string, diff string"), pad=0).collect()}
    assert "+y" in got["n1"] and "+q" not in got["n1"] and "+q" in got["n2"] and got["n3"] == "" and got["n4"] == d
    assert diff.relevant(d, 5, 1, 0, 10_000) == d and "+q" in diff.relevant(d, 50, 2, 0, 10_000)


def test_search_sorts_no_contents(spark):
    f = spark.createDataFrame([(f"f{i}.java", "x\ny\n", 4) for i in range(9)], "relative_path string, content string, n_bytes int")
    got = files.search(f, "x", max_files=3)
    assert [r["path"] for r in got["hits"].collect()] == ["f0.java", "f1.java", "f2.java"] and got["scanned"].first()["truncated_by_max_files"]
    plan = got["scanned"]._jdf.queryExecution().executedPlan().toString()
    assert not any("TakeOrdered" in x and "content" in x for x in plan.split("\n"))


def test_many_queries(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    v = spark.createDataFrame([(f"v{i}", [float(i == j) for j in range(8)]) for i in range(8)], "id string, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "query_id int, q array<double>")
    assert {(r["query_id"], r["id"]) for r in vector.search(q, v, 1).collect()} == {(i, f"v{i}") for i in range(8)}
