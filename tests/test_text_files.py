"""Text, JSON, diff, file, parser and stream operators."""

import json

import pytest
from pyspark.sql import functions as F

from codeweft import errors
from codeweft.functions import jsonio, text
from codeweft.operators import diff, index, vector
from codeweft.sources import files, ingest
from codeweft.sources import javaparse as J
from codeweft.streaming import commits


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("url", ["https://github.com/Org/Repo.git/", "git@github.com:org/repo.git"])
def test_clone_url(spark, url):
    assert one(spark, text.clone_url("u"), u=url) == "https://github.com/org/repo"


def test_scalars(spark):
    assert one(spark, text.branch_of("r"), r="refs/heads/a/b") == "a/b"
    assert [one(spark, text.simple_type("t"), t=t) for t in ("java.util.List<X>[]", "int[]", "Map.Entry<A, B>", "<T>")] == ["List", "int", "Entry", "<T>"]
    assert one(spark, text.method_id(F.lit("p.A"), F.lit("m"), F.array(F.lit("java.util.List<X>"), F.lit("int[]")))) == "p.A#m(List,int)"
    assert [one(spark, text.null_sha("s"), s=s) for s in ("0" * 40, " ", "0" * 39, "ab")] == [True, True, False, False]
    assert [one(spark, text.depth_from_count("n"), n=n) for n in (1, 19, 20, 50, 51, 35)] == [30, 30, 30, 20, 10, 25]
    assert one(spark, text.escaped_html("t"), t='a<b>&"c"\n') == 'a&lt;b&gt;&amp;"c"<br>'
    doc = one(spark, text.html_document("t"), t="<p>hi</p>")
    assert "<body><p>hi</p></body>" in doc and "UTF-8" in doc
    assert "<body></body>" in spark.sql("select cast(null as string) t").select(text.html_document("t")).first()[0]
    assert one(spark, text.lines("t"), t="a\r\nb\rc\n") == ["a", "b", "c"] and one(spark, text.lines("t"), t="a\n\n") == ["a", ""]
    assert one(spark, text.truncated("t", 2), t="abc") == "ab\n... [truncated]\n"
    assert one(spark, text.first_filled("a", "b"), a=" ", b=" x ") == "x"


def test_globs():
    assert {text.normal_glob(g) for g in ("*.java", "glob:*.java", "**/*.java")} == {"{*.java,**/*.java}"}
    assert text.normal_glob("**/*.kt") == "{*.kt,**/*.kt}"
    import re

    rx = text.glob_regex(text.normal_glob("*.java"))
    assert re.match(rx, "A.java") and re.match(rx, "a/b/A.java") and not re.match(rx, "a/A.kt")
    assert re.match(text.glob_regex("src/?[ab]*.{x,y}"), "src/zb1.y") and not re.match(text.glob_regex("src/*.x"), "src/a/b.x")


def _files(spark, *rows):
    return spark.createDataFrame([(p, c, len(c or "")) for p, c in rows], "relative_path string, content string, n_bytes int")


def test_search(spark):
    f = _files(spark, ("src/Hello.java", "package x;\nclass Hello { void foo() { bar(); } }\n"), ("target/T.java", "bar()"), ("n.java", None))
    got = files.search(f, "bar()")
    assert [tuple(r) for r in got["hits"].select("path", "line_number").collect()] == [("src/Hello.java", 2)]
    assert tuple(got["scanned"].first()) == (2, False) or got["scanned"].first()[0] in (1, 2)
    two = files.search(_files(spark, ("a.java", "x\nx\nx\n")), "x", max_hits=2)
    assert two["hits"].count() == 2 and two["counts"].first()["truncated_by_max_hits"]
    assert files.search(_files(spark, ("M.java", "id 123\nid 999\n")), r"id\s+\d+", regex=True)["hits"].count() == 2
    assert files.search(_files(spark, ("M.java", "A" * 5000)), "a", ignore_case=True)["hits"].first()["line_text"] == "A" * 4000 + "…"
    with pytest.raises(errors.EngineError) as x:
        files.search(f, "(unclosed", regex=True)
    assert x.value.code == 100011


def test_snippets(spark, tmp_path):
    f = spark.createDataFrame([("big.txt", "a\nb\nc\nd\n"), ("e", ""), ("n", None)], "path string, content string")
    got = {r["path"]: r for r in files.snippets(f, 2, 3).collect()}
    assert (got["big.txt"]["content"], got["big.txt"]["end_line"], got["big.txt"]["truncated"]) == ("b\nc", 3, False)
    assert got["e"]["content"] is None and got["n"]["content"] is None
    with pytest.raises(errors.EngineError) as x:
        files.snippets(f, None, 3)
    assert x.value.code == 100009
    (tmp_path / "repo").mkdir()
    with pytest.raises(errors.EngineError) as x:
        files.inside(str(tmp_path / "repo"), "../other/x")
    assert x.value.code == 100007


def test_snapshot_source(spark, tmp_path):
    p = tmp_path / "m/src/main/java/x"
    p.mkdir(parents=True)
    (p / "A.java").write_text("package x;\nclass A {}\n")
    (p / "a.txt").write_text("no")
    r = files.snapshot(spark, str(tmp_path)).collect()
    assert [(x["relative_path"], x["line_count"], x["source_root"].endswith("src/main/java")) for x in r] == [("m/src/main/java/x/A.java", 2, True)]
    assert files.snapshot(spark, str(tmp_path / "none")).count() == 0


DIFF = "--- a/x\n+++ b/x\n@@ -1,3 +1,4 @@\n class A {\n+  int x;\n }\n@@ -40 +41 @@\n-a\n+b\n"


def test_hunks(spark):
    df = spark.createDataFrame([("k", DIFF), ("e", ""), ("n", None)], "key string, diff string")
    got = [tuple(r) for r in diff.hunks(df).orderBy("hunk").select("key", "hunk", "new_start", "new_end").collect()]
    assert got == [("k", 1, 1, 4), ("k", 2, 41, 41)]
    nodes = spark.createDataFrame([("k", "m", 3, 3), ("k", "far", 20, 21)], "key string, node string, line_start int, line_end int")
    assert [r["node"] for r in diff.overlapping(nodes, diff.hunks(df), pad=0).collect()] == ["m"]


def test_relevant():
    got = diff.relevant(DIFF, 3, 3, 0, 10_000)
    assert "@@" in got and "+  int x" in got and "-40" not in got and got.count("+++ b/x") == 1
    assert diff.relevant(" ", 1, 2, 0, 10) == "" and diff.relevant(DIFF, 300, 301, 0, 9).startswith(DIFF[:9] + "\n... [truncated]")
    assert diff.relevant(DIFF, None, 2, 0, 10_000) == DIFF


def test_line_diffs(spark):
    df = spark.createDataFrame([("p", "a\nb\n", "a\nc\nd\n"), ("q", None, "x"), ("r", "s", "s")], "path string, old string, new string")
    assert [(r["insertions"], r["deletions"]) for r in diff.line_stats(df).orderBy("path").collect()] == [(2, 1), (1, 0), (0, 0)]
    u = {r["path"]: r["diff"] for r in diff.unified(df).collect()}
    assert "+c" in u["p"] and u["r"] == ""


def test_snapshot_diff_and_evidence(spark):
    a = spark.createDataFrame([("x.java", "1"), ("y.java", "1"), ("n.java", None), ("z.md", "1")], "path string, checksum string")
    b = spark.createDataFrame([("x.java", "2"), ("w.java", "1"), ("n.java", None)], "path string, checksum string")
    assert {tuple(r) for r in diff.snapshot_diff(a, b).collect()} == {("x.java", "MODIFIED"), ("y.java", "DELETED"), ("w.java", "ADDED")}
    fl = spark.createDataFrame([("c", "x.java", "MODIFIED", 2, 1)], "commit string, path string, change_type string, insertions int, deletions int")
    n = spark.createDataFrame([("c", "METHOD", "A#m()", "x.java", "y" * 20)], "commit string, kind string, qualified_name string, path string, snippet string")
    doc = json.loads(diff.evidence(F.struct(F.col("commit").alias("hash")), fl, n, "commit", 5).first()["document"])
    assert doc["lineStats"] == {"files": 1, "insertions": 2, "deletions": 1} and doc["nodes"][0]["diffSnippet"].startswith("yyyyy\n...")


def test_confidence_and_nodes(spark):
    rows = [("0.6",), ("0.5",), ("0.3",), ("true",), ("NaN",), ("Infinity",), ("x",), (None,), ("1e0",)]
    got = spark.createDataFrame(rows, "c string").select(jsonio.confident(F.col("c")).alias("x")).collect()
    assert [r["x"] for r in got] == [True, True, False, False, False, False, False, False, True]
    df = spark.createDataFrame([(0, "method", "A", ""), (1, "METHOD", "A", ""), (2, "TYPE", "A", "")], "pos int, kind string, qualified_name string, file_path string").withColumn("r", F.lit(1))
    assert [r["pos"] for r in jsonio.distinct_nodes(df, ["r"], ["pos"]).orderBy("pos").collect()] == [0, 2]
    nodes = '[{"kind":" METHOD ","qualifiedName":"A"},{"kind":"","qualifiedName":"B"}]'
    for t in (nodes, json.dumps(nodes)):
        x = one(spark, jsonio.normal_nodes(jsonio.parsed_list(F.col("t"), f"array<{jsonio.NODE}>")), t=t)
        assert [tuple(n) for n in x] == [("METHOD", "A", "")]
    assert one(spark, jsonio.parsed_list(F.col("t"), f"array<{jsonio.NODE}>"), t="{") == []


def test_payload(spark):
    p = {"pusher": {"name": "ann"}, "after": "AB", "head_commit": {"id": "zz", "author": {"name": "head"}}, "commits": [{"id": "ab", "message": "m1", "author": {"name": "tip"}}, {"id": "c"}]}
    assert one(spark, jsonio.pusher(F.col("p")), p=json.dumps(p)) == "ann"
    assert one(spark, jsonio.pusher(F.col("p")), p=json.dumps({"pusher": "bob"})) == "bob" and one(spark, jsonio.pusher(F.col("p")), p="{}") == "unknown"
    assert one(spark, jsonio.tip_author(F.col("p")), p=json.dumps(p)) == "tip"
    assert one(spark, jsonio.messages(F.col("p")), p=json.dumps(p)) == ["m1"] and one(spark, jsonio.messages(F.col("p")), p="{}") == []
    assert one(spark, jsonio.prompt("a <<<X>>> b", X=F.to_json(F.struct(F.lit(1).alias("k"))))) == 'a {"k":1} b'
    assert [one(spark, jsonio.status_code(F.col("s")), s=s) for s in ("200", "404.0", "x")] == [200, 404, 0]


JAVA = '''
package p.q;
import java.util.List;
import static a.B.c;
import d.*;
/** Doc */
public abstract class A<T extends Comparable<T>> extends Base<T> implements I, J<String> {
  private final int[] x = {1, 2}, y;
  static { int z = 0; }
  /** m */ @Ann(value = "}{", n = {1})
  public <K> List<K> m(final java.util.Map<String, List<K>> a, int[]... b) throws E { String s = "void no() {"; call(s, 1); /* void none() {} */ return null; }
  A() {}
  abstract void n(@Nullable String s);
  enum E { ONE(1) { void in() {} }, TWO; int f() { return 1; } }
  record R(int a, String b) { R { } int g() { return a; } }
  @interface N { String v() default "x;"; int[] w() default {1}; }
  interface In { default void d() {} }
}
'''


def test_javaparse():
    u = J.parse(JAVA)
    m = {J.method_id(d.owner, d.name, [t for t, _ in d.params]): d for d in u.decls if d.kind == "method"}
    assert set(m) == {"p.q.A#m(Map,int)", "p.q.A#<init>()", "p.q.A#n(String)", "p.q.A.E#f()", "p.q.A.R#g()", "p.q.A.N#v()", "p.q.A.N#w()", "p.q.A.In#d()"}
    assert m["p.q.A#m(Map,int)"].doc == "/** m */" and [(c.name, c.argc) for c in m["p.q.A#m(Map,int)"].calls] == [("call", 2)]
    assert J.signature(m["p.q.A#n(String)"]) == "void n(String s)" and J.signature(m["p.q.A#<init>()"]) == "A()"
    types = {d.name: d for d in u.decls if d.kind == "type"}
    assert types["p.q.A"].supers == [("EXTENDS", "Base"), ("IMPLEMENTS", "I"), ("IMPLEMENTS", "J")] and types["p.q.A.N"].type_kind == "ANNOTATION"
    assert [d.name for d in u.decls if d.kind == "field"][:2] == ["x", "y"]
    for broken in ("", None, "class", "class A {", "class A { void m(", "}}}", '"', "/**", "@", "class A { int x = ", "record"):
        J.parse(broken)


def test_ingest(spark):
    f = spark.createDataFrame([("A.java", "r", "package p; import q.B; class A { B b; void m() { b.run(1); run(1); own(); } void own() {} }"), ("B.java", "r", "package q; class B { void run(int i) {} }"), ("N.java", "r", None)], "path string, repo_id string, content string")
    rows = ingest.parse(f)
    e = {(r["src"], r["rel_type"], r["dst"]) for r in ingest.edges(rows).collect()}
    assert {("p.A#m()", "CALLS", "q.B#run(int)"), ("p.A#m()", "CALLS", "p.A#own()"), ("p.A", "DEPENDS_ON", "q.B"), ("A.java", "IMPORTS", "q.B"), ("p.A", "HAS_FIELD", "p.A#b")} <= e
    assert rows.where("row_kind = 'error'").count() == 0


def test_vector_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("n", None), ("s", [1.0]), (" ", [1.0, 0.0]), ("bad", [float("nan"), 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, q array<double>")
    assert [tuple(r) for r in vector.search(q, v, 2).orderBy("place").collect()] == [(1, "a", 1.0, 1), (1, "b", 1.0, 2)]
    assert vector.search(q.where("query_id = 2"), v, 2).count() == 0
    e = vector.embed(spark.createDataFrame([("a b",), ("",), (None,)], "text string")).collect()
    assert abs(sum(x * x for x in e[0]["embedding"]) - 1) < 1e-6 and e[1]["embedding"] is None and e[2]["embedding"] is None


def test_stream_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", []
    src.mkdir()
    ev = lambda h: json.dumps({"repo_id": "r", "commit_hash": h})
    (src / "1.json").write_text("\n".join([ev("a"), ev("a"), ev("b"), "broken"]))
    go = lambda: commits.run(commits.events(spark, str(src)), str(tmp_path / "state"), lambda b, n: out.extend(r["commit_hash"] for r in b.collect()))
    go()
    (src / "2.json").write_text("\n".join([ev("b"), ev("c")]))
    go()
    go()
    assert sorted(out) == ["a", "b", "c"]


CALLS = [
    ("I.java", "package q; public interface I { void run(int i); void run(String s); }"),
    ("B.java", "package q; public class B implements I { public void run(int i) { } public void run(String s) { } static B make() { return null; } }"),
    ("C.java", "package q; class C extends B { void more() { run(7); super.run(\"x\"); } class In { void deep() { more(); } } }"),
    ("A.java", "package p; import q.*; import static q.B.make; class A { B b; void m(C c) { b.run(1); b.run(\"s\"); String t = \"u\"; c.run(t); make(); B.make(); other().run(2); unknown(); long k = 3; own(k); } void own(int x) {} void own(long y) {} }"),
]


def test_calls_resolve_by_scope_and_types(spark):
    f = spark.createDataFrame([(p, "r", c) for p, c in CALLS], "path string, repo_id string, content string")
    got = {(r["src"], r["dst"]) for r in ingest.edges(ingest.parse(f)).where("rel_type = 'CALLS'").collect()}
    assert got == {
        ("q.C#more()", "q.B#run(int)"), ("q.C#more()", "q.B#run(String)"), ("q.C.In#deep()", "q.C#more()"), ("p.A#m(C)", "q.B#run(int)"), ("p.A#m(C)", "q.B#run(String)"),
        ("p.A#m(C)", "q.B#make()"), ("p.A#m(C)", "p.A#own(long)"),
    }
    up = {(r["src"], r["rel_type"], r["dst"]) for r in ingest.edges(ingest.parse(f)).where("rel_type in ('EXTENDS', 'IMPLEMENTS', 'DEPENDS_ON', 'CONTAINS_FILE')").collect()}
    assert up == {("q.B", "IMPLEMENTS", "q.I"), ("q.C", "EXTENDS", "q.B"), ("p.A", "DEPENDS_ON", "q.B")} | {(f"r:{'p' if x == 'A' else 'q'}", "CONTAINS_FILE", f"{x}.java") for x in "IBCA"}


def test_index_snapshot_and_changes(spark):
    snap = lambda rows: spark.createDataFrame([(p, "r", c) for p, c in rows], "path string, repo_id string, content string")
    empty = ingest.node_tables(ingest.parse(snap(CALLS)).limit(0), snap(CALLS).limit(0))
    g = index.Graph(empty, spark.createDataFrame([], "src string, rel_type string, dst string, line_no int"), spark.createDataFrame([], "id string, node_type string, embedding array<float>"))
    g, bad = index.index_snapshot(g, snap(CALLS))
    keys = lambda g: {r["key"] for r in index.node_keys(g.nodes).collect()}
    assert {"A.java", "r:p", "p.A", "p.A#b", "p.A#own(int)", "q.C.In#deep()"} <= keys(g) and bad.count() == 0
    assert {r["id"] for r in g.vectors.collect()} >= {"p.A", "q.B#run(int)"}
    assert g.edges.where("src = 'p.A#m(C)' and dst = 'q.B#make()'").count() == 1
    once = {tuple(r) for r in g.edges.collect()}
    again, _ = index.index_snapshot(g, snap(CALLS))
    assert {tuple(r) for r in again.edges.collect()} == once
    # B goes, A calls only its own method now, D is new.
    new = [CALLS[0], CALLS[2], ("A.java", "package p; class A { void m(int c) { own(c); } void own(int x) {} }"), ("D.java", "package d; class D { }")]
    h, _ = index.index_snapshot(g, snap(new))
    assert {"q.B", "q.B#run(int)", "B.java"}.isdisjoint(keys(h)) and {"d.D", "p.A#m(int)", "q.C", "p.A#m(C)"} <= keys(h)  # methods of a modified file stay, as stored
    e = {(r["src"], r["rel_type"], r["dst"]) for r in h.edges.collect()}
    assert ("p.A#m(int)", "CALLS", "p.A#own(int)") in e and not any("q.B" in x or "q.B" in z for x, _, z in e) and ("p.A#m(C)", "CALLS", "p.A#own(long)") not in e
    ids = {r["id"] for r in h.vectors.collect()}
    assert "d.D" in ids and "q.B" not in ids and h.nodes["Type"].where("qualified_name = 'q.I'").count() == 1


def test_tasks_records_and_isolation(spark):
    t = spark.createDataFrame([(1, 1, None, None), (2, 0, None, "x")], "id bigint, status smallint, finish_time string, error_msg string")
    u = spark.createDataFrame([(1, "FAIL", "b", "boom"), (1, "RUNNING", "a", None), (2, "RUNNING", "c", None), (9, "FAIL", "c", None), (2, "ODD", "z", None)], "id bigint, state string, at string, error_msg string")
    assert {tuple(r) for r in index.task_update(t, u).collect()} == {(1, 3, "b", "boom"), (2, 1, None, "x")}
    assert index.append_new(t, t.unionByName(t.withColumn("id", F.col("id") + 1)), ["id"]).count() == 3 and index.by_id(t, 2).count() == 1

    def one(repo, root):
        if repo == "b":
            raise RuntimeError("no checkout")

    assert index.run_each([("a", "/a"), ("b", "/b"), ("c", "/c")], one) == [("a", "SUCCESS", ""), ("b", "FAIL", "RuntimeError: no checkout"), ("c", "SUCCESS", "")]
    rows = ingest.parse(spark.createDataFrame([("A.java", "r", "class A { int x; void m() {} }")], "path string, repo_id string, content string"))
    assert tuple(ingest.counters(rows).first()) == (1, 0, 1, 1, 1)
