"""Functions with documentation."""

import pytest

from codeweft.llm import function_docs as D
from codeweft.sources import javaparse as J

FILES = "path string, repo_id string, content string"


@pytest.mark.parametrize(
    "doc,want",
    [
        ("/** Moves the cursor past entries that were already acknowledged. */", True),
        ("/** Reads.\n * @return all open pages of the segment\n */", False),
        ("/** {@inheritDoc} */", False),
        ("/** */", False),
        ("/***********/", False),
        ("/** TODO */", False),
        ("/** TODO: document */", False),
        ("/** Read page method. */", False),
        ("/** <p>Reads the page</p> */", False),
        ("/** See {@link Other#thing}. */", False),
        ("/** @see Other */", False),
        ("/** &nbsp; <br> */", False),
        ("/** 待补充 */", False),
        ("/** 按到达顺序遍历尚未封存的条目。 */", True),
        ("/** Fasst benachbarte Bereiche zusammen. */", True),
        ("/**\r\n * Drops pages nobody touched\r\n * during the grace period.\r\n */", True),
        ("/** <pre> moves the cursor past </pre> */", False),
        ("/** See {@link X}. Keeps a bounded history of all failures. */", True),
    ],
)
def test_says_something(doc, want):
    u = J.parse("package p; class A { " + doc + " Page readPage(int page) { return null; } }")
    d = next(x for x in u.decls if x.kind == "method")
    text = D.main_text(d.doc)
    assert (bool(text) and D.says_something(text, d)) is want


def test_which_comment_counts():
    def doc(body):
        return next(x for x in J.parse("class A { " + body + " void m() {} }").decls if x.kind == "method").doc

    assert doc("/** a */\n\n @X(\"}\") @Y\n") == "/** a */"
    assert doc("/** a */ /** b */") == "/** b */"
    assert doc("/** a */ // note\n") is None and doc("/** a */ /* b */") is None and doc("/** a */ int x;") is None
    assert doc("@X /** a */") == "/** a */"
    assert doc("/**/") is None


def test_pairs(spark):
    good = "/** Moves the cursor past entries that were already acknowledged. */"
    files = spark.createDataFrame(
        [
            ("I.java", "r", f"package p; public interface I {{ {good} int go(java.util.List<String> x); {good} int go(int x); /** Go. */ void go(); }}"),
            ("A.java", "r", "package q; import p.I; class A implements I { public int go(List<Integer> y) { return 1; } public int go(int x) { return 2; } }"),
            ("B.java", "r", "package q; import p.I; class B implements I { public int go(List<Integer> y) { return 3; } }"),
            ("A.java", "r", f"package q; class A {{ {good} A() {{ }} String s = \"/** x */ void no() {{}}\"; /* {good} void none() {{}} */ }}"),
            ("N.java", "r", None), ("E.java", "r", ""), ("x.py", "r", "class A: pass"), (None, "r", "class Z { }"), ("I.java", "r", f"package p; public interface I {{ {good} int go(java.util.List<String> x); {good} int go(int x); /** Go. */ void go(); }}"),
        ],
        FILES,
    )
    got = {(r["path"], r["method_id"]): (r["code"], r["code_path"], r["signature"]) for r in D.pairs(files).collect()}
    assert set(got) == {("I.java", "p.I#go(List)"), ("I.java", "p.I#go(int)"), ("A.java", "q.A#<init>()")}
    assert got["I.java", "p.I#go(List)"] == ("public int go(List<Integer> y) { return 1; }", "A.java", "int go(java.util.List<String> x)")
    assert got["I.java", "p.I#go(int)"][0].endswith("return 2; }") and got["A.java", "q.A#<init>()"][1] == "A.java"
    assert D.pairs(files).count() == 3
    t = {r["overload"]: r for r in D.symbol_table(files).where("owner = 'p.I'").collect()}
    assert (t["go(List)"]["n_documented"], t["go(List)"]["n_definitions"], t["go()"]["n_documented"]) == (2, 0, 0)


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], FILES)
    assert D.pairs(none).count() == 0 and D.symbol_table(none).count() == 0
    more = spark.createDataFrame([("A.java", None, "class A { /** Keeps a bounded history of failures. */ void m() { } }", 1, "x")], FILES + ", doc int, owner string")
    assert [r["method_id"] for r in D.pairs(more).collect()] == ["A#m()"]


def test_definitions_in_nearest_subtypes(spark):
    good = "/** Moves the cursor past entries that were already acknowledged. */"
    rows = [
        ("I.java", f"package p; public interface I {{ {good} int go(java.util.List<String> x); {good} int none(); }}"),
        ("J.java", "package p; public interface J extends I { }"),
        ("K.java", "package q; import p.*; abstract class K implements J { class In extends K { public int none() { return 9; } } }"),
        ("Z.java", "package q; class Z extends K { public int go(List<Integer> y) { return 1; } }"),
        ("Y.java", "package q; class Y extends K { public int go(List<Integer> y) { return 2; } }"),
        ("X.java", "package q; class X extends Y { public int go(List<Integer> y) { return 0; } }"),
        ("A.java", f"package c; abstract class A extends B {{ {good} abstract void loop(); }}"), ("B.java", "package c; abstract class B extends A { }"),
    ]
    files = spark.createDataFrame([(p, "r", c) for p, c in rows], FILES)
    got = {r["method_id"]: (r["code"], r["code_path"]) for r in D.pairs(files).collect()}
    # Brute force: subtypes level by level, the smallest (path, code) of the first level that has a definition.
    d = [r for r in D.declarations(files).collect()]
    subs = {(s, r["owner"]) for r in d if r["kind"] == "type" for s in r["supers"]}
    for r in d:
        if r["kind"] == "method" and r["documented"]:
            front, seen, best = {r["owner"]}, set(), None
            while front and best is None:
                seen |= front
                front = {b for a, b in subs if a in front} - seen
                best = min(((x["path"], x["code"]) for x in d if x["owner"] in front and x["overload"] == r["overload"] and x["has_body"]), default=None)
            assert got[r["method_id"]] == ((best[1], best[0]) if best else (r["code"], r["path"]))
    assert got["p.I#go(List)"][1] == "Y.java" and got["p.I#none()"][1] == "K.java" and got["c.A#loop()"][1] == "A.java"


def test_found_comes_through_the_join(spark):
    files = spark.createDataFrame([("A.java", "r", "class A { /** Keeps a bounded history of failures. */ void m() { } }")], FILES)
    plan = D.pairs(files).select("path", "method_id").distinct()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
