"""Generated, minified, vendored and data-like files."""

import random

import pytest
from pyspark.sql import functions as F

from codeweft.llm import handwritten as H
from codeweft.llm import layout

HAND = "package com.own.a;\n\nimport java.util.List;\n\npublic class A {\n    private int x;\n\n    public int get(int limit) {\n        int sum = 0;\n        for (int i = 0; i < limit; i++) {\n            sum += step(i, x);\n        }\n        return sum;\n    }\n}\n"


def js(seed, n=8):
    r = random.Random(seed)
    return "".join(f"function f{r.randrange(10**6)}(a{r.randrange(999)}, b) {{\n  const c{r.randrange(999)} = a + {r.randrange(10**5)};\n  return run{r.randrange(10**6)}(c, b, {r.randrange(999)});\n}}\n\n" for _ in range(n))


def judge(spark, rows):
    f = spark.createDataFrame([(p, "own-repo", c) for p, c in rows], "path string, repo_id string, content string")
    roots = spark.createDataFrame([("org.lib",)], "root string")
    repos = spark.createDataFrame([("own-repo",), (None,)], "repo_id string")
    return {r["path"]: r["reason"] for r in H.not_handwritten(f, roots, repos).collect()}


@pytest.mark.parametrize("mark", ["// Generated by the x compiler. DO NOT EDIT.\n", "/* @generated */\n", "// <auto-generated/>\n", "/*\n * Stub emitted by x-gen 3.1 out of a.wsdl.\n */\n", "// source: a.proto\n// Do not modify this file.\n", "// 本文件由模板自动生成，请勿手工修改\n", "// FICHERO GENERADO, NO MODIFICAR\n", "/*\n * This file was produced from a.xsd; manual changes will be lost.\n */\n", "// This module has been derived from the schema.\n"])
def test_generated(spark, mark):
    assert judge(spark, [("A.java", mark + HAND)]) == {"A.java": "generated"}


def test_prose_about_generators_is_no_mark(spark):
    rows = [
        ("B.java", HAND.replace("public class A", "/**\n * Writes files that carry the mark 'generated, do not edit' for templates.\n */\npublic class A")),
        ("C.java", HAND.replace("    public int", "    /** Auto-generated method stub */\n    public int")), ("D.java", HAND.replace("com.own.a", "com.own.generated")),
        ("e.js", "// This panel lists generated files; do not edit rows that are locked.\n" + js(1)), ("F.java", "// Copyright own team. Internal use only.\n" + HAND), ("vendor/G.java", HAND),
    ]
    assert judge(spark, rows) == {}


def test_vendored(spark):
    lib = "/*! lib core 1.2 | (c) lib contributors | public terms */\n" + js(5, 20)
    changed = js(5, 20).replace("return run", "return  run", 1) + "\nfunction extra(a) {\n  return a;\n}\n"
    rows = [
        ("x/A.java", HAND.replace("com.own.a", "org.lib.a")), ("y/B.java", HAND.replace("com.own.a", "net.foreign.a")), ("z/C.java", "/* Copyright (c) the lib contributors. Licensed under the lib public terms. */\n" + HAND),
        ("web/lib.js", lib), ("web/moved.js", js(5, 20)), ("web/changed.js", changed), ("web/own.js", js(6, 20)), ("web/node_modules/q/i.js", js(7)),
    ]
    assert judge(spark, rows) == {k: "vendored" for k in ("x/A.java", "y/B.java", "z/C.java", "web/lib.js", "web/moved.js", "web/changed.js", "web/node_modules/q/i.js")}


def test_java_copies_in_a_package_of_the_host(spark):
    body = "/** Keeps steps. */\npublic class Steps {\n" + "".join(f"    int step{i}(int a, int b) {{\n        return a * {i + 3} + b - limit{i};\n    }}\n\n" for i in range(12)) + "}\n"
    imports = lambda root: "".join(f"import {root}.part{i}.Name{i};\n" for i in range(30)) + f"import static {root}.part.Name.*;\n\n"
    notice = "/* Copyright (c) the lib contributors. Licensed under the lib public terms. */\n"
    other = "public class Other {\n" + "".join(f"    void other{i}(long x) {{\n        run{i}(x, {i});\n    }}\n" for i in range(12)) + "}\n"
    rows = [
        ("lib/Steps.java", notice + "package org.lib.a;\n\n" + imports("org.lib") + body),
        ("own/support/Steps.java", "package com.own.support;\n\n" + imports("com.own") + body.replace("/** Keeps steps. */\n", "")),
        ("own/compat/Steps.java", "package com.own.compat;\n\n" + body.replace("a * 5 + b", "b * 5 + a")), ("own/Other.java", "package com.own.a;\n\n" + imports("com.own") + other),
    ]
    assert judge(spark, rows) == {k: "vendored" for k in ("lib/Steps.java", "own/support/Steps.java", "own/compat/Steps.java")}


def test_generated_by_tail_and_folder(spark):
    rows = [
        ("A.java", HAND + "// checksum of the template: 1f, regenerate instead of editing\n"), ("/r/m/target/gen/com/own/a/B.java", HAND), ("/r/m/build/generated/sources/main/com/own/a/C.java", HAND),
        ("/r/m/src/gen/java/com/own/a/D.java", HAND), ("/r/build/src/main/java/com/own/a/E.java", HAND), ("/r/m/src/main/java/com/own/gen/F.java", HAND.replace("com.own.a", "com.own.gen")),
        ("/r/m/src/main/java/com/own/generated/target/G.java", HAND), ("/r/gen/h.js", js(3)), ("/r/build/i.js", js(4)),
    ]
    assert judge(spark, rows) == {k: "generated" for k in ("A.java", "/r/m/target/gen/com/own/a/B.java", "/r/m/build/generated/sources/main/com/own/a/C.java", "/r/m/src/gen/java/com/own/a/D.java", "/r/gen/h.js")}


def test_statistics_of_a_text():
    n, longest, mean, space, alnum, numeric, encoded = layout.statistics("añb 1, 22,\r\n\"ff\" x\rend".encode())
    assert (n, longest, round(mean, 3)) == (22, 10, 7.333) and round(space, 4) == round(6 / 22, 4) and round(alnum, 4) == round(12 / 22, 4)
    assert round(numeric, 4) == round((2 + 3 + 4) / 16, 4) and encoded == 0 and layout.statistics(b"") is None


def test_rulers_are_not_encoded():
    assert layout.statistics(b"# " + b"-" * 200 + b"\n" + b"=" * 90)[6] == 0


def test_short_texts_have_no_layout(spark):
    assert judge(spark, [("v.py", "V = [1, 2, 3, 4]\n"), ("w.js", "var a=1")]) == {}


def test_shingles_follow_words():
    a = layout.shingles(b"int a = b + c ; return d ; done now here")
    assert a[0] == layout.shingles(b"int  a=b+c;return\nd;done now here")[0] and len(a[1]) == 5
    assert layout.shingles(b"x y")[1].shape == (1,) and layout.shingles(b" ;; ") is None
    assert layout.code_only(b"package a.b;\nimport x.Y;\n/* c */ class A { // d\n String u = \"http://x\"; }", True).split() == b'class A { String u = "http://x"; }'.split()


def test_layout(spark):
    r = random.Random(1)
    table = "package com.own.a;\nfinal class T {\n    static final byte[] TABLE = {\n" + "".join("            " + ", ".join(str(r.randrange(-128, 127)) for _ in range(24)) + ",\n" for _ in range(60)) + "    };\n}\n"
    blob = "package com.own.a;\nfinal class B {\n    static final String S = \"\"\n" + "".join('        + "' + "".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(90)) + '"\n' for _ in range(40)) + "    ;\n}\n"
    mini = "".join(f"function a{i}(b,c){{return b>c?b-{i}:c*7}}" for i in range(200))
    rows = [("T.java", table), ("B.java", blob), ("m.js", mini), ("d.py", "DATA = {\n" + "".join(f"    {r.randrange(9**9)}: {r.randrange(9**9)},\n" for _ in range(200)) + "}\n"), ("ok.js", js(2)), ("A.java", HAND)]
    assert judge(spark, rows) == {"T.java": "data", "B.java": "data", "m.js": "minified", "d.py": "data"}


def test_indented_blobs_are_data(spark):
    r = random.Random(7)
    blob = "package com.own.a;\nfinal class B {\n    static final String S = \"\"\n" + "".join(" " * 24 + '+ "' + "".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(64)) + '"\n' for _ in range(40)) + "    ;\n}\n"
    assert sum(c.isspace() for c in blob) / len(blob) > 0.25
    assert judge(spark, [("B.java", blob)]) == {"B.java": "data"}


def test_nulls_and_empty(spark):
    assert judge(spark, [("a.js", None), ("b.java", ""), ("c.py", " \n "), (None, HAND)]) == {}
    f = spark.createDataFrame([], "path string, repo_id string, content string")
    e = spark.createDataFrame([], "root string")
    assert H.not_handwritten(f, e, spark.createDataFrame([], "repo_id string")).count() == 0


def test_copies_equal_brute_force(spark):
    import re

    r = random.Random(4)
    base = [js(100 + i, 6) for i in range(4)]
    known = [(f"k{i}", b) for i, b in enumerate(base)]
    others = []
    for i in range(30):
        lines = base[i % 4].split("\n")
        for _ in range(r.randrange(0, 6)):
            lines[r.randrange(len(lines))] = f"changed{r.randrange(10**6)}"
        others.append((f"o{i}", "\n".join(lines)))
    s = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})([x for x in re.split(r"[^\w$]+", t) if x])
    want = {k for k, t in others if any(len(s(t) & s(b)) / len(s(t) | s(b)) >= 0.8 for b in base)}
    df = lambda rows: H.read(spark.createDataFrame([(f"{k}.js", "r", c) for k, c in rows], "path string, repo_id string, content string")).select(F.regexp_replace("path", ".js$", "").alias("key"), "cls", "n", "s")
    got = {x["key"] for x in H.copies(df(known), df(others)).collect()}
    assert got == want and 0 < len(want) < 30
