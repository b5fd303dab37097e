"""From file contents to node and edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import lines
from codeweft.operators import store
from codeweft.operators.graph import hops
from codeweft.session import cut
from codeweft.sources import javaparse as J

ROWS = (
    "path string, repo_id string, row_kind string, key string, owner string, name string, type_kind string, signature string, return_type string, access string, "
    "is_static boolean, is_abstract boolean, is_final boolean, line_start int, line_end int, rel_type string, targets array<string>, arity int, types array<string>"
)
_COLS = [c.split()[0] for c in ROWS.split(", ")]
# Types that make no dependency.
PLAIN = frozenset("byte short int long float double boolean char void String Integer Long Boolean Double Float Short Byte Character".split())


def _edge(path: str, repo: str | None, src: str, rel: str, *targets: str) -> tuple:
    return (path, repo, "edge", src, None, None, *[None] * 9, rel, list(targets), None, None)


def _rows(path: str, repo: str | None, text: str) -> Iterator[tuple]:
    u = J.parse(text)
    package = f"{repo}:{u.package}"
    yield (path, repo, "package", package, None, u.package, *[None] * 13)
    yield (path, repo, "file", path, package, path.rpartition("/")[2], *[None] * 13)
    yield _edge(path, repo, package, "CONTAINS_FILE", path)
    static: dict[str, list[str]] = {}
    for imp in u.imports:
        if imp.startswith("static "):
            owner, _, name = imp[7:].rpartition(".")
            static.setdefault(name, []).append(owner)
        elif not imp.endswith("*"):
            yield _edge(path, repo, path, "IMPORTS", imp)
    fields: dict[str, dict[str, str]] = {}
    supers: dict[str, list[str]] = {}
    for d in u.decls:
        if d.kind == "field":
            fields.setdefault(d.owner, {})[d.name] = J.simple_type(d.returns)
        elif d.kind == "type":
            supers[d.name] = [c for _, s in d.supers for c in J.candidates(u, s, d.owner)]

    def around(owner: str) -> list[str]:
        """The type and those around it, inner first."""
        out = []
        while owner and owner != u.package:
            out.append(owner)
            owner = owner.rpartition(".")[0]
        return out

    def variable(name: str, owner: str) -> str:
        return next((fields[o][name] for o in around(owner) if name in fields.get(o, ())), "")

    def owners(c: J.Call, owner: str) -> list[str]:
        """Types that may declare what is called, most likely first."""
        if c.scope is None:
            return []
        if c.scope == "":
            return [*around(owner), *static.get(c.name, []), *static.get("*", [])]
        if c.scope == "super":
            return supers.get(owner, [])
        t = c.scope_type or variable(c.scope, owner) or (c.scope if c.scope[:1].isupper() else "")
        return J.candidates(u, t, owner) if t else []

    for d in u.decls:
        access = next((m for m in d.modifiers if m in ("public", "protected", "private")), "")
        flags = ("static" in d.modifiers, "abstract" in d.modifiers, "final" in d.modifiers)
        if d.kind == "type":
            yield (path, repo, "type", d.name, d.owner, d.name.rpartition(".")[2], d.type_kind, None, None, access, *flags, d.line_start, d.line_end, None, None, None, None)
            yield _edge(path, repo, path, "DEFINES_TYPE", d.name)
            if d.owner and d.owner != u.package:
                yield _edge(path, repo, d.name, "INNER_CLASS_OF", d.owner)
            for rel, s in d.supers:
                yield _edge(path, repo, d.name, rel, *J.candidates(u, s, d.owner))
        elif d.kind == "method":
            types = [J.simple_type(t) for t, _ in d.params]
            key = J.method_id(d.owner, d.name, [t for t, _ in d.params])
            returns = "void" if d.name == "<init>" else d.returns
            yield (path, repo, "method", key, d.owner, d.name, None, J.signature(d), returns, access, *flags, d.line_start, d.line_end, None, None, len(types), types)
            yield _edge(path, repo, d.owner, "HAS_METHOD", key)
            for c in d.calls:
                args = [variable(t[1:], d.owner) if t.startswith("?") else t for t in c.args]
                yield (path, repo, "call", key, d.owner, c.name, *[None] * 7, text.count("\n", 0, c.at) + 1, None, "CALLS", owners(c, d.owner), c.argc, args)
        else:
            key = f"{d.owner}#{d.name}"
            yield (path, repo, "field", key, d.owner, d.name, None, None, d.returns, access, *flags, d.line_start, d.line_end, None, None, None, None)
            yield _edge(path, repo, d.owner, "HAS_FIELD", key)
            if J.simple_type(d.returns) not in PLAIN:
                t = d.returns.split("<")[0].replace("[]", "").strip()
                yield _edge(path, repo, d.owner, "DEPENDS_ON", *J.candidates(u, t, d.owner))
    if u.error:
        yield (path, repo, "error", path, None, u.error, *[None] * 13)


def parse(files: DataFrame) -> DataFrame:
    """Typed rows (see ROWS) of all declarations, relations, candidate calls and errors of (path, repo_id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for p, r, t in zip(b["path"], b["repo_id"], b["content"]):
                try:
                    out += _rows(p, r, t or "")
                except Exception as e:  # one broken file must not end the run
                    out.append((p, r, "error", p, None, f"{type(e).__name__}: {e}", *[None] * 13))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=_COLS).astype(object)
                    out = []
            yield pd.DataFrame(out, columns=_COLS).astype(object)

    return files.where("path is not null").select("path", "repo_id", "content").mapInPandas(run, ROWS)


#: Levels of supertypes in which an inherited method is looked for.
INHERITED = 8


def resolved(targets: DataFrame, types: DataFrame) -> DataFrame:
    """(targets, dst) of distinct lists of names: the first that is a type; an only name stands for itself; else the simple name, which no type has."""
    t = targets.select("targets").where(F.size("targets") > 0).distinct()
    hit = t.select("targets", F.posexplode("targets").alias("pos", "key")).join(types.select("key").distinct(), "key").groupBy("targets").agg(F.min(F.struct("pos", "key")).alias("x"))
    other = F.when(F.size("targets") == 1, F.col("targets")[0]).otherwise(F.substring_index(F.col("targets")[0], ".", -1))
    return t.join(hit, "targets", "left").select("targets", F.coalesce("x.key", other).alias("dst"))


def edges(rows: DataFrame, known_types: DataFrame | None = None, known_methods: DataFrame | None = None) -> DataFrame:
    """(src, rel_type, dst, line_no): parsed relations plus the calls that resolve.

    Names of types are resolved by import, nesting, package and whole-package
    imports, whichever exists in the rows or in ``known_types`` (key). A call
    goes to the type of what stands before the dot, or without one to its own
    type and those around it or statically imported, and their supertypes up
    to INHERITED levels: to the nearest method of that name and number of
    arguments whose parameter types contradict the arguments least; ties go to
    the smaller id. Calls on expressions, and those that find nothing, go.
    """
    types = rows.where("row_kind = 'type'").select("key")
    if known_types is not None:
        types = types.unionByName(known_types.select("key"))
    links = rows.where("row_kind = 'edge'").select(F.col("key").alias("src"), "rel_type", "targets").distinct()
    sure = F.col("rel_type").isin("EXTENDS", "IMPLEMENTS", "DEPENDS_ON")
    plain = links.where(~sure).select("src", "rel_type", F.col("targets")[0].alias("dst"))
    named = links.where(sure)
    plain = cut(plain.unionByName(named.join(resolved(named, types), "targets").select("src", "rel_type", "dst")).distinct())

    methods = rows.where("row_kind = 'method'").select("owner", "name", "arity", "types", F.col("key").alias("dst"))
    if known_methods is not None:
        methods = methods.unionByName(known_methods.select("owner", "name", "arity", "types", "dst"))
    methods = methods.distinct()
    up = plain.where("rel_type in ('EXTENDS', 'IMPLEMENTS')")
    own = types.distinct().select(F.col("key").alias("at"), F.col("key").alias("owner"), F.lit(0).alias("far"))
    above = hops(up.select(F.col("src").alias("seed")).distinct(), up, INHERITED).select(F.col("seed").alias("at"), F.col("node").alias("owner"), F.col("hop").alias("far"))
    calls = rows.where("row_kind = 'call' and size(targets) > 0").select(F.col("key").alias("src"), "name", "arity", F.col("types").alias("args"), F.col("line_start").alias("line_no"), "targets").distinct()
    some = calls.select("*", F.posexplode("targets").alias("pos", "at")).join(own.unionByName(above), "at").join(methods, ["owner", "name", "arity"])
    closed = F.array(*map(F.lit, sorted(PLAIN)))
    pairs = F.arrays_zip(F.col("args").alias("a"), F.col("types").alias("t"))
    odd = lambda p: (p["a"] != p["t"]) & F.array_contains(closed, p["a"]) & F.array_contains(closed, p["t"])
    rank = F.struct("pos", "far", F.size(F.filter(pairs, odd)).alias("odd"), (-F.size(F.filter(pairs, lambda p: p["a"] == p["t"]))).alias("same"), "dst")
    best = some.groupBy("src", "name", "arity", "args", "line_no", "targets").agg(F.min(rank).alias("x")).select("src", F.col("x.dst").alias("dst"), "line_no")
    both = best.groupBy("src", "dst").agg(F.max("line_no").alias("line_no"))
    return plain.withColumn("line_no", F.lit(None).cast("int")).unionByName(both.select("src", F.lit("CALLS").alias("rel_type"), "dst", "line_no")).distinct()


def failures(rows: DataFrame) -> DataFrame:
    """(file_path, error_type, error_msg) of the files that could not be read to their end."""
    return rows.where("row_kind = 'error'").select(F.col("path").alias("file_path"), F.lit("PARSE_ERROR").alias("error_type"), F.col("name").alias("error_msg"))


def counters(rows: DataFrame) -> DataFrame:
    """One row: files parsed and failed, and the nodes found by label."""
    n = lambda kind: F.count_if(F.col("row_kind") == kind)
    bad = F.countDistinct(F.when(F.col("row_kind") == "error", F.col("path")))
    return rows.agg(
        F.countDistinct(F.when(F.col("row_kind") == "file", F.col("path"))).alias("n_files"), bad.alias("n_failed"), n("type").alias("n_types"), n("method").alias("n_methods"), n("field").alias("n_fields")
    )


def node_tables(rows: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The node tables of parsed rows, one row per key, the last by path and line.

    ``files``: the snapshot that was parsed, with path, repo_id and whichever
    of relative_path, content, checksum, line_count, last_modified it has.
    """
    pick = lambda kind, *cols: rows.where(F.col("row_kind") == kind).select("path", "line_start", *cols)
    last = lambda df, key: store.last_per_key(df.withColumn("_l", F.coalesce("line_start", F.lit(0))), [key], ["path", "_l"]).drop("_l")
    has = set(files.columns)
    own = lambda c, other: F.col(c) if c in has else other
    none = lambda kind: F.lit(None).cast(kind)
    body = F.col("content") if "content" in has else none("string")
    jf = files.where("path is not null").select(
        "path", own("relative_path", none("string")).alias("relative_path"), own("checksum", F.md5(body)).alias("checksum"), own("line_count", F.size(lines(body))).cast("int").alias("line_count"),
        own("last_modified", none("bigint")).cast("bigint").alias("last_modified"), "repo_id",
    )
    package = last(pick("package", F.col("key").alias("id"), F.col("name").alias("qualified_name"), "repo_id"), "id").drop("line_start").withColumn("path", F.replace("qualified_name", F.lit("."), F.lit("/")))
    flags = [F.col("access").alias("access_modifier"), "is_abstract", "is_final", "is_static"]
    types = last(pick("type", F.col("key").alias("qualified_name"), F.col("name").alias("simple_name"), F.col("type_kind").alias("kind"), *flags, "line_end"), "qualified_name")
    methods = last(pick("method", F.col("key").alias("id"), F.col("owner").alias("owner_qualified_name"), F.col("name").alias("simple_name"), "signature", "return_type", *flags, (F.col("name") == "<init>").alias("is_constructor"), "line_end"), "id")
    fields = last(pick("field", F.col("key").alias("id"), F.col("owner").alias("owner_qualified_name"), F.col("name").alias("simple_name"), F.col("return_type").alias("type_name"), *flags), "id")
    return {
        "JavaFile": store.last_per_key(jf.withColumn("_o", F.coalesce("last_modified", F.lit(0))), ["path"], ["_o", "checksum"]).drop("_o"), "Package": package,
        "Type": types.withColumnRenamed("path", "file_path"), "Method": methods.withColumnRenamed("path", "file_path").drop("is_final"),
        "Field": fields.withColumnRenamed("path", "file_path").withColumnRenamed("line_start", "line_no").drop("is_abstract"),
    }
