"""Tolerant JSON post-processing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.errors import BAD_JSON

NODE = "struct<kind:string,qualifiedName:string,filePath:string>"
RISKS = f"array<struct<risk_name:string,risk_priority:string,confidence:string,nodes:array<{NODE}>>>"


def confident(c: Column, least: float = 0.5) -> Column:
    """True for a finite number (or its text) of at least ``least``; true, false, NaN and other text never are."""
    v = c.try_cast("double")
    return F.coalesce((v >= least) & ~F.isnan(v) & (F.abs(v) != float("inf")) & ~F.lower(F.trim(c.cast("string"))).isin("true", "false"), F.lit(False))


def parsed_list(text: Column, kind: str) -> Column:
    """An array from JSON text, also where the array itself is a JSON string; anything else gives an empty array."""
    twice = F.from_json(F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x string")["x"], kind)
    return F.coalesce(F.from_json(text, kind), twice, F.from_json(F.lit("[]"), kind))


def strict_list(text: Column, kind: str) -> Column:
    """An array from JSON text; null or blank gives an empty one, anything else that is no array raises error 100012."""
    got = F.from_json(text, kind)
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    bad = F.raise_error(F.lit(f"{BAD_JSON}: no JSON list")).cast(kind)
    return F.when(blank, F.from_json(F.lit("[]"), kind)).when(F.trim(text).startswith("[") & got.isNotNull(), got).otherwise(bad)


def _object(text: Column) -> Column:
    """JSON text if it is an object, else null."""
    return F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), text)


def _block(root: Column, key: str) -> Column:
    """The JSON text of an object below ``root``, ``{}`` if there is none."""
    return F.coalesce(_object(F.get_json_object(root, f"$.{key}")), F.lit("{}"))


def change_payload(text: Column) -> Column:
    """The blocks of a change payload, each empty where it is missing or of another kind.

    A struct of JSON texts: meta, lineStats, truncation (its warnings are a
    list or empty), and of arrays of JSON texts: changedFiles, nodes; both may
    come as JSON inside a string. repoId is that of meta. Text that is no JSON
    object gives empty blocks.
    """
    root = _object(text)
    items = lambda k: F.transform(parsed_list(F.get_json_object(root, f"$.{k}"), "array<variant>"), lambda v: F.to_json(v))
    cut = _block(root, "truncation")
    warned = F.get_json_object(cut, "$.warnings")
    plain = F.from_json(cut, "map<string,variant>")
    fixed = F.to_json(F.map_concat(F.map_filter(plain, lambda k, v: k != "warnings"), F.map_from_entries(F.array(F.struct(F.lit("warnings").alias("key"), F.parse_json(F.lit("[]")).alias("value"))))))
    return F.struct(
        _block(root, "meta").alias("meta"), _block(root, "lineStats").alias("lineStats"), F.when(warned.isNotNull() & ~F.trim(warned).startswith("["), fixed).otherwise(cut).alias("truncation"),
        items("changedFiles").alias("changedFiles"), items("nodes").alias("nodes"), F.coalesce(F.get_json_object(root, "$.meta.repoId"), F.lit("")).alias("repoId"),
    )


_RAW_NODE = "struct<kind:variant,qualifiedName:variant,filePath:variant>"
RESPONSE = f"repoId variant, effectiveDepth variant, results array<struct<seed:{_RAW_NODE},matchedInGraph:variant,impactChains:array<struct<chainKind:variant,hopCount:variant,nodes:array<{_RAW_NODE}>,edgeTypes:array<variant>>>>>, truncation struct<warnings:array<variant>>"


def _of(v: Column, kind: str, default) -> Column:
    """The value of a variant if it is of that kind, else the default."""
    fits = F.schema_of_variant(v) == {"string": "STRING", "int": "BIGINT", "boolean": "BOOLEAN"}[kind]
    return F.when(fits, F.try_variant_get(v, "$", kind)).otherwise(F.lit(default))


def propagation_response(status: Column, body: Column) -> Column:
    """A propagation response by status: typed blocks for 2xx, the same shape with nothing in it otherwise.

    Values of another kind than expected become '' or 0 or false, other list
    items empty ones; edge types that are no text go.
    """
    ok = status_code(status).between(200, 299)
    r = F.from_json(F.when(ok, body), RESPONSE)
    node = lambda n: F.struct(*(_of(n[k], "string", "").alias(k) for k in ("kind", "qualifiedName", "filePath")))
    some = lambda a, kind: F.coalesce(a, F.array().cast(kind))
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    text = lambda v: F.try_variant_get(v, "$", "string")
    node_kind = "array<struct<kind:string,qualifiedName:string,filePath:string>>"
    chain = lambda c: F.struct(
        _of(c["chainKind"], "string", "").alias("chainKind"), _of(c["hopCount"], "int", 0).alias("hopCount"), some(F.transform(c["nodes"], node), node_kind).alias("nodes"),
        some(F.transform(F.filter(c["edgeTypes"], is_text), text), "array<string>").alias("edgeTypes"),
    )
    chain_kind = f"array<struct<chainKind:string,hopCount:int,nodes:{node_kind},edgeTypes:array<string>>>"
    result = lambda x: F.struct(node(x["seed"]).alias("seed"), _of(x["matchedInGraph"], "boolean", False).alias("matchedInGraph"), some(F.transform(x["impactChains"], chain), chain_kind).alias("impactChains"))
    return F.struct(
        _of(r["repoId"], "string", "").alias("repoId"), _of(r["effectiveDepth"], "int", 0).alias("effectiveDepth"),
        some(F.transform(r["results"], result), f"array<struct<seed:struct<kind:string,qualifiedName:string,filePath:string>,matchedInGraph:boolean,impactChains:{chain_kind}>>").alias("results"),
        some(F.transform(r["truncation"]["warnings"], lambda v: v.cast("string")), "array<string>").alias("warnings"),
    )


def report_order(rows: DataFrame, by: list[str], priority: str, confidence: str, pos: str) -> DataFrame:
    """``rows`` plus ``place`` per ``by``: by the number in the priority (``P1`` before ``P2``, unreadable ones last), then the higher confidence, missing last, then position."""
    n = F.regexp_extract(F.trim(priority), r"^[Pp](\d+)$", 1).try_cast("int")
    w = W.partitionBy(*by).orderBy(n.asc_nulls_last(), F.col(confidence).cast("string").try_cast("double").desc_nulls_last(), pos)
    return rows.withColumn("place", F.row_number().over(w))


def align(risks: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """Each node of a risk beside the propagation result of the same kind, name and file: ``risks`` plus ``matched`` and ``n_chains``; none found gives false and 0."""
    key = [*by, "kind", "qualified_name", "file_path"]
    r = results.groupBy(*key).agg(F.max("matched").alias("matched"), F.max("n_chains").alias("n_chains"))
    return risks.join(r, key, "left").fillna(False, ["matched"]).fillna(0, ["n_chains"])


def normal_nodes(nodes: Column) -> Column:
    """Node references with kind and name, trimmed, filePath '' by default; others go."""
    some = lambda x: F.trim(F.coalesce(x, F.lit("")))
    clean = F.transform(nodes, lambda n: F.struct(some(n["kind"]).alias("kind"), some(n["qualifiedName"]).alias("qualifiedName"), some(n["filePath"]).alias("filePath")))
    return F.filter(clean, lambda n: (n["kind"] != "") & (n["qualifiedName"] != ""))


def distinct_nodes(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First occurrence of each (kind in any case, name, file) per ``by``; needs kind, qualified_name, file_path."""
    w = W.partitionBy(*by, F.upper("kind"), "qualified_name", "file_path").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prompt(template: str, **values: Column) -> Column:
    """``<<<KEY>>>`` replaced by the compact JSON of each value."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit(f"<<<{k}>>>"), F.coalesce(v, F.lit("null")))
    return out


def status_code(x: Column) -> Column:
    """A status from text or number: whole part, 0 if there is none."""
    return F.coalesce(x.try_cast("double").cast("int"), F.lit(0))


def pusher(payload: Column) -> Column:
    """The pusher of a push payload: a text, or its name, else ``unknown``."""
    p, n = F.get_json_object(payload, "$.pusher"), F.get_json_object(payload, "$.pusher.name")
    flat = F.when(~p.startswith("{"), p)
    return F.coalesce(F.nullif(F.trim(n), F.lit("")), F.nullif(F.trim(flat), F.lit("")), F.lit("unknown"))


COMMIT = "struct<id:string,message:string,author:struct<name:string,email:string>>"


def tip_author(payload: Column) -> Column:
    """Author name of the pushed tip: of head_commit if it is the tip or unnamed, else of the matching commit, else of head_commit."""
    after = F.lower(F.get_json_object(payload, "$.after"))
    head = F.from_json(F.get_json_object(payload, "$.head_commit"), COMMIT)
    commits = F.from_json(F.get_json_object(payload, "$.commits"), f"array<{COMMIT}>")
    match = F.get(F.filter(commits, lambda c: F.lower(c["id"]) == after), 0)
    own = F.when(head["id"].isNull() | (F.lower(head["id"]) == after), head["author"]["name"])
    return F.coalesce(own, match["author"]["name"], head["author"]["name"])


def messages(payload: Column) -> Column:
    """Messages of all commits that have one."""
    commits = F.from_json(F.get_json_object(payload, "$.commits"), f"array<{COMMIT}>")
    return F.coalesce(F.transform(F.filter(commits, lambda c: c["message"].isNotNull()), lambda c: c["message"]), F.array().cast("array<string>"))
