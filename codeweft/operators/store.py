"""Upsert and delete of node and edge tables without MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.graph import edge_view
from codeweft.session import filled


def last_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: a maximum per key, so partial results are formed before the shuffle."""
    value = [c for c in rows.columns if c not in key]
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("_v"))
    return top.select(*key, *(F.col(f"_v.`{c}`").alias(c) for c in value)).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``old`` with the last row per key of ``new`` written over it."""
    fresh = last_per_key(new, key, order)
    return fresh.unionByName(old.join(fresh.select(*key), key, "left_anti"))


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without the (distinct, filled) ``keys``."""
    return rows.join(keys.where(filled(key)).select(key).distinct(), key, "left_anti")


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes, one per (src, rel_type, dst): no ghost nodes. ``nodes``: (key)."""
    n = nodes.select("key").distinct()
    e = edges.join(n.withColumnRenamed("key", "src"), "src", "left_semi").join(n.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return edge_view(e)


def merged_edges(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """One edge per (src, rel_type, dst) with the line number written last."""
    e = edges.where(filled("src") & filled("dst"))
    return e.groupBy("src", "rel_type", "dst").agg(F.max_by("line_no", order).alias("line_no"))


def changed_files(snapshot: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose (path, checksum) is not stored yet: the rest can be skipped."""
    return snapshot.join(stored.select("path", "checksum").distinct(), ["path", "checksum"], "left_anti")


def file_members(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(key): the files, their types, and the methods and fields of those."""
    p = paths.where(filled("path")).select(F.col("path").alias("src")).distinct()
    types = edge_view(edges, "DEFINES_TYPE").join(p, "src", "left_semi").select(F.col("dst").alias("key")).distinct()
    parts = edge_view(edges, "HAS_METHOD", "HAS_FIELD").join(types.withColumnRenamed("key", "src"), "src", "left_semi").select(F.col("dst").alias("key"))
    return p.select(F.col("src").alias("key")).unionByName(types).unionByName(parts).distinct()


def delete_files(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges left after the files and all they define are gone, at either end."""
    gone = file_members(edges, paths)
    return edges.join(gone.withColumnRenamed("key", "src"), "src", "left_anti").join(gone.withColumnRenamed("key", "dst"), "dst", "left_anti")


def delete_outgoing(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges left after all out-edges of the files, their types and methods are gone."""
    return edges.join(file_members(edges, paths).withColumnRenamed("key", "src"), "src", "left_anti")
