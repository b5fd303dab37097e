"""Named queries of the general data-processing problems: hot keys, hierarchies, dangling references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.hierarchy import descendants, resolve, with_counts
from codeweft.operators.orphans import orphan_references, orphan_report
from codeweft.operators.tree_aggregate import State, heavy_keys, tree_aggregate
from codeweft.session import table

HOT_SHARE = 0.02
#: Node tables by lower-case label, with their key.
NODE_TABLES = {"package": ("n_package", "id"), "javafile": ("n_java_file", "path"), "type": ("n_type", "qualified_name"), "method": ("n_method", "id")}


# Hot keys


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "edges"), "dst", HOT_SHARE).select("dst")


def p2_per_dst(spark: SparkSession, d: str) -> DataFrame:
    """Complete results for every dst: rows, calls, line span, first and last writing."""
    e = table(spark, d, "edges")
    states = [
        State("n_rows", "count", F.lit(1)), State("n_calls", "sum", F.when(F.col("rel_type") == "CALLS", 1).otherwise(0)),
        State("min_line", "min", F.col("line_no")), State("max_line", "max", F.col("line_no")),
        State("first_written", "min", F.col("written_at")), State("last_written", "max", F.col("written_at")),
    ]
    return tree_aggregate(e, ["dst"], states)


# Hierarchies


def parent_links(spark: SparkSession, d: str) -> DataFrame:
    """(h, child, parent) of the package, type and nesting hierarchies."""
    e = table(spark, d, "edges").where(F.col("rel_type").isin("CONTAINS_SUB", "EXTENDS", "INNER_CLASS_OF"))
    down = F.col("rel_type") == "CONTAINS_SUB"
    links = e.select(F.col("rel_type").alias("h"), F.when(down, F.col("dst")).otherwise(F.col("src")).alias("child"), F.when(down, F.col("src")).otherwise(F.col("dst")).alias("parent"))
    owners = table(spark, d, "n_method").select(F.lit("INNER_CLASS_OF").alias("h"), F.col("id").alias("child"), F.col("owner_qualified_name").alias("parent"))
    return links.unionByName(owners)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve(parent_links(spark, d)).select(F.col("h").alias("rel_type"), "node_id", "root_id", "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path (root first), depth, root and number of descendants of every node with a parent."""
    r = with_counts(resolve(parent_links(spark, d), paths=True))
    return r.select(F.col("h").alias("rel_type"), "node_id", "root_id", "depth", F.array_join("path", ">").alias("path"), "n_descendants")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every (ancestor, descendant) pair off the cycles, with the distance."""
    return descendants(resolve(parent_links(spark, d), paths=True)).select(F.col("h").alias("rel_type"), "ancestor_id", "node_id", "distance")


# Dangling references


def references(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of every edge in long form."""
    e = table(spark, d, "edges")
    ends = F.array(*(F.struct(F.lit(s).alias("side"), F.lower(f"{s}_label").alias("tbl"), F.col(s).alias("key")) for s in ("src", "dst")))
    return e.select(F.col("edge_id").alias("ref_id"), F.col("written_at").alias("at"), F.explode(ends).alias("x")).select("ref_id", "at", "x.side", "x.tbl", "x.key")


def lifetimes(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, key, since, until) of all node tables and library symbols."""
    out = table(spark, d, "lib_symbols").where(F.col("node_label").isin("Type", "Method")).select(
        F.lower("node_label").alias("tbl"), F.col("node_id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(None).cast("timestamp_ntz").alias("until")
    )
    for label, (name, key) in NODE_TABLES.items():
        t = table(spark, d, name).where("indexed_at is not null")
        out = out.unionByName(t.select(F.lit(label).alias("tbl"), F.col(key).alias("key"), F.col("indexed_at").alias("since"), F.col("deleted_at").alias("until")))
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(references(spark, d), lifetimes(spark, d)).select(F.col("ref_id").alias("edge_id"), "side")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per node table, side and month of written_at."""
    return orphan_report(orphan_references(references(spark, d), lifetimes(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_per_dst, p3_found, p3_paths, p3_descendants, p5_found, p5_report)
}

_LINKS = """
links AS (
  SELECT h, child, min(parent) AS parent FROM (
    SELECT rel_type AS h, CASE WHEN rel_type = 'CONTAINS_SUB' THEN dst ELSE src END AS child,
           CASE WHEN rel_type = 'CONTAINS_SUB' THEN src ELSE dst END AS parent
    FROM edges WHERE rel_type IN ('CONTAINS_SUB', 'EXTENDS', 'INNER_CLASS_OF')
    UNION ALL SELECT 'INNER_CLASS_OF', id, owner_qualified_name FROM n_method)
  WHERE trim(child) <> '' AND trim(parent) <> '' GROUP BY h, child),
up AS (
  SELECT h, child AS node, parent AS anc, 1 AS dist, [parent, child] AS path FROM links
  UNION ALL
  SELECT u.h, u.node, l.parent, u.dist + 1, list_prepend(l.parent, u.path) FROM up u JOIN links l ON l.h = u.h AND l.child = u.anc
  WHERE u.anc <> u.node AND NOT list_contains(u.path[2:], u.anc)),
ring AS (SELECT DISTINCT h, node FROM up WHERE anc = node),
ringroot AS (
  SELECT r.h, r.node, least(r.node, min(u.anc)) AS root FROM ring r JOIN up u ON u.h = r.h AND u.node = r.node GROUP BY r.h, r.node),
tops AS (
  SELECT u.h, u.node, u.anc AS root, u.dist AS depth, u.path FROM up u
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.h = u.h AND l.child = u.anc)),
state AS (
  SELECT h, node, root, depth, path FROM tops
  UNION ALL SELECT h, node, root, -1, NULL FROM ringroot
  UNION ALL SELECT DISTINCT u.h, u.node, rr.root, -2, CAST(NULL AS VARCHAR[]) FROM up u JOIN ringroot rr ON rr.h = u.h AND rr.node = u.anc
  WHERE NOT EXISTS (SELECT 1 FROM ring r WHERE r.h = u.h AND r.node = u.node))
"""

_ORPHANS = """
refs AS (
  SELECT edge_id, 'src' AS side, lower(src_label) AS tbl, src AS key, written_at AS "at" FROM edges
  UNION ALL SELECT edge_id, 'dst', lower(dst_label), dst, written_at FROM edges),
lives AS (
  SELECT 'package' AS tbl, id AS key, indexed_at AS since, deleted_at AS until FROM n_package
  UNION ALL SELECT 'javafile', path, indexed_at, deleted_at FROM n_java_file
  UNION ALL SELECT 'type', qualified_name, indexed_at, deleted_at FROM n_type
  UNION ALL SELECT 'method', id, indexed_at, deleted_at FROM n_method),
orphans AS (
  SELECT * FROM refs r WHERE trim(r.key) <> ''
    AND NOT EXISTS (SELECT 1 FROM lives l WHERE l.tbl = r.tbl AND l.key = r.key AND l.since <= r."at" AND (l.until IS NULL OR l.until > r."at"))
    AND NOT EXISTS (SELECT 1 FROM lib_symbols s WHERE lower(s.node_label) = r.tbl AND s.node_id = r.key))
"""

ORACLE: dict[str, str] = {
    "p2_found": "SELECT dst FROM edges WHERE trim(dst) <> '' GROUP BY dst HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)",
    "p2_per_dst": """SELECT dst, count(*)::BIGINT AS n_rows, sum(CASE WHEN rel_type = 'CALLS' THEN 1 ELSE 0 END)::BIGINT AS n_calls,
        min(line_no) AS min_line, max(line_no) AS max_line, min(written_at) AS first_written, max(written_at) AS last_written FROM edges GROUP BY dst""",
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT h AS rel_type, node AS node_id, root AS root_id, depth::INTEGER AS depth FROM state",
    "p3_paths": f"""WITH RECURSIVE {_LINKS}, below AS (SELECT u.h, u.anc, count(*) AS n FROM up u JOIN tops t ON t.h = u.h AND t.node = u.node GROUP BY u.h, u.anc)
        SELECT s.h AS rel_type, s.node AS node_id, s.root AS root_id, s.depth::INTEGER AS depth, array_to_string(s.path, '>') AS path, coalesce(b.n, 0)::BIGINT AS n_descendants
        FROM state s LEFT JOIN below b ON b.h = s.h AND b.anc = s.node""",
    "p3_descendants": f"""WITH RECURSIVE {_LINKS} SELECT u.h AS rel_type, u.anc AS ancestor_id, u.node AS node_id, u.dist::INTEGER AS distance
        FROM up u JOIN tops t ON t.h = u.h AND t.node = u.node""",
    "p5_found": f"WITH {_ORPHANS} SELECT edge_id, side FROM orphans",
    "p5_report": f"""WITH {_ORPHANS} SELECT tbl, side, strftime("at", '%Y-%m') AS period, count(*)::BIGINT AS n_orphans, count(DISTINCT key)::BIGINT AS n_keys
        FROM orphans GROUP BY tbl, side, strftime("at", '%Y-%m')""",
}
