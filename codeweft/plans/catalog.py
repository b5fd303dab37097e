"""Named queries of the graph, vector, text, diff and JSON operators on the domain tables, with their SQL.

Where an operator needs a set of seeds, these are the ends of all edges whose
id is divisible by 50, against the whole tables.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import jsonio, text
from codeweft.operators import context, diff, graph, index, risk, store, trails, vector
from codeweft.sources import files, ingest
from codeweft.streaming import commits

from codeweft.session import cut, filled, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _edges(spark: SparkSession, d: str, *types: str) -> DataFrame:
    return graph.edge_view(table(spark, d, "edges"), *types)


def _seeds(spark: SparkSession, d: str, rel: str, end: str = "src") -> DataFrame:
    e = table(spark, d, "edges").where((F.col("rel_type") == rel) & (F.col("edge_id") % 50 == 0) & filled(end))
    return e.select(F.col(end).alias("seed")).distinct()


def _access(spark: SparkSession, d: str) -> DataFrame:
    """Field accesses: implementing stands for reading, extending for writing."""
    e = _edges(spark, d, "IMPLEMENTS", "EXTENDS")
    return e.withColumn("rel_type", F.when(F.col("rel_type") == "IMPLEMENTS", "READS_FIELD").otherwise("WRITES_FIELD"))


def _all(spark: SparkSession, d: str, rel: str, end: str = "src") -> DataFrame:
    return table(spark, d, "edges").where((F.col("rel_type") == rel) & filled(end)).select(F.col(end).alias("seed")).distinct()


def _a(rel: str, end: str = "src") -> str:
    return f"s AS (SELECT DISTINCT {end} AS seed FROM edges WHERE rel_type = '{rel}' AND trim({end}) <> '')"


def _e(name: str, *types: str) -> str:
    some = ", ".join(f"'{t}'" for t in types)
    return f"{name} AS (SELECT DISTINCT src, rel_type, dst FROM edges WHERE rel_type IN ({some}) AND trim(src) <> '' AND trim(dst) <> '')"


def _s(rel: str, end: str = "src") -> str:
    return f"s AS (SELECT DISTINCT {end} AS seed FROM edges WHERE rel_type = '{rel}' AND edge_id % 50 = 0 AND trim({end}) <> '')"


def _hops(k: int, up: bool, e: str = "c", name: str = "r") -> str:
    a, b = ("dst", "src") if up else ("src", "dst")
    return f"""{name} AS (SELECT s.seed, {e}.{b} AS node, 1 AS hop FROM {e} JOIN s ON {e}.{a} = s.seed
        UNION SELECT {name}.seed, {e}.{b}, {name}.hop + 1 FROM {name} JOIN {e} ON {e}.{a} = {name}.node WHERE {name}.hop < {k})"""


# Reachability


@query(f"WITH RECURSIVE {_e('c', 'CALLS')}, {_s('CALLS')}, {_hops(3, True)} SELECT DISTINCT node FROM r")
def callers_within_k(spark, d):
    return graph.reachable(_seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS"), 3, up=True)


@query(f"WITH RECURSIVE {_e('c', 'CALLS')}, {_s('CALLS')}, {_hops(3, False)} SELECT DISTINCT node FROM r")
def callees_within_k(spark, d):
    return graph.reachable(_seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS"), 3)


@query(f"WITH RECURSIVE {_e('c', 'EXTENDS', 'IMPLEMENTS')}, {_s('EXTENDS', 'dst')}, {_hops(5, True)} SELECT DISTINCT node FROM r")
def subtypes_within_k(spark, d):
    return graph.reachable(_seeds(spark, d, "EXTENDS", "dst"), _edges(spark, d, "EXTENDS", "IMPLEMENTS"), 5, up=True)


@query(f"""WITH RECURSIVE {_e('c', 'CALLS')}, {_e('t', 'EXTENDS', 'IMPLEMENTS')}, s AS (SELECT DISTINCT src AS seed, rel_type FROM edges WHERE rel_type IN ('CALLS') AND edge_id % 50 = 0 AND trim(src) <> ''),
    {_hops(5, True)}, s2 AS (SELECT DISTINCT dst AS seed FROM edges WHERE rel_type = 'EXTENDS' AND edge_id % 50 = 0 AND trim(dst) <> ''),
    r2 AS (SELECT t.src AS node, 1 AS hop FROM t JOIN s2 ON t.dst = s2.seed UNION SELECT t.src, r2.hop + 1 FROM r2 JOIN t ON t.dst = r2.node WHERE r2.hop < 5)
    SELECT DISTINCT 'method' AS kind, node FROM r UNION SELECT DISTINCT 'type', node FROM r2""")
def impact_analysis(spark, d):
    """Callers of changed methods and subtypes of changed types, up to the impact limit."""
    m = graph.reachable(_seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS"), graph.IMPACT_HOPS, up=True)
    t = graph.reachable(_seeds(spark, d, "EXTENDS", "dst"), _edges(spark, d, "EXTENDS", "IMPLEMENTS"), graph.IMPACT_HOPS, up=True)
    return m.select(F.lit("method").alias("kind"), "node").unionByName(t.select(F.lit("type").alias("kind"), "node"))


@query(f"WITH RECURSIVE {_e('c', 'CALLS')}, {_s('CALLS')}, {_hops(3, False)} SELECT seed, node, min(hop)::INTEGER AS hop FROM r GROUP BY seed, node")
def min_hop_per_seed(spark, d):
    return graph.hops(_seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS"), 3)


@query(f"WITH RECURSIVE {_e('c', 'CALLS')}, {_s('CALLS')}, {_hops(3, True)} SELECT seed, node, min(hop)::INTEGER AS hop FROM r GROUP BY seed, node")
def min_hop_upstream(spark, d):
    return graph.hops(_seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS"), 3, up=True)


_ATTR = f"""WITH RECURSIVE {_e('c', 'CALLS')}, {_s('CALLS')}, {_hops(2, True, 'c', 'u')}, {_hops(2, False, 'c', 'w')},
    x AS (SELECT seed, node, hop, 'u' AS way FROM u UNION ALL SELECT seed, node, hop, 'd' FROM w UNION ALL SELECT seed, seed, 0, 's' FROM s),
    p AS (SELECT node, seed, min(hop) AS hop, bool_or(way = 'u') AS iu, bool_or(way = 'd') AS id, bool_or(way = 's') AS is_ FROM x GROUP BY node, seed),
    m AS (SELECT *, min(hop) OVER (PARTITION BY node) AS mh, row_number() OVER (PARTITION BY node ORDER BY hop, seed) AS n, count(*) OVER (PARTITION BY node) AS n_seeds FROM p),
    t AS (SELECT node, count(*) > 1 AS tie FROM m WHERE hop = mh GROUP BY node),
    a AS (SELECT m.node, seed AS primary_seed, hop::INTEGER AS hop, tie, CASE WHEN is_ THEN 'seed' WHEN iu AND id THEN 'lateral' WHEN iu THEN 'upstream' ELSE 'downstream' END AS direction, n_seeds::INTEGER AS n_seeds
          FROM m JOIN t ON t.node = m.node WHERE n = 1)"""


def _attributed(spark, d):
    s, c = _seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS")
    return graph.attribution(graph.hops(s, c, 2, up=True), graph.hops(s, c, 2), s)


@query(f"{_ATTR} SELECT * FROM a")
def node_attribution(spark, d):
    a = _attributed(spark, d)
    return a.select("node", "primary_seed", "hop", "tie", "direction", F.size("min_hops").alias("n_seeds"))


@query(f"{_ATTR} SELECT node, hop FROM a WHERE hop = 0 UNION SELECT node, hop FROM (SELECT node, hop FROM a ORDER BY hop, node LIMIT 500)")
def truncate_nodes_by_hop(spark, d):
    return graph.truncate(_attributed(spark, d), 500)


@query(f"""WITH RECURSIVE {_e('c', 'CALLS')}, {_s('CALLS')}, {_hops(2, False)}, n AS (SELECT node FROM r UNION SELECT seed FROM s)
    SELECT src, rel_type, dst FROM c WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""")
def induced_edges(spark, d):
    s, c = _seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS")
    return graph.induced(c, graph.reachable(s, c, 2).unionByName(s.withColumnRenamed("seed", "node")))


@query(f"WITH {_e('c', 'EXTENDS', 'IMPLEMENTS')}, {_a('INNER_CLASS_OF')} SELECT src, rel_type, dst FROM c WHERE src IN (SELECT seed FROM s) OR dst IN (SELECT seed FROM s)")
def edges_touching_scope(spark, d):
    return graph.touching(_edges(spark, d, "EXTENDS", "IMPLEMENTS"), _all(spark, d, "INNER_CLASS_OF").withColumnRenamed("seed", "node"))


@query(f"""WITH {_e('c', 'EXTENDS', 'IMPLEMENTS')}, {_a('INNER_CLASS_OF')} SELECT src, rel_type, dst FROM c WHERE src IN (SELECT seed FROM s)
    UNION ALL SELECT src, rel_type, dst FROM c WHERE dst IN (SELECT seed FROM s)""")
def edges_touching_scope_compat(spark, d):
    return graph.touching(_edges(spark, d, "EXTENDS", "IMPLEMENTS"), _all(spark, d, "INNER_CLASS_OF").withColumnRenamed("seed", "node"), compat=True)


# Trails


def _trail_sql(e: str, k: int, up: bool) -> str:
    a, b = ("dst", "src") if up else ("src", "dst")
    return f"""t AS (SELECT s.seed, c.{b} AS at, 1 AS hop, [s.seed, c.{b}] AS nodes, [c.rel_type] AS types, [c.src || '|' || c.rel_type || '|' || c.dst] AS used FROM c JOIN s ON c.{a} = s.seed
        UNION ALL SELECT t.seed, c.{b}, t.hop + 1, list_append(t.nodes, c.{b}), list_append(t.types, c.rel_type), list_append(t.used, c.src || '|' || c.rel_type || '|' || c.dst)
        FROM t JOIN c ON c.{a} = t.at WHERE t.hop < {k} AND NOT list_contains(t.used, c.src || '|' || c.rel_type || '|' || c.dst)),
      q AS (SELECT seed, hop::INTEGER AS hop, array_to_string(nodes, ' > ') AS nodes, array_to_string(types, ' > ') AS types, row_number() OVER (PARTITION BY seed ORDER BY hop, nodes, types) AS n FROM t)"""


def _flat(t: DataFrame) -> DataFrame:
    return t.select("seed", "hop", F.array_join("nodes", " > ").alias("nodes"), F.array_join("types", " > ").alias("types"))


@query(f"WITH RECURSIVE {_e('c', 'CALLS')}, {_s('CALLS')}, {_trail_sql('c', 3, False)} SELECT seed, hop, nodes, types FROM q WHERE n <= 80")
def trails_downstream_topk(spark, d):
    return _flat(trails.trails(_seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS"), 3))


@query(f"WITH RECURSIVE {_e('c', 'CALLS')}, {_s('CALLS')}, {_trail_sql('c', 3, True)} SELECT seed, hop, nodes, types FROM q WHERE n <= 80")
def trails_upstream_topk(spark, d):
    return _flat(trails.trails(_seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS"), 3, up=True))


@query(f"WITH RECURSIVE {_e('c', 'EXTENDS', 'IMPLEMENTS')}, {_s('EXTENDS', 'dst')}, {_trail_sql('c', 6, True)} SELECT seed, hop, nodes, types FROM q WHERE n <= 80")
def hierarchy_chains(spark, d):
    return _flat(trails.trails(_seeds(spark, d, "EXTENDS", "dst"), _edges(spark, d, "EXTENDS", "IMPLEMENTS"), 6, up=True))


@query(f"WITH RECURSIVE {_e('c', 'DEPENDS_ON')}, {_s('DEPENDS_ON')}, {_trail_sql('c', 3, False)} SELECT seed, hop, nodes, types FROM q WHERE n <= 80")
def depends_chains(spark, d):
    return _flat(trails.trails(_seeds(spark, d, "DEPENDS_ON"), _edges(spark, d, "DEPENDS_ON"), 3))


@query(f"""WITH RECURSIVE {_e('c', 'CALLS')}, {_s('CALLS')}, {_trail_sql('c', 3, False)}
    SELECT seed, hop::INTEGER AS hop, array_to_string(nodes, ' > ') AS nodes, array_to_string(types, ' > ') AS types FROM t ORDER BY t.hop, t.nodes, t.seed, t.types LIMIT 80""")
def sample_paths(spark, d):
    return _flat(trails.sample_paths(_seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS"), 3, 200))


# Typed neighbourhoods


_ACC = "f AS (SELECT DISTINCT src, CASE WHEN rel_type = 'IMPLEMENTS' THEN 'READS_FIELD' ELSE 'WRITES_FIELD' END AS rel_type, dst FROM edges WHERE rel_type IN ('IMPLEMENTS', 'EXTENDS') AND trim(src) <> '' AND trim(dst) <> '')"


@query(f"""WITH {_ACC} SELECT dst AS field, coalesce(array_to_string(list_sort(list(DISTINCT src) FILTER (rel_type = 'READS_FIELD')), ','), '') AS readers,
    coalesce(array_to_string(list_sort(list(DISTINCT src) FILTER (rel_type = 'WRITES_FIELD')), ','), '') AS writers FROM f GROUP BY dst""")
def field_coupling(spark, d):
    return graph.field_coupling(_access(spark, d)).select("field", F.array_join("readers", ",").alias("readers"), F.array_join("writers", ",").alias("writers"))


@query(f"""WITH {_ACC}, {_s('EXTENDS')} SELECT a.src AS seed, a.dst AS field, b.src AS other, a.rel_type AS first_type, b.rel_type AS second_type
    FROM f a JOIN s ON s.seed = a.src JOIN f b ON a.dst = b.dst WHERE b.src <> a.src""")
def method_field_method(spark, d):
    return graph.through_hub(_access(spark, d), _seeds(spark, d, "EXTENDS"))


@query(f"""WITH {_e('c', 'HAS_METHOD')} SELECT src AS type, dst AS member FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM c) WHERE n <= 200""")
def type_members(spark, d):
    return graph.top_per(_edges(spark, d, "HAS_METHOD"), ["src"], ["dst"], 200).select(F.col("src").alias("type"), F.col("dst").alias("member"))


@query(f"WITH {_e('c', 'HAS_METHOD')} SELECT dst AS member, min(src) AS owner FROM c GROUP BY dst")
def owner_lookup(spark, d):
    return _edges(spark, d, "HAS_METHOD").groupBy(F.col("dst").alias("member")).agg(F.min("src").alias("owner"))


@query(f"WITH {_e('c', 'HAS_METHOD')}, {_a('INNER_CLASS_OF')} SELECT DISTINCT dst AS method FROM c JOIN s ON s.seed = c.src")
def methods_by_type(spark, d):
    return _edges(spark, d, "HAS_METHOD").join(_all(spark, d, "INNER_CLASS_OF").withColumnRenamed("seed", "src"), "src", "left_semi").select(F.col("dst").alias("method")).distinct()


@query(f"""WITH {_e('df', 'DEFINES_TYPE')}, {_e('hm', 'HAS_METHOD')}, p AS (SELECT DISTINCT src AS p FROM edges WHERE rel_type = 'DEFINES_TYPE' UNION SELECT relative_path FROM n_java_file),
    f AS (SELECT DISTINCT path FROM n_java_file WHERE path IN (SELECT p FROM p) OR (relative_path <> '' AND relative_path IN (SELECT p FROM p)))
    SELECT DISTINCT hm.dst AS method FROM f JOIN df ON df.src = f.path JOIN hm ON hm.src = df.dst""")
def methods_by_file_or(spark, d):
    """Methods of files named by path or relative path: two equi-joins instead of an OR."""
    f = table(spark, d, "n_java_file")
    p = table(spark, d, "edges").where("rel_type = 'DEFINES_TYPE'").select(F.col("src").alias("p"))
    p = p.unionByName(f.select(F.col("relative_path").alias("p"))).where(filled("p")).distinct()
    named = f.join(p, f["path"] == p["p"], "left_semi").select("path").unionByName(f.join(p, f["relative_path"] == p["p"], "left_semi").select("path")).distinct()
    t = _edges(spark, d, "DEFINES_TYPE").join(named.withColumnRenamed("path", "src"), "src", "left_semi").select(F.col("dst").alias("src"))
    return _edges(spark, d, "HAS_METHOD").join(t.distinct(), "src", "left_semi").select(F.col("dst").alias("method")).distinct()


@query(f"""WITH {_e('hm', 'HAS_METHOD')}, {_e('df', 'DEFINES_TYPE')}, {_e('cf', 'CONTAINS_FILE')}, {_s('CALLS')}
    SELECT DISTINCT s.seed AS method, hm.src AS type, df.src AS file, cf.src AS package FROM s JOIN hm ON hm.dst = s.seed JOIN df ON df.dst = hm.src LEFT JOIN cf ON cf.dst = df.src ORDER BY 1, 2, 3, 4 LIMIT 500""")
def structure_optional_package(spark, d):
    hm = _edges(spark, d, "HAS_METHOD").select(F.col("dst").alias("method"), F.col("src").alias("type"))
    df = _edges(spark, d, "DEFINES_TYPE").select(F.col("dst").alias("type"), F.col("src").alias("file"))
    cf = _edges(spark, d, "CONTAINS_FILE").select(F.col("dst").alias("file"), F.col("src").alias("package"))
    j = _seeds(spark, d, "CALLS").withColumnRenamed("seed", "method").join(hm, "method").join(df, "type").join(cf, "file", "left")
    return j.select("method", "type", "file", "package").distinct().orderBy(*(F.col(c).asc_nulls_last() for c in ("method", "type", "file", "package"))).limit(500)


@query(f"""WITH {_e('df', 'DEFINES_TYPE')}, {_e('im', 'IMPORTS')}, {_s('INNER_CLASS_OF')} SELECT DISTINCT s.seed AS type, df.src AS file, im.dst AS imported
    FROM s JOIN df ON df.dst = s.seed JOIN im ON im.src = df.src ORDER BY 1, 2, 3 LIMIT 200""")
def imports_limit(spark, d):
    df = _edges(spark, d, "DEFINES_TYPE").select(F.col("dst").alias("type"), F.col("src").alias("file"))
    im = _edges(spark, d, "IMPORTS").select(F.col("src").alias("file"), F.col("dst").alias("imported"))
    return _seeds(spark, d, "INNER_CLASS_OF").withColumnRenamed("seed", "type").join(df, "type").join(im, "file").select("type", "file", "imported").distinct().orderBy("type", "file", "imported").limit(200)


_ATTRIBUTES = ("simple_name", "signature", "owner_qualified_name", "access_modifier", "file_path", "line_start", "line_end", "kind")
_METHOD_ATTR, _TYPE_ATTR = _ATTRIBUTES[:-1], ("simple_name", "access_modifier", "file_path", "line_start", "line_end", "kind")


@query(f"""WITH i AS (SELECT DISTINCT dst AS id FROM edges WHERE trim(dst) <> ''),
    m AS (SELECT id, {', '.join(f'min({c}) AS {c}' for c in _METHOD_ATTR)} FROM n_method GROUP BY id),
    t AS (SELECT qualified_name AS id, {', '.join(f'min({c}) AS {c}' for c in _TYPE_ATTR)} FROM n_type GROUP BY 1)
    SELECT i.id, CASE WHEN m.id IS NOT NULL THEN 'Method' ELSE 'Type' END AS label, m.signature, m.owner_qualified_name, t.kind,
      {', '.join(f'coalesce(m.{c}, t.{c}) AS {c}' for c in _TYPE_ATTR[:-1])}
    FROM i LEFT JOIN m ON m.id = i.id LEFT JOIN t ON t.id = i.id WHERE m.id IS NOT NULL OR t.id IS NOT NULL""")
def node_details_coalesce(spark, d):
    """Attributes of every node that an edge leads to, methods before types."""
    one = lambda t, key, cols: table(spark, d, t).groupBy(F.col(key).alias("id")).agg(F.struct(*(F.min(c).alias(c) for c in cols)).alias(t))
    i = table(spark, d, "edges").where(filled("dst")).select(F.col("dst").alias("id")).distinct()
    j = i.join(one("n_method", "id", _METHOD_ATTR), "id", "left").join(one("n_type", "qualified_name", _TYPE_ATTR), "id", "left").where("n_method is not null or n_type is not null")
    both = [F.coalesce(f"n_method.{c}", f"n_type.{c}").alias(c) for c in _TYPE_ATTR[:-1]]
    return j.select("id", F.when(F.col("n_method").isNotNull(), "Method").otherwise("Type").alias("label"), "n_method.signature", "n_method.owner_qualified_name", "n_type.kind", *both)


@query(f"""WITH r AS (SELECT DISTINCT e.src AS seed, t.repo_id FROM edges e JOIN index_tasks t ON t.id = e.task_id WHERE e.rel_type = 'CALLS' AND trim(e.src) <> '')
    SELECT r.seed, r.repo_id, k.id IS NOT NULL AS found FROM r LEFT JOIN (SELECT DISTINCT m.id, f.repo_id FROM n_method m JOIN n_java_file f ON f.path = m.file_path) k ON k.id = r.seed AND k.repo_id = r.repo_id""")
def seed_exists_in_repo(spark, d):
    e = table(spark, d, "edges").where((F.col("rel_type") == "CALLS") & filled("src")).select(F.col("src").alias("seed"), "task_id")
    r = e.join(table(spark, d, "index_tasks").select(F.col("id").alias("task_id"), "repo_id").distinct(), "task_id").select("seed", "repo_id").distinct()
    m = table(spark, d, "n_method").select(F.col("id").alias("seed"), F.col("file_path").alias("path")).distinct()
    known = m.join(table(spark, d, "n_java_file").select("path", "repo_id").distinct(), "path").select("seed", "repo_id", F.lit(True).alias("found")).distinct()
    return r.join(known, ["seed", "repo_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query(f"""WITH {_e('df', 'DEFINES_TYPE')}, {_e('hm', 'HAS_METHOD')} SELECT df.src AS file, count(DISTINCT df.dst)::BIGINT AS n_types, count(DISTINCT hm.dst)::BIGINT AS n_methods FROM df LEFT JOIN hm ON hm.src = df.dst GROUP BY df.src""")
def embedding_keys_per_file(spark, d):
    hm = _edges(spark, d, "HAS_METHOD").select(F.col("src").alias("dst"), F.col("dst").alias("m"))
    return _edges(spark, d, "DEFINES_TYPE").join(hm, "dst", "left").groupBy(F.col("src").alias("file")).agg(F.countDistinct("dst").alias("n_types"), F.countDistinct("m").alias("n_methods"))


@query("""WITH a AS (SELECT repo_id, count(DISTINCT trigger_commit) AS n FROM index_tasks GROUP BY 1), b AS (SELECT repo_id, count(DISTINCT commit_hash) AS n FROM documents GROUP BY 1)
    SELECT r.id AS repo_id, coalesce(a.n, 0)::BIGINT AS n_task_commits, coalesce(b.n, 0)::BIGINT AS n_doc_commits FROM repositories r LEFT JOIN a ON a.repo_id = r.id LEFT JOIN b ON b.repo_id = r.id""")
def commit_seeds(spark, d):
    """Two independent outer joins, each side aggregated first."""
    a = table(spark, d, "index_tasks").groupBy("repo_id").agg(F.countDistinct("trigger_commit").alias("a"))
    b = table(spark, d, "documents").groupBy("repo_id").agg(F.countDistinct("commit_hash").alias("b"))
    r = table(spark, d, "repositories").select(F.col("id").alias("repo_id"))
    return r.join(a, "repo_id", "left").join(b, "repo_id", "left").select("repo_id", F.coalesce("a", F.lit(0)).alias("n_task_commits"), F.coalesce("b", F.lit(0)).alias("n_doc_commits"))


# Aggregations and sets


@query("SELECT rel_type, count(*)::BIGINT AS n FROM edges GROUP BY rel_type")
def relation_histogram(spark, d):
    return table(spark, d, "edges").groupBy("rel_type").agg(F.count("*").alias("n"))


@query("""SELECT 'methods' AS what, count(DISTINCT id)::BIGINT AS n FROM n_method UNION ALL SELECT 'types', count(DISTINCT qualified_name) FROM n_type UNION ALL SELECT 'files', count(DISTINCT path) FROM n_java_file
    UNION ALL SELECT 'packages', count(DISTINCT id) FROM n_package UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT src, rel_type, dst FROM edges WHERE trim(src) <> '' AND trim(dst) <> '')""")
def summary_counts(spark, d):
    one = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    out = one("relations", _edges(spark, d))
    for what, t, k in (("methods", "n_method", "id"), ("types", "n_type", "qualified_name"), ("files", "n_java_file", "path"), ("packages", "n_package", "id")):
        out = out.unionByName(one(what, table(spark, d, t).where(F.col(k).isNotNull()).select(k).distinct()))
    return out


@query(f"""WITH a AS (SELECT DISTINCT dst AS seed FROM edges WHERE rel_type = 'HAS_METHOD' AND edge_id % 50 = 0 AND trim(dst) <> ''), {_s('CALLS')}
    SELECT seed, max(p) AS provenance FROM (SELECT seed, 'commit' AS p FROM a UNION ALL SELECT seed, 'request' FROM s) GROUP BY seed""")
def seed_union_provenance(spark, d):
    return context.seed_union(("request", _seeds(spark, d, "CALLS")), ("commit", _seeds(spark, d, "HAS_METHOD", "dst")))


@query("SELECT id, name, row_number() OVER (ORDER BY create_time, id)::INTEGER AS place FROM repositories WHERE status = 1")
def active_repos_ordered(spark, d):
    r = table(spark, d, "repositories").where("status = 1").select(F.struct("create_time", "id", "name").alias("x"))
    return r.agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.posexplode("x").alias("p", "x")).select("x.id", "x.name", (F.col("p") + 1).alias("place"))  # a registry of fixed size


_URL = "regexp_replace(regexp_replace(regexp_replace(lower(trim(clone_url)), '/$', ''), '^git@([^:]+):(.*)$', 'https://\\1/\\2'), '\\.git$', '')"


@query(f"SELECT id, {_URL} AS url FROM repositories")
def clone_url_normalize(spark, d):
    return table(spark, d, "repositories").select("id", text.clone_url("clone_url").alias("url"))


@query(f"SELECT {_URL} AS url, arg_min(id, (create_time, id)) AS id, count(*)::BIGINT AS n FROM repositories WHERE status = 1 GROUP BY 1")
def active_repo_by_url(spark, d):
    r = table(spark, d, "repositories").where("status = 1").withColumn("url", text.clone_url("clone_url"))
    return r.groupBy("url").agg(F.min_by("id", F.struct("create_time", "id")).alias("id"), F.count("*").alias("n"))


@query("""SELECT DISTINCT repo_id, commit_hash FROM documents d WHERE repo_id IS NOT NULL AND commit_hash IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM index_tasks t WHERE t.status = 2 AND t.repo_id = d.repo_id AND t.trigger_commit = d.commit_hash)""")
def processed_commit_antijoin(spark, d):
    done = table(spark, d, "index_tasks").where("status = 2").select("repo_id", F.col("trigger_commit").alias("commit_hash"))
    return commits.fresh(table(spark, d, "documents").where("repo_id is not null and commit_hash is not null").select("repo_id", "commit_hash"), done)


@query("""SELECT repo_id, count(*)::BIGINT AS n, sum(CASE WHEN status = 2 THEN 1 ELSE 0 END)::BIGINT AS ok, sum(CASE WHEN status = 3 THEN 1 ELSE 0 END)::BIGINT AS failed,
    sum(CASE WHEN trigger_commit IS NULL OR trim(trigger_commit) = '' OR regexp_matches(trigger_commit, '^0{40}$') THEN 1 ELSE 0 END)::BIGINT AS no_commit FROM index_tasks GROUP BY repo_id""")
def task_outcomes(spark, d):
    ok, bad = F.col("status") == 2, F.col("status") == 3
    return table(spark, d, "index_tasks").groupBy("repo_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if(bad).alias("failed"), F.count_if(text.null_sha("trigger_commit")).alias("no_commit")
    )


# Store


@query("""SELECT DISTINCT path, md5(content) AS checksum FROM source_files s WHERE content IS NOT NULL AND path LIKE '%.java'
    AND NOT EXISTS (SELECT 1 FROM n_java_file f WHERE f.indexed_at < '2023-10-01' AND f.path = s.path AND f.checksum = md5(s.content))""")
def checksum_skip(spark, d):
    snap = table(spark, d, "source_files").where(F.col("content").isNotNull() & F.col("path").endswith(".java")).select("path", F.md5("content").alias("checksum")).distinct()
    stored = table(spark, d, "n_java_file").where("indexed_at < timestamp_ntz'2023-10-01'")
    return store.changed_files(snap, stored).select("path", "checksum")


@query("""WITH m AS (SELECT '2023-09-01'::TIMESTAMP AS a, '2024-09-01'::TIMESTAMP AS b),
    o AS (SELECT path, min(checksum) AS c FROM n_java_file, m WHERE indexed_at <= a AND (deleted_at IS NULL OR deleted_at > a) GROUP BY path),
    n AS (SELECT path, min(checksum) AS c FROM n_java_file, m WHERE indexed_at <= b AND (deleted_at IS NULL OR deleted_at > b) GROUP BY path)
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'ADDED' WHEN n.path IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change_type
    FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.c IS DISTINCT FROM n.c""")
def snapshot_diff(spark, d):
    f = table(spark, d, "n_java_file")
    at = lambda t: f.where(f"indexed_at <= timestamp_ntz'{t}' and (deleted_at is null or deleted_at > timestamp_ntz'{t}')").groupBy("path").agg(F.min("checksum").alias("checksum"))
    return diff.snapshot_diff(at("2023-09-01"), at("2024-09-01"))


@query("""WITH t AS (SELECT DISTINCT repo_id, task_type, id, status, start_time FROM index_tasks),
    o AS (SELECT * FROM t WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY repo_id, task_type ORDER BY id DESC, coalesce(start_time, '1900-01-01'::TIMESTAMP) DESC, status DESC) = 1),
    n AS (SELECT * FROM t WHERE id % 2 = 1 AND status = 2 QUALIFY row_number() OVER (PARTITION BY repo_id, task_type ORDER BY id DESC, coalesce(start_time, '1900-01-01'::TIMESTAMP) DESC, status DESC) = 1)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.repo_id IS NOT DISTINCT FROM o.repo_id AND n.task_type IS NOT DISTINCT FROM o.task_type)""")
def upsert_last_wins(spark, d):
    """The finished odd tasks written over the even ones: new keys come in, the others keep their old row."""
    t = table(spark, d, "index_tasks").select("repo_id", "task_type", "id", "status", "start_time").withColumn("_s", F.coalesce("start_time", F.lit("1900-01-01").cast("timestamp_ntz")))
    old = store.last_per_key(t.where("id % 2 = 0"), ["repo_id", "task_type"], ["id", "_s", "status"])
    return store.upsert(old, t.where("id % 2 = 1 and status = 2"), ["repo_id", "task_type"], ["id", "_s", "status"]).drop("_s")


_GONE = f"""{_e('df', 'DEFINES_TYPE')}, {_e('hm', 'HAS_METHOD', 'HAS_FIELD')}, p AS (SELECT DISTINCT src AS k FROM edges WHERE rel_type = 'DEFINES_TYPE' AND edge_id % 50 = 0 AND trim(src) <> ''),
    t AS (SELECT DISTINCT df.dst AS k FROM df JOIN p ON p.k = df.src), g AS (SELECT k FROM p UNION SELECT k FROM t UNION SELECT hm.dst FROM hm JOIN t ON t.k = hm.src)"""


def _paths(spark, d):
    return _seeds(spark, d, "DEFINES_TYPE").withColumnRenamed("seed", "path")


@query(f"WITH {_GONE} SELECT edge_id FROM edges WHERE NOT EXISTS (SELECT 1 FROM g WHERE k = src) AND NOT EXISTS (SELECT 1 FROM g WHERE k = dst)")
def delete_file_cascade(spark, d):
    return store.delete_files(table(spark, d, "edges"), _paths(spark, d)).select("edge_id")


@query(f"WITH {_GONE} SELECT edge_id FROM edges WHERE NOT EXISTS (SELECT 1 FROM g WHERE k = src)")
def delete_file_outgoing(spark, d):
    return store.delete_outgoing(table(spark, d, "edges"), _paths(spark, d)).select("edge_id")


@query("""WITH n AS (SELECT id AS k FROM n_method UNION SELECT qualified_name FROM n_type UNION SELECT path FROM n_java_file UNION SELECT id FROM n_package)
    SELECT DISTINCT src, rel_type, dst FROM edges WHERE trim(src) <> '' AND trim(dst) <> '' AND src IN (SELECT k FROM n WHERE k IS NOT NULL) AND dst IN (SELECT k FROM n WHERE k IS NOT NULL)""")
def edge_endpoint_filter(spark, d):
    keys = [table(spark, d, t).select(F.col(k).alias("key")) for t, k in (("n_method", "id"), ("n_type", "qualified_name"), ("n_java_file", "path"), ("n_package", "id"))]
    return store.known_ends(table(spark, d, "edges"), keys[0].union(keys[1]).union(keys[2]).union(keys[3]))


@query("SELECT src, rel_type, dst, arg_max_null(line_no, edge_id) AS line_no FROM edges WHERE trim(src) <> '' AND trim(dst) <> '' GROUP BY src, rel_type, dst")
def edge_merge_last_line(spark, d):
    return store.merged_edges(table(spark, d, "edges"))


@query("""SELECT DISTINCT qualified_name AS node_id, 'TYPE' AS node_type, concat_ws(' ', kind, qualified_name) AS text FROM n_type WHERE trim(qualified_name) <> ''
    UNION SELECT id, 'METHOD', signature FROM n_method WHERE trim(id) <> '' AND trim(signature) <> ''""")
def embedding_texts(spark, d):
    return vector.embedding_texts(table(spark, d, "n_type"), table(spark, d, "n_method"))


@query("SELECT DISTINCT node_id FROM code_node_embedding WHERE node_id IS NOT NULL AND node_id NOT IN (SELECT id FROM n_method WHERE deleted_at IS NOT NULL AND trim(id) <> '')")
def delete_embeddings(spark, d):
    gone = table(spark, d, "n_method").where("deleted_at is not null").select(F.col("id").alias("node_id"))
    return store.delete(table(spark, d, "code_node_embedding").where("node_id is not null"), gone, "node_id").select("node_id").distinct()


# Vectors


def _vec_sql(where: str, least: float) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
      v AS (SELECT node_id AS id, embedding::DOUBLE[] AS e FROM code_node_embedding WHERE trim(node_id) <> '' AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 {where}),
      x AS (SELECT query_id, id, max(round(list_inner_product(q, e), 9)) AS score FROM q, v GROUP BY query_id, id),
      h AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM x WHERE score >= {least} QUALIFY place <= 10)"""


def _search(spark, d, where: str, least: float | None) -> DataFrame:
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    v = table(spark, d, "code_node_embedding").where(where).select(F.col("node_id").alias("id"), "embedding")
    return vector.search(q, v, 10, least)


@query(_vec_sql("", -1e9) + " SELECT query_id, id, round(score, 6) AS score, place::INTEGER AS place FROM h")
def vector_multi_query(spark, d):
    return _search(spark, d, "true", None).select("query_id", "id", F.round("score", 6).alias("score"), F.col("place").cast("int").alias("place"))


@query(_vec_sql("AND upper(node_type) = 'METHOD' AND repo_id IS NOT NULL", 0.3) + " SELECT query_id, id, round(score, 6) AS score, place::INTEGER AS place FROM h")
def vector_topk_filtered_minscore(spark, d):
    return _search(spark, d, "upper(node_type) = 'METHOD' and repo_id is not null", 0.3).select("query_id", "id", F.round("score", 6).alias("score"), F.col("place").cast("int").alias("place"))


@query(_vec_sql("", 0.2) + f""", n AS (SELECT DISTINCT node_id AS id, upper(node_type) AS t FROM code_node_embedding), {_e('hm', 'HAS_METHOD')}
    SELECT DISTINCT seed FROM (SELECT h.id AS seed FROM h JOIN n USING (id) WHERE t = 'METHOD' UNION ALL SELECT hm.dst FROM h JOIN n USING (id) JOIN hm ON hm.src = h.id WHERE t = 'TYPE')""")
def vector_hits_to_seeds(spark, d):
    nodes = table(spark, d, "code_node_embedding").select(F.col("node_id").alias("id"), "node_type")
    return vector.hits_to_seeds(_search(spark, d, "true", 0.2), nodes, _edges(spark, d, "HAS_METHOD"))


# Text


def _newest(spark, d) -> DataFrame:
    s = table(spark, d, "source_files").where("content is not null").groupBy("path").agg(F.max(F.struct("scanned_at", "content", "n_bytes")).alias("x"))
    return s.select("path", F.regexp_replace("path", "^/data/checkouts/", "").alias("relative_path"), "x.content", "x.n_bytes")


_FILES = r"""f AS (SELECT path, regexp_replace(path, '^/data/checkouts/', '') AS rel, x.content AS content, x.n_bytes AS n_bytes FROM (
      SELECT path, max({'a': scanned_at, 'content': content, 'n_bytes': n_bytes}) AS x FROM source_files WHERE content IS NOT NULL GROUP BY path)),
    g AS (SELECT * FROM f WHERE GLOB AND n_bytes <= 2097152 AND len(list_intersect(string_split(rel, '/')[1:-2], ['.git', '.svn', '.hg', '.idea', '.gradle', 'node_modules', 'target', 'build', 'dist', 'out', '.mvn'])) = 0),
    a AS (SELECT rel, regexp_split_to_array(content, '\r\n|\r|\n') AS l FROM g),
    b AS (SELECT rel, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM a),
    l AS (SELECT rel AS path, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM b)"""
_JAVA, _JS = _FILES.replace("GLOB", "rel LIKE '%.java'"), _FILES.replace("GLOB", "rel LIKE '%.js'")
_HIT = "SELECT path, n::INTEGER AS line_number, CASE WHEN length(line) > 4000 THEN left(line, 4000) || '…' ELSE line END AS line_text FROM l WHERE {} ORDER BY path, n LIMIT 500"


@query(f"WITH {_JAVA} " + _HIT.format("contains(line, 'log.debug(\"merge')"))
def text_search_literal(spark, d):
    return files.search(_newest(spark, d), 'log.debug("merge', max_hits=500, max_files=200_000)["hits"]


@query(f"WITH {_JAVA} " + _HIT.format(r"regexp_matches(line, 'merge\w+\(\d{2}\)')"))
def text_search_regex(spark, d):
    return files.search(_newest(spark, d), r"merge\w+\(\d{2}\)", regex=True, max_hits=500, max_files=200_000)["hits"]


@query(f"WITH {_JS} " + _HIT.format("contains(lower(line), 'panelcopy')"))
def text_search_case_insensitive(spark, d):
    return files.search(_newest(spark, d), "PANELCOPY", ignore_case=True, glob="*.js", max_hits=500, max_files=200_000)["hits"]


@query(f"WITH {_JAVA}, h AS (SELECT 1 FROM l WHERE contains(line, 'return null') LIMIT 100) SELECT count(*)::BIGINT AS n_hits, count(*) >= 100 AS truncated_by_max_hits FROM h")
def text_search_caps(spark, d):
    return files.search(_newest(spark, d), "return null", max_files=200_000)["counts"]


@query(f"WITH {_JAVA.replace('GLOB', 'true')}, z AS (SELECT f.path, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS l FROM f), y AS (SELECT path, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM z) SELECT path, 3 AS start_line, least(7, len(l))::INTEGER AS end_line, CASE WHEN len(l) >= 3 THEN left(array_to_string(l[3:7], chr(10)), 262144) END AS content, CASE WHEN len(l) >= 3 THEN length(array_to_string(l[3:7], chr(10))) > 262144 END AS truncated FROM y")
def snippet_range(spark, d):
    return files.snippets(_newest(spark, d), 3, 7)


@query("SELECT DISTINCT regexp_extract(path, '^(.*src/main/java)/', 1) AS source_root FROM n_java_file WHERE regexp_extract(path, '^(.*src/main/java)/', 1) <> ''")
def source_roots(spark, d):
    return table(spark, d, "n_java_file").select(text.source_root("path").alias("source_root")).where("source_root is not null").distinct()


@query("SELECT id, regexp_replace('refs/heads/' || branch, '^refs/heads/', '') AS branch FROM repositories")
def branch_from_ref(spark, d):
    return table(spark, d, "repositories").select("id", text.branch_of(F.concat(F.lit("refs/heads/"), "branch")).alias("branch"))


@query("""SELECT DISTINCT return_type, string_split(trim(replace(CASE WHEN instr(return_type, '<') > 1 THEN left(return_type, instr(return_type, '<') - 1) ELSE return_type END, '[]', '')), '.')[-1] AS simple
    FROM n_method WHERE return_type IS NOT NULL""")
def strip_simple_name(spark, d):
    return table(spark, d, "n_method").where("return_type is not null").select("return_type", text.simple_type("return_type").alias("simple")).distinct()


@query("SELECT DISTINCT path, to_timestamp(floor(last_modified / 1000)::BIGINT) AT TIME ZONE 'UTC' AS modified FROM n_java_file WHERE last_modified IS NOT NULL")
def epoch_to_timestamp(spark, d):
    return table(spark, d, "n_java_file").where("last_modified is not null").select("path", text.from_epoch_ms("last_modified").cast("timestamp_ntz").alias("modified")).distinct()


@query(r"SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>')) AS digest FROM documents WHERE text IS NOT NULL")
def html_escape_merge(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.escaped_html("text")).alias("digest"))


# JSON in texts


def _json_lines(spark, d) -> DataFrame:
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(text.lines("text")).alias("pos", "line")).where(F.col("line").startswith('{"kind"') & F.col("line").endswith("}"))
    j = x.select("doc_id", "pos", F.from_json("line", "kind string, qualifiedName string, confidence string").alias("j"))
    return j.where("j.kind is not null and j.qualifiedName is not null").select("doc_id", "pos", "j.kind", F.col("j.qualifiedName").alias("qualified_name"), F.lit("").alias("file_path"), F.col("j.confidence").alias("confidence"))


_JSON = r"""a AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM a),
    j AS (SELECT doc_id, pos, json_extract_string(line, '$.kind') AS kind, json_extract_string(line, '$.qualifiedName') AS qualified_name, TRY_CAST(json_extract_string(line, '$.confidence') AS DOUBLE) AS c
          FROM (SELECT * FROM b WHERE line LIKE '{"kind"%}') WHERE json_valid(line) AND json_extract_string(line, '$.kind') IS NOT NULL AND json_extract_string(line, '$.qualifiedName') IS NOT NULL)"""


@query(f"WITH {_JSON} SELECT doc_id, pos::INTEGER AS pos, kind, qualified_name FROM j WHERE c >= 0.5")
def json_confidence_filter(spark, d):
    return _json_lines(spark, d).where(jsonio.confident(F.col("confidence"))).select("doc_id", "pos", "kind", "qualified_name")


@query(f"WITH {_JSON} SELECT doc_id, upper(kind) AS kind, qualified_name, min(pos)::INTEGER AS pos FROM j GROUP BY doc_id, upper(kind), qualified_name")
def node_ref_dedupe(spark, d):
    return jsonio.distinct_nodes(_json_lines(spark, d), ["doc_id"], ["pos"]).select("doc_id", F.upper("kind").alias("kind"), "qualified_name", "pos")


@query(f"""WITH {_JSON}, n AS (SELECT doc_id, count(DISTINCT (upper(kind), qualified_name)) AS n FROM j GROUP BY doc_id)
    SELECT doc_id, n::BIGINT AS n, CASE WHEN n < 20 THEN 30 WHEN n > 50 THEN 10 ELSE round_even(30 - 10 * (n - 20) / 30.0, 0) END::INTEGER AS depth FROM n""")
def depth_from_count(spark, d):
    n = jsonio.distinct_nodes(_json_lines(spark, d), ["doc_id"], ["pos"]).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.withColumn("depth", text.depth_from_count("n"))


@query(f"""WITH {_JSON} SELECT doc_id, pos::INTEGER AS pos, qualified_name,
    row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN pos % 5 < 4 THEN pos % 5 END NULLS LAST, c DESC NULLS LAST, pos)::INTEGER AS place FROM j""")
def report_ordering(spark, d):
    """References by priority, here the position by five (the fifth is unreadable), then confidence."""
    rows = _json_lines(spark, d).withColumn("priority", F.when(F.col("pos") % 5 < 4, F.concat(F.lit("P"), (F.col("pos") % 5).cast("string"))).otherwise("soon"))
    return jsonio.report_order(rows, ["doc_id"], "priority", "confidence", "pos").select("doc_id", "pos", "qualified_name", "place")


@query(f"""WITH {_JSON} SELECT doc_id, 'repo of ' || doc_id AS repo_id, count(*)::BIGINT AS n_nodes, 0::BIGINT AS n_files, true AS fixed FROM j GROUP BY doc_id""")
def change_payload_blocks(spark, d):
    """Payloads whose nodes are a JSON list inside a string, whose files are no list and whose warnings are of a wrong kind."""
    node = F.struct("pos", F.struct("kind", F.col("qualified_name").alias("qualifiedName")).alias("n"))
    lists = _json_lines(spark, d).groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["n"])).alias("nodes"))
    meta = F.struct(F.concat(F.lit("repo of "), F.col("doc_id").cast("string")).alias("repoId"))
    text_ = F.to_json(F.struct(meta.alias("meta"), "nodes", F.lit(7).alias("changedFiles"), F.struct(F.lit("x").alias("warnings"), F.lit(1).alias("more")).alias("truncation")))
    p = lists.select("doc_id", jsonio.change_payload(text_).alias("p"))
    fixed = (F.get_json_object("p.truncation", "$.warnings") == "[]") & (F.get_json_object("p.truncation", "$.more") == "1")
    return p.select("doc_id", F.col("p.repoId").alias("repo_id"), F.size("p.nodes").cast("bigint").alias("n_nodes"), F.size("p.changedFiles").cast("bigint").alias("n_files"), fixed.alias("fixed"))


@query(f"""WITH {_JSON}, n AS (SELECT doc_id, count(*) AS n FROM j GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 3 ELSE 0 END::INTEGER AS depth, CASE WHEN doc_id % 3 > 0 THEN n ELSE 0 END::BIGINT AS n_results,
      CASE WHEN doc_id % 3 > 0 THEN n ELSE 0 END::BIGINT AS n_matched, CASE WHEN doc_id % 3 > 0 THEN 'CALLS' END AS edge_type FROM n""")
def propagation_responses(spark, d):
    """Responses of status 200, "201.0" and 500 with values of wrong kinds among their edge types."""
    seed = F.struct("kind", F.col("qualified_name").alias("qualifiedName"))
    chain = F.struct(F.lit("CALLS").alias("chainKind"), F.lit("x").alias("hopCount"), F.array(F.parse_json(F.lit('"CALLS"')), F.parse_json(F.lit("5"))).alias("edgeTypes"))
    rows = _json_lines(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct(seed.alias("seed"), F.lit(True).alias("matchedInGraph"), F.array(chain).alias("impactChains"))).alias("results"))
    body = F.to_json(F.struct(F.lit("r").alias("repoId"), F.lit(3).alias("effectiveDepth"), "results"))
    status = F.element_at(F.array(F.lit("500"), F.lit("200"), F.lit("201.0")), (F.col("doc_id") % 3 + 1).cast("int"))
    r = rows.select("doc_id", jsonio.propagation_response(status, body).alias("r"))
    first = F.get(F.get(F.get("r.results", 0)["impactChains"], 0)["edgeTypes"], 0)
    return r.select("doc_id", F.col("r.effectiveDepth").alias("depth"), F.size("r.results").cast("bigint").alias("n_results"), F.size(F.filter("r.results", lambda x: x["matchedInGraph"])).cast("bigint").alias("n_matched"), first.alias("edge_type"))


@query(f"""WITH {_JSON}, k AS (SELECT DISTINCT doc_id, kind, qualified_name FROM j),
    f AS (SELECT k.*, EXISTS (SELECT 1 FROM n_method m WHERE m.id = k.qualified_name) AS matched, (SELECT count(*) FROM edges e WHERE e.rel_type = 'CALLS' AND e.src = k.qualified_name) AS n FROM k WHERE doc_id % 2 = 0)
    SELECT k.doc_id, k.kind, k.qualified_name, coalesce(f.matched, false) AS matched, coalesce(f.n, 0)::BIGINT AS n_chains FROM k LEFT JOIN f USING (doc_id, kind, qualified_name)""")
def risk_alignment(spark, d):
    """Named nodes beside their results, which here exist for every other document."""
    k = _json_lines(spark, d).select("doc_id", "kind", "qualified_name", "file_path").distinct()
    hit = table(spark, d, "n_method").select(F.col("id").alias("qualified_name"), F.lit(True).alias("matched")).distinct()
    n = table(spark, d, "edges").where("rel_type = 'CALLS'").groupBy(F.col("src").alias("qualified_name")).agg(F.count("*").alias("n_chains"))
    results = k.where("doc_id % 2 = 0").join(hit, "qualified_name", "left").join(n, "qualified_name", "left").fillna(False, ["matched"]).fillna(0, ["n_chains"])
    return jsonio.align(k, results, ["doc_id"]).select("doc_id", "kind", "qualified_name", "matched", "n_chains")


@query("""SELECT doc_id, md5(CASE WHEN text = '' THEN '<p>' || doc_id || '</p>' ELSE '<table role="presentation" width="100%" cellpadding="0" cellspacing="0" border="0" style="margin:0;padding:0;"><tr><td align="center" style="padding:0 8px 8px 8px;"><table role="presentation" width="650" cellpadding="0" cellspacing="0" border="0" style="max-width:650px;font-family:Arial,Helvetica,sans-serif;color:#333333;"><tr><td style="font-size:14px;line-height:1.6;text-align:left;">'
    || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</td></tr></table></td></tr></table><br><p>' || doc_id || '</p>' END) AS digest FROM documents WHERE text IS NOT NULL""")
def mail_bodies(spark, d):
    """Texts as summaries above a report."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.merged_html("text", F.concat(F.lit(" <p>"), F.col("doc_id").cast("string"), F.lit("</p> ")))).alias("digest"))


# Diffs


_HUNKS = r"""a AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM a),
    h AS (SELECT doc_id, pos, regexp_extract(line, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@', 1)::INTEGER AS s, regexp_extract(line, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@', 2) AS n
          FROM b WHERE regexp_matches(line, '^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@')),
    hunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS hunk, s AS new_start, (s + CASE WHEN n = '' THEN 1 ELSE n::INTEGER END - 1)::INTEGER AS new_end FROM h)"""


def _hunks(spark, d) -> DataFrame:
    return diff.hunks(table(spark, d, "documents").where("text is not null and contains(text, '@@ -')"), "doc_id", "text")


@query(f"WITH {_HUNKS} SELECT doc_id, hunk, new_start, new_end FROM hunks")
def diff_hunks(spark, d):
    return _hunks(spark, d).select("doc_id", "hunk", "new_start", "new_end")


@query(f"""WITH {_HUNKS}, n AS (SELECT DISTINCT d.doc_id, m.id AS node, m.line_start, m.line_end FROM documents d JOIN n_java_file f ON f.repo_id = d.repo_id JOIN n_method m ON m.file_path = f.path
      WHERE contains(d.text, '@@ -') AND list_contains(regexp_split_to_array(d.text, '[^A-Za-z0-9_$]+'), m.simple_name) AND m.line_start IS NOT NULL AND m.line_end IS NOT NULL)
    SELECT n.doc_id, node, hunk FROM n JOIN hunks h ON h.doc_id = n.doc_id AND new_end >= line_start - 6 AND new_start <= line_end + 6""")
def hunk_overlap(spark, d):
    """Methods that a text names, in its repository, that meet one of its hunks."""
    docs = table(spark, d, "documents").where("text is not null and repo_id is not null and contains(text, '@@ -')")
    words = docs.select("doc_id", "repo_id", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_$]+"))).alias("word"))
    m = table(spark, d, "n_method").where("line_start is not null and line_end is not null and simple_name is not null")
    m = m.join(table(spark, d, "n_java_file").select(F.col("path").alias("file_path"), "repo_id").distinct(), "file_path").select("repo_id", F.col("simple_name").alias("word"), F.col("id").alias("node"), "line_start", "line_end").distinct()
    return diff.overlapping(words.join(m, ["repo_id", "word"]), _hunks(spark, d), "doc_id").select("doc_id", "node", "hunk").distinct()


@query("""SELECT path, old, new FROM (SELECT path, lag(checksum) OVER w AS old, checksum AS new FROM (SELECT DISTINCT path, indexed_at, checksum FROM n_java_file) WINDOW w AS (PARTITION BY path ORDER BY indexed_at, checksum))
    WHERE old IS NOT NULL""")
def file_versions(spark, d):
    """Consecutive lifetimes of a file with their checksums."""
    from pyspark.sql import Window

    s = table(spark, d, "n_java_file").select("path", "indexed_at", "checksum").distinct()
    return s.select("path", F.lag("checksum").over(Window.partitionBy("path").orderBy("indexed_at", "checksum")).alias("old"), F.col("checksum").alias("new")).where("old is not null")


@query()
def diff_line_stats(spark, d):
    """Insertions and deletions between a file and the same file without its comments."""
    f = _newest(spark, d).where(F.col("path").endswith(".java"))
    return diff.line_stats(f.select("path", F.col("content").alias("old"), F.regexp_replace("content", r"(?m)^[ \t]*//.*$\n?", "").alias("new"))).select("path", "insertions", "deletions")


def _uncommented(spark, d) -> DataFrame:
    """(repo, module, path, old, new): Java files beside themselves without line comments, where they have some."""
    f = _newest(spark, d).where(F.col("path").endswith(".java") & F.col("content").rlike(r"(?m)^[ \t]*//") & ~F.col("content").contains("\r"))
    parts = F.split("relative_path", "/")
    return f.select(parts[0].alias("repo"), parts[1].alias("module"), "path", F.col("content").alias("old"), F.regexp_replace("content", r"(?m)^[ \t]*//.*$\n?", "").alias("new"))


@query(r"""WITH f AS (SELECT path, max({'a': scanned_at, 'content': content}) AS x FROM source_files WHERE content IS NOT NULL AND path LIKE '%.java' GROUP BY path),
    l AS (SELECT string_split(path, '/')[4] AS repo, path, len(list_filter(string_split(x.content, chr(10)), lambda y: regexp_matches(y, '^[ \t]*//'))) AS n FROM f WHERE NOT contains(x.content, chr(13)))
    SELECT repo, count(*)::BIGINT AS files, 0::BIGINT AS insertions, sum(n)::BIGINT AS deletions FROM l WHERE n > 0 GROUP BY repo""")
def diff_totals(spark, d):
    """Sums of lines per repository that go when the line comments do."""
    return diff.diff_totals(diff.line_stats(_uncommented(spark, d)), "repo")


@query()
def node_diff_snippets(spark, d):
    """Digest of the part of its file's diff that concerns each method."""
    m = table(spark, d, "n_method").where("id is not null and line_start is not null and line_end is not null").select(F.col("file_path").alias("path"), "id", "line_start", "line_end").distinct()
    f = diff.unified(_uncommented(spark, d)).select("path", "diff")
    return diff.node_snippets(m.join(f.select("path"), "path", "left_semi"), f).select("path", "id", "line_start", F.md5("snippet").alias("digest"), F.length("snippet").alias("n_chars"))


@query("""WITH v AS (SELECT s.c AS commit_hash, path, min(checksum) AS k FROM n_java_file, (SELECT unnest(['2023-06-01', '2023-09-01', '2024-09-01']) AS c) s
      WHERE indexed_at <= s.c::TIMESTAMP AND (deleted_at IS NULL OR deleted_at > s.c::TIMESTAMP) GROUP BY 1, 2),
    p AS (SELECT * FROM (VALUES ('2023-09-01', '2023-06-01'), ('2024-09-01', '2023-09-01')) t(c, parent)),
    o AS (SELECT p.c AS commit_hash, v.path, v.k FROM v JOIN p ON p.parent = v.commit_hash)
    SELECT coalesce(o.commit_hash, v.commit_hash) AS commit_hash, coalesce(o.path, v.path) AS path, CASE WHEN o.path IS NULL THEN 'ADDED' WHEN v.path IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change_type
    FROM v FULL JOIN o ON o.commit_hash = v.commit_hash AND o.path = v.path WHERE o.path IS NULL OR v.path IS NULL OR o.k IS DISTINCT FROM v.k""")
def first_parent_diff(spark, d):
    """Three days as commits, each with the one before as its parent."""
    days = ("2023-06-01", "2023-09-01", "2024-09-01")
    f = table(spark, d, "n_java_file").withColumn("commit_hash", F.explode(F.array(*map(F.lit, days))))
    at = F.col("commit_hash").cast("timestamp_ntz")
    v = f.where((F.col("indexed_at") <= at) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > at))).groupBy("commit_hash", "path").agg(F.min("checksum").alias("checksum"))
    return diff.first_parent_diff(v, spark.createDataFrame(list(zip(days[1:], days)), "commit_hash string, parent_hash string"))


# Events


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type <> 'error' AND NOT EXISTS (
    SELECT 1 FROM (SELECT DISTINCT user_id, props FROM events WHERE event_type = 'error') e WHERE e.user_id = events.user_id AND e.props = events.props) GROUP BY user_id, event_type""")
def event_dedupe_batch(spark, d):
    """First event per user and type, without those whose (user, payload) a table of processed ones has."""
    e = table(spark, d, "events")
    done = e.where("event_type = 'error'").select("user_id", "props").distinct()
    return e.where("event_type <> 'error'").join(done, ["user_id", "props"], "left_anti").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


# Payloads, details and statistics


@query("""SELECT DISTINCT d.doc_id, r.branch, r.id AS pusher, d.commit_hash AS tip, 'author of ' || d.commit_hash AS author FROM documents d JOIN repositories r ON r.id = d.repo_id WHERE d.commit_hash IS NOT NULL""")
def push_payload_fields(spark, d):
    """Push payloads written as JSON and read back: branch, pusher, tip and its author."""
    j = table(spark, d, "documents").where("commit_hash is not null").join(table(spark, d, "repositories").select(F.col("id").alias("repo_id"), "branch"), "repo_id")
    commit = lambda c: F.struct(c.alias("id"), F.lit("m").alias("message"), F.struct(F.concat(F.lit("author of "), c).alias("name")).alias("author"))
    payload = F.to_json(F.struct(
        F.concat(F.lit("refs/heads/"), "branch").alias("ref"), F.struct(F.col("repo_id").alias("name")).alias("pusher"), F.upper("commit_hash").alias("after"),
        commit(F.lit("0")).alias("head_commit"), F.array(commit(F.lit("1")), commit(F.col("commit_hash"))).alias("commits"),
    ))
    p = j.select("doc_id", payload.alias("p"))
    return p.select("doc_id", text.branch_of(F.get_json_object("p", "$.ref")).alias("branch"), jsonio.pusher(F.col("p")).alias("pusher"), F.lower(F.get_json_object("p", "$.after")).alias("tip"), jsonio.tip_author(F.col("p")).alias("author")).distinct()


@query(f"""WITH {_JSON} SELECT doc_id, count(*)::BIGINT AS raw, sum(CASE WHEN c >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS confident,
    count(DISTINCT CASE WHEN c >= 0.5 THEN (upper(kind), qualified_name) END)::BIGINT AS distinct_nodes FROM j GROUP BY doc_id""")
def risk_list_stats(spark, d):
    rows = _json_lines(spark, d).withColumn("ok", jsonio.confident(F.col("confidence")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("raw"), F.count_if("ok").alias("confident"), F.countDistinct(F.when(F.col("ok"), F.struct(F.upper("kind").alias("k"), "qualified_name"))).alias("distinct_nodes"))


@query(f"""WITH {_JSON} SELECT doc_id, to_json(list({{'kind': kind, 'qualifiedName': qualified_name, 'filePath': ''}} ORDER BY pos)) AS nodes FROM j WHERE c >= 0.5 GROUP BY doc_id""".replace("to_json(list(", "CAST(to_json(list(").replace("ORDER BY pos)) AS nodes", "ORDER BY pos)) AS VARCHAR) AS nodes"))
def propagation_request_body(spark, d):
    """The node list of a propagation request as a JSON text, per document."""
    rows = _json_lines(spark, d).where(jsonio.confident(F.col("confidence")))
    node = F.struct("pos", F.struct("kind", F.col("qualified_name").alias("qualifiedName"), F.col("file_path").alias("filePath")).alias("n"))
    return rows.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["n"])).alias("nodes"))


@query("SELECT id, arg_min(signature, (indexed_at, signature)) AS signature FROM n_method WHERE id IS NOT NULL AND signature IS NOT NULL AND indexed_at IS NOT NULL GROUP BY id")
def first_wins_details(spark, d):
    m = table(spark, d, "n_method").where("id is not null and signature is not null and indexed_at is not null")
    return m.groupBy("id").agg(F.min_by("signature", F.struct("indexed_at", "signature")).alias("signature"))


@query(f"""{_vec_sql("", 0.2)}, n AS (SELECT DISTINCT src AS id FROM edges WHERE rel_type = 'CALLS' AND trim(src) <> '')
    SELECT query_id, id, place::INTEGER AS place, id IN (SELECT id FROM n) AS in_graph FROM h""")
def semantic_hits_in_graph(spark, d):
    callers = _edges(spark, d, "CALLS").select(F.col("src").alias("id"), F.lit(True).alias("in_graph")).distinct()
    hits = _search(spark, d, "true", 0.2).join(callers, "id", "left")
    return hits.select("query_id", "id", F.col("place").cast("int").alias("place"), F.coalesce("in_graph", F.lit(False)).alias("in_graph"))


@query("""WITH x AS (SELECT DISTINCT file_path, 0 AS k, line_start AS pos, qualified_name AS node FROM n_type WHERE file_path IS NOT NULL UNION SELECT DISTINCT file_path, 1, line_start, id FROM n_method WHERE file_path IS NOT NULL AND id IS NOT NULL)
    SELECT node, file_path, CASE k WHEN 0 THEN 'TYPE' ELSE 'METHOD' END AS kind FROM x WHERE pos IS NOT NULL ORDER BY file_path, k, pos, node LIMIT 120""")
def diff_node_budget(spark, d):
    """The nodes that get a diff snippet: the first 120 by file, kind and position."""
    t = table(spark, d, "n_type").select("file_path", F.lit("TYPE").alias("kind"), F.col("line_start"), F.col("qualified_name").alias("node"))
    m = table(spark, d, "n_method").where("id is not null").select("file_path", F.lit("METHOD").alias("kind"), "line_start", F.col("id").alias("node"))
    rows = t.unionByName(m).where("file_path is not null and line_start is not null").distinct()
    return diff.diff_budget(rows.withColumn("file_pos", F.col("file_path")).withColumn("pos", F.struct("line_start", "node"))).select("node", "file_path", "kind")


@query(f"""WITH RECURSIVE {_e('c', 'CALLS')}, {_s('CALLS')}, {_hops(2, True, 'c', 'u0')}, {_hops(2, False, 'c', 'w0')},
    u AS (SELECT seed, node, min(hop) AS hop FROM u0 GROUP BY seed, node), w AS (SELECT seed, node, min(hop) AS hop FROM w0 GROUP BY seed, node),
    x AS (SELECT c.src, c.dst, u.seed, u.hop AS us, NULL::BIGINT AS ud, NULL::BIGINT AS ds, NULL::BIGINT AS dd FROM c JOIN u ON u.node = c.src UNION ALL SELECT c.src, c.dst, u.seed, NULL, u.hop, NULL, NULL FROM c JOIN u ON u.node = c.dst
      UNION ALL SELECT c.src, c.dst, w.seed, NULL, NULL, w.hop, NULL FROM c JOIN w ON w.node = c.src UNION ALL SELECT c.src, c.dst, w.seed, NULL, NULL, NULL, w.hop FROM c JOIN w ON w.node = c.dst),
    p AS (SELECT src, dst, seed, min(us) AS us, min(ud) AS ud, min(ds) AS ds, min(dd) AS dd, least(min(us), min(ud), min(ds), min(dd)) AS score FROM x GROUP BY src, dst, seed)
    SELECT src, dst, seed AS reference_seed, (CASE WHEN dd IS NOT NULL AND (ds IS NOT NULL OR src = seed) THEN dd ELSE us END)::INTEGER AS hop_from_seed,
      CASE WHEN dd IS NOT NULL AND (ds IS NOT NULL OR src = seed) THEN 'downstream' ELSE 'upstream' END AS direction FROM p QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY score, seed) = 1""")
def edge_reference_seed(spark, d):
    s, c = _seeds(spark, d, "CALLS"), _edges(spark, d, "CALLS")
    return graph.edge_attribution(c, graph.hops(s, c, 2, up=True), graph.hops(s, c, 2))


@query()
def unified_diffs(spark, d):
    """The unified diff of every file with line comments and itself without: digest and length."""
    return diff.unified(_uncommented(spark, d)).select("path", F.md5("diff").alias("digest"), F.length("diff").alias("n_chars"))


@query()
def evidence_documents(spark, d):
    """One evidence document per module of a repository: files that lose their line comments, lines, and the methods concerned with their part of the diff."""
    pairs = cut(_uncommented(spark, d))
    by = F.struct("repo", "module")
    files_ = diff.line_stats(pairs).select(by.alias("key"), "path", F.lit("MODIFIED").alias("change_type"), "insertions", "deletions")
    m = table(spark, d, "n_method").where("id is not null and line_start is not null and line_end is not null").select(F.col("file_path").alias("path"), F.lit("METHOD").alias("kind"), F.col("id").alias("qualified_name"), "line_start", "line_end").distinct()
    diffs = diff.unified(pairs).select(by.alias("key"), "path", "diff")
    nodes = diff.node_snippets(m.join(diffs.select("key", "path"), "path"), diffs.select("path", "diff"))
    meta = F.struct(F.col("key.repo").alias("repoId"), F.col("key.module").alias("module"))
    return diff.evidence(meta, files_, nodes, "key").select("key.repo", "key.module", F.md5("document").alias("digest"), F.length("document").alias("n_chars"))


# Composites and operators that SQL cannot express


@query()
def risk_chains_budget(spark, d):
    """Accepted chains of the methods whose edges have an id divisible by 50: a request and a budget for each type that owns some."""
    from pyspark.sql import Window

    seeds = _seeds(spark, d, "CALLS").withColumn("request", F.substring_index("seed", "#", 1))
    request = seeds.select("request", F.row_number().over(Window.partitionBy("request").orderBy("seed")).alias("seed_pos"), F.lit("METHOD").alias("kind"), "seed")
    known = table(spark, d, "n_method").select(F.lit("Method").alias("label"), F.col("id").alias("key"))
    got, _ = risk.propagate(request, table(spark, d, "edges"), known, 3)
    return got.select("request", "seed", "category", "hop", F.array_join("nodes", " > ").alias("nodes"))


def _parsed(spark, d) -> DataFrame:
    f = _newest(spark, d).where(F.col("path").endswith(".java")).withColumn("repo_id", F.regexp_extract("path", "^/data/checkouts/([^/]+)/", 1))
    return ingest.parse(f)


@query()
def parse_java(spark, d):
    """Declarations and relations of all Java files, one row each."""
    return _parsed(spark, d).where("row_kind <> 'call'").select("path", "row_kind", "key", "owner", "rel_type", F.array_join("targets", ",").alias("targets"), "line_start", "line_end").distinct()


_BOTH = "SELECT path FROM source_files WHERE content IS NOT NULL AND path LIKE '%.java'"


@query(f"SELECT DISTINCT id, file_path FROM n_method WHERE id IS NOT NULL AND file_path IN ({_BOTH})")
def parsed_methods(spark, d):
    """Methods read from the files that the method table knows."""
    known = table(spark, d, "n_method").where("id is not null").select(F.col("file_path").alias("path")).distinct()
    return _parsed(spark, d).where("row_kind = 'method'").join(known, "path", "left_semi").select(F.col("key").alias("id"), F.col("path").alias("file_path")).distinct()


@query(f"SELECT count(DISTINCT path)::BIGINT AS n_files, 0::BIGINT AS n_failed FROM ({_BOTH})")
def parse_counters(spark, d):
    return ingest.counters(_parsed(spark, d)).select("n_files", "n_failed")


@query()
def parsed_calls(spark, d):
    """Resolved calls of all Java files."""
    return ingest.edges(cut(_parsed(spark, d))).where("rel_type = 'CALLS'")


_T1, _T2 = "2023-09-01", "2024-09-01"


@query(f"""WITH RECURSIVE lives(label, k, file, a, b) AS (SELECT 'JavaFile', path, path, indexed_at, deleted_at FROM n_java_file UNION ALL SELECT 'Type', qualified_name, file_path, indexed_at, deleted_at FROM n_type UNION ALL SELECT 'Method', id, file_path, indexed_at, deleted_at FROM n_method),
    o AS (SELECT DISTINCT label, k FROM lives WHERE k IS NOT NULL AND a <= '{_T1}'::TIMESTAMP AND (b IS NULL OR b > '{_T1}'::TIMESTAMP)),
    n AS (SELECT label, k, min(file) AS file FROM lives WHERE k IS NOT NULL AND a <= '{_T2}'::TIMESTAMP AND (b IS NULL OR b > '{_T2}'::TIMESTAMP) GROUP BY label, k),
    gone AS (SELECT k FROM o WHERE label = 'JavaFile' AND k NOT IN (SELECT k FROM n WHERE label = 'JavaFile')),
    fresh AS (SELECT k FROM n WHERE label = 'JavaFile' AND k NOT IN (SELECT k FROM o WHERE label = 'JavaFile')),
    e AS (SELECT DISTINCT src, rel_type, dst FROM edges WHERE written_at <= '{_T1}'::TIMESTAMP AND trim(src) <> '' AND trim(dst) <> ''),
    t AS (SELECT DISTINCT dst AS k FROM e WHERE rel_type = 'DEFINES_TYPE' AND src IN (SELECT k FROM gone)),
    g AS (SELECT k FROM gone UNION SELECT k FROM t UNION SELECT dst FROM e WHERE rel_type = 'HAS_METHOD' AND src IN (SELECT k FROM t)),
    w AS (SELECT label, k FROM n WHERE file IN (SELECT k FROM fresh))
    SELECT label, k AS key, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.label = x.label AND w.k = x.k) THEN 'new' ELSE 'old' END AS origin
    FROM (SELECT label, k FROM o WHERE k NOT IN (SELECT k FROM g) UNION SELECT label, k FROM w) x""")
def incremental_nodes(spark, d):
    """The node tables of one day taken to a later one: files that are gone cascade, files that are new are written, all else stays."""
    keys = {"JavaFile": ("n_java_file", "path", "path"), "Type": ("n_type", "qualified_name", "file_path"), "Method": ("n_method", "id", "file_path")}
    day = lambda t: f"indexed_at <= timestamp_ntz'{t}' and (deleted_at is null or deleted_at > timestamp_ntz'{t}')"

    def at(t: str, origin: str) -> dict[str, DataFrame]:
        one = lambda name, key, file: table(spark, d, name).where(f"{key} is not null and {day(t)}").groupBy(F.col(key)).agg(F.min(file).alias("_f")).withColumn("origin", F.lit(origin))
        return {label: one(*x) for label, x in keys.items()}

    old, new = at(_T1, "old"), at(_T2, "new")
    files_ = lambda x: x["JavaFile"].select("path", F.lit("").alias("checksum"))
    changes = cut(diff.snapshot_diff(files_(old), files_(new), ""))
    added = changes.where("change_type = 'ADDED'").select(F.col("path").alias("_f"))
    fresh = {label: df.join(added, "_f", "left_semi").select(*old[label].columns) for label, df in new.items()}
    e = table(spark, d, "edges").where(f"written_at <= timestamp_ntz'{_T1}'")
    g = index.maintain(index.Graph(old, e), changes, fresh, e.limit(0))
    out = [df.select(F.lit(label).alias("label"), F.col(keys[label][1]).alias("key"), "origin") for label, df in g.nodes.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH u AS (SELECT id, max({'at': update_time, 's': CASE WHEN error_msg IS NULL THEN 2 ELSE 3 END, 'e': error_msg}) AS x FROM index_tasks WHERE update_time IS NOT NULL GROUP BY id)
    SELECT DISTINCT t.id, coalesce(u.x.s, t.status)::SMALLINT AS status, coalesce(u.x.at, t.finish_time) AS finish_time FROM index_tasks t LEFT JOIN u ON u.id = t.id""")
def task_status_update(spark, d):
    """Every task ended at its last update, failed if it has an error."""
    t = table(spark, d, "index_tasks")
    u = t.where("update_time is not null").select("id", F.when(F.col("error_msg").isNull(), "SUCCESS").otherwise("FAIL").alias("state"), F.col("update_time").alias("at"), "error_msg")
    return index.task_update(t, u).select("id", "status", "finish_time").distinct()


@query("SELECT * FROM repositories WHERE id = (SELECT min(id) FROM repositories)")
def repository_by_id(spark, d):
    r = table(spark, d, "repositories")
    return index.by_id(r, r.agg(F.min("id")).first()[0])


@query("""WITH c AS (SELECT DISTINCT e.src, e.dst, e.rel_type, t.trigger_commit AS c FROM edges e JOIN index_tasks t ON t.id = e.task_id WHERE t.trigger_commit IS NOT NULL AND trim(e.src) <> '' AND trim(e.dst) <> ''),
    hm AS (SELECT DISTINCT src AS t, dst AS m FROM edges WHERE rel_type = 'HAS_METHOD' AND trim(src) <> '' AND trim(dst) <> ''),
    ci AS (SELECT DISTINCT dst AS node, c FROM c WHERE rel_type = 'INNER_CLASS_OF'),
    df AS (SELECT DISTINCT c.c, hm.m FROM c JOIN edges d ON d.rel_type = 'DEFINES_TYPE' AND d.src = c.dst JOIN hm ON hm.t = d.dst WHERE c.rel_type = 'CONTAINS_FILE'),
    l AS (SELECT DISTINCT ci.c, hm.m FROM ci JOIN hm ON hm.t = ci.node)
    SELECT c AS commit, m AS seed, 'graph' AS source FROM l UNION ALL SELECT c, m, 'diff' FROM df WHERE c NOT IN (SELECT c FROM l)""")
def commit_seed_fallback(spark, d):
    """Seeds of commits: of the outer types that their task linked, else of the files that it placed in packages."""
    e = table(spark, d, "edges").where(filled("src") & filled("dst"))
    c = e.join(table(spark, d, "index_tasks").where("trigger_commit is not null").select(F.col("id").alias("task_id"), F.col("trigger_commit").alias("commit")).distinct(), "task_id")
    hm = _edges(spark, d, "HAS_METHOD").select(F.col("src").alias("type"), F.col("dst").alias("method"))
    changed = c.where("rel_type = 'INNER_CLASS_OF'").select(F.col("dst").alias("node"), "commit").distinct()
    types = _edges(spark, d, "DEFINES_TYPE").select(F.col("src").alias("file"), F.col("dst").alias("type"))
    placed = c.where("rel_type = 'CONTAINS_FILE'").select("commit", F.col("dst").alias("file")).distinct().join(types, "file").join(hm, "type").select("commit", "method").distinct()
    return context.commit_seeds(changed, hm, placed, placed.limit(0).select("commit", F.col("method").alias("seed")))


_CAPPED = f"""{_e('c', 'CALLS')}, {_e('hm', 'HAS_METHOD')}, {_e('df', 'DEFINES_TYPE')}, {_e('cf', 'CONTAINS_FILE')}, {_e('im', 'IMPORTS')}, {_e('dp', 'DEPENDS_ON')}, {_s('CALLS')},
    o AS (SELECT DISTINCT src AS k FROM hm WHERE dst IN (SELECT seed FROM s)),
    st AS (SELECT hm.dst AS m, hm.src AS t, df.src AS f, cf.src AS p FROM hm JOIN s ON s.seed = hm.dst JOIN df ON df.dst = hm.src LEFT JOIN cf ON cf.dst = df.src ORDER BY m, t, f, p NULLS LAST LIMIT 500),
    x AS (SELECT 0 AS g, src, rel_type, dst FROM c WHERE src IN (SELECT seed FROM s) AND dst IN (SELECT seed FROM s) UNION ALL SELECT 2, src, rel_type, dst FROM dp WHERE src IN (SELECT k FROM o) OR dst IN (SELECT k FROM o)
      UNION ALL SELECT * FROM (SELECT 3, src, rel_type, dst FROM im WHERE src IN (SELECT src FROM df WHERE dst IN (SELECT k FROM o)) ORDER BY src, dst LIMIT 200)
      UNION ALL SELECT DISTINCT 4, f, 'DEFINES_TYPE', t FROM st UNION ALL SELECT DISTINCT 4, t, 'HAS_METHOD', m FROM st UNION ALL SELECT DISTINCT 4, p, 'CONTAINS_FILE', f FROM st WHERE p IS NOT NULL)"""


@query(f"WITH {_CAPPED} SELECT src, rel_type, dst FROM x ORDER BY g, src, rel_type, dst LIMIT 300")
def capped_group_edges(spark, d):
    """Edges of all groups around the seed methods under one cap."""
    methods, e = _seeds(spark, d, "CALLS").withColumnRenamed("seed", "node"), table(spark, d, "edges")
    owners = _edges(spark, d, "HAS_METHOD").join(methods.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return graph.capped_edges(graph.group_edges(methods, owners, e, graph.EDGE_ORDER), 300).select("src", "rel_type", "dst")


@query(f"WITH RECURSIVE {_e('c', 'EXTENDS', 'IMPLEMENTS')}, {_s('EXTENDS')}, {_trail_sql('c', 6, False)} SELECT seed, hop, nodes, types FROM q WHERE n <= 80")
def hierarchy_chains_down(spark, d):
    return _flat(trails.trails(_seeds(spark, d, "EXTENDS"), _edges(spark, d, "EXTENDS", "IMPLEMENTS"), 6))


@query(f"WITH RECURSIVE {_e('c', 'DEPENDS_ON')}, {_s('DEPENDS_ON', 'dst')}, {_trail_sql('c', 3, True)} SELECT seed, hop, nodes, types FROM q WHERE n <= 80")
def depends_chains_in(spark, d):
    return _flat(trails.trails(_seeds(spark, d, "DEPENDS_ON", "dst"), _edges(spark, d, "DEPENDS_ON"), 3, up=True))


@query()
def analysis_context(spark, d):
    """Summary of the composite context of one changed type and two questions."""
    f = table(spark, d, "n_java_file")
    first = table(spark, d, "edges").where("rel_type = 'DEFINES_TYPE'").where(filled("src") & filled("dst")).agg(F.min(F.struct("src", "dst")).alias("x")).first()["x"]
    repo = f.where(F.col("path") == first["src"]).agg(F.min("repo_id")).first()[0] or "none"
    r = context.Request(repo, type_names=(first["dst"],), file_paths=(first["src"],), queries=("merge the batch", "flush the cursor"), min_score=-1.0)
    v = table(spark, d, "code_node_embedding").select(F.col("node_id").alias("id"), "node_type", "repo_id", "embedding")
    return context.assemble(r, table(spark, d, "edges"), f, v)["counts"]


@query()
def stream_commits(spark, d):
    """Commits of all tasks fed through the idempotent stream, counted per repository."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    import uuid

    state = f"{base or tempfile.gettempdir()}/codeweft-stream-{uuid.uuid4().hex}"
    t = table(spark, d, "index_tasks")
    path = f"{d}/index_tasks.parquet"
    folder, pick = (path, "*.parquet") if "://" not in path and os.path.isdir(path) else (d, "index_tasks.parquet")
    s = spark.readStream.schema(t.schema).option("pathGlobFilter", pick).option("maxFilesPerTrigger", 4).parquet(folder)
    s = s.where("repo_id is not null and trigger_commit is not null").select("repo_id", F.col("trigger_commit").alias("commit_hash"))
    commits.run(s, state, lambda batch, n: batch.write.mode("overwrite").parquet(f"{state}/out/batch={n}"))
    return spark.read.parquet(f"{state}/out").groupBy("repo_id").agg(F.countDistinct("commit_hash").alias("n_commits"))
