"""The stored graph and how a snapshot or a change set is written into it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators import store, vector
from codeweft.schema import NODE_KEYS
from codeweft.session import cut, filled
from codeweft.sources import ingest


@dataclass(frozen=True)
class Graph:
    """Node tables by label, each keyed as in NODE_KEYS, edges (src, rel_type, dst, line_no) and, if kept, vectors (id, ...)."""

    nodes: dict[str, DataFrame]
    edges: DataFrame
    vectors: DataFrame | None = None


def node_keys(nodes: dict[str, DataFrame]) -> DataFrame:
    """(key) of all nodes."""
    out = None
    for label, df in nodes.items():
        one = df.select(F.col(NODE_KEYS[label]).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out.where(filled("key")).distinct()


def drop_files(g: Graph, paths: DataFrame) -> Graph:
    """``g`` without the files ``paths`` (path), their types, the methods and fields of those, all edges at them and their vectors."""
    gone = cut(store.file_members(g.edges, paths))
    keep = lambda df, key: df.join(gone.select(F.col("key").alias(key)), key, "left_anti")
    nodes = {label: keep(df, NODE_KEYS[label]) if label in ("JavaFile", "Type", "Method", "Field") else df for label, df in g.nodes.items()}
    return Graph(nodes, keep(keep(g.edges, "src"), "dst"), None if g.vectors is None else keep(g.vectors, "id"))


def written(g: Graph, fresh: dict[str, DataFrame], edges: DataFrame) -> Graph:
    """``g`` with node tables and edges of a parse written over it: parents and children alike, last one per key.

    Columns that a stored table has and the parse lacks become null in the new
    rows. Edges are kept only between nodes that are there once all of them
    are written, one per (src, rel_type, dst), the parsed line winning.
    """
    nodes = dict(g.nodes)
    for label, new in fresh.items():
        key = NODE_KEYS[label]
        old = nodes.get(label)
        if old is None:
            nodes[label] = new
            continue
        shaped = new.select(*((F.col(c) if c in new.columns else F.lit(None)).cast(t).alias(c) for c, t in old.dtypes))
        nodes[label] = shaped.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))
    both = g.edges.select("src", "rel_type", "dst", "line_no", F.lit(0).alias("edge_id")).unionByName(edges.select("src", "rel_type", "dst", "line_no", F.lit(1).alias("edge_id")))
    kept = store.known_ends(both, node_keys(nodes))
    return replace(g, nodes=nodes, edges=store.merged_edges(both).join(kept, ["src", "rel_type", "dst"], "left_semi"))


def with_vectors(g: Graph, changed: DataFrame) -> Graph:
    """``g`` with the vectors of the types and methods of the files ``changed`` (path) computed anew; nothing without a text gets one."""
    texts = vector.embedding_texts(g.nodes["Type"].join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi"), g.nodes["Method"].join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi"))
    new = vector.embed(texts).where("embedding is not null").select(F.col("node_id").alias("id"), "node_type", "embedding")
    old = g.vectors
    return replace(g, vectors=new if old is None else new.unionByName(old.select("id", "node_type", "embedding").join(new.select("id"), "id", "left_anti")))


def maintain(g: Graph, changes: DataFrame, fresh: dict[str, DataFrame], edges: DataFrame) -> Graph:
    """``g`` after ``changes`` (path, change_type) whose added and modified files were parsed into ``fresh`` and ``edges``.

    DELETED files go with all they define; of MODIFIED ones the out-edges of
    the file, its types and methods go before the parse is written. Files that
    could not be parsed are in neither, so what is stored of them stays.
    """
    of = lambda kind: changes.where(F.col("change_type") == kind).select("path").distinct()
    g = drop_files(g, of("DELETED"))
    g = replace(g, edges=store.delete_outgoing(g.edges, of("MODIFIED")))
    return written(g, fresh, edges)


def index_changes(g: Graph, changes: DataFrame, files: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, parse errors) after ``changes``, parsing the added and modified among ``files`` (path, repo_id, content)."""
    todo = files.join(changes.where("change_type <> 'DELETED'").select("path").distinct(), "path", "left_semi")
    rows = cut(ingest.parse(todo))
    bad = ingest.failures(rows)
    good = rows.join(bad.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    fine = todo.join(bad.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    known = g.nodes["Method"]
    overloads = known.select(
        F.col("owner_qualified_name").alias("owner"), F.col("simple_name").alias("name"), F.filter(F.split(F.regexp_extract("id", r"\((.*)\)$", 1), ","), lambda x: x != "").alias("types"), F.col("id").alias("dst")
    ).withColumn("arity", F.size("types"))
    edges = ingest.edges(good, g.nodes["Type"].select(F.col("qualified_name").alias("key")), overloads)
    failed = changes.join(bad.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    out = maintain(g, failed, ingest.node_tables(good, fine), edges)
    if g.vectors is not None:
        out = with_vectors(out, failed.where("change_type <> 'DELETED'"))
    return out, bad


def index_snapshot(g: Graph, files: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, parse errors) after a whole snapshot: files of unchanged checksum are skipped, those that are gone are dropped."""
    now = files.where("path is not null").select("path", F.coalesce("checksum" if "checksum" in files.columns else F.md5("content"), F.lit("")).alias("checksum"))
    old = g.nodes["JavaFile"].select("path", F.coalesce("checksum", F.lit("")).alias("was"))
    j = now.join(old, "path", "full_outer")
    kind = F.when(F.col("checksum").isNull(), "DELETED").when(F.col("was").isNull(), "ADDED").when(F.col("was") != F.col("checksum"), "MODIFIED")
    return index_changes(g, cut(j.select("path", kind.alias("change_type")).where("change_type is not null")), files)


def run_each(repos: Iterable[tuple[str, str]], one: Callable[[str, str], DataFrame | None]) -> list[tuple[str, str, str]]:
    """(repo id, status, message) of ``one`` called for every active repository (id, root) in turn; a failure ends its own repository only."""
    out = []
    for repo, root in repos:
        try:
            one(repo, root)
            out.append((repo, "SUCCESS", ""))
        except Exception as e:
            out.append((repo, "FAIL", f"{type(e).__name__}: {e}"[:500]))
    return out


#: Task states by the number that is stored.
STATES = ("PENDING", "RUNNING", "SUCCESS", "FAIL")


def task_update(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """``tasks`` (id, status, finish_time, error_msg, ...) after ``updates`` (id, state, at, error_msg): the last by time, then state, wins.

    An end state sets the finish time, others clear nothing. Updates of tasks
    that are not there, or with an unknown state, change nothing.
    """
    code = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")) - 1
    u = updates.where(F.col("state").isin(*STATES)).select("id", code.cast("smallint").alias("_s"), "at", F.col("error_msg").alias("_e"))
    u = u.groupBy("id").agg(F.max_by(F.struct("_s", "at", "_e"), F.struct("at", "_s")).alias("u"))
    j = tasks.join(u, "id", "left")
    done = F.col("u._s") >= 2
    new = {"status": F.coalesce("u._s", "status"), "finish_time": F.when(done, F.col("u.at")).otherwise(F.col("finish_time")), "error_msg": F.coalesce("u._e", "error_msg")}
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in tasks.columns))


def append_new(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` plus the ``rows`` whose ``key`` it lacks, one per key: commit records and parse errors."""
    return stored.unionByName(rows.dropDuplicates(key).join(stored.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def by_id(rows: DataFrame, value: str, key: str = "id") -> DataFrame:
    """The rows of one id; the predicate reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))
