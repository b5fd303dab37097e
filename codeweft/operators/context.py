"""The composite analysis context: seeds, graph, semantic hits and summary in one answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft import errors
from codeweft.operators import graph, vector
from codeweft.operators.trails import sample_paths
from codeweft.schema import clamp
from codeweft.session import cut


@dataclass(frozen=True)
class Request:
    """What to assemble; limits are clamped to their ranges."""

    repo_id: str
    method_ids: tuple[str, ...] = ()
    type_names: tuple[str, ...] = ()
    file_paths: tuple[str, ...] = ()
    queries: tuple[str, ...] = ()
    max_hops: int | None = None
    max_nodes: int | None = None
    max_edges: int | None = None
    max_paths: int | None = None
    top_k: int | None = None
    min_score: float = 0.2
    hits_as_seeds: bool = True
    include: frozenset[str] | None = None
    groups: tuple[str, ...] | None = None

    def wants(self, block: str) -> bool:
        """Whether a block (graph, semantic, summary) is asked for: all are unless some are named."""
        return self.include is None or block in self.include

    def check(self) -> None:
        if not self.repo_id or not self.repo_id.strip():
            raise errors.EngineError(errors.REPO_ID_EMPTY, "no repository")
        if not any(x and x.strip() for x in (*self.method_ids, *self.type_names, *self.file_paths, *self.queries)):
            raise errors.EngineError(errors.CONTEXT_INPUT_EMPTY, "nothing to look for")


def seed_union(*sources: tuple[str, DataFrame]) -> DataFrame:
    """(seed, provenance): distinct filled seeds, the first source that names one wins."""
    rows = None
    for i, (name, df) in enumerate(sources):
        part = df.where(F.col("seed").rlike(r"\S")).select("seed", F.struct(F.lit(i).alias("i"), F.lit(name).alias("n")).alias("p"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("seed").agg(F.min("p").alias("p")).select("seed", F.col("p.n").alias("provenance"))


def explicit_seeds(r: Request, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(seed): methods named, methods of named types, methods of types in named files (by path or relative path)."""
    spark = edges.sparkSession
    one = lambda xs: spark.createDataFrame([(x,) for x in xs if x and x.strip()], "x string")
    has = graph.edge_view(edges, "HAS_METHOD").select(F.col("src").alias("t"), F.col("dst").alias("seed"))
    types = one(r.type_names).select(F.col("x").alias("t"))
    paths = one(r.file_paths)
    f = files.select("path", "relative_path").distinct()
    named = f.join(paths, f["path"] == paths["x"], "left_semi").unionByName(f.join(paths, f["relative_path"] == paths["x"], "left_semi")).select("path").distinct()
    of_files = graph.edge_view(edges, "DEFINES_TYPE").join(named, F.col("src") == F.col("path"), "left_semi").select(F.col("dst").alias("t"))
    return one(r.method_ids).select(F.col("x").alias("seed")).unionByName(has.join(types.unionByName(of_files).distinct(), "t", "left_semi").select("seed")).distinct()


def assemble(r: Request, edges: DataFrame, files: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """The blocks of the answer: seeds, the graph's blocks and paths, hits, histogram and counts.

    ``vectors``: (id, node_type, repo_id, embedding). A request without seeds
    is not expanded: its graph blocks are empty. Blocks that were not asked
    for are missing; hits are still looked up where they serve as seeds.
    """
    r.check()
    spark = edges.sparkSession
    queries = [q for q in r.queries if q and q.strip()][:8]
    q = spark.createDataFrame([(i, vector.hashed(t)) for i, t in enumerate(queries)], "query_id int, q array<double>")
    scoped = vectors.where(F.col("repo_id") == r.repo_id)
    hits = cut(vector.search(q, scoped, clamp(r.top_k, 10, 1, 100), r.min_score))
    named = explicit_seeds(r, edges, files)
    from_hits = vector.hits_to_seeds(hits, vectors, graph.edge_view(edges, "HAS_METHOD")) if r.hits_as_seeds else named.limit(0)
    seeds = cut(seed_union(("request", named), ("semantic", from_hits)))
    h = clamp(r.max_hops, 3, 1, graph.CONTEXT_HOPS)
    out: dict[str, DataFrame] = {"seeds": seeds}
    g = None
    if r.wants("graph"):
        g = graph.expand(seeds.select("seed"), edges, h, h, clamp(r.max_nodes, 500, 1, 2000), clamp(r.max_edges, 2000, 1, 8000), r.groups)
        out |= g | {"paths": sample_paths(seeds.select("seed"), graph.edge_view(edges, "CALLS"), h, clamp(r.max_paths, 50, 1, 200))}
    if r.wants("semantic"):
        out["hits"] = noted(hits, None if g is None else g["nodes"].select("node").unionByName(g["side_nodes"]), False if g is None else not g["warnings"].isEmpty())
    if r.wants("summary"):
        count = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        counts = count("seeds", seeds).unionByName(count("hits", hits))
        if g is not None:
            rel = g["edges"].unionByName(g["inheritance"])
            out["histogram"] = rel.groupBy("rel_type").agg(F.count("*").alias("n"))
            counts = counts.unionByName(count("nodes", g["nodes"])).unionByName(count("edges", rel)).unionByName(count("paths", out["paths"]))
        out["counts"] = counts
    return out


def noted(hits: DataFrame, nodes: DataFrame | None, truncated: bool) -> DataFrame:
    """``hits`` (id, ...) plus ``in_graph`` and, where it is false, why: no graph was asked for, it was cut, or the node is not in it."""
    if nodes is None:
        return hits.withColumn("in_graph", F.lit(False)).withColumn("note", F.lit("the request has no graph"))
    scope = nodes.select(F.col("node").alias("id"), F.lit(True).alias("in_graph")).distinct()
    why = "the graph is cut, or the node is outside of it" if truncated else "the node is outside of the graph: no seed leads to it, or it is not stored"
    j = hits.join(scope, "id", "left").withColumn("in_graph", F.coalesce("in_graph", F.lit(False)))
    return j.withColumn("note", F.when(~F.col("in_graph"), why))


def commit_seeds(changed_in: DataFrame, has_method: DataFrame, diff_methods: DataFrame, named: DataFrame) -> DataFrame:
    """(commit, seed, source) of commits: what the graph links to them, else the methods of the files they changed.

    ``changed_in``: (node, commit), methods or types; ``has_method``: (type,
    method); ``diff_methods``: (commit, method) of changed files that were not
    deleted; ``named``: (commit, seed) that a request names anyhow. The diff
    serves only commits to which the graph adds no seed that is not named.
    """
    own = changed_in.select("commit", F.col("node").alias("seed"))
    types = has_method.select(F.col("type").alias("node"), F.col("method").alias("seed")).distinct()
    linked = own.join(has_method.select(F.col("method").alias("seed")).distinct(), "seed", "left_semi").select("commit", "seed")
    linked = linked.unionByName(changed_in.join(types, "node").select("commit", "seed")).where(F.col("seed").rlike(r"\S")).distinct()
    fresh = linked.join(named.select("commit", "seed").distinct(), ["commit", "seed"], "left_anti").select("commit").distinct()
    other = diff_methods.select("commit", F.col("method").alias("seed")).join(fresh, "commit", "left_anti").where(F.col("seed").rlike(r"\S")).distinct()
    return linked.withColumn("source", F.lit("graph")).unionByName(other.join(linked, ["commit", "seed"], "left_anti").withColumn("source", F.lit("diff")))
