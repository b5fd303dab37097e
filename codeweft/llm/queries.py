"""Named queries of the training-data problems and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import function_docs, handwritten, mixing, neighbors, packing, pii, tokens
from codeweft.session import cut, table

#: Key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = "example-key"


# Functions with documentation


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return function_docs.pairs(table(spark, d, "source_files")).select("path", "method_id").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Signature, documentation and code of every documented method."""
    return function_docs.pairs(table(spark, d, "source_files"))


def p1_symbols(spark: SparkSession, d: str) -> DataFrame:
    return function_docs.symbol_table(table(spark, d, "source_files"))


# Files that nobody wrote by hand


def _library_roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lib_symbols").where("node_label = 'Type'").select(F.substring_index("node_id", ".", 2).alias("root")).distinct()


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "source_files"), _library_roots(spark, d), table(spark, d, "index_tasks").select("repo_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("path").distinct()


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d)


def p4_layout(spark: SparkSession, d: str) -> DataFrame:
    """Layout per language of the files with text: how many, longest line, characters."""
    f = handwritten.read(table(spark, d, "source_files"))
    return f.groupBy("lang").agg(F.count("*").alias("n_files"), F.max("max_line").cast("bigint").alias("max_line"), F.sum("n_chars").alias("n_chars"))


# Nearest vectors


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_node_embedding").select(F.col("node_id").alias("id"), "embedding")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.similar_pairs(_vectors(spark, d), 0.9).select(F.col("id_a").alias("node_id_a"), F.col("id_b").alias("node_id_b"))


def p6_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest nodes of every node whose hashed id is divisible by 50, among all nodes."""
    v = _vectors(spark, d)
    return neighbors.top_k(v.where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0), v, 10)


def p6_top_k_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 50, among all vectors."""
    e = table(spark, d, "embeddings").select(F.format_string("%012d", "vec_id").alias("id"), "embedding")
    top = neighbors.top_k(e.where("cast(id as bigint) % 50 = 0"), e, 10)
    return top.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("id").cast("bigint").alias("vec_id"), F.round("cosine", 6).alias("cosine"), F.col("place").cast("int").alias("place"))


# Containers and mixtures


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(tokens.sized(table(spark, d, "documents")), table(spark, d, "pack_limits"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p7_packed(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Per limit and source: how far mixed containers are from the proportions."""
    return packing.mixture(p7_packed(spark, d))


def p7_violations(spark: SparkSession, d: str) -> DataFrame:
    """Documents per limit, and zeros: nothing is lost, changed or too much for its container."""
    sizes = cut(tokens.sized(table(spark, d, "documents")))
    return packing.violations(packing.packed(sizes, table(spark, d, "pack_limits")), sizes)


def p8_draws(spark: SparkSession, d: str) -> DataFrame:
    """Mixes as large as the supply of their sources; a source that is too small for its share is repeated as often as it may."""
    return mixing.mixture(tokens.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"), whole=True)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(tokens.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"), whole=True)[1]


def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    """Documents per target, and zeros: none is drawn too often or for another source."""
    sizes, targets = cut(tokens.sized(table(spark, d, "documents"))), table(spark, d, "mix_targets")
    return mixing.violations(mixing.mixture(sizes, targets, whole=True)[0], sizes, targets)


# Personal information


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.detect(table(spark, d, "documents"), table(spark, d, "name_parts")).select("doc_id", "kind", "start_pos", "end_pos").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), table(spark, d, "name_parts"), SURROGATE_KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_pairs, p1_symbols, p4_found, p4_reasons, p4_layout, p6_found, p6_top_k, p6_top_k_embeddings, p7_packed, p7_report, p7_mixture, p7_violations, p8_draws, p8_shares, p8_violations, p9_found, p9_redacted)
}

ORACLE: dict[str, str] = {
    "p4_layout": r"""SELECT regexp_extract(path, '\.(\w+)$', 1) AS lang, count(*)::BIGINT AS n_files,
        max(list_max([length(x) FOR x IN regexp_split_to_array(content, '\r\n|\r|\n')]))::BIGINT AS max_line, sum(length(content))::BIGINT AS n_chars
        FROM source_files WHERE regexp_matches(content, '\S') GROUP BY 1""",
    "p6_found": """WITH v AS (SELECT DISTINCT node_id AS id, embedding AS e FROM code_node_embedding
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(embedding) IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        u AS (SELECT id, CAST(e AS DOUBLE[64]) AS e FROM v)
        SELECT a.id AS node_id_a, b.id AS node_id_b FROM u a JOIN u b ON a.id < b.id WHERE array_cosine_similarity(a.e, b.e) >= 0.9""",
    "p7_violations": """SELECT limit_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL)::BIGINT AS n_docs, 0::BIGINT AS n_lost, 0::BIGINT AS n_overfull, 0::BIGINT AS n_changed FROM pack_limits""",
    "p8_violations": """SELECT mix_id, t.source, max_repeats, coalesce(n, 0)::BIGINT AS n_docs, 0::BIGINT AS n_over_repeated, 0::BIGINT AS n_foreign
        FROM mix_targets t LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE text <> '' GROUP BY source) d ON d.source = t.source""",
    "p6_top_k_embeddings": """SELECT q AS query_id, vec_id, round(c, 6) AS cosine, place FROM (
          SELECT a.vec_id AS q, b.vec_id, array_cosine_similarity(a.e, b.e) AS c,
                 CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY array_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS INTEGER) AS place
          FROM (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings WHERE vec_id % 50 = 0) a
          JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings) b ON a.vec_id <> b.vec_id) WHERE place <= 10""",
}
