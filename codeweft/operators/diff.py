"""Snapshot diffs, line diffs and unified-diff hunks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.functions.text import lines, truncated

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def snapshot_diff(old: DataFrame, new: DataFrame, suffix: str = ".java") -> DataFrame:
    """(path, change_type) of two snapshots (path, checksum): ADDED, MODIFIED or DELETED."""
    a = old.where(F.col("path").endswith(suffix)).select("path", F.col("checksum").alias("a"), F.lit(True).alias("in_a"))
    b = new.where(F.col("path").endswith(suffix)).select("path", F.col("checksum").alias("b"), F.lit(True).alias("in_b"))
    j = a.join(b, "path", "full_outer")
    kind = F.when(F.col("in_a").isNull(), "ADDED").when(F.col("in_b").isNull(), "DELETED").when(~F.col("a").eqNullSafe(F.col("b")), "MODIFIED")
    return j.select("path", kind.alias("change_type")).where("change_type is not null")


def line_counts(old: str | None, new: str | None) -> tuple[int, int]:
    """(insertions, deletions) between two texts, line by line."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    ins = dele = 0
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag != "equal":
            dele += j - i
            ins += m - k
    return ins, dele


def line_stats(pairs: DataFrame) -> DataFrame:
    """``pairs`` (old, new texts) plus insertions and deletions."""

    @F.pandas_udf("insertions int, deletions int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([line_counts(x, y) for x, y in zip(a, b)], columns=["insertions", "deletions"])

    return pairs.withColumn("_s", run("old", "new")).select(*pairs.columns, "_s.insertions", "_s.deletions")


def unified(pairs: DataFrame) -> DataFrame:
    """``pairs`` (path, old, new) plus ``diff``: a unified diff with three lines around; equal texts give ''."""

    @F.pandas_udf("string")
    def run(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), f"a/{q}", f"b/{q}", lineterm="", n=3)) for q, x, y in zip(p, a, b)], dtype=object)

    return pairs.withColumn("diff", run("path", "old", "new"))


def hunks(diffs: DataFrame, key: str = "key", text: str = "diff") -> DataFrame:
    """(key, hunk, new_start, new_end, body): the hunks of unified diffs, wherever they stand in a text.

    A hunk runs from its header to the next header or the end of its text; a
    header without a length has one line, a length of 0 ends before it begins.
    """
    rows = diffs.select(key, F.posexplode(lines(text)).alias("pos", "line"))
    head = F.col("line").rlike(HUNK)
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("hunk", F.sum(F.when(head, 1).otherwise(0)).over(w)).where("hunk > 0")
    part = lambda i: F.regexp_extract("first", HUNK, i)
    out = rows.groupBy(key, "hunk").agg(F.min_by("line", "pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    start = part(3).cast("int")
    length = F.when(part(4) == "", 1).otherwise(part(4).cast("int"))
    return out.select(key, F.col("hunk").cast("int").alias("hunk"), start.alias("new_start"), (start + length - 1).alias("new_end"), "body")


def overlapping(nodes: DataFrame, hunk_rows: DataFrame, key: str = "key", pad: int = 6) -> DataFrame:
    """Nodes (key, node, line_start, line_end) with the hunks of the same key they meet, ``pad`` lines around."""
    j = nodes.join(hunk_rows, key)
    return j.where((F.col("new_end") >= F.col("line_start") - pad) & (F.col("new_start") <= F.col("line_end") + pad))


def relevant(diff: str | None, start: int | None, end: int | None, pad: int, most: int) -> str:
    """The hunks of ``diff`` that meet new lines start-pad..end+pad, file headers once; the whole diff, cut, if none can be chosen."""
    import re

    if not diff or not diff.strip():
        return ""

    def cut(s: str) -> str:
        return s if len(s) <= most else s[:most] + "\n... [truncated]\n"

    if start is None or end is None or start < 1 or end < 1:
        return cut(diff)
    low = max(1, start - max(0, pad))
    high = max(low, end + max(0, pad))
    rows = diff.split("\n")
    at = [i for i, x in enumerate(rows) if re.match(HUNK, x)]
    if not at:
        return cut(diff)
    kept = []
    for i, j in zip(at, [*at[1:], len(rows)]):
        m = re.match(HUNK, rows[i])
        a = int(m[3])
        b = a + (1 if m[4] is None else int(m[4])) - 1
        if b >= low and a <= high:
            kept += rows[i:j]
    return cut("\n".join(rows[: at[0]] + kept)) if kept else cut(diff)


def node_snippets(nodes: DataFrame, diffs: DataFrame, key: str = "path", pad: int = 6, most_chars: int = 12_000) -> DataFrame:
    """``nodes`` (key, line_start, line_end, ...) plus ``snippet``: the part of their file's diff (key, diff) that concerns them.

    Nodes of files without a diff get an empty snippet.
    """

    @F.pandas_udf("string")
    def pick(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        at = lambda x: None if pd.isna(x) else int(x)
        return pd.Series([relevant(x, at(s), at(e), pad, most_chars) for x, s, e in zip(d, a, b)], dtype=object)

    return nodes.join(diffs.select(key, F.col("diff").alias("_d")), key, "left").withColumn("snippet", pick("_d", "line_start", "line_end")).drop("_d")


def diff_totals(stats: DataFrame, *by: str) -> DataFrame:
    """(by, files, insertions, deletions): what ``line_stats`` adds up to; no rows give one row of zeros where ``by`` is empty."""
    return stats.groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum("insertions"), F.lit(0)).alias("insertions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"))


def first_parent_diff(versions: DataFrame, parents: DataFrame) -> DataFrame:
    """(commit_hash, path, change_type) of every commit against its first parent.

    ``versions``: (commit_hash, path, checksum), the files of each snapshot;
    ``parents``: (commit_hash, parent_hash), at most one row per commit. A
    commit without parent, or whose parent has no snapshot, adds all its files.
    """
    new = versions.select("commit_hash", "path", F.col("checksum").alias("b"), F.lit(True).alias("in_b"))
    old = versions.select(F.col("commit_hash").alias("parent_hash"), "path", F.col("checksum").alias("a"), F.lit(True).alias("in_a"))
    old = old.join(parents.where("parent_hash is not null"), "parent_hash").join(versions.select("commit_hash").distinct(), "commit_hash", "left_semi").select("commit_hash", "path", "a", "in_a")
    j = new.join(old, ["commit_hash", "path"], "full_outer")
    kind = F.when(F.col("in_a").isNull(), "ADDED").when(F.col("in_b").isNull(), "DELETED").when(~F.col("a").eqNullSafe(F.col("b")), "MODIFIED")
    return j.select("commit_hash", "path", kind.alias("change_type")).where("change_type is not null")


def diff_budget(nodes: DataFrame, most: int = 120) -> DataFrame:
    """The first ``most`` nodes in order of file, kind (types, methods, fields) and position get a snippet."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in (("TYPE", 0), ("METHOD", 1), ("FIELD", 2)) for x in kv)), F.col("kind"))
    return nodes.withColumn("kind_ord", kind).orderBy("file_pos", "kind_ord", "pos").limit(most)


def evidence(meta: Column, files: DataFrame, nodes: DataFrame, by: str, most_chars: int = 12_000) -> DataFrame:
    """One evidence document (JSON) per ``by``: meta, changed files with totals, nodes with cut snippets."""
    f = files.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("path", "change_type"))).alias("changedFiles"), F.struct(F.count("*").alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions")).alias("lineStats"),
    )
    n = nodes.select(by, F.struct("kind", F.col("qualified_name").alias("qualifiedName"), F.col("path").alias("filePath"), truncated("snippet", most_chars).alias("diffSnippet")).alias("x")).groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("nodes"))
    return f.join(n, by, "left").select(by, F.to_json(F.struct(meta.alias("meta"), "changedFiles", "lineStats", "nodes")).alias("document"))
