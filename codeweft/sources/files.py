"""Files as tables: snapshots, text search and snippets."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft import errors
from codeweft.functions.text import glob_regex, lines, normal_glob, posix, source_root, truncated

# Folders that text search skips, wherever they stand below the root.
IGNORED = (".git", ".svn", ".hg", ".idea", ".gradle", "node_modules", "target", "build", "dist", "out", ".mvn")


def snapshot(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """(path, relative_path, content, checksum, line_count, last_modified, n_bytes, source_root) of the files below ``root``.

    A root that does not exist gives no rows.
    """
    cols = "path string, relative_path string, content string, checksum string, line_count int, last_modified bigint, n_bytes bigint, source_root string"
    if "://" not in root and not os.path.isdir(root):
        return spark.createDataFrame([], cols)
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = posix(F.regexp_replace("path", "^file:/*", "/"))
    text = F.col("content").cast("string")
    base = posix(F.lit(os.path.abspath(root) if "://" not in root else root))
    return b.select(
        path.alias("path"), F.substring(path, F.length(base) + 2, F.lit(100_000)).alias("relative_path"), text.alias("content"), F.md5("content").alias("checksum"),
        F.size(lines(text)).alias("line_count"), F.unix_millis("modificationTime").alias("last_modified"), F.col("length").alias("n_bytes"), source_root(path).alias("source_root"),
    )


def inside(root: str, path: str) -> str:
    """The real path of ``path`` below ``root``; error 100007 if it leads outside."""
    base = os.path.realpath(root)
    full = os.path.realpath(path if os.path.isabs(path) else os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise errors.EngineError(errors.PATH_ESCAPE, "path leads outside of the repository")
    return full


def matches(line: Column, query: str, regex: bool = False, ignore_case: bool = False) -> Column:
    """Whether a line has the query: by regular expression (find), literally, or in any case."""
    if regex:
        try:
            re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", query))
        except re.error as e:
            raise errors.EngineError(errors.BAD_PATTERN, str(e)) from None
        return line.rlike(("(?i)" if ignore_case else "") + query)
    return F.contains(F.lower(line), F.lower(F.lit(query))) if ignore_case else F.contains(line, F.lit(query))


def search(
    files: DataFrame, query: str, regex: bool = False, ignore_case: bool = False, sub_path: str = "", glob: str = "**/*.java", max_hits: int = 100,
    max_files: int = 50_000, max_bytes: int = 2 * 1024 * 1024, skip_ignored: bool = True,
) -> dict[str, DataFrame]:
    """Hits (path, line_number, line_text) in (relative_path, content, n_bytes), with counts.

    Files come in path order up to ``max_files``, hits in path and line order
    up to ``max_hits``; truncation is reported when a cap is reached. Lines
    beyond 4000 characters are cut after matching. Null contents have no lines.
    """
    max_hits, max_files, max_bytes = max(1, min(500, max_hits)), max(1, min(200_000, max_files)), max(1024, max_bytes)
    rel = F.col("relative_path")
    root = sub_path.strip("/").replace("\\", "/")
    below = F.when(rel.startswith(root + "/"), F.substring(rel, len(root) + 2, 100_000)) if root else rel
    f = files.withColumn("_b", below).where("_b is not null").where(F.col("_b").rlike(glob_regex(normal_glob(glob))) & (F.col("n_bytes") <= max_bytes))
    if skip_ignored:
        f = f.where(~F.arrays_overlap(F.slice(F.split("_b", "/"), F.lit(1), F.greatest(F.size(F.split("_b", "/")) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED))))
    # Where the file cap falls is found by paths alone; contents are then filtered by it and never sorted.
    last = f.select("relative_path").orderBy("relative_path").limit(max_files).agg(F.max("relative_path").alias("_last"))  # one row
    scanned = f.join(F.broadcast(last), F.col("relative_path") <= F.col("_last"))
    hit = scanned.select("relative_path", F.posexplode(lines("content")).alias("p", "line")).where(matches(F.col("line"), query, regex, ignore_case))
    hits = hit.select(F.col("relative_path").alias("path"), (F.col("p") + 1).alias("line_number"), truncated("line", 4000, "…").alias("line_text")).orderBy("path", "line_number").limit(max_hits)
    n = scanned.agg(F.count("*").alias("scanned_files"), (F.count("*") >= max_files).alias("truncated_by_max_files"))
    return {"hits": hits, "scanned": n, "counts": hits.agg(F.count("*").alias("n_hits"), (F.count("*") >= max_hits).alias("truncated_by_max_hits"))}


def snippets(files: DataFrame, start: Column | int | None, end: Column | int | None, max_chars: int = 262_144, max_span: int = 2000, strict: bool = False) -> DataFrame:
    """(path, start_line, end_line, content, truncated): a closed range of lines of each file.

    The range is cut to ``max_span`` lines and to the end of the file. A
    missing, reversed or too early end is error 100009; so is a range beyond
    the end of a file if ``strict``, which otherwise gives a null content.
    """
    if start is None or end is None:
        raise errors.EngineError(errors.SNIPPET_RANGE, "a range needs both ends")
    if isinstance(start, int) and isinstance(end, int) and (start < 1 or end < start):
        raise errors.EngineError(errors.SNIPPET_RANGE, "a range begins at 1 or later and ends no earlier")
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    max_chars = max(1, min(262_144 * 4, max_chars))
    ls = lines("content")
    last = F.least(b, a + max_span - 1, F.size(ls))
    text = F.when((a >= 1) & (b >= a) & (a <= F.size(ls)), F.array_join(F.slice(ls, F.greatest(a, F.lit(1)), F.greatest(last - a + 1, F.lit(0))), "\n"))
    if strict:
        text = F.coalesce(text, F.raise_error(F.lit(f"{errors.SNIPPET_RANGE}: nothing in this range")).cast("string"))
    out = files.select(F.col("path"), a.alias("start_line"), last.alias("end_line"), text.alias("_t"))
    return out.select("path", "start_line", "end_line", F.substring("_t", 1, max_chars).alias("content"), (F.length("_t") > max_chars).alias("truncated"))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row per key."""
    w = W.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
