"""Generated, minified, vendored and data-like source files.

Layout statistics with thresholds per language decide about minified files
and data saved as code. They cannot see who wrote a file, so generator marks
in its comments, the folder it stands in and the origin of its package or
text decide about generated and third-party files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm import layout
from codeweft.session import cut

#: Thresholds per language: longest and mean line (characters), least share of white space, largest shares of
#: numeric literals and of encoded runs, and the range of the alphanumeric share that code has.
LIMITS = {
    "java": {"max_line": 1500, "mean_line": 200, "space": 0.06, "numeric": 0.50, "encoded": 0.35, "alnum": (0.25, 0.93)},
    "js": {"max_line": 500, "mean_line": 110, "space": 0.08, "numeric": 0.40, "encoded": 0.30, "alnum": (0.30, 0.90)},
    "py": {"max_line": 1000, "mean_line": 160, "space": 0.10, "numeric": 0.35, "encoded": 0.30, "alnum": (0.30, 0.90)},
}
OTHER = {"max_line": 1500, "mean_line": 200, "space": 0.06, "numeric": 0.50, "encoded": 0.35, "alnum": (0.20, 0.95)}
#: Shorter texts have no layout to speak of: their shares decide nothing.
LEAST_CHARS = 200

# How tools mark their output. A statement must begin its comment line, so that prose about generated files is no mark.
_OPEN = r"(?im)^[ \t]*(?:(?://+|/\*+|\*|#+|<!--|--)[ \t!]*)(?:/\*[^*\n]*\*/[ \t]*/\*[ \t]*)?(?:eslint-disable[ \t]*(?:\*/[ \t]*/\*[ \t]*|\n[^\w\n]*))?"
STATEMENTS = (
    r"(?:this (?:file|code|class|output|source|unit|module) (?:is|was|has been) )?(?:auto[- ]?|machine[- ])?generated (?:by|from|with|using|file|code|source|automatically|on)\b",
    r"(?:this|the) (?:file|code|class|output|source|unit|module) (?:is|was|has been) (?:automatically |mechanically )?(?:produced|created|emitted|rendered|derived|compiled|built|assembled|written) (?:automatically )?(?:from|by (?:a |the )?(?:tool|machine|script|compiler|generator|plugin)|with|out of)\b",
    r"@generated\b", r"<auto-?generated\b", r"<autogenerated\b", r"auto-?generated[.,:;!* ]*(?:do not|$)",
    r"(?:code|file|source) (?:written|produced|created|emitted|generated) by (?:a )?(?:machine|tool|the)\b", r"machine[- ](?:written|made|generated) (?:from|by|with)\b",
    r"this (?:output|file|code) is (?:overwritten|rewritten|recreated|regenerated) by\b", r"(?:stub|code|file|class|source)s? (?:emitted|produced) by\b",
    r"source: [\w./-]+\.(?:proto|wsdl|xsd|thrift|avsc|g4|idl|fbs|graphql)\b", r"(?:tool|generator): [\w.-]+", r"end of generated code\b", r"do not edit[ ,;:.!-]+(?:generated|this file is)",
    r"(?:fichero|archivo|c[oó]digo) generado\b", r"(?:diese )?datei (?:wurde |ist )?(?:automatisch )?(?:generiert|erzeugt)\b", r"automatisch (?:generiert|erzeugt)", r"fichier g[eé]n[eé]r[eé]\b", r"code g[eé]n[eé]r[eé]\b",
    r"[^\n]{0,20}自动生成", r"由[^\n]{0,20}生成", r"自動生成",
)
# What a top-level comment says only where the next run of a tool replaces the file.
WARNINGS = (
    r"(?:manual|hand|local|any) (?:changes|edits|modifications)(?: (?:made )?(?:to|in) this file)? (?:will be|are|get) (?:lost|overwritten|discarded)\b",
    r"\bregenerate (?:it |this file )?(?:instead of|rather than) (?:editing|changing)\b", r"\b(?:edit|change) the (?:template|schema|grammar|model) (?:instead|and regenerate)\b",
)
_MARK = re.compile(_OPEN + "(?:" + "|".join(STATEMENTS) + ")")
_WARNING = re.compile("(?i)" + "|".join(WARNINGS))
_ANNOTATION = re.compile(r"(?m)^[ \t]*@(?:javax?\.annotation\.(?:processing\.)?)?Generated\b")
_TYPE_LINE = re.compile(r"(?m)^[ \t]*(?:(?:public|protected|private|abstract|final|static|sealed|strictfp)[ \t]+)*(?:class|interface|enum|record|@interface)[ \t]+\w")
_TOP_COMMENT = re.compile(r"(?:^|(?<=\n))(?:/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|(?://|#|--)[^\n]*)", re.S)
_PACKAGE = re.compile(r"(?:^|[\n;/])[ \t]*package\s+([\w.\s]+?)\s*;")
# Notices that third-party files carry, and folders that hold nothing else in script trees.
_NOTICE = re.compile(r"(?im)^[ \t]*(?:/\*+!?|//+|\*|#+)[ \t]*(?:Copyright \(c\) the [\w-]+ contributors\b|Part of [\w-]+, see NOTICE\b|[\w.-]+ [\w.-]+ v?\d[\w.]* \| \(c\) |Licensed to the [\w -]+ under|SPDX-License-Identifier:)|^[ \t]*/\*![^\n]*\(c\)")
_SCRIPT_FOLDERS = re.compile(r"/(?:node_modules|bower_components|site-packages|third_party|vendor)/")
# Folders that build tools write sources into, and, for compiled languages, the folders of build output.
_GENERATED_FOLDERS = re.compile(r"/(?:generated|generated-(?:test-)?sources|gen|src-gen|gen-src)/")
_OUTPUT_FOLDERS = re.compile(r"/(?:target|build|out)/")
_HAND_ROOT = re.compile(r"/src/(?:main|test)/")

#: What ``read`` tells about each file. ``s``: sorted shingle hashes (8 bytes each), ``n`` of them; ``cls``: equal for equal words.
READ = (
    "path string, repo_id string, lang string, n_chars int, max_line int, mean_line double, space double, alnum double, numeric double, encoded double, "
    "generated boolean, root string, notice boolean, cls bigint, n int, s binary"
)


def source_root(path: str, package: str) -> str:
    """The folder of a file up to where its package begins."""
    folder = path.rpartition("/")[0] + "/"
    tail = "/" + package.replace(".", "/") + "/"
    return folder[: -len(tail) + 1] if package and folder.endswith(tail) else folder


def in_output(path: str, lang: str, package: str) -> bool:
    """Whether a file stands where tools write: a folder of generated sources or build output above its package, not below ``src/main`` or ``src/test``."""
    root = source_root(path, package)
    if _HAND_ROOT.search(root):
        return False
    return bool(_GENERATED_FOLDERS.search(root) or lang == "java" and _OUTPUT_FOLDERS.search(root))


def traits(path: str, text: str) -> tuple[bool, str | None, bool]:
    """(generated, package root of two labels, notice) of one file."""
    lang = path.rpartition(".")[2].lower()
    comments = "\n".join(m[0] for m in _TOP_COMMENT.finditer(text))
    package, top = "", comments
    if lang == "java":
        first = _TYPE_LINE.search(text)
        head = text[: first.start()] if first else text
        m = _PACKAGE.search(head)
        package = "".join(m[1].split()) if m else ""
        top = head + "\n" + comments  # a header may be indented, a mark may close the file
    mark = bool(_MARK.search(top) or _WARNING.search(comments) or lang == "java" and _ANNOTATION.search(top))
    notice = bool(_NOTICE.search(top))
    root = ".".join(package.split(".")[:2]) if package else None
    return mark or in_output(path, lang, package), root, notice


def read(files: DataFrame) -> DataFrame:
    """READ of every file of (path, repo_id, content) that has a text; null, empty and blank contents have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, repo, raw in zip(b.column("path").to_pylist(), b.column("repo_id").to_pylist(), b.column("content").cast(pa.binary()).to_pylist()):
                lang = path.rpartition(".")[2].lower() if "." in path else ""
                stats = layout.statistics(raw)
                words = layout.shingles(layout.code_only(raw, lang == "java"))
                cls, s = words if words else (None, None)
                rows.append((path, repo, lang, *stats, *traits(path, raw.decode("utf-8", "replace")), cls, None if s is None else len(s), None if s is None else s.tobytes()))
            cols = list(zip(*rows)) if rows else [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)

    some = files.where(F.col("path").isNotNull() & F.col("content").isNotNull() & F.col("content").rlike(r"\S"))
    return some.select("path", "repo_id", "content").mapInArrow(run, READ)


_ARROW = pa.schema([
    (c.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]])
    for c in READ.split(", ")
])


def _limit(name: str, at: int | None = None) -> Column:
    pick = lambda v: v if at is None else v[at]
    out = F.lit(pick(OTHER[name]))
    for k, v in LIMITS.items():
        out = F.when(F.col("lang") == k, F.lit(pick(v[name]))).otherwise(out)
    return out


def judged(files: DataFrame, library_roots: DataFrame, known_repos: DataFrame) -> DataFrame:
    """READ of every file with text, its flags and ``reason``.

    ``library_roots``: (root), the first two labels of packages of known
    libraries; ``known_repos``: (repo_id). Flags: minified, data, generated,
    vendored. ``reason`` is the first that holds, else null: hand-written.
    """
    f = read(files)
    big = F.col("n_chars") >= LEAST_CHARS
    tight = F.col("space") < _limit("space")
    over = lambda k: F.col(k) > _limit(k)
    odd = (F.col("alnum") < _limit("alnum", 0)) | (F.col("alnum") > _limit("alnum", 1)) & tight
    data = big & (over("numeric") | over("encoded") | odd)
    mini = big & (over("mean_line") | over("max_line") & tight)
    # The owner of a repository is the first label of its id; a root whose second label is no owner is foreign.
    owners = known_repos.select(F.substring_index("repo_id", "-", 1).alias("owner")).where("owner <> ''").distinct().withColumn("own", F.lit(True))
    libs = library_roots.select("root").distinct().withColumn("lib", F.lit(True))
    f = f.withColumn("data", data).withColumn("minified", mini & ~data)
    f = f.join(libs, "root", "left").join(owners, F.substring_index("root", ".", -1) == F.col("owner"), "left")
    foreign = F.coalesce(F.col("root").contains(".") & (F.col("lib").isNotNull() | F.col("own").isNull()), F.lit(False))
    folder = (F.col("lang") != "java") & F.col("path").rlike(_SCRIPT_FOLDERS.pattern)
    f = f.withColumn("vendored", foreign | F.col("notice") | folder)
    reason = F.when(F.col("generated"), "generated").when(F.col("vendored"), "vendored").when(F.col("data"), "data").when(F.col("minified"), "minified")
    return f.select(*(c.split()[0] for c in READ.split(", ")), "vendored", "data", "minified", reason.alias("reason"))


#: Of a known text's shingles, the rarest are looked up: one more than a similar text may lack, and this share of all on top.
EXTRA = 0.15
#: Bits of the map of looked-up shingles that every task gets (16 MB). When it is full it lets more through, never less.
MAP_BITS = 27


def copies(known: DataFrame, others: DataFrame, share: float = 0.8) -> DataFrame:
    """Keys of ``others`` whose shingles are as similar as ``share`` (Jaccard) to a text of ``known``.

    Both: (key, cls, n, s) as ``read`` gives them. Exact. A text that is
    similar lacks at most (1 - share) of a known text's shingles, so of any
    p of these it has p less that many. The p rarest ones, by their number of
    known texts, are looked up; the others' shingles are first held against a
    map of bits, so that only those that occur there are shuffled. Pairs with
    enough hits are compared in full. Known texts of one kind (smallest hash,
    size) have one representative; what it does not match meets the rest.
    Null keys and texts without words match nothing.
    """
    spark = known.sparkSession
    some = lambda df: df.where("key is not null and s is not null")
    k = some(known).groupBy("cls").agg(F.first("n").alias("n"), F.first("s").alias("s"))
    rows = k.mapInArrow(_exploded, "cls bigint, n int, low bigint, h bigint")
    df = rows.groupBy("h").agg(F.count("*").alias("df"))
    lacks = F.floor(F.col("n") * (1 - share) + 1e-9).cast("int")
    p = F.least("n", lacks + 1 + F.floor(F.col("n") * EXTRA).cast("int"))
    ranked = rows.join(df, "h").groupBy("cls").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("r"))  # one text's shingles each
    kind = F.struct("low", F.floor(F.log2("n") * 4))
    heads = ranked.select("cls", "n", kind.alias("kind"), (p - lacks).alias("need"), F.transform(F.slice("r", F.lit(1), p), lambda x: x["h"]).alias("hs"))
    first = heads.groupBy("kind").agg(F.min("cls").alias("cls")).select("cls", F.lit(True).alias("rep"))
    probe = cut(heads.join(first, "cls", "left").select("cls", F.col("n").alias("na"), "need", F.coalesce("rep", F.lit(False)).alias("rep"), F.explode("hs").alias("h")))

    shards = probe.select(F.shiftrightunsigned("h", 64 - MAP_BITS).cast("int").alias("bit")).distinct().groupBy(F.shiftright("bit", 16).alias("shard")).applyInPandas(_bits, "shard int, bits binary")
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in shards.collect():  # at most 2^(MAP_BITS - 16) rows of 8 KB
        bits[r["shard"] << 13 : (r["shard"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            keys, sizes, hit = [], [], []
            for key, n, s in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), b.column("s").to_pylist()):
                h = np.frombuffer(s, np.uint64)
                at = h >> np.uint64(64 - MAP_BITS)
                h = h[(m[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if len(h):
                    keys += [key] * len(h)
                    sizes += [n] * len(h)
                    hit.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(hit) if hit else [], pa.int64())], names=["key", "nb", "h"])

    o = some(others)
    same = o.join(k.select("cls"), "cls", "left_semi").select("key")
    hits = cut(o.select("key", "n", "s").mapInArrow(met, "key string, nb int, h bigint"))
    close = F.pandas_udf(_jaccard, "double")

    def matched(hits: DataFrame, probe: DataFrame) -> DataFrame:
        pairs = hits.join(probe, "h").where(F.least("na", "nb") >= share * F.greatest("na", "nb"))
        pairs = pairs.groupBy("key", "cls").agg(F.countDistinct("h").alias("c"), F.first("need").alias("need")).where("c >= need").select("key", "cls")
        full = pairs.join(k.select("cls", F.col("s").alias("s1")), "cls").join(o.select("key", F.col("s").alias("s2")), "key")
        return full.where(close("s1", "s2") >= share).select("key").distinct()

    one = cut(matched(hits, probe.where("rep")))
    two = matched(hits.join(one, "key", "left_anti"), probe.where("not rep"))
    return same.unionByName(one).unionByName(two).distinct()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for cls, n, s in zip(b.column("cls").to_pylist(), b.column("n").to_pylist(), b.column("s").to_pylist()):
            h = np.frombuffer(s, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, cls)), pa.array(np.full(n, n, np.int32)), pa.array(np.full(n, h[0]).view(np.int64)), pa.array(h.view(np.int64))], names=["cls", "n", "low", "h"]
            )


def _bits(pdf: pd.DataFrame) -> pd.DataFrame:
    bit = pdf["bit"].to_numpy() & 0xFFFF
    flags = np.zeros(1 << 16, np.uint8)
    flags[bit] = 1
    return pd.DataFrame({"shard": [int(pdf["bit"].iloc[0]) >> 16], "bits": [np.packbits(flags, bitorder="little").tobytes()]})


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both))
    return pd.Series(out, dtype=float)


def not_handwritten(files: DataFrame, library_roots: DataFrame, known_repos: DataFrame) -> DataFrame:
    """(path, reason) of every file that is no hand-written source.

    What ``judged`` finds, plus copies (changed, moved or stripped of their
    notice) of files that it found to be vendored, Java files among them: they
    are also moved into a package of the host project. Repeated rows of a path
    give one row per reason. Files without text are no cases.
    """
    j = judged(files, library_roots, known_repos)
    compared = F.col("reason").isNull() | F.col("vendored") & ~F.col("minified") & ~F.col("data")
    j = cut(j.select("path", "reason", "vendored", "cls", "n", F.when(compared, F.col("s")).alias("s")))
    found = j.where("reason is not null").select("path", "reason")
    side = lambda c: j.where(c).select(F.col("path").alias("key"), "cls", "n", "s")
    moved = copies(side("vendored"), side("reason is null")).select(F.col("key").alias("path"), F.lit("vendored").alias("reason"))
    return found.unionByName(moved).distinct()
