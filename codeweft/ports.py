"""Extension points: what an own store, embedder or source has to offer, and the functions that SQL texts can call."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.vector import hashed


@runtime_checkable
class GraphStore(Protocol):
    """Node tables by label and edges, read and written as a whole."""

    def nodes(self, label: str) -> DataFrame: ...
    def edges(self) -> DataFrame: ...
    def write(self, label: str, rows: DataFrame) -> None: ...
    def write_edges(self, rows: DataFrame) -> None: ...


@runtime_checkable
class VectorStore(Protocol):
    """Vectors (id, node_type, repo_id, embedding)."""

    def vectors(self) -> DataFrame: ...
    def write(self, rows: DataFrame) -> None: ...


@runtime_checkable
class SnapshotSource(Protocol):
    """Files (path, repo_id, content) of a repository at a commit."""

    def files(self, repo_id: str, commit: str | None = None) -> DataFrame: ...


@runtime_checkable
class RecordStore(Protocol):
    """One of the control tables: repositories, tasks, commits, parse errors."""

    def rows(self) -> DataFrame: ...
    def append(self, rows: DataFrame) -> None: ...


@runtime_checkable
class MailPort(Protocol):
    """Takes finished HTML documents."""

    def send(self, rows: DataFrame) -> None: ...


class Folder:
    """Any of the stores as Parquet below a folder; a table is replaced by writing it beside and renaming it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _write(self, name: str, rows: DataFrame, mode: str = "overwrite") -> None:
        if mode == "append":
            rows.write.mode("append").parquet(f"{self.root}/{name}")
            return
        fresh = f"{self.root}/_{name}.new"
        rows.write.mode("overwrite").parquet(fresh)  # rows may still read the old table
        jvm = self.spark._jvm
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(path(f"{self.root}/{name}"), True)
        fs.rename(path(fresh), path(f"{self.root}/{name}"))

    def nodes(self, label: str) -> DataFrame:
        return self._read(label)

    def edges(self) -> DataFrame:
        return self._read("edges")

    def vectors(self) -> DataFrame:
        return self._read("vectors")

    def write(self, label: str, rows: DataFrame) -> None:
        self._write(label, rows)

    def write_edges(self, rows: DataFrame) -> None:
        self._write("edges", rows)

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, "append")


def register(spark: SparkSession, prefix: str = "cw_") -> list[str]:
    """Makes the functions of this library callable in SQL texts of the session; their names."""
    from codeweft.operators import diff
    from codeweft.sources import javaparse

    table = {
        f"{prefix}embed": F.udf(lambda t: hashed(t), "array<double>"), f"{prefix}relevant_diff": F.udf(lambda d, a, b: diff.relevant(d, a, b, 6, 12_000), "string"),
        f"{prefix}simple_type": F.udf(lambda t: None if t is None else javaparse.simple_type(t), "string"), f"{prefix}method_ids": F.udf(_method_ids, "array<string>"),
    }
    for name, f in table.items():
        spark.udf.register(name, f)
    return list(table)


def _method_ids(text: str | None) -> list[str]:
    from codeweft.sources import javaparse as J

    return [J.method_id(d.owner, d.name, [t for t, _ in d.params]) for d in J.parse(text, want_calls=False).decls if d.kind == "method"]
