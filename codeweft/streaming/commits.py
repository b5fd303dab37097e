"""Commit events as a stream: idempotent, at least once, incremental."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "repo_id string, commit_hash string, branch string, pusher string, parent_commit_hash string"


def events(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Landed commit events (JSON lines) as a stream; rows that are no JSON come as nulls and are dropped."""
    raw = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)
    return raw.select(F.from_json("value", EVENT).alias("e")).select("e.*").where("repo_id is not null and commit_hash is not null")


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from Kafka, from the earliest offset; needs the connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*").where("repo_id is not null and commit_hash is not null")


def fresh(batch: DataFrame, processed: DataFrame) -> DataFrame:
    """Events of a batch that were not processed yet, each (repo, commit) once."""
    return batch.dropDuplicates(["repo_id", "commit_hash"]).join(processed.select("repo_id", "commit_hash").distinct(), ["repo_id", "commit_hash"], "left_anti")


def run(stream: DataFrame, state: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Feed new events to ``handle`` until the stream is drained; processed keys are kept below ``state``.

    A batch writes its keys into a folder of its own number after ``handle``
    has succeeded. A batch that fails is retried; one that is replayed after
    success finds its keys and does nothing.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        try:
            done = spark.read.schema("repo_id string, commit_hash string, batch int").option("basePath", f"{state}/processed").parquet(f"{state}/processed")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], "repo_id string, commit_hash string")
        new = fresh(batch, done).persist()
        try:
            handle(new, number)
            new.select("repo_id", "commit_hash").write.mode("overwrite").parquet(f"{state}/processed/batch={number}")
        finally:
            new.unpersist()

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
