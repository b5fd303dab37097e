"""References to keys that were not there: orphans per table and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.session import partitions

_PARENT, _CHILD = 0, 1


def orphan_references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``children`` whose key had no live parent at their time.

    ``children``: (ref_id, side, tbl, key, at); ``parents``: (tbl, key, since,
    until) with until null for "still there" and since null for "always".
    A parent covers ``at`` if since <= at < until. Null and blank child keys
    are no references; a child with a null time is an orphan unless an
    "always" parent has its key. Repeated parents and overlapping lifetimes
    count once, a lifetime that ends before it begins covers nothing.

    Parents and children are tagged and united in long form, then grouped by
    table and key; within a group the running number of open lifetimes is the
    parent flag at each child. Keys that hold more than a quarter of a
    partition's share of the children (found by a frequent-items pass whose
    result is bounded by its support) are spread over salts, with their few
    lifetimes repeated per salt, so that no group outgrows a task.
    """
    spark = children.sparkSession
    width = partitions(spark)
    kids = children.where(F.col("key").rlike(r"\S")).select("tbl", "key", "at", "ref_id", "side")
    hot = kids.freqItems(["key"], max(1e-4, 1 / (4 * width))).select(F.explode("key_freqItems").alias("key")).distinct()
    hot = spark.createDataFrame([(r["key"], True) for r in hot.collect()], "key string, hot boolean")  # at most 1/support rows

    kids = kids.join(F.broadcast(hot), "key", "left").select(
        "tbl", "key", F.when(F.col("hot"), F.pmod(F.xxhash64("ref_id", "side"), F.lit(width)).cast("int")).otherwise(0).alias("salt"),
        F.col("at").alias("t"), F.lit(_CHILD).alias("tag"), F.lit(0).alias("open"), "ref_id", "side",
    )
    spans = parents.where(F.col("key").rlike(r"\S") & (F.col("until").isNull() | F.col("since").isNull() | (F.col("since") < F.col("until"))))
    marks = spans.select("tbl", "key", F.explode(F.array(F.struct(F.col("since").alias("t"), F.lit(1).alias("open")), F.struct(F.col("until").alias("t"), F.lit(-1).alias("open")))).alias("m"))
    marks = marks.where("not (m.open = -1 and m.t is null)").groupBy("tbl", "key", F.col("m.t").alias("t")).agg(F.sum("m.open").cast("int").alias("open"))
    marks = marks.join(F.broadcast(hot), "key", "left").select(
        "tbl", "key", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(width - 1))).otherwise(F.array(F.lit(0)))).alias("salt"),
        "t", F.lit(_PARENT).alias("tag"), "open", F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast("string").alias("side"),
    )
    # Nulls sort first: an "always" parent opens before everything, a child without time sees only those. At equal times lifetimes open and close before the child looks.
    order = W.partitionBy("tbl", "key", "salt").orderBy(F.col("t").asc_nulls_first(), "tag").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = kids.unionByName(marks).withColumn("n_open", F.sum("open").over(order))
    return seen.where((F.col("tag") == _CHILD) & (F.col("n_open") <= 0)).select("ref_id", "side", "tbl", "key", F.col("t").alias("at"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, side and month of their time (null: no time)."""
    return orphans.groupBy("tbl", "side", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n_orphans"), F.countDistinct("key").alias("n_keys"))
