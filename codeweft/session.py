"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow)."""
    b = SparkSession.builder.master(master).appName("codeweft")
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only
    where that is unset (local tests) a temporary folder is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codeweft-"))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filled(col: str):
    """True where ``col`` is neither null nor blank (white space only counts as blank)."""
    return F.col(col).isNotNull() & F.col(col).rlike(r"\S")
