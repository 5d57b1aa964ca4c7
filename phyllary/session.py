"""Session helpers: table access, shipping the package to workers, durable cuts of lineage, guarded broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)

#: Rows beyond which a side that is not bounded by design is never broadcast.
BROADCAST_ROWS = 200_000


_shipped: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, as in tests."""
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def _shipment() -> str:
    """The package as an archive that workers import from. The driver's file server hands it out; nothing else reads it."""
    path = Path(tempfile.mkdtemp(prefix="phyllary-code-")) / "phyllary.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(Path(ROOT, "phyllary").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    return str(path)


def prepare(spark: SparkSession) -> SparkSession:
    """Let the workers import the package, once per session: on one machine from its folder, on a cluster from an archive that Spark
    ships to every executor. Every function of this package that runs Python on workers calls it."""
    sc = spark.sparkContext
    if _shipped.get("application") != sc.applicationId:
        _shipped["application"] = sc.applicationId
        if not is_local(spark):
            sc.addPyFile(_shipment())
    env = sc.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def arrow_function(f, return_type: str):
    """F.pandas_udf for workers that can import the package."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        prepare(spark)
    return F.pandas_udf(f, return_type)


def in_batches(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInPandas for workers that can import the package."""
    prepare(df.sparkSession)
    return df.mapInPandas(f, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that is set, or else the cluster's own (spark.checkpoint.dir). Where neither is, a folder of this
    machine serves a local session, as in tests; on a cluster that is an error, as executors elsewhere could not read it."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not where and not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="phyllary-ckpt-"))
    return where or ""


def durable(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, so that later stages neither recompute nor depend on any one executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the side has at most that many rows (counted up to the bound only), else the side as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work that is bound by Python: dealt out anew only where it has fewer partitions than there are cores,
    which is where it is small; larger inputs keep the partitions of their files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
