"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def make_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    On a cluster without a shared file system the package is shipped as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table of a data folder, pruned to ``columns`` if any are given."""
    make_importable(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    The cluster's ``spark.checkpoint.dir`` is used where it is set. Where it is
    not, a folder of this machine serves a session that runs on this machine
    alone; on a cluster, whose executors would not share it, that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return shared
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "palimp-checkpoints"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut at a reliable checkpoint all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)
