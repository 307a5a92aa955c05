"""Stage boundaries: results written once to the folder that all executors share, with their lineage cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where it is unset on one machine, as in tests, a folder of our own is set.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not where:
        where = "file://" + os.path.join(tempfile.gettempdir(), "seamline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", where)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, with its lineage cut; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
