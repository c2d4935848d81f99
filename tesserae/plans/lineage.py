"""Cutting the lineage of what is computed once and read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that spark.checkpoint.dir names; on a cluster that setting is needed."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="tesserae-"))  # one machine, as in tests
    return sc.getCheckpointDir().rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df computed once and reread from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
