"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder that ``spark.checkpoint.dir`` names and goes on from there, so that lost
    executors cost no round again. A local session without the setting uses a temporary folder; on a cluster that is an
    error."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not folder and (master.startswith("local-cluster") or not master.startswith("local")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)
