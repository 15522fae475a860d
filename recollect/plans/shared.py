"""The folder that driver and executors share, for checkpoints and stream logs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else a temporary folder in local mode, and a folder of the warehouse on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = tempfile.mkdtemp() if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed and written to the shared folder: short lineage that survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
