"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir and read from there. Where that is unset, a folder in the warehouse, or a temporary one in a local session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            local = context.master == "local" or context.master.startswith("local[")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-") if local else f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
