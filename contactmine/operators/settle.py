"""Compute a frame once when a plan reads it more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read back from there.

    Without a checkpoint folder (``spark.checkpoint.dir``) the frame is returned as
    it is: results are the same, its plan is then evaluated by each reader.
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        return df
    return df.checkpoint()
