"""Cutting lineage so that it survives lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names in spark.checkpoint.dir.

    Only a session on one machine that names none gets a temporary one; on a cluster that is an error.
    """
    session = df.sparkSession
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = session.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)
