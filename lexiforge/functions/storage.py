"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(rows: DataFrame) -> DataFrame:
    """rows, written to the checkpoint folder now and read from there ever after: what they were made of is not
    computed again, and a lost executor costs nothing. Select the columns that are needed before.

    The folder is that of spark.checkpoint.dir; only where none is set and the master is local, as in tests, one of
    this machine. A cluster without the setting is an error.
    """
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = context.getConf().get("spark.checkpoint.dir") or rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(root or f"file://{tempfile.mkdtemp(prefix='lexiforge-')}")
    return rows.checkpoint()
