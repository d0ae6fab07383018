"""Cutting long lineages in a way that survives lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by spark.checkpoint.dir.

    Only a local session without that setting falls back to a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="cellweave-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
