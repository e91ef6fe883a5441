"""Results that are cut from their lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """``df`` written by ``checkpoint``; a folder of its own is made only on a single machine without ``spark.checkpoint.dir``."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="whorl-"))
    return df.checkpoint()
