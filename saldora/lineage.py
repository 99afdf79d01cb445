"""Cutting lineage in loops, on storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in spark.checkpoint.dir; a temporary folder only on a local master that names none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir", None)
        if given is None and sc.master != "local" and not sc.master.startswith("local["):  # executors of local-cluster are apart
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.gettempdir() + "/saldora")
    return df.checkpoint()
