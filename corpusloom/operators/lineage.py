"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from a checkpoint in spark.checkpoint.dir.

    Only where that setting is absent (local tests) a temporary folder of the machine takes its place, until the process ends.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        if not folder:
            folder = tempfile.mkdtemp(prefix="corpusloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()
