"""How results are laid out: written once for several readers, spread over the cores."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``df``, written to the shared checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir``.  Where none is named,
    a session whose tasks all run in this process gets a folder of its own; on
    a cluster, whose executors would not share it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        if folder is None:
            folder = tempfile.mkdtemp(prefix="lectern")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A table in fewer files than cores would be read, and worked on, by as many
    tasks; only such small ones are moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
