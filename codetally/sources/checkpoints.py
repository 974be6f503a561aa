"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local-mode session gets a temporary one, which goes with
    the process; on a cluster that is an error, since a machine-local folder dies
    with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and context.getCheckpointDir():
        return context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="codetally-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured
