"""Cut lineage with a reliable checkpoint in the folder the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """Checkpoint the frame. The session setting names the shared folder; only a session with
    none, such as a local test, gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="grainmill-"))
    return df.checkpoint()
