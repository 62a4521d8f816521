"""Tables that cut long plans: written once under the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stage(df: DataFrame) -> DataFrame:
    """A table of the rows of ``df`` in spark.checkpoint.dir, or in a fresh local folder where that is unset in local mode (tests).

    Archives and page files are read once, later steps plan on plain columns, and a lost executor costs one step.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quirework-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
