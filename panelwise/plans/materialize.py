"""Cut long lineage before a frame is read many times (model fits, folds).

Uses a reliable ``checkpoint()`` or a written table in the cluster's shared
``spark.checkpoint.dir`` (read from the session, never a machine-local folder), so a lost
executor re-reads the saved files instead of recomputing panels, fills and windows.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(df_or_spark) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).  Where it is unset, a
    session in one JVM takes a temporary folder; on a cluster that is an error."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d and re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelwise-"))
        d = sc.getCheckpointDir()
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    return d.rstrip("/")


def fresh_dir(df_or_spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(df_or_spark)}/panelwise-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, and
    a lost executor re-reads files instead of repeating the work."""
    path = fresh_dir(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df))
    return df.checkpoint(eager=True)
