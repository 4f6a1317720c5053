"""Lineage cuts that survive lost executors: tables written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one, in local mode only."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="graphloom-"))


def materialize(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write df to the shared folder, a folder for each value of column by, and read it back, so that nothing upstream runs twice."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove the files of materialized frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
