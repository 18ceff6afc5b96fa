"""How iterations cut their lineage: a reliable copy in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a temporary folder serves a local session; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratalith-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df``; dealt out anew where it has fewer partitions than there are cores, as a table of one small file."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/stratalith/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
