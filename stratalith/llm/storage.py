"""Shared-folder staging: how the operators cut lineage without losing it to a dead executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.staging import shared_folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/stratalith/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a reliable cut of the lineage. In at most ``files`` files, where that is given."""
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_for(spark: SparkSession, n: int, each: int) -> int:
    """Files for ``n`` rows, ``each`` of them in a file, but not fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-n // each))


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Keep only the named columns, under private names, so that no other column can clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def numbered(df: DataFrame, out: str, label: str) -> DataFrame:
    """``df``, staged, with ``out`` = 0, 1, 2 ... in the order of its partitions and of the rows in them."""
    rows = staged(df.withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row per partition
    return rows.join(F.broadcast(before), part == F.col("__part")).withColumn(out, F.col("__at").bitwiseAND(F.lit(2**33 - 1)) + F.col("__before")).drop("__at", "__part", "__before")
