"""Writers of the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def tsv(df: DataFrame, path: str, decimals: dict[str, int] | None = None, order: list[str] | None = None, one_file: bool = False) -> None:
    """Table with a header, by tabs; decimals are rounded half to even. ``one_file`` is for small exports."""
    for column, n in (decimals or {}).items():
        df = df.withColumn(column, F.bround(column, n))
    if order:
        df = df.orderBy(*order)
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")


def json_lines(df: DataFrame, path: str) -> None:
    """A JSON object per line; text beyond ASCII stays as it is."""
    df.write.mode("overwrite").json(path)


def dated(df: DataFrame, path: str, estimate: str = "est", work: str = "work") -> None:
    """Dated works by estimate, then work."""
    parquet(df.orderBy(estimate, work), path)
