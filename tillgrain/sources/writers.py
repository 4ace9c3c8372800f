"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Arrays as comma-joined text, for formats without nested types."""
    return df.select(
        *[
            F.array_join(name, ", ").alias(name) if kind.startswith("array") else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    flat(df).write.mode("overwrite").options(header=True, encoding=encoding).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full refresh.

    The rebalance hint gathers each output partition into few files and lets adaptive
    execution split the large ones, so a month with a third of all rows is not one task.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(
            *partition_by
        ).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_table(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    bucket_by: str | None = None,
    buckets: int = 0,
    path: str | None = None,
) -> None:
    """Full refresh of a catalog table, stored under ``path`` where one is given.

    Tables bucketed alike by a key (say CustomerID) join and group on it without a shuffle.
    """
    if bucket_by:
        df = df.repartition(buckets, bucket_by)  # one file per bucket instead of one per task
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)


def write_jdbc(
    df: DataFrame, url: str, table: str, properties: dict[str, str], batch_size: int = 5000
) -> None:
    """Full refresh of a database table that keeps its definition."""
    df.write.option("truncate", True).option("batchsize", batch_size).jdbc(
        url, table, mode="overwrite", properties=properties
    )
