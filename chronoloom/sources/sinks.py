"""Sinks: Parquet tables and Markdown briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition: str | None = "asset_id") -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_briefs(briefs: DataFrame, path: str) -> None:
    """asset_id, brief -> text files in one folder for each asset."""
    briefs.select("asset_id", "brief").write.mode("overwrite").partitionBy("asset_id").text(path)
