"""Sinks. A scoring run replaces its own partition, so a repeated run leaves the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_scores(output: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Append one run's rows below ``path/scored_at=...``; a second write of the run overwrites the first."""
    writer = output.write.partitionBy("scored_at").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if file_format == "csv":
        writer = writer.option("header", "true")
    writer.format(file_format).save(path)
