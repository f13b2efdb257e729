"""Run a stream over everything available now, into a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilframe.session import scratch_path


def run_available(stream: DataFrame, label: str, output_mode: str = "append") -> DataFrame:
    """Process all input once, exactly once per row, and return the table that was written."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
