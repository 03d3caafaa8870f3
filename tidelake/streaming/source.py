"""File streams over a partitioned lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidelake.sources.lake import CANONICAL


def read_lake_stream(
    spark: SparkSession, base: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """New canonical files of every day, with ``dt`` from the path."""
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields if f.name != "dt"]
    with_dt = T.StructType([*fields, T.StructField("dt", T.DateType(), True)])
    reader = spark.readStream.schema(with_dt).option("basePath", base)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{base}/dt=*/{CANONICAL}")


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run a stream over everything that has arrived, then stop."""
    running = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    running.awaitTermination()
