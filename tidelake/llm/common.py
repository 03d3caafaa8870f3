"""Small helpers the operators share: private columns, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.session import scratch

ROW = "row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, carry: list[Column] | None = None, **columns: Column) -> DataFrame:
    """The input row (or only the carried columns) as one struct beside private columns.

    Whatever names the input has, none can clash with a column of an operator;
    Spark drops the struct again where a result does not ask for it.
    """
    kept = F.struct("*") if carry is None else F.struct(*carry)
    return df.select(kept.alias(ROW), *(c.alias(name) for name, c in columns.items()))


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends; lazy frames may read it until then."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back.

    Cuts lineage: a lost executor costs a file read, and what was dear to derive is
    derived once however often it is used.
    """
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    keep_until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def text_slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, so that Python objects of few rows live at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
