"""Reading and writing the daily-partitioned Parquet lake."""
