"""Session defaults and the shared folder that every job may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "tidelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Operators never depend on these settings for right results; they only decide
    how well skewed joins split and where streaming state lives.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even where that costs one more exchange downstream
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    A temporary folder stands in only for a local session without the setting.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_DIR} must name a shared folder on a cluster")
    fallback = tempfile.mkdtemp(prefix="tidelake-")
    spark.sparkContext.setCheckpointDir(fallback)
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new, never reused folder below the shared one."""
    return f"{shared_dir(spark)}/tidelake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back; the files go with the driver.

    Unlike a checkpoint the copy is columnar, so each of its readers takes only the
    columns it needs.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The frame read back from a reliable checkpoint in the shared folder.

    For results that are costly to derive and used several times; lost executors then
    cost a file read and not the whole derivation.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
