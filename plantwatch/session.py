"""Session set-up and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # temporary folder per local application
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(app: str = "plantwatch", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: UTC, and a state store that timers need."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session may do without: it gets one
    temporary folder, and no setting of the session changes."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="plantwatch-")
    return _LOCAL[context.applicationId]


def workdir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/plantwatch/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written once below the checkpoint folder and read back.

    For results that later steps read several times: computed once, safe from lost
    executors, and with a short plan. A checkpoint would do the same, but computes
    its input twice.
    """
    path = workdir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it; a missing one is fine."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that `stored` returned and that nothing reads any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/plantwatch/" in folder:
            remove(df.sparkSession, folder)
