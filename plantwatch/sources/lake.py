"""The date-partitioned archive and the serving measurements, both Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from plantwatch import schemas
from plantwatch.functions.times import instant
from plantwatch.params import DEFAULTS, Params
from plantwatch.session import remove

PARTS = ["year", "month", "day"]


# ---- archive ----------------------------------------------------------------

def archive_schema() -> T.StructType:
    return T.StructType([*schemas.SENSOR.fields, T.StructField("event_time", T.TimestampType()),
                         *[T.StructField(c, T.IntegerType()) for c in PARTS]])


def archive(readings: DataFrame, path: str) -> None:
    """Append a bounded table. One shuffle by day keeps the file count down; its
    partitions are balanced by size, so a heavy day is split over several files."""
    rows = readings.select(*archive_schema().fieldNames())
    (rows.hint("rebalance", *PARTS).write.mode("append").partitionBy(*PARTS).parquet(path))


def archive_stream(readings: DataFrame, path: str, checkpoint: str, p: Params = DEFAULTS,
                   **trigger) -> StreamingQuery:
    """The file sink commits each batch once, also when it is replayed."""
    rows = readings.select(*archive_schema().fieldNames())
    return (rows.writeStream.format("parquet").partitionBy(*PARTS)
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": p.trigger})).start())


def read_archive(spark: SparkSession, path: str, start=None, stop=None) -> DataFrame:
    """Archived readings with start <= event_time < stop.

    The same bounds are put on the partition columns, so other days are not listed
    as input at all.
    """
    df = spark.read.schema(archive_schema()).parquet(path)
    day = F.make_date("year", "month", "day")
    if start is not None:
        at = instant(df, "event_time", start)
        df = df.where((day >= at.cast("date")) & (F.col("event_time") >= at))
    if stop is not None:
        at = instant(df, "event_time", stop)
        df = df.where((day <= at.cast("date")) & (F.col("event_time") < at))
    return df


# ---- serving measurements -----------------------------------------------------

def write_measurement(df: DataFrame, root: str, name: str, epoch_id: int, by_day: bool = False) -> None:
    """Rows of one epoch, with event and ingest time.

    An epoch replaces only its own partitions, so a replay changes nothing. `by_day` is for
    epochs that span many days: one shuffle, balanced by size, spares each task a file per day.
    """
    out = (df.select(*schemas.MEASUREMENTS[name], "event_time")
           .withColumns({"ingest_time": F.current_timestamp(),
                         "event_date": F.to_date("event_time"), "epoch_id": F.lit(epoch_id)}))
    if by_day:
        out = out.hint("rebalance", "event_date")
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date", "epoch_id").parquet(f"{root}/{name}"))


def measurement_schema(name: str) -> T.StructType:
    columns = [T.StructField(c, schemas.MEASUREMENT_TYPES.get(c, T.StringType()))
               for c in schemas.MEASUREMENTS[name]]
    return T.StructType([*columns, T.StructField("event_time", T.TimestampType()),
                         T.StructField("ingest_time", T.TimestampType()),
                         T.StructField("event_date", T.DateType()),
                         T.StructField("epoch_id", T.LongType())])


def read_measurement(spark: SparkSession, root: str, name: str, upto: int | None = None) -> DataFrame:
    """A measurement as written so far, or up to an epoch; one never written, or without rows, is empty."""
    try:
        rows = spark.read.parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        rows = spark.createDataFrame([], measurement_schema(name))
    return rows if upto is None else rows.where(F.col("epoch_id") <= upto)


def measurement_lookback(df: DataFrame, as_of, length: str) -> DataFrame:
    """Rows of the last `length` before `as_of`; whole days are pruned."""
    now = instant(df, "event_time", as_of)
    start = now - F.expr(f"INTERVAL {length}")
    return df.where((F.col("event_date") >= start.cast("date"))
                    & (F.col("event_date") <= now.cast("date"))
                    & (F.col("event_time") > start) & (F.col("event_time") <= now))


# ---- state tables -------------------------------------------------------------

class StateTable:
    """A table that epoch n reads as epoch n-1 left it, and replaces.

    Two folders take turns, so a replay of epoch n still finds the input of its
    first run, and old states do not pile up.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _slot(self, epoch_id: int) -> str:
        return f"{self.path}/slot={epoch_id % 2}"

    def before(self, epoch_id: int) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("_epoch", T.LongType())])
        if epoch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        try:
            df = self.spark.read.schema(stored).parquet(self._slot(epoch_id - 1))
        except AnalysisException as error:
            raise RuntimeError(f"{self.path} has no state of epoch {epoch_id - 1}") from error
        return df.where(F.col("_epoch") == epoch_id - 1).drop("_epoch")

    def after(self, epoch_id: int) -> DataFrame:
        return self.before(epoch_id + 1)

    def last(self) -> int:
        """The newest epoch saved; -1 before the first. Also right while a slot is being replaced."""
        try:
            rows = (self.spark.read.schema("_epoch long").option("ignoreMissingFiles", True)
                    .parquet(self.path))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1
        newest = rows.agg(F.max("_epoch")).first()[0]
        return -1 if newest is None else newest

    def save(self, df: DataFrame, epoch_id: int) -> None:
        (df.select(*self.schema.fieldNames()).withColumn("_epoch", F.lit(epoch_id).cast("long"))
         .write.mode("overwrite").parquet(self._slot(epoch_id)))


class DeltaTable:
    """A table that epoch n reads as epoch n-1 left it, for one that is large next to its changes.

    An epoch writes the rows it adds and the keys it removes, each in a folder of its own,
    so a replay finds its input and replaces its output. Every `every`th epoch writes the
    whole table as well: no read meets more changes than that, and what lies before the
    last whole copy but one is deleted. A key that is in the table isn't added again
    before it is removed; one both added and removed in an epoch is gone.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str,
                 every: int):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.every = max(1, every)

    def _folder(self, kind: str, epoch_id: int) -> str:
        return f"{self.path}/{kind}/epoch={epoch_id}"

    def _read(self, kind: str, epochs, columns) -> DataFrame:
        stored = T.StructType([*columns, T.StructField("_epoch", T.LongType())])
        folders = [self._folder(kind, n) for n in epochs]
        if not folders:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*folders)

    def _write(self, df: DataFrame, kind: str, epoch_id: int) -> None:
        (df.withColumn("_epoch", F.lit(epoch_id).cast("long"))
         .write.mode("overwrite").parquet(self._folder(kind, epoch_id)))

    def before(self, epoch_id: int) -> DataFrame:
        if epoch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        last = epoch_id - 1
        whole = last - last % self.every
        since = range(whole + 1, epoch_id)
        try:
            rows = self._read("whole", [whole], self.schema).unionByName(
                self._read("added", since, self.schema))
            gone = self._read("removed", since, [self.schema[self.key]])
        except AnalysisException as error:
            raise RuntimeError(f"{self.path} has no state of epoch {last}") from error
        if not since:
            return rows.drop("_epoch")
        gone = gone.groupBy(F.col(self.key).alias("_key")).agg(F.max("_epoch").alias("_gone"))
        return rows.join(gone, (F.col(self.key) == F.col("_key"))
                         & (F.col("_epoch") <= F.col("_gone")), "left_anti").drop("_epoch")

    def after(self, epoch_id: int) -> DataFrame:
        return self.before(epoch_id + 1)

    def save(self, added: DataFrame, removed: DataFrame, epoch_id: int) -> None:
        """`removed` has the key column; of `added`, rows whose key is in it aren't kept."""
        self.add(added.join(removed.select(self.key), self.key, "left_anti"), epoch_id)
        self.remove(removed, epoch_id)

    def add(self, added: DataFrame, epoch_id: int) -> DataFrame:
        """The epoch's rows, written and handed back, for what is removed to depend on them;
        `remove` must follow. Readers pass over rows whose key is removed in the same epoch."""
        self._write(added.select(*self.schema.fieldNames()), "added", epoch_id)
        return self._read("added", [epoch_id], self.schema).drop("_epoch")

    def remove(self, removed: DataFrame, epoch_id: int) -> None:
        names, keys = self.schema.fieldNames(), removed.select(self.key)
        self._write(keys, "removed", epoch_id)
        if epoch_id % self.every:
            return
        rows = self.before(epoch_id).unionByName(
            self._read("added", [epoch_id], self.schema).drop("_epoch"))
        self._write(rows.join(keys, self.key, "left_anti").select(*names), "whole", epoch_id)
        # A replay of this epoch reads from the whole copy before it.
        old = epoch_id - self.every
        remove(self.spark, self._folder("whole", old - self.every))
        for n in range(max(0, old - self.every), old + 1):
            for kind in ("added", "removed"):
                remove(self.spark, self._folder(kind, n))


def settler(root: str, epoch_id: int):
    """Stores a step of an epoch below `root` and hands back the stored rows."""
    def settle(df: DataFrame, name: str) -> DataFrame:
        table = StateTable(df.sparkSession, f"{root}/{name}", df.schema)
        table.save(df, epoch_id)
        return table.after(epoch_id)
    return settle
