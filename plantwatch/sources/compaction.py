"""Compaction of the archive: few files in order of machine and time, and statistics per file.

The archive's sink writes a file per task and epoch. `compact` copies the closed days among the
files it hasn't taken yet into a table of its own, day by day in order of machine and time, so
each of its files holds a narrow range of both. The archive itself stays as its sink wrote it.
A manifest per run names the files made, with their ranges, and the files taken; it counts from
the moment its job has committed. A run that broke off before leaves no trace: the next one has
the same number and replaces its files. One run at a time.

`read` opens only files whose ranges meet what is asked for, and the archive's files that no
run has taken, which are those of open days and of late readings.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantwatch.functions.times import instant
from plantwatch.params import DEFAULTS, Params
from plantwatch.session import forget, stored
from plantwatch.sources.lake import PARTS, archive_schema

MANIFEST = T.StructType([
    T.StructField("kind", T.StringType()),   # "taken" from the archive, or "made"
    T.StructField("file", T.StringType()),   # below the archive's folder, or the table's
    T.StructField("day", T.DateType()), T.StructField("rows", T.LongType()),
    T.StructField("first_time", T.TimestampType()), T.StructField("last_time", T.TimestampType()),
    T.StructField("first_machine", T.StringType()), T.StructField("last_machine", T.StringType())])
ORDER = ["event_date", "machine_id", "event_time"]
TASK_ROWS = 1 << 20  # rows that one task sorts, about; small files hold many


def runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs whose manifest has committed."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/run=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(int(s.getPath().getParent().getName()[4:]) for s in found or ())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    folders = [f"{path}/manifest/run={n}" for n in runs(spark, path)]
    if not folders:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(*folders)


def untaken(spark: SparkSession, archive: str, listed: DataFrame) -> DataFrame:
    """(file, bytes, day) of the archive's files that no run has taken; none is opened for it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(archive)
    within = "/".join(f"{c}=[^/]+" for c in PARTS)
    date = F.make_date(*[F.regexp_extract("file", rf"{c}=(\d+)/", 1).try_cast("int") for c in PARTS])
    found = found.select(F.regexp_extract("path", rf"({within}/[^/]+)$", 1).alias("file"),
                         F.col("length").alias("bytes")).withColumn("day", date)
    return found.join(listed.where("kind = 'taken'").select("file"), "file", "left_anti")


def _archived(spark: SparkSession, archive: str, files: list[str]) -> DataFrame:
    return (spark.read.schema(archive_schema()).option("basePath", archive)
            .parquet(*[f"{archive}/{f}" for f in files]))


def compact(spark: SparkSession, archive: str, path: str, before, p: Params = DEFAULTS) -> int:
    """Take the archive's files of days before `before`; returns how many. None: nothing is written.

    What is handled on the driver are names of files that came since the last run.
    """
    new = untaken(spark, archive, manifest(spark, path))
    new = stored(new.where(F.col("day") < F.lit(str(before)).cast("date")), "compaction")
    files = [r.file for r in new.select("file").collect()]
    if files:
        number = max(runs(spark, path), default=-1) + 1
        folder = f"data/run={number}"
        rows = _archived(spark, archive, files).withColumn("event_date", F.make_date(*PARTS))
        parts = math.ceil(max(new.agg(F.sum("bytes")).first()[0] / p.archive_file_bytes, rows.count() / TASK_ROWS))
        # By range, so that a day or machine with most rows is dealt to several files.
        (rows.repartitionByRange(max(1, parts), *ORDER).sortWithinPartitions(*ORDER)
         .write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/{folder}"))
        made = (spark.read.schema(archive_schema().add("event_date", "date")).parquet(f"{path}/{folder}")
                .groupBy(F.col("event_date").alias("day"), F.col("_metadata.file_name").alias("name"))
                .agg(F.count("*").alias("rows"), F.min("event_time").alias("first_time"),
                     F.max("event_time").alias("last_time"), F.min("machine_id").alias("first_machine"),
                     F.max("machine_id").alias("last_machine"))
                .withColumn("file", F.concat(F.lit(f"{folder}/event_date="), F.col("day").cast("string"),
                                             F.lit("/"), "name")))
        rows = made.withColumn("kind", F.lit("made")).unionByName(
            new.withColumn("kind", F.lit("taken")), allowMissingColumns=True)
        (rows.select(*MANIFEST.fieldNames()).write.mode("overwrite")
         .parquet(f"{path}/manifest/run={number}"))
    forget(new)
    return len(files)


def read(spark: SparkSession, archive: str, path: str, start=None, stop=None,
         machines: list[str] | None = None) -> DataFrame:
    """Archived readings with start <= event_time < stop, of the machines named or of all."""
    listed = manifest(spark, path)
    made, new = listed.where("kind = 'made'"), untaken(spark, archive, listed)
    rows = []
    if start is not None:
        at = instant(made, "last_time", start)
        made, new = made.where(F.col("last_time") >= at), new.where(F.col("day") >= at.cast("date"))
        rows.append(F.col("event_time") >= at)
    if stop is not None:
        at = instant(made, "first_time", stop)
        made, new = made.where(F.col("first_time") < at), new.where(F.col("day") <= at.cast("date"))
        rows.append(F.col("event_time") < at)
    if machines is not None:
        wanted = F.array(*map(F.lit, machines)).cast("array<string>")
        made = made.where(F.exists(wanted, lambda m: m.between(F.col("first_machine"), F.col("last_machine"))))
        rows.append(F.col("machine_id").isin(machines))
    schema, folders = archive_schema(), [f"{path}/{r.file}" for r in made.select("file").collect()]
    late = [r.file for r in new.select("file").collect()]
    parts = ([spark.read.schema(schema).parquet(*folders)] if folders else []) + (
        [_archived(spark, archive, late)] if late else [])
    df = parts[0] if parts else spark.createDataFrame([], schema)
    for other in parts[1:]:
        df = df.unionByName(other)
    for condition in rows:
        df = df.where(condition)
    return df.select(*schema.fieldNames())
