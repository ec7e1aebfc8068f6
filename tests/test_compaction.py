"""Compaction of the archive: whole results, few files, late readings and broken runs."""

import pytest
from pyspark.sql import functions as F

from conftest import multiset
from plantwatch.functions import decode
from plantwatch.params import DEFAULTS
from plantwatch.session import workdir
from plantwatch.sources import compaction, lake

SMALL = DEFAULTS.but(archive_file_bytes=20_000)


@pytest.fixture()
def root(spark):
    return workdir(spark, "test-compaction")


@pytest.fixture(scope="module")
def readings(spark, tables):
    return decode.sensors(tables.sensor_json()).persist()


def archived(root, *parts):
    for rows in parts:
        rows.write.mode("append").partitionBy(*lake.PARTS).parquet(f"{root}/lake")


def both(spark, root, **span):
    got = compaction.read(spark, f"{root}/lake", f"{root}/compact", **span)
    machines = span.pop("machines", None)
    want = lake.read_archive(spark, f"{root}/lake", **span)
    return got, want if machines is None else want.where(F.col("machine_id").isin(machines))


def columns(readings):
    return readings.select(*lake.archive_schema().fieldNames())


def test_reads_equal_the_archive(spark, root, readings):
    rows = columns(readings)
    archived(root, rows.where("day % 2 = 0"), rows.where("day % 2 = 1").repartition(6))
    assert compaction.read(spark, f"{root}/lake", f"{root}/compact").count() == readings.count()
    taken = compaction.compact(spark, f"{root}/lake", f"{root}/compact", "2024-01-20", SMALL)
    assert taken > 0 and compaction.compact(spark, f"{root}/lake", f"{root}/compact", "2024-01-20", SMALL) == 0
    names = [r[0] for r in readings.select("machine_id").distinct().orderBy("machine_id").limit(3).collect()]
    for span in ({}, {"start": "2024-01-18 07:00:00"}, {"stop": "2024-01-10 12:00:00"},
                 {"start": "2024-01-18 07:00:00", "stop": "2024-01-21 00:00:00"}, {"machines": names},
                 {"start": "2024-01-05 00:00:00", "stop": "2024-01-06 00:00:00", "machines": names[:1]},
                 {"machines": []}, {"start": "2031-01-01 00:00:00"}):
        got, want = both(spark, root, **span)
        assert multiset(got) == multiset(want), span


def test_files_out_of_range_are_not_opened(spark, root, readings):
    archived(root, columns(readings).repartition(8))
    compaction.compact(spark, f"{root}/lake", f"{root}/compact", "2100-01-01", SMALL)
    listed = compaction.manifest(spark, f"{root}/compact")
    made = listed.where("kind = 'made'")
    assert made.agg(F.sum("rows")).first()[0] == readings.count()
    assert made.count() < listed.where("kind = 'taken'").count()
    span = {"start": "2024-01-05 00:00:00", "stop": "2024-01-07 00:00:00"}
    got, want = both(spark, root, **span)
    days = made.where("day in (DATE '2024-01-05', DATE '2024-01-06')").count()
    assert 0 < len(got.inputFiles()) <= days < made.count() and multiset(got) == multiset(want)
    whole = compaction.read(spark, f"{root}/lake", f"{root}/compact")
    assert len(whole.inputFiles()) == made.count()
    # one machine: of each day at most the files whose range holds it
    machine = readings.agg(F.min("machine_id")).first()[0]
    one, want = both(spark, root, machines=[machine])
    assert len(one.inputFiles()) == made.where(F.col("first_machine") == machine).count()
    assert multiset(one) == multiset(want)


def test_a_hot_machine_is_dealt_to_several_files(spark, root, readings):
    hot = columns(readings).where("day = 5").withColumn("machine_id", F.lit("M-1"))
    archived(root, hot)
    compaction.compact(spark, f"{root}/lake", f"{root}/compact", "2100-01-01", DEFAULTS.but(archive_file_bytes=3_000))
    got, want = both(spark, root)
    assert len(got.inputFiles()) > 1 and multiset(got) == multiset(want)


def test_late_readings_are_read_and_taken_later(spark, root, readings):
    rows = columns(readings)
    late = F.xxhash64("machine_id", "event_time") % 5 == 0
    archived(root, rows.where(~late))
    compaction.compact(spark, f"{root}/lake", f"{root}/compact", "2024-01-20", SMALL)
    archived(root, rows.where(late))
    span = {"start": "2024-01-08 00:00:00", "stop": "2024-01-22 00:00:00"}
    got, want = both(spark, root, **span)
    assert multiset(got) == multiset(want)
    assert compaction.compact(spark, f"{root}/lake", f"{root}/compact", "2024-01-25", SMALL) > 0
    got, want = both(spark, root, **span)
    assert multiset(got) == multiset(want)
    assert compaction.runs(spark, f"{root}/compact") == [0, 1]
    assert all("/compact/" in f for f in got.inputFiles())


def test_a_broken_run_leaves_no_trace(spark, root, readings):
    rows = columns(readings)
    archived(root, rows)
    # files of a run that ended before its manifest
    rows.limit(50).write.parquet(f"{root}/compact/data/run=0/event_date=2024-01-02")
    rows.limit(9).select(F.lit("made").alias("kind")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/compact/manifest/run=0")
    got, want = both(spark, root)
    assert multiset(got) == multiset(want)
    assert compaction.compact(spark, f"{root}/lake", f"{root}/compact", "2024-02-01", SMALL) > 0
    assert compaction.runs(spark, f"{root}/compact") == [0]
    got, want = both(spark, root)
    assert multiset(got) == multiset(want)


def test_an_archive_without_rows(spark, root, readings):
    archived(root, columns(readings).limit(0))
    assert compaction.compact(spark, f"{root}/lake", f"{root}/compact", "2100-01-01") == 0
    assert compaction.read(spark, f"{root}/lake", f"{root}/compact", "2024-01-01 00:00:00").count() == 0


def test_tasks_sort_a_bounded_number_of_rows(spark, root, readings, monkeypatch):
    """Small files hold many rows: what one task sorts doesn't grow with them."""
    day = columns(readings).where("day = 5").withColumn("machine_id", F.lit("M-1"))
    archived(root, day)
    monkeypatch.setattr(compaction, "TASK_ROWS", 4)
    compaction.compact(spark, f"{root}/lake", f"{root}/compact", "2100-01-01")
    got, want = both(spark, root)
    assert len(got.inputFiles()) > 1 and multiset(got) == multiset(want)
