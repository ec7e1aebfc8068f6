"""The jobs as a user starts them, chained over file topics."""

import json

import pytest
from pyspark.sql import functions as F

from plantwatch import run
from plantwatch.session import workdir
from plantwatch.sources import compaction, lake
from plantwatch.sources.bus import Bus
from plantwatch.streaming import jobs


@pytest.fixture(scope="module")
def work(spark):
    return workdir(spark, "test-run")


def publish(spark, bus, topic, messages, epoch=0):
    bus.publish(spark.createDataFrame([(json.dumps(m).encode(),) for m in messages],
                                      "value binary"), topic, epoch)


def test_plant(spark, work):
    topics = f"{work}/bus"
    bus = Bus(spark, "parquet", topics)

    def stamp(s):
        return f"2024-01-01T10:{s // 60:02d}:{s % 60:02d}Z"
    readings = [{"machine_id": f"POMPE-{i}", "timestamp": stamp(10 * t), "temperature": 60.0 + 8 * i,
                 "charge_travail": 20.0, "consommation_electrique": 128.0, "vibration": 1.0,
                 "pression": 5.0} for i in range(1, 6) for t in range(3)]
    publish(spark, bus, "sensors", readings)

    def job(name):
        run.main([name, "--work", work, "--bus", f"{topics}", "--bus-format", "parquet",
                  "--once"], spark)

    for name in ("archive", "hot-state", "energy", "predict", "alerts"):
        job(name)
    assert lake.read_archive(spark, f"{work}/archive", "2024-01-01 00:00:00",
                             "2024-01-02 00:00:00").count() == 15
    run.main(["compact", "--work", work], spark)
    compacted = compaction.read(spark, f"{work}/archive", f"{work}/archive-compact")
    assert compacted.count() == 15 and all("/archive-compact/" in f for f in compacted.inputFiles())
    assert bus.table("energy_alerts").count() == 15
    alerts = [json.loads(r.value) for r in bus.table("ml_alerts").collect()]
    assert sorted((a["machine_id"], a["action"]) for a in alerts) == [
        ("POMPE-2", "PAUSE"), ("POMPE-3", "PAUSE"), ("POMPE-4", "ARRETER"),
        ("POMPE-5", "ARRETER")]
    publish(spark, bus, "orders", [
        {"task_id": "t1", "product": "x", "duration_minutes": 5, "timestamp": stamp(30)},
        {"tache_id": "t2", "quantite": 100, "timestamp": stamp(30)},
        {"product": "nameless", "timestamp": stamp(30)}])
    publish(spark, bus, "maintenance", [
        {"action": "REPARER", "machine_id": "POMPE-2", "timestamp": stamp(40)},
        {"action": "FORCER_ARRET", "machine_id": "POMPE-3", "timestamp": stamp(40)}])
    job("orchestrate")
    given = {r.machine_id: r.task_id for r in lake.read_measurement(
        spark, f"{work}/serving", "assignations").collect()}
    assert set(given) == {"POMPE-1", "POMPE-2"} and set(given.values()) == {"t1", "t2"}
    status = {r.machine_id: r.statut for r in lake.read_measurement(
        spark, f"{work}/serving", "statut_machines").collect()}
    assert status == {"POMPE-1": "ASSIGNEE", "POMPE-2": "ASSIGNEE", "POMPE-3": "ARRET",
                      "POMPE-4": "PAUSE", "POMPE-5": "PAUSE"}
    kpi = lake.read_measurement(spark, f"{work}/serving", "resource_manager_stats").first()
    assert (kpi.total, kpi.in_queue, kpi.repairs) == (2, 0, 1)


def test_counts_of_an_empty_epoch(spark):
    rows, seen = jobs.counted(spark.createDataFrame([], "x int"), n=F.count(F.lit(1)))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get.get("n", 0) == 0
