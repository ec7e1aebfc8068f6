"""Bus topics, archive, measurements and state tables; replays change nothing."""

import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import multiset
from plantwatch import schemas
from plantwatch.functions import decode
from plantwatch.operators import features, lifecycle, rollups
from plantwatch.params import DEFAULTS
from plantwatch.session import workdir
from plantwatch.sources import lake, records
from plantwatch.sources.bus import Bus
from plantwatch.streaming import jobs


@pytest.fixture()
def root(spark):
    return workdir(spark, "test")


@pytest.fixture()
def bus(spark, root):
    return Bus(spark, "parquet", f"{root}/bus")


def test_every_outgoing_record(tables, spark):
    readings = tables.readings()
    anomalies = rollups.energy_anomalies(readings)
    now = F.lit("2024-02-01").cast("timestamp")
    alerts = features.alert_records(features.changed_class(features.rule_scored(readings)))
    held = tables.held()
    status = tables.status_events().withColumn("details", F.lit("x"))
    active = lifecycle.active_alerts(lifecycle.event_flow(
        tables.alert_events(), tables.maintenance_events()), "2024-01-31 00:00:00",
        DEFAULTS.but(pause_seconds=86400))
    for df, schema in [
            (records.energy_alerts(anomalies, now), schemas.ENERGY_ALERT),
            (records.ml_alerts(alerts), schemas.ML_ALERT),
            (records.assignments(held), schemas.ASSIGNMENT),
            (records.statuses(status), schemas.MACHINE_STATUS),
            (records.failure_alerts(rollups.predictions(readings)), schemas.FAILURE_ALERT),
            (records.machine_commands(active), schemas.MACHINE_COMMAND)]:
        rows = df.limit(5).collect()
        assert rows
        for r in rows:
            message = json.loads(r.value)
            assert set(schema.fieldNames()) <= set(message) and r.key == message["machine_id"]
    note = records.system_alerts(spark.createDataFrame([("W", 1)], "level string, n int"), now)
    assert json.loads(note.first().value) == {
        "level": "W", "n": 1, "timestamp": "2024-02-01T00:00:00.000000Z"}


def test_topics_round_trip(spark, bus, root, tables):
    """Every topic is read as a stream and decoded; new files only after the checkpoint."""
    orders = spark.createDataFrame([(b'{"task_id":"a"}',), (b'{"id":"b"}',)], "value binary")
    bus.publish(orders, "orders", 0)
    bus.publish(spark.createDataFrame(
        [(b'{"machine_id":"M","action":"PAUSE","timestamp":"2024-01-01T00:00:00Z"}',)],
        "value binary"), "ml_alerts", 0)
    bus.publish(spark.createDataFrame(
        [(b'{"machine_id":"M","action":"REPARER"}',), (b'{"action":"REPARER"}',)],
        "value binary"), "maintenance", 0)
    bus.publish(tables.sensor_json(), "sensors", 0)
    bus.publish(tables.sensor_json(), "sensors", 0)  # a replay replaces its epoch

    def drain(df, name):
        q = (df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.table(name)
    assert {r.task_id for r in drain(bus.orders(), "t_orders").collect()} == {"a", "b"}
    assert drain(bus.ml_alerts(), "t_alerts").first().event_time.year == 2024
    assert drain(bus.maintenance(), "t_maint").count() == 1
    assert drain(bus.sensors(), "t_sensors").count() == tables.readings().count()


def test_archive_prunes_days(spark, root, tables):
    lake.archive(decode.sensors(tables.sensor_json()), f"{root}/lake")
    df = lake.read_archive(spark, f"{root}/lake", "2024-01-05 12:00:00", "2024-01-07 00:00:00")
    want = tables.readings().where(
        "event_time >= TIMESTAMP_NTZ '2024-01-05 12:00:00' AND "
        "event_time < TIMESTAMP_NTZ '2024-01-07 00:00:00'").count()
    assert df.count() == want > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "make_date(year" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_measurement_replay(spark, root, tables):
    rows = rollups.energy_anomalies(tables.readings())
    lake.write_measurement(rows, root, "anomalies_energie", 1)
    lake.write_measurement(rows.limit(10), root, "anomalies_energie", 2)
    lake.write_measurement(rows, root, "anomalies_energie", 1)
    back = lake.read_measurement(spark, root, "anomalies_energie")
    assert back.count() == rows.count() + 10
    recent = lake.measurement_lookback(back.where("epoch_id = 1"), "2024-01-10 00:00:00", "2 days")
    assert recent.count() == rows.where(
        "event_time > TIMESTAMP_NTZ '2024-01-08' AND event_time <= TIMESTAMP_NTZ '2024-01-10'"
    ).count()


def test_state_table(spark, root):
    schema = spark.range(1).schema
    t = lake.StateTable(spark, root, schema)
    assert t.before(0).count() == 0
    with pytest.raises(RuntimeError, match="no state of epoch 4"):
        t.before(5)
    for epoch in range(4):
        n = t.before(epoch).count()
        t.save(spark.range(n + 1), epoch)
        t.save(spark.range(n + 1), epoch)  # a replay reads what the first run read
    assert t.after(3).count() == 4 and t.before(3).count() == 3


def test_delta_table(spark, root):
    """Random changes, every epoch run twice, against a plain dictionary."""
    rng, want, gone = random.Random(5), {}, []
    t = lake.DeltaTable(spark, root, spark.createDataFrame([], "k string, v long").schema, "k", 3)
    assert t.before(0).count() == 0
    with pytest.raises(RuntimeError, match="no state of epoch 4"):
        t.before(5)
    for epoch in range(11):
        assert dict(map(tuple, t.before(epoch).collect())) == want
        added = {f"k{epoch}-{i}": epoch for i in range(rng.randint(0, 3))}
        added |= {k: epoch for k in rng.sample(gone, min(1, len(gone)))}  # comes back
        removed = rng.sample(sorted(want | added), min(2, len(want | added)))
        for _ in range(2):
            t.save(spark.createDataFrame(list(added.items()), t.schema),
                   spark.createDataFrame([(k,) for k in removed], "k string"), epoch)
        before, want = want, {k: v for k, v in (want | added).items() if k not in removed}
        gone = [k for k in {*gone, *removed} if k not in want]
        # neither does a replay find another input, nor are whole tables written in between
        assert dict(map(tuple, t.before(epoch).collect())) == before
        if epoch % 3:
            new = t._read("added", [epoch], t.schema).drop("_epoch")
            assert dict(map(tuple, new.collect())) == {k: v for k, v in added.items() if k in want}
    assert dict(map(tuple, t.after(10).collect())) == want
    assert sorted(os.listdir(f"{root}/whole")) == ["epoch=6", "epoch=9"]
    assert sorted(os.listdir(f"{root}/added")) == ["epoch=10", "epoch=7", "epoch=8", "epoch=9"]


def test_feature_stream_over_epochs(spark, root, tables):
    """Many small epochs, one of them replayed, give the rows of one batch."""
    readings = tables.readings().select(*jobs.KEPT).cache()
    state = jobs.FeatureState(spark, f"{root}/state", readings.schema)
    edges = ["2024-01-01", "2024-01-04", "2024-01-04 12:00:00", "2024-01-20", "2024-02-01"]
    got = []
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        part = readings.where(f"event_time >= TIMESTAMP_NTZ '{a}' AND "
                              f"event_time < TIMESTAMP_NTZ '{b}'")
        if n == 2:
            state.epoch(part, n).collect()
        got += state.epoch(part, n).collect()
    fields = ["machine_id", "seq", *schemas.FEATURES, "class_id", "previous_class", "is_alert"]
    want = {(r.machine_id, r.seq): r for r in features.feature_alerts(readings).collect()}
    assert len(got) == len(want)
    for r in got:
        for f in fields:
            assert r[f] == pytest.approx(want[r.machine_id, r.seq][f], abs=1e-6) \
                if isinstance(r[f], float) else r[f] == want[r.machine_id, r.seq][f], f


def test_running_jobs(spark, root, bus, tables):
    """Hot state, energy, predictions and alerts off one stream of readings."""
    stream = tables.readings(tables.stream("events"))
    counts = {}

    def note(epoch_id, seen):
        counts.update(seen)
    once = {"availableNow": True, "on_count": note}
    jobs.hot_state(stream, f"{root}/serving", f"{root}/cp1", **once).awaitTermination()
    jobs.energy(stream, f"{root}/serving", bus, f"{root}/cp2", **once).awaitTermination()
    jobs.predict(stream, f"{root}/serving", bus, f"{root}/cp3", **once).awaitTermination()
    state = jobs.FeatureState(spark, f"{root}/state", stream.select(*jobs.KEPT).schema)
    jobs.ml_alerts(stream, state, bus, f"{root}/cp4", **once).awaitTermination()
    readings = tables.readings()
    n = readings.count()
    assert counts["archived"] == counts["predictions"] == counts["messages"] == n
    assert counts["anomalies"] == rollups.energy_anomalies(readings).count()
    hot = lake.read_measurement(spark, f"{root}/serving", "etat_machines")
    assert hot.count() == n and hot.where("etat IS NULL").count() == 0
    assert lake.read_measurement(spark, f"{root}/serving", "predictions").count() == n
    anomalies = rollups.energy_anomalies(readings).count()
    assert bus.table("energy_alerts").count() == anomalies
    alerts = features.changed_class(features.rule_scored(readings)).where("is_alert").count()
    assert counts["alerts"] == alerts
    assert bus.table("ml_alerts").count() == alerts
    high = rollups.predictions(readings).where("probabilite_panne > 0.7").count()
    assert bus.table("failure_alerts").count() == high


def test_absent_measurements_are_empty(spark, root):
    assert lake.read_measurement(spark, root, "etat_machines").count() == 0
    empty = spark.createDataFrame([], "machine_id string, probabilite_panne double, event_time timestamp")
    lake.write_measurement(empty, root, "predictions", 0)
    rows = lake.read_measurement(spark, root, "predictions")
    assert rows.count() == 0 and {"event_date", "epoch_id", "probabilite_panne"} <= set(rows.columns)


def test_a_published_epoch_is_not_written_again(spark, bus, root):
    record = spark.createDataFrame([(b"x",)], "value binary")
    for _ in range(2):
        bus.publish(record, "commands", 3)
    files = bus.table("commands").inputFiles()
    bus.publish(record, "commands", 3)
    assert bus.table("commands").inputFiles() == files and bus.table("commands").count() == 1


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from plantwatch import session
    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", applicationId="x"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(far)


def test_crash_between_two_sinks(spark, root, tables):
    """The measurement of an epoch is written, its alerts are not; the resumed job ends in equal tables."""
    failed = []

    class Broken(Bus):
        def publish(self, df, name, epoch_id=None):
            if epoch_id == 1 and not failed:
                failed.append(epoch_id)
                raise RuntimeError("the broker is away")
            super().publish(df, name, epoch_id)
    work = f"{root}/crash"
    readings = tables.readings(tables.replayed("events", "ts", epochs=3))
    broken = Broken(spark, "parquet", f"{work}/bus")
    for again in (False, True):
        query = jobs.energy(readings, f"{work}/serving", broken, f"{work}/checkpoint", availableNow=True)
        if again:
            query.awaitTermination()
        else:
            with pytest.raises(StreamingQueryException):
                query.awaitTermination()
    want = rollups.energy_anomalies(tables.readings())
    got = lake.read_measurement(spark, f"{work}/serving", "anomalies_energie")
    assert failed and multiset(got.select(*want.columns)) == multiset(want)
    assert broken.table("energy_alerts").count() == want.count()


def test_replayed_epochs_are_cuts_of_equal_files(spark, root, tables, tmp_path):
    """An epoch reads one cut, by as many tasks as there are cores; a small table has one file per cut."""
    many = spark.sparkContext.defaultParallelism
    for name, rows in (("whole", tables.raw("events")), ("few", tables.raw("events").where("event_id % 200 = 0"))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        seen = {}

        def epoch(batch, epoch_id):
            seen[epoch_id] = tuple(batch.withColumn("file", F.input_file_name()).agg(
                F.count_distinct("file"), F.min("ts"), F.max("ts")).first())
        stream = type(tables)(spark, f"{tmp_path}/{name}").replayed("events", "ts")
        stream.writeStream.foreachBatch(epoch).option("checkpointLocation", f"{root}/{name}").trigger(
            availableNow=True).start().awaitTermination()
        assert len(seen) == 6 and {s[0] for s in seen.values()} <= ({many} if name == "whole" else {0, 1})
        ends = [(a, b) for _, a, b in (seen[k] for k in sorted(seen)) if a]
        assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


def test_rollups_are_summed_before_measures_become_rows(spark):
    """Absent values count nowhere, and the sums of a window are one row per machine in the shuffle."""
    df = spark.sql("""SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:01:00', 1D, CAST(NULL AS DOUBLE)),
        ('a', TIMESTAMP '2024-01-01 00:09:00', 3D, NULL), ('a', TIMESTAMP '2024-01-01 00:11:00', NULL, 5D) t(machine_id, event_time, x, y)""")
    out = rollups.partials(df, ["x", "y"], "10 minutes")
    got = {(r.measure, r.event_time.minute): (r.total, r.n, r.peak) for r in out.collect()}
    assert got == {("x", 0): (4.0, 2, 3.0), ("y", 10): (5.0, 1, 5.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")  # parents are printed first
