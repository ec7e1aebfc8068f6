"""Alert lifecycle against a plain state machine, in batch and as a stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from plantwatch import run
from plantwatch.functions import decode
from plantwatch.operators import lifecycle
from plantwatch.params import DEFAULTS
from plantwatch.session import workdir
from plantwatch.sources import lake
from plantwatch.sources.bus import Bus
from plantwatch.streaming import lifecycle as live

P = DEFAULTS.but(pause_seconds=600)
T0 = datetime(2024, 1, 1)
SCHEMA = "machine_id string, event_time timestamp, seq long, source string, action string"


def by_hand(events, end=None, pause=600):
    """Transitions of one machine's events, which are (seconds, source, action)."""
    state, since, out = None, None, []

    def lapse(t):
        nonlocal state
        if state == "PAUSE" and t - since > pause:
            out.append(("PAUSE_EXPIRED", since + pause))
            state = None
    for t, source, action in events:
        if source == "ml" and action in ("PAUSE", "ARRETER"):
            lapse(t)
            if state != "ARRET":
                out.append(("PAUSE_RESTARTED" if state else "PAUSE_STARTED", t))
                state, since = "PAUSE", t
        elif (source, action) == ("maintenance", "FORCER_ARRET"):
            lapse(t)
            if state != "ARRET":
                out.append(("STOPPED", t))
                state = "ARRET"
        elif (source, action) == ("maintenance", "REPARER"):
            lapse(t)
            if state:
                out.append(("REPAIRED", t))
            state = None
    if end is not None:
        lapse(end)
    return sorted(out)


SEQUENCES = {
    "restart": [(0, "ml", "PAUSE"), (500, "ml", "PAUSE"), (1100, "ml", "PAUSE")],
    "expiry on the line": [(0, "ml", "PAUSE"), (600, "ml", "PAUSE"), (1201, "ml", "PAUSE")],
    "stop holds": [(0, "maintenance", "FORCER_ARRET"), (10, "ml", "PAUSE"),
                   (900, "maintenance", "FORCER_ARRET"), (1000, "maintenance", "REPARER"),
                   (1001, "ml", "ARRETER")],
    "stop during pause": [(0, "ml", "PAUSE"), (5, "maintenance", "FORCER_ARRET"),
                          (2000, "maintenance", "REPARER")],
    "repair without alert": [(0, "maintenance", "REPARER"), (5, "ml", "PAUSE"),
                             (700, "maintenance", "REPARER")],
    "unknown": [(0, "ml", "CONTINUER"), (1, "maintenance", "DANSER"), (2, "ml", "REPARER")],
    "same time": [(0, "ml", "PAUSE"), (0, "maintenance", "REPARER"), (0, "ml", "PAUSE")],
}


def flow_of(spark, sequences):
    rows = [(m, T0 + timedelta(seconds=t), i, s, a)
            for m, events in sequences.items() for i, (t, s, a) in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df, machine):
    return sorted((r.transition, (r.event_time - T0).total_seconds())
                  for r in df.collect() if r.machine_id == machine)


def test_batch(spark):
    end = 5000
    df = lifecycle.transitions(flow_of(spark, SEQUENCES), T0 + timedelta(seconds=end), P).cache()
    for machine, events in SEQUENCES.items():
        assert found(df, machine) == by_hand(events, end), machine


def test_batch_on_given_events(spark, tables):
    p = DEFAULTS.but(pause_seconds=6 * 3600)
    flow = lifecycle.event_flow(tables.alert_events(), tables.maintenance_events())
    start = datetime(2024, 1, 1)
    per = {}
    for r in flow.orderBy("machine_id", "event_time", "seq").collect():
        per.setdefault(r.machine_id, []).append(
            ((r.event_time - start).total_seconds(), r.source, r.action))
    got = {}
    for r in lifecycle.transitions(flow, "2024-01-31 00:00:00", p).collect():
        got.setdefault(r.machine_id, []).append(
            (r.transition, (r.event_time - start).total_seconds()))
    want = {m: by_hand(e, 30 * 86400, 6 * 3600) for m, e in per.items()}
    def whole(rows):
        return sorted((name, round(t, 3)) for name, t in rows)
    assert {m: whole(v) for m, v in got.items()} == {m: whole(v) for m, v in want.items() if v}


def test_state_and_early_return(spark):
    flow = flow_of(spark, {
        "a": [(0, "ml", "PAUSE"), (550, "ml", "PAUSE")],
        "b": [(100, "ml", "PAUSE")], "c": [(50, "maintenance", "FORCER_ARRET")],
        "d": [(0, "ml", "PAUSE")], "e": [(0, "ml", "PAUSE"), (690, "ml", "PAUSE")]})
    now = T0 + timedelta(seconds=699)
    active = lifecycle.active_alerts(flow, now, P)
    assert sorted(tuple(r) for r in active.drop("since").collect()) == [
        ("a", "PAUSE", "MOYENNE", 451), ("b", "PAUSE", "MOYENNE", 1),
        ("c", "ARRETER", "HAUTE", 0), ("e", "PAUSE", "MOYENNE", 591)]
    starts = lifecycle.session_starts(lifecycle.transitions(flow, now, P))

    def release(queue, available):
        load = spark.createDataFrame([(queue, available)], "queue_size long, available long")
        return [r.machine_id for r in lifecycle.early_return(active, starts, load, P).collect()]
    # a's pause was renewed in time, so it keeps its first place; e's began anew
    assert release(3, 0) == ["a"]
    assert release(0, 0) == [] and release(3, 1) == []


def epochs(spark, flows, delay=0, horizon=86_400):
    """Changes and late rows of a stream whose epochs are the given frames; the second runs twice."""
    root = workdir(spark, "test-lifecycle")
    state = live.LifecycleState(spark, f"{root}/state", T.TimestampType(), P, delay, horizon)
    changes, late = [], []
    for n, flow in enumerate(flows):
        for _ in range(2 if n == 1 else 1):  # a replay gives the same
            said, rejected = state.epoch(flow, n)
            rows = said.collect(), rejected.collect()
        changes += rows[0]
        late += rows[1]
    return changes, late


def holding(spark, changes):
    df = spark.createDataFrame(changes, "machine_id string, transition string, event_time timestamp, seq long, change int")
    return live.net(df).cache()


@pytest.mark.parametrize("parts, delay", [(1, 0), (3, 700)])
def test_stream_equals_batch(spark, parts, delay):
    """Events in order over one or several epochs; a last marker moves the watermark on."""
    flow = flow_of(spark, {**SEQUENCES, "zz": [(9000 + delay, "ml", "PAUSE")]})
    t = F.col("event_time").cast("double") - F.lit(T0).cast("double")
    edges = [-1, *[3000 * (i + 1) // parts for i in range(parts - 1)], 10 ** 6]
    changes, late = epochs(spark, [flow.where((t > a) & (t <= b)) for a, b in zip(edges, edges[1:])], delay)
    assert {r.reason for r in late} == {"unknown action"} and all(r.change == 1 for r in changes)
    df = holding(spark, changes)
    for machine, events in SEQUENCES.items():
        assert found(df, machine) == by_hand(events, 9000), machine


def test_late_events_correct_what_was_said(spark):
    """Any order of arrival ends in what a batch says; what can't be placed is kept as a reject."""
    rng = random.Random(3)
    events = {f"m{k}": sorted((rng.randrange(0, 4000), *rng.choice(
        [("ml", "PAUSE"), ("maintenance", "FORCER_ARRET"), ("maintenance", "REPARER")])) for _ in range(12)) for k in range(6)}
    events = {m: [e for i, e in enumerate(v) if i == 0 or e[0] != v[i - 1][0]] for m, v in events.items()}
    flow = flow_of(spark, {**events, "zz": [(9000, "ml", "PAUSE")]}).cache()
    seen = F.pmod(F.xxhash64("machine_id", "event_time"), F.lit(3))
    last = F.col("machine_id") == "zz"
    changes, late = epochs(spark, [flow.where((seen == k) & ~last) for k in (2, 0)] + [flow.where((seen == 1) | last)])
    assert not late and any(r.change == -1 for r in changes)
    df = holding(spark, changes)
    for machine, rows in events.items():
        assert found(df, machine) == by_hand(rows, 9000), machine

    odd = spark.createDataFrame([("m0", None, 1, "ml", "PAUSE"), (None, T0, 2, "ml", "PAUSE"), ("m0", T0, 3, "ml", "DANCE"),
                                 ("m0", T0, 4, "ml", "PAUSE")], SCHEMA)
    changes, late = epochs(spark, [flow.limit(0), flow, odd], horizon=600)
    assert sorted(r.reason for r in late) == ["event older than the kept history", "event without machine",
                                              "event without time", "unknown action"]
    df = holding(spark, changes)
    for machine, rows in events.items():
        assert found(df, machine) == by_hand(rows, 9000), machine


def test_job_writes_changes_late_rows_and_system_alerts(spark):
    root = workdir(spark, "test-lifecycle-job")
    bus = Bus(spark, "parquet", f"{root}/bus")
    flow = flow_of(spark, SEQUENCES)
    for source, topic in (("ml", "ml_alerts"), ("maintenance", "maintenance")):
        rows = flow.where(F.col("source") == source).withColumn("timestamp", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        bus.publish(decode.encode(rows, "machine_id", "action", "timestamp"), topic, 0)
    run.main(["lifecycle", "--work", f"{root}/work", "--bus", f"{root}/bus", "--bus-format", "parquet", "--once"], spark)
    changes = lake.read_measurement(spark, f"{root}/work/serving", "transitions")
    stops = changes.where("transition = 'STOPPED' AND change = 1").count()
    alerts = [r[0] for r in bus.table("system_alerts").selectExpr("CAST(value AS STRING)").collect()]
    assert stops > 0 and sum('"STOPPED"' in a for a in alerts) == stops and all('"timestamp"' in a for a in alerts)


def test_an_epoch_sorts_its_events_once(spark):
    """What was said and what is said now come from one window, however many views there are."""
    flow = flow_of(spark, SEQUENCES)
    early = F.col("event_time") < F.lit(T0 + timedelta(seconds=900))
    state = live.LifecycleState(spark, f"{workdir(spark, 'test-lifecycle')}/state", T.TimestampType(), P)
    for n, part in enumerate((flow.where(early), flow.where(~early))):
        changes, _ = state.epoch(part, n)
        plan = changes._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") == 1, plan


def test_a_day_of_an_epoch_is_one_file(spark):
    """Tasks that all hold all days leave no file each per day."""
    root = workdir(spark, "test-lifecycle-files")
    rows = (spark.range(0, 400, 1, 8).withColumn("event_time", F.lit(T0) + F.make_dt_interval(days=F.col("id") % 4))
            .select(F.lit("m").alias("machine_id"), F.lit("STOPPED").alias("transition"), "event_time",
                    F.col("id").alias("seq"), F.lit(1).alias("change")))
    lake.write_measurement(rows, root, "transitions", 0, by_day=True)
    kept = lake.read_measurement(spark, root, "transitions")
    assert kept.count() == 400 and len(kept.inputFiles()) == 4
