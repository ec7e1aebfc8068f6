"""Assignment and orchestration epochs against literal loops on small fleets."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from plantwatch.operators import epoch, fleet, lifecycle, work
from plantwatch.params import DEFAULTS
from plantwatch.session import workdir
from plantwatch.sources import lake
from plantwatch.sources.bus import Bus
from plantwatch.streaming import orchestrate
from plantwatch.streaming.orchestrate import Orchestrator

T0 = datetime(2024, 1, 1)
QUEUE = epoch.state_schemas(T.TimestampType())["queue"]


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def greedy(queue, machines):
    """Pick the best machine, give it the first urgent or else the first task; repeat."""
    queue, machines, out = list(queue), list(machines), {}
    while queue and machines:
        best = None
        for m in machines:
            if m["score"] is not None and (best is None or m["score"] < best["score"]):
                best = m
        best = best or machines[0]
        machines.remove(best)
        task = next((t for t in queue if t["priority"] == "HAUTE"), queue[0])
        queue.remove(task)
        out[best["machine_id"]] = task["task_id"]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_rank_join_is_greedy(spark, seed):
    rng = random.Random(seed)
    fresh = [{"task_id": f"T{i}", "priority": rng.choice(["HAUTE", "NORMALE"]), "seq": i,
              "requeue_seq": None} for i in range(rng.randint(0, 8))]
    back = [{"task_id": f"R{i}", "priority": "HAUTE", "seq": 100 + i, "requeue_seq": 100 + i}
            for i in range(rng.randint(0, 3))]
    machines = [{"machine_id": f"M{i}", "pos": i,
                 "score": rng.choice([None, 0.1, 0.2, 0.2, 0.3])} for i in range(rng.randint(1, 6))]
    queue = spark.createDataFrame(
        [(t["task_id"], "p", 100, 5, t["priority"], T0, t["seq"], t["requeue_seq"])
         for t in fresh + back], QUEUE)
    scored = spark.createDataFrame(
        [(m["machine_id"], m["pos"], m["score"], False) for m in machines],
        "machine_id string, pos long, score double, wake boolean")
    got = {r.machine_id: r.task_id for r in work.assign(queue, scored).collect()}
    # put-back tasks stand at the head, the latest first
    assert got == greedy(back[::-1] + fresh, machines)


def test_held_interruptions(spark):
    held = spark.createDataFrame(
        [("a", "Ta", "p", 1, 10, "NORMALE", at(0), 1), ("b", "Tb", "p", 1, 10, "NORMALE", at(0), 2),
         ("c", "Tc", "p", 1, 10, "NORMALE", at(0), 3), ("d", "Td", "p", 1, 10, "HAUTE", at(0), 4)],
        epoch.state_schemas(T.TimestampType())["held"])
    stops = spark.createDataFrame(
        [("a", at(479), 1), ("a", at(500), 2), ("b", at(480), 3), ("c", at(600), 4)],
        "machine_id string, event_time timestamp, seq long")
    got = {r.task_id: (r.outcome, round(r.progress, 3))
           for r in work.held_interruptions(stops, held).collect()}
    assert got == {"Ta": ("REQUEUED", 0.798), "Tb": ("COMPLETED", 0.8)}
    whole = {r.task_id: r.outcome for r in work.interruptions(stops, held).collect()}
    assert whole == {k: v[0] for k, v in got.items()}


def test_idle_shutdown(spark):
    roster = spark.createDataFrame([(m, i) for i, m in enumerate("abcde")],
                                   "machine_id string, pos long")
    latest = spark.createDataFrame([("d", "PAUSE")], "machine_id string, statut string")
    held = spark.createDataFrame([("e",)], "machine_id string")
    activity = spark.createDataFrame([("a", at(200)), ("b", at(199))],
                                     "machine_id string, last_activity timestamp")
    got = fleet.idle_shutdowns(roster, latest, held, activity, at(0), at(2000), False)
    assert {r.machine_id: r.details for r in got.collect()} == {
        "b": "Économie énergie - inactif 30 min", "c": "Économie énergie - inactif 33 min"}
    assert fleet.idle_shutdowns(roster, latest, held, activity, at(0), at(2000), True).count() == 0


class Plant:
    """The loop the epochs must agree with: one object per machine and task."""

    def __init__(self, roster, scores, p):
        self.roster, self.scores, self.p = roster, scores, p
        self.queue, self.held, self.alerts, self.idle = [], {}, {}, set()
        self.activity = {}
        self.total = self.done = self.cut = self.expired = self.repairs = self.early = 0

    def _lapse(self, now):
        for m, (state, since) in list(self.alerts.items()):
            if state == "PAUSE" and now - since > self.p.pause_seconds:
                del self.alerts[m]
                self.expired += 1

    def epoch(self, orders, events, now, started=0):
        for t, m, effect in events:
            a = self.alerts.get(m)
            if a and a[0] == "PAUSE" and t - a[1] > self.p.pause_seconds:
                del self.alerts[m]
                self.expired += 1
            if effect == "CLEAR":
                self.repairs += self.alerts.pop(m, None) is not None
            elif self.alerts.get(m, ("",))[0] != "ARRET":
                self.alerts[m] = (effect, t)  # a renewed alert keeps its place
            if effect == "ARRET" and m in self.held:
                task, since = self.held[m]
                if 0 <= t - since < task["d"] * 60:
                    del self.held[m]
                    if (t - since) / (task["d"] * 60) < self.p.done_ratio:
                        self.cut += 1
                        self.queue.insert(0, dict(task, pr="HAUTE"))
                    else:
                        self.done += 1
        self._lapse(now)
        for m, (task, since) in list(self.held.items()):
            if now - since >= task["d"] * 60:
                del self.held[m]
                self.done += 1
                self.activity[m] = now
        self.queue += orders
        self.total += len(orders)

        def free():
            return [m for m in self.roster if m not in self.held and m not in self.alerts
                    and (m not in self.idle or self.queue)]
        if self.queue and len(free()) < self.p.min_available:
            paused = [m for m, (s, _) in self.alerts.items() if s == "PAUSE"]
            if paused:
                del self.alerts[paused[0]]
                self.early += 1
        machines = [{"machine_id": m, "score": self.scores.get(m)} for m in free()]
        queue = [{"task_id": t["id"], "priority": t["pr"]} for t in self.queue]
        by_id = {t["id"]: t for t in self.queue}
        given = greedy(queue, machines)
        for m, task in given.items():
            self.held[m] = (by_id[task], now)
            self.activity[m] = now
            self.idle.discard(m)
        self.queue = [t for t in self.queue if t["id"] not in given.values()]
        if not self.queue:
            for m in self.roster:
                if m not in self.held and m not in self.alerts and m not in self.idle and \
                        now - self.activity.get(m, started) > self.p.idle_seconds:
                    self.idle.add(m)
        return given


def test_epochs_follow_the_loop(spark):
    p = DEFAULTS.but(pause_seconds=300, idle_seconds=900, min_available=1)
    roster_names = ["a", "b", "c"]
    temps = {"a": (70.0, 50.0), "b": (60.0, 20.0)}
    plant = Plant(roster_names, {m: t / 100 * 0.6 + c / 100 * 0.4 for m, (t, c) in temps.items()},
                  p)
    roster = spark.createDataFrame([(m, i) for i, m in enumerate(roster_names)],
                                   "machine_id string, pos long")
    metrics = spark.createDataFrame([(m, *v) for m, v in temps.items()],
                                    "machine_id string, temperature double, charge_travail double")
    kinds = {"PAUSE": ("ml", "ARRETER"), "ARRET": ("maintenance", "FORCER_ARRET"),
             "CLEAR": ("maintenance", "REPARER")}
    script = [  # orders (id, minutes, priority), events (time, machine, effect), clock
        ([("t1", 5, "NORMALE"), ("t2", 20, "NORMALE"), ("t3", 9, "HAUTE")], [(10, "c", "PAUSE")],
         60),
        ([("t4", 5, "NORMALE")], [(100, "b", "ARRET"), (110, "a", "PAUSE")], 120),
        ([("t5", 5, "NORMALE")], [(360, "b", "CLEAR"), (370, "c", "ARRET")], 420),
        ([], [(1000, "a", "CLEAR")], 1000),
        ([], [(3000, "c", "CLEAR")], 3000),
        ([], [(5000, "b", "PAUSE")], 5000),
        ([("t6", 1, "NORMALE")], [(5100, "a", "ARRET"), (5100, "c", "ARRET")], 5100),
    ]
    root = workdir(spark, "test-epoch")
    seq, requests = 0, []
    state = epoch.empty_state(spark, T.TimestampType())
    for n, (orders, events, now) in enumerate(script):
        order_rows, event_rows = [], []
        for o in orders:
            seq += 1
            order_rows.append((o[0], "p", 100, o[1], o[2], at(now), seq, None))
        for t, m, effect in events:
            seq += 1
            event_rows.append((m, at(t), seq, *kinds[effect]))
        requests.append((order_rows, event_rows))
        want = plant.epoch([{"id": o[0], "d": o[1], "pr": o[2]} for o in orders], events, now)
        result = epoch.run(
            state, spark.createDataFrame(order_rows, QUEUE),
            spark.createDataFrame(event_rows, "machine_id string, event_time timestamp, seq long, "
                                  "source string, action string"),
            metrics, roster, at(now), at(0), p, lake.settler(f"{root}/state", n))
        state = result.state
        got = {r.machine_id: r.task_id for r in result.outputs["assignments"].collect()}
        assert got == want, n
        assert {r.machine_id for r in state["held"].collect()} == set(plant.held), n
        assert {r.machine_id for r in state["idle"].collect()} == plant.idle, n
        row = state["counters"].first()
        assert (row.total, row.completed, row.interrupted, row.in_queue, row.pauses_expired,
                row.repairs, row.emergency_returns) == (
            plant.total, plant.done, plant.cut, len(plant.queue), plant.expired, plant.repairs,
            plant.early), n
        status = {r.machine_id: r.statut for r in result.outputs["statuses"].collect()}
        for m in roster_names:
            alert = plant.alerts.get(m, ("",))[0]
            assert status[m] == (alert or ("ASSIGNEE" if m in plant.held else
                                           "IDLE" if m in plant.idle else "DISPONIBLE")), (n, m)
    assert plant.early and plant.cut and plant.expired and plant.idle is not None


def test_replayed_epoch_changes_nothing(spark):
    root = workdir(spark, "test-replay")
    roster = spark.createDataFrame([("a", 0), ("b", 1)], "machine_id string, pos long")
    bus = Bus(spark, "parquet", f"{root}/bus")

    def metrics_at(as_of):
        return spark.createDataFrame([], "machine_id string, temperature double, "
                                         "charge_travail double")
    plant = Orchestrator(roster, metrics_at, f"{root}/state", bus, f"{root}/serving",
                         T.TimestampType(), at(0))
    rows = spark.createDataFrame(
        [("order", "t1", "p", 1, 5, "NORMALE", at(5), 1, None, None, None, None),
         ("event", None, None, None, None, None, at(6), 2, None, "b", "ml", "PAUSE")],
        "kind string, task_id string, product_name string, quantity long, duration_minutes int, "
        "priority string, event_time timestamp, seq long, requeue_seq long, machine_id string, "
        "source string, action string")

    def look():
        return (sorted(r.value for r in bus.table("statuses").collect()),
                lake.read_measurement(spark, f"{root}/serving", "assignations").count(),
                sorted(map(tuple, plant.tables["held"].after(0).collect())))
    plant.epoch(rows, 0)
    first = look()
    plant.epoch(rows, 0)
    assert look() == first and first[1] == 1 and first[2][0][0] == "a"


INBOX = ("kind string, task_id string, product_name string, quantity long, duration_minutes int, "
         "priority string, event_time timestamp, seq long, requeue_seq long, machine_id string, "
         "source string, action string")


def order(task, when, seq, minutes=5):
    return ("order", task, "p", 1, minutes, "NORMALE", when, seq, None, None, None, None)


def event(machine, when, seq, action, source="maintenance"):
    return ("event", None, None, None, None, None, when, seq, None, machine, source, action)


def tick(when):
    return ("tick", None, None, None, None, None, when, None, None, None, None, None)


@pytest.fixture()
def plant(spark):
    root = workdir(spark, "test-clock")
    roster = spark.createDataFrame([("a", 0), ("b", 1)], "machine_id string, pos long")

    def metrics_at(as_of):
        return lake.read_measurement(spark, f"{root}/serving", "etat_machines")
    p = Orchestrator(roster, metrics_at, f"{root}/state", Bus(spark, "parquet", f"{root}/bus"),
                     f"{root}/serving", T.TimestampType(), at(0))
    p.run = lambda n, *rows: p.epoch(spark.createDataFrame(list(rows), INBOX), n)
    p.ids = lambda table, n: sorted(r[0] if table == "queue" else r[1]
                                    for r in p.tables[table].after(n).collect())
    return p


def test_orders_without_a_time_keep_the_state(plant):
    plant.run(0, order("t1", at(5), 1, 90), order("t2", at(5), 2, 90), order("t3", at(6), 3))
    plant.run(1, order("t4", None, 4))
    plant.run(2, order("t5", at(60), 5))
    assert plant.ids("held", 2) == ["t1", "t2"] and plant.ids("queue", 2) == ["t3", "t4", "t5"]
    assert plant.tables["counters"].after(2).first().total == 5


def test_the_clock_never_runs_back(plant):
    plant.run(0, event("a", at(600), 1, "FORCER_ARRET"), event("b", at(600), 2, "FORCER_ARRET"))
    plant.run(1, order("t1", at(5), 3))
    assert plant.ids("held", 1) == [] and plant.ids("queue", 1) == ["t1"]
    plant.run(2, event("b", at(700), 4, "REPARER"))
    assert plant.ids("held", 2) == ["t1"]


def test_ticks_drive_a_quiet_plant(plant):
    plant.run(0, order("t1", at(5), 1), order("t2", at(5), 2), order("t3", at(5), 3), tick(at(10)))
    assert plant.ids("queue", 0) == ["t3"]
    plant.run(1, tick(at(400)))
    assert plant.ids("held", 1) == ["t3"]
    # a time from the future moves nothing, and its alert holds at once
    plant.run(2, tick(at(410)), event("a", at(99_999), 4, "FORCER_ARRET"), order("t4", at(88_888), 5))
    assert plant.ids("held", 2) in (["t3"], ["t4"], ["t3", "t4"])
    assert plant.clock.after(2).first()[0] == at(410)
    statuses = {r.machine_id: r.statut for r in lake.read_measurement(
        plant.roster.sparkSession, plant.serving, "statut_machines").where("epoch_id = 2").collect()}
    assert statuses["a"] == "ARRET"


def test_an_order_that_comes_twice_is_one_task(plant):
    plant.run(0, order("t1", at(5), 1), order("t1", at(6), 2))
    plant.run(1, order("t1", at(7), 3))
    assert plant.ids("held", 1) == ["t1"] and plant.ids("queue", 1) == []
    assert plant.tables["counters"].after(1).first().total == 1


def test_a_missing_state_is_an_error(plant):
    with pytest.raises(RuntimeError, match="no state of epoch 6"):
        plant.run(7, order("t1", at(5), 1))


def test_interruptions_and_commands_are_kept(plant):
    plant.run(0, order("t1", at(5), 1, 60))
    plant.run(1, event("a", at(65), 2, "FORCER_ARRET"))
    spark = plant.roster.sparkSession
    row = lake.read_measurement(spark, plant.serving, "interruptions").first()
    assert (row.machine_id, row.task_id, row.outcome) == ("a", "t1", "REQUEUED")
    assert [r.value for r in plant.bus.table("commands").collect()] == [
        b'{"machine_id":"a","action":"ARRETER"}']


SINKS = ["assignations", "statut_machines", "interruptions", "resource_manager_stats", "task_queue"]


def test_readers_see_all_sinks_of_an_epoch_or_none(plant):
    """An epoch broken off between two sinks shows in none of them until it is run again."""
    assert plant.clock.last() == -1 and [rows.count() for rows in plant.served(*SINKS)] == [0] * 5
    second = order("t3", at(65), 3), event("a", at(65), 2, "FORCER_ARRET")
    plant.run(0, order("t1", at(5), 1, 60), order("t2", at(5), 2, 60))
    whole = [rows.count() for rows in plant.served(*SINKS)]
    assert whole == [2, 2, 0, 1, 1]
    spark, bus = plant.roster.sparkSession, plant.bus

    class Broken(Bus):
        def publish(self, df, name, epoch_id=None):
            if name == "commands":
                raise RuntimeError("the broker is away")
            super().publish(df, name, epoch_id)
    plant.bus = Broken(spark, bus.format, bus.location)
    with pytest.raises(RuntimeError, match="away"):
        plant.run(1, *second)
    written = lake.read_measurement(spark, plant.serving, "interruptions")
    assert written.count() == 1 and lake.read_measurement(spark, plant.serving, "task_queue").count() == 1
    assert plant.clock.last() == 0 and [rows.count() for rows in plant.served(*SINKS)] == whole
    plant.bus = bus
    plant.run(1, *second)
    assert plant.clock.last() == 1 and [rows.count() for rows in plant.served(*SINKS)] == [2, 4, 1, 2, 2]
    plant.run(1, *second)  # and a replay changes nothing
    assert [rows.count() for rows in plant.served(*SINKS)] == [2, 4, 1, 2, 2]


def test_new_orders_are_written_once_and_only_events_are_cached(plant, monkeypatch):
    cached = []
    keep = orchestrate.shared
    monkeypatch.setattr(orchestrate, "shared", lambda df: cached.append(df.columns) or keep(df))
    plant.run(0, order("t1", at(5), 1), order("t2", at(5), 2), order("t3", at(5), 3))
    assert cached == [lifecycle.FLOW]
    spark = plant.roster.sparkSession
    assert {r.task_id for r in spark.read.parquet(f"{plant.root}/queue/added/epoch=0").collect()} == {"t1", "t2", "t3"}
    assert lake.StateTable(spark, f"{plant.root}/orders", QUEUE).last() == -1  # no step of its own
    assert plant.ids("queue", 0) == ["t3"] and plant.tables["counters"].after(0).first().total == 3
