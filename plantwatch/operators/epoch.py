"""One orchestration epoch as set operations on state tables.

Order of steps: pauses run out, tasks finish or are cut short, orders and alerts
come in, one machine may return early, free machines take tasks, statuses are
reconciled, idle machines shut down, counters are written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantwatch.operators import fleet, lifecycle, work
from plantwatch.operators.floor import KPI
from plantwatch.operators.ordered import HALO
from plantwatch.params import DEFAULTS, Params
from plantwatch.session import stored

LAST = 2 ** 62  # sequence number after all others of the same time


def state_schemas(time: T.DataType) -> dict[str, T.StructType]:
    """Layout of the state tables; `time` is the type of event times."""
    def table(**fields):
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])
    s, i, n = T.StringType(), T.IntegerType(), T.LongType()
    task = {"task_id": s, "product_name": s, "quantity": n, "duration_minutes": i, "priority": s,
            "event_time": time, "seq": n}
    return {
        "queue": table(**task, requeue_seq=n),
        "held": table(machine_id=s, **task),
        "alerts": table(machine_id=s, event_time=time, seq=n, source=s, action=s),
        "pauses": table(machine_id=s, paused_since=time, paused_seq=n),
        "idle": table(machine_id=s),
        "activity": table(machine_id=s, last_activity=time),
        "counters": table(**{c: n for c in KPI}),
    }


def empty_state(spark: SparkSession, time: T.DataType) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], schema) for n, schema in state_schemas(time).items()}


@dataclass
class Epoch:
    state: dict[str, DataFrame]
    outputs: dict[str, DataFrame]


def _kept_alerts(events: DataFrame, as_of, p: Params) -> DataFrame:
    """Latest event of each kind per machine, without pauses that are over."""
    known = lifecycle.known(events.drop(HALO))
    newest = (known.groupBy("machine_id", "effect")
              .agg(F.max_by(F.struct("event_time", "seq", "source", "action"),
                            F.struct("event_time", "seq")).alias("e"))
              .select("machine_id", "effect", "e.*"))
    over = lifecycle.alert_state(known, as_of, p, prepared=True).where(
        F.col("state") == "EXPIRED").select("machine_id", F.lit("PAUSE").alias("effect"))
    return newest.join(over, ["machine_id", "effect"], "left_anti").drop("effect")


def _new_orders(orders: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """One row per task that is neither queued nor held: an order may come twice."""
    first = F.min_by(F.struct(*[c for c in orders.columns if c != "task_id"]),
                     F.struct("event_time", "seq"))
    known = state["queue"].select("task_id").unionByName(state["held"].select("task_id"))
    return (orders.groupBy("task_id").agg(first.alias("_o")).select("task_id", "_o.*")
            .select(*orders.columns).join(known, "task_id", "left_anti"))


def run(state: dict[str, DataFrame], orders: DataFrame, flow: DataFrame, metrics: DataFrame,
        roster: DataFrame, as_of, started, p: Params = DEFAULTS, settle=None,
        keep_queue=None) -> Epoch:
    """Advance the state to `as_of`.

    `orders` are new queue rows, `flow` new alert and maintenance events, `metrics`
    the latest temperature and workload per machine. `settle(df, name)` stores a
    step's result and returns the stored rows: later steps read each several times,
    and their plans stay short. By default it is a new table below the checkpoint folder.
    `keep_queue` is two functions, `add(rows)`, which stores new queue rows and returns them as
    stored, and `remove(keys)`, which returns the queue after the epoch: the one table that
    grows with the work waiting isn't written anew, and new rows are written once. Its length
    is kept as a counter, and only its head is stored as a step.
    """
    settle = settle or stored
    time = flow.schema["event_time"].dataType
    now = F.lit(str(as_of)).cast(time)

    # alerts: what is new, in the light of the latest events kept
    events = flow.select(*lifecycle.FLOW).withColumn(HALO, F.lit(False)).unionByName(
        state["alerts"].withColumn(HALO, F.lit(True)))
    changes = settle(lifecycle.transitions(events, as_of, p), "changes")
    active = settle(lifecycle.active_alerts(events.drop(HALO), as_of, p), "active")
    # a continued pause keeps its place; a new start replaces it
    pauses = settle(
        lifecycle.session_starts(changes).withColumn("_new", F.lit(1))
        .unionByName(state["pauses"].withColumn("_new", F.lit(0)))
        .groupBy("machine_id")
        .agg(F.max_by(F.struct("paused_since", "paused_seq"), "_new").alias("_p"))
        .select("machine_id", "_p.*")
        .join(active.where(F.col("action") == "PAUSE").select("machine_id"), "machine_id",
              "left_semi"), "paused")

    # tasks that end
    stops = lifecycle.known(flow).where(F.col("effect") == "ARRET")
    cut_short = settle(work.held_interruptions(stops, state["held"], p), "interruptions")
    going = state["held"].join(cut_short.select("task_id"), "task_id", "left_anti")
    finished = settle(work.completed(going, as_of), "finished")
    held = work.still_held(going, as_of)
    orders = _new_orders(orders.select(*state["queue"].columns), state)
    added = orders.unionByName(work.requeued(cut_short).select(*state["queue"].columns))
    added = keep_queue[0](added) if keep_queue else settle(added, "added")
    queue = state["queue"].unionByName(added)
    arrived = added.count()
    length = (state["counters"].agg(F.sum("in_queue")).first()[0] or 0) + arrived
    waiting = length > 0

    # machines that may work, after at most one early return
    sleeping = state["idle"].withColumn("statut", F.lit("IDLE"))
    free = settle(fleet.available_machines(roster, sleeping, held, active, waiting), "free")
    load = free.agg(F.count(F.lit(1)).alias("available")).withColumn(
        "queue_size", F.lit(length).cast("long"))
    released = settle(lifecycle.early_return(active, pauses, load, p).select("machine_id"),
                      "released")
    blocked = active.join(released, "machine_id", "left_anti")
    freed = fleet.available_machines(
        roster.join(released, "machine_id", "left_semi"), sleeping, held, blocked, waiting)
    returns = released.select(
        "machine_id", now.alias("event_time"), F.lit(LAST).alias("seq"),
        F.lit("maintenance").alias("source"), F.lit(lifecycle.EARLY_RETURN).alias("action"))

    # assignment
    scored = settle(fleet.scored_simple(free.unionByName(freed), metrics), "scored")
    head = settle(work.queue_head(queue, scored.count(), p), "head")
    assigned = settle(work.assign(head, scored, p).withColumn("event_time", now)
                      .withColumn("seq", F.lit(None).cast("long")), "assigned")
    held_after = settle(held.unionByName(assigned.select(*held.columns)), "held")
    if keep_queue:
        queue_after = keep_queue[1](assigned.select("task_id"))
    else:
        queue_after = settle(work.remaining_queue(queue, assigned), "queue")
    left = length - assigned.count()

    # activity, idling
    ended = finished.select("machine_id", now.alias("event_time"))
    activity = settle(fleet.last_activity(
        state["activity"].withColumnRenamed("last_activity", "event_time"), ended, assigned),
        "activity")
    awake = state["idle"].join(assigned.select("machine_id"), "machine_id", "left_anti")
    status = derived_status(roster, blocked, held_after, awake)
    shutdowns = settle(fleet.idle_shutdowns(
        roster, status, held_after, activity, started, as_of, work_waiting=left > 0, p=p),
        "shutdowns")
    idle = settle(awake.unionByName(shutdowns.select("machine_id")), "idle")

    # counters
    alerts_row = lifecycle.alert_counters(changes).drop("emergency_returns")
    counters = work.merge_counters(
        cut_short.agg((F.lit(arrived) - F.count(F.when(F.col("outcome") == "REQUEUED", 1))).alias("total")),
        finished.agg(F.count(F.lit(1)).alias("_finished")),
        cut_short.agg(F.count(F.when(F.col("outcome") == "COMPLETED", 1)).alias("_late"),
                      F.count(F.when(F.col("outcome") == "REQUEUED", 1)).alias("interrupted")),
        alerts_row, released.agg(F.count(F.lit(1)).alias("emergency_returns")),
        free.sparkSession.range(1).select(F.lit(left).cast("long").alias("in_queue")))
    delta = counters.withColumn("completed", F.col("_finished") + F.col("_late")).select(*KPI)
    # depth is a level, the others add up over epochs
    before = state["counters"].withColumn("in_queue", F.lit(0).cast("long"))
    totals = settle(before.unionByName(delta).agg(*[F.sum(c).alias(c) for c in KPI]), "counters")
    alerts_after = settle(_kept_alerts(events.drop(HALO).unionByName(returns), as_of, p), "alerts")
    pauses_after = settle(pauses.join(released, "machine_id", "left_anti"), "pauses")
    statuses = settle(status_rows(roster, blocked, held_after, idle, finished, shutdowns,
                                  released, assigned, now), "statuses")
    return Epoch(
        state={"queue": queue_after, "held": held_after, "alerts": alerts_after,
               "pauses": pauses_after, "idle": idle, "activity": activity, "counters": totals},
        outputs={
            "assignments": assigned.select("task_id", "machine_id", "product_name", "quantity",
                                           "duration_minutes", "event_time"),
            "statuses": statuses, "interruptions": cut_short,
            "pause_starts": lifecycle.pause_starts(changes),
            "commands": changes.where(F.col("transition").isin("PAUSE_STARTED", "STOPPED")).select(
                "machine_id", F.when(F.col("transition") == "STOPPED", "ARRETER")
                .otherwise("PAUSE").alias("action")),
            "stats": totals.withColumn("event_time", now),
            "queue_size": totals.select(F.col("in_queue").alias("size"), now.alias("event_time")),
        })


def derived_status(roster: DataFrame, blocked: DataFrame, held: DataFrame,
                   idle: DataFrame) -> DataFrame:
    """Status by precedence: down, cooldown, running, idle, available."""
    def mark(df, name):
        return df.select("machine_id", F.lit(True).alias(name))
    df = (roster.select("machine_id")
          .join(blocked.select("machine_id", F.col("action").alias("_alert")), "machine_id", "left")
          .join(mark(held, "_held"), "machine_id", "left")
          .join(mark(idle, "_idle"), "machine_id", "left"))
    return df.select("machine_id", F.when(F.col("_alert") == "ARRETER", "ARRET")
                     .when(F.col("_alert") == "PAUSE", "PAUSE")
                     .when(F.col("_held"), "ASSIGNEE").when(F.col("_idle"), "IDLE")
                     .otherwise("DISPONIBLE").alias("statut"))


def status_rows(roster, blocked, held, idle, finished, shutdowns, released, assigned, now):
    """One status row per machine with the reason for its latest change."""
    # Texts of the changes, weakest first.
    notes = (
        finished.select("machine_id", F.lit(1).alias("_w"), "details")
        .unionByName(assigned.where("wake").select(
            "machine_id", F.lit(2).alias("_w"), F.lit("Réveil automatique").alias("details")))
        .unionByName(shutdowns.select("machine_id", F.lit(3).alias("_w"), "details"))
        .unionByName(released.select("machine_id", F.lit(4).alias("_w"),
                                     F.lit("Retour urgent").alias("details")))
        .unionByName(held.select("machine_id", F.lit(5).alias("_w"),
                                 F.format_string("Tâche %s", "task_id").alias("details")))
        .groupBy("machine_id").agg(F.max_by("details", "_w").alias("details")))
    return (derived_status(roster, blocked, held, idle).join(notes, "machine_id", "left")
            .withColumn("details", F.coalesce("details", F.lit("")))
            .withColumn("event_time", now))
