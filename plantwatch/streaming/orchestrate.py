"""The orchestrator as a stream: one epoch per micro-batch on versioned state tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from plantwatch.operators import epoch as epochs, lifecycle
from plantwatch.params import DEFAULTS, Params
from plantwatch.sources import lake, records
from plantwatch.sources.bus import Bus
from plantwatch.streaming.jobs import shared, start

ORDER_COLUMNS = ["task_id", "product_name", "quantity", "duration_minutes", "priority",
                 "event_time", "seq", "requeue_seq"]


def inbox(orders: DataFrame, *flows: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Orders and alert events as one stream, so that an epoch sees both.

    `ticks` (column event_time) are rows of a timer: they move the clock while the
    bus is quiet, and no timestamp of a record can move it beyond them.
    """
    rows = orders.select(F.lit("order").alias("kind"), *ORDER_COLUMNS)
    if ticks is not None:
        rows = rows.unionByName(ticks.select(F.lit("tick").alias("kind"), "event_time"),
                                allowMissingColumns=True)
    for flow in flows:
        rows = rows.unionByName(flow.select(F.lit("event").alias("kind"), *lifecycle.FLOW),
                                allowMissingColumns=True)
    return rows


class Orchestrator:
    """Reads the state of the epoch before, runs the epoch and writes state and sinks.

    All writes are keyed by epoch, so a replayed epoch gives the same files. The clock
    is part of the state and never runs back: it is the newest tick or, without ticks,
    the newest event of the epoch, or else what it was. Records without a time, or
    with one after the clock, happen at the clock.

    The clock is saved after all sinks, so its epoch says how far they are whole: `served`
    shows no epoch of which a sink is missing.
    """

    def __init__(self, roster: DataFrame, metrics_at, root: str, bus: Bus, serving: str, time,
                 started, p: Params = DEFAULTS):
        self.roster, self.metrics_at, self.bus, self.serving = roster, metrics_at, bus, serving
        self.root, self.started, self.p, self.time = root, started, p, time
        spark = roster.sparkSession
        self.tables = {n: lake.StateTable(spark, f"{root}/{n}", schema)
                       for n, schema in epochs.state_schemas(time).items()}
        self.tables["queue"] = lake.DeltaTable(spark, f"{root}/queue", self.tables["queue"].schema,
                                               "task_id", p.queue_epochs)
        self.clock = lake.StateTable(spark, f"{root}/clock", T.StructType(
            [T.StructField("event_time", time)]))

    def _now(self, rows: DataFrame, epoch_id: int):
        last = self.clock.before(epoch_id).first()
        if epoch_id and last is None:
            raise RuntimeError(f"{self.root} has no clock of epoch {epoch_id - 1}")
        tick = F.col("kind") == "tick"
        ticked, newest = rows.agg(F.max(F.when(tick, F.col("event_time"))),
                                  F.max(F.when(~tick, F.col("event_time")))).first()
        seen = newest if ticked is None else ticked
        known = [t for t in (last and last[0], seen) if t is not None]
        return max(known) if known else datetime.fromisoformat(str(self.started))

    def _keep_queue(self, epoch_id: int):
        queue = self.tables["queue"]

        def add(added: DataFrame) -> DataFrame:
            return queue.add(added, epoch_id)

        def remove(removed: DataFrame) -> DataFrame:
            queue.remove(removed, epoch_id)
            return queue.after(epoch_id)
        return add, remove

    def epoch(self, batch: DataFrame, epoch_id: int) -> None:
        as_of = self._now(batch, epoch_id)
        now = F.lit(str(as_of)).cast(self.time)
        timed = batch.withColumn("event_time", F.least(F.coalesce("event_time", now), now))
        state = {n: t.before(epoch_id) for n, t in self.tables.items()}
        # Of orders, the clock reads the time and the queue the rest, once; events are read often.
        orders = timed.where(F.col("kind") == "order").select(*ORDER_COLUMNS)
        with shared(timed.where(F.col("kind") == "event").select(*lifecycle.FLOW)) as flow:
            result = epochs.run(state, orders, flow, self.metrics_at(as_of), self.roster, as_of,
                                self.started, self.p, lake.settler(self.root, epoch_id),
                                self._keep_queue(epoch_id))
        self._sinks(result.outputs, epoch_id)
        self.clock.save(self.roster.sparkSession.range(1).select(now.alias("event_time")), epoch_id)

    def _sinks(self, out: dict[str, DataFrame], epoch_id: int) -> None:
        def measure(rows, name):
            lake.write_measurement(rows, self.serving, name, epoch_id)
        self.bus.publish(records.assignments(out["assignments"]), "assignments", epoch_id)
        self.bus.publish(records.statuses(out["statuses"]), "statuses", epoch_id)
        measure(out["assignments"], "assignations")
        measure(out["statuses"], "statut_machines")
        measure(out["pause_starts"], "pause_starts")
        measure(out["interruptions"], "interruptions")
        self.bus.publish(records.machine_commands(out["commands"]), "commands", epoch_id)
        measure(out["stats"], "resource_manager_stats")
        measure(out["queue_size"], "task_queue")

    def served(self, *names: str) -> list[DataFrame]:
        """The measurements named, all up to the last epoch whose sinks are all written."""
        last = self.clock.last()
        return [lake.read_measurement(self.roster.sparkSession, self.serving, n, last) for n in names]

    def start(self, inbox_rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return start(inbox_rows, checkpoint, self.epoch, self.p,
                     **(trigger or {"processingTime": self.p.epoch}))
