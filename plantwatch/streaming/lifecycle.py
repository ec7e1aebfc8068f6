"""Alert lifecycle as a stream: the batch operator over kept events, with corrections for late ones.

An epoch takes new events, moves the watermark to the newest event less the allowed delay and
returns what the batch operator says now and did not say before. Events that come within the
delay wait for the watermark. An event behind it changes what was said: the epoch takes back
the transitions that no longer hold (`change` -1) and adds the new ones (+1), so the sum of
changes is always what a batch over the same events gives. Only the machines that an epoch
touches, or whose pause may run out in it, are computed again.

Events are kept for `horizon_seconds` behind the watermark; of older ones the latest of each
kind per machine is all that later states depend on. An event that is older than what is kept
can't be placed any more: it goes to the rejects with the reason, as does one without a time.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from plantwatch.functions.times import instant
from plantwatch.operators.lifecycle import FLOW, corrections, effect, known
from plantwatch.operators.ordered import HALO
from plantwatch.params import DEFAULTS, Params
from plantwatch.session import stored
from plantwatch.sources import lake, records
from plantwatch.sources.bus import Bus
from plantwatch.streaming.jobs import shared, start

CHANGES = ["machine_id", "transition", "event_time", "seq"]


class LifecycleState:
    """Kept events and the watermark across epochs, in versioned state tables."""

    def __init__(self, spark: SparkSession, root: str, time: T.DataType, p: Params = DEFAULTS,
                 delay_seconds: int = 0, horizon_seconds: int = 86_400):
        self.spark, self.p = spark, p
        self.delay, self.horizon = timedelta(seconds=delay_seconds), timedelta(seconds=horizon_seconds)
        kinds = {"machine_id": T.StringType(), "event_time": time, "seq": T.LongType(),
                 "source": T.StringType(), "action": T.StringType()}
        events = T.StructType([T.StructField(n, kinds[n]) for n in FLOW])
        self.base = lake.StateTable(spark, f"{root}/base", events)
        self.history = lake.StateTable(spark, f"{root}/history", events)
        self.clock = lake.StateTable(spark, f"{root}/clock", T.StructType([T.StructField("event_time", time)]))

    def epoch(self, batch: DataFrame, epoch_id: int) -> tuple[DataFrame, DataFrame]:
        """(changes, rejects) of one epoch; the state for the next is written."""
        flow = batch.select(*[F.col(c).cast(self.history.schema[c].dataType).alias(c) for c in FLOW])
        last = self.clock.before(epoch_id).first()
        old = last[0] if last else None
        newest = known(flow).agg(F.max("event_time")).first()[0]
        seen = [t for t in (old, newest - self.delay if newest else None) if t is not None]
        new = max(seen) if seen else None

        timed = F.col("event_time").isNotNull()
        oldest = F.lit(True) if old is None else F.col("event_time") > instant(flow, "event_time", old - self.horizon)
        reason = (F.when(effect().isNull(), "unknown action").when(F.col("machine_id").isNull(), "event without machine")
                  .when(~timed, "event without time").when(~oldest, "event older than the kept history"))
        judged = flow.withColumn("reason", reason)
        rejects = judged.where("reason is not null").select(
            F.to_json(F.struct(*FLOW)).alias("raw"), "reason", "event_time")
        taken = judged.where("reason is null").select(*FLOW)

        base, history = self.base.before(epoch_id), self.history.before(epoch_id)
        pool = history.unionByName(taken)
        changes = self._changes(base, history, taken, old, new)
        self._save(base, pool, new, epoch_id)
        return changes, rejects

    def _changes(self, base, history, taken, old, new) -> DataFrame:
        if new is None:
            return self.spark.createDataFrame([], self.history.schema).select(
                "machine_id", F.lit("").alias("transition"), "event_time", "seq", F.lit(0).alias("change")).limit(0)
        marked = (base.withColumns({HALO: F.lit(True), "_new": F.lit(False)})
                  .unionByName(history.withColumns({HALO: F.lit(False), "_new": F.lit(False)}))
                  .unionByName(taken.withColumns({HALO: F.lit(False), "_new": F.lit(True)})))
        touched = taken.select("machine_id")
        if old is not None:
            # waiting events, and pauses that may run out since the old watermark
            due = instant(marked, "event_time", old - timedelta(seconds=self.p.pause_seconds))
            waiting = history.unionByName(base).where(F.col("event_time") > due)
            touched = touched.unionByName(waiting.select("machine_id"))
        # stored, as a join is too much to be computed at each reading
        mine = stored(marked.join(touched.distinct(), "machine_id", "left_semi"), "touched")
        return corrections(mine, old, new, self.p).select(*CHANGES, "change")

    def _save(self, base, pool, new, epoch_id: int) -> None:
        if new is not None:
            kept = F.col("event_time") > instant(pool, "event_time", new - self.horizon)
            folded = base.unionByName(pool.where(~kept)).withColumn("effect", effect())
            base = (folded.groupBy("machine_id", "effect")
                    .agg(F.max_by(F.struct(*FLOW), F.struct("event_time", "seq")).alias("e")).select("e.*"))
            pool = pool.where(kept)
            clock = self.spark.range(1).select(instant(pool, "event_time", new).alias("event_time"))
        else:
            clock = self.spark.createDataFrame([], self.clock.schema)
        self.base.save(base, epoch_id)
        self.history.save(pool, epoch_id)
        self.clock.save(clock, epoch_id)


def net(changes: DataFrame) -> DataFrame:
    """Transitions that hold after all corrections."""
    total = changes.groupBy(*CHANGES).agg(F.sum("change").cast("int").alias("_n")).where("_n > 0")
    return total.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def lifecycle(flow: DataFrame, state: LifecycleState, serving: str, checkpoint: str, bus: Bus | None = None,
              p: Params = DEFAULTS, **trigger) -> StreamingQuery:
    """Changes to the measurement `transitions`, events that can't be placed to `late_events`;
    stops and pauses that ran out also as system alerts."""
    def epoch(batch: DataFrame, epoch_id: int):
        with shared(batch.select(*FLOW)) as rows:
            changes, rejected = state.epoch(rows, epoch_id)
            with shared(changes) as said:
                lake.write_measurement(said, serving, "transitions", epoch_id, by_day=True)
                if bus is not None:
                    urgent = said.where("change > 0 AND transition IN ('STOPPED', 'PAUSE_EXPIRED')")
                    bus.publish(records.system_alerts(urgent.select(
                        "machine_id", F.col("transition").alias("type_alerte"), "event_time"), "event_time"),
                        "system_alerts", epoch_id)
            # without a time they count as of the watermark, so a replay meets the same partition
            mark = state.clock.after(epoch_id).agg(F.max("event_time")).first()[0]
            known_time = F.coalesce("event_time", instant(rows, "event_time", mark or "1970-01-01"))
            lake.write_measurement(rejected.withColumn("event_time", known_time), serving, "late_events", epoch_id,
                                   by_day=True)
    return start(flow, checkpoint, epoch, p, **trigger)
