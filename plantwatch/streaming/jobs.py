"""Assembly of the running jobs: decode once, classify with columns, write per epoch.

Every job takes a streaming frame, so the same code runs on a bus topic or on
files. Each query has its own checkpoint folder.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from plantwatch import schemas
from plantwatch.functions import decode
from plantwatch.functions.times import instant
from plantwatch.functions.values import rounded
from plantwatch.operators import features, latest, ordered, rollups
from plantwatch.params import DEFAULTS, Params
from plantwatch.sources import lake, records
from plantwatch.sources.bus import Bus


def start(df: DataFrame, checkpoint: str, each_epoch, p: Params = DEFAULTS,
          **trigger) -> StreamingQuery:
    return (df.writeStream.foreachBatch(each_epoch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": p.trigger})).start())


@contextmanager
def shared(df: DataFrame):
    """One epoch's rows for several sinks; lost blocks are computed again."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def counted(df: DataFrame, **counts):
    """`df` with counts that are taken while it is written, without a job of their own."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in counts.items()]), seen


def _report(on_count, epoch_id: int, seen: Observation) -> None:
    if on_count:
        on_count(epoch_id, seen.get)


def hot_state(readings: DataFrame, serving: str, checkpoint: str, p: Params = DEFAULTS,
              on_count=None, **trigger) -> StreamingQuery:
    """Every reading into the served state, missing values filled."""
    def epoch(batch: DataFrame, epoch_id: int):
        rows, seen = counted(latest.fill_serving(batch), archived=F.count(F.lit(1)))
        lake.write_measurement(rows, serving, "etat_machines", epoch_id)
        _report(on_count, epoch_id, seen)
    return start(readings, checkpoint, epoch, p, **trigger)


def energy(readings: DataFrame, serving: str, bus: Bus, checkpoint: str, p: Params = DEFAULTS,
           on_count=None, **trigger) -> StreamingQuery:
    """Energy anomalies to the served measurement and to the alert topic."""
    def epoch(batch: DataFrame, epoch_id: int):
        with shared(rollups.energy_anomalies(batch, p)) as anomalies:
            rows, seen = counted(anomalies, anomalies=F.count(F.lit(1)))
            lake.write_measurement(rows, serving, "anomalies_energie", epoch_id)
            bus.publish(records.energy_alerts(anomalies), "energy_alerts", epoch_id)
            _report(on_count, epoch_id, seen)
    return start(readings, checkpoint, epoch, p, **trigger)


def rejects(bus: Bus, serving: str, checkpoint: str, p: Params = DEFAULTS,
            **trigger) -> StreamingQuery:
    """Raw records that no job takes; one without any time counts as of the newest of its epoch,
    so that a replay on another day meets the same partition."""
    rows = decode.rejects(bus.stream("orders"), bus.stream("ml_alerts"), bus.stream("maintenance"))

    def epoch(batch: DataFrame, epoch_id: int):
        with shared(batch) as kept:
            newest = kept.agg(F.max("event_time")).first()[0]
            known = F.coalesce("event_time", instant(kept, "event_time", newest or "1970-01-01"))
            lake.write_measurement(kept.withColumn("event_time", known), serving, "rejects", epoch_id)
    return start(rows, checkpoint, epoch, p, **trigger)


def rollup(readings: DataFrame, serving: str, checkpoint: str, every: str = "10 minutes",
           p: Params = DEFAULTS, on_count=None, **trigger) -> StreamingQuery:
    """Sums, counts and maxima per window of each epoch: panels add them up instead of reading
    the readings again. A late reading is a row more in its window, whatever the watermark."""
    def epoch(batch: DataFrame, epoch_id: int):
        rows, seen = counted(rollups.partials(batch, schemas.MEASURES, every), windows=F.count(F.lit(1)))
        lake.write_measurement(rows, serving, "rollups", epoch_id)
        _report(on_count, epoch_id, seen)
    return start(readings, checkpoint, epoch, p, **trigger)


def predict(readings: DataFrame, serving: str, bus: Bus | None, checkpoint: str, score=None,
            p: Params = DEFAULTS, on_count=None, **trigger) -> StreamingQuery:
    """Failure probability per reading, by `score` or by rule; high ones also as alerts."""
    def epoch(batch: DataFrame, epoch_id: int):
        scored = score(batch) if score else rollups.predictions(batch, p)
        with shared(scored) as kept:
            rows, seen = counted(kept, predictions=F.count(F.lit(1)))
            lake.write_measurement(rows, serving, "predictions", epoch_id)
            if bus is not None:
                bus.publish(records.failure_alerts(kept, p), "failure_alerts", epoch_id)
            _report(on_count, epoch_id, seen)
    return start(readings, checkpoint, epoch, p, **trigger)


def predict_rolling(readings: DataFrame, state: "FeatureState", serving: str, bus: Bus | None,
                    checkpoint: str, score, p: Params = DEFAULTS, **trigger) -> StreamingQuery:
    """As `predict`, by a model on rolling features: serving sees what training saw."""
    def write(rows: DataFrame, epoch_id: int):
        served = rows.select("machine_id", "event_time", rounded("failure_probability", 4)
                             .alias("probabilite_panne"))
        with shared(served) as kept:
            lake.write_measurement(kept, serving, "predictions", epoch_id)
            if bus is not None:
                bus.publish(records.failure_alerts(kept, p), "failure_alerts", epoch_id)
    return feature_alerts(readings, state, checkpoint, write, p, score, **trigger)


def rolling_mean(readings: DataFrame, measure: str, every: str, p: Params = DEFAULTS) -> DataFrame:
    """Streaming form of the hourly means: late rows beyond the watermark are dropped."""
    timed = readings.withColumn("event_time", F.col("event_time").cast("timestamp"))
    return rollups.mean_by_machine(timed.withWatermark("event_time", p.watermark), measure, every)


# ---- rolling features and change alerts ------------------------------------------

KEPT = ["machine_id", "event_time", "seq", *schemas.MEASURES]


def last_readings(rows: DataFrame, n: int) -> DataFrame:
    """The newest n rows per machine; each task passes on at most n rows per machine."""
    newest = Window.partitionBy("machine_id").orderBy(F.desc("event_time"), F.desc("seq"))
    return (rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
            .drop("_n"))


class FeatureState:
    """Rolling features across epochs: the last `window_rows` readings per machine are
    kept in a state table and lead each epoch's rows. The batch operator does the rest,
    so a stream and a batch over the same readings agree, and a heavy machine is cut
    into slices here as well."""

    def __init__(self, spark, path: str, schema, p: Params = DEFAULTS):
        self.p = p
        self.table = lake.StateTable(spark, path, schema)

    def epoch(self, batch: DataFrame, epoch_id: int, score=features.rule_scored) -> DataFrame:
        kept = self.table.before(epoch_id).withColumn(ordered.HALO, F.lit(True))
        rows = batch.select(*KEPT).withColumn(ordered.HALO, F.lit(False)).unionByName(kept)
        self.table.save(last_readings(rows.drop(ordered.HALO), self.p.window_rows), epoch_id)
        return features.feature_alerts(rows, score, self.p)


def feature_alerts(readings: DataFrame, state: FeatureState, checkpoint: str, write,
                   p: Params = DEFAULTS, score=features.rule_scored, **trigger) -> StreamingQuery:
    """Scored rows of each epoch to `write(rows, epoch_id)`."""
    def epoch(batch: DataFrame, epoch_id: int):
        with shared(batch.select(*KEPT)) as rows:
            write(state.epoch(rows, epoch_id, score), epoch_id)
    return start(readings, checkpoint, epoch, p, **trigger)


def ml_alerts(readings: DataFrame, state: FeatureState, bus: Bus, checkpoint: str,
              p: Params = DEFAULTS, score=features.rule_scored, on_count=None,
              **trigger) -> StreamingQuery:
    """Alerts on a change of class, to the alert topic; messages and alerts are counted."""
    def write(rows: DataFrame, epoch_id: int):
        rows, seen = counted(rows, messages=F.count(F.lit(1)),
                             alerts=F.count(F.when(F.col("is_alert"), 1)))
        bus.publish(records.ml_alerts(features.alert_records(rows)), "ml_alerts", epoch_id)
        _report(on_count, epoch_id, seen)
    return feature_alerts(readings, state, checkpoint, write, p, score, **trigger)
