"""Read views of the floor: machines, tasks in progress and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantwatch.functions import rules
from plantwatch.functions.times import instant, micros, seconds_between
from plantwatch.functions.values import rounded
from plantwatch.operators.fleet import machines_by_status
from plantwatch.operators.latest import latest, latest_fields, latest_status, latest_task, lookback
from plantwatch.operators.work import merge_counters
from plantwatch.params import DEFAULTS, Params


def floor_view(roster: DataFrame, status: DataFrame, readings: DataFrame, pauses: DataFrame,
               assignments: DataFrame, as_of, p: Params = DEFAULTS) -> DataFrame:
    """One row per machine: status, metrics, running task with progress, pause clock.

    Four scans with map-side combine and joins of one row per machine replace
    four point queries per machine.
    """
    now = instant(status, "event_time", as_of)
    state = latest_status(status, as_of, p.floor_status_lookback).select("machine_id", "statut")
    metrics = latest_fields(
        lookback(readings, "event_time", as_of, p.floor_metrics_lookback),
        ["machine_id"], ["temperature", "charge_travail"], "event_time")
    pause = (latest(lookback(pauses, "event_time", as_of, p.floor_pause_lookback),
                    ["machine_id"], "event_time", [])
             .withColumnRenamed("event_time", "pause_start"))
    task = (latest_task(assignments, as_of, p.floor_task_lookback)
            .withColumnRenamed("event_time", "task_start").drop("quantity"))
    df = roster.select("machine_id", "pos")
    for side in (state, metrics, pause, task):
        df = df.join(side, "machine_id", "left")
    # What a machine shows without data.
    df = df.withColumns({"statut": F.coalesce("statut", F.lit("DISPONIBLE")),
                         "temperature": F.coalesce("temperature", F.lit(45.0)),
                         "charge_travail": F.coalesce("charge_travail", F.lit(25.0))})
    running = F.col("statut") == "ASSIGNEE"
    length = F.col("duration_minutes") * 60.0
    timed = running & (length > 0) & F.col("task_start").isNotNull()
    elapsed = seconds_between("task_start", now)
    return df.select(
        "machine_id", "pos", F.col("statut").alias("status"),
        rules.status_label("statut").alias("status_label"),
        rounded("temperature", 1).alias("temperature"),
        rounded("charge_travail", 1).alias("charge"),
        F.when(timed, F.col("task_id")).alias("task"),
        F.when(timed, F.col("product_name")).alias("product"),
        F.when(timed, rules.unit_progress(elapsed, length)).alias("progress"),
        F.when(running, micros("task_start") / 1e6).alias("task_started"),
        F.when(running & (length > 0), length.cast("long")).alias("task_duration"),
        F.when(timed, F.greatest(F.lit(0), (length - elapsed).cast("long")))
        .alias("task_time_remaining"),
        F.when(F.col("statut") == "PAUSE", rules.pause_seconds_left("pause_start", now, p))
        .cast("long").alias("time_remaining"))


def tasks_view(assignments: DataFrame, as_of, p: Params = DEFAULTS) -> DataFrame:
    """The newest task of each machine that got one lately."""
    return (latest_task(assignments, as_of, p.tasks_lookback)
            .select(F.col("task_id").alias("id"), F.col("machine_id").alias("machine"),
                    F.coalesce("product_name", F.lit("N/A")).alias("product"),
                    F.coalesce("duration_minutes", F.lit(0)).alias("duration")))


def queue_size(stats: DataFrame, as_of, p: Params = DEFAULTS) -> DataFrame:
    """Latest queue size, zero when nothing was written lately."""
    recent = lookback(stats, "event_time", as_of, p.stats_lookback)
    return recent.agg(F.coalesce(F.max_by("in_queue", F.struct("event_time", "seq")), F.lit(0))
                      .alias("queue_size"))


KPI = ["total", "completed", "interrupted", "in_queue", "pauses_expired", "emergency_returns",
       "repairs"]


def kpi_view(status: DataFrame, stats: DataFrame, as_of, p: Params = DEFAULTS) -> DataFrame:
    """Machine counts per status next to the latest counters."""
    buckets = machines_by_status(latest_status(status, as_of, p.floor_status_lookback))
    machines = buckets.groupBy().pivot(
        "statut", ["DISPONIBLE", "ASSIGNEE", "PAUSE", "ARRET", "IDLE"]).agg(F.max("machines"))
    machines = machines.toDF(*[c.lower() for c in machines.columns])
    recent = lookback(stats, "event_time", as_of, p.stats_lookback)
    counters = recent.agg(F.max_by(F.struct(*KPI), F.struct("event_time", "seq")).alias("k"))
    counters = counters.select(*[F.coalesce(f"k.{c}", F.lit(0)).alias(c) for c in KPI])
    return merge_counters(machines, counters)
