"""Rolling features per machine, change alerts, transitions and horizon labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantwatch import schemas
from plantwatch.functions import rules
from plantwatch.functions.times import micros
from plantwatch.functions.values import rounded
from plantwatch.operators.ordered import Ordered, arrange, rank_rows
from plantwatch.params import DEFAULTS, Params

ORDER = ("event_time", "seq")


def _rolling(o: Ordered, p: Params) -> DataFrame:
    recent = o.last_rows(p.window_rows)
    df = o.df.withColumn("_i", F.row_number().over(o.window).cast("double"))

    def slope(measure: str) -> Column:
        fitted = F.regr_slope(measure, "_i").over(recent)
        return F.when(F.count(measure).over(recent) > 1, fitted).otherwise(0.0)

    return df.withColumns({
        "vib_mean": F.avg("vibration").over(recent),
        "temp_mean": F.avg("temperature").over(recent),
        "vib_std": F.stddev_pop("vibration").over(recent),
        "pres_std": F.stddev_pop("pression").over(recent),
        "temp_slope": slope("temperature"),
        "vib_slope": slope("vibration"),
        "temp_max": F.max("temperature").over(recent),
    }).drop("_i")


def rolling_features(readings: DataFrame, key: str = "machine_id", order=ORDER,
                     p: Params = DEFAULTS) -> DataFrame:
    """The twelve-number vector of each reading from its last `window_rows` readings.

    Rows that already carry `_halo` = true (kept state of a stream) feed the
    windows and are dropped from the result.
    """
    o = arrange(readings, [key], order, previous=p.window_rows - 1, p=p)
    return o.finish(_rolling(o, p))


def single_reading_features(readings: DataFrame) -> DataFrame:
    """The vector a lone reading gives: means and maximum are the values, the rest zero."""
    filled = {m: F.coalesce(m, F.lit(0.0)) for m in schemas.MEASURES}
    zero = F.lit(0.0)
    return readings.withColumns(filled).withColumns({
        "vib_mean": F.col("vibration"), "temp_mean": F.col("temperature"),
        "vib_std": zero, "pres_std": zero, "temp_slope": zero, "vib_slope": zero,
        "temp_max": F.col("temperature")})


def rule_scored(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    cls = rules.risk_class("temperature", "charge_travail", p)
    return readings.withColumn("class_id", cls).withColumns({
        "label": rules.class_label("class_id"),
        "confidence": rules.class_confidence("class_id")})


def changed_class(scored: DataFrame, cls: str = "class_id", key: str = "machine_id",
                  order=ORDER, p: Params = DEFAULTS) -> DataFrame:
    """Previous class (0 at first) and whether this reading raises an alert."""
    return _mark_changes(arrange(scored, [key], order, previous=1, p=p), cls)


def _mark_changes(o: Ordered, cls: str) -> DataFrame:
    prev = F.lag(cls, 1, 0).over(o.window)
    df = o.df.withColumn("previous_class", prev).withColumn(
        "is_alert", (F.col(cls) != F.col("previous_class")) & (F.col(cls) > 0))
    return o.finish(df)


def feature_alerts(readings: DataFrame, score=rule_scored, p: Params = DEFAULTS) -> DataFrame:
    """Features, class and change mark in one ordered pass.

    Each slice gets `window_rows` earlier rows: the last of them has a whole
    window, so its class is right and can be compared with.
    """
    o = arrange(readings, ["machine_id"], ORDER, previous=p.window_rows, p=p)
    scored = score(_rolling(o, p))
    return _mark_changes(Ordered(scored, o.keys, o.order, o.cut), "class_id")


def alert_records(scored: DataFrame) -> DataFrame:
    """Alerts in bus shape, from scored rows marked by change detection."""
    return scored.where("is_alert").select(
        "machine_id", rules.class_action("class_id").alias("action"),
        rounded("temperature", 2).alias("temperature"),
        rounded("charge_travail", 2).alias("charge_travail"),
        rules.class_severity("class_id").alias("severity"), "event_time", "seq")


def status_transitions(snapshots: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Shipped, pulled and breakdown events between consecutive snapshots of a machine.

    A task counts only while its machine is running, so the task before is that
    of the snapshot before if the machine was running then.
    """
    running = F.col("statut") == "ASSIGNEE"
    rows = snapshots.withColumn("_task", F.when(running, F.col("task_id")))
    o = arrange(rows, ["machine_id"], ORDER, previous=1, p=p)
    prev, prev_task = F.lag("statut").over(o.window), F.lag("_task").over(o.window)
    df = o.df.withColumns({"previous_statut": prev, "previous_task": prev_task})
    was = F.col("previous_statut")
    events = F.array_compact(F.array(
        F.when((was == "ASSIGNEE") & ~running & F.col("previous_task").isNotNull(),
               F.lit("SHIPPED")),
        F.when(running & F.col("_task").isNotNull()
               & ~F.col("_task").eqNullSafe(F.col("previous_task")), F.lit("PULLED")),
        F.when((F.col("statut") == "ARRET") & was.isNotNull() & (was != "ARRET"),
               F.lit("BREAKDOWN"))))
    return (o.finish(df.withColumn("event", events))
            .withColumn("event", F.explode("event"))
            .select("machine_id", "event_time", "seq", "previous_statut", "statut", "event",
                    F.when(F.col("event") == "SHIPPED", F.col("previous_task"))
                    .when(F.col("event") == "PULLED", F.col("_task")).alias("task_id")))


# ---- run-to-failure labels ------------------------------------------------

def episode_steps(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Readings numbered 0, 1, 2, … within their episode."""
    ranked = rank_rows(readings, ORDER, "step", ["episode_id"], p)
    return ranked.withColumn("step", F.col("step") - 1)


def horizon_label(failure_step, step, p: Params = DEFAULTS) -> Column:
    left = F.col(failure_step) - F.col(step)
    return (F.when(left <= p.critical_horizon, 2).when(left <= p.warning_horizon, 1)
            .otherwise(0))


def labelled(steps: DataFrame, failures: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Steps with their episode's failure step (if any) and horizon class.

    `failures` has one row per failed episode. Rows after the failure are not
    part of the episode.
    """
    joined = steps.join(failures, "episode_id", "left")
    return (joined.where(F.col("failure_step").isNull() | (F.col("step") <= F.col("failure_step")))
            .withColumn("label", horizon_label("failure_step", "step", p)))


def next_failure(readings: DataFrame, failed: Column, p: Params = DEFAULTS) -> DataFrame:
    """Time of the first failure at or after each reading, for logs without episodes.

    Walks the log backwards as a running value, so heavy machines stay cut.
    """
    back = (readings.withColumns({"_back": -micros("event_time"), "_bseq": -F.col("seq"),
                                  "_fail": F.when(failed, F.col("event_time"))}))
    o = arrange(back, ["machine_id"], ["_back", "_bseq"],
                latest=[F.col("_fail").isNotNull()], p=p)
    df = o.df.withColumn("failure_time", F.last("_fail", ignorenulls=True).over(o.so_far))
    return o.finish(df).drop("_back", "_bseq", "_fail")


def class_balance(labels: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class and the balanced class weight n / (k * n_class)."""
    every = Window.partitionBy()  # over one row per class
    return (labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("weight", F.sum("n").over(every)
                        / (F.count(F.lit(1)).over(every) * F.col("n"))))


def dataset_summary(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count(F.lit(1)).alias("samples"),
                      F.count_distinct("episode_id").alias("episodes"))
