"""Tumbling-window aggregates; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantwatch.functions import rules
from plantwatch.functions.values import rounded
from plantwatch.params import DEFAULTS, Params


def tumbling(df: DataFrame, ts: str, every: str, keys, **aggregates: Column) -> DataFrame:
    """Partial aggregation runs before the shuffle, so a hot machine costs one row
    per task and window. Windows without rows are absent."""
    return (df.groupBy(F.window(ts, every).alias("_w"), *keys)
            .agg(*[a.alias(n) for n, a in aggregates.items()])
            .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                    *keys, *aggregates))


def mean_by_machine(df: DataFrame, measure: str, every: str, ts: str = "event_time") -> DataFrame:
    return tumbling(df, ts, every, ["machine_id"], mean_value=F.avg(measure))


# ---- kept rollups ------------------------------------------------------------------

def partials(df: DataFrame, measures, every: str, ts: str = "event_time") -> DataFrame:
    """Sum, count and maximum per machine, measure and window: what coarser windows, ranges and
    further epochs can be put together from. `event_time` is the start of the window."""
    # All measures of a window are one row until they are summed up.
    sums = {m: F.struct(F.lit(m).alias("measure"), F.sum(F.col(m).cast("double")).alias("total"), F.count(m).alias("n"),
                        F.max(F.col(m).cast("double")).alias("peak")) for m in measures}
    wide = tumbling(df, ts, every, ["machine_id"], **sums)
    return (wide.select("machine_id", F.explode(F.array(*measures)).alias("_m"), F.col("window_start").alias("event_time"))
            .select("machine_id", "_m.*", "event_time").where("n > 0"))


def merged(kept: DataFrame, every: str) -> DataFrame:
    """Mean, maximum and count per window of `every`, a multiple of the kept windows."""
    return (tumbling(kept, "event_time", every, ["machine_id", "measure"],
                     total=F.sum("total"), n=F.sum("n"), max_value=F.max("peak"))
            .withColumn("mean_value", F.col("total") / F.col("n")).drop("total"))


def temperature_mean(readings: DataFrame, every: str) -> DataFrame:
    return mean_by_machine(readings, "temperature", every)


def workload_mean(readings: DataFrame, every: str) -> DataFrame:
    return mean_by_machine(readings, "charge_travail", every)


def failure_probability_max(predictions: DataFrame, every: str) -> DataFrame:
    peaks = tumbling(predictions, "event_time", every, ["machine_id"],
                     max_probability=F.max("probabilite_panne"))
    return peaks.withColumn("band", rules.probability_band("max_probability"))


def anomaly_mean(anomalies: DataFrame, every: str) -> DataFrame:
    return tumbling(anomalies, "event_time", every, ["machine_id", "type_alerte"],
                    mean_value=F.avg("valeur_actuelle"))


def energy_anomalies(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One record per abnormal reading, in the shape of the served measurement."""
    return (readings
            .withColumn("type_alerte", rules.energy_class("consommation_electrique",
                                                          "charge_travail", p))
            .where(F.col("type_alerte").isNotNull())
            .select("machine_id", "type_alerte",
                    rounded("consommation_electrique", 2).alias("valeur_actuelle"),
                    F.lit(p.power_normal).alias("valeur_normale"), "event_time"))


def predictions(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Failure probability per reading by rule, rounded as it is served."""
    return readings.select(
        "machine_id",
        rounded(rules.rule_failure_probability("temperature", "charge_travail", p), 4)
        .alias("probabilite_panne"), "event_time")


def alert_rate(scored: DataFrame) -> DataFrame:
    """Messages, alerts and their ratio."""
    alerts = F.sum(F.col("is_alert").cast("int"))
    return scored.agg(F.count(F.lit(1)).alias("messages"),
                      F.coalesce(alerts, F.lit(0)).alias("alerts"),
                      F.coalesce(F.try_divide(alerts, F.count(F.lit(1))), F.lit(0.0))
                      .alias("alert_rate"))
