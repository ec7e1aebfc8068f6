"""Bus records of every outgoing topic, as key and JSON value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantwatch.functions.decode import encode
from plantwatch.functions.times import iso
from plantwatch.params import DEFAULTS, Params


def energy_alerts(anomalies: DataFrame, detected_at=None) -> DataFrame:
    """`timestamp_detection` is the time of detection; `event_time` stays next to it."""
    detected = F.current_timestamp() if detected_at is None else detected_at
    return encode(anomalies.withColumns({"timestamp_detection": iso(detected),
                                         "event_time": iso("event_time")}),
                  "machine_id", "type_alerte", "valeur_actuelle", "valeur_normale",
                  "timestamp_detection", "event_time")


def ml_alerts(alerts: DataFrame) -> DataFrame:
    return encode(alerts.withColumn("timestamp", iso("event_time")), "machine_id", "action",
                  "timestamp", "temperature", "charge_travail", "severity")


def assignments(assigned: DataFrame) -> DataFrame:
    return encode(assigned.withColumn("timestamp", iso("event_time")), "task_id", "machine_id",
                  "product_name", "quantity", "duration_minutes", "timestamp")


def statuses(rows: DataFrame) -> DataFrame:
    return encode(rows.withColumns({"status": F.col("statut"), "timestamp": iso("event_time")}),
                  "machine_id", "status", "details", "timestamp")


def system_alerts(rows: DataFrame, stamped_at) -> DataFrame:
    """Any columns, with the time of sending added."""
    return encode(rows.withColumn("timestamp", iso(stamped_at)))


def failure_alerts(predictions: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Readings whose failure probability is above the selector's limit."""
    return encode(predictions.where(F.col("probabilite_panne") > p.max_failure_probability)
                  .withColumn("timestamp_detection", iso("event_time")),
                  "machine_id", "probabilite_panne", "timestamp_detection")


def machine_commands(alerts: DataFrame) -> DataFrame:
    """Start and stop orders that follow from alerts."""
    return encode(alerts.where(F.col("action").isin("PAUSE", "ARRETER"))
                  .select("machine_id", "action"), "machine_id", "action")
