"""JSON contracts to typed columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantwatch import schemas
from plantwatch.functions.values import first_number, first_text
from plantwatch.params import DEFAULTS, Params


def parse(df: DataFrame, schema) -> DataFrame:
    """Bus records to contract columns. A broken record yields only NULLs.

    `seq` orders records of equal time: the source's own position where it has
    one, else a hash of the record, which a replay gives again.
    """
    seq = F.col("seq") if "seq" in df.columns else F.xxhash64("value")
    arrived = F.col("arrived_at") if "arrived_at" in df.columns else F.lit(None).cast("timestamp")
    return df.select(F.from_json(F.col("value").cast("string"), schema).alias("d"),
                     seq.alias("seq"), arrived.alias("arrived_at")).select(
        "d.*", "seq", "arrived_at")


def event_time(ts="timestamp") -> Column:
    return F.try_to_timestamp(F.col(ts))


def _timed(df: DataFrame) -> DataFrame:
    """Event time, or else the time of arrival where the source tells it."""
    return df.withColumn("event_time", F.coalesce(event_time(), "arrived_at")).drop("arrived_at")


def sensors(df: DataFrame) -> DataFrame:
    """Typed readings with event time and partition keys; no machine, no row."""
    return (_timed(parse(df, schemas.SENSOR)).where(F.col("machine_id").isNotNull())
            .withColumns({"year": F.year("event_time"), "month": F.month("event_time"),
                          "day": F.dayofmonth("event_time")}))


def orders(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Production orders in any known spelling; `rejected` marks those without id."""
    priority = F.coalesce(first_text("priority"), F.lit("NORMALE")) if p.honour_priority \
        else F.lit("NORMALE")
    task_id = first_text("task_id", "id", "tache_id")
    return _timed(parse(df, schemas.ORDER)).select(
        task_id.alias("task_id"),
        first_text("product_name", "produit", "product").alias("product_name"),
        first_number("quantity", "quantite", "qty", default=0).alias("quantity"),
        first_number("duration_minutes", "duree_minutes", "duration",
                     default=p.default_duration, limit=2.0 ** 31).cast("int")
        .alias("duration_minutes"),
        priority.alias("priority"), "event_time", "seq", task_id.isNull().alias("rejected"),
    )


def queue_rows(orders_df: DataFrame) -> DataFrame:
    """Accepted orders as new queue rows."""
    return orders_df.where(~F.col("rejected")).drop("rejected").withColumn(
        "requeue_seq", F.lit(None).cast("long"))


def alerts(df: DataFrame) -> DataFrame:
    return (_timed(parse(df, schemas.ML_ALERT)).where(F.col("machine_id").isNotNull())
            .withColumn("source", F.lit("ml")))


def rejects(orders_df: DataFrame, *flows: DataFrame) -> DataFrame:
    """Raw records that no job takes, with the reason: orders without an id, alert and
    maintenance records without a machine or with an unknown action."""
    raw = F.col("value").cast("string").alias("raw")

    def read(df, schema, reason):
        arrived = F.col("arrived_at") if "arrived_at" in df.columns \
            else F.lit(None).cast("timestamp")
        rows = df.select(raw, arrived.alias("arrived_at"),
                         F.from_json(F.col("value").cast("string"), schema).alias("d"))
        return rows.select("raw", F.coalesce(event_time("d.timestamp"), "arrived_at")
                           .alias("event_time"), reason.alias("reason")).where("reason IS NOT NULL")

    no_id = F.when(first_text("d.task_id", "d.id", "d.tache_id").isNull(), "order without id")
    rows = read(orders_df, schemas.ORDER, no_id)
    for df, schema, actions in zip(flows, (schemas.ML_ALERT, schemas.MAINTENANCE_ACTION),
                                   (schemas.ACTIONS, schemas.MAINTENANCE_ACTIONS)):
        known = F.coalesce(F.col("d.action").isin(*actions), F.lit(False))
        reason = (F.when(F.col("d.machine_id").isNull(), "event without machine")
                  .when(~known, "unknown action"))
        rows = rows.unionByName(read(df, schema, reason))
    return rows


def maintenance(df: DataFrame) -> DataFrame:
    return (_timed(parse(df, schemas.MAINTENANCE_ACTION)).where(F.col("machine_id").isNotNull())
            .withColumn("source", F.lit("maintenance")))


def encode(df: DataFrame, *columns: str, key: str | None = "machine_id") -> DataFrame:
    """Rows to bus records: JSON value, keyed so that one machine stays in order."""
    names = list(columns) or df.columns
    value = F.to_json(F.struct(*names)).alias("value")
    if key and key in df.columns:
        return df.select(F.col(key).cast("string").alias("key"), value)
    return df.select(value)
