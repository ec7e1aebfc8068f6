"""Latest-value lookups: one pass with map-side combine instead of point queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantwatch import schemas
from plantwatch.functions.times import instant, span
from plantwatch.operators.ordered import arrange
from plantwatch.params import DEFAULTS, Params


def lookback(df: DataFrame, ts: str, as_of, length: str | None) -> DataFrame:
    """Rows of the last `length` before `as_of`; the bounds reach the scan."""
    now = instant(df, ts, as_of)
    recent = F.col(ts) <= now
    if length:
        recent &= F.col(ts) > now - span(length)
    return df.where(recent)


def between(df: DataFrame, ts: str, start, stop) -> DataFrame:
    return df.where((F.col(ts) >= instant(df, ts, start)) & (F.col(ts) < instant(df, ts, stop)))


def latest(df: DataFrame, keys, ts: str, columns, seq: str = "seq") -> DataFrame:
    """The newest row per key; equal times are decided by `seq`."""
    newest = F.max_by(F.struct(ts, *columns), F.struct(ts, seq))
    if not keys:
        return df.agg(newest.alias("_row")).select("_row.*")
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def latest_status(status: DataFrame, as_of, length: str | None) -> DataFrame:
    return latest(lookback(status, "event_time", as_of, length),
                  ["machine_id"], "event_time", ["statut"])


def to_tall(df: DataFrame, keys, fields) -> DataFrame:
    """One (field, value) record per measure; a NULL measure leaves no record."""
    return df.unpivot(list(keys), list(fields), "field", "value").where(F.col("value").isNotNull())


def to_wide(tall: DataFrame, keys, fields, ts: str, seq: str = "seq") -> DataFrame:
    """Latest value per field as columns."""
    return (tall.groupBy(*keys).pivot("field", list(fields))
            .agg(F.max_by("value", F.struct(ts, seq))))


def latest_fields(df: DataFrame, keys, fields, ts: str, seq: str = "seq") -> DataFrame:
    """As `to_wide(to_tall(..))`, but without multiplying the rows: each field's
    newest non-NULL value in one aggregation."""
    at = F.struct(ts, seq)
    return df.groupBy(*keys).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def latest_task(assignments: DataFrame, as_of, length: str | None) -> DataFrame:
    """The newest assignment per machine with its attributes, without a join."""
    return latest(lookback(assignments, "event_time", as_of, length), ["machine_id"],
                  "event_time", ["task_id", "product_name", "quantity", "duration_minutes"])


def asof_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str,
              values: list[str], tolerance: str | None = None, left_seq: str = "seq",
              right_seq: str = "seq", prefix: str = "", p: Params = DEFAULTS) -> DataFrame:
    """Each left row with the newest right row not later than it, and within `tolerance`.

    Both sides go through one shuffle by key as a single ordered frame; the
    newest right row so far is a running value, so no pairs are formed.
    """
    # The key stays a column of its own, so that later work per key needs no new shuffle.
    left_row = F.struct(*[c for c in left.columns if c not in (on, left_ts)])
    right_row = F.struct(F.col(right_ts).alias("_at"), *values)
    rows = (
        right.select(F.col(on).alias("_on"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"),
                     F.col(right_seq).cast("long").alias("_seq"), right_row.alias("_right"))
        .unionByName(
            left.select(F.col(on).alias("_on"), F.col(left_ts).alias("_ts"),
                        F.lit(1).alias("_side"), F.col(left_seq).cast("long").alias("_seq"),
                        left_row.alias("_left")), allowMissingColumns=True))
    o = arrange(rows, ["_on"], ["_ts", "_side", "_seq"], latest=[F.col("_side") == 0], p=p)
    found = o.df.withColumn("_found", F.last("_right", ignorenulls=True).over(o.so_far))
    match: Column = F.col("_found")
    if tolerance:
        match = F.when(F.col("_found._at") > F.col("_ts") - span(tolerance), F.col("_found"))
    return (o.finish(found).where(F.col("_side") == 1)
            .select(F.col("_on").alias(on), F.col("_ts").alias(left_ts), "_left.*",
                    match.alias("_match"))
            .select(*left.columns, F.col("_match._at").alias(f"{prefix}{right_ts}"),
                    *[F.col(f"_match.{v}").alias(f"{prefix}{v}") for v in values]))


def fill_serving(df: DataFrame) -> DataFrame:
    """Defaults of a served reading: empty text and zero."""
    return df.withColumns({
        "etat": F.coalesce("etat", F.lit("")),
        **{m: F.coalesce(m, F.lit(0.0)) for m in schemas.MEASURES}})

