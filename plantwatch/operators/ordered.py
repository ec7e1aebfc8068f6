"""Ordered work per key that stays parallel when one key holds most of the rows.

`arrange` looks at the row counts per key. Where every key is small, the frame
is left alone and a plain window per key does. Keys above `rows_per_slice` are
cut along the order into slices of about that size, and each slice gets the few
earlier rows it needs as `_halo` rows. Windows then run per (key, slice), and
`finish` drops the halo. The result is the same row by row. A frame without keys
is dealt in ranges of its order instead, one slice each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plantwatch.functions.times import micros
from plantwatch.params import DEFAULTS, Params
from plantwatch.session import stored

SLICE, HALO, POS = "_slice", "_halo", "_pos"
WHOLE = -1  # slice id of keys that are not cut


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: tuple
    order: tuple
    cut: bool

    @property
    def partition(self) -> list:
        return [*self.keys, SLICE] if self.cut else list(self.keys)

    @property
    def window(self):
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    @property
    def so_far(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self):
        return self.window.rowsBetween(Window.unboundedPreceding, -1)

    def last_rows(self, n: int):
        return self.window.rowsBetween(1 - n, 0)

    def finish(self, df: DataFrame) -> DataFrame:
        if HALO in df.columns:
            df = df.where(~F.col(HALO))
        return df.drop(HALO, SLICE)


def _position(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    value = micros(name) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(name)
    return F.coalesce(value.cast("double"), F.lit(float("-inf")))


def _splits(df: DataFrame, n: int) -> tuple[list, list]:
    """Split points of `_pos` into about n equal parts, and the values that repeat."""
    points = df.approxQuantile(POS, [i / n for i in range(1, n)], 1.0 / (4 * n))
    repeated = sorted({a for a, b in zip(points, points[1:]) if a == b and math.isfinite(a)})
    return sorted({x for x in points if math.isfinite(x)}), repeated


def _bucket(df: DataFrame, splits: list, out: str) -> DataFrame:
    inf = float("inf")
    if not splits:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=[-inf, *splits, inf], inputCol=POS, outputCol=out,
                      handleInvalid="keep").transform(df)


def _cut(df: DataFrame, order, rows: int, hot: Column | None, p: Params) -> DataFrame:
    """Add `_slice`, rising along the order, to the hot rows."""
    n = max(2, min(p.max_slices, math.ceil(rows / p.rows_per_slice)))
    placed = df.withColumn(POS, _position(df, order[0]))
    hot_rows = placed if hot is None else placed.where(hot)
    splits, repeated = _splits(hot_rows, n)
    # A value that alone fills more than one part gets a slice of its own, which
    # is cut once more along the second order column.
    above = [math.nextafter(v, math.inf) for v in repeated]
    placed = _bucket(placed, sorted({*splits, *above}), "_major")
    minor = F.lit(0.0)
    if repeated and len(order) > 1:
        placed = placed.withColumn("_tied", F.col(POS).isin(repeated)).withColumn(
            POS, _position(df, order[1]))
        tied = placed.where(F.col("_tied") if hot is None else F.col("_tied") & hot)
        placed = _bucket(placed, _splits(tied, n)[0], "_minor")
        minor = F.when(F.col("_tied"), F.col("_minor")).otherwise(0.0)
    slice_id = (F.col("_major") * (p.max_slices + 1) + minor).cast("long")
    if hot is not None:
        slice_id = F.when(hot, slice_id).otherwise(F.lit(WHOLE))
    return placed.withColumn(SLICE, slice_id.cast("long")).drop(
        POS, "_major", "_minor", "_tied")


def heavy_keys(df: DataFrame, keys, p: Params = DEFAULTS) -> list:
    """Keys above the slice size, with their counts; at most `max_listed_keys` + 1."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") > p.rows_per_slice)
            .limit(p.max_listed_keys + 1).collect())


def sliced(df: DataFrame, keys, order, p: Params = DEFAULTS) -> Ordered:
    """Cut heavy keys (or, without keys, the whole frame) into slices along the order.

    Without keys a slice is a range of one shuffle by range, at every size; the ranges are
    written once, so that a row keeps its slice. With keys the input is read for its row
    counts, and again for the result: an input that is expensive to compute should be stored
    as a table before.
    """
    keys, order = tuple(keys), tuple(order)
    if not keys:
        ranges = df.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id().cast("long"))
        return Ordered(stored(ranges, "ranges"), keys, order, True)
    heavy = heavy_keys(df, keys, p)
    if not heavy:
        return Ordered(df, keys, order, False)
    if len(heavy) > p.max_listed_keys:
        # Too many heavy keys to list: cut every key along the same points.
        return Ordered(_cut(df, order, df.count(), None, p), keys, order, True)
    listed = df.sparkSession.createDataFrame(
        [tuple(r[k] for k in keys) + (True,) for r in heavy],
        T.StructType([df.schema[k] for k in keys] + [T.StructField("_hot", T.BooleanType())]))
    # Broadcast is safe: the list holds at most max_listed_keys rows.
    match = [df[k].eqNullSafe(listed[k]) for k in keys]
    marked = df.join(F.broadcast(listed), match, "left").select(
        *[df[c] for c in df.columns], F.coalesce(listed["_hot"], F.lit(False)).alias("_hot"))
    rows = sum(r["_rows"] for r in heavy)
    cut = _cut(marked, order, rows, F.col("_hot"), p).drop("_hot")
    return Ordered(cut, keys, order, True)


def _payload(df: DataFrame, order) -> list:
    return [*order, *[c for c in df.columns if c not in order and c != SLICE]]


def _with_rows(o: Ordered, halo: DataFrame) -> Ordered:
    df = o.df if HALO in o.df.columns else o.df.withColumn(HALO, F.lit(False))
    halo = (halo.select(SLICE, F.explode("_kept").alias("_row")).select("_row.*", SLICE)
            .withColumn(HALO, F.lit(True)).select(*df.columns))
    return Ordered(df.unionByName(halo), o.keys, o.order, True)


def with_previous(o: Ordered, n: int) -> Ordered:
    """Give each slice the n rows before it."""
    if not o.cut:
        return o
    hot = o.df.where(F.col(SLICE) != WHOLE)
    fields = _payload(o.df, o.order)
    tail_window = Window.partitionBy(*o.partition).orderBy(*[F.col(c).desc() for c in o.order])
    tails = (hot.withColumn("_n", F.row_number().over(tail_window)).where(F.col("_n") <= n)
             .groupBy(*o.partition)
             .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_tail")))
    # Slices in this table are never empty, so n of them hold the last n rows.
    earlier = Window.partitionBy(*o.keys).orderBy(SLICE).rowsBetween(-n, -1)
    rows = F.flatten(F.collect_list("_tail").over(earlier))
    kept = F.slice(rows, F.greatest(F.size(rows) - n, F.lit(0)) + 1, F.lit(n))
    return _with_rows(o, tails.withColumn("_kept", kept))


def with_latest(o: Ordered, conditions: list) -> Ordered:
    """Give each slice the latest earlier row that meets each condition."""
    if not o.cut:
        return o
    hot = o.df.where(F.col(SLICE) != WHOLE)
    fields = _payload(o.df, o.order)
    row, at = F.struct(*fields), F.struct(*o.order)
    latest = hot.groupBy(*o.partition).agg(*[
        F.max_by(F.when(c, row), F.when(c, at)).alias(f"_c{i}") for i, c in enumerate(conditions)])
    earlier = Window.partitionBy(*o.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.array_compact(F.array_distinct(F.array(*[
        F.last(F.col(f"_c{i}"), ignorenulls=True).over(earlier) for i in range(len(conditions))])))
    return _with_rows(o, latest.withColumn("_kept", carried))


def running_sums(o: Ordered, **values: Column) -> DataFrame:
    """Running totals of `values` along the order, exact across slices."""
    df = o.df.withColumns(values)
    local = {out: F.sum(out).over(o.so_far) for out in values}
    if not o.cut:
        return df.withColumns(local)
    # One row of totals per (key, slice): small, so its window per key is cheap.
    earlier = Window.partitionBy(*o.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*o.partition).agg(*[F.sum(out).alias(out) for out in values]).select(
        *[F.col(c).alias(f"_k_{c}") for c in o.partition],
        *[F.coalesce(F.sum(out).over(earlier), F.lit(0)).alias(f"_o_{out}") for out in values])
    match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in o.partition]
    summed = df.withColumns(local).join(offsets, match)
    return summed.select(*[
        (F.col(c) + F.when(F.col(SLICE) == WHOLE, F.lit(0)).otherwise(F.col(f"_o_{c}"))).alias(c)
        if c in values else F.col(c) for c in df.columns])


def rank_rows(df: DataFrame, order, out: str = "rank", keys=(), p: Params = DEFAULTS) -> DataFrame:
    """1, 2, 3, … along `order` (which must be unique) without a single-task sort."""
    o = sliced(df, keys, order, p)
    if not o.cut:
        return df.withColumn(out, F.row_number().over(o.window).cast("long"))
    return running_sums(o, **{out: F.lit(1).cast("long")}).drop(SLICE)


def arrange(df: DataFrame, keys, order, previous: int = 0, latest: list | None = None,
            p: Params = DEFAULTS) -> Ordered:
    o = sliced(df, keys, order, p)
    if previous:
        o = with_previous(o, previous)
    if latest:
        o = with_latest(o, latest)
    return o
