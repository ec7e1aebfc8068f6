"""Rolling features against plain numpy, labels and change alerts on edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch import schemas
from plantwatch.operators import features


def by_hand(rows):
    """The vector of the last of `rows` (five measures each, at most twelve rows)."""
    vib, temp, pres, power, load = np.array(rows, dtype=float).T
    n = len(rows)

    def slope(y):
        return np.polyfit(np.arange(n), y, 1)[0] if n > 1 else 0.0
    return [vib[-1], temp[-1], pres[-1], power[-1], load[-1], vib.mean(), temp.mean(), vib.std(),
            pres.std(), slope(temp), slope(vib), temp.max()]


@pytest.mark.parametrize("n", [1, 2, 11, 12, 13, 30])
def test_vector(spark, n):
    rng = np.random.default_rng(0)
    rows = [[float(x) for x in (rng.uniform(0.5, 3.5), rng.uniform(55, 95), rng.uniform(3.5, 6.5),
                                rng.uniform(80, 150), rng.uniform(20, 95))] for _ in range(n)]
    df = spark.createDataFrame(
        [("M", i, 7, *r) for i, r in enumerate(rows)],
        "machine_id string, seq long, t int, vibration double, temperature double, "
        "pression double, consommation_electrique double, charge_travail double")
    # all rows share one time: the sequence number decides
    df = df.withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    got = {r.seq: [r[f] for f in schemas.FEATURES]
           for r in features.rolling_features(df).collect()}
    for i in range(n):
        assert got[i] == pytest.approx(by_hand(rows[max(0, i - 11):i + 1]), rel=1e-6, abs=1e-6)


def test_constant_series(spark):
    df = spark.range(20).select(
        F.lit("M").alias("machine_id"), F.col("id").alias("seq"),
        F.lit("2024-01-01").cast("timestamp").alias("event_time"),
        *[F.lit(5.0).alias(m) for m in schemas.MEASURES])
    for r in features.rolling_features(df).collect():
        assert r.temp_slope == 0 and r.vib_slope == 0 and r.vib_std == 0 and r.temp_max == 5


def test_single_reading(spark):
    df = spark.createDataFrame([(None, 100.0, 1.0, 80.0, 4.0)], ", ".join(
        f"{m} double" for m in schemas.MEASURES))
    row = features.single_reading_features(df).first()
    assert [row[f] for f in schemas.FEATURES] == [
        1.0, 80.0, 4.0, 100.0, 0.0, 1.0, 80.0, 0.0, 0.0, 0.0, 0.0, 80.0]


def test_change_alerts(spark):
    classes = [0, 1, 1, 2, 1, 0, 0, 2]
    df = spark.createDataFrame([("M", i, c) for i, c in enumerate(classes)],
                               "machine_id string, seq long, class_id int")
    df = df.withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    marked = features.changed_class(df).where("is_alert").orderBy("seq").collect()
    assert [r.seq + 1 for r in marked] == [2, 4, 5, 8]


def test_horizon_labels(spark):
    cases = [(None, 5, 0), (10, 4, 2), (10, 3, 1), (100, 77, 0), (20, 2, 1), (20, 1, 0)]
    df = spark.createDataFrame([(f, t, w) for f, t, w in cases], "f int, t int, want int")
    for r in df.withColumn("got", features.horizon_label("f", "t")).collect():
        assert r.got == r.want


def test_transitions(spark):
    rows = [("ASSIGNEE", "a"), ("ASSIGNEE", "b"), ("PAUSE", "b"), ("ASSIGNEE", "b"),
            ("ARRET", "b"), ("ARRET", None), ("DISPONIBLE", None)]
    df = spark.createDataFrame([("M", i, *r) for i, r in enumerate(rows)],
                               "machine_id string, seq long, statut string, task_id string")
    df = df.withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    got = sorted((r.seq, r.event, r.task_id) for r in features.status_transitions(df).collect())
    assert got == [(0, "PULLED", "a"), (1, "PULLED", "b"), (2, "SHIPPED", "b"),
                   (3, "PULLED", "b"), (4, "BREAKDOWN", None), (4, "SHIPPED", "b")]
