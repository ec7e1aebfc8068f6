"""Thresholds exactly on the line, NULL, NaN and broken records."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plantwatch.functions import decode, rules, times, values
from plantwatch.operators import rollups
from plantwatch.params import DEFAULTS

NAN = float("nan")


def values_of(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_energy_class(spark):
    rows = [(135.0, 50.0), (135.01, 50.0), (120.0, 10.0), (120.01, 29.99), (120.01, 30.0),
            (120.01, None), (None, 10.0), (NAN, 10.0), (130.0, NAN), (136.0, None)]
    assert values_of(spark, rows, "p double, c double", rules.energy_class("p", "c")) == [
        None, "surconsommation", None, "fuite", None, None, None, None, None, "surconsommation"]


def test_risk_class_and_probability(spark):
    rows = [(90.0, 90.0), (90.01, 0.0), (0.0, 90.01), (75.0, 70.0), (75.01, 0.0), (0.0, 70.01),
            (None, None), (None, 95.0), (NAN, 0.0)]
    cls = values_of(spark, rows, "t double, c double", rules.risk_class("t", "c"))
    assert cls == [1, 2, 2, 0, 1, 1, 0, 2, 0]
    p = values_of(spark, rows, "t double, c double", rules.rule_failure_probability("t", "c"))
    assert p == [{0: 0.05, 1: 0.6, 2: 0.95}[c] for c in cls]


def test_class_fields(spark):
    row = spark.range(3).select(
        F.collect_list(rules.class_label(F.col("id").cast("int"))),
        F.collect_list(rules.class_action(F.col("id").cast("int"))),
        F.collect_list(rules.class_severity("id")),
        F.collect_list(rules.class_confidence(F.col("id").cast("int")))).first()
    assert [set(c) for c in row] == [
        {"aucune", "pause_requise", "maintenance_requise"}, {"CONTINUER", "PAUSE", "ARRETER"},
        {"MOYENNE", "HAUTE"}, {0.99, 0.85, 0.95}]


def test_bands_and_minutes(spark):
    assert values_of(spark, [(0.59,), (0.6,), (0.84,), (0.85,)], "p double",
                     rules.probability_band("p")) == ["green", "orange", "orange", "red"]
    assert values_of(spark, [(0,), (99,), (199,), (250,)], "q long",
                     rules.task_minutes("q")) == [1, 1, 1, 2]


NOW = datetime(2024, 1, 1, 12, 0, 0)


def test_availability_ladder(spark):
    rows = [  # busy until, etat, action, probability, temperature, load
        (datetime(2024, 1, 1, 12, 5, 59), "arrete", None, None, 99.0, 99.0),
        (NOW, "arrete", None, None, 99.0, 99.0),
        (None, "en_marche", "ARRETER", 0.99, 99.0, 99.0),
        (None, None, "PAUSE", 0.71, 99.0, 99.0),
        (None, None, "PAUSE", 0.7, 90.01, 99.0),
        (None, None, None, None, 90.0, 80.5),
        (None, None, "CONTINUER", 0.0, 90.0, 80.0),
        (None, None, None, None, None, None)]
    verdict = rules.availability(
        {k: F.col(k) for k in ("busy_until", "etat", "action", "probability", "temperature",
                               "load")}, F.lit(NOW))
    got = values_of(spark, rows, "busy_until timestamp, etat string, action string, "
                    "probability double, temperature double, load double", verdict)
    assert [(r.available, r.reason) for r in got] == [
        (False, "Occupée (encore 5 min)"), (False, "Machine arrêtée"),
        (False, "ML recommande ARRÊT"), (False, "Probabilité panne élevée (71%)"),
        (False, "Température trop élevée (90.01°C)"), (False, "Charge trop élevée (80.5%)"),
        (True, "Disponible"), (True, "Disponible")]


def test_task_clock(spark):
    rows = [(datetime(2024, 1, 1, 11, 55), 10), (datetime(2024, 1, 1, 11, 50), 10),
            (datetime(2024, 1, 1, 11, 0), 10), (None, 10), (NOW, 0)]
    df = "s timestamp, d int"
    assert values_of(spark, rows, df, rules.task_progress("s", "d", F.lit(NOW))) == [
        0.5, 1.0, 1.0, 0.0, 1.0]
    assert values_of(spark, rows, df, rules.task_done("s", "d", F.lit(NOW))) == [
        False, True, True, False, True]
    assert values_of(spark, rows, df, rules.task_minutes_left("s", "d", F.lit(NOW))) == [
        5.0, 0.0, 0.0, 10.0, 0.0]


def test_pause_clock(spark):
    rows = [("PAUSE", datetime(2024, 1, 1, 11, 50)), ("PAUSE", datetime(2024, 1, 1, 11, 49, 59)),
            ("ARRETER", datetime(2024, 1, 1, 10, 0))]
    got = values_of(spark, rows, "a string, s timestamp",
                    rules.pause_expired("a", "s", F.lit(NOW)))
    assert got == [False, True, False]
    left = values_of(spark, [(datetime(2024, 1, 1, 11, 59, 30, 500000),), (NOW,),
                             (datetime(2023, 1, 1),), (None,)], "s timestamp",
                     rules.pause_seconds_left("s", F.lit(NOW)))
    assert left == [570, 600, 0, None]  # 600 - 29.5 cut to whole seconds


def test_scores(spark):
    rows = [(80.0, 50.0, None, None), (90.0, 10.0, "CONTINUER", 0.1), (None, None, "PAUSE", 0.5)]
    schema = "t double, c double, a string, p double"
    assert values_of(spark, rows, schema, rules.detailed_score("t", "c", "a", "p")) == \
        pytest.approx([100.0, 20 + 15 - 15 + 1, 0 + 25 + 5])
    assert values_of(spark, rows, schema, rules.simple_score("t", "c")) == pytest.approx(
        [0.48 + 0.2, 0.54 + 0.04, 0.42 + 0.2])


def test_rounding_and_texts(spark):
    assert values_of(spark, [(2.675,), (-2.675,), (0.1 + 0.2 - 0.175,), (None,)], "x double",
                     values.rounded("x", 2)) == [2.68, -2.68, 0.13, None]
    assert values_of(spark, [(0,), (59,), (61,), (600,)], "s int",
                     times.minutes_seconds("s")) == ["0:00", "0:59", "1:01", "10:00"]
    assert values_of(spark, [(-1.0,), (0.5,), (2.0,), (None,)], "x double",
                     values.clamp("x", 0.0, 1.0)) == [0.0, 0.5, 1.0, None]


def test_decode_sensors(spark):
    good = ('{"machine_id":"M","timestamp":"2024-02-03T04:05:06Z","temperature":1.5,'
            '"charge_travail":null}')
    bad = ['nonsense', '{"timestamp":"2024-02-03T04:05:06Z"}',
           '{"machine_id":"N","timestamp":"soon","temperature":"hot","vibration":2.0}']
    df = spark.createDataFrame([(bytearray(v.encode()),) for v in [good, *bad]], "value binary")
    rows = {r.machine_id: r for r in decode.sensors(df).collect()}
    assert set(rows) == {"M", "N"}
    assert (rows["M"].year, rows["M"].month, rows["M"].day) == (2024, 2, 3)
    assert rows["M"].event_time == datetime(2024, 2, 3, 4, 5, 6) and rows["M"].temperature == 1.5
    assert rows["N"].event_time is None and rows["N"].temperature is None
    assert rows["N"].vibration == 2.0


def test_decode_orders(spark):
    messages = [
        '{"tache_id":"a","type_produit":"x","quantite":5}',
        '{"task_id":"","id":"b","produit":"p","quantity":0,"qty":"7","duration":0}',
        '{"task_id":"c","product":"q","duration_minutes":0,"duree_minutes":9.9,"priority":"HAUTE"}',
        '{"product":"nameless"}', 'broken']
    df = spark.createDataFrame([(bytearray(m.encode()),) for m in messages], "value binary")
    got = decode.orders(df).collect()
    assert [(r.task_id, r.product_name, r.quantity, r.duration_minutes, r.priority, r.rejected)
            for r in got] == [
        ("a", None, 5, 60, "NORMALE", False), ("b", "p", 7, 0, "NORMALE", False),
        ("c", "q", 0, 9, "HAUTE", False), (None, "nameless", 0, 60, "NORMALE", True),
        (None, None, 0, 60, "NORMALE", True)]
    assert decode.queue_rows(decode.orders(df)).count() == 3
    ignoring = decode.orders(df, DEFAULTS.but(honour_priority=False)).collect()
    assert {r.priority for r in ignoring} == {"NORMALE"}


def test_encode_round_trip(spark):
    df = spark.createDataFrame([("M", 1.5, None)], "machine_id string, x double, y string")
    row = decode.encode(df).first()
    assert row.key == "M" and row.value == '{"machine_id":"M","x":1.5}'


def test_alert_rate_of_nothing(spark):
    none = spark.createDataFrame([], "is_alert boolean")
    assert tuple(rollups.alert_rate(none).first()) == (0, 0, 0.0)


def test_nan_does_not_fail_rounding(spark):
    got = values_of(spark, [(NAN,)], "x double", values.rounded("x", 2))
    assert got == [None] or math.isnan(got[0])


def test_poison_numbers_do_not_end_a_batch(spark):
    texts = ['{"task_id":"a","quantity":"1e30","duration":3000000000}', '{"task_id":"b","quantity":"NaN","qty":"7"}',
             '{"task_id":"c","quantite":"-Infinity","duration_minutes":"x"}', '{"task_id":"d","quantity":12.9}']
    rows = decode.orders(spark.createDataFrame([(t.encode(),) for t in texts], "value binary")).collect()
    assert [(r.task_id, r.quantity, r.duration_minutes) for r in rows] == [
        ("a", 0, DEFAULTS.default_duration), ("b", 7, DEFAULTS.default_duration),
        ("c", 0, DEFAULTS.default_duration), ("d", 12, DEFAULTS.default_duration)]
    assert values_of(spark, [(1e19,), (0.125,), (None,), (NAN,), (-2e30,)], "v double",
                     values.rounded("v", 2)) == [1e19, 0.13, None, None, -2e30]
    assert values_of(spark, [(2 ** 62,), (None,), (-2 ** 62,)], "q long", rules.task_minutes("q")) == [
        2 ** 31 - 1, 1, 1]


def test_rejects_keep_the_raw_record(spark):
    def topic(*texts):
        return spark.createDataFrame([(t.encode(),) for t in texts], "value binary")
    got = decode.rejects(topic('{"id":"x"}', '{"qty":1}', "broken"), topic('{"machine_id":"m","action":"PAUSE"}', '{"action":"PAUSE"}'),
                         topic('{"machine_id":"m","action":"DANSER","timestamp":"2024-01-01T00:00:00Z"}'))
    assert sorted((r.raw, r.reason) for r in got.collect()) == [
        ("broken", "order without id"), ('{"action":"PAUSE"}', "event without machine"),
        ('{"machine_id":"m","action":"DANSER","timestamp":"2024-01-01T00:00:00Z"}', "unknown action"),
        ('{"qty":1}', "order without id")]
