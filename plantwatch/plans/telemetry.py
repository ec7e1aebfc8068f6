"""Readings: decoding, rules, latest values, rollups, features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch import schemas
from plantwatch.functions import decode, rules
from plantwatch.functions.values import rounded
from plantwatch.operators import features, latest, rollups
from plantwatch.plans.registry import query
from plantwatch.plans.tables import AS_OF, SCENARIO, Tables, half_up, with_views


def _six(*names):
    return {n: rounded(n, 6) for n in names}


@query("q01_decode_sensor_json", with_views("""
SELECT machine_id, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp", etat,
       charge_travail, consommation_electrique, vibration, temperature, pression, event_time,
       CAST(year(event_time) AS INTEGER) AS "year", CAST(month(event_time) AS INTEGER) AS "month",
       CAST(day(event_time) AS INTEGER) AS "day"
FROM readings""", "readings"))
def q01(spark, sf_dir):
    df = decode.sensors(Tables(spark, sf_dir).sensor_json()).drop("seq")
    return df.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def _spellings(spark, sf_dir):
    """Orders in four spellings: contract, emitted, aliases with an empty first
    choice, and one without any id."""
    o = Tables(spark, sf_dir).orders_in()
    form = F.col("seq") % 4
    contract = F.to_json(F.struct(F.col("task_id").alias("tache_id"),
                                  F.col("product_name").alias("type_produit"),
                                  F.col("quantity").alias("quantite")))
    emitted = F.to_json(F.struct(
        "task_id", F.col("product_name").alias("product"), "duration_minutes", "priority",
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit("PENDING").alias("status")))
    alias = F.to_json(F.struct(
        F.lit("").alias("task_id"), F.col("task_id").alias("id"),
        F.col("product_name").alias("produit"), F.lit(0).alias("quantity"),
        F.col("quantity").alias("qty"), F.col("duration_minutes").alias("duree_minutes")))
    nameless = F.to_json(F.struct("product_name", "quantity"))
    value = F.when(form == 0, contract).when(form == 1, emitted).when(form == 2, alias) \
        .otherwise(nameless)
    return o.select(value.cast("binary").alias("value"))


@query("q02b_rejected_orders", with_views("""
SELECT '{"product_name":"' || product_name || '","quantity":' || quantity || '}' AS raw,
       'order without id' AS reason
FROM order_fields WHERE seq % 4 = 3""", "order_fields"))
def q02b(spark, sf_dir):
    return decode.rejects(_spellings(spark, sf_dir)).select("raw", "reason")


@query("q02_task_decode_aliases", with_views("""
SELECT CASE WHEN seq % 4 = 3 THEN NULL ELSE task_id END AS task_id,
       CASE WHEN seq % 4 = 0 THEN NULL ELSE product_name END AS product_name,
       CASE WHEN seq % 4 = 1 THEN 0 ELSE quantity END AS quantity,
       CAST(CASE WHEN seq % 4 IN (1, 2) THEN duration_minutes ELSE 60 END AS INTEGER)
         AS duration_minutes,
       CASE WHEN seq % 4 = 1 THEN priority ELSE 'NORMALE' END AS priority,
       CASE WHEN seq % 4 = 1 THEN o_orderdate END AS event_time,
       seq % 4 = 3 AS rejected
FROM order_fields""", "order_fields"))
def q02(spark, sf_dir):
    return decode.orders(_spellings(spark, sf_dir)).drop("seq").withColumn(
        "event_time", F.col("event_time").cast("timestamp_ntz"))


ENERGY_CLASS = """CASE WHEN consommation_electrique > 135 THEN 'surconsommation'
            WHEN consommation_electrique > 120 AND charge_travail < 30 THEN 'fuite' END"""
ENERGY_SQL = with_views(f"""
SELECT machine_id, {ENERGY_CLASS} AS type_alerte,
       {half_up('consommation_electrique', 2)} AS valeur_actuelle, 11e1 AS valeur_normale, event_time
FROM readings WHERE {ENERGY_CLASS} IS NOT NULL""", "readings")


@query("q03_energy_anomalies", ENERGY_SQL)
def q03(spark, sf_dir):
    return rollups.energy_anomalies(Tables(spark, sf_dir).readings())


RISK = """CASE WHEN temperature > 90 OR charge_travail > 90 THEN 2
            WHEN temperature > 75 OR charge_travail > 70 THEN 1 ELSE 0 END"""


@query("q04_rule_risk_class", with_views(f"""
SELECT machine_id, event_time, seq, CAST(c AS INTEGER) AS class_id,
       CASE c WHEN 0 THEN 'aucune' WHEN 1 THEN 'pause_requise' ELSE 'maintenance_requise' END
         AS label,
       CASE c WHEN 0 THEN 99e-2 WHEN 1 THEN 85e-2 ELSE 95e-2 END AS confidence,
       CASE c WHEN 0 THEN 5e-2 WHEN 1 THEN 6e-1 ELSE 95e-2 END AS probability,
       CASE c WHEN 0 THEN 'CONTINUER' WHEN 1 THEN 'PAUSE' ELSE 'ARRETER' END AS action,
       CASE c WHEN 2 THEN 'HAUTE' ELSE 'MOYENNE' END AS severity
FROM (SELECT *, {RISK} AS c FROM readings)""", "readings"))
def q04(spark, sf_dir):
    scored = features.rule_scored(Tables(spark, sf_dir).readings())
    return scored.select(
        "machine_id", "event_time", "seq", "class_id", "label", "confidence",
        rules.rule_failure_probability("temperature", "charge_travail").alias("probability"),
        rules.class_action("class_id").alias("action"),
        rules.class_severity("class_id").alias("severity"))


@query("q05_latest_status", with_views(
    "SELECT machine_id, event_time, statut FROM latest_status", "latest_status"))
def q05(spark, sf_dir):
    return latest.latest_status(Tables(spark, sf_dir).status_events(), AS_OF,
                                SCENARIO.status_lookback)


LATEST_FIELDS_SQL = with_views("""
SELECT machine_id, charge_travail, consommation_electrique, vibration, temperature, pression
FROM readings
WHERE event_time <= TIMESTAMP '2024-01-31'
  AND event_time > TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_time DESC, seq DESC) = 1""",
                               "readings")


@query("q06_latest_fields_pivot", LATEST_FIELDS_SQL)
def q06(spark, sf_dir):
    recent = latest.lookback(Tables(spark, sf_dir).readings(), "event_time", AS_OF,
                             SCENARIO.state_lookback)
    tall = latest.to_tall(recent, ["machine_id", "event_time", "seq"], schemas.MEASURES)
    return latest.to_wide(tall, ["machine_id"], schemas.MEASURES, "event_time")


@query("q06b_latest_fields_wide", LATEST_FIELDS_SQL)
def q06b(spark, sf_dir):
    recent = latest.lookback(Tables(spark, sf_dir).readings(), "event_time", AS_OF,
                             SCENARIO.state_lookback)
    return latest.latest_fields(recent, ["machine_id"], schemas.MEASURES, "event_time")


def _hourly(measure, name="mean_value", fn="avg", view="readings", extra=""):
    return f"""
SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS window_start,
       time_bucket(INTERVAL 1 HOUR, event_time) + INTERVAL 1 HOUR AS window_end,
       machine_id{extra}, {half_up(f"{fn}({measure})", 6)} AS {name}
FROM {view} GROUP BY ALL"""


@query("q08_temperature_hourly_mean", with_views(_hourly("temperature"), "readings"))
def q08(spark, sf_dir):
    df = rollups.temperature_mean(Tables(spark, sf_dir).readings(), "1 hour")
    return df.withColumns(_six("mean_value"))


@query("q09_workload_hourly_mean", with_views(_hourly("charge_travail"), "readings"))
def q09(spark, sf_dir):
    df = rollups.workload_mean(Tables(spark, sf_dir).readings(), "1 hour")
    return df.withColumns(_six("mean_value"))


@query("q10_failure_prob_hourly_max", with_views(f"""
SELECT *, CASE WHEN max_probability >= 85e-2 THEN 'red' WHEN max_probability >= 6e-1
               THEN 'orange' ELSE 'green' END AS band FROM (
{_hourly("CASE c WHEN 0 THEN 5e-2 WHEN 1 THEN 6e-1 ELSE 95e-2 END", "max_probability", "max",
         f"(SELECT *, {RISK} AS c FROM readings)")})""", "readings"))
def q10(spark, sf_dir):
    predicted = rollups.predictions(Tables(spark, sf_dir).readings())
    return rollups.failure_probability_max(predicted, "1 hour")


@query("q11_anomaly_hourly_mean", with_views(
    _hourly("valeur_actuelle", view=f"""(
  SELECT machine_id, event_time, {ENERGY_CLASS} AS type_alerte,
         {half_up('consommation_electrique', 2)} AS valeur_actuelle FROM readings
  WHERE {ENERGY_CLASS} IS NOT NULL)""", extra=", type_alerte"), "readings"))
def q11(spark, sf_dir):
    anomalies = rollups.energy_anomalies(Tables(spark, sf_dir).readings())
    return rollups.anomaly_mean(anomalies, "1 hour").withColumns(_six("mean_value"))


@query("q11b_dashboard_range", with_views(f"""
SELECT time_bucket(INTERVAL 10 MINUTE, event_time) AS window_start,
       time_bucket(INTERVAL 10 MINUTE, event_time) + INTERVAL 10 MINUTE AS window_end,
       machine_id, {half_up("avg(temperature)", 6)} AS mean_value
FROM readings WHERE event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-17'
GROUP BY ALL""", "readings"))
def q11b(spark, sf_dir):
    """A dashboard panel over its chosen range."""
    week = latest.between(Tables(spark, sf_dir).readings(), "event_time",
                          "2024-01-10 00:00:00", "2024-01-17 00:00:00")
    return rollups.temperature_mean(week, "10 minutes").withColumns(_six("mean_value"))


FEATURE_SQL = f"""
SELECT machine_id, event_time, seq, vibration, temperature, pression, consommation_electrique,
       charge_travail,
       {half_up('avg(vibration) OVER w', 6)} AS vib_mean, {half_up('avg(temperature) OVER w', 6)} AS temp_mean,
       {half_up('stddev_pop(vibration) OVER w', 6)} AS vib_std,
       {half_up('stddev_pop(pression) OVER w', 6)} AS pres_std,
       CASE WHEN count(*) OVER w > 1 THEN {half_up('regr_slope(temperature, i) OVER w', 6)}
            ELSE 0e0 END AS temp_slope,
       CASE WHEN count(*) OVER w > 1 THEN {half_up('regr_slope(vibration, i) OVER w', 6)}
            ELSE 0e0 END AS vib_slope,
       max(temperature) OVER w AS temp_max
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY event_time, seq)
                AS DOUBLE) AS i FROM readings)
WINDOW w AS (PARTITION BY machine_id ORDER BY event_time, seq
             ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
ROLLED = ["vib_mean", "temp_mean", "vib_std", "pres_std", "temp_slope", "vib_slope"]


def feature_rows(df):
    return df.withColumns({n: rounded(n, 6) for n in ROLLED}).select(
        "machine_id", "event_time", "seq", *schemas.FEATURES)


@query("q17_rolling_features", with_views(FEATURE_SQL, "readings"))
def q17(spark, sf_dir):
    return feature_rows(features.rolling_features(Tables(spark, sf_dir).readings()))


CHANGES = f"""
  SELECT *, c <> p AND c > 0 AS is_alert FROM (
    SELECT *, lag(c, 1, 0) OVER (PARTITION BY machine_id ORDER BY event_time, seq) AS p
    FROM (SELECT *, {RISK} AS c FROM readings))"""


@query("q18_change_alerts", with_views(f"""
SELECT machine_id, CASE c WHEN 1 THEN 'PAUSE' ELSE 'ARRETER' END AS action,
       {half_up('temperature', 2)} AS temperature,
       {half_up('charge_travail', 2)} AS charge_travail,
       CASE c WHEN 2 THEN 'HAUTE' ELSE 'MOYENNE' END AS severity, event_time, seq
FROM ({CHANGES}) WHERE is_alert""", "readings"))
def q18(spark, sf_dir):
    scored = features.rule_scored(Tables(spark, sf_dir).readings())
    return features.alert_records(features.changed_class(scored))


@query("q18b_alert_rate", with_views(f"""
SELECT count(*) AS messages, count(CASE WHEN is_alert THEN 1 END) AS alerts,
       {half_up('count(CASE WHEN is_alert THEN 1 END) / CAST(count(*) AS DOUBLE)', 6)}
         AS alert_rate
FROM ({CHANGES})""", "readings"))
def q18b(spark, sf_dir):
    scored = features.rule_scored(Tables(spark, sf_dir).readings())
    return rollups.alert_rate(features.changed_class(scored)).withColumns(_six("alert_rate"))


LABELS = """
  SELECT s.*, f.failure_step,
         CASE WHEN f.failure_step - step <= 6 THEN 2 WHEN f.failure_step - step <= 18 THEN 1
              ELSE 0 END AS label
  FROM steps s LEFT JOIN (
    SELECT machine_id, max(step) AS failure_step FROM steps WHERE failed GROUP BY machine_id) f
  USING (machine_id)
  WHERE f.failure_step IS NULL OR step <= f.failure_step"""
STEPS = """steps AS (
  SELECT *, etat IS NOT DISTINCT FROM 'arrete'
            AND CAST(substr(machine_id, 3) AS BIGINT) % 5 <> 0 AS failed,
         row_number() OVER (PARTITION BY machine_id ORDER BY event_time, seq) - 1 AS step
  FROM readings)"""
LABELLED = f"WITH {STEPS}, labelled AS ({LABELS})"


@query("q20_failure_horizon_labels", with_views(f"""{LABELLED}
SELECT machine_id AS episode_id, seq, step, failure_step, CAST(label AS INTEGER) AS label
FROM labelled""", "readings"))
def q20(spark, sf_dir):
    return Tables(spark, sf_dir).labels().select("episode_id", "seq", "step", "failure_step",
                                                 "label")


@query("q20b_time_to_next_failure", with_views("""
SELECT machine_id, event_time, seq,
       min(CASE WHEN etat = 'arrete' THEN event_time END) OVER (
         PARTITION BY machine_id ORDER BY event_time, seq
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS failure_time
FROM readings""", "readings"))
def q20b(spark, sf_dir):
    df = Tables(spark, sf_dir).readings().select("machine_id", "event_time", "seq", "etat")
    found = features.next_failure(df, F.col("etat") == "arrete")
    return found.select("machine_id", "event_time", "seq", "failure_time")


@query("q21_class_balance_weights", with_views(f"""{LABELLED}
SELECT CAST(label AS INTEGER) AS label, count(*) AS n,
       {half_up('(SELECT count(*) FROM labelled) / (CAST((SELECT count(DISTINCT label) '
                'FROM labelled) AS DOUBLE) * count(*))', 6)} AS weight
FROM labelled GROUP BY label""", "readings"))
def q21(spark, sf_dir):
    return features.class_balance(Tables(spark, sf_dir).labels()).withColumns(_six("weight"))


@query("q21b_dataset_summary", with_views(f"""{LABELLED}
SELECT count(*) AS samples, count(DISTINCT machine_id) AS episodes FROM labelled""", "readings"))
def q21b(spark, sf_dir):
    return features.dataset_summary(Tables(spark, sf_dir).labels())


@query("q44_serving_state_fill", with_views("""
SELECT machine_id, coalesce(etat, '') AS etat, coalesce(charge_travail, 0e0) AS charge_travail,
       coalesce(temperature, 0e0) AS temperature, coalesce(vibration, 0e0) AS vibration,
       coalesce(consommation_electrique, 0e0) AS consommation_electrique, event_time
FROM readings""", "readings"))
def q44(spark, sf_dir):
    filled = latest.fill_serving(Tables(spark, sf_dir).readings())
    return filled.select(*schemas.MEASUREMENTS["etat_machines"], "event_time")
