"""Streaming jobs run over the whole given tables and read back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from plantwatch.functions import decode, rules
from plantwatch.functions.values import rounded
from plantwatch.operators import latest, rollups
from plantwatch.params import DEFAULTS
from plantwatch.plans.fleet import LIFECYCLE_VIEWS, STATE_SQL, TRANSITION_SQL
from plantwatch.plans.registry import query
from plantwatch.plans.tables import RUN_START, SCENARIO, Tables, half_up, with_views
from plantwatch.plans.telemetry import ENERGY_SQL, FEATURE_SQL, feature_rows
from plantwatch.session import workdir
from plantwatch.sources import compaction, lake
from plantwatch.sources.bus import Bus
from plantwatch.streaming import jobs, lifecycle
from plantwatch.streaming.orchestrate import Orchestrator, inbox


EPOCH_END = """(SELECT max(event_time) FROM (
  SELECT ts AS event_time FROM events WHERE event_type IN ('signup', 'error', 'purchase')
  UNION ALL SELECT event_time - to_seconds((seq * 37) % 86400) FROM assignments))"""


def _finish(stream):
    stream.awaitTermination()


@query("q40_stream_energy", ENERGY_SQL)
def q40(spark, sf_dir):
    t, root = Tables(spark, sf_dir), workdir(spark, "energy")
    readings = t.readings(t.replayed("events", "ts"))
    bus = Bus(spark, "parquet", f"{root}/bus")
    _finish(jobs.energy(readings, f"{root}/serving", bus, f"{root}/checkpoint", availableNow=True))
    return lake.read_measurement(spark, f"{root}/serving", "anomalies_energie").select(
        "machine_id", "type_alerte", "valeur_actuelle", "valeur_normale", "event_time")


@query("q47_stream_resume", ENERGY_SQL)
def q47(spark, sf_dir):
    """The energy job broken off twice, each time with an epoch written but not committed, and resumed."""
    t, root = Tables(spark, sf_dir), workdir(spark, "resume")
    readings = t.readings(t.replayed("events", "ts"))
    bus = Bus(spark, "parquet", f"{root}/bus")

    def run(last):
        def stop(epoch_id, seen):
            if epoch_id == last:
                raise RuntimeError(f"broken off in epoch {last}")
        _finish(jobs.energy(readings, f"{root}/serving", bus, f"{root}/checkpoint", on_count=stop, availableNow=True))
    for last in (1, 3):
        try:
            run(last)
        except StreamingQueryException:  # a table too small for so many epochs runs through
            pass
    run(None)
    return lake.read_measurement(spark, f"{root}/serving", "anomalies_energie").select(
        "machine_id", "type_alerte", "valeur_actuelle", "valeur_normale", "event_time")


@query("q48_panel_from_rollups", with_views(f"""
SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS window_start, machine_id,
       {half_up("avg(temperature)", 6)} AS mean_value, max(temperature) AS max_value, count(*) AS n
FROM readings WHERE event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-17'
GROUP BY ALL""", "readings"))
def q48(spark, sf_dir):
    """A week's panel by the hour from rollups of 10 minutes that a stream has kept."""
    t, root = Tables(spark, sf_dir), workdir(spark, "rollups")
    readings = t.readings(t.replayed("events", "ts", late=F.col("event_id") % 5 == 0))
    _finish(jobs.rollup(readings, f"{root}/serving", f"{root}/checkpoint", availableNow=True))
    kept = lake.read_measurement(spark, f"{root}/serving", "rollups").where("measure = 'temperature'")
    days = kept.where("event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'")
    week = latest.between(days, "event_time", "2024-01-10 00:00:00", "2024-01-17 00:00:00")
    return rollups.merged(week, "1 hour").select(
        "window_start", "machine_id", rounded("mean_value", 6).alias("mean_value"), "max_value", "n")


@query("q41_stream_features", with_views(FEATURE_SQL, "readings"))
def q41(spark, sf_dir):
    t, root = Tables(spark, sf_dir), workdir(spark, "features")
    readings = t.readings(t.replayed("events", "ts"))
    state = jobs.FeatureState(spark, f"{root}/state", readings.select(*jobs.KEPT).schema)

    def write(rows, epoch_id):
        rows.write.mode("overwrite").parquet(f"{root}/out/epoch_id={epoch_id}")

    _finish(jobs.feature_alerts(readings, state, f"{root}/checkpoint", write, availableNow=True))
    return feature_rows(spark.read.parquet(f"{root}/out"))


# The last watermark is the newest known event; pauses that end by then have expired.
STREAM_END = "(SELECT max(event_time) FROM flow WHERE effect IS NOT NULL)"


@query("q42_stream_lifecycle", with_views(f"""
WITH {STATE_SQL}, {TRANSITION_SQL}
SELECT machine_id, transition, event_time FROM changes""".replace(
    "TIMESTAMP '2024-01-31'", STREAM_END), *LIFECYCLE_VIEWS))
def q42(spark, sf_dir):
    """Alert changes over several epochs; one event in seven comes an epoch late, behind the watermark."""
    t, root = Tables(spark, sf_dir), workdir(spark, "lifecycle")
    events = t.replayed("events", "ts", late=F.col("event_id") % 7 == 0)
    flow = t.alert_events(events).unionByName(t.maintenance_events(events))
    state = lifecycle.LifecycleState(spark, f"{root}/state", flow.schema["event_time"].dataType, SCENARIO,
                                     horizon_seconds=15 * 86_400)
    _finish(lifecycle.lifecycle(flow, state, f"{root}/serving", f"{root}/checkpoint", Bus(spark, "parquet", f"{root}/bus"),
                                SCENARIO, availableNow=True))
    changes = lake.read_measurement(spark, f"{root}/serving", "transitions")
    return lifecycle.net(changes).select("machine_id", "transition", "event_time")


TWO_WEEKS = "2024-01-08 00:00:00", "2024-01-22 00:00:00"
TWO_WEEKS_SQL = with_views("""
SELECT machine_id, etat, charge_travail, consommation_electrique, vibration, temperature, pression,
       event_time, CAST(day(event_time) AS INTEGER) AS "day"
FROM readings WHERE event_time >= TIMESTAMP '2024-01-08' AND event_time < TIMESTAMP '2024-01-22'""", "readings")


def _shown(archived):
    return archived.select("machine_id", "etat", "charge_travail", "consommation_electrique", "vibration",
                           "temperature", "pression",
                           F.col("event_time").cast("timestamp_ntz").alias("event_time"), "day")


def _contract(readings):
    """Readings as the archive's sink takes them."""
    return (readings.withColumn("timestamp", F.col("event_time").cast("string"))
            .withColumn("event_time", F.col("event_time").cast("timestamp"))
            .withColumns({"year": F.year("event_time"), "month": F.month("event_time"),
                          "day": F.dayofmonth("event_time")})
            .select(*lake.archive_schema().fieldNames()))


@query("q43_archive_roundtrip", TWO_WEEKS_SQL)
def q43(spark, sf_dir):
    """All readings into the archive, two weeks read back through the partitions."""
    t, root = Tables(spark, sf_dir), workdir(spark, "archive")
    lake.archive(decode.sensors(t.sensor_json()), f"{root}/lake")
    return _shown(lake.read_archive(spark, f"{root}/lake", *TWO_WEEKS))


@query("q43b_stream_archive", with_views("""
SELECT machine_id, etat, charge_travail, consommation_electrique, vibration, temperature, pression,
       event_time FROM readings""", "readings"))
def q43b(spark, sf_dir):
    t, root = Tables(spark, sf_dir), workdir(spark, "archive-stream")
    readings = _contract(t.readings(t.replayed("events", "ts")))
    _finish(lake.archive_stream(readings, f"{root}/lake", f"{root}/checkpoint", availableNow=True))
    return _shown(lake.read_archive(spark, f"{root}/lake")).drop("day")


@query("q43c_compacted_archive", TWO_WEEKS_SQL)
def q43c(spark, sf_dir):
    """The stream's archive, compacted up to a day within the two weeks that are read: what lies
    before comes from few files chosen by their statistics, the rest from the archive's own."""
    t, root = Tables(spark, sf_dir), workdir(spark, "archive-compact")
    readings = _contract(t.readings(t.replayed("events", "ts", late=F.col("event_id") % 7 == 0)))
    _finish(lake.archive_stream(readings, f"{root}/lake", f"{root}/checkpoint", availableNow=True))
    compaction.compact(spark, f"{root}/lake", f"{root}/compact", "2024-01-15")
    return _shown(compaction.read(spark, f"{root}/lake", f"{root}/compact", *TWO_WEEKS))


@query("q46_stream_hourly_mean", with_views("""
SELECT * FROM (
  SELECT machine_id, time_bucket(INTERVAL 1 HOUR, event_time) AS window_start,
         CAST(round(CAST(avg(temperature) AS DECIMAL(28, 10)), 6) AS DOUBLE) AS mean_value
  FROM readings GROUP BY 1, 2)
WHERE window_start + INTERVAL 1 HOUR
      <= (SELECT max(event_time) - INTERVAL 10 MINUTE FROM readings)""", "readings"))
def q46(spark, sf_dir):
    """Hourly means in append mode: windows that the watermark has closed."""
    t, root = Tables(spark, sf_dir), workdir(spark, "hourly")
    means = jobs.rolling_mean(t.readings(t.replayed("events", "ts")), "temperature", "1 hour")
    _finish(means.writeStream.format("parquet").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema(means.schema).parquet(f"{root}/out").select(
        "machine_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        rounded("mean_value", 6).alias("mean_value"))


@query("q45_orchestration_epoch", with_views(f"""
WITH {STATE_SQL.replace("TIMESTAMP '2024-01-31'", EPOCH_END)},
metrics AS (
  SELECT machine_id, arg_max(temperature, (event_time, seq)) AS temperature,
         arg_max(charge_travail, (event_time, seq)) AS charge_travail
  FROM readings WHERE event_time <= {EPOCH_END}
    AND event_time > {EPOCH_END} - INTERVAL 12 HOUR GROUP BY machine_id),
machines AS (
  SELECT machine_id, row_number() OVER (ORDER BY m.machine_id IS NULL,
    coalesce(temperature, 7e1) / 1e2 * 6e-1 + coalesce(charge_travail, 5e1) / 1e2 * 4e-1, pos)
    AS k
  FROM roster LEFT JOIN metrics m USING (machine_id)
  WHERE machine_id NOT IN (SELECT machine_id FROM active)),
tasks AS (
  SELECT *, row_number() OVER (ORDER BY priority <> 'HAUTE',
    event_time - to_seconds((seq * 37) % 86400), seq) AS k FROM assignments)
SELECT task_id, m.machine_id, product_name, duration_minutes, {EPOCH_END} AS event_time
FROM tasks t JOIN machines m USING (k)""", "flow", "assignments", "roster", "readings"))
def q45(spark, sf_dir):
    """All orders and events of the tables as one epoch of the orchestrator."""
    t, root = Tables(spark, sf_dir), workdir(spark, "orchestrate")
    events = t.stream("events")
    orders = t.arrivals(t.stream("orders")).withColumn("requeue_seq", F.lit(None).cast("long"))
    rows = inbox(orders, t.alert_events(events), t.maintenance_events(t.stream("events")))

    def metrics_at(as_of):
        recent = latest.lookback(t.readings(), "event_time", as_of, SCENARIO.state_lookback)
        return latest.latest_fields(recent, ["machine_id"], ["temperature", "charge_travail"],
                                    "event_time")

    plant = Orchestrator(t.roster(), metrics_at, f"{root}/state",
                         Bus(spark, "parquet", f"{root}/bus"), f"{root}/serving",
                         orders.schema["event_time"].dataType, RUN_START, SCENARIO)
    _finish(plant.start(rows, f"{root}/checkpoint", availableNow=True))
    return lake.read_measurement(spark, f"{root}/serving", "assignations").select(
        "task_id", "machine_id", "product_name", "duration_minutes", "event_time")


# Ends of the epochs: close together in the middle, so that tasks run on from one to the next.
EPOCH_EDGES = ("2024-01-10", "2024-01-11", "2024-01-13", "2024-02-02")


def _epoch_sql(k: int) -> str:
    """Epoch k (from 1) on what epoch k - 1 left in `held` and `waiting`, each a table per epoch."""
    now, p = f"(SELECT t FROM clock{k})", k - 1
    edge = f"TIMESTAMP '{EPOCH_EDGES[p]}'"
    since = f"AND event_time >= TIMESTAMP '{EPOCH_EDGES[p - 1]}'" if p else ""
    alerts = (STATE_SQL.replace("TIMESTAMP '2024-01-31'", now).replace("state AS (", f"state{k} AS (")
              .replace("active AS (", f"active{k} AS (").replace("FROM state ", f"FROM state{k} "))
    return f"""
clock{k} AS MATERIALIZED (SELECT max(event_time) AS t FROM inbox WHERE event_time < {edge}),
{alerts},
stops{k} AS (
  SELECT machine_id, event_time AS stop_at, seq AS stop_seq FROM flow
  WHERE effect = 'ARRET' AND event_time < {edge} {since}
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_time, seq) = 1),
cut{k} AS MATERIALIZED (
  SELECT *, date_diff('microsecond', event_time, stop_at) / 6e7 / duration_minutes AS share
  FROM held{p} JOIN stops{k} USING (machine_id)
  WHERE event_time <= stop_at
    AND date_diff('microsecond', event_time, stop_at) < CAST(duration_minutes AS BIGINT) * 60000000),
going{k} AS MATERIALIZED (
  SELECT * FROM held{p} WHERE task_id NOT IN (SELECT task_id FROM cut{k})
    AND date_diff('microsecond', event_time, {now}) < CAST(duration_minutes AS BIGINT) * 60000000),
queue{k} AS MATERIALIZED (
  SELECT * FROM waiting{p}
  UNION ALL SELECT * FROM arrivals WHERE event_time < {edge} {since}
  UNION ALL SELECT task_id, product_name, duration_minutes, 'HAUTE', stop_at, stop_seq,
                   epoch_us(stop_at) FROM cut{k} WHERE share < 8e-1),
metrics{k} AS (
  SELECT machine_id, arg_max(temperature, (event_time, seq)) AS temperature,
         arg_max(charge_travail, (event_time, seq)) AS charge_travail
  FROM readings WHERE event_time <= {now} AND event_time > {now} - INTERVAL 12 HOUR
  GROUP BY machine_id),
machines{k} AS (
  SELECT machine_id, row_number() OVER (ORDER BY m.machine_id IS NULL,
    coalesce(temperature, 7e1) / 1e2 * 6e-1 + coalesce(charge_travail, 5e1) / 1e2 * 4e-1, pos)
    AS k
  FROM roster LEFT JOIN metrics{k} m USING (machine_id)
  WHERE machine_id NOT IN (SELECT machine_id FROM active{k})
    AND machine_id NOT IN (SELECT machine_id FROM going{k})),
tasks{k} AS (
  SELECT *, row_number() OVER (ORDER BY priority <> 'HAUTE', coalesce(-back, 0), event_time, seq,
                               task_id) AS k FROM queue{k}),
given{k} AS MATERIALIZED (
  SELECT m.machine_id, task_id, product_name, duration_minutes, {now} AS event_time
  FROM tasks{k} JOIN machines{k} m USING (k)),
held{k} AS MATERIALIZED (SELECT * FROM going{k} UNION ALL SELECT * FROM given{k}),
waiting{k} AS MATERIALIZED (
  SELECT * FROM queue{k} WHERE task_id NOT IN (SELECT task_id FROM given{k}))"""


EPOCHS = range(1, len(EPOCH_EDGES) + 1)
EPOCHS_SQL = with_views(f"""
WITH arrivals AS MATERIALIZED (
  SELECT task_id, product_name, greatest(1, CAST(trunc(quantity / 1e2) AS INTEGER)) AS duration_minutes,
         priority, event_time - to_seconds((seq * 37) % 86400) AS event_time, seq,
         CAST(NULL AS BIGINT) AS back FROM assignments),
inbox AS MATERIALIZED (
  SELECT ts AS event_time FROM events WHERE event_type IN ('signup', 'error', 'purchase')
  UNION ALL SELECT event_time FROM arrivals),
waiting0 AS (SELECT * FROM arrivals WHERE false),
held0 AS (SELECT machine_id, task_id, product_name, duration_minutes, event_time
          FROM assignments WHERE false),
{",".join(map(_epoch_sql, EPOCHS))}
{" UNION ALL ".join(f'''
SELECT CAST({k - 1} AS BIGINT) AS epoch_id, 'ASSIGNED' AS kind, task_id, machine_id, event_time
FROM given{k}
UNION ALL
SELECT {k - 1}, CASE WHEN share < 8e-1 THEN 'REQUEUED' ELSE 'COMPLETED' END, task_id, machine_id,
       stop_at FROM cut{k}
UNION ALL
SELECT {k - 1}, 'IN_QUEUE', CAST(count(*) AS VARCHAR), NULL, (SELECT t FROM clock{k})
FROM waiting{k}''' for k in EPOCHS)}""", "flow", "assignments", "roster", "readings")


@query("q49_orchestration_epochs", EPOCHS_SQL)
def q49(spark, sf_dir):
    """The orchestrator over several epochs, stopped after each and started again: what it
    assigned, what stops cut short, and how many tasks were left waiting."""
    t, root = Tables(spark, sf_dir), workdir(spark, "orchestrate")
    orders = t.arrivals().withColumns({
        "duration_minutes": rules.task_minutes("quantity", DEFAULTS),
        "requeue_seq": F.lit(None).cast("long")})
    rows = inbox(orders, t.alert_events(), t.maintenance_events())

    def metrics_at(as_of):
        recent = latest.lookback(t.readings(), "event_time", as_of, SCENARIO.state_lookback)
        return latest.latest_fields(recent, ["machine_id"], ["temperature", "charge_travail"],
                                    "event_time")

    plant = Orchestrator(t.roster(), metrics_at, f"{root}/state",
                         Bus(spark, "parquet", f"{root}/bus"), f"{root}/serving",
                         orders.schema["event_time"].dataType, RUN_START,
                         SCENARIO.but(min_available=0, queue_epochs=2))
    before = F.lit(False)
    for edge in EPOCH_EDGES:
        due = F.col("event_time") < F.lit(edge).cast("timestamp_ntz")
        rows.where(due & ~before).write.mode("append").parquet(f"{root}/inbox")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{root}/inbox")
        _finish(plant.start(arrived, f"{root}/checkpoint", availableNow=True))
        before = due

    def told(name, kind, task, machine=F.col("machine_id")):
        return lake.read_measurement(spark, f"{root}/serving", name).select(
            F.col("epoch_id").cast("long").alias("epoch_id"), kind.alias("kind"),
            task.alias("task_id"), machine.alias("machine_id"), "event_time")
    return (told("assignations", F.lit("ASSIGNED"), F.col("task_id"))
            .unionByName(told("interruptions", F.col("outcome"), F.col("task_id")))
            .unionByName(told("task_queue", F.lit("IN_QUEUE"), F.col("size").cast("string"),
                              F.lit(None).cast("string"))))
