"""The factory views over the given tables, in Spark and as SQL text.

Both forms say the same: event rows are sensor readings, statuses, alerts and
maintenance actions of a machine; orders are production orders and assignments;
suppliers are the roster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantwatch import schemas
from plantwatch.functions import rules
from plantwatch.functions.times import iso
from plantwatch.params import Params
from plantwatch.session import prepare, workdir

AS_OF = "2024-01-31 00:00:00"
RUN_START = "2024-01-01 00:00:00"

# The event table holds a few readings per machine and day, so spans are hours
# where the live defaults are minutes.
SCENARIO = Params(
    pause_seconds=6 * 3600, idle_seconds=2 * 3600, units_per_minute=1000.0,
    status_lookback="12 hours", state_lookback="12 hours", floor_status_lookback="12 hours",
    floor_metrics_lookback="12 hours", floor_pause_lookback="12 hours",
    floor_task_lookback="12 hours", tasks_lookback="2 hours", stats_lookback="24 hours",
)


class Tables:
    """Lazy views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark), sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stream(self, name: str, schema_of: DataFrame | None = None) -> DataFrame:
        schema = (schema_of or self.raw(name)).schema
        return (self.spark.readStream.schema(schema)
                .option("pathGlobFilter", f"{name}.parquet").parquet(self.dir))

    def replayed(self, name: str, time: str, epochs: int = 6, late: Column | None = None) -> DataFrame:
        """A table as a stream of several epochs: its rows, cut by time and written one cut
        after the other, are read as many files per epoch as a cut has. Rows that are `late`
        come with the cut after theirs. Every cut has the same number of files, so that an epoch
        is a cut and all cores read it, however the table's own files lie in time."""
        rows = self.raw(name)
        low, high = rows.agg(F.min(time), F.max(time)).first()
        edges = [low + (high - low) * k / epochs for k in range(1, epochs)] if low else []
        # A row belongs to the first cut whose edge lies after it; the last has no edge.
        kind, cut = rows.schema[time].dataType, F.lit(len(edges))
        for k, edge in reversed(list(enumerate(edges))):
            cut = F.when(F.col(time) < F.lit(edge).cast(kind), k).otherwise(cut)
        if late is not None:
            cut = F.when(late, F.least(cut + 1, F.lit(len(edges)))).otherwise(cut)
        many = max(self.spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
        for files in (many, 1):  # one per cut, where a cut has too few rows for more
            path = workdir(self.spark, f"replay-{name}")
            for k in range(len(edges) + 1):
                rows.where(cut == k).repartition(files, time).write.mode("append").parquet(path)
            written = len(self.spark.read.schema(rows.schema).parquet(path).inputFiles())
            if written == files * (len(edges) + 1):
                break
        return (self.spark.readStream.schema(rows.schema)
                .option("maxFilesPerTrigger", files).parquet(path))

    # -- from events -----------------------------------------------------------
    def readings(self, events: DataFrame | None = None) -> DataFrame:
        e = self.raw("events") if events is None else events
        kind, value, n = F.col("event_type"), F.col("value"), F.col("event_id")
        return e.select(
            F.concat(F.lit("M-"), "user_id").alias("machine_id"),
            F.col("ts").alias("event_time"), n.alias("seq"),
            F.when(kind == "error", "arrete").when(kind == "signup", None)
            .otherwise("en_marche").alias("etat"),
            F.get_json_object("props", "$.k").cast("double").alias("charge_travail"),
            (F.lit(80.0) + (n * 7) % 71).alias("consommation_electrique"),
            (F.lit(0.5) + F.least(value, F.lit(120.0)) / 40.0).alias("vibration"),
            (F.lit(50.0) + F.least(value, F.lit(100.0)) * 0.45).alias("temperature"),
            (F.lit(4.0) + (n % 25) / 10.0).alias("pression"))

    def sensor_json(self) -> DataFrame:
        contract = [F.col(c) for c in schemas.SENSOR.fieldNames()]
        return (self.readings().withColumn("timestamp", iso("event_time"))
                .select(F.to_json(F.struct(*contract)).cast("binary").alias("value")))

    def status_events(self) -> DataFrame:
        kind = F.col("event_type")
        statut = (F.when(kind == "view", "DISPONIBLE").when(kind == "click", "ASSIGNEE")
                  .when(kind == "signup", "PAUSE").when(kind == "error", "ARRET")
                  .when(kind == "purchase", "IDLE"))
        return self.raw("events").select(
            F.concat(F.lit("M-"), "user_id").alias("machine_id"), F.col("ts").alias("event_time"),
            F.col("event_id").alias("seq"), statut.alias("statut"))

    def alert_events(self, events: DataFrame | None = None) -> DataFrame:
        """Sensor alerts: signup asks for a pause, error for a stop."""
        e = self.raw("events") if events is None else events
        return e.where(F.col("event_type").isin("signup", "error")).select(
            F.concat(F.lit("M-"), "user_id").alias("machine_id"), F.col("ts").alias("event_time"),
            F.col("event_id").alias("seq"), F.lit("ml").alias("source"),
            F.when(F.col("event_type") == "signup", "PAUSE").otherwise("ARRETER").alias("action"))

    def maintenance_events(self, events: DataFrame | None = None) -> DataFrame:
        """Purchases by remainder of 3: repair, forced stop, and an action nobody knows."""
        e = self.raw("events") if events is None else events
        third = F.col("event_id") % 3
        return e.where(F.col("event_type") == "purchase").select(
            F.concat(F.lit("M-"), "user_id").alias("machine_id"), F.col("ts").alias("event_time"),
            F.col("event_id").alias("seq"), F.lit("maintenance").alias("source"),
            F.when(third == 0, "REPARER").when(third == 1, "FORCER_ARRET").otherwise("INCONNU")
            .alias("action"))

    # -- from orders and suppliers ----------------------------------------------
    def _order_fields(self, orders: DataFrame | None = None) -> DataFrame:
        key = F.col("o_orderkey")
        return (self.raw("orders") if orders is None else orders).select(
            F.concat(F.lit("TASK-"), key).alias("task_id"),
            F.col("o_orderstatus").alias("product_name"),
            F.col("o_totalprice").cast("long").alias("quantity"),
            (F.lit(1) + key % 3).cast("int").alias("duration_minutes"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HAUTE")
            .otherwise("NORMALE").alias("priority"),
            key.alias("seq"), "o_custkey", "o_orderdate", "o_orderkey")

    def orders_in(self) -> DataFrame:
        return self._order_fields().select(
            "task_id", "product_name", "quantity", "duration_minutes", "priority",
            F.col("o_orderdate").alias("event_time"), "seq", F.lit(None).cast("long")
            .alias("requeue_seq"))

    def assignments(self, orders: DataFrame | None = None) -> DataFrame:
        """Assignments in the month of the events, each at its own second."""
        start = F.lit(RUN_START).cast("timestamp_ntz")
        offset = F.make_dt_interval(secs=(F.col("o_orderkey") * 173) % 2592000)
        return self._order_fields(orders).select(
            F.concat(F.lit("M-"), F.col("o_custkey") % 150).alias("machine_id"),
            (start + offset).alias("event_time"), "seq", "task_id", "product_name", "quantity",
            "duration_minutes", "priority")

    def arrivals(self, orders: DataFrame | None = None) -> DataFrame:
        """The same orders as they came in: up to a day before they were assigned."""
        wait = F.make_dt_interval(secs=(F.col("seq") * 37) % 86400)
        return self.assignments(orders).withColumn("event_time", F.col("event_time") - wait)

    def held(self, as_of: str = AS_OF) -> DataFrame:
        """Latest assignment per machine, with the duration that its quantity asks for."""
        from plantwatch.operators.latest import latest_task
        return latest_task(self.assignments(), as_of, None).withColumn(
            "duration_minutes", rules.task_minutes("quantity", SCENARIO))

    def roster(self) -> DataFrame:
        return self.raw("supplier").select(
            F.concat(F.lit("M-"), "s_suppkey").alias("machine_id"), F.col("s_suppkey").alias("pos"))

    # -- run-to-failure episodes ---------------------------------------------------
    def episode_readings(self) -> DataFrame:
        """Readings with their episode; machines whose number ends in 0 or 5 never fail."""
        r = self.readings()
        number = F.substring("machine_id", 3, 20).cast("long")
        return r.withColumn("episode_id", F.col("machine_id")).withColumn(
            "failed", (F.col("etat").eqNullSafe("arrete")) & (number % 5 != 0))

    def labels(self, params: Params = SCENARIO) -> DataFrame:
        from plantwatch.operators import features
        steps = features.episode_steps(self.episode_readings(), params)
        failures = (steps.where("failed").groupBy("episode_id")
                    .agg(F.max("step").alias("failure_step")))
        return features.labelled(steps, failures, params)


# ---- the same views as SQL -------------------------------------------------------

VIEWS = {
    "readings": """
  SELECT 'M-' || user_id AS machine_id, ts AS event_time, event_id AS seq,
         CASE event_type WHEN 'error' THEN 'arrete' WHEN 'signup' THEN NULL
              ELSE 'en_marche' END AS etat,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS charge_travail,
         8e1 + (event_id * 7) % 71 AS consommation_electrique,
         5e-1 + least(value, 12e1) / 4e1 AS vibration,
         5e1 + least(value, 1e2) * 45e-2 AS temperature,
         4e0 + (event_id % 25) / 1e1 AS pression
  FROM events""",
    "status_events": """
  SELECT 'M-' || user_id AS machine_id, ts AS event_time, event_id AS seq,
         CASE event_type WHEN 'view' THEN 'DISPONIBLE' WHEN 'click' THEN 'ASSIGNEE'
              WHEN 'signup' THEN 'PAUSE' WHEN 'error' THEN 'ARRET'
              WHEN 'purchase' THEN 'IDLE' END AS statut
  FROM events""",
    "flow": """
  SELECT 'M-' || user_id AS machine_id, ts AS event_time, event_id AS seq,
         CASE WHEN event_type IN ('signup', 'error') THEN 'PAUSE'
              WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'CLEAR'
              WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN 'ARRET' END AS effect
  FROM events""",
    "order_fields": """
  SELECT 'TASK-' || o_orderkey AS task_id, o_orderstatus AS product_name,
         CAST(trunc(o_totalprice) AS BIGINT) AS quantity,
         CAST(1 + o_orderkey % 3 AS INTEGER) AS duration_minutes,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HAUTE'
              ELSE 'NORMALE' END AS priority,
         o_orderkey AS seq, o_custkey, o_orderdate
  FROM orders""",
    "assignments": """
  SELECT 'M-' || (o_custkey % 150) AS machine_id,
         TIMESTAMP '2024-01-01' + to_seconds((seq * 173) % 2592000) AS event_time,
         seq, task_id, product_name, quantity, duration_minutes, priority
  FROM order_fields""",
    "held": """
  SELECT machine_id, event_time, seq, task_id, product_name, quantity,
         greatest(1, CAST(trunc(quantity / 1e3) AS INTEGER)) AS duration_minutes
  FROM assignments WHERE event_time <= TIMESTAMP '2024-01-31'
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_time DESC, seq DESC) = 1""",
    "roster": """
  SELECT 'M-' || s_suppkey AS machine_id, s_suppkey AS pos FROM supplier""",
    "latest_status": """
  SELECT machine_id, event_time, statut FROM status_events
  WHERE event_time <= TIMESTAMP '2024-01-31'
    AND event_time > TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_time DESC, seq DESC) = 1""",
    "latest_state": """
  SELECT machine_id, event_time, etat, temperature, charge_travail FROM readings
  WHERE event_time <= TIMESTAMP '2024-01-31'
    AND event_time > TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_time DESC, seq DESC) = 1""",
    "marks": """
  SELECT *,
    max(CASE WHEN effect = 'PAUSE' THEN (event_time, seq) END) OVER w AS lp,
    max(CASE WHEN effect = 'ARRET' THEN (event_time, seq) END) OVER w AS la,
    max(CASE WHEN effect = 'CLEAR' THEN (event_time, seq) END) OVER w AS lc
  FROM flow WHERE effect IS NOT NULL
  WINDOW w AS (PARTITION BY machine_id ORDER BY event_time, seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
}
NEEDS = {"assignments": ["order_fields"], "held": ["assignments"],
         "latest_status": ["status_events"], "latest_state": ["readings"], "marks": ["flow"]}


def half_up(expr: str, places: int) -> str:
    """SQL that rounds half up on the decimal digits of a number, free of binary noise."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28, 10)), {places}) AS DOUBLE)"


def with_views(sql: str, *names: str) -> str:
    """`sql` with the named views, and those they build on, as common table expressions."""
    wanted: list[str] = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in wanted)
    own = sql.strip()
    if own.upper().startswith("WITH "):
        return f"WITH {ctes},\n{own[5:]}"
    return f"WITH {ctes}\n{own}"
