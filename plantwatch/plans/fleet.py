"""Machines and tasks: statuses, availability, assignment, lifecycle and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions import rules
from plantwatch.functions.values import rounded
from plantwatch.operators import features, fleet, floor, latest, lifecycle, work
from plantwatch.plans.registry import query
from plantwatch.plans.tables import AS_OF, RUN_START, SCENARIO, Tables, half_up, with_views
from plantwatch.session import stored

MONTH_END = "TIMESTAMP '2024-01-31'"


@query("q07_latest_task_per_machine", with_views(f"""
SELECT machine_id, event_time, task_id, product_name, quantity, duration_minutes
FROM assignments WHERE event_time <= {MONTH_END} AND event_time > {MONTH_END} - INTERVAL 12 HOUR
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_time DESC, seq DESC) = 1""",
                                                  "assignments"))
def q07(spark, sf_dir):
    return latest.latest_task(Tables(spark, sf_dir).assignments(), AS_OF,
                              SCENARIO.floor_task_lookback)


ENUM = """(VALUES (0, 'DISPONIBLE', 'available'), (1, 'ASSIGNEE', 'running'),
  (2, 'PAUSE', 'cooldown'), (3, 'ARRET', 'down'), (4, 'IDLE', 'idle')) e(position, statut, label)"""


@query("q12_machines_by_status", with_views(f"""
SELECT CAST(position AS INTEGER) AS position, e.statut, label, count(s.machine_id) AS machines
FROM {ENUM} LEFT JOIN latest_status s USING (statut) GROUP BY ALL""", "latest_status"))
def q12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return fleet.machines_by_status(latest.latest_status(t.status_events(), AS_OF,
                                                         SCENARIO.status_lookback))


HELD_NOW = f"""held_now AS (
  SELECT * FROM held
  WHERE date_diff('microsecond', event_time, {MONTH_END}) < duration_minutes * 6e7)"""
ROSTER_STATUS = """roster_status AS (
  SELECT r.machine_id, pos, coalesce(statut, 'DISPONIBLE') AS statut
  FROM roster r LEFT JOIN latest_status USING (machine_id))"""


@query("q13_fleet_state_counts", with_views(f"""
WITH {HELD_NOW}, {ROSTER_STATUS}
SELECT count(CASE WHEN h.machine_id IS NULL AND statut = 'DISPONIBLE' THEN 1 END) AS disponible,
       count(h.machine_id) AS assignee,
       count(CASE WHEN h.machine_id IS NULL AND statut = 'PAUSE' THEN 1 END) AS pause,
       count(CASE WHEN h.machine_id IS NULL AND statut = 'ARRET' THEN 1 END) AS arret,
       count(CASE WHEN h.machine_id IS NULL AND statut = 'IDLE' THEN 1 END) AS idle
FROM roster_status r LEFT JOIN held_now h USING (machine_id)""",
                                             "held", "latest_status", "roster"))
def q13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    status = latest.latest_status(t.status_events(), AS_OF, SCENARIO.status_lookback)
    return fleet.fleet_counts(t.roster(), status, work.still_held(t.held(), AS_OF))


# ---- lifecycle -------------------------------------------------------------------

# A pause holds after its last clear; six hours are 21,600 seconds.
STATE_SQL = f"""state AS (
  SELECT machine_id, CASE
      WHEN la IS NOT NULL AND (lc IS NULL OR la > lc) THEN 'ARRET'
      WHEN lp IS NOT NULL AND (lc IS NULL OR lp > lc) THEN
        CASE WHEN date_diff('microsecond', lp_ts, {MONTH_END}) > 21600000000 THEN 'EXPIRED'
             ELSE 'PAUSE' END END AS state,
    lp_ts, lp_seq, la_ts, la_seq FROM (
    SELECT machine_id,
      max(CASE WHEN effect = 'PAUSE' THEN (event_time, seq) END) AS lp,
      max(CASE WHEN effect = 'ARRET' THEN (event_time, seq) END) AS la,
      max(CASE WHEN effect = 'CLEAR' THEN (event_time, seq) END) AS lc,
      max(CASE WHEN effect = 'PAUSE' THEN event_time END) AS lp_ts,
      max(CASE WHEN effect = 'ARRET' THEN event_time END) AS la_ts,
      arg_max(CASE WHEN effect = 'PAUSE' THEN seq END,
              CASE WHEN effect = 'PAUSE' THEN (event_time, seq) END) AS lp_seq,
      arg_max(CASE WHEN effect = 'ARRET' THEN seq END,
              CASE WHEN effect = 'ARRET' THEN (event_time, seq) END) AS la_seq
    FROM flow WHERE event_time <= {MONTH_END} GROUP BY machine_id)),
active AS (
  SELECT machine_id, CASE state WHEN 'PAUSE' THEN 'PAUSE' ELSE 'ARRETER' END AS action,
    CASE state WHEN 'PAUSE' THEN 'MOYENNE' ELSE 'HAUTE' END AS severity,
    CASE state WHEN 'PAUSE' THEN lp_ts ELSE la_ts END AS since,
    CASE state WHEN 'PAUSE' THEN CAST(greatest(0, trunc(
      21600 - date_diff('microsecond', lp_ts, {MONTH_END}) / 1e6)) AS INTEGER) ELSE 0 END
      AS time_remaining
  FROM state WHERE state IN ('PAUSE', 'ARRET'))"""
TRANSITION_SQL = f"""judged AS (
  SELECT *, la IS NOT NULL AND (lc IS NULL OR la > lc) AS down,
    lp IS NOT NULL AND (lc IS NULL OR lp > lc)
      AND NOT (la IS NOT NULL AND (lc IS NULL OR la > lc)) AS waiting,
    max(CASE WHEN effect = 'PAUSE' THEN event_time END) OVER (
      PARTITION BY machine_id ORDER BY event_time, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp_ts
  FROM marks),
timed AS (SELECT *, coalesce(waiting AND date_diff('microsecond', lp_ts, event_time) > 21600000000,
                             false) AS lapsed FROM judged),
changes AS (
  SELECT machine_id, 'PAUSE_EXPIRED' AS transition, lp_ts + INTERVAL 6 HOUR AS event_time, seq
  FROM timed WHERE lapsed
  UNION ALL
  SELECT * FROM (SELECT machine_id, CASE
      WHEN down AND effect <> 'CLEAR' THEN NULL
      WHEN effect = 'ARRET' THEN 'STOPPED'
      WHEN effect = 'PAUSE' AND waiting AND NOT lapsed THEN 'PAUSE_RESTARTED'
      WHEN effect = 'PAUSE' THEN 'PAUSE_STARTED'
      WHEN down OR (waiting AND NOT lapsed) THEN 'REPAIRED' END AS transition, event_time, seq
    FROM timed) WHERE transition IS NOT NULL
  UNION ALL
  SELECT machine_id, 'PAUSE_EXPIRED', lp_ts + INTERVAL 6 HOUR, lp_seq FROM state
  WHERE state = 'EXPIRED')"""
LIFECYCLE_VIEWS = ("flow", "marks")


def _flow(t: Tables):
    return lifecycle.event_flow(t.alert_events(), t.maintenance_events())


@query("q38_alert_lifecycle", with_views(f"""
WITH {STATE_SQL}, {TRANSITION_SQL}
SELECT machine_id, transition, event_time, seq FROM changes WHERE event_time <= {MONTH_END}""",
                                         *LIFECYCLE_VIEWS))
def q38(spark, sf_dir):
    return lifecycle.transitions(_flow(Tables(spark, sf_dir)), AS_OF, SCENARIO)


@query("q38b_rejected_events", with_views("""
SELECT 'M-' || user_id AS machine_id, ts AS event_time, event_id AS seq,
       'maintenance' AS source, 'INCONNU' AS action
FROM events WHERE event_type = 'purchase' AND event_id % 3 = 2""", "flow"))
def q38b(spark, sf_dir):
    return lifecycle.rejected(_flow(Tables(spark, sf_dir)))


@query("q31_expired_pauses_and_emergency", with_views(f"""
WITH {STATE_SQL}, {TRANSITION_SQL},
starts AS (
  SELECT machine_id, event_time AS paused_since, seq AS paused_seq FROM changes
  WHERE transition = 'PAUSE_STARTED'
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_time DESC, seq DESC) = 1),
first_paused AS (
  SELECT machine_id FROM active JOIN starts USING (machine_id) WHERE action = 'PAUSE'
  ORDER BY paused_since, paused_seq LIMIT 1)
SELECT machine_id, state, CASE state WHEN 'ARRET' THEN la_ts ELSE lp_ts END AS since,
       coalesce(a.time_remaining, 0) AS time_remaining,
       f.machine_id IS NOT NULL AS released_early
FROM state LEFT JOIN active a USING (machine_id) LEFT JOIN first_paused f USING (machine_id)
WHERE state IS NOT NULL""", *LIFECYCLE_VIEWS))
def q31(spark, sf_dir):
    """Alert states with the machine that an urgent shortage would release.

    The shortage is stated by a minimum above the fleet's size.
    """
    t = Tables(spark, sf_dir)
    flow, p = _flow(t), SCENARIO.but(min_available=1_000_000_000)
    states = lifecycle.alert_state(flow, AS_OF, p)
    active = lifecycle.active_alerts(flow, AS_OF, p)
    starts = lifecycle.session_starts(lifecycle.transitions(flow, AS_OF, p))
    load = t.roster().agg(F.count(F.lit(1)).alias("available")).withColumn(
        "queue_size", F.lit(1))
    chosen = lifecycle.early_return(active, starts, load, p).select(
        "machine_id", F.lit(True).alias("_released"))
    return (states.join(active.select("machine_id", "time_remaining"), "machine_id", "left")
            .join(chosen, "machine_id", "left")
            .select("machine_id", "state", "since",
                    F.coalesce("time_remaining", F.lit(0)).alias("time_remaining"),
                    F.coalesce("_released", F.lit(False)).alias("released_early")))


@query("q31b_active_alerts", with_views(f"""
WITH {STATE_SQL} SELECT * FROM active""", *LIFECYCLE_VIEWS))
def q31b(spark, sf_dir):
    return lifecycle.active_alerts(_flow(Tables(spark, sf_dir)), AS_OF, SCENARIO)


@query("q31c_pause_starts", with_views(f"""
WITH {STATE_SQL}, {TRANSITION_SQL}
SELECT machine_id, epoch_us(event_time) / 1e6 AS pause_start_timestamp,
       strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') AS pause_start_iso, event_time, seq
FROM changes WHERE transition IN ('PAUSE_STARTED', 'PAUSE_RESTARTED')
  AND event_time <= {MONTH_END}""", *LIFECYCLE_VIEWS))
def q31c(spark, sf_dir):
    return lifecycle.pause_starts(lifecycle.transitions(_flow(Tables(spark, sf_dir)), AS_OF,
                                                        SCENARIO))


# ---- tasks -----------------------------------------------------------------------

STOPS_SQL = """stops AS (SELECT machine_id, event_time, seq FROM flow WHERE effect = 'ARRET')"""
LONG_TASKS_SQL = """long_tasks AS (
  SELECT machine_id, event_time, seq, task_id, product_name, quantity,
         greatest(1, CAST(trunc(quantity / 1e3) AS INTEGER)) AS duration_minutes
  FROM assignments)"""
INTERRUPT_SQL = f"""{STOPS_SQL}, {LONG_TASKS_SQL}, hits AS (
  SELECT s.machine_id, s.event_time, s.seq, a.event_time AS started, a.task_id, a.product_name,
         a.quantity, a.duration_minutes,
         date_diff('microsecond', a.event_time, s.event_time) / 1e6 AS elapsed
  FROM stops s ASOF JOIN (
    SELECT * FROM long_tasks
    QUALIFY row_number() OVER (PARTITION BY machine_id, event_time ORDER BY seq DESC) = 1) a
  ON s.machine_id = a.machine_id AND s.event_time >= a.event_time),
cut_short AS (
  SELECT task_id, machine_id, least(1e0, elapsed / (duration_minutes * 6e1)) AS progress,
         event_time, seq, product_name, quantity, duration_minutes,
         CASE WHEN elapsed / (duration_minutes * 6e1) < 8e-1 THEN 'REQUEUED'
              ELSE 'COMPLETED' END AS outcome
  FROM hits WHERE elapsed < duration_minutes * 60
  QUALIFY row_number() OVER (PARTITION BY machine_id, task_id ORDER BY event_time, seq) = 1)"""


def _long_tasks(t: Tables):
    return t.assignments().withColumn("duration_minutes", rules.task_minutes("quantity", SCENARIO))


def _stops(t: Tables):
    return t.maintenance_events().where(F.col("action") == "FORCER_ARRET")


def _cut_short(t: Tables):
    return work.interruptions(_stops(t), _long_tasks(t), SCENARIO)


@query("q29_interruptions", with_views(f"""
WITH {INTERRUPT_SQL}
SELECT task_id, machine_id, {half_up('progress', 6)} AS progress, event_time, seq, product_name, quantity,
       duration_minutes, outcome FROM cut_short""", "flow", "assignments"))
def q29(spark, sf_dir):
    return _cut_short(Tables(spark, sf_dir)).withColumn("progress", rounded("progress", 6))


LOG_SQL = """log AS (
  SELECT task_id, 'ENQUEUE' AS kind,
         event_time - to_seconds((seq * 37) % 86400) AS event_time, 1 AS delta, seq FROM assignments
  UNION ALL SELECT task_id, 'ASSIGN', event_time, -1, seq FROM assignments
  UNION ALL SELECT task_id, 'COMPLETE', event_time + to_minutes(duration_minutes), 0, seq
            FROM long_tasks)"""


@query("q14_task_counters", with_views(f"""
WITH {INTERRUPT_SQL}, {STATE_SQL}, {TRANSITION_SQL}, {LOG_SQL},
t AS (
  SELECT count(CASE WHEN kind = 'ENQUEUE' THEN 1 END) AS enq,
         count(CASE WHEN kind = 'ASSIGN' THEN 1 END) AS asg,
         count(CASE WHEN kind = 'COMPLETE' AND c.task_id IS NULL THEN 1 END) AS done
  FROM log l LEFT JOIN (SELECT task_id FROM cut_short WHERE event_time <= {MONTH_END}) c
    USING (task_id)
  WHERE l.event_time <= {MONTH_END}),
i AS (
  SELECT count(CASE WHEN outcome = 'REQUEUED' THEN 1 END) AS back,
         count(CASE WHEN outcome = 'COMPLETED' THEN 1 END) AS done
  FROM cut_short WHERE event_time <= {MONTH_END}),
a AS (
  SELECT count(CASE WHEN transition = 'PAUSE_EXPIRED' THEN 1 END) AS pauses_expired,
         count(CASE WHEN transition = 'EARLY_RETURN' THEN 1 END) AS emergency_returns,
         count(CASE WHEN transition = 'REPAIRED' THEN 1 END) AS repairs
  FROM changes WHERE event_time <= {MONTH_END})
SELECT t.enq AS total, t.done + i.done AS completed, i.back AS interrupted,
       t.enq - t.asg + i.back AS in_queue, pauses_expired, emergency_returns, repairs
FROM t, i, a""", "flow", "marks", "assignments"))
def q14(spark, sf_dir):
    t = Tables(spark, sf_dir)
    log = work.task_log(t.arrivals(), _long_tasks(t))
    tasks = work.task_counters(log, stored(_cut_short(t), "cut-short"), AS_OF)
    alerts = lifecycle.alert_counters(lifecycle.transitions(_flow(t), AS_OF, SCENARIO))
    return work.merge_counters(tasks, alerts)


@query("q15_queue_depth_series", with_views(f"""
WITH {LONG_TASKS_SQL}, {LOG_SQL},
depth AS (
  SELECT event_time, seq, kind, task_id, CAST(delta AS INTEGER) AS delta,
         CAST(sum(delta) OVER w AS BIGINT) AS size
  FROM log WHERE delta <> 0
  WINDOW w AS (ORDER BY event_time, seq, CASE kind WHEN 'ENQUEUE' THEN 0 ELSE 1 END
               ROWS UNBOUNDED PRECEDING))
SELECT *, CAST(least(3, greatest(0, size - lag(size, 1, 0) OVER (
         ORDER BY event_time, seq, CASE kind WHEN 'ENQUEUE' THEN 0 ELSE 1 END))) AS INTEGER)
         AS growth
FROM depth""", "assignments"))
def q15(spark, sf_dir):
    t = Tables(spark, sf_dir)
    log = work.task_log(t.arrivals(), _long_tasks(t))
    return work.queue_growth(work.queue_depth(log, SCENARIO))


@query("q16_asof_sensor_at_assignment", with_views(f"""
SELECT a.machine_id, a.event_time, a.seq, a.task_id,
       CASE WHEN r.event_time > a.event_time - INTERVAL 12 HOUR THEN r.event_time END
         AS reading_event_time,
       CASE WHEN r.event_time > a.event_time - INTERVAL 12 HOUR THEN r.temperature END
         AS reading_temperature,
       CASE WHEN r.event_time > a.event_time - INTERVAL 12 HOUR THEN r.charge_travail END
         AS reading_charge_travail
FROM assignments a ASOF LEFT JOIN (
  SELECT * FROM readings
  QUALIFY row_number() OVER (PARTITION BY machine_id, event_time ORDER BY seq DESC) = 1) r
ON a.machine_id = r.machine_id AND a.event_time >= r.event_time""", "assignments", "readings"))
def q16(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tasks = t.assignments().select("machine_id", "event_time", "seq", "task_id")
    return latest.asof_join(tasks, t.readings(), "machine_id", "event_time", "event_time",
                            ["temperature", "charge_travail"], "12 hours", prefix="reading_")


@query("q19_status_transitions", with_views("""
WITH snapshots AS (
  SELECT s.*, CASE WHEN statut = 'ASSIGNEE' THEN a.task_id END AS task
  FROM status_events s ASOF LEFT JOIN (
    SELECT * FROM assignments
    QUALIFY row_number() OVER (PARTITION BY machine_id, event_time ORDER BY seq DESC) = 1) a
  ON s.machine_id = a.machine_id AND s.event_time >= a.event_time),
paired AS (
  SELECT *, lag(statut) OVER w AS previous_statut, lag(task) OVER w AS previous_task
  FROM snapshots WINDOW w AS (PARTITION BY machine_id ORDER BY event_time, seq))
SELECT machine_id, event_time, seq, previous_statut, statut, 'SHIPPED' AS event,
       previous_task AS task_id FROM paired
WHERE previous_statut = 'ASSIGNEE' AND statut <> 'ASSIGNEE' AND previous_task IS NOT NULL
UNION ALL
SELECT machine_id, event_time, seq, previous_statut, statut, 'PULLED', task FROM paired
WHERE statut = 'ASSIGNEE' AND task IS NOT NULL AND task IS DISTINCT FROM previous_task
UNION ALL
SELECT machine_id, event_time, seq, previous_statut, statut, 'BREAKDOWN', NULL FROM paired
WHERE statut = 'ARRET' AND previous_statut <> 'ARRET'""", "status_events", "assignments"))
def q19(spark, sf_dir):
    t = Tables(spark, sf_dir)
    snapshots = latest.asof_join(t.status_events(), t.assignments(), "machine_id", "event_time",
                                 "event_time", ["task_id"], prefix="at_")
    return features.status_transitions(
        snapshots.withColumnRenamed("at_task_id", "task_id").drop("at_event_time"))


# ---- availability and choice -------------------------------------------------------

ADVICE_SQL = """advice AS (
  SELECT machine_id, CASE c WHEN 0 THEN 'CONTINUER' WHEN 1 THEN 'PAUSE' ELSE 'ARRETER' END
           AS action, CASE c WHEN 0 THEN 5e-2 WHEN 1 THEN 6e-1 ELSE 95e-2 END AS probabilite_panne
  FROM (SELECT machine_id, CASE WHEN temperature > 90 OR charge_travail > 90 THEN 2
                                WHEN temperature > 75 OR charge_travail > 70 THEN 1 ELSE 0 END AS c
        FROM readings WHERE event_time <= TIMESTAMP '2024-01-30'
        QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_time DESC, seq DESC)
          = 1))"""
BUSY_SQL = f"""busy AS (
  SELECT machine_id, event_time + to_minutes(duration_minutes) AS busy_until FROM held)"""
ASSESS_SQL = f"""{ADVICE_SQL}, {BUSY_SQL}, assessed AS (
  SELECT r.machine_id, pos, etat, temperature, charge_travail, action, probabilite_panne,
         busy_until,
    CASE WHEN busy_until > {MONTH_END} THEN 'Occupée (encore '
           || date_diff('microsecond', {MONTH_END}, busy_until) // 60000000 || ' min)'
         WHEN etat = 'arrete' THEN 'Machine arrêtée'
         WHEN action = 'ARRETER' THEN 'ML recommande ARRÊT'
         WHEN coalesce(probabilite_panne, 0) > 7e-1 THEN 'Probabilité panne élevée ('
           || CAST(round(probabilite_panne * 100) AS INTEGER) || '%)'
         WHEN temperature > 90 THEN 'Température trop élevée (' || temperature || '°C)'
         WHEN charge_travail > 80 THEN 'Charge trop élevée (' || charge_travail || '%)'
         ELSE 'Disponible' END AS reason
  FROM roster r LEFT JOIN latest_state USING (machine_id) LEFT JOIN advice USING (machine_id)
  LEFT JOIN busy USING (machine_id))"""
ASSESS_VIEWS = ("roster", "latest_state", "held")


def _assessed(t: Tables):
    """The advice is a day old, so that it can differ from the current state."""
    state = latest.latest(
        latest.lookback(t.readings(), "event_time", AS_OF, SCENARIO.state_lookback),
        ["machine_id"], "event_time", ["etat", "temperature", "charge_travail"]).drop("event_time")
    scored = features.rule_scored(t.readings()).select(
        "machine_id", "event_time", "seq", rules.class_action("class_id").alias("action"),
        rules.rule_failure_probability("temperature", "charge_travail").alias("probabilite_panne"))
    advice = latest.latest(
        latest.lookback(scored, "event_time", "2024-01-30 00:00:00", None),
        ["machine_id"], "event_time", ["action", "probabilite_panne"]).drop("event_time")
    return fleet.assess(t.roster(), state, advice, fleet.occupied_until(t.held()), AS_OF)


@query("q22_availability_with_reason", with_views(f"""
WITH {ASSESS_SQL}
SELECT machine_id, pos, reason = 'Disponible' AS available, reason FROM assessed""",
                                                  *ASSESS_VIEWS))
def q22(spark, sf_dir):
    return _assessed(Tables(spark, sf_dir)).select("machine_id", "pos", "available", "reason")


@query("q23_unavailable_reasons_text", with_views(f"""
WITH {ASSESS_SQL}
SELECT page, count(*) AS machines, string_agg(machine_id || ': ' || reason, ', ' ORDER BY pos)
         AS reasons,
       'Aucune machine disponible (' || string_agg(machine_id || ': ' || reason, ', ' ORDER BY pos)
         || ')' AS "text"
FROM (SELECT *, (row_number() OVER (ORDER BY pos, machine_id) - 1) // 100 AS page
      FROM assessed WHERE reason <> 'Disponible') GROUP BY page""", *ASSESS_VIEWS))
def q23(spark, sf_dir):
    return fleet.no_machine_text(fleet.reason_report(_assessed(Tables(spark, sf_dir))))


AVAILABLE_SQL = f"""{HELD_NOW}, {ROSTER_STATUS}, {STATE_SQL},
ready AS (
  SELECT machine_id, pos, statut, statut = 'IDLE' AS wake FROM roster_status
  WHERE statut IN ('DISPONIBLE', 'IDLE')
    AND machine_id NOT IN (SELECT machine_id FROM held_now)
    AND machine_id NOT IN (SELECT machine_id FROM active))"""
AVAILABLE_VIEWS = ("held", "latest_status", "roster", "flow")


def _available(t: Tables):
    status = latest.latest_status(t.status_events(), AS_OF, SCENARIO.status_lookback)
    return fleet.available_machines(
        t.roster(), status, work.still_held(t.held(), AS_OF),
        lifecycle.active_alerts(_flow(t), AS_OF, SCENARIO), work_waiting=True)


@query("q24_available_machines", with_views(f"""
WITH {AVAILABLE_SQL} SELECT * FROM ready""", *AVAILABLE_VIEWS))
def q24(spark, sf_dir):
    return _available(Tables(spark, sf_dir)).select("machine_id", "pos", "statut", "wake")


SIMPLE_SQL = """scored AS (
  SELECT r.*, s.machine_id IS NULL AS stateless,
    CASE WHEN s.machine_id IS NOT NULL THEN
      coalesce(temperature, 7e1) / 1e2 * 6e-1 + coalesce(charge_travail, 5e1) / 1e2 * 4e-1 END
      AS score
  FROM ready r LEFT JOIN latest_state s USING (machine_id))"""


def _scored(t: Tables):
    state = latest.latest_fields(
        latest.lookback(t.readings(), "event_time", AS_OF, SCENARIO.state_lookback),
        ["machine_id"], ["temperature", "charge_travail"], "event_time")
    return fleet.scored_simple(_available(t), state)


@query("q25_best_machine_simple", with_views(f"""
WITH {AVAILABLE_SQL}, {SIMPLE_SQL}
SELECT machine_id, {half_up('score', 6)} AS score FROM scored ORDER BY stateless, scored.score, pos
LIMIT 1""", *AVAILABLE_VIEWS, "latest_state"))
def q25(spark, sf_dir):
    best = fleet.best_simple(_scored(Tables(spark, sf_dir)))
    return best.select("machine_id", rounded("score", 6).alias("score"))


@query("q26_best_machine_detailed", with_views(f"""
WITH {ASSESS_SQL},
s AS (
  SELECT *, coalesce(charge_travail, 0e0) * 2
      + greatest(0e0, coalesce(temperature, 7e1) - 80) * 15e-1
      + CASE action WHEN 'CONTINUER' THEN -15e0 WHEN 'PAUSE' THEN 25e0 ELSE 0e0 END
      + coalesce(probabilite_panne, 0e0) * 10 AS score
  FROM assessed WHERE reason = 'Disponible')
SELECT machine_id, {half_up('score', 6)} AS score,
       'Sélectionnée (score: ' || printf('%.1f', score) || ')' AS reason
FROM s ORDER BY s.score, pos LIMIT 1""", *ASSESS_VIEWS))
def q26(spark, sf_dir):
    best = fleet.best_detailed(_assessed(Tables(spark, sf_dir)))
    return best.withColumn("score", rounded("score", 6))


# The queue at the end of the month: new orders, and interrupted tasks back at the head.
QUEUE_SQL = f"""{INTERRUPT_SQL}, queue AS (
  SELECT task_id, product_name, quantity, duration_minutes, priority,
         o_orderdate AS event_time, seq, NULL AS requeue_seq FROM order_fields
  WHERE task_id NOT IN (SELECT task_id FROM cut_short)
  UNION ALL
  SELECT task_id, product_name, quantity, duration_minutes, 'HAUTE', event_time, seq, seq
  FROM cut_short WHERE outcome = 'REQUEUED'),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY priority <> 'HAUTE', requeue_seq DESC NULLS LAST,
                                        event_time, seq, task_id) AS "rank" FROM queue)"""


def _queue(t: Tables):
    """Stored, as ranking reads it for its size and again for the ranks."""
    return stored(work.queue_with_requeued(t.orders_in(), _cut_short(t)), "queue")


@query("q27_task_queue_order", with_views(f"""
WITH {QUEUE_SQL}
SELECT "rank", task_id, product_name, quantity, duration_minutes, priority FROM ranked""",
                                          "flow", "assignments"))
def q27(spark, sf_dir):
    ranked = work.queue_ranks(_queue(Tables(spark, sf_dir)), SCENARIO)
    return ranked.select("rank", *work.TASK)


@query("q28_assignments", with_views(f"""
WITH {AVAILABLE_SQL}, {SIMPLE_SQL}, {QUEUE_SQL},
machines AS (
  SELECT *, row_number() OVER (ORDER BY stateless, score, pos) AS "rank" FROM scored)
SELECT "rank", task_id, product_name, quantity,
       greatest(1, CAST(trunc(quantity / 1e3) AS INTEGER)) AS duration_minutes, priority,
       machine_id, {half_up('score', 6)} AS score, wake
FROM ranked JOIN machines USING ("rank")""", *AVAILABLE_VIEWS, "latest_state", "assignments"))
def q28(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pairs = work.assign(_queue(t), stored(_scored(t), "scored"), SCENARIO)
    return pairs.withColumns({"duration_minutes": rules.task_minutes("quantity", SCENARIO),
                              "score": rounded("score", 6)})


IDLE_SQL = f"""activity AS (
  SELECT machine_id, max(event_time) AS last_activity FROM (
    SELECT machine_id, event_time FROM assignments WHERE event_time <= {MONTH_END}
    UNION ALL
    SELECT machine_id, event_time + to_minutes(duration_minutes) FROM assignments
    WHERE event_time + to_minutes(duration_minutes) <= {MONTH_END}) GROUP BY machine_id)"""


@query("q30_idle_shutdown", with_views(f"""
WITH {HELD_NOW}, {ROSTER_STATUS}, {IDLE_SQL}
SELECT machine_id, 'IDLE' AS statut, idle AS idle_seconds,
       'Économie énergie - inactif ' || printf('%.0f', round(idle / 60)) || ' min' AS details
FROM (SELECT *, date_diff('microsecond', coalesce(last_activity, TIMESTAMP '2024-01-01'),
                          {MONTH_END}) / 1e6 AS idle
      FROM roster_status LEFT JOIN activity USING (machine_id))
WHERE statut = 'DISPONIBLE' AND idle > 7200
  AND machine_id NOT IN (SELECT machine_id FROM held_now)""",
                                       "held", "latest_status", "roster", "assignments"))
def q30(spark, sf_dir):
    t = Tables(spark, sf_dir)
    status = latest.latest_status(t.status_events(), AS_OF, SCENARIO.status_lookback)
    begun = latest.lookback(t.assignments(), "event_time", AS_OF, None)
    ended = latest.lookback(work.completed(t.assignments(), AS_OF), "event_time", AS_OF, None)
    return fleet.idle_shutdowns(t.roster(), status, work.still_held(t.held(), AS_OF),
                                fleet.last_activity(begun, ended), RUN_START, AS_OF,
                                work_waiting=False, p=SCENARIO)


@query("q39_completed_tasks", with_views(f"""
WITH {HELD_NOW}, {STATE_SQL}
SELECT machine_id, task_id, 'DISPONIBLE' AS statut, 'Tâche ' || task_id || ' terminée' AS details
FROM held WHERE machine_id NOT IN (SELECT machine_id FROM held_now)
UNION ALL
SELECT machine_id, task_id, 'ASSIGNEE', 'Tâche ' || task_id FROM held_now
WHERE machine_id NOT IN (SELECT machine_id FROM active)""", "held", "flow"))
def q39(spark, sf_dir):
    """Status rows of one epoch: finished tasks free their machine, held ones run."""
    t = Tables(spark, sf_dir)
    alerts = lifecycle.active_alerts(_flow(t), AS_OF, SCENARIO)
    done = work.completed(t.held(), AS_OF).drop("event_time")
    return done.unionByName(work.reconciled(work.still_held(t.held(), AS_OF), alerts))


AGE = f"date_diff('microsecond', event_time, {MONTH_END})"


@query("q39b_task_records", with_views(f"""
SELECT machine_id, task_id, duration_minutes,
       {half_up(f"least(1e0, {AGE} / 1e6 / (duration_minutes * 6e1))", 6)} AS progress,
       {half_up(f"greatest(0e0, duration_minutes - {AGE} / 6e7)", 6)} AS time_remaining
FROM held""", "held"))
def q39b(spark, sf_dir):
    record = work.task_record(Tables(spark, sf_dir).held(), AS_OF)
    return record.select("machine_id", "task_id", "duration_minutes",
                         rounded("progress", 6).alias("progress"),
                         rounded("time_remaining", 6).alias("time_remaining"))


# ---- views -------------------------------------------------------------------------

@query("q32_floor_view", with_views(f"""
WITH pauses AS (
  SELECT machine_id, max(event_time) AS pause_start FROM flow
  WHERE effect = 'PAUSE' AND event_time <= {MONTH_END}
    AND event_time > {MONTH_END} - INTERVAL 12 HOUR GROUP BY machine_id),
task AS (
  SELECT machine_id, event_time AS started, task_id, product_name, duration_minutes
  FROM (SELECT machine_id, event_time, seq, task_id, product_name,
               greatest(1, CAST(trunc(quantity / 1e3) AS INTEGER)) AS duration_minutes
        FROM assignments)
  WHERE event_time <= {MONTH_END} AND event_time > {MONTH_END} - INTERVAL 12 HOUR
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_time DESC, seq DESC) = 1),
v AS (
  SELECT r.machine_id, pos, coalesce(statut, 'DISPONIBLE') AS statut,
         coalesce(temperature, 45e0) AS temperature, coalesce(charge_travail, 25e0) AS charge,
         task_id, product_name, started, duration_minutes, pause_start,
         date_diff('microsecond', started, {MONTH_END}) / 1e6 AS elapsed
  FROM roster r LEFT JOIN latest_status USING (machine_id) LEFT JOIN latest_state
    USING (machine_id) LEFT JOIN pauses USING (machine_id) LEFT JOIN task USING (machine_id))
SELECT machine_id, pos, statut AS status, label AS status_label, {half_up('temperature', 1)}
         AS temperature,
       {half_up('charge', 1)} AS charge, CASE WHEN statut = 'ASSIGNEE' THEN task_id END AS task,
       CASE WHEN statut = 'ASSIGNEE' THEN product_name END AS product,
       CASE WHEN statut = 'ASSIGNEE' AND started IS NOT NULL THEN
         {half_up('greatest(0e0, least(1e0, elapsed / (duration_minutes * 6e1)))', 3)} END AS progress,
       CASE WHEN statut = 'ASSIGNEE' THEN epoch_us(started) / 1e6 END AS task_started,
       CASE WHEN statut = 'ASSIGNEE' THEN CAST(duration_minutes AS BIGINT) * 60 END
         AS task_duration,
       CASE WHEN statut = 'ASSIGNEE' AND started IS NOT NULL THEN CAST(greatest(0,
         trunc(duration_minutes * 6e1 - elapsed)) AS BIGINT) END AS task_time_remaining,
       CASE WHEN statut = 'PAUSE' AND pause_start IS NOT NULL THEN CAST(greatest(0, trunc(21600
         - date_diff('microsecond', pause_start, {MONTH_END}) / 1e6)) AS BIGINT) END
         AS time_remaining
FROM v JOIN {ENUM} USING (statut)""", "roster", "latest_status", "latest_state", "flow",
                                    "assignments"))
def q32(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pauses = lifecycle.known(t.alert_events()).where(F.col("effect") == "PAUSE")
    return floor.floor_view(t.roster(), t.status_events(), t.readings(), pauses, _long_tasks(t),
                            AS_OF, SCENARIO)


@query("q32b_tasks_view", with_views(f"""
SELECT task_id AS id, machine_id AS machine, product_name AS product, duration_minutes AS duration
FROM assignments WHERE event_time <= {MONTH_END} AND event_time > {MONTH_END} - INTERVAL 2 HOUR
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_time DESC, seq DESC) = 1""",
                                     "assignments"))
def q32b(spark, sf_dir):
    return floor.tasks_view(Tables(spark, sf_dir).assignments(), AS_OF, SCENARIO)


STATS_SQL = """stats AS (
  SELECT CAST(event_time AS DATE) + INTERVAL 1 DAY - INTERVAL 1 SECOND AS event_time,
         max(seq) AS seq, count(*) AS total,
         count(CASE WHEN product_name = 'F' THEN 1 END) AS completed,
         count(CASE WHEN product_name = 'P' THEN 1 END) AS interrupted,
         count(CASE WHEN product_name = 'O' THEN 1 END) AS in_queue
  FROM assignments GROUP BY 1)"""


def _stats(t: Tables):
    """Counter rows as an orchestration run would leave them: one per day."""
    day = F.date_trunc("day", "event_time").cast("timestamp_ntz")

    def having(status):
        return F.count(F.when(F.col("product_name") == status, 1))

    return (t.assignments().groupBy((day + F.expr("INTERVAL 86399 SECONDS")).alias("event_time"))
            .agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("total"),
                 having("F").alias("completed"), having("P").alias("interrupted"),
                 having("O").alias("in_queue"))
            .withColumns({c: F.lit(0).cast("long")
                          for c in ("pauses_expired", "emergency_returns", "repairs")}))


@query("q32c_kpi_view", with_views(f"""
WITH {STATS_SQL},
k AS (SELECT * FROM stats WHERE event_time <= {MONTH_END}
        AND event_time > {MONTH_END} - INTERVAL 24 HOUR ORDER BY event_time DESC LIMIT 1)
SELECT count(CASE statut WHEN 'DISPONIBLE' THEN 1 END) AS disponible,
       count(CASE statut WHEN 'ASSIGNEE' THEN 1 END) AS assignee,
       count(CASE statut WHEN 'PAUSE' THEN 1 END) AS pause,
       count(CASE statut WHEN 'ARRET' THEN 1 END) AS arret,
       count(CASE statut WHEN 'IDLE' THEN 1 END) AS idle,
       coalesce((SELECT total FROM k), 0) AS total,
       coalesce((SELECT completed FROM k), 0) AS completed,
       coalesce((SELECT interrupted FROM k), 0) AS interrupted,
       coalesce((SELECT in_queue FROM k), 0) AS in_queue,
       CAST(0 AS BIGINT) AS pauses_expired, CAST(0 AS BIGINT) AS emergency_returns,
       CAST(0 AS BIGINT) AS repairs
FROM latest_status""", "latest_status", "assignments"))
def q32c(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return floor.kpi_view(t.status_events(), _stats(t), AS_OF, SCENARIO)


@query("q32d_queue_size", with_views(f"""
WITH {STATS_SQL}
SELECT coalesce((SELECT arg_max(in_queue, event_time) FROM stats
  WHERE event_time <= {MONTH_END} AND event_time > {MONTH_END} - INTERVAL 24 HOUR), 0)
  AS queue_size""", "assignments"))
def q32d(spark, sf_dir):
    return floor.queue_size(_stats(Tables(spark, sf_dir)), AS_OF, SCENARIO)
