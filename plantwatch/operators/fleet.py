"""Machine side: state counts, availability, idling and choice of a machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from plantwatch import schemas
from plantwatch.functions import rules
from plantwatch.functions.times import instant, plus_seconds, seconds_between
from plantwatch.operators.ordered import rank_rows
from plantwatch.params import DEFAULTS, Params

PAGE = 100  # machines per text of a reason report


def with_status(roster: DataFrame, latest: DataFrame) -> DataFrame:
    """Every machine with its latest status; a silent machine counts as available.

    Both sides have one row per machine; the engine broadcasts the smaller one
    when its measured size allows, and sort-merges otherwise.
    """
    return roster.join(latest.select("machine_id", "statut"), "machine_id", "left").withColumn(
        "statut", F.coalesce("statut", F.lit("DISPONIBLE")))


def machines_by_status(latest: DataFrame) -> DataFrame:
    """Five fixed buckets, zero-filled; unknown statuses and silent machines do not count."""
    counts = latest.groupBy("statut").agg(F.count(F.lit(1)).alias("machines"))
    enum = latest.sparkSession.createDataFrame(
        [(s, i) for i, s in enumerate(schemas.STATUSES)],
        T.StructType([T.StructField("statut", T.StringType()),
                      T.StructField("position", T.IntegerType())]))
    return (F.broadcast(enum).join(counts, "statut", "left")  # five rows
            .select("position", "statut", rules.status_label("statut").alias("label"),
                    F.coalesce("machines", F.lit(0)).alias("machines")))


def fleet_counts(roster: DataFrame, latest: DataFrame, held: DataFrame) -> DataFrame:
    """One row of counts over the roster; a held task wins over the status."""
    tasks = held.select("machine_id", F.lit(True).alias("_held"))
    df = with_status(roster, latest).join(tasks, "machine_id", "left")
    busy = F.col("_held").isNotNull()

    def free_with(status):
        return F.count(F.when(~busy & (F.col("statut") == status), 1)).alias(status.lower())

    return df.agg(free_with("DISPONIBLE"), F.count(F.when(busy, 1)).alias("assignee"),
                  *[free_with(s) for s in ("PAUSE", "ARRET", "IDLE")])


def available_machines(roster: DataFrame, latest: DataFrame, held: DataFrame, alerts: DataFrame,
                       work_waiting: bool) -> DataFrame:
    """Machines that may take a task now; `wake` marks those that sleep."""
    asleep = F.col("statut") == "IDLE"
    ready = F.col("statut") == "DISPONIBLE"
    if work_waiting:
        ready = ready | asleep
    return (with_status(roster, latest).where(ready)
            .join(held.select("machine_id"), "machine_id", "left_anti")
            .join(alerts.select("machine_id"), "machine_id", "left_anti")
            .withColumn("wake", asleep))


def wake_events(chosen: DataFrame) -> DataFrame:
    """Status rows for sleeping machines that were given work."""
    # Fixed value: the text of a wake-up.
    return chosen.where("wake").select("machine_id", F.lit("DISPONIBLE").alias("statut"),
                                       F.lit("Réveil automatique").alias("details"))


def last_activity(*activity: DataFrame) -> DataFrame:
    """Newest of all assign, complete and wake times per machine."""
    events = activity[0].select("machine_id", "event_time")
    for other in activity[1:]:
        events = events.unionByName(other.select("machine_id", "event_time"))
    return events.groupBy("machine_id").agg(F.max("event_time").alias("last_activity"))


def idle_shutdowns(roster: DataFrame, latest: DataFrame, held: DataFrame, activity: DataFrame,
                   started, as_of, work_waiting: bool, p: Params = DEFAULTS) -> DataFrame:
    """Free machines without activity for too long. None while work waits.

    A machine without any activity counts from `started`, the start of the run.
    """
    candidates = (with_status(roster, latest).where(F.col("statut") == "DISPONIBLE")
                  .join(held.select("machine_id"), "machine_id", "left_anti")
                  .join(activity, "machine_id", "left"))
    since = F.coalesce("last_activity", instant(activity, "last_activity", started))
    idle = seconds_between(since, instant(activity, "last_activity", as_of))
    found = candidates.withColumn("idle_seconds", idle).where(
        F.col("idle_seconds") > p.idle_seconds)
    if work_waiting:
        found = found.where(F.lit(False))
    # Fixed value: the text of a shutdown.
    return found.select("machine_id", F.lit("IDLE").alias("statut"), "idle_seconds", F.format_string(
        "Économie énergie - inactif %.0f min", F.col("idle_seconds") / 60).alias("details"))


# ---- choice ----------------------------------------------------------------

def scored_simple(available: DataFrame, state: DataFrame) -> DataFrame:
    """Candidates with score; a machine without any state comes after all others."""
    known = state.select("machine_id", "temperature", "charge_travail",
                         F.lit(True).alias("_known"))
    has_state = F.col("_known").isNotNull()
    return (available.join(known, "machine_id", "left")
            .withColumn("score", F.when(has_state, rules.simple_score("temperature",
                                                                      "charge_travail")))
            .withColumn("stateless", (~has_state).cast("int"))
            .drop("_known"))


def best_simple(scored: DataFrame) -> DataFrame:
    return scored.orderBy("stateless", "score", "pos").limit(1)


def assess(roster: DataFrame, state: DataFrame, advice: DataFrame, occupied: DataFrame, as_of,
           p: Params = DEFAULTS) -> DataFrame:
    """Roster with availability and reason, from state, model advice and occupation.

    All four sides have one row per machine.
    """
    df = (roster.join(state, "machine_id", "left").join(advice, "machine_id", "left")
          .join(occupied, "machine_id", "left"))
    now = instant(occupied, "busy_until", as_of)
    verdict = rules.availability(
        {"busy_until": F.col("busy_until"), "etat": F.col("etat"), "action": F.col("action"),
         "probability": F.col("probabilite_panne"), "temperature": F.col("temperature"),
         "load": F.col("charge_travail")}, now, p)
    return df.withColumn("_v", verdict).select("*", "_v.available", "_v.reason").drop("_v")


def scored_detailed(assessed: DataFrame) -> DataFrame:
    return assessed.where("available").withColumn("score", rules.detailed_score(
        "temperature", "charge_travail", "action", "probabilite_panne"))


def best_detailed(assessed: DataFrame) -> DataFrame:
    """The free machine with the lowest score; the roster order decides ties."""
    # Fixed value: the text of a selection.
    return (scored_detailed(assessed).orderBy("score", "pos").limit(1)
            .withColumn("reason", F.format_string("Sélectionnée (score: %.1f)", F.col("score")))
            .select("machine_id", "score", "reason"))


def reason_report(assessed: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Why machines are not available, as joined text in roster order.

    A text holds PAGE machines, so a large fleet gives several whole pages
    instead of one unbounded value.
    """
    blocked = rank_rows(assessed.where(~F.col("available")).select("machine_id", "pos", "reason"),
                        ["pos", "machine_id"], "rank", p=p)
    entry = F.struct("rank", F.concat_ws(": ", "machine_id", "reason").alias("text"))
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"])
    return (blocked.withColumn("page", F.floor((F.col("rank") - 1) / PAGE))
            .groupBy("page").agg(F.count(F.lit(1)).alias("machines"),
                                 F.concat_ws(", ", entries).alias("reasons")))


def no_machine_text(report: DataFrame) -> DataFrame:
    """The refusal text per page of the report."""
    # Fixed value: the text of a refusal.
    return report.withColumn("text", F.concat(F.lit("Aucune machine disponible ("),
                                              F.col("reasons"), F.lit(")")))


def occupied_until(held: DataFrame) -> DataFrame:
    return held.select("machine_id", plus_seconds(
        "event_time", F.col("duration_minutes") * 60).alias("busy_until"))
