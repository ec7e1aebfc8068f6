"""Alert lifecycle per machine as ordered set logic over the event flow.

An event has machine_id, event_time, seq, source ('ml' or 'maintenance') and
action. PAUSE starts or restarts a timed pause, a forced stop holds until a
repair, and a repair or an early return clears. A sensor alert never stops a
machine for good: its ARRETER counts as PAUSE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantwatch.functions import rules
from plantwatch.functions.times import instant, micros, plus_seconds, seconds_between
from plantwatch.operators.ordered import HALO, Ordered, arrange
from plantwatch.params import DEFAULTS, Params

FLOW = ["machine_id", "event_time", "seq", "source", "action"]
EARLY_RETURN = "RETOUR_URGENT"


def event_flow(*streams: DataFrame) -> DataFrame:
    """Sensor alerts, forced stops and repairs as one flow per machine."""
    flow = streams[0].select(*FLOW)
    for other in streams[1:]:
        flow = flow.unionByName(other.select(*FLOW))
    return flow


def effect() -> Column:
    """What an event does: PAUSE, ARRET or CLEAR; NULL for an unknown action."""
    sensor = F.col("source") == "ml"
    return (F.when(sensor & F.col("action").isin("PAUSE", "ARRETER"), "PAUSE")
            .when(~sensor & (F.col("action") == "FORCER_ARRET"), "ARRET")
            .when(~sensor & F.col("action").isin("REPARER", EARLY_RETURN), "CLEAR"))


def known(flow: DataFrame) -> DataFrame:
    return flow.withColumn("effect", effect()).where(F.col("effect").isNotNull())


def rejected(flow: DataFrame) -> DataFrame:
    return flow.where(effect().isNull())


EFFECTS = ("PAUSE", "ARRET", "CLEAR")


def _state_before(o: Ordered, seen: Column | None = None, mark: str = "_") -> dict:
    """Latest pause, stop and clear before each event, as (time, seq); with `seen`, of such events alone."""
    at = F.struct("event_time", "seq")
    return {f"{mark}{e}": F.last(F.when(_of(e, seen), at), ignorenulls=True).over(o.before) for e in EFFECTS}


def _of(name: str, seen: Column | None) -> Column:
    return F.col("effect") == name if seen is None else (F.col("effect") == name) & seen


def _judged(df: DataFrame, p: Params, mark: str = "_") -> DataFrame:
    """`df` with the changes that each event makes (array `<mark>changes`), by its `_state_before`."""
    pause, stop, clear = (f"{mark}{e}" for e in EFFECTS)
    down, waiting, lapsed, paused = (f"{mark}{n}" for n in ("down", "waiting", "lapsed", "paused"))

    def after_clear(c):
        return F.col(c).isNotNull() & (F.col(clear).isNull() | (F.col(c) > F.col(clear)))

    timer = seconds_between(f"{pause}.event_time", "event_time")
    df = (df.withColumn(down, after_clear(stop))
          .withColumn(waiting, after_clear(pause) & ~F.col(down))
          .withColumn(lapsed, F.col(waiting) & (timer > p.pause_seconds))
          .withColumn(paused, F.col(waiting) & ~F.col(lapsed)))
    happened = (
        F.when(F.col(down) & (F.col("effect") != "CLEAR"), None)
        .when(F.col("effect") == "ARRET", F.lit("STOPPED"))
        .when((F.col("effect") == "PAUSE") & F.col(paused), F.lit("PAUSE_RESTARTED"))
        .when(F.col("effect") == "PAUSE", F.lit("PAUSE_STARTED"))
        .when(F.col(down) | F.col(paused),
              F.when(F.col("action") == EARLY_RETURN, F.lit("EARLY_RETURN"))
              .otherwise(F.lit("REPAIRED"))))

    def change(name, at, condition):
        return F.when(condition, F.struct(name.alias("transition"), at.alias("at")))

    return df.withColumn(f"{mark}changes", F.array_compact(F.array(
        change(F.lit("PAUSE_EXPIRED"), plus_seconds(f"{pause}.event_time", F.lit(p.pause_seconds)), F.col(lapsed)),
        change(happened, F.col("event_time"), happened.isNotNull()))))


def transitions(flow: DataFrame, as_of=None, p: Params = DEFAULTS) -> DataFrame:
    """Every change of an alert: started, restarted, expired, stopped, repaired.

    With `as_of`, pauses that ran out by then without a later event expire too.
    Rows that carry `_halo` = true (kept state of a stream) are context only.
    """
    events = known(flow)
    o = arrange(events, ["machine_id"], ["event_time", "seq"], latest=[_of(e, None) for e in EFFECTS], p=p)
    df = _judged(o.df.withColumns(_state_before(o)), p)
    seen = (o.finish(df)
            .select("machine_id", "seq", F.explode("_changes").alias("_c"))
            .select("machine_id", "_c.transition", F.col("_c.at").alias("event_time"), "seq"))
    if as_of is None:
        return seen
    now = instant(flow, "event_time", as_of)
    quiet = (alert_state(events, as_of, p, prepared=True)
             .where(F.col("state") == "EXPIRED")
             .select("machine_id", F.lit("PAUSE_EXPIRED").alias("transition"),
                     plus_seconds("since", F.lit(p.pause_seconds)).alias("event_time"),
                     F.col("seq")))
    return seen.unionByName(quiet).where(F.col("event_time") <= now)


def corrections(flow: DataFrame, old, new, p: Params = DEFAULTS) -> DataFrame:
    """What `transitions` says as of `new` and did not say as of `old` (`change` 1), and the reverse (-1).

    Rows whose `_new` is true were not there as of `old`, which is None if nothing was said before.
    Both answers come from one shuffle and one sort, with the state before each event once over
    all events and once over those that were there. The input is read three times.
    """
    events = known(flow).where((F.col("event_time") <= instant(flow, "event_time", new)) | F.col(HALO))
    there = ~F.col("_new")
    said = F.lit(False) if old is None else there & (F.col("event_time") <= instant(flow, "event_time", old))
    o = arrange(events, ["machine_id"], ["event_time", "seq"],
                latest=[_of(e, seen) for seen in (None, there) for e in EFFECTS], p=p)
    df = o.df.withColumns({**_state_before(o), **_state_before(o, there, "_was_")})
    df = o.finish(_judged(_judged(df, p), p, "_was_"))
    df = df.withColumn("_was_changes", F.when(said, F.col("_was_changes")).otherwise(F.slice("_was_changes", 1, 0)))

    # pauses that ran out without a later event
    last = events.groupBy("machine_id").agg(*_latest(None, "_"), *_latest(said, "_was_"))
    quiet = last.select("machine_id", *[
        F.when(_state(instant(flow, "event_time", at), p, mark) == "EXPIRED", F.col(f"{mark}PAUSE")).alias(f"{mark}out")
        for mark, at in (("_", new), ("_was_", new if old is None else old))])
    quiet = quiet.where(~F.col("_out").eqNullSafe(F.col("_was_out")))

    def signed(one, other, n):
        return F.transform(F.array_except(one, other), lambda c: F.struct(
            c["transition"].alias("transition"), c["at"].alias("event_time"), F.lit(n).alias("change")))
    changed = (df.select("machine_id", "seq", F.explode(F.concat(
        signed("_changes", "_was_changes", 1), signed("_was_changes", "_changes", -1))).alias("_c"))
        .select("machine_id", "_c.transition", "_c.event_time", "seq", "_c.change"))
    for mark, n in (("_", 1), ("_was_", -1)):
        changed = changed.unionByName(quiet.where(F.col(f"{mark}out").isNotNull()).select(
            "machine_id", F.lit("PAUSE_EXPIRED").alias("transition"),
            plus_seconds(f"{mark}out.event_time", F.lit(p.pause_seconds)).alias("event_time"),
            F.col(f"{mark}out.seq").alias("seq"), F.lit(n).alias("change")))
    # what two rows say, one each way, cancels out
    return (changed.groupBy("machine_id", "transition", "event_time", "seq")
            .agg(F.sum("change").cast("int").alias("change")).where("change <> 0"))


def _latest(seen: Column | None, mark: str = "") -> list:
    """Aggregates: latest pause, stop and clear, as (time, seq); with `seen`, of such events alone."""
    at = F.struct("event_time", "seq")
    return [F.max(F.when(_of(e, seen), at)).alias(f"{mark}{e}") for e in EFFECTS]


def _state(now: Column, p: Params, mark: str = "") -> Column:
    """ARRET, PAUSE, EXPIRED or NULL, by the `_latest` of a machine."""
    pause, stop, clear = (F.col(f"{mark}{e}") for e in EFFECTS)

    def holds(c):
        return c.isNotNull() & (clear.isNull() | (c > clear))

    lapsed = rules.pause_expired(F.lit("PAUSE"), f"{mark}PAUSE.event_time", now, p)
    return (F.when(holds(stop), "ARRET")
            .when(holds(pause) & lapsed, "EXPIRED").when(holds(pause), "PAUSE"))


def alert_state(flow: DataFrame, as_of, p: Params = DEFAULTS, prepared: bool = False) -> DataFrame:
    """State of each machine with an alert at `as_of`: ARRET, PAUSE or EXPIRED.

    Needs only the latest event of each kind, so it is one aggregation with
    map-side combine whatever the number of events per machine.
    """
    events = flow if prepared else known(flow)
    now = instant(events, "event_time", as_of)
    last = events.where(F.col("event_time") <= now).groupBy("machine_id").agg(*_latest(None))
    start = F.when(_state(now, p) == "ARRET", F.col("ARRET")).otherwise(F.col("PAUSE"))
    return (last.withColumns({"state": _state(now, p), "_start": start})
            .where(F.col("state").isNotNull())
            .select("machine_id", "state", F.col("_start.event_time").alias("since"),
                    F.col("_start.seq").alias("seq")))


def active_alerts(flow: DataFrame, as_of, p: Params = DEFAULTS) -> DataFrame:
    """Blocked machines with action, severity and whole seconds of pause left."""
    now = instant(flow, "event_time", as_of)
    paused = F.col("state") == "PAUSE"
    return (alert_state(flow, as_of, p).where(F.col("state") != "EXPIRED")
            .select("machine_id",
                    F.when(paused, "PAUSE").otherwise("ARRETER").alias("action"),
                    F.when(paused, "MOYENNE").otherwise("HAUTE").alias("severity"),
                    "since",
                    F.when(paused, rules.pause_seconds_left("since", now, p)).otherwise(0)
                    .alias("time_remaining")))


def session_starts(changes: DataFrame) -> DataFrame:
    """Start of each machine's latest unbroken pause: its place in the release order."""
    return (changes.where(F.col("transition") == "PAUSE_STARTED").groupBy("machine_id")
            .agg(F.max(F.struct("event_time", "seq")).alias("_first"))
            .select("machine_id", F.col("_first.event_time").alias("paused_since"),
                    F.col("_first.seq").alias("paused_seq")))


def early_return(alerts: DataFrame, starts: DataFrame, load: DataFrame,
                 p: Params = DEFAULTS) -> DataFrame:
    """The one paused machine to release when work waits and too few machines are free.

    `load` is one row: queue_size, available. Empty result when there is no need.
    """
    first = (alerts.where(F.col("action") == "PAUSE").join(starts, "machine_id")
             .orderBy("paused_since", "paused_seq").limit(1))
    urgent = (F.col("queue_size") > 0) & (F.col("available") < p.min_available)
    return (first.where(load.select(urgent).scalar())
            .withColumn("queue_size", load.select("queue_size").scalar())
            .select("machine_id", "paused_since", "time_remaining", "queue_size"))


def alert_counters(changes: DataFrame) -> DataFrame:
    def times(name):
        return F.count(F.when(F.col("transition") == name, 1))
    return changes.agg(times("PAUSE_EXPIRED").alias("pauses_expired"),
                       times("EARLY_RETURN").alias("emergency_returns"),
                       times("REPAIRED").alias("repairs"))


def pause_starts(changes: DataFrame) -> DataFrame:
    """Start markers of pauses, as epoch seconds and text."""
    return (changes.where(F.col("transition").isin("PAUSE_STARTED", "PAUSE_RESTARTED"))
            .select("machine_id", (micros("event_time") / 1e6).alias("pause_start_timestamp"),
                    F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                    .alias("pause_start_iso"), "event_time", "seq"))
