"""Task side: queue order, assignment by rank, completion and interruption."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantwatch.functions import rules
from plantwatch.functions.times import instant, micros, plus_seconds, seconds_between
from plantwatch.operators.latest import asof_join
from plantwatch.operators.ordered import arrange, rank_rows, running_sums, sliced
from plantwatch.params import DEFAULTS, Params

TASK = ["task_id", "product_name", "quantity", "duration_minutes", "priority"]


PLACE = ["_lane", "_at", "seq", "task_id"]


def _placed(queue: DataFrame) -> DataFrame:
    """Queue rows with their place (`PLACE`).

    Urgent tasks first; among equals, tasks put back at the head (the latest one
    put back leads) and then by arrival.
    """
    keyed = queue.withColumns({
        "_urgent": F.when(F.col("priority") == "HAUTE", 0).otherwise(1),
        "_back": F.coalesce(-F.col("requeue_seq"), F.lit(1)).cast("long"),
        "_at": micros("event_time"),
    })
    # Urgency and head place first as one number, so that slicing sees arrival next.
    keyed = keyed.withColumn("_lane", F.when(F.col("_back") < 1, F.col("_back") - 1).otherwise(0))
    lane = F.col("_urgent").cast("double") * 1e15 + F.col("_lane")
    return keyed.withColumn("_lane", lane).drop("_urgent", "_back")


def queue_head(queue: DataFrame, first: int, p: Params = DEFAULTS) -> DataFrame:
    """At least the `first` tasks of the queue: just those, unless one task can't sort so many."""
    if first > p.max_top:
        return queue
    return _placed(queue).orderBy(*PLACE).limit(first).select(*queue.columns)


def queue_ranks(queue: DataFrame, p: Params = DEFAULTS, first: int | None = None) -> DataFrame:
    """Order in which tasks leave the queue; with `first`, of as many tasks at its head."""
    if first is not None:
        queue = queue_head(queue, first, p)
    return rank_rows(_placed(queue), PLACE, "rank", p=p).drop("_at", "_lane")


def machine_ranks(scored: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Candidates by score, stateless ones last, roster order on ties."""
    keyed = scored.withColumn("_score", F.coalesce("score", F.lit(1e300)))
    return rank_rows(keyed, ["_score", "pos", "machine_id"], "rank", p=p).drop("_score")


def assign(queue: DataFrame, scored: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Best machine takes the first task, the next best the second, and so on.

    A score depends on neither the task nor earlier picks, so the loop of picks
    is a join on rank. Both sides meet one to one, and of the queue only as many
    tasks as there are machines are ranked.
    """
    tasks = queue_ranks(queue, p, scored.count()).select("rank", *TASK)
    machines = machine_ranks(scored, p).select("rank", "machine_id", "score", "wake")
    return tasks.join(machines, "rank")


def remaining_queue(queue: DataFrame, assigned: DataFrame) -> DataFrame:
    return queue.join(assigned.select("task_id"), "task_id", "left_anti")


def completed(held: DataFrame, as_of) -> DataFrame:
    """Held tasks whose time is over, with the status row they cause."""
    now = instant(held, "event_time", as_of)
    # Fixed value: the text of a completion.
    return (held.where(rules.task_done("event_time", "duration_minutes", now))
            .select("machine_id", "task_id", F.lit("DISPONIBLE").alias("statut"),
                    F.format_string("Tâche %s terminée", "task_id").alias("details"),
                    plus_seconds("event_time", F.col("duration_minutes") * 60)
                    .alias("event_time")))


def still_held(held: DataFrame, as_of) -> DataFrame:
    now = instant(held, "event_time", as_of)
    return held.where(~rules.task_done("event_time", "duration_minutes", now))


def reconciled(held: DataFrame, alerts: DataFrame) -> DataFrame:
    """Machines that hold a task and are not blocked are running."""
    # Fixed value: the text of a running task.
    return (held.join(alerts.select("machine_id"), "machine_id", "left_anti")
            .select("machine_id", "task_id", F.lit("ASSIGNEE").alias("statut"),
                    F.format_string("Tâche %s", "task_id").alias("details")))


def task_record(tasks: DataFrame, as_of) -> DataFrame:
    """Flat view of a task with progress and minutes left."""
    now = instant(tasks, "event_time", as_of)
    return tasks.withColumns({
        "progress": rules.task_progress("event_time", "duration_minutes", now),
        "time_remaining": rules.task_minutes_left("event_time", "duration_minutes", now)})


def interruptions(stops: DataFrame, assignments: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Tasks cut short by a real stop of their machine.

    A stop hits the task the machine runs at that time; the first stop takes the
    task away. Below the done ratio the task goes back to the queue, else it
    counts as completed. A pause keeps its task and is not passed in here.
    """
    hit = asof_join(stops.select("machine_id", "event_time", "seq"),
                    assignments, "machine_id", "event_time", "event_time",
                    ["task_id", "product_name", "quantity", "duration_minutes", "priority"],
                    prefix="task_", p=p)
    elapsed = seconds_between("task_event_time", "event_time")
    running = hit.where(F.col("task_task_id").isNotNull()
                        & (elapsed < F.col("task_duration_minutes") * 60))
    first = (running.groupBy("machine_id", "task_task_id")
             .agg(F.min_by(F.struct("event_time", "seq", "task_event_time", "task_product_name",
                                    "task_quantity", "task_duration_minutes", "task_priority"),
                           F.struct("event_time", "seq")).alias("s")))
    return _outcome(first.select(
        F.col("task_task_id").alias("task_id"), "machine_id",
        F.col("s.task_event_time").alias("started"), F.col("s.event_time").alias("event_time"),
        F.col("s.seq").alias("seq"), F.col("s.task_product_name").alias("product_name"),
        F.col("s.task_quantity").alias("quantity"),
        F.col("s.task_duration_minutes").alias("duration_minutes")), p)


def held_interruptions(stops: DataFrame, held: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """As `interruptions`, for the one task each machine holds at the start of an epoch.

    Stops come after the task began, as an epoch starts with what its predecessor
    assigned, so the first one counts; a machine with many stops costs one row.
    """
    tasks = held.select("machine_id", "task_id", F.col("event_time").alias("started"),
                        "product_name", "quantity", "duration_minutes")
    first = stops.groupBy("machine_id").agg(
        F.min(F.struct("event_time", "seq")).alias("s"))
    hit = first.join(tasks, "machine_id").select(
        "*", F.col("s.event_time").alias("event_time"), F.col("s.seq").alias("seq")).drop("s")
    running = seconds_between("started", "event_time")
    return _outcome(hit.where((running >= 0) & (running < F.col("duration_minutes") * 60)), p)


def _outcome(hits: DataFrame, p: Params) -> DataFrame:
    progress = rules.task_progress("started", "duration_minutes", F.col("event_time"))
    return hits.select(
        "task_id", "machine_id", progress.alias("progress"), "event_time", "seq", "product_name",
        "quantity", "duration_minutes",
        F.when(progress < p.done_ratio, "REQUEUED").otherwise("COMPLETED").alias("outcome"))


def requeued(cut_short: DataFrame) -> DataFrame:
    """Interrupted tasks as urgent queue rows at the head; they start from zero."""
    return cut_short.where(F.col("outcome") == "REQUEUED").select(
        "task_id", "product_name", "quantity", "duration_minutes",
        F.lit("HAUTE").alias("priority"), "event_time", "seq",
        micros("event_time").alias("requeue_seq"))


def queue_with_requeued(orders: DataFrame, cut_short: DataFrame) -> DataFrame:
    """Orders as a queue in which interrupted tasks stand at the head again.

    One join on the task: those that counted as completed leave the queue.
    """
    hit = cut_short.select("task_id", "outcome", F.col("event_time").alias("_at"),
                           F.col("seq").alias("_seq"), F.col("duration_minutes").alias("_minutes"))
    back = F.col("outcome") == "REQUEUED"
    return (orders.join(hit, "task_id", "left")
            .where(F.col("outcome").isNull() | back)
            .select("task_id", "product_name", "quantity",
                    F.coalesce("_minutes", "duration_minutes").alias("duration_minutes"),
                    F.when(back, "HAUTE").otherwise(F.col("priority")).alias("priority"),
                    F.coalesce("_at", "event_time").alias("event_time"),
                    F.coalesce("_seq", "seq").alias("seq"), F.col("_seq").alias("requeue_seq")))


def task_log(orders: DataFrame, assignments: DataFrame) -> DataFrame:
    """Enqueue, assign and complete events of every task, with the queue change."""
    def events(df, kind, ts, delta):
        return df.select("task_id", F.lit(kind).alias("kind"), ts.alias("event_time"),
                         F.lit(delta).alias("delta"), "seq")
    done = plus_seconds("event_time", F.col("duration_minutes") * 60)
    return (events(orders, "ENQUEUE", F.col("event_time"), 1)
            .unionByName(events(assignments, "ASSIGN", F.col("event_time"), -1))
            .unionByName(events(assignments, "COMPLETE", done, 0)))


def task_counters(log: DataFrame, cut_short: DataFrame, as_of) -> DataFrame:
    """Total, completed, interrupted and in_queue at `as_of`.

    A task that was cut short has no completion of its own: below the ratio it
    is back in the queue, else the stop completed it.
    """
    now = instant(log, "event_time", as_of)
    stops = cut_short.where(F.col("event_time") <= now)
    plain = (log.where(F.col("event_time") <= now)
             .join(stops.select("task_id", F.lit("COMPLETE").alias("kind")),
                   ["task_id", "kind"], "left_anti")
             .groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
    outcomes = stops.groupBy(F.col("outcome").alias("kind")).agg(F.count(F.lit(1)).alias("n"))

    def n(*kinds):
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))

    return plain.unionByName(outcomes).agg(
        n("ENQUEUE").alias("total"), n("COMPLETE", "COMPLETED").alias("completed"),
        n("REQUEUED").alias("interrupted"),
        (n("ENQUEUE") - n("ASSIGN") + n("REQUEUED")).alias("in_queue"))


def queue_depth(log: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Queue size after each enqueue and assign."""
    moves = (log.where(F.col("delta") != 0)
             .withColumn("_kind", F.when(F.col("kind") == "ENQUEUE", 0).otherwise(1)))
    o = sliced(moves, [], ["event_time", "seq", "_kind"], p)
    return running_sums(o, size=F.col("delta").cast("long")).select(
        "event_time", "seq", "kind", "task_id", "delta", "size")


def queue_growth(depth: DataFrame) -> DataFrame:
    """Growth since the sample before, at most 3. A sample follows one move, so the
    size before it is the size less the move."""
    # Fixed value: at most three are shown at once.
    before = F.col("size") - F.col("delta")
    return depth.withColumn("growth", F.least(F.lit(3), F.greatest(
        F.lit(0), F.col("size") - before)).cast("int"))


def sampled_growth(samples: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Growth between samples taken at any interval, at most 3."""
    o = arrange(samples, [], ["event_time", "seq"], previous=1, p=p)
    grown = F.col("size") - F.lag("size", 1, 0).over(o.window)
    return o.finish(o.df.withColumn("growth", F.least(F.lit(3), F.greatest(F.lit(0), grown))))


def merge_counters(*rows: DataFrame) -> DataFrame:
    """Counter sets of one row each side by side, without a join."""
    merged = rows[0]
    for other in rows[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])
