"""Start one job: `python -m plantwatch.run <job> --work <folder> [options]`, or the
same through spark-submit.

    archive      readings to the date-partitioned archive
    hot-state    readings to the served state
    energy       energy anomalies to serving and to the alert topic
    predict      failure probabilities to serving and to the alert topic
    alerts       change alerts to the alert topic
    lifecycle    starts, ends and stops of alerts to serving and to the system alerts
    orchestrate  orders, alerts and maintenance to assignments and statuses
    rollup       sums, counts and maxima per ten minutes to serving, for panels
    rejects      records that no job takes, to serving, with the reason
    compact      closed days of the archive to few files with statistics
    train        choose, fit and save a model from a table of episodes
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantwatch import session
from plantwatch.functions import decode
from plantwatch.operators import features, latest, learning
from plantwatch.params import DEFAULTS, Params
from plantwatch.sources import compaction, lake
from plantwatch.sources.bus import Bus
from plantwatch.operators.lifecycle import FLOW
from plantwatch.streaming import jobs, lifecycle
from plantwatch.streaming.orchestrate import Orchestrator, inbox

# Fixed value: the default fleet.
MACHINES = [f"POMPE-{i}" for i in range(1, 6)]


def arguments(argv=None):
    parser = argparse.ArgumentParser(description=__doc__,
                                     formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=["archive", "hot-state", "energy", "predict", "alerts",
                                        "compact", "lifecycle", "orchestrate", "rejects", "rollup", "train"])
    parser.add_argument("--work", required=True, help="shared folder for tables and checkpoints")
    parser.add_argument("--bus", default="", help="broker list, or folder of file topics")
    parser.add_argument("--bus-format", default="kafka")
    parser.add_argument("--model", help="folder of the saved model")
    parser.add_argument("--episodes", help="table of labelled episodes, for training")
    parser.add_argument("--roster", help="table of machine_id and pos; default: five pumps")
    parser.add_argument("--started", default="1970-01-01 00:00:00",
                        help="start of the run, from which silent machines count as idle")
    parser.add_argument("--before", help="first day that is not compacted; default: today")
    parser.add_argument("--single", action="store_true",
                        help="predict from lone readings instead of rolling features")
    parser.add_argument("--once", action="store_true", help="stop when the input is read")
    return parser.parse_args(argv)


def roster(spark: SparkSession, path: str | None) -> DataFrame:
    if path:
        return spark.read.parquet(path).select("machine_id", "pos")
    return spark.createDataFrame([(m, i) for i, m in enumerate(MACHINES)],
                                 "machine_id string, pos long")


def served_metrics(spark: SparkSession, serving: str, p: Params):
    """Latest temperature and workload per machine, from the served state."""
    def at(as_of):
        rows = lake.read_measurement(spark, serving, "etat_machines")
        recent = lake.measurement_lookback(rows, as_of, p.state_lookback)
        return latest.latest_fields(recent, ["machine_id"], ["temperature", "charge_travail"],
                                    "event_time", "epoch_id")
    return at


def train(spark: SparkSession, episodes: str, path: str, cfg=learning.DEFAULT_LEARNING):
    """`episodes` has episode_id, event_time, seq, failure_step and the five measures."""
    rows = spark.read.parquet(episodes).withColumn("machine_id", F.col("episode_id"))
    steps = features.episode_steps(features.rolling_features(rows))
    table = session.stored(steps.withColumn(
        "label", features.horizon_label("failure_step", "step")), "training")
    tuning, held_out = learning.split(table, cfg)
    name, model, summary = learning.select_and_train(tuning, table, path, cfg)
    judged = learning.predict(learning.fit(tuning, learning.candidates(cfg)[name]), held_out)
    return name, summary, learning.evaluation(judged)


def start(args, spark: SparkSession, p: Params = DEFAULTS):
    bus = Bus(spark, args.bus_format, args.bus)
    serving, checkpoint = f"{args.work}/serving", f"{args.work}/checkpoints/{args.job}"
    trigger = {"availableNow": True} if args.once else {}
    model = learning.load_model(spark, args.model)
    if args.job == "archive":
        return lake.archive_stream(bus.sensors(), f"{args.work}/archive", checkpoint, p, **trigger)
    if args.job == "hot-state":
        return jobs.hot_state(bus.sensors(), serving, checkpoint, p, **trigger)
    if args.job == "energy":
        return jobs.energy(bus.sensors(), serving, bus, checkpoint, p, **trigger)
    if args.job == "predict" and (model is None or args.single):
        # Without a model by rule; with one, each reading as if it stood alone.
        score = (lambda df: learning.failure_predictions(df, model, windowed=False)) \
            if model else None
        return jobs.predict(bus.sensors(), serving, bus, checkpoint, score, p, **trigger)
    if args.job in ("alerts", "predict"):
        readings = bus.sensors()
        state = jobs.FeatureState(spark, f"{args.work}/state/{args.job}",
                                  readings.select(*jobs.KEPT).schema, p)
        if args.job == "predict":
            return jobs.predict_rolling(readings, state, serving, bus, checkpoint,
                                        learning.scorer(model), p, **trigger)
        return jobs.ml_alerts(readings, state, bus, checkpoint, p, learning.scorer(model),
                              **trigger)
    if args.job == "rollup":
        return jobs.rollup(bus.sensors(), serving, checkpoint, p=p, **trigger)
    if args.job == "rejects":
        return jobs.rejects(bus, serving, checkpoint, p, **trigger)
    if args.job == "lifecycle":
        state = lifecycle.LifecycleState(spark, f"{args.work}/state/lifecycle", T.TimestampType(), p, delay_seconds=60)
        first, second = bus.flow()
        flow = first.select(*FLOW).unionByName(second.select(*FLOW))
        return lifecycle.lifecycle(flow, state, serving, checkpoint, bus, p, **trigger)
    # A timer keeps the plant going while the bus is quiet; it can't be read to an end.
    ticks = None if args.once else (
        spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        .select(F.col("timestamp").alias("event_time")))
    rows = inbox(decode.queue_rows(bus.orders(p)), *bus.flow(), ticks=ticks)
    plant = Orchestrator(roster(spark, args.roster), served_metrics(spark, serving, p),
                         f"{args.work}/state/orchestrate", bus, serving, T.TimestampType(),
                         args.started, p)
    return plant.start(rows, checkpoint, **(trigger or {"processingTime": p.epoch}))


def main(argv=None, spark: SparkSession | None = None):
    args = arguments(argv)
    spark = spark or session.build(f"plantwatch-{args.job}")
    if args.job == "train":
        name, summary, scores = train(spark, args.episodes, args.model)
        print(f"selected {name}")
        summary.show()
        scores.show()
        return
    if args.job == "compact":
        before = args.before or spark.sql("SELECT current_date()").first()[0]
        taken = compaction.compact(spark, f"{args.work}/archive", f"{args.work}/archive-compact", before)
        print(f"files taken: {taken}")
        return
    start(args, spark).awaitTermination()


if __name__ == "__main__":
    main()
