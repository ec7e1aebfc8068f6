"""Cut frames give the same rows as whole ones, however skewed the keys and times are."""

import pytest
from pyspark.sql import functions as F

from conftest import multiset
from plantwatch.operators import features, latest, lifecycle, metrics, ordered, work
from plantwatch.params import DEFAULTS

CUT = DEFAULTS.but(rows_per_slice=25)


@pytest.fixture(scope="module")
def skewed(tables):
    """A machine with a third of the rows; half of its rows share one time."""
    r = tables.readings()
    hot = F.col("seq") % 3 == 0
    r = r.withColumn("machine_id", F.when(hot, "HOT").otherwise(F.col("machine_id")))
    r = r.withColumn("event_time", F.when(
        hot & (F.col("seq") % 2 == 0),
        F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).otherwise(F.col("event_time")))
    return r.cache()


def test_heavy_keys_are_cut(skewed):
    o = ordered.sliced(skewed, ["machine_id"], ["event_time", "seq"], CUT)
    assert o.cut
    sizes = o.df.where("_slice >= 0").groupBy("machine_id", "_slice").count()
    assert {r.machine_id for r in sizes.collect()} >= {"HOT"}
    assert max(r["count"] for r in sizes.collect()) <= 4 * CUT.rows_per_slice


@pytest.mark.parametrize("parts", ["1", "7"])
def test_one_path_without_keys(spark, skewed, parts):
    """Ranks and running totals of a whole frame, whatever the number of ranges; ties share a range."""
    rows = sorted((r.event_time, r.seq, r.temperature) for r in skewed.collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        o = ordered.sliced(skewed, [], ["event_time", "seq"])
        assert o.cut and o.df.select(ordered.SLICE).distinct().count() == int(parts)
        got = ordered.running_sums(o, n=F.lit(1).cast("long")).select("n", "event_time", "seq", "temperature").orderBy("n").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in got] == [(i + 1, *r) for i, r in enumerate(rows)]


def test_more_heavy_keys_than_listed(skewed):
    p = CUT.but(rows_per_slice=3, max_listed_keys=2)
    assert multiset(features.rolling_features(skewed, p=p)) == multiset(
        features.rolling_features(skewed))


@pytest.mark.parametrize("operator", [
    lambda r, p: features.rolling_features(r, p=p),
    lambda r, p: features.changed_class(features.rule_scored(r), p=p),
    lambda r, p: features.feature_alerts(r, p=p),
    lambda r, p: features.next_failure(r, F.col("etat") == "arrete", p),
    lambda r, p: features.episode_steps(r.withColumn("episode_id", F.col("machine_id")), p),
    lambda r, p: ordered.rank_rows(r, ["event_time", "seq"], p=p),
    lambda r, p: features.status_transitions(
        r.select("machine_id", "event_time", "seq",
                 F.when(F.col("seq") % 4 < 2, "ASSIGNEE").otherwise("ARRET").alias("statut"),
                 F.concat(F.lit("T"), F.floor(F.col("seq") / 5)).alias("task_id")), p),
])
def test_cut_equals_whole(skewed, operator):
    assert multiset(operator(skewed, CUT)) == multiset(operator(skewed, DEFAULTS))


def test_asof(skewed):
    left = skewed.where("seq % 5 = 1").select("machine_id", "event_time", "seq")
    right = skewed.where("seq % 5 <> 1")

    def run(p):
        return latest.asof_join(left, right, "machine_id", "event_time", "event_time",
                                ["temperature"], "3 days", prefix="r_", p=p)
    assert multiset(run(CUT)) == multiset(run(DEFAULTS))
    assert run(CUT).count() == left.count()


def test_lifecycle(skewed):
    sensor = F.col("seq") % 7 < 5
    flow = skewed.select(
        "machine_id", "event_time", "seq",
        F.when(sensor, "ml").otherwise("maintenance").alias("source"),
        F.when(sensor, "PAUSE").when(F.col("seq") % 2 == 0, "REPARER").otherwise("FORCER_ARRET")
        .alias("action"))
    end = "2024-01-31 00:00:00"
    assert multiset(lifecycle.transitions(flow, end, CUT)) == multiset(
        lifecycle.transitions(flow, end, DEFAULTS))


def test_queue(tables):
    orders = tables.orders_in().withColumn("requeue_seq", F.when(
        F.col("seq") % 50 == 0, F.col("seq"))).withColumn("priority", F.when(
            F.col("requeue_seq").isNotNull(), "HAUTE").otherwise(F.col("priority")))
    # a third of all orders arrive at the same time
    orders = orders.withColumn("event_time", F.when(
        F.col("seq") % 3 == 0, F.lit("1998-01-01").cast("timestamp_ntz"))
        .otherwise(F.col("event_time")))
    assert multiset(work.queue_ranks(orders, CUT)) == multiset(work.queue_ranks(orders))
    log = work.task_log(tables.arrivals(), tables.assignments())
    assert multiset(work.queue_depth(log, CUT)) == multiset(work.queue_depth(log))


def test_average_precision(skewed):
    scored = skewed.withColumn("positive", F.col("seq") % 4 == 0)
    for p in (CUT, DEFAULTS):
        got = metrics.average_precision(scored, F.col("positive"), "temperature", p).first()[0]
        rows = sorted(((r.temperature, r.positive) for r in scored.collect()), reverse=True)
        total, seen, found, want, i = sum(r[1] for r in rows), 0, 0, 0.0, 0
        while i < len(rows):
            same = [r for r in rows[i:] if r[0] == rows[i][0]]
            seen, hits, i = seen + len(same), sum(r[1] for r in same), i + len(same)
            found += hits
            want += hits / total * found / seen
        assert got == pytest.approx(want)
