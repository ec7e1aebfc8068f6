"""Training, scoring and evaluation on episodes that do wear out."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window, functions as F

from plantwatch import run, schemas
from plantwatch.functions import decode
from plantwatch.operators import boosting, features, forest, learning, metrics
from plantwatch.session import stored, workdir
from plantwatch.sources import lake
from plantwatch.sources.bus import Bus

CFG = learning.Learning(trees=20, tree_depth=6, boosting_rounds=2, boosting_depth=3, folds=2,
                        regression_rounds=20)


@pytest.fixture(scope="module")
def episodes(spark):
    """40 machines of 60 steps; heat and vibration rise before the failure at step 59,
    and every fourth machine stays healthy."""
    noise = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) / 1000.0
    e, t = F.floor(F.col("id") / 60), F.col("id") % 60
    wear = F.when(e % 4 != 0, F.greatest(F.lit(0), t - 38) / 21.0).otherwise(0.0)
    df = spark.range(40 * 60).select(
        F.concat(F.lit("E"), e).alias("episode_id"), F.concat(F.lit("E"), e).alias("machine_id"),
        t.alias("seq"), F.lit("2024-01-01").cast("timestamp").alias("event_time"),
        (60 + 30 * wear + 6 * noise).alias("temperature"), (1 + 2 * wear + noise).alias("vibration"),
        (5 + noise).alias("pression"), (100 + 20 * noise).alias("consommation_electrique"),
        (50 + 30 * noise).alias("charge_travail"),
        F.when(e % 4 != 0, 59).cast("long").alias("failure_step"))
    rolled = features.rolling_features(df).withColumn(
        "label", features.horizon_label("failure_step", "seq"))
    return stored(rolled, "test-episodes")


def test_split_keeps_episodes_whole(episodes):
    train, test = learning.split(episodes)
    a = {r.episode_id for r in train.select("episode_id").distinct().collect()}
    b = {r.episode_id for r in test.select("episode_id").distinct().collect()}
    assert a and b and not a & b and len(a | b) == 40
    folds = learning.with_fold(episodes).groupBy("episode_id").agg(F.count_distinct("fold")
                                                                   .alias("n"))
    assert folds.where("n > 1").count() == 0


def test_weights_balance(episodes):
    sums = learning.with_weights(episodes).groupBy("label").agg(F.sum("weight").alias("w"))
    assert [r.w for r in sums.collect()] == pytest.approx([800.0] * 3)


def test_select_train_save_score(spark, episodes):
    train, test = learning.split(episodes)
    path = workdir(spark, "test-model")
    name, model, summary = learning.select_and_train(
        train, train, path, CFG, names=("random_forest", "logreg"))
    rows = summary.collect()
    assert {r.candidate for r in rows} == {"random_forest", "logreg"}
    assert [r.candidate for r in rows if r.selected] == [name]
    assert max(r["mean"] for r in rows) == [r["mean"] for r in rows if r.selected][0]

    judged = learning.predict(learning.load_model(spark, path), test).cache()
    scores = {r.model: r.macro_f1 for r in learning.evaluation(judged).collect()}
    assert scores["model"] > scores["majority"] + 0.1
    assert judged.where("confidence < 1.0 / 3 - 1e-9 OR failure_probability < 0 "
                        "OR failure_probability > 1").count() == 0
    assert len(model.stages[0].getInputCols()) == 12 and set(schemas.FEATURES) == set(
        model.stages[0].getInputCols())
    ap = metrics.average_precision(judged, F.col("label") == 2, "critical_probability").first()[0]
    assert 0.5 < ap <= 1


def test_forest_importances_and_single_reading(spark, episodes):
    model = learning.fit(episodes, learning.candidates(CFG)["random_forest"])
    top = metrics.top_importances(learning.importances(model)).collect()
    assert len(top) == 6 and top[0].importance >= top[-1].importance
    readings = episodes.select("machine_id", "event_time", "seq", *schemas.MEASURES)
    for windowed in (True, False):
        served = learning.failure_predictions(readings, model, windowed)
        assert served.columns == ["machine_id", "probabilite_panne", "event_time"]
        assert served.count() == readings.count()
    scored = features.feature_alerts(readings, learning.scorer(model))
    prev = F.lag("class_id", 1, 0).over(Window.partitionBy("machine_id").orderBy("seq"))
    wrong = scored.withColumn("_p", prev).where(
        "is_alert <> (class_id <> _p AND class_id > 0)").count()
    assert wrong == 0


def test_train_and_predict_jobs(spark, episodes):
    """Train from a table of episodes, then serve probabilities off a topic."""
    work = workdir(spark, "test-train")
    episodes.select("episode_id", "event_time", "seq", "failure_step",
                    *schemas.MEASURES).write.parquet(f"{work}/episodes")
    name, summary, scores = run.train(spark, f"{work}/episodes", f"{work}/model", CFG)
    assert summary.count() == 3 and name in learning.candidates(CFG)
    got = {r.model: r.macro_f1 for r in scores.collect()}
    assert got["model"] > got["majority"] + 0.1
    bus = Bus(spark, "parquet", f"{work}/bus")
    contract = episodes.withColumns({"timestamp": F.lit("2024-01-01T00:00:00Z")})
    bus.publish(decode.encode(contract, "machine_id", "timestamp", *schemas.MEASURES), "sensors", 0)
    for extra in ([], ["--single"]):
        run.main(["predict", "--work", f"{work}/{len(extra)}", "--bus", f"{work}/bus",
                  "--bus-format", "parquet", "--model", f"{work}/model", "--once", *extra], spark)
        served = lake.read_measurement(spark, f"{work}/{len(extra)}/serving", "predictions")
        assert served.count() == episodes.count()
        assert served.where("probabilite_panne BETWEEN 0 AND 1").count() == episodes.count()


def test_boosting_candidate(spark, episodes):
    """Held-out macro-F1, the saved model, and rounds that end when the loss no longer falls."""
    train, test = learning.split(episodes)
    cfg = learning.candidates(learning.Learning(boosting_rounds=8, boosting_depth=3))["hist_gbm"]
    model = learning.fit(train, cfg)
    path = workdir(spark, "test-boosting")
    learning.save_model(model, spark, path)
    judged = learning.predict(learning.load_model(spark, path), test).cache()
    scores = {r.model: r.macro_f1 for r in learning.evaluation(judged).collect()}
    assert scores["model"] > scores["majority"] + 0.3
    assert judged.where("abs(confidence) > 1 or failure_probability < 0").count() == 0
    assert model.rounds == 8 and learning.importances(model) is None
    again = learning.predict(model, test).select("machine_id", "seq", "confidence")
    assert again.exceptAll(judged.select("machine_id", "seq", "confidence")).count() == 0


def plain_tree(bins, g, h, cfg):
    """Leaves (as frozensets of rows) and their values, grown best first one cut at a time."""
    def cut(rows):
        best = None
        for f in range(bins.shape[1]):
            for b in range(cfg.bins - 1):
                left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                if min(len(left), len(right)) < cfg.leaf_rows:
                    continue
                gain = sum(g[x].sum() ** 2 / h[x].sum() for x in (left, right)) - g[rows].sum() ** 2 / h[rows].sum()
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = gain, left, right
        return best
    leaves = [(np.arange(len(bins)), 0)]
    while len(leaves) < cfg.leaves:
        ready = [(c, i) for i, (rows, d) in enumerate(leaves) if d < cfg.depth and (c := cut(rows))]
        if not ready:
            break
        (_, left, right), i = max(ready, key=lambda x: x[0][0])
        depth = leaves.pop(i)[1] + 1
        leaves += [(left, depth), (right, depth)]
    return {frozenset(rows.tolist()): -cfg.rate * g[rows].sum() / h[rows].sum() for rows, _ in leaves}


def test_boosting_grows_the_trees_of_a_plain_search(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 11).astype(int) + (x[:, 2] > 8) * (x[:, 0] > 5)
    cfg = boosting.Boosting(depth=4, rounds=1, leaves=6, leaf_rows=15, bins=16, aside_percent=0)
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y)], "a double, b double, c double, label int")
    model = boosting.fit_folds(df.repartition(5), ["a", "b", "c"], cfg=cfg)[0]
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(model.edge)], axis=1)
    w = (len(y) / (3 * np.bincount(y)))[y]
    for c, tree in model.trees:
        want = plain_tree(bins, w * (1 / 3 - (y == c)), w * (2 / 9), cfg)
        at = tree.leaf(bins)
        got = {frozenset(np.flatnonzero(at == n).tolist()): tree.value[n] for n in set(at.tolist())}
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_boosting_of_folds_in_one(spark, episodes):
    """Each fold's model is blind to the fold's own labels."""
    df = learning.with_fold(episodes, CFG)
    cfg = learning.candidates(CFG)["hist_gbm"]
    models = boosting.fit_folds(df, schemas.FEATURES, 2, cfg)
    changed = df.withColumn("label", F.when(F.col("fold") == 0, 2 - F.col("label")).otherwise(F.col("label")))
    other = boosting.fit_folds(changed, schemas.FEATURES, 2, cfg)
    assert models[0].trees == other[0].trees and models[1].trees != other[1].trees
    assert boosting.fit_folds(df.limit(0), schemas.FEATURES, 0, cfg)[0].rounds == 0


def test_no_model_falls_back_to_rules(spark, episodes):
    assert learning.load_model(spark, None) is None
    assert learning.load_model(spark, "/nonexistent/model") is None
    assert learning.scorer(None) is features.rule_scored
    served = learning.failure_predictions(episodes, None)
    assert {r[0] for r in served.select("probabilite_panne").distinct().collect()} <= {
        0.05, 0.6, 0.95}


def test_report_with_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, prediction int")
    report = {r.class_id: r for r in metrics.class_report(df).collect()}
    assert (report[2].precision, report[2].recall, report[2].f1, report[2].support) == (0, 0, 0, 0)
    assert report[0].precision == 1.0 and report[0].recall == 0.5
    matrix = {r.label: (r.pred_0, r.pred_1, r.pred_2)
              for r in metrics.confusion_matrix(df).collect()}
    assert matrix == {0: (1, 1, 0), 1: (0, 1, 0), 2: (0, 0, 0)}
    folds = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.1)],
                                  "candidate string, macro_f1 double")
    got = {r.candidate: (round(r["mean"], 6), round(r["std"], 6))
           for r in metrics.fold_summary(folds).collect()}
    assert got == {"a": (0.6, 0.1), "b": (0.1, 0.0)}


def test_registered_plan_uses_the_declared_candidates(spark, monkeypatch):
    """q36 fits every candidate with the default settings."""
    from plantwatch.plans import models
    used = []
    monkeypatch.setattr(models, "training_table", lambda spark, sf_dir: spark.createDataFrame(
        [("E1",)], "episode_id string"))
    monkeypatch.setattr(learning, "cross_validate", lambda train, cfg=learning.DEFAULT_LEARNING: used.append(cfg))
    monkeypatch.setattr(learning, "summarise", lambda scores: scores)
    models.q36(spark, "")
    assert used == [learning.Learning()]
    declared = learning.candidates(used[0])["hist_gbm"]
    assert (declared.rounds, declared.depth, declared.rate) == (350, 8, 0.08)


def test_boosting_rounds_take_one_query_per_level(spark, episodes, monkeypatch):
    """The loss that ends the rounds comes with the next round's roots, without a query of its own."""
    df, asked = episodes.where("seq % 2 = 0").persist(), []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: asked.append(1) or collect(self))
    model = boosting.fit_folds(df, schemas.FEATURES, cfg=boosting.Boosting(depth=2, rounds=3, leaves=4))[0]
    df.unpersist()
    assert model.rounds == 3 and len(asked) <= 1 + 3 * 2  # one of counts, one per level
    bins = np.random.default_rng(3).integers(0, 9, (500, 2))
    tree = boosting.Tree([0, 1, -1, -1, -1], [4, 2, 0, 0, 0], [1, 3, 0, 0, 0], [2, 4, 0, 0, 0], [0.0] * 5)
    assert tree.leaf(bins).tolist() == [2 if a > 4 else 3 if b <= 2 else 4 for a, b in bins.tolist()]


def plain_leaves(bins, keys, label, tree, weights, cfg):
    """Leaves of one tree by a search node by node over all features: frozensets of the rows that it takes."""
    times = forest.drawn(keys, tree, cfg.seed, forest.poisson_table()).astype(int)

    def counts(rows):
        return np.bincount(label[rows], times[rows], cfg.classes)

    def gini(rows):
        c = counts(rows) * weights
        return (1 - (c ** 2).sum() / c.sum() ** 2) * c.sum()

    def grow(rows, depth):
        best = None
        for f in range(bins.shape[1]):
            for b in range(cfg.bins - 1):
                parts = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                if depth == cfg.depth or min(times[x].sum() for x in parts) < cfg.leaf_rows:
                    continue
                gain = (gini(rows) - sum(map(gini, parts))) / (counts(rows) * weights).sum()
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = gain, parts
        if best is None:
            return [rows]
        both = [grow(x, depth + 1) for x in best[1]]
        tops = {int(np.argmax(counts(x) * weights)) for x in best[1]}
        return [rows] if [len(x) for x in both] == [1, 1] and len(tops) == 1 else sum(both, [])
    return {frozenset(x.tolist()) for x in grow(np.flatnonzero(times), 0)}


def test_forest_grows_the_trees_of_a_plain_search(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (300, 1)).astype(float)
    y = np.where(rng.random(300) < 0.2, rng.integers(0, 3, 300), (x[:, 0] // 3).astype(int))
    cfg = forest.Settings(trees=3, depth=3, leaf_rows=15, bins=8)
    df = spark.createDataFrame([(i, *map(float, r), int(k), float(1 + k)) for i, (r, k) in enumerate(zip(x, y))],
                               "id long, a double, label int, weight double")
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    model = forest.Forest(cfg).fit(df.repartition(5))
    keys = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("a", "id", "label", "weight")).collect()]).view(np.uint64)
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(model.edge)], axis=1)
    for t, tree in enumerate(model.trees):
        taken = forest.drawn(keys, t, cfg.seed, forest.poisson_table()) > 0
        at = tree.walk(bins.ravel(), np.arange(300), cfg.depth, cfg.bins)
        got = {frozenset(np.flatnonzero((at == n) & taken).tolist()) for n in set(at[taken].tolist())}
        assert got == plain_leaves(bins, keys, y, t, np.array([1.0, 2.0, 3.0]), cfg) and len(got) > 2


def test_forest_takes_one_query_per_level_and_the_same_rows_from_any_partitions(spark, episodes, monkeypatch):
    asked, collect = [], type(episodes).collect
    monkeypatch.setattr(type(episodes), "collect", lambda self: asked.append(1) or collect(self))
    estimator = learning.candidates(CFG)["random_forest"]
    one = learning.fit(episodes.repartition(3, "seq"), estimator)
    assert len(asked) <= 3 + CFG.tree_depth  # class weights, the number of features, edges, one per level
    other = learning.fit(episodes.repartition(7, "seq"), estimator)
    for a, b in zip(one.stages[-1].trees, other.stages[-1].trees):
        assert (a.counts[0] == b.counts[0]).all()  # bin edges are approximate quantiles and may differ


def test_forest_judges_as_well_as_spark_mls_and_is_saved(spark, episodes):
    train, test = learning.split(episodes)
    mls = RandomForestClassifier(numTrees=CFG.trees, maxDepth=CFG.tree_depth, minInstancesPerNode=CFG.leaf_rows, seed=CFG.seed,
                                 featuresCol="features", labelCol="label", weightCol="weight")
    models = [learning.fit(train, e) for e in (mls, learning.candidates(CFG)["random_forest"])]
    path = workdir(spark, "test-forest")
    learning.save_model(models[1], spark, path)
    models.append(learning.load_model(spark, path))
    score = [metrics.macro_f1(m.transform(learning.complete(test))).first()[0] for m in models]
    assert score[1] == score[2] and score[1] > score[0] - 0.03
    shares = [learning.importances(m).orderBy("position").toPandas()["importance"].to_numpy() for m in models]
    assert np.abs(shares[1] - shares[0]).max() < 0.15 and (shares[1] == shares[2]).all() and shares[1].sum() == pytest.approx(1)


def test_forest_edges_give_rare_classes_their_share(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 20, 1).otherwise(0).alias("label"),
                                  F.array((F.col("id") / 1000).cast("double")).alias("x"))
    cfg = forest.Settings(bins=8)
    edge = forest.edges(df, 1, {0: 500.0, 1: 500.0}, cfg)[0]
    assert len(edge) == 7 and 3 <= sum(e < 0.02 for e in edge) <= 4


def _boosted(spark, df, cfg, folds=2):
    """Models of the folds and the Spark jobs that they took."""
    spark.sparkContext.setJobGroup("boosting", "boosting")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting"))
    models = boosting.fit_folds(df, schemas.FEATURES, folds, cfg)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return models, jobs


def test_boosting_runs_several_rounds_in_a_job(spark, episodes):
    """All 350 rounds may run: a job for each level of each was most of the time."""
    df = learning.with_fold(episodes, CFG).persist()
    models, jobs = _boosted(spark, df, boosting.Boosting(depth=4, rounds=20, leaves=8))
    df.unpersist()
    assert [m.rounds for m in models] == [20, 20] and jobs < 20


@pytest.mark.parametrize("rare", [False, True])
def test_boosting_by_levels_and_by_tasks_grows_the_same_trees(spark, episodes, monkeypatch, rare):
    """Whole models in a task each, their scores stored in between, and levels over all tasks, rounds ended by the loss included."""
    df = learning.with_fold(episodes, CFG)
    if rare:  # weights too large to add a hessian and a row up as one number, or to keep gradients in 32 bits
        df = df.where("label <> 2 or (temperature > 89.5 and seq = 59)")
        for _ in range(5):
            df = df.union(df.where("label <> 2"))
    df = stored(df, "test-folds").repartition(3).persist()
    cfg = boosting.Boosting(depth=4, rounds=9, leaves=7, keep_rounds=2, patience=3, rate=0.4, leaf_rows=2 if rare else 20)
    monkeypatch.setattr(boosting, "STORED_JOBS", 2)
    monkeypatch.setattr(boosting, "CHUNK", 500)
    monkeypatch.setattr(boosting, "SMALL", 1 << 14 if rare else 100)
    whole, _ = _boosted(spark, df, cfg)
    monkeypatch.setattr(boosting, "WHOLE", 0)
    levels, jobs = _boosted(spark, df, cfg)
    df.unpersist()
    assert [m.edge for m in whole] == [m.edge for m in levels]
    assert [m.trees for m in whole] == [m.trees for m in levels] and whole[0].rounds > 3
    assert jobs <= 20 + cfg.rounds * cfg.depth


def test_sums_of_a_task_are_exact_at_any_weight():
    rng = np.random.default_rng(4)
    bins, cfg = rng.integers(0, 9, (11, 5000)).astype(np.uint8), boosting.Boosting(bins=9)
    rows = np.flatnonzero(rng.random(5000) < 0.3).astype(np.int32)
    for most, kind in ((1.0, np.int32), (500.0, np.int32), (1e5, np.float64)):
        pairs = np.rint(rng.random((5000, 2)) * [most, most / 4] * boosting.UNIT).astype(kind)
        source = boosting.Rows(list(bins), most)
        assert bool(source.row) == (most < 64)
        for part in (None, rows):
            use = np.arange(5000) if part is None else part
            got = source.sums(pairs, part, cfg)
            for f in range(11):
                want = [np.bincount(bins[f, use], x, 9) for x in (pairs[use, 0].astype(float), pairs[use, 1].astype(float), None)]
                assert all((a == b).all() for a, b in zip(got[:, f], want))
