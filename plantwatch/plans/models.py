"""Training and scoring on the given tables. No SQL twin: the fits are iterative."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch import schemas
from plantwatch.functions.values import rounded
from plantwatch.operators import features, learning, metrics
from plantwatch.plans.registry import query
from plantwatch.plans.tables import Tables
from plantwatch.session import stored


def training_table(spark, sf_dir):
    """Features and labels of all episodes, written once: fits read it many times,
    and a lost executor costs a re-read instead of the whole lineage."""
    t = Tables(spark, sf_dir)
    keys = ["machine_id", "event_time", "seq"]
    rolled = features.rolling_features(t.episode_readings()).select(
        *keys, "episode_id", *schemas.FEATURES)
    labels = t.labels().select("machine_id", "seq", "label")
    return learning.spread(stored(rolled.join(labels, ["machine_id", "seq"]), "training"))


@query("q36_grouped_cv")
def q36(spark, sf_dir):
    train, _ = learning.split(training_table(spark, sf_dir))
    return learning.summarise(learning.cross_validate(train))


@query("q36b_top_importances")
def q36b(spark, sf_dir):
    train, _ = learning.split(training_table(spark, sf_dir))
    model = learning.fit(train, learning.candidates()["random_forest"])
    return metrics.top_importances(learning.importances(model))


@query("q37_model_scores")
def q37(spark, sf_dir):
    """Every reading scored by the forest: class, confidence and failure probability."""
    table = training_table(spark, sf_dir)
    model = learning.fit(table, learning.candidates()["random_forest"])
    rolled = features.rolling_features(Tables(spark, sf_dir).readings())
    return learning.predict(model, rolled).select(
        "machine_id", "event_time", "seq", "class_id", "label_text",
        rounded("confidence", 4).alias("confidence"),
        rounded("failure_probability", 4).alias("probabilite_panne"))


@query("q37b_model_evaluation")
def q37b(spark, sf_dir):
    """Macro-F1 of forest, rule and majority class on episodes not trained on."""
    train, test = learning.split(training_table(spark, sf_dir))
    model = learning.fit(train, learning.candidates()["random_forest"])
    judged = stored(learning.predict(model, test).select(
        "label", "class_id", "temperature", "charge_travail", "critical_probability"), "judged")
    average = metrics.average_precision(judged, F.col("label") == 2, "critical_probability")
    return learning.evaluation(judged).unionByName(
        average.select(F.lit("average_precision").alias("model"),
                       F.col("average_precision").alias("macro_f1"))).select(
        F.col("model").alias("measure"), F.col("macro_f1").alias("value"))
