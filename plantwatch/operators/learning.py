"""Training, selection and scoring of failure models with Spark ML pipelines."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantwatch import schemas
from plantwatch.functions import rules
from plantwatch.functions.values import rounded
from plantwatch.operators import features, metrics
from plantwatch.operators.boosting import BoostedModel, Boosting, fit_folds
from plantwatch.operators.forest import Forest, Settings


@dataclass(frozen=True)
class Learning:
    # Candidate settings.
    seed: int = 42
    train_percent: int = 80
    folds: int = 5
    regression_rounds: int = 2000
    trees: int = 120
    tree_depth: int = 10
    leaf_rows: int = 20
    boosting_depth: int = 8
    boosting_rate: float = 0.08
    boosting_rounds: int = 350
    parallel_fits: int = 8


DEFAULT_LEARNING = Learning()


def split(labelled: DataFrame, cfg: Learning = DEFAULT_LEARNING) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the episode, so that no episode is in both."""
    share = F.pmod(F.xxhash64("episode_id", F.lit(cfg.seed)), F.lit(100))
    return labelled.where(share < cfg.train_percent), labelled.where(share >= cfg.train_percent)


def with_fold(labelled: DataFrame, cfg: Learning = DEFAULT_LEARNING) -> DataFrame:
    return labelled.withColumn(
        "fold", F.pmod(F.xxhash64("episode_id"), F.lit(cfg.folds)).cast("int"))


def with_weights(labelled: DataFrame) -> DataFrame:
    weights = features.class_balance(labelled).select("label", "weight")
    return labelled.join(F.broadcast(weights), "label")  # one row per class


def candidates(cfg: Learning = DEFAULT_LEARNING) -> dict:
    """The estimators to choose from, in listed order."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "logreg": LogisticRegression(maxIter=cfg.regression_rounds, **common),
        "random_forest": Forest(Settings(trees=cfg.trees, depth=cfg.tree_depth, leaf_rows=cfg.leaf_rows, seed=cfg.seed)),
        "hist_gbm": Boosting(depth=cfg.boosting_depth, rate=cfg.boosting_rate,
                             rounds=cfg.boosting_rounds, leaf_rows=cfg.leaf_rows, seed=cfg.seed),
    }


def preparation() -> list:
    return [VectorAssembler(inputCols=schemas.FEATURES, outputCol="raw", handleInvalid="keep"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]


def complete(df: DataFrame) -> DataFrame:
    """Missing features as zero, as a lone reading is scored."""
    return df.withColumns({f: F.coalesce(f, F.lit(0.0)) for f in schemas.FEATURES})


def spread(df: DataFrame) -> DataFrame:
    """A table of few files over all cores; a large one has enough partitions as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fit(train: DataFrame, estimator) -> PipelineModel | BoostedModel:
    if isinstance(estimator, Boosting):
        return fit_folds(complete(train), schemas.FEATURES, cfg=estimator)[0]
    return Pipeline(stages=[*preparation(), estimator]).fit(complete(with_weights(train)))


def cross_validate(train: DataFrame, cfg: Learning = DEFAULT_LEARNING, names=None) -> DataFrame:
    """Macro-F1 per candidate and fold, with whole episodes per fold.

    Each fit and each score is a distributed job; only one number per fit comes
    back. Several fits run side by side, as their many short jobs leave cores idle.
    """
    df = spread(with_fold(train, cfg)).persist()
    plans = [(position, name, fold) for position, name in enumerate(candidates(cfg))
             if not names or name in names for fold in range(cfg.folds)]

    def run(plan):
        position, name, fold = plan
        model = boosted.result()[fold] if name == "hist_gbm" else fit(df.where(F.col("fold") != fold), candidates(cfg)[name])
        judged = model.transform(complete(df.where(F.col("fold") == fold)))
        return name, position, fold, metrics.macro_f1(judged).first()[0]

    try:
        with ThreadPoolExecutor(cfg.parallel_fits) as pool:
            if any(name == "hist_gbm" for _, name, _ in plans):  # all folds grow together, first in the pool
                boosted = pool.submit(inheritable_thread_target(train.sparkSession)(fit_folds), complete(df),
                                      schemas.FEATURES, cfg.folds, candidates(cfg)["hist_gbm"])
            scores = list(pool.map(inheritable_thread_target(train.sparkSession)(run), plans))
    finally:
        df.unpersist()
    return train.sparkSession.createDataFrame(
        scores, "candidate string, position int, fold int, macro_f1 double")


def summarise(scores: DataFrame) -> DataFrame:
    """Mean and spread per candidate; the first best is selected."""
    summary = metrics.fold_summary(scores, "candidate", "position")
    best = metrics.best_candidate(summary).select("candidate", F.lit(True).alias("_best"))
    return (summary.join(F.broadcast(best), "candidate", "left")
            .withColumn("selected", F.coalesce("_best", F.lit(False))).drop("_best"))


def select_and_train(train: DataFrame, everything: DataFrame, path: str | None = None,
                     cfg: Learning = DEFAULT_LEARNING, names=None):
    """Pick by cross-validation on `train`, refit on `everything`, optionally save."""
    summary = summarise(cross_validate(train, cfg, names))
    chosen = summary.where("selected").first()["candidate"]
    model = fit(everything, candidates(cfg)[chosen])
    if path:
        save_model(model, everything.sparkSession, path)
    return chosen, model, summary


def save_model(model: PipelineModel | BoostedModel, spark: SparkSession, path: str) -> None:
    if isinstance(model, BoostedModel):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def predict(model: PipelineModel | BoostedModel, df: DataFrame) -> DataFrame:
    """Class, confidence and failure probability from a fitted pipeline."""
    out = model.transform(complete(df))
    p = F.col("probability") if isinstance(model, BoostedModel) else vector_to_array("probability")
    return (out.withColumn("_p", p)
            .withColumns({"class_id": F.col("prediction").cast("int"),
                          "confidence": F.array_max("_p"),
                          "failure_probability": 1 - F.col("_p")[0],
                          "critical_probability": F.col("_p")[2]})
            .withColumn("label_text", rules.class_label("class_id"))
            .drop("raw", "features", "rawPrediction", "probability", "prediction", "_p"))


def load_model(spark: SparkSession, path: str | None) -> PipelineModel | BoostedModel | None:
    """The saved model, or nothing when there is none."""
    for folder, load in (("boosting", lambda: BoostedModel.load(spark, path)),
                         ("metadata", lambda: PipelineModel.load(path))) if path else ():
        try:
            spark.read.text(f"{path}/{folder}")
        except AnalysisException:
            continue
        return load()
    return None


def scorer(model: PipelineModel | None):
    """Scoring of rolled readings by model, or by rule without one."""
    if model is None:
        return features.rule_scored

    def score(df: DataFrame) -> DataFrame:
        return predict(model, df).withColumnRenamed("label_text", "label")
    return score


def failure_predictions(readings: DataFrame, model: PipelineModel | None,
                        windowed: bool = True) -> DataFrame:
    """Failure probability per reading in served shape.

    By default from rolling features; `windowed=False` scores each reading as if
    it stood alone.
    """
    if model is None:
        from plantwatch.operators.rollups import predictions
        return predictions(readings)
    rows = features.rolling_features(readings) if windowed \
        else features.single_reading_features(readings)
    return predict(model, rows).select(
        "machine_id", rounded("failure_probability", 4).alias("probabilite_panne"), "event_time")


def importances(model: PipelineModel) -> DataFrame | None:
    """Importance per feature for tree models."""
    if isinstance(model, BoostedModel):
        return None
    classifier = model.stages[-1]
    if not hasattr(classifier, "featureImportances"):
        return None
    values = classifier.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(
        [(f, v, i) for i, (f, v) in enumerate(zip(schemas.FEATURES, values))],
        T.StructType([T.StructField("feature", T.StringType()),
                      T.StructField("importance", T.DoubleType()),
                      T.StructField("position", T.IntegerType())]))


def evaluation(judged: DataFrame) -> DataFrame:
    """Macro-F1 of model, rule and majority class on the same rows.

    `judged` has label, class_id (model), temperature and charge_travail.
    """
    rows = judged.select("label", F.col("class_id").alias("model"),
                         rules.risk_class("temperature", "charge_travail").alias("rule"))
    rows = rows.withColumn("prediction", metrics.majority_class(rows).scalar())
    parts = [metrics.macro_f1(rows, pred=c).withColumn("model", F.lit(n))
             for c, n in (("model", "model"), ("rule", "rule"), ("prediction", "majority"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("model", "macro_f1")
