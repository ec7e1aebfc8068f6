"""Classification metrics from (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plantwatch.operators.ordered import running_sums, sliced
from plantwatch.params import DEFAULTS, Params
from plantwatch.session import stored

CLASSES = (0, 1, 2)


def confusion_matrix(df: DataFrame, label="label", pred="prediction", classes=CLASSES) -> DataFrame:
    """One row per true class, one column per predicted class; absent ones are zero."""
    counts = (df.groupBy(F.col(label).cast("int").alias("label"))
              .pivot(pred, list(classes)).agg(F.count(F.lit(1))))
    counts = counts.toDF("label", *[f"pred_{c}" for c in classes])
    every = df.sparkSession.createDataFrame([(c,) for c in classes],
                                            T.StructType([T.StructField("label", T.IntegerType())]))
    return F.broadcast(every).join(counts, "label", "left").na.fill(0)  # one row per class


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def class_report(df: DataFrame, label="label", pred="prediction", classes=CLASSES) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives zero."""
    hits = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))  # k*k rows from here on
    per = []
    for c in classes:
        is_label, is_pred = F.col(label) == c, F.col(pred) == c
        def total(cond):
            return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
        per.append(F.struct(F.lit(c).alias("class_id"), total(is_label & is_pred).alias("tp"),
                            total(is_pred).alias("predicted"), total(is_label).alias("support")))
    rows = hits.agg(F.array(*per).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    rows = rows.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")),
                             "recall": _ratio(F.col("tp"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", _ratio(2 * p * r, p + r)).select(
        "class_id", "precision", "recall", "f1", "support")


def macro_f1(df: DataFrame, label="label", pred="prediction", classes=CLASSES) -> DataFrame:
    return class_report(df, label, pred, classes).agg(F.avg("f1").alias("macro_f1"))


def attention_view(df: DataFrame, label="label", pred="prediction") -> DataFrame:
    """Report of the binary question: does the machine need attention?"""
    return class_report(df.select((F.col(label) >= 1).cast("int").alias("label"),
                                  (F.col(pred) >= 1).cast("int").alias("prediction")),
                        classes=(0, 1))


def average_precision(df: DataFrame, positive: Column, score: str,
                      p: Params = DEFAULTS) -> DataFrame:
    """Sum of precision times recall step over descending score; equal scores form one step."""
    # One row per distinct score, read for its size and again for the totals: stored.
    steps = stored(df.groupBy(score).agg(F.count(F.lit(1)).alias("n"),
                                         F.count(F.when(positive, 1)).alias("hits"))
                   .withColumn("_down", -F.col(score)), "score-steps")
    found = running_sums(sliced(steps, [], ["_down"], p), seen=F.col("n"), found=F.col("hits"))
    # Recall rises by hits / all positives at each step.
    return found.agg(_ratio(F.sum(F.col("hits") * F.col("found") / F.col("seen")),
                            F.sum("hits")).alias("average_precision"))


def fold_summary(scores: DataFrame, *by: str, score: str = "macro_f1") -> DataFrame:
    """Mean and spread over the folds, per candidate or by the columns named."""
    return scores.groupBy(*(by or ("candidate",))).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def best_candidate(summary: DataFrame) -> DataFrame:
    """Highest mean; the first listed wins ties."""
    return summary.orderBy(F.desc("mean"), "position").limit(1)


def top_importances(importances: DataFrame, n: int = 6) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "position").limit(n)


def majority_class(df: DataFrame, label="label") -> DataFrame:
    """The most frequent class; the lowest one on ties."""
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.max_by(label, F.struct("n", -F.col(label))).alias("prediction")))
