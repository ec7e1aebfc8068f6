"""Evaluation of the rule and of trained models on labelled episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions import rules
from plantwatch.functions.values import rounded
from plantwatch.operators import metrics
from plantwatch.plans.registry import query
from plantwatch.plans.tables import SCENARIO, Tables, half_up, with_views
from plantwatch.plans.telemetry import LABELLED, RISK

JUDGED = f"""{LABELLED}, judged AS (SELECT label, {RISK} AS pred, CASE {RISK} WHEN 0 THEN 5e-2
  WHEN 1 THEN 6e-1 ELSE 95e-2 END AS score FROM labelled)"""


def _judged(t: Tables):
    labels = t.labels()
    return labels.select(
        "label", rules.risk_class("temperature", "charge_travail").alias("prediction"),
        rules.rule_failure_probability("temperature", "charge_travail").alias("score"))


@query("q33_confusion_matrix", with_views(f"""{JUDGED}
SELECT CAST(c AS INTEGER) AS label, count(CASE WHEN pred = 0 THEN 1 END) AS pred_0,
       count(CASE WHEN pred = 1 THEN 1 END) AS pred_1, count(CASE WHEN pred = 2 THEN 1 END)
         AS pred_2
FROM (VALUES (0), (1), (2)) k(c) LEFT JOIN judged ON label = c GROUP BY c""", "readings"))
def q33(spark, sf_dir):
    return metrics.confusion_matrix(_judged(Tables(spark, sf_dir)))


def _scores(source: str, classes: str) -> str:
    return f"""
SELECT class_id, "precision", recall, support,
       coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1
FROM (SELECT CAST(c AS INTEGER) AS class_id,
        coalesce(count(CASE WHEN label = c AND pred = c THEN 1 END)
          / nullif(CAST(count(CASE WHEN pred = c THEN 1 END) AS DOUBLE), 0), 0) AS "precision",
        coalesce(count(CASE WHEN label = c AND pred = c THEN 1 END)
          / nullif(CAST(count(CASE WHEN label = c THEN 1 END) AS DOUBLE), 0), 0) AS recall,
        count(CASE WHEN label = c THEN 1 END) AS support
      FROM (VALUES {classes}) k(c), {source} GROUP BY c)"""


def _report(source: str, classes: str) -> str:
    shown = ", ".join(f'{half_up(c, 6)} AS {c}' for c in ('"precision"', "recall", "f1"))
    return f"\nSELECT class_id, {shown}, support FROM ({_scores(source, classes)})"


def _rounded(df):
    return df.withColumns({c: rounded(c, 6) for c in ("precision", "recall", "f1")})


@query("q34_class_report", with_views(JUDGED + _report("judged", "(0), (1), (2)"), "readings"))
def q34(spark, sf_dir):
    return _rounded(metrics.class_report(_judged(Tables(spark, sf_dir))))


@query("q34b_macro_f1_summary", with_views(f"""{JUDGED},
dummy AS (SELECT label, (SELECT label FROM judged GROUP BY label ORDER BY count(*) DESC, label
                         LIMIT 1) AS pred FROM judged)
SELECT 'rule' AS model, {half_up("avg(f1)", 6)} AS macro_f1
FROM ({_scores("judged", "(0), (1), (2)")})
UNION ALL
SELECT 'majority', {half_up("avg(f1)", 6)} FROM ({_scores("dummy", "(0), (1), (2)")})""",
                                          "readings"))
def q34b(spark, sf_dir):
    """Macro-F1 of the rule next to that of always naming the most frequent class."""
    judged = _judged(Tables(spark, sf_dir))
    dummy = judged.select("label", metrics.majority_class(judged).scalar().alias("prediction"))
    return (metrics.macro_f1(judged).withColumn("model", F.lit("rule"))
            .unionByName(metrics.macro_f1(dummy).withColumn("model", F.lit("majority")))
            .select("model", rounded("macro_f1", 6).alias("macro_f1")))


@query("q34c_attention_report", with_views(
    JUDGED + _report("(SELECT CAST(label >= 1 AS INTEGER) AS label, "
                     "CAST(pred >= 1 AS INTEGER) AS pred FROM judged) b", "(0), (1)"), "readings"))
def q34c(spark, sf_dir):
    return _rounded(metrics.attention_view(_judged(Tables(spark, sf_dir))))


@query("q35_average_precision", with_views(f"""{JUDGED},
score_steps AS (SELECT score, count(*) AS n, count(CASE WHEN label = 2 THEN 1 END) AS hits
          FROM judged GROUP BY score),
running AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS seen,
                   sum(hits) OVER (ORDER BY score DESC) AS found FROM score_steps)
SELECT {half_up('coalesce(sum(hits * CAST(found AS DOUBLE) / seen) / nullif(sum(hits), 0), 0)', 6)}
  AS average_precision
FROM running""", "readings"))
def q35(spark, sf_dir):
    df = metrics.average_precision(_judged(Tables(spark, sf_dir)), F.col("label") == 2, "score",
                                   SCENARIO)
    return df.withColumn("average_precision", rounded("average_precision", 6))
