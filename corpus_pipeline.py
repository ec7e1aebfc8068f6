"""From documents to a training mix: toxicity, line dedup, near duplicates, benchmark, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents; the last returns one row per copy in training order.
No SQL: toxicity is a fitted model (tests/llm/test_pipeline.py checks the stages).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantwatch.llm import decontaminate, jaccard, lines, mix, toxicity as toxic
from plantwatch.llm.rows import hidden, read
from plantwatch.session import stored

ORACLE_SQL = None


def _counted(done: DataFrame) -> DataFrame:
    """n_chars anew, where documents have it and the text has changed."""
    if "n_chars" not in done.columns:
        return done
    return done.withColumn("n_chars", F.length("text").cast(done.schema["n_chars"].dataType))


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    docs, back = hidden(docs, ("doc_id", "text"))
    scored = toxic.toxicity(docs, read(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*back)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing else is left."""
    docs, back = hidden(docs, ("doc_id", "text", "n_chars"))
    done = lines.dedup_lines(docs)
    empty = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x00-\x20]")
    return _counted(done.where(~F.coalesce(empty, F.lit(False)))).select(*back)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut out of the others."""
    docs, back = hidden(docs, ("doc_id", "text", "n_chars"))
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), cut=True)
    return _counted(found.where(~F.col("contaminated"))).select(*back)


def mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order."""
    return mix.training_rows(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing)]


def run(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
