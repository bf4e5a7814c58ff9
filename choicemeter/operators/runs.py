"""Comparison of runs by the description their judge or player was given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemeter.functions import scores
from choicemeter.names import NO_CONFIG, NO_DESCRIPTION


def run_means(winners: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Mean toxicity and severe toxicity per run, role and classifier.

    ``files`` lists the (run_id, role, classifier) that exist; one without rows
    has mean 0.
    """
    keys = ["run_id", "role", "classifier"]
    means = (
        winners.where(F.col("run_id").isNotNull())
        .groupBy(*keys)
        .agg(
            F.avg(scores.to_score("toxicity")).alias("mean_run_toxicity"),
            F.avg(scores.to_score("severe_toxicity")).alias("mean_run_severe_toxicity"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    if files is not None:
        means = files.select(*keys).distinct().join(means, keys, "left")
        empty = F.col("rows").isNull()
        means = means.withColumns(
            {c: F.when(empty, F.lit(0.0)).otherwise(F.col(c)) for c in ("mean_run_toxicity", "mean_run_severe_toxicity")}
        )
    return means.drop("rows")


def judge_comparison(winners: DataFrame, attributes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Unweighted mean of the run means per description, role and classifier, highest first.

    ``attributes`` has run_id, readable and judge_description.  A run without
    configuration and one whose configuration has no description get a label
    of their own.
    """
    described_runs = attributes.select("run_id", "readable", "judge_description")
    joined = run_means(winners, files).join(described_runs, "run_id", "left")
    description = F.when(F.coalesce(F.col("readable"), F.lit(False)), F.coalesce("judge_description", F.lit(NO_DESCRIPTION)))
    described = joined.withColumn("judge_description", F.coalesce(description, F.lit(NO_CONFIG)))
    return (
        described.groupBy("judge_description", "role", "classifier")
        .agg(
            F.count("run_id").alias("run_number"),
            F.avg("mean_run_toxicity").alias("mean_toxicity"),
            F.avg("mean_run_severe_toxicity").alias("mean_severe_toxicity"),
        )
        .orderBy(F.desc("mean_toxicity"), "judge_description", "role", "classifier")
    )
