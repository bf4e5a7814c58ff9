"""Aggregate states of scores: small rows that are kept per run and merged, so that a new run costs its own scan only.

A state holds the number of rows, the number, mean and squared deviations (M2) of the
scores, their range, the rows at or above the tail threshold and a KLL quantile sketch.
Means and deviations are merged by the pairwise formula: M2 of a union is the sum of
the parts' M2 and of n * (part's mean - mean)^2.  Sketches are merged by Spark; a
quantile from one lies within ``rank_error`` of its rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemeter.functions import scores
from choicemeter.names import ATTRIBUTES
from choicemeter.operators.consistency import known_keys

# Size of a sketch: quantiles are off by 0.14 percent of the ranks at most, in 99 of 100 cases.
SKETCH = 2000
STATE_KEYS = ["clean_config", "lang", "model", "temperature"]
Z_95 = 1.96


def rank_error(size: int = SKETCH) -> float:
    """How far, as a share of all ranks, a sketch's quantile may be off, in 99 of 100 cases."""
    return 2.296 / size**0.9723


def score_states(
    df: DataFrame,
    keys: Sequence[str],
    attributes: Sequence[str] = ("toxicity",),
    threshold: float = scores.TAIL_THRESHOLD,
    size: int = SKETCH,
) -> DataFrame:
    """A state per key and attribute: rows, n, mean, m2, low, high, tail, sketch.

    Rows with a null key are left out.  A missing score counts as a row below the
    threshold and as no score; a group without scores has null mean, m2 and range.
    """
    keys = list(keys)
    present = [a for a in attributes if a in df.columns]
    base = known_keys(df, keys).select(*keys, *(scores.to_score(a).alias(a) for a in present))
    value = F.col("value")
    return (
        base.unpivot(keys, present, "attribute", "value")
        .groupBy(*keys, "attribute")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(value)).alias("m2"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            F.count_if(value >= threshold).alias("tail"),
            F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"),
        )
    )


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of coarser groups: the states of all runs and keys that share ``keys`` and attribute, merged."""
    keys = [*keys, "attribute"]
    some = known_keys(states, keys)
    whole = some.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2))
    return (
        some.join(whole, keys)
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("n").alias("n"),
            F.max("_mean").alias("mean"),
            F.sum(F.col("m2") + apart).alias("m2"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.sum("tail").alias("tail"),
            F.kll_merge_agg_double("sketch").alias("sketch"),
        )
    )


def described(states: DataFrame, probabilities: dict[str, float] | None = None) -> DataFrame:
    """The figures of states: mean, count, std, sem, band, low, high, tail_percent and approximate quantiles."""
    keys = states.columns[: states.columns.index("rows")]
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    sem = std / F.sqrt(F.greatest(F.col("n"), F.lit(1)))
    quantile = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))
    return states.select(
        *keys,
        "mean",
        F.col("n").alias("count"),
        std.alias("std"),
        sem.alias("sem"),
        F.coalesce(sem * Z_95, F.lit(0.0)).alias("band"),
        "low",
        "high",
        (F.col("tail") / F.col("rows") * 100).alias("tail_percent"),
        *(quantile(p).alias(name) for name, p in (probabilities or {}).items()),
    )


def approximate_quantiles(df: DataFrame, keys: Sequence[str], probabilities: dict[str, float], score: str = "toxicity", size: int = SKETCH) -> DataFrame:
    """Count, mean, range and quantiles per group from one aggregate; sketches are shuffled, values are not."""
    points = described(score_states(df, keys, [score], size=size), probabilities)
    return points.where(F.col("count") > 0).select(*keys, F.col("count").alias("n"), "mean", "low", "high", *probabilities)


def attribute_means(states: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Mean of every attribute per model, from states."""
    merged = merge_states(states, ["model"]).select("model", "attribute", "mean")
    return merged.groupBy("model").pivot("attribute", list(attributes)).agg(F.first("mean"))
