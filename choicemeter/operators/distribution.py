"""Distribution of a score over models, temperatures, configurations, languages and plays.

Scores are read through ``to_score``: text that is no number, and NaN, count
as missing.  Rows with a null group key are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemeter.functions import scores, text
from choicemeter.names import ATTRIBUTES
from choicemeter.operators.consistency import known_keys
from choicemeter.operators.states import approximate_quantiles
from choicemeter.session import written

Z_95 = 1.96
# Width of the cells in which exact quantiles count values before ranking them.
RANK_CELL = 1.0 / 65536
# Values beyond this share the outermost cells, so that a group has a bounded number of cells whatever its range.
WIDEST = 16.0


def with_clean_config(df: DataFrame) -> DataFrame:
    return df.withColumn("clean_config", text.clean_config("config"))


def with_play_key(df: DataFrame) -> DataFrame:
    return df.withColumn("play_key", text.play_key("black_id", "winners"))


def mean_by(df: DataFrame, keys: Sequence[str], score: str = "toxicity") -> DataFrame:
    """Mean, count of scores, sample deviation, standard error and 95 % band.

    One score has no deviation; its band is 0.
    """
    stats = (
        known_keys(df, keys)
        .groupBy(*keys)
        .agg(
            F.avg(scores.to_score(score)).alias("mean"),
            F.count(scores.to_score(score)).alias("count"),
            F.stddev_samp(scores.to_score(score)).alias("std"),
        )
    )
    sem = F.col("std") / F.sqrt(F.greatest(F.col("count"), F.lit(1)))
    return stats.withColumn("sem", sem).withColumn("band", F.coalesce(F.col("sem") * Z_95, F.lit(0.0)))


def toxicity_by_temperature(df: DataFrame, score: str = "toxicity") -> DataFrame:
    return mean_by(df, ["model", "temperature"], score)


def tail_rate(
    df: DataFrame, keys: Sequence[str], score: str = "toxicity", threshold: float = scores.TAIL_THRESHOLD
) -> DataFrame:
    """Share of rows at or above the threshold in percent; a missing score counts as below."""
    return known_keys(df, keys).groupBy(*keys).agg(scores.tail_percent(score, threshold).alias("tail_percent"))


def tail_rate_by_config(df: DataFrame, score: str = "toxicity", threshold: float = scores.TAIL_THRESHOLD) -> DataFrame:
    return tail_rate(with_clean_config(df), ["clean_config", "model"], score, threshold)


def attribute_profile(df: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Mean of every attribute the table has, per model."""
    present = [a for a in attributes if a in df.columns]
    return known_keys(df, ["model"]).groupBy("model").agg(*(F.avg(scores.to_score(a)).alias(a) for a in present))


def config_model_stats(df: DataFrame, score: str = "toxicity", min_n: int = 1) -> DataFrame:
    """Mean and count per configuration and model, groups of fewer than ``min_n`` scores dropped."""
    keys = ["clean_config", "model"]
    return (
        known_keys(with_clean_config(df), keys)
        .groupBy(*keys)
        .agg(F.avg(scores.to_score(score)).alias("mean"), F.count(scores.to_score(score)).alias("count"))
        .where(F.col("count") >= min_n)
    )


def spread_models(means: DataFrame, row_key: str, models: Sequence[str] | None = None) -> DataFrame:
    """One row per key and one column per model, from one mean per key and model.

    Columns must be known beforehand: without ``models``, the means are written, so that
    the rows behind them are aggregated once, and the models are read from there.
    """
    if models is None:
        means = written(means, "means")
        models = [r.model for r in means.where("model is not null").select("model").distinct().orderBy("model").collect()]
    if not models:
        return means.select(row_key).distinct()
    return means.groupBy(row_key).pivot("model", list(models)).agg(F.first("mean"))


def config_model_matrix(
    df: DataFrame, models: Sequence[str] | None = None, score: str = "toxicity", min_n: int = 1
) -> DataFrame:
    return spread_models(config_model_stats(df, score, min_n), "clean_config", models)


def top_matrix(
    df: DataFrame, row_key: str, k: int = 30, models: Sequence[str] | None = None, score: str = "toxicity"
) -> DataFrame:
    """The k keys with the highest mean score, and their mean per model.

    Sums per key and model are taken once; the ranking and the matrix both come
    from that small table.  Means that agree to twelve digits are ranked by key.
    """
    value = scores.to_score(score)
    sums = (
        df.where(value.isNotNull() & F.col(row_key).isNotNull())
        .groupBy(row_key, "model")
        .agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    )
    ranked = sums.groupBy(row_key).agg(F.round(F.sum("total") / F.sum("n"), 12).alias("overall"))
    top = ranked.orderBy(F.desc("overall"), row_key).limit(k).select(row_key)
    # k rows at most.
    kept = sums.join(F.broadcast(top), row_key, "left_semi").where(F.col("model").isNotNull())
    return spread_models(kept.select(row_key, "model", (F.col("total") / F.col("n")).alias("mean")), row_key, models)


def top_black_matrix(df: DataFrame, k: int = 30, models: Sequence[str] | None = None) -> DataFrame:
    return top_matrix(df, "black_id", k, models)


def top_play_matrix(df: DataFrame, k: int = 30, models: Sequence[str] | None = None) -> DataFrame:
    return top_matrix(with_play_key(df), "play_key", k, models)


def stability(df: DataFrame, score: str = "toxicity") -> DataFrame:
    """Mean, deviation, count and bubble size per model, temperature and play."""
    keys = ["model", "temperature", "play_key"]
    value = scores.to_score(score)
    groups = (
        known_keys(with_play_key(df), keys)
        .groupBy(*keys)
        .agg(F.avg(value).alias("tox_mean"), F.stddev_samp(value).alias("tox_std"), F.count(value).alias("n"))
    )
    # The largest group as a whole: asking for its count alone would be another aggregate over the rows.
    largest = groups.agg(F.max(F.struct("n", "tox_mean", "tox_std"))["n"]).scalar()
    return groups.withColumn("size", F.col("n") * 500 / F.greatest(largest, F.lit(1)))


def top_unstable(groups: DataFrame, top: int = 10) -> DataFrame:
    """The plays whose scores vary most; a missing deviation comes last."""
    order = F.round("tox_std", 12).desc_nulls_last()
    return groups.orderBy(order, "model", "temperature", "play_key").limit(top)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], probabilities: dict[str, float], score: str = "toxicity", cell: float = RANK_CELL
) -> DataFrame:
    """Count, mean, range and exact quantiles (linear interpolation), for groups of any size.

    The aggregate that Spark offers keeps all values of a group in one buffer.
    Here equal values are counted first, counts are added up per cell of
    ``cell`` width, and a running count over the cells tells the rank at which
    each one begins.  Values are then ranked within their own cell only, so no
    task holds a whole group: one window sees the cells of a group (65,537 for
    scores in [0, 1]), the other the distinct values of one cell.
    """
    keys = list(keys)
    value = scores.to_score(score)
    counts = (
        known_keys(df, keys)
        .where(value.isNotNull())
        .groupBy(*keys, value.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_cell", F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("_v"))) / cell))
    )
    begin = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = (
        counts.groupBy(*keys, "_cell")
        .agg(
            F.sum("_n").alias("_cell_n"),
            F.sum(F.col("_v") * F.col("_n")).alias("_sum"),
            F.min("_v").alias("_low"),
            F.max("_v").alias("_high"),
        )
        .withColumn("_before", F.sum("_cell_n").over(begin) - F.col("_cell_n"))
        .withColumn("_total", F.sum("_cell_n").over(Window.partitionBy(*keys)))
    )
    wanted = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in probabilities.items()}
    ranks = [r for rank in wanted.values() for r in (F.floor(rank), F.ceil(rank))]
    holds = F.lit(False)
    for rank in ranks:
        holds |= (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_cell_n"))
    # Two cells a probability and group at most; only their values are ranked.
    picked_cells = cells.where(holds).select(*keys, "_cell", "_before", "_total")
    within = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counts.join(picked_cells, [*keys, "_cell"])
        .withColumn("_last", F.col("_before") + F.sum("_n").over(within) - 1)
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("_v")))

    found: list[Column] = []
    for name, rank in wanted.items():
        found += [at(F.floor(rank)).alias(f"_{name}_low"), at(F.ceil(rank)).alias(f"_{name}_high")]
    whole = cells.groupBy(*keys).agg(
        F.max("_total").alias("n"), (F.sum("_sum") / F.sum("_cell_n")).alias("mean"), F.min("_low").alias("low"), F.max("_high").alias("high")
    )
    picked = whole.join(ranked.groupBy(*keys).agg(*found), keys)

    def between(name: str, probability: float) -> Column:
        rank = (F.col("n") - 1) * F.lit(float(probability))
        below, above = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        return (below + (above - below) * (rank - F.floor(rank))).alias(name)

    return picked.select(*keys, "n", "mean", "low", "high", *(between(n, p) for n, p in probabilities.items()))


def language_risk(df: DataFrame, score: str = "toxicity", digits: int = 3, exact: bool = True) -> DataFrame:
    """Mean, median, 90th and 95th percentile per language and model, rounded.

    Not ``exact``: quantiles come from mergeable sketches (see ``states``), within a stated
    error of their rank, and only the sketches are shuffled.
    """
    keys = ["lang", "model"]
    quantiles = exact_quantiles if exact else approximate_quantiles
    points = quantiles(df, keys, {"p50": 0.5, "p90": 0.9, "p95": 0.95}, score)
    rounded = [scores.round_half_even(F.col(c), digits).alias(c) for c in ("mean", "p50", "p90", "p95")]
    return points.select(*keys, *rounded)


def quartiles(df: DataFrame, keys: Sequence[str], score: str = "toxicity") -> DataFrame:
    """Count, lowest, quartiles and highest score per group: what a cut violin shows."""
    return exact_quantiles(df, keys, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, score).drop("mean")


def config_distribution(df: DataFrame, by_model: bool = False, score: str = "toxicity") -> DataFrame:
    keys = ["clean_config", "model"] if by_model else ["clean_config"]
    return quartiles(with_clean_config(df), keys, score)


def score_histogram(df: DataFrame, keys: Sequence[str], bins: int = 20, score: str = "toxicity") -> DataFrame:
    """Counts per equal-width bin of [0, 1], with count, mean and range of the group.

    The last bin is closed.  At most ``bins`` rows per group reach the window.
    """
    keys = list(keys)
    value = scores.clip_score(score)
    place = F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int")
    binned = (
        known_keys(df, keys)
        .where(value.isNotNull())
        .groupBy(*keys, place.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("bin_n"),
            F.sum(scores.to_score(score)).alias("_sum"),
            F.min(scores.to_score(score)).alias("_low"),
            F.max(scores.to_score(score)).alias("_high"),
        )
    )
    group = Window.partitionBy(*keys)
    return binned.select(
        *keys,
        "bin",
        "bin_n",
        F.sum("bin_n").over(group).alias("n"),
        (F.sum("_sum").over(group) / F.sum("bin_n").over(group)).alias("mean"),
        F.min("_low").over(group).alias("low"),
        F.max("_high").over(group).alias("high"),
    )


def score_density(
    df: DataFrame, keys: Sequence[str], points: int = 100, bins: int = 1024, score: str = "toxicity"
) -> DataFrame:
    """Curve of a violin: Gaussian kernel density at ``points`` places between a group's lowest and highest score.

    Columns: the keys, point (from 0), score, density, and width, the density as a share of
    the group's highest.  The bandwidth is the sample deviation times n ** -0.2.  Scores are clipped to
    [0, 1].  Values are counted in ``bins`` equal bins, each of which stands at the mean of
    its values, so the curve is exact where a bin has one value, and else off by the
    kernel's second derivative over half a bin.  A group is one array of bins, whatever its
    number of rows.  A group without spread (one score, or equal ones) has one point of
    width 1 and no density.
    """
    if points < 2 or bins < 1:
        raise ValueError("a curve needs two points and a bin")
    keys = list(keys)
    value = scores.clip_score(score)
    place = F.least(F.floor(value * bins), F.lit(bins - 1))
    binned = (
        known_keys(df, keys)
        .where(value.isNotNull())
        .groupBy(*keys, place.alias("_bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("at"),
            (F.var_pop(value) * F.count(F.lit(1))).alias("m2"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        )
    )
    group = binned.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "m2"))).alias("_bins"),
        F.sum("n").alias("_n"),
        (F.sum(F.col("at") * F.col("n")) / F.sum("n")).alias("_mean"),
        F.min("low").alias("_low"),
        F.max("high").alias("_high"),
    )
    apart = F.aggregate("_bins", F.lit(0.0), lambda t, b: t + b["m2"] + b["n"] * F.pow(b["at"] - F.col("_mean"), F.lit(2)))
    spread = F.when((F.col("_n") > 1) & (F.col("_low") < F.col("_high")), F.sqrt(apart / (F.col("_n") - 1)))
    wide = group.withColumn("_h", spread * F.pow(F.col("_n"), F.lit(-0.2)))
    last = F.when(F.col("_h").isNull(), 0).otherwise(points - 1)
    x = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("point") / (points - 1)
    kernels = F.aggregate("_bins", F.lit(0.0), lambda t, b: t + b["n"] * F.exp(F.pow((F.col("score") - b["at"]) / F.col("_h"), F.lit(2)) / -2))
    curve = (
        wide.withColumn("point", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("score", x)
        .select(*keys, "point", "score", (kernels / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))
    )
    highest = F.max("density").over(Window.partitionBy(*keys))
    return curve.withColumn("width", F.coalesce(F.col("density") / highest, F.lit(1.0)))


def grouped_moments(df: DataFrame, score: str = "toxicity", threshold: float = scores.TAIL_THRESHOLD) -> DataFrame:
    """Mean, count, deviation and tail rate for several groupings in one scan.

    ``grouping`` names the key set of a row: model x temperature,
    configuration x model, or model alone.
    """
    base = with_clean_config(df).select(
        "clean_config", "model", "temperature", scores.to_score(score).alias("_v"), scores.threshold_flag(score, threshold).alias("_tail")
    )
    sets = base.groupingSets(
        [
            [F.col("model"), F.col("temperature")],
            [F.col("clean_config"), F.col("model")],
            [F.col("model")],
        ],
        "clean_config",
        "model",
        "temperature",
    ).agg(
        F.grouping_id("clean_config", "model", "temperature").alias("_set"),
        F.avg("_v").alias("mean"),
        F.count("_v").alias("count"),
        F.stddev_samp("_v").alias("std"),
        (F.avg("_tail") * 100).alias("tail_percent"),
    )
    grouping = (
        F.when(F.col("_set") == 4, "model_temperature").when(F.col("_set") == 1, "config_model").otherwise("model")
    )
    complete = (
        F.col("model").isNotNull()
        & ((F.col("_set") != 4) | F.col("temperature").isNotNull())
        & ((F.col("_set") != 1) | F.col("clean_config").isNotNull())
    )
    return sets.where(complete).withColumn("grouping", grouping).drop("_set")
