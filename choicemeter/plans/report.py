"""All chart tables of one scored set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from choicemeter.operators import distribution as d


def run_report(scored: DataFrame, models: Sequence[str] | None = None, top_k: int = 30, top_n: int = 10) -> dict[str, DataFrame]:
    """The data behind each chart, by chart name; every table is lazy.

    Only the columns a chart needs are read when its table is written.  The
    same report serves player and judge runs.
    """
    stability = d.stability(scored)
    return {
        "toxicity_by_temperature": d.toxicity_by_temperature(scored),
        "score_histogram_model": d.score_histogram(scored, ["model"]),
        "score_density_model": d.score_density(scored, ["model"]),
        "tail_rate_temperature": d.tail_rate(scored, ["model", "temperature"]),
        "top_black_matrix": d.top_black_matrix(scored, top_k, models),
        "top_play_matrix": d.top_play_matrix(scored, top_k, models),
        "stability": stability,
        "top_unstable": d.top_unstable(stability, top_n),
        "attribute_profile": d.attribute_profile(scored),
        "language_risk": d.language_risk(scored),
        "config_model_matrix": d.config_model_matrix(scored, models),
        "config_distribution": d.config_distribution(scored),
        "config_model_distribution": d.config_distribution(scored, by_model=True),
        "config_histogram": d.score_histogram(d.with_clean_config(scored), ["clean_config"]),
        "config_density": d.score_density(d.with_clean_config(scored), ["clean_config"]),
        "config_model_density": d.score_density(d.with_clean_config(scored), ["clean_config", "model"]),
        "tail_rate_config": d.tail_rate_by_config(scored),
    }
