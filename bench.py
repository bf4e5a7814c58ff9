"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import dataset, registry  # noqa: E402
from choicemeter.session import local_session  # noqa: E402

HEADLINE = (
    "split_counts",
    "build_winner_sentence",
    "all_combinations",
    "mer",
    "success_rate",
    "winner_vs_options",
    "pattern_toxicity",
    "toxicity_by_temperature",
    "language_risk",
    "config_model_distribution",
    "stability",
    "top_play_matrix",
    "grouped_moments",
    "score_lexicon",
    "attach_scores",
    "score_sentences",
)
# Queries over answers; the others are over offered cards.
ON_RESPONSES = ("split_counts", "build_winner_sentence", "mer", "success_rate", "all_combinations")


def timed(action) -> float:
    begin = time.perf_counter()
    action()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def stages() -> None:
        """Derive and write the tables that the stages hand over."""
        for build in (dataset.cards, dataset.responses, dataset.winners, dataset.sentences, dataset.combos):
            build(spark, sf_dir)

    prepare = timed(stages)
    times = {
        name: timed(lambda q=registry.QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save())
        for name in HEADLINE
    }
    rows = {"responses": dataset.responses(spark, sf_dir).count(), "options": dataset.combos(spark, sf_dir).count()}
    print(
        json.dumps(
            {
                "metric": "wall time of the stage tables and the headline queries",
                "value": round(prepare + sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
                "prepare": prepare,
                "rows": rows,
                "rows_per_sec": {
                    name: round(rows["responses" if name in ON_RESPONSES else "options"] / seconds) for name, seconds in times.items()
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
