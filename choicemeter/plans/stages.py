"""The five stages of an experiment; each reads and writes tables below one root folder.

Tables are partitioned by run, so a stage touches only the partitions of its
run and the analysis of all runs reads the same tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemeter.functions import text
from choicemeter.names import ATTRIBUTES, CELL_KEYS
from choicemeter.operators import answers, consistency, reshape, runs, scoring, states, sweep, validation
from choicemeter.plans.report import run_report
from choicemeter.sources import readers, sinks
from choicemeter.sources.contracts import STAGE_CONFIGS


def start_run(spark: SparkSession, config: Mapping, started: datetime | None = None) -> str:
    """Check a run's configuration, give it an id and store the configuration under it."""
    started = started or datetime.now()
    value = json.dumps(config, ensure_ascii=False)
    row = spark.createDataFrame([(str(config.get("prompt_type")), started, value)], "prompt_type string, started timestamp, value string")
    named = row.select(text.run_id("prompt_type", "started").alias("run_id"), "value")
    check_stage(spark, 1, config)
    sinks.write_manifest(named, f"{config['results_dir']}/manifest")
    return named.first()["run_id"]


def check_stage(spark: SparkSession, stage: int, config: Mapping) -> None:
    """Refuse a stage's configuration that breaks its contract."""
    value = json.dumps(config, ensure_ascii=False)
    row = spark.createDataFrame([("", value)], "run_id string, value string")
    parsed = row.select("run_id", F.try_parse_json("value").alias("config"))
    errors = readers.check_configs(parsed, STAGE_CONFIGS[stage]).first()["errors"]
    if errors:
        raise ValueError("; ".join(errors))


def card_pattern(cards: DataFrame) -> str:
    """The pattern of the white cards' ids, so that no id is cut: one row of an aggregate."""
    parts = cards.where(F.col("color") == "WHITE").select(
        F.regexp_extract("card_id", "^([A-Za-z]+)([0-9]+)$", 1).alias("letters"), F.length(F.regexp_extract("card_id", "^([A-Za-z]+)([0-9]+)$", 2)).alias("digits")
    )
    found = parts.agg(F.collect_set("letters").alias("letters"), F.min("digits").alias("least"), F.max("digits").alias("most")).first()
    if not found["letters"]:
        return text.ID_PATTERN
    if "" in found["letters"] or len(found["letters"]) > 1:
        raise ValueError("ids of white cards must be the same letters and a number")
    least, most = found["least"], found["most"]
    return found["letters"][0] + (f"[0-9]{{{most}}}" if least == most else f"[0-9]{{{least},{most}}}")


def collect_responses(
    spark: SparkSession, config: Mapping, run_id: str, respond: Callable[[str, str, float], str], tasks: int | None = None
) -> DataFrame:
    """Stage 1: prompt every model with every play and store the answers.  Returns the plays left out.

    Answers are kept in slices below ``calls``, so that a run that is repeated after a
    failure asks only for those that are missing.
    """
    kind, root = config["file_type"], config["results_dir"]
    cards, card_rejects = readers.read_cards(spark, config["cards_dir"], config["languages"], kind)
    games, game_rejects = readers.read_games(spark, config["cards_dir"], config["languages"], config["prompt_type"], kind)
    sinks.write_rejects(validation.row_messages(card_rejects), root, run_id, "cards")
    sinks.write_rejects(validation.row_messages(game_rejects), root, run_id, "games")
    foreign = ~F.col("lang").eqNullSafe(F.col("folder_lang"))
    own = games.where(~foreign).drop("folder_lang")
    if config["dataset_mode"] == "test":
        own = sweep.test_subset(own, config["test_num_rows"])
    prompts, left_out = sweep.plan_prompts(
        own, cards, config["models"], config["temperatures"], config["rounds"], config["prompt_type"], config["character_description"]
    )
    sinks.write_responses(sweep.batch_respond(prompts, respond, tasks, f"{root}/calls/{run_id}"), root, run_id)
    other = games.where(foreign).drop("folder_lang").withColumn("reason", F.lit("unexpected language"))
    unused = left_out.select(*other.columns).unionByName(other)
    sinks.write_rejects(unused, root, run_id, "plays")
    return unused


def build_sentences(spark: SparkSession, config: Mapping, run_id: str, id_pattern: str | None = None) -> None:
    """Stage 2: split the answers, keep the rejects, build the winners' and all other sentences.

    The pattern of card ids follows from the cards unless it is given.  A sentence that
    could not be built stays in its table as null, and its row with the reason among the rejects.
    """
    root = config["results_dir"]
    cards, _ = readers.read_cards(spark, config["cards_dir"], config["languages"], config["file_type"])
    responses = run_table(spark, f"{root}/raw_responses", run_id)
    good, no_id, mismatch = answers.split_answers(responses, cards, id_pattern or card_pattern(cards))
    sinks.write_rejects(no_id, root, run_id, "no_id")
    sinks.write_rejects(mismatch, root, run_id, "mismatch")
    built = answers.with_sentence_reason(answers.winner_sentences(good, cards))
    sinks.write_sentences(built.drop("reason"), root, run_id, "winners")
    sinks.write_rejects(built.where(F.col("sentence").isNull()), root, run_id, "sentence")
    sinks.write_sentences(answers.all_combinations(good, cards), root, run_id, "combinations")


def score_sentences(
    spark: SparkSession, root: str, run_id: str, scorers: Mapping[str, tuple[scoring.Scorer, Sequence[str]]]
) -> None:
    """Stage 3: score both sentence tables with every classifier: name -> (scorer, its labels).

    A row whose sentence could not be built has no text to score: stage 2 keeps it among the rejects.
    """
    for kind in ("winners", "combinations"):
        sentences = run_table(spark, f"{root}/{kind}", run_id).where(F.col("sentence").isNotNull())
        for classifier, (scorer, labels) in scorers.items():
            scored = scoring.add_scores(sentences, "sentence", scorer, labels)
            sinks.write_scores(scored, root, run_id, kind, classifier)
            written = sinks.read_parts(spark, f"{root}/scored_{kind}", classifier=classifier, run_id=run_id)
            sinks.write_states(written, root, run_id, kind, classifier)


def remote_scorer(
    call: Callable[[str], Mapping], attributes: Sequence[str] = ATTRIBUTES, tasks: int | None = None, store: str | None = None
) -> scoring.Scorer:
    """A scorer around a remote client whose replies hold ``attributeScores``; with ``store`` a text is sent once."""

    def score(texts: DataFrame) -> DataFrame:
        replies = scoring.batch_score_json(texts, "input", call, tasks, store).withColumnRenamed("original_text", "input")
        return scoring.flatten_scores(replies, attributes).select("input", *(a.lower() for a in attributes))

    return score


def run_table(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The rows of one run; only its partition is read."""
    return sinks.read_parts(spark, path, run_id=run_id).drop("run_id")


def report(spark: SparkSession, root: str, run_id: str, kind: str, classifier: str, models: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Stage 4: the chart tables of one scored set."""
    scored = run_table(spark, f"{root}/scored_{kind}", run_id).where(F.col("classifier") == classifier)
    return run_report(scored, models)


def with_role(df: DataFrame) -> DataFrame:
    """Add the role that the run id tells."""
    run = F.col("run_id")
    return df.withColumn("role", F.when(run.contains("player"), "player").when(run.contains("judge"), "judge"))


def analyse_states(spark: SparkSession, root: str, kind: str = "winners", classifier: str | None = None) -> dict[str, DataFrame]:
    """Figures of all runs from their aggregate states; the scores are not read again.

    A run that is added costs the scan of its own scores, when they are written.
    """
    values = {"kind": kind, **({"classifier": classifier} if classifier else {})}
    found = sinks.read_parts(spark, f"{root}/score_states", **values)
    toxicity = found.where("attribute = 'toxicity'")
    quantiles = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    by = lambda keys: states.described(states.merge_states(toxicity, keys), quantiles)
    return {
        "temperature": by(["model", "temperature"]),
        "config": by(["clean_config", "model"]),
        "language": by(["lang", "model"]),
        "run": by(["run_id", "classifier"]),
        "attributes": states.attribute_means(found),
    }


def analyse(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Stage 5: all runs at once; run_id, role and classifier are group keys instead of files."""
    file_keys = ["run_id", "role", "classifier"]
    winners = with_role(sinks.read_parts(spark, f"{root}/scored_winners")).where(F.col("role").isNotNull())
    options = with_role(sinks.read_parts(spark, f"{root}/scored_combinations")).where(F.col("role").isNotNull())
    rates = consistency.success_rate(winners, file_keys)
    cells = consistency.winner_vs_options(options, [*file_keys, *CELL_KEYS])
    attributes = readers.run_attributes(readers.read_manifest(spark, f"{root}/manifest/*"))
    # what was scored, also where no row came of it
    files = with_role(sinks.read_parts(spark, f"{root}/scored_files", kind="winners")).where(F.col("role").isNotNull())
    compared = runs.judge_comparison(winners, attributes, files)
    mer = consistency.majority_election_rate(winners, [*file_keys, *CELL_KEYS])
    return {
        "mer": mer,
        "mer_chart": consistency.mer_chart(mer),
        "success_rate": rates,
        "top_success": consistency.top_success(rates, by=file_keys),
        "winner_vs_options": cells,
        "pattern_toxicity": consistency.toxicity_pattern(cells, "toxicity", file_keys),
        "pattern_severe": consistency.toxicity_pattern(cells, "severe_toxicity", file_keys),
        "judge_comparison": compared,
        "judge_comparison_long": reshape.melt_means(compared),
    }
