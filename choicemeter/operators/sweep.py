"""Planning of a sweep: which prompts are sent to which model, how often.

``games`` has config, lang, play_no, black_id and white_ids (array); config, lang,
play_no and, for configurations of several files, part name one play.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicemeter.functions import text
from choicemeter.functions.prompts import render_prompt
from choicemeter.operators.answers import black_cards, white_cards
from choicemeter.operators.lookup import lookup_join
from choicemeter.sources.slices import SLICES, ask_in_slices

PLAY_KEYS = ("config", "lang", "part", "play_no")


def play_keys(games: DataFrame) -> list[str]:
    return [k for k in PLAY_KEYS if k in games.columns]


def test_subset(games: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` plays of every game file, per language.

    The rank filter is applied in every input task before the shuffle, so a
    large file sends few rows to the window.
    """
    place = F.row_number().over(Window.partitionBy("lang", "config").orderBy(*play_keys(games)[2:]))
    return games.withColumn("_place", place).where(F.col("_place") <= rows).drop("_place")


def sweep_matrix(games: DataFrame, models: Sequence[str], temperatures: Sequence[float], rounds: int) -> DataFrame:
    """Every play with every model and temperature, ``rounds`` times.

    The settings are a handful of values of the run's configuration; rows are
    unfolded from arrays, without a join.
    """
    return (
        games.withColumn("model", F.explode(F.array(*map(F.lit, models))))
        .withColumn("temperature", F.explode(F.array(*(F.lit(float(t)) for t in temperatures))))
        .withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(int(rounds)))))
    )


def sweep_size(matrix: DataFrame) -> DataFrame:
    """Number of (config, model, temperature) combinations and of prompts, per language."""
    cells = matrix.groupBy("lang", "config", "model", "temperature").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("lang").agg(F.count(F.lit(1)).alias("combinations"), F.sum("n").alias("prompts"))


def play_options(games: DataFrame, cards: DataFrame) -> DataFrame:
    """Add the texts a prompt needs: ``options`` and ``black_text``.

    Plays are few against the prompts made from them, so the texts are looked
    up here, once per play.  ``reason`` says why a play cannot be used: a card
    (or an option itself) is missing.
    """
    keys = play_keys(games)
    offered = games.select(*keys, F.posexplode("white_ids").alias("pos", "white_id"))
    labelled = lookup_join(offered, white_cards(cards), ["lang", "white_id"]).select(
        *keys, "pos", text.option_label("white_id", "white_text").alias("label")
    )
    # A play's own options: as many as its array holds.
    options = labelled.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda o: o["label"]), "").alias("options"),
        F.count_if(F.col("label").isNull()).alias("_missing"),
    )
    joined = games.join(options, keys, "left")
    joined = lookup_join(joined, black_cards(cards), ["lang", "black_id"])
    reason = F.when(F.coalesce(F.col("_missing"), F.lit(0)) > 0, "white card not found").when(
        F.col("black_text").isNull(), "black card not found"
    )
    return joined.withColumn("reason", reason).drop("_missing")


def render_prompts(plays: DataFrame, prompt_type: str, character_description: str) -> DataFrame:
    """Add the prompt of every usable play; a language without template is a reason too."""
    prompt = render_prompt(
        F.col("lang"),
        F.lit(prompt_type),
        {
            "character_description": F.lit(character_description),
            "black_card_text": F.col("black_text"),
            "white_cards_options": F.col("options"),
        },
    )
    prompted = plays.withColumn("prompt", F.when(F.col("reason").isNull(), prompt))
    no_template = F.col("reason").isNull() & F.col("prompt").isNull()
    return prompted.withColumn("reason", F.when(no_template, "no prompt template").otherwise(F.col("reason")))


def check_language(games: DataFrame, lang: str) -> tuple[DataFrame, DataFrame]:
    """Plays of the expected language, and the others with a reason."""
    other = ~F.col("lang").eqNullSafe(lang)
    return games.where(~other), games.where(other).withColumn("reason", F.lit("unexpected language"))


def plan_prompts(
    games: DataFrame,
    cards: DataFrame,
    models: Sequence[str],
    temperatures: Sequence[float],
    rounds: int,
    prompt_type: str,
    character_description: str,
) -> tuple[DataFrame, DataFrame]:
    """All prompts of a sweep, and the plays that were left out."""
    plays = render_prompts(play_options(games, cards), prompt_type, character_description)
    usable = plays.where(F.col("reason").isNull()).drop("reason", "options", "black_text")
    return sweep_matrix(usable, models, temperatures, rounds), plays.where(F.col("reason").isNotNull())


def batch_respond(
    prompts: DataFrame, respond: Callable[[str, str, float], str], tasks: int | None = None, store: str | None = None, slices: int = SLICES
) -> DataFrame:
    """Send every prompt to ``respond(prompt, model, temperature)``.

    Calls are slow, so ``tasks`` sets how many run side by side.  A failed call
    becomes the answer ``API_ERROR: <type>: <message>`` of its row.  With ``store``, a
    folder, answers are kept there slice by slice, and what it holds is not asked again.
    """
    if store:
        return ask_in_slices(prompts, lambda some: batch_respond(some, respond, tasks), store, slices)
    carried = [c for c in ("_call",) if c in prompts.columns]
    asked = prompts.select(
        "config", "iteration", "lang", "model", "temperature", "black_id", F.col("white_ids").alias("play"), "prompt", *carried
    )
    if tasks:
        asked = asked.repartition(tasks)
    schema = (
        "config string, iteration int, lang string, model string, temperature double, "
        "black_id string, play array<string>, " + "".join(f"{c} string, " for c in carried) + "response string"
    )

    def answer(row) -> str:
        try:
            return respond(row.prompt, row.model, row.temperature) or ""
        except Exception as error:  # noqa: BLE001 - any failure of the model is an answer row
            return f"API_ERROR: {type(error).__name__}: {error}"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            responses = [answer(row) for row in batch.itertuples(index=False)]
            yield batch.drop(columns="prompt").assign(response=responses)

    return asked.mapInPandas(ask, schema)
