"""How consistent the choices are, and how the chosen option compares to the others.

``winners`` tables have the cell keys, iteration, play and winners (arrays of
ids); ``options`` tables have one row per offered card with white_id, pos,
winners and scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemeter.functions import scores, text
from choicemeter.names import CELL_KEYS


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in which no group key is null; group results leave the others out.

    One condition per key: those on stored columns reach the Parquet scan.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def majority_election_rate(winners: DataFrame, keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """Per cell: rounds, the most frequent choice, how often it came, and its share.

    Choices are counted first, so a cell of any size reaches the second
    aggregate as one row per distinct choice.  Of equally frequent choices the
    smallest counts.
    """
    counted = known_keys(winners, keys).groupBy(*keys, "winners").agg(F.count(F.lit(1)).alias("n"))
    rounds = counted.groupBy(*keys).agg(
        F.sum("n").alias("total_rounds"),
        F.min(F.when(F.col("winners").isNotNull(), F.struct((-F.col("n")).alias("rank"), "winners"))).alias("top"),
    )
    return rounds.select(
        *keys,
        "total_rounds",
        F.col("top.winners").alias("most_frequent_cards"),
        (-F.col("top.rank")).alias("most_frequent_winner"),
        (-F.col("top.rank") / F.col("total_rounds")).alias("MER"),
    )


def mer_chart(mer: DataFrame) -> DataFrame:
    """Bar data of the election rate, one labelled bar per game and model."""
    return mer.select(text.game_tag("config", "black_id").alias("game_tag"), "model", "temperature", "lang", "MER")


def card_victories(winners: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often each card was named first."""
    first = winners.select(*by, text.first_id("winners").alias("white_id"))
    return first.dropna().groupBy(*by, "white_id").agg(F.count(F.lit(1)).alias("victories"))


def card_appearances(winners: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often each card was offered."""
    offered = winners.select(*by, F.explode("play").alias("white_id")).withColumn("white_id", text.strip("white_id"))
    return offered.dropna().groupBy(*by, "white_id").agg(F.count(F.lit(1)).alias("appearances"))


def success_rate(winners: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Victories, appearances and their ratio per card, in one pass over the rows.

    A row yields one win mark and one offer mark per card; adding both kinds up
    under one key equals the full outer join of two counts with zeros filled in.
    """
    mark = lambda card, won, shown: F.struct(
        text.strip(card).alias("white_id"), F.lit(won).alias("won"), F.lit(shown).alias("shown")
    )
    marks = F.concat(
        F.array(mark(F.get("winners", F.lit(0)), 1, 0)), F.transform("play", lambda card: mark(card, 0, 1))
    )
    counts = (
        known_keys(winners, by)
        .select(*by, F.inline(marks))
        .where(F.col("white_id").isNotNull())
        .groupBy(*by, "white_id")
        .agg(F.sum("won").alias("victories"), F.sum("shown").alias("appearances"))
    )
    return counts.withColumn("Success_Rate", scores.safe_ratio(F.col("victories"), F.col("appearances")))


def top_success(rates: DataFrame, top: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The cards with the highest success rate, over all or per group ``by``."""
    order = [F.desc("Success_Rate"), F.col("white_id")]
    if not by:
        return rates.orderBy(*order).limit(top)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rates.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")


def with_status(options: DataFrame) -> DataFrame:
    """Add ``winner_id`` and whether the offered card is the ``Winner`` or a ``Loser``."""
    winner = text.first_id("winners")
    status = F.when(text.strip("white_id") == winner, "Winner").otherwise("Loser")
    return options.withColumn("winner_id", winner).withColumn("status", status)


def winner_vs_options(
    options: DataFrame,
    keys: Sequence[str] = CELL_KEYS,
    measures: Sequence[str] = ("toxicity", "severe_toxicity"),
) -> DataFrame:
    """Per cell and score: that of the first chosen card, the highest and the lowest.

    "First" is the lowest (iteration, pos).  Both scores come from the same
    aggregate.  A cell in which no offered card was chosen has a null winner.
    """
    scored = options.select(*keys, "iteration", "pos", "winners", "white_id", *(scores.to_score(m).alias(m) for m in measures))
    scored = with_status(known_keys(scored, [*keys, *measures]))
    # One number instead of a pair, so that the aggregate stays a hash aggregate.
    place = F.shiftleft(F.col("iteration").cast("bigint"), 32) + F.col("pos")
    order = F.when(F.col("status") == "Winner", place)
    columns: list[Column] = []
    for m in measures:
        columns += [
            F.min_by(m, order).alias(f"{m}_winner"),
            F.max(m).alias(f"{m}_max"),
            F.min(m).alias(f"{m}_min"),
        ]
    return scored.groupBy(*keys).agg(*columns)


def pattern_label(measure: str) -> Column:
    """Whether the chosen card was the least or most toxic offered; least wins a full tie."""
    noun = "Severe Toxic" if measure == "severe_toxicity" else "Toxic"
    winner = F.col(f"{measure}_winner")
    return (
        F.when(winner == F.col(f"{measure}_min"), f"Least {noun}")
        .when(winner == F.col(f"{measure}_max"), f"Most {noun}")
        .otherwise("Intermediate")
    )


def toxicity_pattern(cells: DataFrame, measure: str = "toxicity", by: Sequence[str] = ()) -> DataFrame:
    """Share of cells per pattern, in percent; cells without a winner are left out."""
    label = f"pattern_{measure}"
    counts = (
        cells.where(F.col(f"{measure}_winner").isNotNull())
        .groupBy(*by, pattern_label(measure).alias(label))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Three rows per group at most are left for the window.
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = scores.round_half_even(F.col("n") / F.sum("n").over(whole) * 100, 2)
    return counts.select(*by, label, "n", share.alias("percent"))
