"""Between wide and long forms of games, and text-to-id resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemeter.functions import text
from choicemeter.operators.lookup import fits_broadcast, lookup_join, match_join
from choicemeter.session import written


def option_columns(df: DataFrame, prefix: str = "white_id_") -> list[str]:
    """The option columns of a wide game table, by name."""
    return [c for c in df.columns if c.startswith(prefix)]


def games_from_wide(wide: DataFrame) -> DataFrame:
    """Wide game rows with their options as one array; other columns are kept."""
    options = option_columns(wide)
    others = [c for c in wide.columns if c not in options]
    return wide.select(*others, F.array(*options).alias("white_ids"))


def melt_games(wide: DataFrame, ids: Sequence[str] = ("black_id",)) -> DataFrame:
    """One row per offered card: ``variable`` is the option column; empty options are dropped."""
    long = wide.unpivot(list(ids), option_columns(wide), "variable", "white_id")
    return long.where(F.col("white_id").isNotNull())


def melt_means(comparison: DataFrame) -> DataFrame:
    """Chart form of the comparison of descriptions: one row per description and score type."""
    ids = [c for c in comparison.columns if c not in ("run_number", "mean_toxicity", "mean_severe_toxicity")]
    return comparison.unpivot(ids, ["mean_toxicity", "mean_severe_toxicity"], "tox_type", "mean_score")


def long_to_games(long: DataFrame, slots: int = 5, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """One row per template with its cards in ``white_id_1..slots``, and the templates that do not fit.

    Templates are counted first, so one with too many rows is set aside before
    its rows are numbered and the window only sees groups of ``slots`` rows.
    """
    counts = long.where(F.col("black_id").isNotNull()).groupBy("black_id").agg(F.count(F.lit(1)).alias("n"))
    fitting = match_join(long, counts, ["black_id"]).where(F.col("n") <= slots)
    slot = F.row_number().over(Window.partitionBy("black_id").orderBy(order))
    numbered = fitting.select("black_id", "white_id", F.concat(F.lit("white_id_"), slot).alias("variable"))
    names = [f"white_id_{i}" for i in range(1, slots + 1)]
    games = numbered.groupBy("black_id").pivot("variable", names).agg(F.first("white_id"))
    return games, counts.where(F.col("n") > slots).withColumn("reason", F.lit("more rows than slots"))


def compact_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Shift the filled values of ``columns`` to the left and drop the last column.

    A row that fills all columns does not fit and comes back as a reject.
    """
    filled = F.filter(F.array(*columns), lambda v: v.isNotNull())
    others = [c for c in df.columns if c not in columns]
    packed = df.withColumn("_filled", filled)
    fits = F.size("_filled") < len(columns)
    kept: list[Column] = [F.get("_filled", F.lit(i)).alias(name) for i, name in enumerate(columns[:-1])]
    compacted = packed.where(fits).select(*others, *kept)
    return compacted, packed.where(~fits).drop("_filled").withColumn("reason", F.lit("no empty column"))


def phrase_texts(phrases: DataFrame, whites: DataFrame, blacks: DataFrame) -> DataFrame:
    """Texts of the two cards next to each phrase, normalized for comparison.

    ``whites`` and ``blacks`` have card_id and card_text.
    """
    white = whites.select(F.col("card_id").alias("white_id"), F.col("card_text").alias("white_text"))
    black = blacks.select(F.col("card_id").alias("black_id"), F.col("card_text").alias("black_text"))
    joined = lookup_join(lookup_join(phrases, white, ["white_id"]), black, ["black_id"])
    shown = ["black_text", "white_text", "full_phrase"]
    others = [c for c in phrases.columns if c not in ("full_phrase", "toxicity_label", "Justification")]
    return joined.select(*others, *(text.normalize_white(c).alias(c) for c in shown))


def phrase_violations(texts: DataFrame) -> DataFrame:
    """Phrases that do not contain their white text."""
    return texts.where(~F.coalesce(F.contains("full_phrase", "white_text"), F.lit(False)))


def phrase_containment(texts: DataFrame) -> DataFrame:
    """One row: phrases, violations, and whether every phrase contains its white text."""
    inside = F.coalesce(F.contains("full_phrase", "white_text"), F.lit(False))
    return texts.agg(
        F.count(F.lit(1)).alias("phrases"),
        F.count_if(~inside).alias("violations"),
        F.bool_and(inside).alias("all_contained"),
    )


def resolve_texts(df: DataFrame, cards: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace text columns by the ids of the cards with the same normalized text.

    ``columns`` maps each text column to the name of its id column; an unknown
    text gives null, and of cards with the same text the smallest id counts, so rows
    never multiply.  With cards within the broadcast limit each column is looked up on its
    own and the rows are not shuffled.  Beyond it each distinct combination of texts is
    looked up once, all of its columns by one join, and joined back by a digest.
    """
    norms = cards.select(F.col("card_id").alias("_card_id"), text.normalize_text("card_text").alias("_norm"))
    known = norms.where("_norm is not null").groupBy("_norm").agg(F.min("_card_id").alias("_card_id"))
    if len(columns) > 1 and not fits_broadcast(df, norms):
        return resolved_together(df, known, columns)
    for column, id_column in columns.items():
        df = (
            lookup_join(df.withColumn("_norm", text.normalize_text(column)), known, ["_norm"])
            .withColumnRenamed("_card_id", id_column)
            .drop("_norm", column)
        )
    return df


def resolved_together(df: DataFrame, known: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``resolve_texts`` with one lookup for all columns of each distinct combination of texts."""
    marks = ["_made_1", "_made_2"]
    others = [c for c in df.columns if c not in columns]
    texts = F.array(*(text.normalize_text(c) for c in columns))
    marked = df.withColumn("_norms", texts).withColumns({"_made_1": F.xxhash64("_norms"), "_made_2": F.xxhash64(F.lit(1), "_norms")})
    # Nulls add nothing to a hash; their places do.
    nulls = F.transform("_norms", lambda t: t.isNull())
    # Read for its keys, its texts and its rows: written, so that what makes the rows is done once.
    marked = written(marked.withColumns({m: F.xxhash64(m, nulls) for m in marks}).select(*others, *marks, "_norms"), "texts")
    cells = marked.select(*marks, "_norms").dropDuplicates(marks).select(*marks, F.posexplode("_norms").alias("_pos", "_norm"))
    found = lookup_join(cells.where(F.col("_norm").isNotNull()), known, ["_norm"], "inner")
    ids = found.groupBy(*marks).agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_card_id"))).alias("_ids"))
    joined = match_join(marked.drop("_norms"), ids, marks)
    named = [F.col("_ids")[F.lit(i)].alias(id_column) for i, id_column in enumerate(columns.values())]
    return joined.select(*others, *named)
