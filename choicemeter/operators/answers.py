"""From raw answers to sentences: split, winner sentences, all offered options.

``responses`` has config, iteration, lang, model, temperature, black_id,
play (array of card ids) and response; ``cards`` has lang, color, card_id and
card_text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicemeter.functions import text
from choicemeter.names import BLACK, WHITE
from choicemeter.operators.lookup import fits_broadcast, lookup_join, match_join, small_join, unique_cards


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise when a column is missing; decided while the plan is built."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def black_cards(cards: DataFrame) -> DataFrame:
    usable, _ = unique_cards(cards.where(F.col("color") == BLACK))
    return usable.select("lang", F.col("card_id").alias("black_id"), F.col("card_text").alias("black_text"))


def white_cards(cards: DataFrame) -> DataFrame:
    usable, _ = unique_cards(cards.where(F.col("color") == WHITE))
    return usable.select("lang", F.col("card_id").alias("white_id"), F.col("card_text").alias("white_text"))


def template_parts(cards: DataFrame) -> DataFrame:
    """Templates as sentences are built from them: normalized and cut at their blanks.

    All pattern work is done here, once per card; a row of answers only
    concatenates.  ``head`` and ``tail`` are the texts around the first blank;
    ``tail`` is null without a blank.
    """
    template = F.col("template")
    cut = black_cards(cards).withColumn("template", text.normalize_black("black_text"))
    return cut.select(
        "lang",
        "black_id",
        F.split(template, text.BLANK_PATTERN, -1).alias("parts"),
        F.regexp_extract_all(template, F.lit(text.BLANK_PATTERN), F.lit(0)).alias("blanks"),
        F.get(F.split(template, text.BLANK_PATTERN, 2), F.lit(0)).alias("head"),
        F.get(F.split(template, text.BLANK_PATTERN, 2), F.lit(1)).alias("tail"),
    )


def white_texts(cards: DataFrame) -> DataFrame:
    """Option texts in the form in which they enter a sentence."""
    return white_cards(cards).select("lang", "white_id", text.normalize_white("white_text").alias("white_text"))


def classify_answers(responses: DataFrame, cards: DataFrame, id_pattern: str = text.ID_PATTERN) -> DataFrame:
    """Add ``winners`` and ``bucket`` (no_id, mismatch or good) to every response.

    An answer without an id is ``no_id``; one whose ids are as many as the
    blanks of its template is ``good``; all others, and those whose template is
    not known, are ``mismatch``.  Every row lands in exactly one bucket.
    """
    require_columns(responses, "response", "lang", "black_id")
    ids = responses.withColumn("winners", text.extract_ids("response", id_pattern))
    blanks = black_cards(cards).select("lang", "black_id", text.blank_count("black_text").alias("_blanks"))
    named = F.size("winners")
    bucket = (
        F.when(named == 0, "no_id").when(named == F.col("_blanks"), "good").otherwise("mismatch")
    )
    return small_join(ids, blanks, ["lang", "black_id"]).withColumn("bucket", bucket).drop("_blanks")


def split_answers(
    responses: DataFrame, cards: DataFrame, id_pattern: str = text.ID_PATTERN
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three buckets as tables: good, no_id (without winners), mismatch (without response).

    A table without a response column gives three empty tables.
    """
    if "response" not in responses.columns:
        empty = responses.where(F.lit(False))
        no_ids = F.array().cast("array<string>").alias("winners")
        return empty.select("*", no_ids), empty.withColumn("response", F.lit("")), empty.select("*", no_ids)
    sorted_out = classify_answers(responses, cards, id_pattern)

    def take(bucket: str, unused: str) -> DataFrame:
        return sorted_out.where(F.col("bucket") == bucket).drop("bucket", unused)

    return take("good", "response"), take("no_id", "winners"), take("mismatch", "response")


def bucket_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def most_blanks(cards: DataFrame) -> int:
    """The largest number of blanks in any template: one aggregated value."""
    row = cards.where(F.col("color") == BLACK).agg(F.max(text.blank_count("card_text"))).first()
    return row[0] or 0


def by_distinct(rows: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame], added: Sequence[str] = ("sentence",)) -> DataFrame:
    """``rows`` with the columns ``added``, which ``build`` adds to each distinct combination of ``keys`` once.

    Rows and combinations meet by a digest of 16 bytes.
    """
    given = [c for k in keys for c in (F.isnull(k), F.col(k))]
    # Nulls in a list add nothing to a hash; their places do.
    given += [F.transform(k, F.isnull) for k in keys if isinstance(rows.schema[k].dataType, T.ArrayType)]
    digest = {"_made_1": F.xxhash64(*given), "_made_2": F.xxhash64(F.lit(1), *given)}
    marked = rows.withColumns(digest)
    built = build(marked.select(*digest, *keys).dropDuplicates([*digest]))
    return match_join(marked, built.select(*digest, *added), [*digest]).drop(*digest)


def filled_once(plays: DataFrame, cards: DataFrame) -> DataFrame:
    """The sentence of each row's lang, black_id and winners: one lookup of cards, whatever the number of blanks."""
    digest = [c for c in plays.columns if c not in ("lang", "black_id", "winners")]
    joined = small_join(plays, template_parts(cards).drop("head", "tail"), ["lang", "black_id"])
    chosen = joined.select(*digest, "lang", "parts", "blanks", F.posexplode_outer("winners").alias("_pos", "white_id"))
    named = lookup_join(chosen, white_texts(cards), ["lang", "white_id"]).groupBy(*digest).agg(
        F.any_value("parts").alias("parts"),
        F.any_value("blanks").alias("blanks"),
        # no row of a place stands for an answer without cards
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "white_text")))).alias("chosen"),
    )
    texts = F.transform("chosen", lambda c: c["white_text"])
    filler = lambda i: F.when(F.size("chosen") >= i, F.get(texts, i - 1)).otherwise(F.get("blanks", i - 1))
    pieces = F.transform("parts", lambda part, i: F.concat(F.when(i == 0, F.lit("")).otherwise(filler(i)), part))
    whole = (F.size("chosen") <= F.size("blanks")) & ~F.exists(pieces, lambda p: p.isNull())
    return named.withColumn("sentence", F.when(whole, text.strip(F.array_join(pieces, ""))))


def winner_sentences(good: DataFrame, cards: DataFrame, blanks: int | None = None) -> DataFrame:
    """Add the sentence that the chosen cards make, null if a card is unknown.

    With cards within the broadcast limit, one lookup per blank finds all texts, and
    the rows are not shuffled.  Beyond it each distinct answer to a template is filled
    once, with one lookup for all of its cards, and joined back.
    """
    whites = white_texts(cards)
    if not fits_broadcast(good, whites):
        return by_distinct(good, ["lang", "black_id", "winners"], lambda plays: filled_once(plays, cards)).select(*good.columns, "sentence")
    blanks = most_blanks(cards) if blanks is None else blanks
    joined = lookup_join(good, template_parts(cards).drop("head", "tail"), ["lang", "black_id"])
    pieces = [F.get("parts", F.lit(0))]
    for i in range(blanks):
        slot = f"_text_{i}"
        texts = whites.select("lang", F.col("white_id").alias("_id"), F.col("white_text").alias(slot))
        joined = lookup_join(joined.withColumn("_id", F.get("winners", F.lit(i))), texts, ["lang", "_id"]).drop("_id")
        filler = F.when(F.size("winners") > i, F.col(slot)).otherwise(F.get("blanks", F.lit(i)))
        piece = F.concat(filler, F.get("parts", F.lit(i + 1)))
        pieces.append(F.when((F.size("blanks") > i) | (F.size("winners") > i), piece).otherwise(""))
    sentence = F.when(F.size("winners") <= F.size("blanks"), text.strip(F.concat(*pieces)))
    return joined.withColumn("sentence", sentence).select(*good.columns, "sentence")


def offered_texts(plays: DataFrame, cards: DataFrame) -> DataFrame:
    """The template of each row's lang, black_id and play, cut at its first blank, and the texts of the play's cards in order."""
    digest = [c for c in plays.columns if c not in ("lang", "black_id", "play")]
    offered = plays.select(*digest, "lang", "black_id", F.posexplode("play").alias("pos", "white_id"))
    found = lookup_join(offered, white_texts(cards), ["lang", "white_id"]).groupBy(*digest).agg(
        F.any_value("lang").alias("lang"),
        F.any_value("black_id").alias("black_id"),
        F.array_sort(F.collect_list(F.struct("pos", "white_text"))).alias("white_texts"),
    )
    templates = template_parts(cards).select("lang", "black_id", "head", "tail")
    texts = F.transform("white_texts", lambda c: c["white_text"])
    return small_join(found.withColumn("white_texts", texts), templates, ["lang", "black_id"])


def first_filled() -> Column:
    """The sentence that ``white_text`` makes in the first blank between ``head`` and ``tail``."""
    with_tail = F.concat("head", "white_text", "tail")
    return text.strip(F.when(F.col("tail").isNotNull(), with_tail).when(F.col("white_text").isNotNull(), F.col("head")))


def all_combinations(good: DataFrame, cards: DataFrame) -> DataFrame:
    """One row per offered card, with the sentence that this one card makes.

    ``pos`` is the place of the card in the play.  A template with several
    blanks has only its first one filled.  Beyond the broadcast limit the texts of each
    distinct play are looked up once and joined to its answers; sentences are made, and a
    play's cards become rows, behind the last shuffle.
    """
    kept = [c for c in good.columns if c not in ("response", "bucket")]
    if not fits_broadcast(good, white_texts(cards)):
        rows, found = good.select(*kept), ["head", "tail", "white_texts"]
        joined = by_distinct(rows, ["lang", "black_id", "play"], lambda plays: offered_texts(plays, cards), found)
        offered = joined.select(*kept, *found, F.posexplode("play").alias("pos", "white_id"))
        filled = offered.withColumn("white_text", F.get("white_texts", F.col("pos")))
        return filled.select(*kept, "pos", "white_id", first_filled().alias("sentence"))
    # templates are looked up before a play's cards become rows
    templates = template_parts(cards).select("lang", "black_id", "head", "tail")
    offered = lookup_join(good, templates, ["lang", "black_id"]).select("*", F.posexplode("play").alias("pos", "white_id"))
    joined = lookup_join(offered, white_texts(cards), ["lang", "white_id"])
    return joined.select(*kept, "pos", "white_id", first_filled().alias("sentence"))


def with_sentence_reason(sentences: DataFrame) -> DataFrame:
    """Add why a sentence is missing; null where it was built."""
    return sentences.withColumn("reason", F.when(F.col("sentence").isNull(), "card text not found"))
