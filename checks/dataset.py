"""Game tables derived from the driver's tables; they grow with them.

``benchmark`` gives the templates, ``part`` the option cards, ``events`` the
answers: one row each, without limits.  As between the stages of an experiment,
answers, good answers and scored options are handed over as written tables;
each is written once per application, in the shared scratch folder.  Card ids have twelve digits, so the
number of cards is not bounded by the id; queries pass ``ID_PATTERN`` on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemeter.functions import text
from choicemeter.operators import answers
from choicemeter.session import scratch_dir

ID_PATTERN = "W[0-9]{12}"
OFFSETS = (0, 53, 106, 159, 12)
MODELS = ("model:0", "model:1", "model:2")
TEMPERATURES = (0.2, 0.5, 0.8)
ROUNDS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A stage's table, built and written when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{scratch_dir(spark, name)}/{name}"
        build(spark, sf_dir).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table that comes in fewer splits than there are cores; leave others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def black(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates: whole texts with a blank put in; every tenth has a second blank at its end."""
    blanked = F.regexp_replace("text", r"^([^ ]+ [^ ]+ [^ ]+) ", "$1 ____ ")
    second = F.when(F.col("item_id") % 10 == 9, " __ ").otherwise("")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("B"), F.col("item_id") + 1).alias("card_id"),
        F.concat(blanked, second, F.lit(". ")).alias("card_text"),
    )


def white_id(number: Column) -> Column:
    return F.concat(F.lit("W"), F.lpad(number.cast("string"), 12, "0"))


def white(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    word = F.when(key % 8 == 0, "Stupid ").when(key % 8 == 3, "worthless IDIOT ").otherwise("")
    end = F.when(key % 3 == 0, ".").when(key % 3 == 1, "!;").otherwise("")
    return table(spark, sf_dir, "part").select(
        white_id(key + 1).alias("card_id"),
        F.concat(F.lit("A "), word, F.col("p_name"), F.lit(" "), key.cast("string"), end).alias("card_text"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "cards", build_cards)


def build_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of both colours in two languages."""
    both = black(spark, sf_dir).withColumn("color", F.lit("BLACK")).unionByName(
        white(spark, sf_dir).withColumn("color", F.lit("WHITE"))
    )
    return both.select(F.explode(F.array(F.lit("EN"), F.lit("IT"))).alias("lang"), "color", "card_id", "card_text")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "responses", build_responses)


def build_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per event; ``n`` is the event's number."""
    templates = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1))).scalar()
    options = table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    n = F.col("event_id")
    parts = (
        spread(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
        .select(n.alias("n"), "user_id", templates.alias("nb"), options.alias("np"))
        .select("n", "user_id", "np", (F.col("n") % F.col("nb")).alias("bn"), F.floor(F.col("n") / F.col("nb")).alias("g"))
        .withColumn("h", F.floor(F.col("g") / 9))
        .withColumn("cn", F.floor(F.col("h") / ROUNDS))
    )
    start = F.col("bn") * 7919 + F.col("cn") * 104729
    play = F.array(*(white_id((start + o) % F.col("np") + 1) for o in OFFSETS))
    pick = F.get("play", (F.col("user_id") % 5).cast("int"))
    kind = F.col("n") % 17
    answer = (
        F.when(kind == 0, "I would rather not choose.")
        .when(kind == 1, F.concat(F.lit("ID: "), pick, F.lit(" or maybe\n"), pick))
        .when(kind == 2, "API_ERROR: TimeoutError: timed out")
        .when(kind == 3, "ID: W999999999999")
        .when(kind == 4, F.concat(F.lit("id "), F.lower(pick)))
        .otherwise(F.concat(F.lit("ID: "), pick))
    )
    third = F.floor(F.col("g") / 3) % 3
    return parts.withColumn("play", play).select(
        "n",
        F.concat(F.lit("games_"), F.col("cn"), F.lit("_configurations")).alias("config"),
        (F.col("h") % ROUNDS + 1).cast("int").alias("iteration"),
        F.when(F.col("cn") % 4 == 3, "IT").otherwise("EN").alias("lang"),
        F.concat(F.lit("model:"), F.col("g") % 3).alias("model"),
        F.when(third == 0, 0.2).when(third == 1, 0.5).otherwise(0.8).alias("temperature"),
        F.concat(F.lit("B"), F.col("bn") + 1).alias("black_id"),
        "play",
        answer.alias("response"),
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.classify_answers(responses(spark, sf_dir), cards(spark, sf_dir), ID_PATTERN)


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good answers, straight from the split."""
    return classified(spark, sf_dir).where("bucket = 'good'").drop("bucket", "response", "n")


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good answers as the next stage reads them."""
    return written(spark, sf_dir, "winners", good)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all offered cards as the scoring stage reads them."""
    return written(
        spark, sf_dir, "sentences", lambda s, d: answers.all_combinations(winners(s, d), cards(s, d))
    )


def with_scores(options: DataFrame) -> DataFrame:
    """Made-up scores from ids and settings, some of them missing (NaN)."""
    # columns of their own, so that each number is looked for once a row
    numbered = options.withColumns({f"_{c}": text.id_number(c) for c in ("white_id", "black_id", "model")})
    w, b = F.col("_white_id"), F.col("_black_id")
    setting = F.col("iteration") * 373 + F.col("_model") * 131 + F.round(F.col("temperature") * 10).cast("bigint") * 57
    gap = w + b + F.col("iteration")
    toxicity = (w * 7919 + b * 104729 + setting + 17) % 1001 / F.lit(1000.0)
    severe = (w * 6101 + b * 3571 + setting + 5) % 1001 / F.lit(1000.0)
    scored = numbered.withColumns(
        {
            "toxicity": F.when(gap % 29 == 0, F.lit(float("nan"))).otherwise(toxicity),
            "severe_toxicity": F.when(gap % 31 == 0, F.lit(float("nan"))).otherwise(severe),
            "obscene": (w * 31 + b * 17) % 101 / F.lit(100.0),
        }
    )
    return scored.drop("_white_id", "_black_id", "_model")


def combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offered cards of the good answers with made-up scores, as the analysis reads them."""
    return written(spark, sf_dir, "combos", build_combos)


def build_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(winners(spark, sf_dir).select("*", F.posexplode("play").alias("pos", "white_id")))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct games behind the answers."""
    games = responses(spark, sf_dir).select("config", "lang", "black_id", "play").distinct()
    return games.withColumn("play_no", text.id_number("black_id"))


def wide_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with one column per option, some options empty."""
    def option(i: int) -> Column:
        card = F.get("play", F.lit(i))
        empty = text.id_number(card) % 7 == 0
        return F.when(~(empty | (F.lit(i > 0) & (F.col("play_no") % 11 == 0))), card).alias(f"white_id_{i + 1}")

    return plays(spark, sf_dir).select("config", "lang", "play_no", "black_id", *(option(i) for i in range(5)))


def long_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per offered card with the digits of both ids."""
    return plays(spark, sf_dir).select("config", "lang", "black_id", F.posexplode("play").alias("pos", "white_id")).withColumns(
        {"white_num": text.id_number("white_id"), "black_num": text.id_number("black_id")}
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they lie in a text file, every thirteenth broken in one of five ways."""
    kind = F.when(F.col("n") % 13 == 0, F.floor(F.col("n") / 13) % 5).otherwise(F.lit(-1))
    literal = F.concat(F.lit("['"), F.array_join("play", "', '"), F.lit("']"))
    return responses(spark, sf_dir).select(
        F.col("n").alias("_row"),
        "config",
        F.when(kind.isin(1, 4), "3.5").otherwise(F.col("iteration").cast("string")).alias("iteration"),
        "lang",
        "model",
        F.when(kind.isin(2, 4), "x").otherwise(F.col("temperature").cast("string")).alias("temperature"),
        F.when(kind != 0, F.col("black_id")).alias("black_id"),
        literal.alias("play"),
        F.when(kind != 3, F.col("response")).alias("response"),
    )


def with_run(df: DataFrame) -> DataFrame:
    """Add prompt_type and run_id: one run per model and temperature."""
    m = text.id_number("model").cast("int")
    t = F.round(F.col("temperature") * 10).cast("int")
    started = F.make_timestamp(F.lit(2025), m + 1, t, F.lit(10), m, t.cast("decimal(8,6)"))
    typed = df.withColumn("prompt_type", F.when(m % 2 == 0, "prompt_player").otherwise("prompt_judge"))
    return typed.withColumn("run_id", text.run_id("prompt_type", started))


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored configuration of each run, one missing, some of them faulty."""
    runs = with_run(responses(spark, sf_dir).select("model", "temperature").distinct())
    m, t = text.id_number("model"), F.round(F.col("temperature") * 10).cast("int")
    description = F.when((m == 1) & (t == 5), F.lit("")).otherwise(
        F.concat(F.lit(', "character_description": "person '), m % 2, F.lit('"'))
    )
    value = F.concat(
        F.lit('{"cards_dir": "./data", "results_dir": '),
        F.when((m == 0) & (t == 2), "7").otherwise('"./results"'),
        F.lit(', "file_type": "csv", "languages": '),
        F.when((m == 0) & (t == 8), "[null]").otherwise('["EN"]'),
        F.lit(', "models": ["'),
        F.col("model"),
        F.lit('"], "temperatures": ['),
        F.col("temperature").cast("string"),
        F.lit('], "rounds": '),
        F.when((m == 2) & (t == 5), "2.5").otherwise("2"),
        F.lit(', "dataset_mode": "'),
        F.when((m == 1) & (t == 2), "some").otherwise("all"),
        F.lit('", "test_num_rows": 2, "prompt_type": "'),
        F.col("prompt_type"),
        F.lit('"'),
        description,
        F.lit("}"),
    )
    return runs.where(~((m == 2) & (t == 8))).select("run_id", value.alias("value"))
