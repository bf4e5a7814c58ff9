"""One query per operator.  Arrays are shown as text and doubles rounded, for comparison with SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import checks
import choicemeter
from checks import dataset as data
from choicemeter.functions import scores, text
from choicemeter.operators import answers, audit, consistency, distribution, reshape, runs, scoring, states, sweep, validation
from choicemeter.operators.lookup import lookup_columns, lookup_join
from choicemeter.plans import report
from choicemeter.session import scratch_dir
from choicemeter.sources import readers, sinks
from choicemeter.sources.contracts import CONTRACTS, RUN_CONFIG

# Functions that run in tasks travel with the job, so that workers need no copy of the repository.
cloudpickle.register_pickle_by_value(checks)
cloudpickle.register_pickle_by_value(choicemeter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CELL = ["config", "lang", "model", "temperature", "black_id"]
ROW = [*CELL[:4], "iteration", "black_id"]
Query = Callable[[SparkSession, str], DataFrame]


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def joined(name: str, alias: str | None = None) -> Column:
    return F.array_join(name, ",").alias(alias or name)


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and arrays joined."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType) and field.name != "temperature":
            column = F.round(column, digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- text functions -----------------------------------------------------------------


@query
def extract_ids(spark, sf):
    rows = data.responses(spark, sf)
    return rows.select(
        "n",
        joined_ids(text.extract_ids("response")).alias("short_ids"),
        joined_ids(text.extract_ids("response", data.ID_PATTERN)).alias("ids"),
    )


def joined_ids(ids: Column) -> Column:
    return F.array_join(ids, ",")


@query
def blank_count(spark, sf):
    return data.cards(spark, sf).select("lang", "color", "card_id", text.blank_count("card_text").alias("blanks"))


@query
def fill_template(spark, sf):
    rows = data.responses(spark, sf).select("n", "black_id", "play")
    filled = lookup_join(rows, data.black(spark, sf).withColumnRenamed("card_id", "black_id"), ["black_id"])
    one = text.fill_template("card_text", F.slice("play", 1, 1))
    return filled.select("n", one.alias("one"), text.fill_template("card_text", F.col("play")).alias("all_texts"))


@query
def normalize_card(spark, sf):
    c = data.cards(spark, sf)
    return c.select(
        "lang", "color", "card_id", text.normalize_white("card_text").alias("as_white"), text.normalize_black("card_text").alias("as_black")
    )


@query
def normalize_text(spark, sf):
    turns = data.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.md5(text.normalize_text("text").cast("binary")).alias("norm_md5"))


@query
def parse_list(spark, sf):
    raw = data.raw_rows(spark, sf)
    return raw.select(F.col("_row").alias("n"), F.array_join(text.parse_list("play"), "|").alias("ids"))


@query
def play_key(spark, sf):
    rows = data.winners(spark, sf)
    return rows.select(*ROW, text.play_key("black_id", "winners").alias("play_key"))


@query
def id_number(spark, sf):
    return data.long_plays(spark, sf).select("config", "pos", "white_id", "white_num", "black_num")


@query
def clean_config(spark, sf):
    rows = data.responses(spark, sf)
    return rows.groupBy("config", text.clean_config("config").alias("clean_config")).agg(F.count(F.lit(1)).alias("n"))


@query
def run_id_build(spark, sf):
    return data.with_run(data.responses(spark, sf)).groupBy("run_id", "prompt_type").agg(F.count(F.lit(1)).alias("n"))


@query
def run_id_extract(spark, sf):
    rows = data.with_run(data.responses(spark, sf))
    name = F.when(F.col("n") % 19 == 0, "winners_without_run").otherwise(F.concat(F.lit("winners_detoxify_"), F.col("run_id"), F.lit(".csv")))
    found = rows.select(text.run_id_from_name(name).alias("run_id"))
    started = F.date_format(text.run_started("run_id"), "yyyy-MM-dd HH:mm:ss").alias("started")
    return found.groupBy("run_id", started).agg(F.count(F.lit(1)).alias("n"))


@query
def score_input(spark, sf):
    turns = data.table(spark, sf, "conversations")
    blanked = F.when(F.col("turn") % 5 == 1, F.lit(" \n ")).when(F.col("turn") % 5 != 2, F.col("text"))
    return turns.select("conv_id", "turn", F.md5(text.score_input(blanked).cast("binary")).alias("input_md5"))


# --- score functions -----------------------------------------------------------------


@query
def numeric_coerce(spark, sf):
    rows = data.combos(spark, sf)
    kind = (text.id_number("white_id") + F.col("iteration")) % 8
    raw = (
        F.when(kind == 0, "n/a").when(kind == 1, "NaN").when(kind == 2, F.lit("")).when(kind == 3, F.concat(F.lit(" "), F.col("obscene").cast("string"), F.lit(" ")))
        .when(kind == 5, F.concat(F.col("obscene").cast("string"), F.lit("d"))).when(kind == 6, "0x1p3").when(kind == 7, "+1.25E2")
        .otherwise(F.col("obscene").cast("string"))
    )
    return shown(validation.numeric_columns(rows.select(*ROW, "pos", raw.alias("value")), ["value"]))


@query
def clip_score(spark, sf):
    wide = data.combos(spark, sf).withColumn("value", F.col("toxicity") * 1.4 - 0.2)
    return shown(wide.select(*ROW, "pos", scores.clip_score("value").alias("clipped")))


@query
def threshold_flags(spark, sf):
    rows = data.combos(spark, sf)
    return rows.select(*ROW, "pos", *scores.flag_columns("severe_toxicity"))


# --- answers -------------------------------------------------------------------------


@query
def split_no_id(spark, sf):
    _, no_id, _ = answers.split_answers(data.responses(spark, sf), data.cards(spark, sf), data.ID_PATTERN)
    return no_id.select("n", *ROW, joined("play"), "response")


@query
def split_mismatch(spark, sf):
    _, _, mismatch = answers.split_answers(data.responses(spark, sf), data.cards(spark, sf), data.ID_PATTERN)
    return mismatch.select("n", *ROW, joined("play"), joined("winners"))


@query
def split_good(spark, sf):
    good, _, _ = answers.split_answers(data.responses(spark, sf), data.cards(spark, sf), data.ID_PATTERN)
    return good.select("n", *ROW, joined("play"), joined("winners"))


@query
def split_counts(spark, sf):
    return answers.bucket_counts(data.classified(spark, sf))


@query
def build_winner_sentence(spark, sf):
    built = answers.winner_sentences(data.winners(spark, sf), data.cards(spark, sf))
    return answers.with_sentence_reason(built).select(*ROW, joined("winners"), "sentence", "reason")


@query
def all_combinations(spark, sf):
    built = answers.all_combinations(data.winners(spark, sf), data.cards(spark, sf))
    return built.select(*ROW, joined("winners"), "pos", "white_id", "sentence")


# --- consistency ---------------------------------------------------------------------


@query
def mer(spark, sf):
    return shown(consistency.majority_election_rate(data.winners(spark, sf)))


@query
def mer_chart(spark, sf):
    return shown(consistency.mer_chart(consistency.majority_election_rate(data.winners(spark, sf))))


@query
def card_victories(spark, sf):
    return consistency.card_victories(data.winners(spark, sf))


@query
def card_appearances(spark, sf):
    return consistency.card_appearances(data.winners(spark, sf))


@query
def success_rate(spark, sf):
    return shown(consistency.success_rate(data.winners(spark, sf)))


@query
def top_success(spark, sf):
    return shown(consistency.top_success(consistency.success_rate(data.winners(spark, sf))))


@query
def winner_status(spark, sf):
    return consistency.with_status(data.combos(spark, sf)).select(*ROW, "pos", "white_id", "winner_id", "status")


@query
def winner_vs_options(spark, sf):
    return shown(consistency.winner_vs_options(data.combos(spark, sf)))


@query
def pattern_toxicity(spark, sf):
    return consistency.toxicity_pattern(consistency.winner_vs_options(data.combos(spark, sf)), "toxicity")


@query
def pattern_severe(spark, sf):
    return consistency.toxicity_pattern(consistency.winner_vs_options(data.combos(spark, sf)), "severe_toxicity")


# --- distributions -------------------------------------------------------------------


@query
def toxicity_by_temperature(spark, sf):
    return shown(distribution.toxicity_by_temperature(data.combos(spark, sf)))


@query
def tail_rate_temperature(spark, sf):
    return shown(distribution.tail_rate(data.combos(spark, sf), ["model", "temperature"]))


@query
def tail_rate_config(spark, sf):
    return shown(distribution.tail_rate_by_config(data.combos(spark, sf)))


@query
def attribute_profile(spark, sf):
    return shown(distribution.attribute_profile(data.combos(spark, sf)))


@query
def language_risk(spark, sf):
    return distribution.language_risk(data.combos(spark, sf))


@query
def score_histogram_model(spark, sf):
    return shown(distribution.score_histogram(data.combos(spark, sf), ["model"]))


@query
def score_density_model(spark, sf):
    return shown(distribution.score_density(data.combos(spark, sf), ["model"]))


@query
def config_density(spark, sf):
    return shown(distribution.score_density(distribution.with_clean_config(data.combos(spark, sf)), ["clean_config"]))


@query
def config_model_density(spark, sf):
    return shown(distribution.score_density(distribution.with_clean_config(data.combos(spark, sf)), ["clean_config", "model"]))


@query
def config_distribution(spark, sf):
    return shown(distribution.config_distribution(data.combos(spark, sf)))


@query
def config_model_distribution(spark, sf):
    return shown(distribution.config_distribution(data.combos(spark, sf), by_model=True))


@query
def config_model_matrix(spark, sf):
    return shown(distribution.config_model_matrix(data.combos(spark, sf), data.MODELS))


@query
def top_black_matrix(spark, sf):
    return shown(distribution.top_black_matrix(data.combos(spark, sf), 30, data.MODELS))


@query
def top_play_matrix(spark, sf):
    return shown(distribution.top_play_matrix(data.combos(spark, sf), 30, data.MODELS))


@query
def stability(spark, sf):
    return shown(distribution.stability(data.combos(spark, sf)))


@query
def top_unstable(spark, sf):
    return shown(distribution.top_unstable(distribution.stability(data.combos(spark, sf))))


@query
def grouped_moments(spark, sf):
    return shown(distribution.grouped_moments(data.combos(spark, sf)))


@query
def run_report(spark, sf):
    """Every figure of every chart table of one report, by chart, key and name."""
    found = []
    for chart, table in report.run_report(data.combos(spark, sf), models=data.MODELS).items():
        keys = [c for c, kind in table.dtypes if kind == "string" or c in ("temperature", "bin", "point")]
        figures = [F.round(F.col(f"`{c}`").cast("double"), 6).alias(c) for c in table.columns if c not in keys]
        wide = table.select(F.concat_ws("|", *keys).alias("key"), *figures)
        names = [F.col(f"`{c}`") for c in wide.columns[1:]]
        long = wide.unpivot(["key"], names, "name", "value").where("value is not null")
        found.append(long.select(F.lit(chart).alias("chart"), "key", F.regexp_replace("name", "`", "").alias("name"), (F.col("value") + F.lit(0.0)).alias("value")))
    return reduce(DataFrame.unionByName, found)


@query
def language_risk_sketch(spark, sf):
    """Whether each quantile of the sketches has a rank within one percent of the one asked for."""
    wanted = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    rows = data.combos(spark, sf)
    points = states.approximate_quantiles(rows, ["lang", "model"], wanted)
    value = scores.to_score("toxicity")
    both = rows.where(value.isNotNull()).select("lang", "model", value.alias("v")).join(points.select("lang", "model", "n", *wanted), ["lang", "model"])
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    near = [((share(F.col("v") < F.col(c)) <= p + 0.01) & (share(F.col("v") <= F.col(c)) >= p - 0.01)).alias(c) for c, p in wanted.items()]
    return both.groupBy("lang", "model").agg(F.max("n").alias("n"), *near)


@query
def states_merged(spark, sf):
    """States of each run and key, written apart, read back and merged."""
    root = scratch_dir(spark, "states")
    rows = data.with_run(data.combos(spark, sf))
    for m in data.MODELS:
        sinks.write_states(rows.where(F.col("model") == m), root, f"run_{m}", "combinations", "detoxify")
    kept = sinks.read_parts(spark, f"{root}/score_states", kind="combinations").where("attribute = 'toxicity'")
    merged = states.described(states.merge_states(kept, ["clean_config"]))
    return shown(merged.drop("attribute", "band"))


@query
def states_attributes(spark, sf):
    kept = states.score_states(distribution.with_clean_config(data.combos(spark, sf)), states.STATE_KEYS, ["toxicity", "severe_toxicity", "obscene"])
    return shown(states.attribute_means(kept, ["toxicity", "severe_toxicity", "obscene"]))


# --- sweep ---------------------------------------------------------------------------


def games(spark, sf):
    return reshape.games_from_wide(data.wide_games(spark, sf))


@query
def sweep_matrix(spark, sf):
    matrix = sweep.sweep_matrix(games(spark, sf), ["m:a", "m:b"], [0.5, 0.8], 2)
    return matrix.select("config", "lang", "play_no", "black_id", "model", "temperature", "iteration")


@query
def sweep_size(spark, sf):
    return sweep.sweep_size(sweep.sweep_matrix(games(spark, sf), ["m:a", "m:b"], [0.5, 0.8], 2))


@query
def test_subset(spark, sf):
    return sweep.test_subset(games(spark, sf), 2).select("config", "lang", "play_no", "black_id")


@query
def prompt_options(spark, sf):
    plays = sweep.play_options(games(spark, sf), data.cards(spark, sf))
    usable = F.col("reason").isNull()
    return plays.select(
        "config", "lang", "play_no", F.when(usable, F.col("options")).alias("options"), F.when(usable, F.col("black_text")).alias("black_text"), "reason"
    )


@query
def render_prompt(spark, sf):
    whole = data.plays(spark, sf).withColumnRenamed("play", "white_ids")
    plays = sweep.play_options(whole, data.cards(spark, sf))
    prompts = sweep.render_prompts(plays, "prompt_player", "A {black_card_text} fan.")
    return prompts.select("config", "lang", "play_no", "prompt", "reason")


def _respond(prompt: str, model: str, temperature: float) -> str:
    if model == "m:b" and temperature > 0.6:
        raise TimeoutError("timed out")
    return "ID: " + re.search(r"ID:(W[0-9]+) TEXT", prompt).group(1)


@query
def batch_respond(spark, sf):
    whole = data.plays(spark, sf).withColumnRenamed("play", "white_ids")
    prompts, _ = sweep.plan_prompts(whole, data.cards(spark, sf), ["m:a", "m:b"], [0.5, 0.8], 2, "prompt_judge", "A critic.")
    answered = sweep.batch_respond(prompts, _respond)
    return answered.select(*ROW, joined("play"), "response")


# --- scoring -------------------------------------------------------------------------


@query
def score_lexicon(spark, sf):
    docs = data.table(spark, sf, "documents")
    return shown(docs.select("doc_id", scoring.lexicon_score(text.score_input("text")).alias("toxicity")))


LEXICONS = {"toxicity": scoring.LEXICON, "severe_toxicity": ("scum", "disgusting", "trash", "idiot"), "mood": ("clown",)}


@query
def attach_scores(spark, sf):
    docs = data.table(spark, sf, "documents").select("doc_id", "text")
    scored = scoring.add_scores(docs, "text", scoring.lexicon_scorer(LEXICONS, 0.3), list(LEXICONS))
    return shown(scored.drop("text"))


@query
def score_sentences(spark, sf):
    """Every offered option's sentence, each distinct one scored once."""
    scored = scoring.add_scores(data.sentences(spark, sf), "sentence", scoring.lexicon_scorer(), ["toxicity"])
    return shown(scored.select(*ROW, "pos", "toxicity"))


@query
def flatten_scores(spark, sf):
    rows = data.combos(spark, sf)
    failed = (text.id_number("white_id") + F.col("iteration")) % 17 == 0
    number = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c).cast("string")), F.lit("null"))
    reply = F.concat(
        F.lit('{"attributeScores": {"TOXICITY": {"summaryScore": {"value": '),
        number("toxicity"),
        F.lit(', "type": "PROBABILITY"}}, "SEVERE_TOXICITY": {"summaryScore": {"value": '),
        number("severe_toxicity"),
        F.lit('}}}, "languages": ["en"]}'),
    )
    replies = rows.select(*ROW, "pos", F.when(failed, '{"error": "HttpError 400"}').otherwise(reply).alias("reply"))
    return shown(scoring.flatten_scores(replies, ["toxicity", "severe_toxicity", "threat"]).drop("reply"))


class _Refused(Exception):
    status = 400


def _call(content: str) -> dict:
    if len(content) % 17 == 0:
        raise _Refused("refused")
    value = len(content) % 100 / 100
    return {"attributeScores": {"TOXICITY": {"summaryScore": {"value": value}}}}


@query
def batch_score_json(spark, sf):
    docs = data.table(spark, sf, "documents")
    replies = scoring.batch_score_json(docs, "text", _call)
    flat = scoring.flatten_scores(replies, ["toxicity"])
    return shown(flat.select(F.md5(F.col("original_text").cast("binary")).alias("text_md5"), "error", "toxicity"))


def _load_length_model():
    return lambda texts: {"toxicity": [len(t) % 50 / 40 for t in texts], "sexual_explicit": [len(t) % 7 / 10 for t in texts]}


@query
def score_model(spark, sf):
    """A plugged-in model: batches, renamed label, clipping."""
    docs = data.table(spark, sf, "documents").select("doc_id", "text")
    labels = ["toxicity", "sexual_explicit"]
    return shown(scoring.add_scores(docs, "text", scoring.model_scorer(_load_length_model, labels), labels).drop("text"))


@query
def score_trained(spark, sf):
    docs = data.table(spark, sf, "documents").select("doc_id", "text")
    labels = data.table(spark, sf, "labels").select("doc_id", "toxic")
    model = scoring.train_scorer(docs.join(labels, "doc_id"))
    scored = scoring.trained_scores(model, docs)
    idf = model.stages[2]
    # what SQL can tell: every document has a score, and the number of documents the model was fitted on
    return scored.select("doc_id", F.col("toxicity").between(0, 1).alias("in_range"), F.lit(idf.numDocs).cast("bigint").alias("fitted_on"))


# --- validation ----------------------------------------------------------------------


def checked_rows(spark, sf):
    return validation.check_rows(data.raw_rows(spark, sf), CONTRACTS["raw_responses"])


@query
def validate_clean(spark, sf):
    rows = validation.clean_nan(data.combos(spark, sf))
    return shown(rows.select(*ROW, "pos", "toxicity", "severe_toxicity"))


@query
def validate_split(spark, sf):
    valid, _ = validation.split_valid(data.raw_rows(spark, sf), CONTRACTS["raw_responses"])
    return valid.select(F.col("_row").alias("n"), *CONTRACTS["raw_responses"].names)


@query
def validate_errors(spark, sf):
    _, rejects = validation.split_valid(data.raw_rows(spark, sf), CONTRACTS["raw_responses"])
    return validation.row_messages(rejects).select(F.col("_row").alias("n"), "message")


@query
def validate_status(spark, sf):
    return validation.validation_status(checked_rows(spark, sf))


@query
def validate_min_options(spark, sf):
    wide = data.wide_games(spark, sf).drop("config").withColumnRenamed("play_no", "_play_no")
    valid, rejects = validation.split_valid(wide, CONTRACTS["games"])
    kept = valid.select("lang", F.col("_play_no").alias("play_no"), F.lit("valid").alias("part"), F.lit("").alias("errors"))
    thrown = rejects.select(F.get_json_object("raw", "$.lang").alias("lang"), F.col("_play_no").alias("play_no"), F.lit("reject").alias("part"), joined("errors"))
    return kept.unionByName(thrown)


@query
def drop_empty_columns(spark, sf):
    rows = data.combos(spark, sf).select(*ROW, "pos", "toxicity", F.lit(float("nan")).alias("threat"), F.lit(None).cast("double").alias("profanity"))
    return shown(validation.drop_empty_columns(rows))


# --- sources and sinks ---------------------------------------------------------------


def _raw_csv(spark, sf) -> str:
    path = f"{scratch_dir(spark, 'responses')}/raw_responses"
    data.raw_rows(spark, sf).drop("_row").write.options(header=True, escape='"').csv(path)
    return path


@query
def load_validated(spark, sf):
    valid, _ = readers.load_validated(spark, _raw_csv(spark, sf), "csv")
    return valid


@query
def scan_csv(spark, sf):
    return readers.scan_csv(spark, _raw_csv(spark, sf)).drop("_path")


@query
def scan_dir_tagged(spark, sf):
    folder = f"{scratch_dir(spark, 'games')}/games_config"
    sinks.write_partitioned(data.wide_games(spark, sf), folder, ["config"], "csv")
    return readers.scan_tagged(spark, folder, "csv", tag="config")


@query
def scan_mixed_headers(spark, sf):
    """Files with five options, and files with two of them in another order, in one folder."""
    folder = f"{scratch_dir(spark, 'games')}/games_config"
    wide = data.wide_games(spark, sf)
    for kind, part in (
        ("a", wide.where("play_no % 2 = 0")),
        ("b", wide.where("play_no % 2 = 1").select("white_id_2", "lang", "black_id", "config", "play_no", "white_id_1")),
    ):
        part.write.options(header=True).csv(f"{folder}/kind={kind}")
    return readers.scan_tagged(spark, folder, "csv", tag="kind")


@query
def cards_by_header(spark, sf):
    folder = scratch_dir(spark, "cards")
    for lang in ("EN", "IT"):
        cards = data.cards(spark, sf).where(F.col("lang") == lang)
        cards.where("color = 'BLACK'").select("card_id", "card_text").write.options(header=True, escape='"').csv(f"{folder}/{lang}/cards_texts/black_cards.csv")
        white = cards.where("color = 'WHITE'").select(F.lit("x").alias("note"), "card_text", "card_id")
        white.write.options(header=True, escape='"').csv(f"{folder}/{lang}/cards_texts/white_cards.csv")
    return readers.read_cards(spark, folder, ["EN", "IT"])[0]


@query
def prompts_from_parts(spark, sf):
    """Games of part files: a play's number starts anew in each of them."""
    folder = scratch_dir(spark, "cards")
    wide = data.wide_games(spark, sf).drop("play_no")
    for lang in ("EN", "IT"):
        own = wide.where(F.col("lang") == lang).repartition(3)
        own.write.option("maxRecordsPerFile", 40).partitionBy("config").parquet(f"{folder}/{lang}/games_config")
    found, _ = readers.read_games(spark, folder, ["EN", "IT"], "prompt_player", "parquet")
    plays = sweep.play_options(found, data.cards(spark, sf))
    usable = F.col("reason").isNull()
    return plays.select("config", "lang", "black_id", F.when(usable, F.col("options")).alias("options"), "reason")


@query
def load_rejects(spark, sf):
    """Rejected rows of text files, each with its place in its file."""
    folder = f"{scratch_dir(spark, 'responses')}/raw_responses"
    data.raw_rows(spark, sf).withColumnRenamed("_row", "_n").write.options(header=True, escape='"').csv(folder)
    _, rejects = readers.load_validated(spark, folder, "csv")
    return rejects.select(
        F.col("_n").cast("bigint").alias("n"), F.regexp_replace("message", "^Fila [0-9]+", "Fila").alias("message"), F.col("_row").isNotNull().alias("numbered")
    )


@query
def load_faults(spark, sf):
    """Card files with surplus and missing cells, quoted line ends, and a last row whose quote is never closed: all rows, read back."""
    rows = data.responses(spark, sf).select("n", "model", "lang")
    kind, quoted = F.col("n") % 11, F.concat(F.lit('"'), F.col("model"), F.lit(' ""'), F.col("lang"), F.lit('"", '), F.col("n"), F.lit('"'))
    card = F.concat(F.lit("W"), F.col("n"))
    line = (
        F.when(kind == 3, F.concat(card, F.lit(","), quoted, F.lit(",surplus")))
        .when(kind == 5, card)
        .when(kind == 7, F.concat(card, F.lit(","), F.replace(quoted, F.lit(", "), F.lit(",\n"))))
        .otherwise(F.concat(card, F.lit(","), quoted))
    )
    parts = rows.select((F.col("n") % 3).alias("part"), "n", line.alias("line")).groupBy("part")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    files = parts.agg(F.concat(F.lit("card_id,card_text\n"), whole, F.lit('\nW0,"open\nW1,x')).alias("value"))
    folder = f"{scratch_dir(spark, 'cards')}/cards"
    files.write.partitionBy("part").text(folder)
    valid, rejects = readers.load_validated(spark, folder, "csv")
    kept = valid.select("card_id", "card_text", F.lit(None).cast("string").alias("message"))
    return kept.union(rejects.select(F.lit(None).cast("string"), "raw", "message"))


@query
def attribute_profile_runs(spark, sf):
    """Scores of two classifiers with other attributes each, written and read back as one table."""
    root = scratch_dir(spark, "scores")
    rows = data.combos(spark, sf)
    number = text.id_number("white_id") * 13 + text.id_number("black_id") * 7
    other = rows.drop("obscene", "severe_toxicity").withColumn("profanity", number % 97 / F.lit(100.0))
    sinks.write_scores(rows, root, "run_a", "combinations", "detoxify")
    sinks.write_scores(other, root, "run_a", "combinations", "perspective")
    scored = sinks.read_parts(spark, f"{root}/scored_combinations")
    parts = [
        distribution.attribute_profile(scored.where(F.col("classifier") == c)).withColumn("classifier", F.lit(c)) for c in ("detoxify", "perspective")
    ]
    return shown(parts[0].unionByName(parts[1]))


def scored_files(spark, sf) -> DataFrame:
    """Scored options of all runs, written and read back with the name of their file."""
    folder = f"{scratch_dir(spark, 'analysis')}/analysis_module"
    rows = data.with_run(data.combos(spark, sf))
    chosen = F.col("white_id") == text.first_id("winners")
    kinds = rows.withColumn("kind", F.explode(F.when(chosen, F.array(F.lit("winners"), F.lit("combinations"))).otherwise(F.array(F.lit("combinations")))))
    named = kinds.withColumn("name", F.concat("kind", F.lit("_detoxify_scores_"), "run_id")).drop("kind", "run_id", "prompt_type")
    sinks.write_partitioned(named, folder, ["name"])
    return readers.scan_runs(spark, folder)


@query
def route_runs(spark, sf):
    routed = scored_files(spark, sf).groupBy("name", "role", "kind", "classifier", "run_id")
    return shown(routed.agg(F.count(F.lit(1)).alias("rows"), F.avg(scores.to_score("toxicity")).alias("mean")))


def manifest(spark, sf) -> DataFrame:
    folder = f"{scratch_dir(spark, 'runs')}/results"
    sinks.write_manifest(data.run_configs(spark, sf), folder)
    return readers.read_manifest(spark, f"{folder}/*")


@query
def run_manifest(spark, sf):
    return readers.run_attributes(manifest(spark, sf))


@query
def config_contract(spark, sf):
    return readers.check_configs(manifest(spark, sf), RUN_CONFIG).select("run_id", F.array_join("errors", "; ").alias("errors"))


@query
def sink_roundtrip(spark, sf):
    """Write every table of one stage, read it back and count its rows."""
    root = scratch_dir(spark, "stage")
    good, no_id, mismatch = answers.split_answers(data.responses(spark, sf), data.cards(spark, sf), data.ID_PATTERN)
    sinks.write_responses(data.responses(spark, sf), root, "run_a")
    sinks.write_rejects(no_id, root, "run_a", "no_id")
    sinks.write_rejects(mismatch, root, "run_a", "mismatch")
    sinks.write_sentences(answers.winner_sentences(good, data.cards(spark, sf)), root, "run_a", "winners")
    sinks.write_sentences(answers.all_combinations(good, data.cards(spark, sf)), root, "run_a", "combinations")
    sinks.write_scores(data.combos(spark, sf), root, "run_a", "combinations", "detoxify")
    names = ["raw_responses", "rejects_no_id", "rejects_mismatch", "winners", "combinations", "scored_combinations"]
    parts = [
        sinks.read_parts(spark, f"{root}/{name}").groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "run_id", "rows")
        for name in names
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def compared(spark, sf) -> DataFrame:
    winners = scored_files(spark, sf).where(F.col("kind") == "winners")
    return runs.judge_comparison(winners, readers.run_attributes(manifest(spark, sf)))


@query
def judge_comparison(spark, sf):
    return shown(compared(spark, sf))


@query
def judge_comparison_empty_run(spark, sf):
    """A run that was scored and has no rows counts with mean 0."""
    winners = scored_files(spark, sf).where(F.col("kind") == "winners")
    files = winners.select("run_id", "role", "classifier").distinct()
    some = winners.where(~F.col("model").isin("model:2"))
    return shown(runs.judge_comparison(some, readers.run_attributes(manifest(spark, sf)), files))


@query
def judge_comparison_long(spark, sf):
    return shown(reshape.melt_means(compared(spark, sf)))


# --- input audit ---------------------------------------------------------------------


@query
def melt_games(spark, sf):
    return reshape.melt_games(data.wide_games(spark, sf), ["config", "lang", "black_id"])


@query
def long_to_games(spark, sf):
    """Toxic sets hold one language's templates; those with more rows than slots are set aside."""
    rows = data.long_plays(spark, sf).withColumn("ordinal", F.struct("config", "pos"))
    wanted, rejects = reshape.long_to_games(rows, 5)
    slots = [f"white_id_{i}" for i in range(1, 6)]
    return wanted.withColumn("n", F.lit(5).cast("bigint")).withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejects.select("black_id", *(F.lit(None).cast("string").alias(s) for s in slots), "n", "reason")
    )


@query
def long_to_games_sets(spark, sf):
    """Each set's template as its own group: all of them fit."""
    rows = data.long_plays(spark, sf).select(
        F.concat_ws("/", "config", "black_id").alias("black_id"), "white_id", F.col("pos").alias("ordinal")
    )
    return reshape.long_to_games(rows, 5)[0]


def app_plays(spark, sf):
    """Plays as exported by an app: texts, some players without an answer."""
    texts = data.white(spark, sf).select("card_id", F.concat(F.lit("  "), F.upper("card_text"), F.lit(" ")).alias("white"))
    rows = lookup_columns(data.wide_games(spark, sf), texts, "card_id", "white", {f"white_id_{i}": f"white_{i}" for i in range(1, 6)})
    rows = lookup_join(rows, data.black(spark, sf).select(F.col("card_id").alias("black_id"), F.concat(F.lit(" "), "card_text", F.lit(" ;")).alias("black")), ["black_id"])
    return rows.select("config", "lang", "play_no", "black", *(f"white_{i}" for i in range(1, 6)))


WHITE_TEXTS = [f"white_{i}" for i in range(1, 6)]


@query
def compact_columns(spark, sf):
    kept, rejects = reshape.compact_columns(app_plays(spark, sf), WHITE_TEXTS)
    none = F.lit(None).cast("string")
    return kept.withColumn("reason", none).drop("black").unionByName(
        rejects.select("config", "lang", "play_no", *(none.alias(c) for c in WHITE_TEXTS[:-1]), "reason")
    )


@query
def resolve_black_ids(spark, sf):
    rows = app_plays(spark, sf).select("config", "lang", "play_no", "black")
    return reshape.resolve_texts(rows, data.black(spark, sf), {"black": "black_id"})


@query
def resolve_white_ids(spark, sf):
    kept, _ = reshape.compact_columns(app_plays(spark, sf).drop("black"), WHITE_TEXTS)
    return reshape.resolve_texts(kept, data.white(spark, sf), {c: c.replace("white_", "white_id_") for c in WHITE_TEXTS[:-1]})


def phrases(spark, sf):
    """A toxic set: every offered pair with its full phrase, some phrases about something else."""
    rows = data.long_plays(spark, sf)
    rows = lookup_join(rows, data.black(spark, sf).select(F.col("card_id").alias("black_id"), F.col("card_text").alias("bt")), ["black_id"])
    rows = lookup_join(rows, data.white(spark, sf).select(F.col("card_id").alias("white_id"), F.col("card_text").alias("wt")), ["white_id"])
    phrase = text.fill_template("bt", F.array(F.lower("wt")))
    label = F.concat(F.lit("label "), F.col("white_num") % 3)
    return rows.select(
        "config", "black_id", "white_id", F.when(F.col("white_num") % 19 != 0, phrase).otherwise("something else").alias("full_phrase"), label.alias("toxicity_label")
    )


def phrase_table(spark, sf):
    return reshape.phrase_texts(phrases(spark, sf), data.white(spark, sf), data.black(spark, sf))


@query
def phrase_texts(spark, sf):
    return phrase_table(spark, sf)


@query
def phrase_violations(spark, sf):
    return reshape.phrase_violations(phrase_table(spark, sf))


@query
def phrase_containment(spark, sf):
    return reshape.phrase_containment(phrase_table(spark, sf))


@query
def describe_text(spark, sf):
    return audit.describe_text(phrases(spark, sf), ["black_id", "white_id", "full_phrase", "toxicity_label"])


@query
def describe_frequent(spark, sf):
    """The same from sketches, and whether the number of distinct values is within four deviations."""
    columns = ["black_id", "white_id", "full_phrase", "toxicity_label"]
    rows = phrases(spark, sf)
    found = audit.describe_frequent(rows, columns)
    exact = audit.describe_text(rows, columns).select("column", F.col("unique").alias("exact"))
    near = F.abs(F.col("unique") - F.col("exact")) <= 4 * audit.UNIQUE_ERROR * F.col("exact")
    return found.join(exact, "column").select("column", "count", near.alias("unique_near"), "top", "freq", "settled")


@query
def audit_blank_count(spark, sf):
    return audit.audit_blank_count(data.black(spark, sf))


@query
def audit_group_size(spark, sf):
    rows = data.long_plays(spark, sf).withColumn("black_id", F.concat_ws("/", "config", "black_id"))
    return audit.audit_group_size(rows)


@query
def cards_used(spark, sf):
    return audit.cards_used(data.white(spark, sf), data.long_plays(spark, sf))


def frequencies(spark, sf):
    ids = data.table(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    return audit.frequency_zero_filled(data.long_plays(spark, sf), ids)


@query
def frequency_zero_filled(spark, sf):
    return frequencies(spark, sf)


@query
def chi_square_uniform(spark, sf):
    ids = data.table(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    return shown(audit.chi_square_uniform(data.long_plays(spark, sf), ids))


@query
def id_correlation(spark, sf):
    return shown(audit.id_correlation(data.long_plays(spark, sf)))
