import pytest
from pyspark.sql import functions as F

from choicemeter.operators import answers
from tests.frames import frame

CARDS = [
    ("EN", "BLACK", "B1", "I like ____. "),
    ("EN", "BLACK", "B2", "__ and ____!"),
    ("EN", "BLACK", "B3", "no blank"),
    ("EN", "BLACK", "B4", "doubled __"),
    ("EN", "BLACK", "B4", "doubled again __"),
    ("EN", "WHITE", "W001", " A Cat. "),
    ("EN", "WHITE", "W002", "The $1 dog!;"),
    ("EN", "WHITE", "W003", "x ."),
]
RESPONSES = [
    (1, "B1", "ID: W001"),
    (2, "B1", "none"),
    (3, "B1", "W001 W002"),
    (4, "B2", "W001 then W002"),
    (5, "B2", "W001"),
    (6, "B3", "W001"),
    (7, "B4", "W001"),
    (8, "B9", "W001"),
    (9, "B1", "W999"),
    (10, "B1", None),
    (11, "B2", "W002 W002"),
]


@pytest.fixture
def cards(spark):
    return frame(spark, CARDS, "lang string, color string, card_id string, card_text string")


@pytest.fixture
def responses(spark):
    return frame(spark, RESPONSES, "n int, black_id string, response string").select(
        "n", F.lit("c").alias("config"), F.lit(1).alias("iteration"), F.lit("EN").alias("lang"), F.lit("m").alias("model"),
        F.lit(0.5).alias("temperature"), "black_id", F.array(F.lit("W001"), F.lit("W003"), F.lit("W999")).alias("play"), "response",
    )


def buckets(parts):
    return [sorted(r.n for r in p.collect()) for p in parts]


def test_split_is_a_partition(responses, cards):
    parts = answers.split_answers(responses, cards)
    assert buckets(parts) == [[1, 4, 9, 11], [2, 10], [3, 5, 6, 7, 8]]
    good, no_id, mismatch = parts
    assert "response" not in good.columns and "winners" in good.columns
    assert "winners" not in no_id.columns and "response" in no_id.columns
    assert "response" not in mismatch.columns


def test_split_without_broadcast(responses, cards, shuffle_joins):
    assert buckets(answers.split_answers(responses, cards)) == [[1, 4, 9, 11], [2, 10], [3, 5, 6, 7, 8]]


def test_split_without_response_column(responses, cards):
    assert buckets(p.withColumn("n", F.lit(1)) for p in answers.split_answers(responses.drop("response"), cards)) == [[], [], []]


@pytest.mark.parametrize("path", ["broadcast", "shuffle"])
def test_sentences(request, responses, cards, path):
    if path == "shuffle":
        request.getfixturevalue("shuffle_joins")
    good = answers.split_answers(responses, cards)[0]
    built = {r.n: r.sentence for r in answers.winner_sentences(good, cards).collect()}
    assert built == {1: "i like a cat.", 4: "a cat and the $1 dog!", 9: None, 11: "the $1 dog and the $1 dog!"}
    options = {(r.n, r.pos): r.sentence for r in answers.all_combinations(good, cards).collect()}
    assert options[1, 0] == "i like a cat." and options[1, 1] == "i like x ."
    assert options[4, 0] == "a cat and ____!" and options[4, 2] is None
    assert len(options) == 4 * 3


def test_one_lookup_of_cards_for_any_number_of_blanks(spark, responses, cards, shuffle_joins):
    many = cards.union(frame(spark, [("EN", "BLACK", "B5", "__ " * 9)], "lang string, color string, card_id string, card_text string"))
    good = responses.withColumn("winners", F.array(*(F.lit(f"W00{i % 3 + 1}") for i in range(9)))).withColumn("black_id", F.lit("B5"))
    built = answers.winner_sentences(good, many)
    assert {r.sentence for r in built.collect()} == {("a cat the $1 dog x  " * 3).strip()}
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WHITE") <= answers.winner_sentences(responses.withColumn("winners", F.array(F.lit("W001"))), cards)._jdf.queryExecution().optimizedPlan().toString().count("WHITE")
    none = good.withColumn("winners", F.array().cast("array<string>")).limit(1)
    assert answers.winner_sentences(none, many).first().sentence == ("__ " * 9).strip()


def test_result_does_not_depend_on_partitioning(responses, cards):
    few = answers.classify_answers(responses.repartition(1), cards).select("n", "bucket").collect()
    many = answers.classify_answers(responses.repartition(7), cards).select("n", "bucket").collect()
    assert sorted(few) == sorted(many)


def test_no_python_in_the_plan(responses, cards):
    plan = answers.all_combinations(answers.split_answers(responses, cards)[0], cards)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("path", ["broadcast", "shuffle"])
def test_combinations_of_odd_plays(spark, request, cards, path):
    if path == "shuffle":
        request.getfixturevalue("shuffle_joins")
    plays = [["W001", None, "W002"], ["W001", "W002"], ["W001", "W002", None], ["W002", "W001", "W001"], ["W9"], [None], [], None]
    rows = [(n, lang, black, play) for n, (lang, black, play) in enumerate([(g, b, p) for g in ("EN", None) for b in ("B1", "B2", "B3", "B4", None) for p in plays] * 2)]
    good = frame(spark, rows, "n int, lang string, black_id string, play array<string>")
    white, filled = {"W001": "a cat", "W002": "the $1 dog"}, {"B1": "i like {}.", "B2": "{} and ____!", "B3": "no blank"}

    def sentence(lang, black, card):
        return filled[black].format(white[card]) if lang and black in filled and card in white else None

    want = [(n, pos, card, sentence(lang, black, card)) for n, lang, black, play in rows for pos, card in enumerate(play or [])]
    found = answers.all_combinations(good, cards)
    assert found.columns == [*good.columns, "pos", "white_id", "sentence"]
    key = lambda r: (r[0], r[1])
    assert sorted(((r.n, r.pos, r.white_id, r.sentence) for r in found.collect()), key=key) == sorted(want, key=key)


def test_answers_are_not_shuffled_for_few_templates_among_many_cards(spark, responses):
    black = F.col("id") < 3
    many = spark.range(20_000).select(
        F.lit("EN").alias("lang"), F.when(black, "BLACK").otherwise("WHITE").alias("color"),
        F.concat(F.when(black, "B").otherwise("W"), F.col("id")).alias("card_id"), F.when(black, "I like ____.").otherwise("cat").alias("card_text"),
    )
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "10k")
    try:
        found = answers.classify_answers(responses, many)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.n: r.bucket for r in found.collect()}[1] == "good"
        spark.conf.set(key, "-1")
        assert "BroadcastHashJoin" not in answers.classify_answers(responses, many)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_plays_become_rows_behind_the_last_shuffle(spark, cards, shuffle_joins):
    good = spark.range(2000).select("id", F.lit("EN").alias("lang"), F.lit("B1").alias("black_id"), F.array(*(F.lit(f"W00{i}") for i in range(5))).alias("play"))
    found = answers.all_combinations(good, cards)
    assert len(found.collect()) == 10_000
    assert sum(shuffled_rows(found._jdf.queryExecution().executedPlan())) < 4000


def shuffled_rows(plan):
    """Rows that each exchange of a plan that has run wrote."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from shuffled_rows(plan.executedPlan())
        return
    if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
        yield from shuffled_rows(plan.plan())
        return
    if name == "ShuffleExchangeExec":
        yield plan.metrics().apply("shuffleRecordsWritten").value()
    children = plan.children()
    for i in range(children.size()):
        yield from shuffled_rows(children.apply(i))
