import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from choicemeter.functions import prompts, text
from tests.frames import frame


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "answer,ids",
    [
        ("ID: W001", ["W001"]),
        ("W0123 and W001W002", ["W012", "W001", "W002"]),
        ("w001", []),
        ("W001, W001", ["W001", "W001"]),
        ("", []),
        (None, []),
    ],
)
def test_extract_ids(spark, answer, ids):
    df = frame(spark, [(answer,)], "a string")
    assert df.select(text.extract_ids("a")).first()[0] == ids


@pytest.mark.parametrize(
    "template,texts,sentence",
    [
        ("a __ b", ["x"], "a x b"),
        ("a ____ b __", ["x"], "a x b __"),
        ("__ and ___", ["x", "y", "z"], "x and y"),
        ("no blank", ["x"], "no blank"),
        ("a _ b __", ["$1 \\1"], "a _ b $1 \\1"),
        ("__", [""], ""),
    ],
)
def test_fill_template(spark, template, texts, sentence):
    df = frame(spark, [(template, texts)], "t string, x array<string>")
    assert df.select(text.fill_template("t", F.col("x"))).first()[0] == sentence


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(alphabet="a_ .b$", max_size=20), st.lists(st.text(alphabet="x_$\\", max_size=4), max_size=3)), min_size=1, max_size=8))
def test_fill_template_like_a_sequential_replacement(spark, cases):
    def expected(template, texts):
        rest = iter(texts)
        return re.sub("__+", lambda m: next(rest, m.group(0)), template)

    df = frame(spark, [(i, t, x) for i, (t, x) in enumerate(cases)], "i int, t string, x array<string>")
    got = {r[0]: r[1] for r in df.select("i", text.fill_template("t", F.col("x"))).collect()}
    assert got == {i: expected(t, x) for i, (t, x) in enumerate(cases)}


@pytest.mark.parametrize(
    "raw", ["  A Cat.,;! ", "dog .", "\tX!\n", "...", "a. b.", "", "Ünï !"]
)
def test_normalize_white(spark, raw):
    assert one(spark, text.normalize_white("t"), t=raw) == raw.lower().strip().rstrip(".,;!")


@pytest.mark.parametrize("raw", [" A  __ b.\n c ", "A____B!", "x \t y"])
def test_normalize_text(spark, raw):
    expected = re.sub(r"\s+", " ", raw.lower().strip().rstrip(".,;!").replace("__", " "))
    assert one(spark, text.normalize_text("t"), t=raw) == expected


@pytest.mark.parametrize(
    "literal,items",
    [("['W001', 'W002']", ["W001", "W002"]), ('["a\'b"]', ["a'b"]), ("['a\\'b']", ["a'b"]), ("[]", []), ("no list", None)],
)
def test_parse_list(spark, literal, items):
    df = frame(spark, [(literal,)], "t string")
    assert df.select(text.parse_list("t")).first()[0] == items


def test_keys_and_run_ids(spark):
    df = frame(spark, [("B1", ["W1", "W2"])], "b string, w array<string>")
    assert df.select(text.play_key("b", "w")).first()[0] == "B1|W1,W2"
    name = "winners_detoxify_scores_run_prompt_player_30_11_2025_15-49-21"
    assert one(spark, text.run_id_from_name("n"), n=name) == "run_prompt_player_30_11_2025_15-49-21"
    assert one(spark, text.run_id_from_name("n"), n="other") is None
    assert str(one(spark, text.run_started("n"), n=name)) == "2025-11-30 15:49:21"
    assert one(spark, text.clean_config("n"), n="random_configurations_5") == "random_5"
    assert one(spark, text.id_number("n"), n="W0a42") == 42
    assert one(spark, text.score_input("n"), n=" \n") == ""


def test_prompt_does_not_read_values_as_placeholders(spark):
    fields = {
        "character_description": F.lit("{black_card_text} {x}"),
        "black_card_text": F.lit("a __"),
        "white_cards_options": F.lit("ID:W1 TEXT:b;"),
    }
    prompt = spark.range(1).select(prompts.render_prompt(F.lit("EN"), F.lit("prompt_judge"), fields)).first()[0]
    template = prompts.PROMPTS["EN", "prompt_judge"]
    assert prompt == template.format(
        character_description="{black_card_text} {x}", black_card_text="a __", white_cards_options="ID:W1 TEXT:b;"
    )
    assert spark.range(1).select(prompts.render_prompt(F.lit("IT"), F.lit("prompt_judge"), fields)).first()[0] is None
