"""One player and one judge run through all five stages."""

import datetime
import os
import re

from choicemeter.operators import scoring
from choicemeter.plans import stages


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def respond(prompt, model, temperature):
    offered = re.findall(r"ID:(W\d{3}) TEXT", prompt)
    if model == "shy":
        return "I cannot choose"
    return f"ID: {offered[0]}" if temperature < 0.6 else f"ID: {offered[-1]}"


def call(content):
    return {"attributeScores": {"TOXICITY": {"summaryScore": {"value": len(content) / 100}}, "SEVERE_TOXICITY": {"summaryScore": {"value": 0.9}}}}


def test_experiment(spark, tmp_path):
    cards = f"{tmp_path}/data"
    write(f"{cards}/EN/cards_texts/black_cards.csv", "card_id,card_text\nB001,I like ____.\nB002,\"What, __?\"\n")
    write(f"{cards}/EN/cards_texts/white_cards.csv", "card_id,card_text\n" + "".join(f"W{i:03d},thing {i}{'x' * i}.\n" for i in range(1, 7)) + "W007,\n")
    game = "lang,black_id,white_id_1,white_id_2,white_id_3\nEN,B001,W001,W002,W003\nEN,B002,W004,W005,W006\nIT,B001,W001,W002,W003\nEN,B001,W001,W999,W002\nEN,B001,W001,,\n"
    write(f"{cards}/EN/games_config/games_a_configurations.csv", game)
    write(f"{cards}/EN/to_judge_config/games_b.csv", game)
    config = {
        "cards_dir": cards, "results_dir": f"{tmp_path}/results", "file_type": "csv", "languages": ["EN"], "models": ["bold", "shy"],
        "temperatures": [0.5, 0.8], "rounds": 2, "dataset_mode": "all", "test_num_rows": 1, "prompt_type": "prompt_player", "character_description": "kind",
    }
    root = config["results_dir"]
    scorers = {
        "detoxify": (scoring.lexicon_scorer({"toxicity": ("thing",), "severe_toxicity": ("what",)}), ["toxicity", "severe_toxicity"]),
        "perspective": (stages.remote_scorer(call, ["toxicity", "severe_toxicity", "profanity"]), ["toxicity", "severe_toxicity", "profanity"]),
    }
    run_ids = []
    for prompt_type in ("prompt_player", "prompt_judge"):
        settings = {**config, "prompt_type": prompt_type}
        run = stages.start_run(spark, settings, datetime.datetime(2025, 11, 30, 15, 49, 21))
        run_ids.append(run)
        left_out = stages.collect_responses(spark, settings, run, respond)
        assert sorted(r.reason for r in left_out.collect()) == ["unexpected language", "white card not found"]
        stages.build_sentences(spark, settings, run)
        stages.score_sentences(spark, root, run, scorers)
    assert run_ids == ["run_prompt_player_30_11_2025_15-49-21", "run_prompt_judge_30_11_2025_15-49-21"]

    count = lambda name: stages.run_table(spark, f"{root}/{name}", run_ids[0]).count()
    assert count("raw_responses") == 2 * 2 * 2 * 2
    assert count("rejects_no_id") == 8 and count("winners") == 8 and count("combinations") == 24
    assert count("scored_winners") == 16 and count("scored_combinations") == 48
    # input = kept + rejected
    assert count("raw_responses") == count("winners") + count("rejects_no_id") + count("rejects_mismatch")
    assert count("rejects_plays") == 2 and count("rejects_cards") == 1 and count("rejects_games") == 1 and count("rejects_sentence") == 0

    charts = stages.report(spark, root, run_ids[0], "combinations", "perspective", ["bold"])
    assert charts["toxicity_by_temperature"].count() == 2
    assert charts["config_model_matrix"].first().clean_config == "games_a"
    assert all(table.count() > 0 for table in charts.values())

    found = stages.analyse(spark, root)
    assert {r.MER for r in found["mer"].collect()} == {1.0} and found["mer"].count() == 2 * 2 * 4
    assert {r.pattern_toxicity for r in found["pattern_toxicity"].where("classifier = 'perspective'").collect()} == {"Least Toxic", "Most Toxic"}
    assert found["top_success"].groupBy("run_id", "role", "classifier").count().select("count").distinct().collect() == [(5,)]
    compared = {(r.role, r.classifier): r for r in found["judge_comparison"].collect()}
    assert found["mer_chart"].count() == found["mer"].count() and found["judge_comparison_long"].count() == 8
    assert len(compared) == 4 and all(r.judge_description == "kind" and r.run_number == 1 for r in compared.values())


def test_a_faulty_configuration_is_refused(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError, match="rounds"):
        stages.start_run(spark, {"results_dir": str(tmp_path), "prompt_type": "prompt_player"})


def test_the_id_pattern_follows_from_the_cards(spark):
    from tests.frames import frame

    ddl = "color string, card_id string"
    assert stages.card_pattern(frame(spark, [("WHITE", "W100"), ("WHITE", "W1000"), ("BLACK", "X1")], ddl)) == "W[0-9]{3,4}"
    assert stages.card_pattern(frame(spark, [("WHITE", "Q07")], ddl)) == "Q[0-9]{2}"
    with __import__("pytest").raises(ValueError):
        stages.card_pattern(frame(spark, [("WHITE", "W1"), ("WHITE", "one")], ddl))
