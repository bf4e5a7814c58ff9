import json
import os

import pytest
from pyspark.sql import functions as F

from choicemeter.operators import sweep, validation
from choicemeter.sources import contracts, readers, sinks
from tests.frames import frame


@pytest.mark.parametrize(
    "name,contract",
    [
        ("black_cards", "cards"),
        ("random_games_5", "games"),
        ("all_models_raw_responses", "raw_responses"),
        ("all_combination_sentences", "combination_sentences"),
        ("Winners_Sentences", "winners_sentences"),
        ("combinations_perspective_scores_run_x", "combinations_perspective"),
        ("winners_detoxify_scores", "winners_detoxify"),
    ],
)
def test_contract_by_name(name, contract):
    assert contracts.contract_for(name).name == contract


def test_no_contract():
    with pytest.raises(ValueError, match="no contract"):
        contracts.contract_for("config")


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


RAW = '''config,iteration,lang,model,temperature,black_id,play,response,extra
c,1,EN,m,0.5,B1,"['W001', 'W002']","ID: W001
line two, ""quoted""",x
c,3.0,EN,m,1,B1,[],ok,x
c,3.5,EN,m,nan,B1,[],ok,x
c,x,EN,m,0.5,,[],NA,x
'''


def test_csv_load(spark, tmp_path):
    path = f"{tmp_path}/raw_responses.csv"
    write(path, RAW)
    valid, found = readers.load_validated(spark, path)
    rows = valid.orderBy("iteration").collect()
    assert [(r.iteration, r.temperature) for r in rows] == [(1, 0.5), (3, 1.0)]
    assert rows[0].response == 'ID: W001\nline two, "quoted"' and "extra" not in valid.columns
    numbered = readers.scan_csv(spark, path, numbered=True)
    _, rejects = validation.split_valid(numbered, contracts.CONTRACTS["raw_responses"])
    messages = sorted(r.message for r in validation.row_messages(rejects).collect())
    assert sorted(r.message for r in found.collect()) == messages and sorted(r._row for r in found.collect()) == [2, 3]
    assert messages == [
        "Fila 4 (Excel): iteration: Input should be a valid integer; temperature: Input should be a valid number",
        "Fila 5 (Excel): iteration: Input should be a valid integer; black_id: Input should be a valid string; response: Input should be a valid string",
    ]


@pytest.mark.parametrize(
    "value,expected", [("3", 3), ("3.0", 3), (" 4 ", 4), ("3.5", None), ("nan", None), ("9e99", None), ("", None), ("-2147483648", -2147483648)]
)
def test_int_rule(spark, value, expected):
    df = frame(spark, [(value,)], "v string")
    assert df.select(validation.as_int(F.col("v"))).first()[0] == expected


def test_types_that_do_not_fit(spark):
    df = frame(spark, [(1, True, float("nan"))], "a long, b boolean, c double")
    contract = contracts.Contract("t", (("a", "string"), ("b", "int"), ("c", "double"), ("d", "string")))
    row = validation.check_rows(df, contract).first()
    assert row.b == 1 and row.errors == ["a: Input should be a valid string", "c: Input should be a valid number", "d: Field required"]


@pytest.mark.parametrize("rows,status", [([("a", "b")], "success"), ([("a", "b"), (None, "b")], "partial_error"), ([(None, "b")], "fatal_error")])
def test_status(spark, rows, status):
    df = frame(spark, rows, "card_id string, card_text string")
    row = validation.validation_status(validation.check_rows(df, contracts.CONTRACTS["cards"])).first()
    assert row.status == status and row.valid_rows + row.rejected_rows == len(rows)


def test_games_keep_extras_and_need_two_options(spark):
    df = frame(spark, [("EN", "B1", "W1", "W2", "x"), ("EN", "B2", "W1", None, "y")], "lang string, black_id string, white_id_1 string, white_id_2 string, note string")
    valid, rejects = validation.split_valid(df, contracts.CONTRACTS["games"])
    assert [r.note for r in valid.collect()] == ["x"]
    assert "found 1" in rejects.first().errors[0]


def test_file_stems(spark):
    paths = ["file:/a/b/games_5.csv", "/a/my%20game.parquet", "/a/config=c_1/part-00.snappy.parquet", "/a/games_10.csv/part-0-x.csv"]
    df = frame(spark, [(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i")
    assert [r[0] for r in df.select(readers.file_stem("p")).collect()] == ["games_5", "my game", "c_1", "games_10"]


def test_directory_scan_tags_files(spark, tmp_path):
    for n in (5, 10):
        write(f"{tmp_path}/games/games_{n}.csv", f"lang,black_id,white_id_1,white_id_2\nEN,B{n},W1,\n")
    rows = readers.scan_tagged(spark, f"{tmp_path}/games").collect()
    assert sorted((r.config, r.black_id, r.white_id_2) for r in rows) == [("games_10", "B10", None), ("games_5", "B5", None)]


def test_routing(spark):
    names = [
        "winners_detoxify_scores_run_prompt_player_30_11_2025_15-49-21",
        "combinations_perspective_scores_run_prompt_judge_30_11_2025_15-49-21",
        "player_judge_winners",
        "winners_only",
    ]
    df = frame(spark, [(n,) for n in names], "name string")
    got = {r.name: (r.role, r.kind, r.classifier) for r in readers.route_runs(df).collect()}
    assert got == {names[0]: ("player", "winners", "detoxify"), names[1]: ("judge", "combinations", "perspective"), names[2]: ("player", "winners", None)}


CONFIG = {
    "cards_dir": "d", "results_dir": "r", "file_type": "csv", "languages": ["EN"], "models": ["m"], "temperatures": [0.5, 1],
    "rounds": 2, "dataset_mode": "all", "test_num_rows": 2, "prompt_type": "prompt_player", "character_description": "x",
}


@pytest.mark.parametrize(
    "change,fields",
    [
        ({}, []),
        ({"rounds": "3", "temperatures": ["0.5"], "languages": []}, []),
        ({"rounds": 2.5}, ["rounds"]),
        ({"rounds": [1]}, ["rounds"]),
        ({"cards_dir": 1, "dataset_mode": "some"}, ["cards_dir", "dataset_mode"]),
        ({"models": "m", "temperatures": ["x"], "languages": [1]}, ["languages", "models", "temperatures"]),
        ({"character_description": None}, ["character_description"]),
        ({"languages": [None]}, ["languages"]),
        ({"languages": ["a", None], "temperatures": ["1d"], "rounds": "2f"}, ["languages", "temperatures", "rounds"]),
        ({"file_type": "parquet"}, []),
        ({"file_type": "xlsx"}, ["file_type"]),
    ],
)
def test_config_contract(spark, change, fields):
    df = frame(spark, [("r", json.dumps({**CONFIG, **change}))], "run_id string, value string")
    parsed = df.select("run_id", F.try_parse_json("value").alias("config"))
    assert [e.split(":")[0] for e in readers.check_configs(parsed, contracts.RUN_CONFIG).first().errors] == fields


def test_manifest_roundtrip(spark, tmp_path):
    run = "run_prompt_player_30_11_2025_15-49-21"
    broken = "run_prompt_player_30_11_2025_15-49-22"
    df = frame(spark, [(run, json.dumps(CONFIG)), (broken, "{no json")], "run_id string, value string")
    sinks.write_manifest(df, f"{tmp_path}/m")
    got = {r.run_id: (r.readable, r.judge_description) for r in readers.run_attributes(readers.read_manifest(spark, f"{tmp_path}/m/*")).collect()}
    assert got == {run: (True, "x"), broken: (False, None)}


def test_manifest_in_run_folders(spark, tmp_path):
    run = "run_prompt_judge_30_11_2025_15-49-21"
    write(f"{tmp_path}/{run}/run_config.json", json.dumps({**CONFIG, "judge_description": "j"}, indent=2))
    row = readers.run_attributes(readers.read_manifest(spark, f"{tmp_path}/*/run_config.json")).first()
    assert (row.run_id, row.judge_description) == (run, "j")


def test_rewriting_one_run_keeps_the_others(spark, tmp_path):
    df = frame(spark, [(1,), (2,)], "a int")
    for run in ("r1", "r2"):
        sinks.write_responses(df, str(tmp_path), run)
    sinks.write_responses(df.limit(1), str(tmp_path), "r1")
    counts = {r.run_id: r["count"] for r in sinks.read_parts(spark, f"{tmp_path}/raw_responses").groupBy("run_id").count().collect()}
    assert counts == {"r1": 1, "r2": 2}


def test_a_rerun_without_rejects_leaves_none(spark, tmp_path):
    for count in (2, 0):
        sinks.write_rejects(frame(spark, [(i,) for i in range(count)], "a int"), str(tmp_path), "r1", "no_id")
        sinks.write_rejects(frame(spark, [(7,)], "a int"), str(tmp_path), "r2", "no_id")
        kept = sinks.read_parts(spark, f"{tmp_path}/rejects_no_id").groupBy("run_id").count().collect()
        assert {r.run_id: r["count"] for r in kept} == ({"r1": 2, "r2": 1} if count else {"r2": 1})


def test_files_of_other_widths_and_orders(spark, tmp_path):
    folder = f"{tmp_path}/EN/games_config"
    write(f"{folder}/games_10.csv", "lang,black_id,white_id_1,white_id_2,white_id_3,white_id_4\nEN,B1,W1,W2,W3,W4\n")
    write(f"{folder}/games_5.csv", "black_id,white_id_2,white_id_1,lang\nB2,W8,W7,EN\nB3,,W7,EN\n")
    write(f"{folder}/quoted.csv", '\ufeff"lang","black_id","white_id_1","a ""b"", c","white_id_2"\nEN,B4,W1,"x\ny",W2\n')
    games, rejects = readers.read_games(spark, str(tmp_path), ["EN"], "prompt_player")
    rows = sorted((r.config, r.lang, r.black_id, tuple(r.white_ids)) for r in games.collect())
    assert rows == [
        ("games_10", "EN", "B1", ("W1", "W2", "W3", "W4")),
        ("games_5", "EN", "B2", ("W7", "W8")),
        ("quoted", "EN", "B4", ("W1", "W2")),
    ]
    assert [(r._row, r.errors[0][-7:]) for r in rejects.collect()] == [(1, "found 1")]
    split = readers.scan_csv(spark, [f"{folder}/games_10.csv", f"{folder}/games_5.csv"], multi_line=False)
    assert {(r.black_id, r.white_id_1, r.white_id_4) for r in split.collect()} == {("B1", "W1", "W4"), ("B2", "W7", None), ("B3", "W7", None)}


def test_cards_go_by_their_header(spark, tmp_path):
    write(f"{tmp_path}/EN/cards_texts/black_cards.csv", "card_text,card_id\nI like __,B1\n")
    write(f"{tmp_path}/EN/cards_texts/white_cards.csv", "card_id,note,card_text\nW1,x,it\nW2,x,\n")
    cards, rejects = readers.read_cards(spark, str(tmp_path), ["EN"])
    assert sorted((r.color, r.card_id, r.card_text) for r in cards.collect()) == [("BLACK", "B1", "I like __"), ("WHITE", "W1", "it")]
    assert [r._row for r in rejects.collect()] == [1]


def test_plays_of_part_files_stay_apart(spark, tmp_path):
    for part, card in (("part-0", "W1"), ("part-1", "W2")):
        write(f"{tmp_path}/EN/games_config/games/{part}.csv", f"lang,black_id,white_id_1,white_id_2\nEN,B1,{card},W3\n")
    games, _ = readers.read_games(spark, f"{tmp_path}", ["EN"], "prompt_player")
    cards = frame(spark, [("EN", "BLACK", "B1", "I __"), *(("EN", "WHITE", f"W{i}", f"t{i}") for i in (1, 2, 3))], "lang string, color string, card_id string, card_text string")
    rows = sweep.play_options(games, cards).collect()
    assert sorted(r.options for r in rows) == ["ID:W1 TEXT:t1;ID:W3 TEXT:t3;", "ID:W2 TEXT:t2;ID:W3 TEXT:t3;"]
    assert {r.play_no for r in rows} == {0} and len({r.part for r in rows}) == 2


def test_readers_hold_no_list_of_files(spark, tmp_path):
    """Tagging is a projection: no join, and no job while planning."""
    frame(spark, [("x", 1)], "name string, a int").write.parquet(f"{tmp_path}/winners_detoxify_scores_run_prompt_player_1_1_2025_1-1-1")
    df = readers.scan_runs(spark, f"{tmp_path}/*")
    assert "Join" not in df._jdf.queryExecution().toString()


def test_routing_works_a_path_out_twice(spark, tmp_path):
    """Once to keep a row and once for its columns, and decodes only paths with escapes."""
    for name in ("winners_detoxify_scores_run_prompt_player_01_01_2025_01-01-01", "a%20b_judge_combinations", "other_player"):
        frame(spark, [(1,)], "a int").write.parquet(f"{tmp_path}/{name}.parquet")
    df = readers.scan_runs(spark, f"{tmp_path}/*")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(csv|parquet|json)") == 2
    got = {(r.name, r.role, r.kind, r.classifier, r.run_id) for r in df.collect()}
    run = "run_prompt_player_01_01_2025_01-01-01"
    assert got == {(f"winners_detoxify_scores_{run}", "player", "winners", "detoxify", run), ("a%20b_judge_combinations", "judge", "combinations", None, None)}


@pytest.mark.parametrize(
    "path,stem",
    [("file:/a/x.csv", "x"), ("file:/a/n=x.parquet/part-0.c000.parquet", "x"), ("file:/a/b%20c+d/part-1", "b c+d"), ("file:/a/b%2Fpart-3", "b"), ("/b/foo", "foo"), ("file:/a//part-1", "")],
)
def test_file_stems(spark, path, stem):
    assert frame(spark, [(path,)], "p string").select(readers.file_stem("p")).first()[0] == stem


def test_scores_of_different_classifiers(spark, tmp_path):
    sinks.write_scores(frame(spark, [("m", 0.5, 0.1)], "model string, toxicity double, obscene double"), str(tmp_path), "r1", "winners", "detoxify")
    sinks.write_scores(frame(spark, [("m", 0.5, 0.2)], "model string, toxicity double, profanity double"), str(tmp_path), "r1", "winners", "perspective")
    rows = {r.classifier: r for r in sinks.read_parts(spark, f"{tmp_path}/scored_winners").collect()}
    assert rows["detoxify"].obscene == 0.1 and rows["detoxify"].profanity is None
    assert rows["perspective"].profanity == 0.2 and rows["perspective"].obscene is None


@pytest.mark.parametrize("value,expected", [("1d", None), ("0.5f", None), ("0x1p3", None), ("1e3", 1000.0), (" .5 ", 0.5), ("-2.", -2.0), ("inf", float("inf")), ("nan", None), ("Infinity", float("inf")), ("1 2", None)])
def test_number_rule(spark, value, expected):
    df = frame(spark, [(value,)], "v string")
    assert df.select(validation.as_number(F.col("v"))).first()[0] == expected
    assert df.select(validation.as_int(F.col("v"))).first()[0] == (-2 if value == "-2." else None)


def test_stage_configs(spark):
    from choicemeter.plans import stages

    stages.check_stage(spark, 3, {"run_id": "r", "run_config_dir": "d", "detoxify_model": "o", "device": "cpu", "batch_size": 64})
    for stage, config in ((2, {"run_id": "r"}), (3, {"run_id": "r", "run_config_dir": "d", "detoxify_model": "o", "device": "cpu", "batch_size": "x"}), (5, {"analysis_dir": 1, "file_type": "csv"})):
        with pytest.raises(ValueError):
            stages.check_stage(spark, stage, config)
