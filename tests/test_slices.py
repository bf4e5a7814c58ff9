import os

import pytest

from choicemeter.operators import scoring, sweep
from choicemeter.sources import sinks, slices

from .frames import frame

PROMPTS = "config string, lang string, part string, play_no long, model string, temperature double, iteration int, black_id string, white_ids array<string>, prompt string"


def prompts(spark, count):
    return frame(spark, [("c", "EN", "", i, f"m{i % 2}", 0.5, 1, "B1", ["W1", "W2"], f"prompt {i % 30}") for i in range(count)], PROMPTS)


def asked(folder):
    return sorted(name.split("-")[0] for name in os.listdir(folder))


def client(folder, fail=None):
    """A client that notes each call, and takes its worker down at one prompt while a file lies there."""

    def respond(prompt, model, temperature):
        number = len(os.listdir(folder))
        with open(f"{folder}/{prompt} {model}-{number}-{os.getpid()}", "w"):
            pass
        if fail and prompt == fail and os.path.exists(f"{folder}/../broken"):
            os._exit(1)
        return f"{model}: {prompt}"

    return respond


def test_a_failed_run_asks_only_for_what_is_missing(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    (tmp_path / "broken").touch()
    table = prompts(spark, 60)
    with pytest.raises(Exception, match="crashed|Job aborted|worker"):
        sweep.batch_respond(table, client(str(calls), "prompt 7"), 2, store, 8).collect()
    done = {r._call: r.response for r in spark.read.parquet(store).collect()}
    first = asked(calls)
    assert 0 < len(done) < 60 and len(first) >= len(done)
    (tmp_path / "broken").unlink()
    again = tmp_path / "again"
    again.mkdir()
    rows = sweep.batch_respond(table, client(str(again), "prompt 7"), 2, store, 8).collect()
    assert sorted(r.response for r in rows) == sorted(f"m{i % 2}: prompt {i % 30}" for i in range(60))
    assert len(asked(again)) == 60 - len(done)  # finished slices are not asked again
    third = tmp_path / "third"
    third.mkdir()
    assert sweep.batch_respond(table, client(str(third)), 2, store, 8).count() == 60 and not asked(third)


def test_equal_rows_are_one_call(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    table = prompts(spark, 3).union(prompts(spark, 3))
    rows = sweep.batch_respond(table, client(str(calls)), None, str(tmp_path / "store"), 2).collect()
    assert len(rows) == 6 and len(asked(calls)) == 3
    assert sweep.batch_respond(table.where("false"), client(str(calls)), None, str(tmp_path / "other"), 2).count() == 0


def test_remote_scores_are_sent_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(content):
        with open(f"{calls}/{content}-{len(os.listdir(calls))}", "w"):
            pass
        return {"attributeScores": {"TOXICITY": {"summaryScore": {"value": len(content) / 10}}}}

    texts = frame(spark, [("one",), ("two",), ("three",), ("one",), (None,)], "sentence string")
    for _ in range(2):
        replies = scoring.batch_score_json(texts, "sentence", call, None, str(tmp_path / "store"), 3)
        got = {r.original_text: r.toxicity for r in scoring.flatten_scores(replies, ["toxicity"]).collect()}
        assert got["three"] == 0.5 and got["one"] == 0.3
    assert len(asked(calls)) == len(set(asked(calls)))


def test_the_store_is_empty_before_the_first_slice(spark, tmp_path):
    assert slices.stored(frame(spark, [(1,)], "a int"), str(tmp_path / "none")).count() == 0


def test_a_failed_write_leaves_the_published_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    path = f"{tmp_path}/t"
    sinks.write_part(frame(spark, [(1,), (2,)], "a int"), path, run_id="r1", kind="x y")
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("int").alias("a"))
    with pytest.raises(Exception, match="no"):
        sinks.write_part(broken, path, run_id="r1", kind="x y")
    rows = lambda **v: sorted((r.a, r.run_id, r.kind) for r in sinks.read_parts(spark, path, **v).collect())
    assert rows() == [(1, "r1", "x y"), (2, "r1", "x y")]
    # all files are there, but nothing names them yet
    frame(spark, [(9,)], "a int").write.parquet(f"{path}/{sinks.ATTEMPTS}/0123456789abcdef")
    assert rows() == [(1, "r1", "x y"), (2, "r1", "x y")]
    before = sinks.read_parts(spark, path)
    sinks.write_part(frame(spark, [(3,)], "a int"), path, run_id="r1", kind="x y")
    sinks.write_part(frame(spark, [(4, "n")], "a int, b string"), path, run_id="r2", kind="z")
    assert rows() == [(3, "r1", "x y"), (4, "r2", "z")] and rows(run_id="r2") == [(4, "r2", "z")] and rows(run_id="r3") == []
    assert sorted(r.a for r in before.collect()) == [1, 2]  # a reader keeps what it began with
    assert [r.b for r in sinks.read_parts(spark, path, run_id="r1").collect() if "b" in r] == []
    gone = sinks.unpublished(spark, path)
    assert len(gone) >= 2 and f"{path}/{sinks.ATTEMPTS}/0123456789abcdef" in gone


def test_a_part_is_written_as_its_tasks_have_it(spark, tmp_path):
    """No shuffle of whole rows before a write: each task's rows stay together, in their order."""
    sinks.write_part(spark.range(0, 4000, 1, 4), f"{tmp_path}/t", run_id="r1")
    rows = sinks.read_parts(spark, f"{tmp_path}/t")
    assert len(rows.inputFiles()) == 4 and rows.count() == 4000
