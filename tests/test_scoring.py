import random
import re

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from choicemeter.operators import scoring, sweep
from tests.frames import frame


class Busy(Exception):
    def __init__(self, status):
        super().__init__("busy")
        self.status = status


def test_retry_waits_double_and_then_gives_up():
    waits, calls = [], []

    def call(content):
        calls.append(content)
        raise Busy(503)

    reply = scoring.with_retry(call, sleep=waits.append)("x")
    assert waits == [1.0, 2.0, 4.0, 8.0, 16.0] and len(calls) == 6
    assert reply == {"original_text": "x", "error": "HttpError 503"}


def test_retry_recovers_and_other_errors_end_at_once():
    answers = iter([Busy(429), {"attributeScores": {}}])

    def flaky(content):
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert "error" not in scoring.with_retry(flaky, sleep=lambda s: None)("x")

    def broken(content):
        raise KeyError("k")

    def refused(content):
        raise Busy(400)

    assert scoring.with_retry(broken, sleep=None)("x")["error"] == "'k'"
    assert scoring.with_retry(refused, sleep=None)("x")["error"] == "HttpError 400"


def test_labels():
    assert scoring.pick_labels(["sexual_explicit", "toxicity", "mood"]) == ["toxicity", "sexually_explicit"]
    with pytest.raises(ValueError, match="no matching labels"):
        scoring.pick_labels(["mood"])


def test_scoring_distinct_equals_scoring_all(spark, shuffle_joins):
    texts = ["you idiot", "you idiot", "nice", None, "  ", "stupid stupid moron, loser trash scum"]
    df = frame(spark, list(enumerate(texts)), "i int, sentence string")
    scored = scoring.add_scores(df, "sentence", scoring.lexicon_scorer({"toxicity": scoring.LEXICON, "severe_toxicity": ("scum",)}), ["toxicity", "severe_toxicity"])
    got = {r.i: (round(r.toxicity, 6), r.severe_toxicity_gt_05) for r in scored.collect()}
    assert got == {0: (0.2, 0), 1: (0.2, 0), 2: (0.0, 0), 3: (0.0, 0), 4: (0.0, 0), 5: (1.0, 0)}


def test_model_is_loaded_per_task_and_fed_in_batches(spark):
    def load():
        seen = []

        def predict(texts):
            seen.append(len(texts))
            return {"toxicity": [float(len(seen))] * len(texts), "sexual_explicit": [-1.0] * len(texts)}

        return predict

    df = spark.range(150).select(F.col("id").cast("string").alias("input")).coalesce(1)
    rows = scoring.model_scorer(load, ["toxicity", "sexual_explicit"])(df).collect()
    assert len(rows) == 150 and {r.toxicity for r in rows} == {1.0, 2.0, 3.0}
    assert {r.sexually_explicit for r in rows} == {-1.0}


def test_model_scorer_hands_back_slices(spark):
    """Missing scores are null, other columns come back as they were, and what a worker hands back is a batch of the model's size."""
    sizes = []

    def load():
        def predict(texts):
            sizes.append(len(texts))
            return {"toxicity": [len(sizes), float("nan"), None][: len(texts)] + [0.5] * (len(texts) - 3)}

        return predict

    df = spark.range(150).select(F.col("id").cast("string").alias("input"), F.date_from_unix_date(F.col("id").cast("int")).alias("day")).coalesce(1)
    scored = scoring.model_scorer(load, ["toxicity"])(df)
    assert "MapInArrow" in scored._jdf.queryExecution().executedPlan().toString()
    got = {int(r.input): (r.day.toordinal(), r.toxicity) for r in scored.collect()}
    epoch = 719163
    want = {i: (epoch + i, {0: i // 64 + 1, 1: None, 2: None}.get(i % 64, 0.5)) for i in range(150)}
    assert got == want


def test_missing_text_column(spark):
    with pytest.raises(ValueError, match="sentence"):
        scoring.add_scores(spark.range(1), "sentence", scoring.lexicon_scorer(), ["toxicity"])


def test_flatten(spark):
    replies = [
        (0, '{"attributeScores": {"TOXICITY": {"summaryScore": {"value": 0.25}}, "SEVERE_TOXICITY": {"summaryScore": {"value": 0.8}}}}'),
        (1, '{"error": "x"}'),
        (2, "no json"),
        (3, None),
        (4, '{"attributeScores": {"TOXICITY": {}}}'),
    ]
    df = frame(spark, replies, "i int, reply string")
    got = {r.i: (r.toxicity, r.severe_toxicity, r.severe_toxicity_gt_05, r.severe_toxicity_gt_08) for r in scoring.flatten_scores(df).collect()}
    assert got == {0: (0.25, 0.8, 1, 1), **{i: (None, None, 0, 0) for i in (1, 2, 3, 4)}}
    assert scoring.flatten_scores(df.where("i < 0")).columns[2:] == [*scoring.ATTRIBUTES, "severe_toxicity_gt_05", "severe_toxicity_gt_08"]


def test_trained_scorer_separates_labels(spark):
    root = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    labelled = docs.join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").withColumn("toxic", F.col("toxic").cast("double"))
    model = scoring.train_scorer(labelled.where("doc_id % 3 <> 0"))
    held_out = scoring.trained_scores(model, labelled.where("doc_id % 3 = 0"))
    assert BinaryClassificationEvaluator(rawPredictionCol="toxicity", labelCol="toxic").evaluate(held_out) > 0.6


def test_trained_scorer_equals_a_fit_outside_spark(spark):
    """Newton steps on the penalized likelihood of the same features give the same probabilities."""
    rng = random.Random(11)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts, labels = [], []
    for _ in range(400):
        words = rng.sample(vocabulary, rng.randint(1, 12))
        labels.append(float(rng.random() < (0.85 if any(w in vocabulary[:12] for w in words) else 0.2)))
        texts.append(rng.choice(["", "7, "]) + "! ".join(w.title() for w in words))
    df = frame(spark, [(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))], "i int, text string, toxic double")
    model = scoring.train_scorer(df.where("i < 300"), features=64)
    found = [r.toxicity for r in scoring.trained_scores(model, df).orderBy("i").collect()]

    place = {w: HashingTF(numFeatures=64, inputCol="a", outputCol="b").indexOf(w) for w in vocabulary}
    x = np.zeros((400, 64))
    for row, t in zip(x, texts):
        row[[place[w] for w in re.findall("[a-z]+", t.lower())]] = 1
    fit, y = x[:300], np.array(labels[:300])
    x = x * np.log(301 / (fit.sum(0) + 1))
    spread = x[:300].std(0, ddof=1)
    x = np.c_[x[:, spread > 0] / spread[spread > 0], np.ones(400)]
    penalty = np.diag([0.01] * (x.shape[1] - 1) + [0.0])
    weights = np.zeros(x.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(-x[:300] @ weights))
        slope = x[:300].T @ (p - y) / 300 + penalty @ weights
        curve = (x[:300].T * (p * (1 - p))) @ x[:300] / 300 + penalty
        weights -= np.linalg.solve(curve, slope)
    assert np.abs(1 / (1 + np.exp(-x @ weights)) - np.array(found)).max() < 0.01


CARDS = [("EN", "BLACK", "B1", "a __"), ("IT", "BLACK", "B1", "b __"), ("EN", "WHITE", "W1", "x"), ("EN", "WHITE", "W2", "y"), ("IT", "WHITE", "W1", "z")]
GAMES = [("g", "EN", 0, "B1", ["W2", "W1"]), ("g", "EN", 1, "B1", ["W1", None]), ("g", "EN", 2, "B9", ["W1", "W2"]), ("g", "IT", 0, "B1", ["W1"]), ("g", "EN", 3, "B1", ["W1", "W1"])]


def test_sweep(spark):
    cards = frame(spark, CARDS, "lang string, color string, card_id string, card_text string")
    games = frame(spark, GAMES, "config string, lang string, play_no long, black_id string, white_ids array<string>")
    prompts, left_out = sweep.plan_prompts(games, cards, ["m1", "m2"], [0.1, 0.9], 3, "prompt_player", "d")
    assert {(r.lang, r.play_no): r.reason for r in left_out.collect()} == {
        ("EN", 1): "white card not found",
        ("EN", 2): "black card not found",
        ("IT", 0): "no prompt template",
    }
    assert prompts.count() == 2 * 2 * 2 * 3
    texts = {r.play_no: r.prompt for r in prompts.collect()}
    assert "ID:W2 TEXT:y;ID:W1 TEXT:x;." in texts[0] and "ID:W1 TEXT:x;ID:W1 TEXT:x;." in texts[3]
    own, other = sweep.check_language(games, "EN")
    assert (own.count(), other.count()) == (4, 1)

    def respond(prompt, model, temperature):
        if model == "m2":
            raise RuntimeError("down")
        return None if temperature > 0.5 else "ID: W1"

    rows = sweep.batch_respond(prompts, respond, tasks=3).collect()
    assert {(r.model, r.temperature): r.response for r in rows} == {
        ("m1", 0.1): "ID: W1",
        ("m1", 0.9): "",
        ("m2", 0.1): "API_ERROR: RuntimeError: down",
        ("m2", 0.9): "API_ERROR: RuntimeError: down",
    }
    assert {r.iteration for r in rows} == {1, 2, 3}


def test_subset_per_language_and_file(spark):
    games = frame(spark, GAMES, "config string, lang string, play_no long, black_id string, white_ids array<string>")
    rows = sweep.test_subset(games, 2).collect()
    assert sorted((r.lang, r.play_no) for r in rows) == [("EN", 0), ("EN", 1), ("IT", 0)]
    assert "WindowGroupLimit" in sweep.test_subset(games, 2)._jdf.queryExecution().executedPlan().toString()
