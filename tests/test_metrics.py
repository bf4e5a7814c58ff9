import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from choicemeter.functions import scores
from choicemeter.functions.stats import chi_square_survival
from choicemeter.operators import audit, consistency, distribution, runs
from tests.frames import frame

CELL = ("c", "EN", "m", 0.5, "B1")
WINNERS = "config string, lang string, model string, temperature double, black_id string, iteration int, play array<string>, winners array<string>"
OPTIONS = WINNERS + ", white_id string, pos int, toxicity double, severe_toxicity double"


def winners(spark, *chosen, cell=CELL):
    return frame(spark, [(*cell, i + 1, ["W1", "W2"], w) for i, w in enumerate(chosen)], WINNERS)


def test_mer_tie_takes_the_smallest(spark):
    row = consistency.majority_election_rate(winners(spark, ["W2"], ["W1"], ["W2"], ["W1"], ["W3"])).first()
    assert (row.total_rounds, row.most_frequent_cards, row.most_frequent_winner, row.MER) == (5, ["W1"], 2, 0.4)


def test_mer_leaves_out_null_keys(spark):
    df = winners(spark, ["W1"]).unionByName(winners(spark, ["W1"], cell=("c", "EN", None, 0.5, "B1")))
    assert consistency.majority_election_rate(df).count() == 1


def test_success_rate_of_cards_not_offered_and_empty_lists(spark):
    df = winners(spark, ["W9", "W1"], [" W1 "], [])
    got = {r.white_id: (r.victories, r.appearances, r.Success_Rate) for r in consistency.success_rate(df).collect()}
    assert got == {"W9": (1, 0, 0.0), "W1": (1, 3, 1 / 3), "W2": (0, 3, 0.0)}
    assert {r.white_id: r.victories for r in consistency.card_victories(df).collect()} == {"W9": 1, "W1": 1}


def options(spark, rows, cell=CELL):
    data = [(*cell, it, ["W1", "W2"], [w], card, pos, t, s) for it, w, card, pos, t, s in rows]
    return frame(spark, data, OPTIONS)


NAN = float("nan")


@pytest.mark.parametrize(
    "rows,label",
    [
        ([(1, "W1", "W1", 0, 0.9, 0.1), (1, "W1", "W2", 1, 0.2, 0.1)], "Most Toxic"),
        ([(1, "W1", "W1", 0, 0.2, 0.1), (1, "W1", "W2", 1, 0.9, 0.1)], "Least Toxic"),
        ([(1, "W1", "W1", 0, 0.5, 0.1), (1, "W1", "W2", 1, 0.5, 0.1)], "Least Toxic"),
        ([(1, "W1", "W1", 0, 0.5, 0.1), (1, "W1", "W2", 1, 0.2, 0.1), (1, "W1", "W3", 2, 0.9, 0.1)], "Intermediate"),
        # the earliest choice counts, and rows with a missing score do not
        ([(2, "W2", "W2", 1, 0.9, 0.1), (1, "W1", "W1", 0, 0.1, 0.1), (1, "W1", "W2", 1, NAN, 0.1)], "Least Toxic"),
        ([(1, "W9", "W1", 0, 0.9, 0.1), (1, "W9", "W2", 1, 0.2, 0.1)], None),
    ],
)
def test_patterns(spark, rows, label):
    cells = consistency.winner_vs_options(options(spark, rows))
    assert cells.count() == 1
    got = [(r.pattern_toxicity, r.percent) for r in consistency.toxicity_pattern(cells).collect()]
    assert got == ([] if label is None else [(label, 100.0)])


def scored(spark, values, **columns):
    df = frame(spark, [(float(v) if v is not None else None,) for v in values], "toxicity double")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def test_single_score_has_no_deviation_and_zero_band(spark):
    row = distribution.toxicity_by_temperature(scored(spark, [0.5, None, NAN], model="m", temperature=0.2)).first()
    assert (row["mean"], row["count"], row["std"], row["sem"], row["band"]) == (0.5, 1, None, None, 0.0)


def test_missing_scores_count_as_below(spark):
    df = scored(spark, [0.8, NAN, None, 0.79], model="m", temperature=0.2)
    assert distribution.tail_rate(df, ["model"]).first().tail_percent == 25.0


@pytest.mark.parametrize("n,seed", [(1, 0), (2, 1), (7, 2), (500, 3), (2000, 4)])
def test_exact_quantiles(spark, n, seed):
    rng = np.random.default_rng(seed)
    # close to zero, so that many values share a cell; with repeats
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n), "toxicity": np.round(rng.beta(0.2, 6.0, n), rng.integers(3, 9))})
    df = spark.createDataFrame(pdf).unionByName(frame(spark, [("a", NAN), (None, 0.5)], "g string, toxicity double"))
    probabilities = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in distribution.exact_quantiles(df, ["g"], probabilities).collect()}
    for g, part in pdf.groupby("g"):
        for name, p in probabilities.items():
            assert got[g][name] == pytest.approx(part.toxicity.quantile(p), abs=1e-12)
        assert (got[g].n, got[g].low, got[g].high) == (len(part), part.toxicity.min(), part.toxicity.max())
    assert set(got) == set(pdf.g)


def test_quantiles_do_not_gather_a_group(spark):
    df = scored(spark, [0.1, 0.2], model="m", lang="EN")
    plan = distribution.language_risk(df)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan


def test_histogram_closes_the_last_bin(spark):
    rows = distribution.score_histogram(scored(spark, [0.0, 0.049, 0.05, 1.0, 0.95, NAN], model="m"), ["model"]).collect()
    assert {r.bin: r.bin_n for r in rows} == {0: 2, 1: 1, 19: 2}
    assert {(r.n, r.low, r.high) for r in rows} == {(5, 0.0, 1.0)}


def test_rounding_like_numpy(spark):
    values = [0.0125, 0.0005, 0.1125, 2.675, 1.0005]
    df = frame(spark, [(v,) for v in values], "v double")
    assert [r[0] for r in df.select(scores.round_half_even(F.col("v"), 3)).collect()] == [float(np.round(v, 3)) for v in values]


def test_clip_and_coerce(spark):
    df = frame(spark, [(0, "1.5"), (1, "-2"), (2, "nan"), (3, "x"), (4, None), (5, "0.25")], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(scores.clip_score("v")).collect()] == [1.0, 0.0, None, None, None, 0.25]
    assert [r[0] for r in df.select(scores.threshold_flag("v", 0.8)).collect()] == [1, 0, 0, 0, 0, 0]


def test_top_matrix_drops_keys_without_scores(spark):
    df = frame(
        spark,
        [("B1", "m", 0.5), ("B2", "m", 0.9), ("B2", None, 0.1), ("B3", "m", NAN)], "black_id string, model string, toxicity double"
    )
    got = {r.black_id: r.m for r in distribution.top_black_matrix(df, 2, ["m"]).collect()}
    assert got == {"B1": 0.5, "B2": 0.9}


def test_matrix_finds_its_models(spark):
    rows = [("b1", "m2", "0.5"), ("b1", "m1", "0.25"), ("b2", "m2", "1"), ("b2", None, "0"), (None, "m3", "1")]
    df = frame(spark, rows, "black_id string, model string, toxicity string")
    found = distribution.top_black_matrix(df)
    assert found.columns == ["black_id", "m1", "m2"]
    assert sorted(tuple(r) for r in found.collect()) == [("b1", 0.25, 0.5), ("b2", None, 1.0)]
    assert distribution.top_black_matrix(df.where("false")).columns == ["black_id"]


def test_unstable_puts_missing_deviation_last(spark):
    df = frame(spark, [("a", 0.1), ("a", 0.2), ("b", 0.5)], "black_id string, toxicity double").withColumns(
        {"model": F.lit("m"), "temperature": F.lit(0.2), "winners": F.array(F.lit("W1"))}
    )
    top = distribution.top_unstable(distribution.stability(df), 2).collect()
    assert [r.play_key for r in top] == ["a|W1", "b|W1"] and [r.size for r in top] == [500.0, 250.0]


def test_chi_square(spark):
    assert chi_square_survival(2.3777777, 3) == pytest.approx(0.4978, abs=1e-4)
    assert chi_square_survival(10.0, 10) == pytest.approx(0.4405, abs=1e-4)
    # literal values of the upper tail: many degrees, even and odd, either side of the mean
    for x, degrees, p in ((3.841458820694124, 1, 0.05), (124.342113, 100, 0.05), (1000.0, 999, 0.48512), (1_002_326.0, 10**6, 0.05), (998_000.0, 10**6 + 1, 0.92152)):
        assert chi_square_survival(x, degrees) == pytest.approx(p, abs=2e-4)
    observed = {1: 10, 2: 12, 3: 8, 4: 15}
    df = frame(spark, [("s", k) for k, n in observed.items() for _ in range(n)], "config string, white_num long")
    row = audit.chi_square_uniform(df, 4).first()
    assert (row.total, row.degrees, row.uniform) == (45, 3, True)
    assert row.statistic == pytest.approx(2.3778, abs=1e-4) and row.p_value == pytest.approx(0.4978, abs=1e-4)


def test_zero_filled_range_crosses_blocks(spark):
    df = frame(spark, [("s", 1), ("s", 70_000)], "config string, white_num long")
    frequencies = audit.frequency_zero_filled(df, 70_001)
    assert frequencies.count() == 70_001 and frequencies.agg(F.sum("n"), F.max("white_num")).first()[:] == (2, 70_001)


def test_zero_filled_equals_plain_counts(spark):
    rng = random.Random(3)
    last = 131_073  # two whole blocks and one id
    rows = [(s, n) for s in ("a", "b") for n in [1, 1, 65_536, 65_537, 65_537, last, 0, -5, last + 1, 10**7] + [rng.randint(1, last) for _ in range(50)]]
    rows += [("c", last + 3), ("d", None), (None, 4)]
    frequencies = audit.frequency_zero_filled(frame(spark, rows, "config string, white_num long"), F.lit(last), tasks=3)
    assert frequencies.dtypes == [("config", "string"), ("white_num", "bigint"), ("n", "bigint")]
    counts = {(r.config, r.white_num): r.n for r in frequencies.where("n > 0").collect()}
    want = {k: n for k, n in Counter(rows).items() if k[0] in ("a", "b") and 1 <= k[1] <= last}
    assert counts == want
    whole = frequencies.groupBy("config").agg(F.count("white_num"), F.count_distinct("white_num"), F.min("white_num"), F.max("white_num"), F.sum("n"))
    assert {tuple(r) for r in whole.collect()} == {(s, last, last, 1, last, sum(n for k, n in want.items() if k[0] == s)) for s in "abc"}


def test_zero_filled_ids_are_not_shuffled(spark):
    df = frame(spark, [("s", 1), ("t", 70_000)], "config string, white_num long")
    frequencies = audit.frequency_zero_filled(df, 200_000)
    plan = frequencies._jdf.queryExecution().executedPlan().toString().split("Generate posexplode(sequence(white_num")
    assert len(plan) == 2 and "Exchange" not in plan[0]
    # two sets with four blocks each
    assert frequencies.select(F.spark_partition_id()).distinct().count() > 4


def test_constant_ids_have_no_correlation(spark):
    df = frame(spark, [("s", 1, 1), ("s", 1, 2)], "config string, black_num long, white_num long")
    assert audit.id_correlation(df).first().correlation is None


def test_judge_comparison_labels_and_empty_files(spark):
    rows = [("r1", 0.2), ("r1", 0.4), ("r2", 0.9), ("r3", 0.5)]
    df = frame(spark, rows, "run_id string, toxicity double").withColumns(
        {"severe_toxicity": F.lit(0.1), "role": F.lit("judge"), "classifier": F.lit("detoxify")}
    )
    files = frame(spark, [(f"r{i}", "judge", "detoxify") for i in range(1, 5)], "run_id string, role string, classifier string")
    attributes = frame(spark, [("r1", True, "kind"), ("r4", True, "kind"), ("r3", True, None)], "run_id string, readable boolean, judge_description string")
    got = {r.judge_description: (r.run_number, round(r.mean_toxicity, 6)) for r in runs.judge_comparison(df, attributes, files).collect()}
    assert got == {"kind": (2, 0.15), "ERROR: Description not found": (1, 0.9), "JUDGE_DESCRIPTION_MISSING": (1, 0.5)}


def plain_density(values, points):
    """The curve over the values themselves."""
    values = np.array(values)
    if len(values) < 2 or values.min() == values.max():
        return [(values[0], None, 1.0)]
    h = values.std(ddof=1) * len(values) ** -0.2
    at = np.linspace(values.min(), values.max(), points)
    density = np.exp(-(((at[:, None] - values) / h) ** 2) / 2).sum(1) / (len(values) * h * math.sqrt(2 * math.pi))
    return list(zip(at, density, density / density.max()))


def test_density_curves(spark):
    rng = random.Random(5)
    groups = {
        "steps": [rng.randint(0, 5) / 5 for _ in range(400)],
        "wide": [rng.random() for _ in range(3000)],
        "low": [min(1.0, rng.expovariate(8)) for _ in range(2000)],
        "two": [0.25, 0.75],
        "one": [0.4],
        "equal": [0.6] * 9,
    }
    rows = [(k, repr(v)) for k, values in groups.items() for v in values]
    rows += [("steps", None), ("steps", "nan"), ("steps", "x"), ("none", None), (None, "0.5")]
    rng.shuffle(rows)
    df = frame(spark, rows, "model string, toxicity string")
    found = {}
    for r in distribution.score_density(df, ["model"], points=50).orderBy("model", "point").collect():
        found.setdefault(r.model, []).append((r.score, r.density, r.width))
    assert set(found) == set(groups)
    for k, values in groups.items():
        want = plain_density(values, 50)
        exact = k in ("steps", "two", "one", "equal")  # a bin has one value
        for got, expected in zip(found[k], want, strict=True):
            assert got == pytest.approx(expected, rel=1e-9 if exact else 2e-3) if expected[1] is not None else got == expected
    two = distribution.score_density(frame(spark, [("a", "-3"), ("a", "7"), ("a", "0.5")], "model string, toxicity string"), ["model"], points=2).collect()
    assert sorted((r.point, r.score) for r in two) == [(0, 0.0), (1, 1.0)]
    assert distribution.score_density(df.where("false"), ["model"]).count() == 0
    with pytest.raises(ValueError):
        distribution.score_density(df, ["model"], points=1)
