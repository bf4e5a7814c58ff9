import random
import statistics

import pytest
from pyspark.sql import functions as F

from choicemeter.functions import scores
from choicemeter.operators import distribution, states
from choicemeter.sources import sinks

from .frames import frame

DDL = "clean_config string, lang string, model string, temperature double, toxicity string, severe_toxicity double"


def rows(seed, count):
    rng = random.Random(seed)
    value = lambda: rng.choice([f"{rng.random():.6f}", f"{0.9 + rng.random() / 10:.6f}", None, "nan", "x", "0.8"])
    return [(rng.choice("ab") if rng.random() < 0.97 else None, rng.choice(["EN", "IT"]), f"m{rng.randint(0, 2)}", rng.choice([0.2, 0.8]), value(), rng.random()) for _ in range(count)]


def number(text):
    return None if text in (None, "nan", "x") else float(text)


def test_merged_states_equal_a_scan_of_all_runs(spark):
    runs = [rows(i, n) for i, n in enumerate((0, 1, 400, 30, 900))]
    parts = [states.score_states(frame(spark, r, DDL), states.STATE_KEYS, ["toxicity", "severe_toxicity"]) for r in runs]
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.union(part)
    for keys, at in ((["model"], (2,)), (["clean_config", "lang"], (0, 1))):
        found = {tuple(r[k] for k in keys): r for r in states.described(states.merge_states(kept, keys)).where("attribute = 'toxicity'").collect()}
        groups = {}
        for r in (r for run in runs for r in run if r[0] is not None):
            groups.setdefault(tuple(r[i] for i in at), []).append(number(r[4]))
        assert set(found) == set(groups)
        for key, values in groups.items():
            some, r = [v for v in values if v is not None], found[key]
            assert r["count"] == len(some) and (r.low, r.high) == (min(some), max(some))
            assert r.mean == pytest.approx(statistics.fmean(some), rel=1e-12) and r.std == pytest.approx(statistics.stdev(some), rel=1e-12)
            assert r.tail_percent == pytest.approx(100 * sum(v >= 0.8 for v in some) / len(values), rel=1e-12)


def test_odd_groups(spark):
    some = frame(spark, [("a", "EN", "m", 0.2, None, 0.1), ("b", "EN", "m", 0.2, "0.5", None), ("b", "EN", None, 0.2, "0.5", None)], DDL)
    out = {r.clean_config: r for r in states.described(states.score_states(some, ["clean_config", "model"]), {"p50": 0.5}).collect()}
    assert (out["a"]["count"], out["a"].mean, out["a"].p50, out["a"].tail_percent) == (0, None, None, 0.0)
    assert (out["b"]["count"], out["b"].mean, out["b"].std, out["b"].band, out["b"].p50) == (1, 0.5, None, 0.0, 0.5)
    assert states.score_states(some.where("false"), ["model"]).count() == 0
    merged = states.merge_states(states.score_states(some, ["clean_config", "model"]), ["model"]).first()
    assert (merged.rows, merged.n, merged["mean"], merged.m2) == (2, 1, 0.5, 0.0)


def test_no_value_is_shuffled(spark):
    df = frame(spark, rows(1, 50), DDL)
    plan = distribution.language_risk(df, exact=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_kll_sketch_agg_double" in plan
    exact = {(r.lang, r.model): r for r in distribution.language_risk(df).collect()}
    for r in distribution.language_risk(df, exact=False).collect():
        assert abs(r.p50 - exact[r.lang, r.model].p50) < 0.5 and r["mean"] == exact[r.lang, r.model]["mean"]


@pytest.mark.parametrize("merged", [False, True])
def test_sketches_keep_their_rank_error(spark, merged):
    count = 200_000
    df = spark.range(count).select(F.lit("m").alias("model"), (F.xxhash64("id") % 1000003 / 1e6).alias("toxicity"), (F.col("id") % 40).alias("run"))
    found = states.score_states(df, ["run", "model"]) if merged else states.score_states(df, ["model"])
    found = states.merge_states(found, ["model"]) if merged else found
    p = {f"p{i}": i / 20 for i in range(1, 20)}
    point = states.described(found, p).first()
    ranks = df.agg(*(F.count_if(F.col("toxicity") <= point[k]).alias(k) for k in p)).first()
    assert states.rank_error() < 0.0015
    assert all(abs(ranks[k] / count - share) < 3 * states.rank_error() for k, share in p.items())


def test_a_run_s_states_come_from_its_own_scores(spark, tmp_path):
    for run in ("r1", "r2"):
        scored = frame(spark, rows(len(run), 20), DDL).withColumnRenamed("clean_config", "config").withColumn("toxicity", scores.to_score("toxicity"))
        sinks.write_scores(scored, str(tmp_path), run, "winners", "c")
        written = sinks.read_parts(spark, f"{tmp_path}/scored_winners", run_id=run)
        assert len(written.inputFiles()) == len(sinks.read_parts(spark, f"{tmp_path}/scored_winners", run_id=run, classifier="c").inputFiles())
        assert all(f in sinks.read_parts(spark, f"{tmp_path}/scored_winners").inputFiles() for f in written.inputFiles())
        sinks.write_states(written, str(tmp_path), run, "winners", "c")
    assert len(sinks.read_parts(spark, f"{tmp_path}/scored_winners").inputFiles()) > len(written.inputFiles())
    kept = sinks.read_parts(spark, f"{tmp_path}/score_states", kind="winners")
    assert {r.run_id for r in kept.select("run_id").distinct().collect()} == {"r1", "r2"}
