import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from choicemeter.operators import audit, reshape
from tests.frames import frame


def test_compaction(spark):
    df = frame(spark, [("a", None, "x", None, "y"), ("b", "p", "q", "r", "s"), ("c", None, None, None, None)], "k string, w1 string, w2 string, w3 string, w4 string")
    kept, rejects = reshape.compact_columns(df, ["w1", "w2", "w3", "w4"])
    assert sorted(tuple(r) for r in kept.collect()) == [("a", "x", "y", None), ("c", None, None, None)]
    assert [r.k for r in rejects.collect()] == ["b"]


def test_long_to_games_sets_aside_what_does_not_fit(spark):
    rows = [("B1", f"W{i}", i) for i in range(3)] + [("B2", f"W{i}", i) for i in range(6)] + [("B1", "W9", -1)]
    games, rejects = reshape.long_to_games(frame(spark, rows, "black_id string, white_id string, ordinal int"))
    assert [tuple(r) for r in games.collect()] == [("B1", "W9", "W0", "W1", "W2", None)]
    assert [(r.black_id, r.n) for r in rejects.collect()] == [("B2", 6)]


def test_melt_and_back(spark):
    wide = frame(spark, [("B1", "W1", None, "W3")], "black_id string, white_id_1 string, white_id_2 string, white_id_3 string")
    assert sorted(tuple(r) for r in reshape.melt_games(wide).collect()) == [("B1", "white_id_1", "W1"), ("B1", "white_id_3", "W3")]
    assert reshape.games_from_wide(wide).first().white_ids == ["W1", None, "W3"]


def test_resolution_of_texts(spark):
    cards = frame(spark, [("W1", "A  Cat."), ("W2", "dog__house")], "card_id string, card_text string")
    df = frame(spark, [(0, " a cat;", "Dog house"), (1, "bird", None)], "i int, w1 string, w2 string")
    got = {r.i: (r.id1, r.id2) for r in reshape.resolve_texts(df, cards, {"w1": "id1", "w2": "id2"}).collect()}
    assert got == {0: ("W1", "W2"), 1: (None, None)}


@pytest.mark.parametrize("broadcast", [True, False])
def test_texts_of_several_columns(spark, request, broadcast):
    if not broadcast:
        request.getfixturevalue("shuffle_joins")
    rng = random.Random(3)
    cards = frame(spark, [("W3", "cat"), ("W1", "A  Cat."), ("W2", "a cat"), ("W4", "dog__house"), ("W5", None)], "card_id string, card_text string")
    ids = {"cat": "W3", " a cat;": "W1", "Dog house": "W4", "bird": None, None: None, "": None}
    rows = [(i, *(rng.choice(list(ids)) for _ in range(3))) for i in range(400)] * 2
    df = frame(spark, rows, "i int, w1 string, w2 string, w3 string")
    found = reshape.resolve_texts(df, cards, {f"w{k}": f"id{k}" for k in (1, 2, 3)})
    assert found.columns == ["i", "id1", "id2", "id3"]
    assert Counter(tuple(r) for r in found.collect()) == Counter((r[0], *(ids[t] for t in r[1:])) for r in rows)
    assert reshape.resolve_texts(df, cards.where("false"), {"w1": "a", "w2": "b"}).where("a is not null or b is not null").count() == 0
    assert reshape.resolve_texts(df.where("false"), cards, {"w1": "a", "w2": "b"}).count() == 0


def test_phrase_without_text_is_a_violation(spark):
    phrases = frame(spark, [("B1", "W1", "I like CATS!"), ("B1", "W9", "x"), ("B1", "W1", "no")], "black_id string, white_id string, full_phrase string")
    whites = frame(spark, [("W1", "Cats.")], "card_id string, card_text string")
    blacks = frame(spark, [("B1", "I like __.")], "card_id string, card_text string")
    texts = reshape.phrase_texts(phrases, whites, blacks)
    row = reshape.phrase_containment(texts).first()
    assert (row.phrases, row.violations, row.all_contained) == (3, 2, False)
    assert sorted(r.full_phrase for r in reshape.phrase_violations(texts).collect()) == ["no", "x"]


def test_description_breaks_ties_by_value(spark):
    df = frame(spark, [("b", "x"), ("a", None), ("b", "y"), ("a", "z")], "k string, v string")
    got = {r.column: (r["count"], r.unique, r.top, r.freq) for r in audit.describe_text(df, ["k", "v"]).collect()}
    assert got == {"k": (4, 2, "a", 2), "v": (3, 3, "x", 1)}


def plain_description(values):
    counts = Counter(v for v in values if v is not None)
    top = min(counts, key=lambda v: (-counts[v], v.encode()))
    return sum(counts.values()), len(counts), top, counts[top]


@pytest.mark.parametrize("seed", range(4))
def test_descriptions_brute_force(spark, seed):
    rng = random.Random(seed)
    head = "é" * audit.HEAD  # values that only differ behind the shuffled beginning
    texts = [head + "b", head + "a", head, head[1:] + "a", "", "Z", "z", "\U0001f600", "\ufffd", None]
    rows = [(rng.choice(texts), str(rng.randint(0, 10**6)) if seed % 2 else "same", None) for _ in range(300)]
    df = frame(spark, rows, "a string, b string, c string")
    want = {name: plain_description([r[i] for r in rows]) for i, name in enumerate("ab")}
    got = {r.column: (r["count"], r.unique, r.top, r.freq) for r in audit.describe_text(df, ["a", "b", "c"]).collect()}
    assert got == want  # a column without values has no row
    found = {r.column: r for r in audit.describe_frequent(df, ["a", "b", "c"]).collect()}
    assert set(found) == {"a", "b"}
    for name, r in found.items():
        if r.settled:
            assert (r["count"], r.top, r.freq) == (want[name][0], *want[name][2:])
        assert abs(r.unique - want[name][1]) <= 0.05 * want[name][1]
    assert found["a"].settled
    assert audit.describe_text(df.where("false"), ["a"]).count() == audit.describe_frequent(df.where("false"), ["a"]).count() == 0


def test_frequent_values_among_many(spark):
    n = 60_000
    unique = F.concat(F.lit("text "), F.col("id")).alias("unique")
    hot = F.when(F.col("id") % 500 == 0, "hot").when(F.col("id") % 500 == 1, "warm").otherwise(F.col("id").cast("string")).alias("hot")
    pairs = F.when(F.col("id") < 4, F.lit("twice")).otherwise(F.floor(F.col("id") / 3).cast("string")).alias("pairs")
    df = spark.range(n).select(unique, hot, pairs)
    exact = {r.column: r for r in audit.describe_text(df, df.columns).collect()}
    found = {r.column: r for r in audit.describe_frequent(df, df.columns, buckets=4096).collect()}
    assert found["hot"].settled and (found["hot"].top, found["hot"].freq) == ("hot", n // 500)
    for name, r in found.items():
        assert r["count"] == exact[name]["count"] == n
        assert abs(r.unique - exact[name].unique) < 4 * audit.UNIQUE_ERROR * exact[name].unique
        assert max(r.others, r.freq or 0) >= exact[name].freq  # none can be missed
    # nothing stands out: not settled rather than guessed
    assert not found["unique"].settled and not found["pairs"].settled
    assert (exact["unique"].top, exact["unique"].freq) == ("text 0", 1)


def test_descriptions_shuffle_no_texts(spark):
    df = spark.range(2000).select(F.repeat(F.col("id").cast("string"), 500).alias("v"))
    for found in (audit.describe_text(df, ["v"]), audit.describe_frequent(df, ["v"])):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        written = [int(x) for x in shuffled_bytes(plan)]
        assert sum(written) < 2000 * 500  # a text has 2,000 characters or so


def shuffled_bytes(plan):
    """Bytes that each exchange of a plan that has run wrote."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from shuffled_bytes(plan.executedPlan())
        return
    if plan.getClass().getSimpleName() in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
        yield from shuffled_bytes(plan.plan())
        return
    if plan.getClass().getSimpleName() == "ShuffleExchangeExec":
        yield plan.metrics().apply("shuffleBytesWritten").value()
    children = plan.children()
    for i in range(children.size()):
        yield from shuffled_bytes(children.apply(i))


def test_audits(spark):
    cards = frame(spark, [("B1", "a __"), ("B2", "b __ __")], "card_id string, card_text string")
    assert tuple(audit.audit_blank_count(cards).first()) == (1, 2, False)
    rows = frame(spark, [("B1", "W1")] * 5 + [(None, "W2")], "black_id string, white_id string")
    assert tuple(audit.audit_group_size(rows).first()) == (1, 5, 5, True)
    whites = frame(spark, [("W1", "a"), ("W2", "b"), ("W3", "c")], "card_id string, card_text string")
    assert sorted(r.card_id for r in audit.cards_used(whites, rows).collect()) == ["W1", "W2"]


def test_texts_are_made_once(spark, shuffle_joins):
    """What makes the rows is worked out once, however often the lookup reads them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = frame(spark, [(1, "A b.", "c"), (2, "c", None), (3, "x", "a  B")], "n int, t1 string, t2 string").mapInArrow(count, "n int, t1 string, t2 string")
    cards = frame(spark, [("W2", "a b"), ("W1", "A  b;"), ("W3", "C")], "card_id string, card_text string")
    got = {tuple(r) for r in reshape.resolve_texts(rows, cards, {"t1": "id1", "t2": "id2"}).collect()}
    assert got == {(1, "W1", "W3"), (2, "W3", None), (3, None, "W1")}
    assert seen.value == 3
