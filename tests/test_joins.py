from collections import Counter

import pytest
from pyspark.sql import functions as F

from choicemeter.operators import lookup
from tests.frames import frame


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def skewed(spark):
    """A third of the rows share one key, another tenth has none, and copies are exact."""
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 != 1, F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        (F.col("id") % 5).alias("v"),
    )
    right = frame(spark, [("hot", 1)] + [(f"k{i}", i) for i in range(30)], "k string, w int")
    return left, right


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_join(skewed, how):
    left, right = skewed
    expected = rows(left.join(right, "k", how).select("k", "v", "w"))
    got = rows(lookup.spread_join(left, right, ["k"], how, salts=8, hot_rows=100).select("k", "v", "w"))
    assert got == expected


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_join(skewed, how):
    left, right = skewed
    expected = rows(left.join(right, "k", how).select("k", "v", "w"))
    assert rows(lookup.salted_join(left, right, ["k"], how, salts=8).select("k", "v", "w")) == expected


def test_chained_lookups_read_the_rows_once(skewed, shuffle_joins):
    left, right = skewed
    for i in range(6):
        left = lookup.lookup_join(left, right.withColumnRenamed("w", f"w{i}"), ["k"])
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 3000") == 1


def test_hot_keys_are_the_frequent_ones(skewed):
    left, _ = skewed
    hot = {r[0] for r in lookup.hot_keys(left, ["k"], 300).collect()}
    counts = left.groupBy("k").count().select(F.xxhash64("k"), "count").collect()
    assert hot == {h for h, n in counts if n >= 300}
    assert hot


def test_hot_key_is_dealt_to_many_tasks(spark, skewed, shuffle_joins):
    left, right = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    joined = lookup.spread_join(left, right, ["k"], "left", salts=8, hot_rows=100)
    tasks = joined.where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 1


def test_lookup_join_takes_the_path_that_the_size_allows(spark, skewed):
    left, right = skewed
    plan = lookup.lookup_join(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "_salt" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "_salt" in lookup.lookup_join(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_lookups_are_not_copied(skewed, shuffle_joins, monkeypatch):
    left, right = skewed
    expected = rows(left.join(right, "k", "left").select("k", "v", "w"))
    for limit, copies in ((lookup.COPY_BYTES, lookup.SALTS), (3 * lookup.estimated_bytes(right), 3), (1, 1)):
        monkeypatch.setattr(lookup, "COPY_BYTES", limit)
        joined = lookup.lookup_join(left, right, ["k"])
        assert lookup.copies_of(right) == copies
        assert f"sequence(0, {copies - 1}" in joined._jdf.queryExecution().analyzed().toString()
        assert rows(joined.select("k", "v", "w")) == expected


def test_doubled_card_ids_are_set_aside(spark):
    cards = frame(
        spark,
        [("EN", "WHITE", "W1", "a"), ("EN", "WHITE", "W2", "b"), ("EN", "WHITE", "W2", "c")], "lang string, color string, card_id string, card_text string"
    )
    usable, doubled = lookup.unique_cards(cards)
    assert [r.card_id for r in usable.collect()] == ["W1"]
    assert [(r.card_id, r.copies) for r in doubled.collect()] == [("W2", 2)]


@pytest.mark.parametrize("path", ["broadcast", "shuffle"])
def test_several_columns_are_looked_up_by_one_join(spark, request, path):
    """As one left join a column, with repeated rows, repeated keys, nulls and unknown keys."""
    if path == "shuffle":
        request.getfixturevalue("shuffle_joins")
    keys = ["a", "b", "c", None, "x"]
    some = [(i % 3 or None, keys[i % 5], keys[i // 5 % 5], keys[i // 25]) for i in range(125)]
    left = frame(spark, some + some[:40] * 2, "n int, k1 string, k2 string, k3 string")
    right = frame(spark, [("a", "A"), ("b", "B"), ("b", "B"), ("c", None), ("c", "C"), (None, "N")], "id string, text string")
    want = left
    for i in (1, 2, 3):
        want = want.join(right.select(F.col("id").alias(f"k{i}"), F.col("text").alias(f"t{i}")), f"k{i}", "left")
    found = lookup.lookup_columns(left, right, "id", "text", {f"k{i}": f"t{i}" for i in (1, 2, 3)})
    assert found.columns == ["n", "k1", "k2", "k3", "t1", "t2", "t3"]
    assert rows(found) == rows(want.select(found.columns))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1


@pytest.mark.parametrize("name", ["compact_columns", "resolve_black_ids"])
def test_plays_of_an_app_hold_the_option_texts_once(spark, tmp_path, name):
    """One join with the options for all five columns: a task holds their texts once."""
    from checks import registry

    spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(40).select(F.col("id").alias("p_partkey"), F.lit("ring").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(6).select(F.col("id").alias("item_id"), F.lit("one two three four").alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    plan = registry.app_plays(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # options, templates
    assert registry.QUERIES[name](spark, str(tmp_path)).count() > 0
