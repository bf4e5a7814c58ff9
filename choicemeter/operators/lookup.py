"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it has at least this many rows.  A table of n rows has at
# most n / HOT_ROWS hot keys, and only their 8-byte hashes and task counts are
# broadcast: 12 MB for a trillion rows.
HOT_ROWS = 1_000_000
# Tasks that share the rows of one key, at least.
SALTS = 32
# Estimated bytes that the copies of a lookup table for these tasks may have; a larger table is not copied.
COPY_BYTES = 32 << 20


def _broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    units = {"kb": 1 << 10, "k": 1 << 10, "mb": 1 << 20, "m": 1 << 20, "gb": 1 << 30, "g": 1 << 30, "b": 1}
    for suffix in sorted(units, key=len, reverse=True):
        if text.endswith(suffix):
            return int(text[: -len(suffix)]) * units[suffix]
    return int(text)


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a table, or None where it cannot be asked."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(left: DataFrame, right: DataFrame) -> bool:
    """Whether Spark will send ``right`` to every task: its estimated size is within the session's limit."""
    size = estimated_bytes(right)
    return size is not None and size <= _broadcast_limit(left)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows, about: one row of an aggregate."""
    row = F.coalesce(F.octet_length(F.to_json(F.struct(*df.columns))), F.lit(0)) + 16 * len(df.columns)
    return df.agg(F.sum(row)).first()[0] or 0


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``lookup_join`` to a table that Spark takes for larger than it is, such as one colour of all cards.

    Where the estimate is beyond the broadcast limit, the table is measured; within the
    limit it is sent to every task, and ``left`` is not shuffled.
    """
    if not fits_broadcast(left, right) and 0 < _broadcast_limit(left) and measured_bytes(right) <= _broadcast_limit(left):
        return left.join(F.broadcast(right), on, how)
    return lookup_join(left, right, on, how)


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join rows to a lookup table (cards and the like) on equal keys.

    Within the session's broadcast limit ``left`` is not shuffled.  Beyond it
    both sides are, with every key dealt to several tasks: ``SALTS``, or as many as
    copies of ``right`` stay within ``COPY_BYTES``.  Keys of a larger table have one task each, where
    Spark's adaptive plan splits a large partition of ``left``.  Neither way reads
    ``left`` more than once, so lookups can follow one another.
    """
    return left.join(right, on, how) if fits_broadcast(left, right) else salted_join(left, right, on, how, copies_of(right))


def lookup_columns(df: DataFrame, right: DataFrame, key: str, value: str, columns: dict[str, str]) -> DataFrame:
    """Look several key columns up in one table by one join; ``columns`` maps each to the name of its value column.

    The result is that of one left ``lookup_join`` a column, also where rows or keys repeat,
    but a task holds the table once and not once a column: a row's keys become rows and
    come together again by all of its columns.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_rows"))
    cells = counted.select("*", F.posexplode(F.array(*columns)).alias("_pos", "_key"))
    values = right.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    found = lookup_join(cells, values, ["_key"]).groupBy(*counted.columns).agg(F.collect_list(F.struct("_pos", "_value")).alias("_found"))
    def values_at(pos: int) -> Column:
        return F.transform(F.filter("_found", lambda c: c["_pos"] == pos), lambda c: c["_value"])

    for i, name in enumerate(columns.values()):
        found = found.withColumn(name, F.explode(values_at(i)))
    return found.withColumn("_rows", F.explode(F.sequence(F.lit(1), F.col("_rows")))).drop("_rows", "_found")


def copies_of(right: DataFrame) -> int:
    """The tasks to which a key's rows are dealt, each with its copy of ``right``."""
    size = estimated_bytes(right)
    return SALTS if size is None else max(1, min(SALTS, COPY_BYTES // max(1, size)))


def match_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join rows to a table that may be as large as they are, such as one row per distinct text.

    Beyond the broadcast limit only hot keys are dealt to several tasks.  They
    are counted first, so ``left`` is read twice more for its keys; hand over a
    written table, and do not chain these joins.
    """
    return left.join(right, on, how) if fits_broadcast(left, right) else spread_join(left, right, on, how)


def _deal(on: list[str], salts: Column | int) -> Column:
    """A task number per row, from its keys and its input task; other columns are not read for it."""
    return F.pmod(F.xxhash64(*on, F.spark_partition_id()), salts if isinstance(salts, Column) else F.lit(salts)).cast("int")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Shuffle join (inner or left): each key's rows go to ``salts`` tasks, each with its copy of ``right``.

    Rows with a null key match nothing and are dealt to ``SALTS`` tasks at least.
    """
    _check_how(how)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    unmatched = reduce(Column.__or__, (F.col(k).isNull() for k in on))
    salt = F.when(unmatched, _deal(on, max(salts, SALTS))).otherwise(_deal(on, salts))
    return left.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def _check_how(how: str) -> None:
    if how not in ("inner", "left"):
        raise ValueError(f"only inner and left joins can be dealt out, not {how!r}")


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Hashes of the keys with at least ``hot_rows`` rows, counted exactly, and the tasks each is dealt to.

    A key goes to ``salts`` tasks, or to more, so that none gets over ``hot_rows`` of its rows.
    """
    counts = df.groupBy(F.xxhash64(*on).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_n"))
    tasks = F.greatest(F.lit(salts), F.ceil(F.col("_n") / hot_rows).cast("int"))
    return counts.where(F.col("_n") >= hot_rows).select("_hot_key", tasks.alias("_salts"))


def spread_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", salts: int = SALTS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Shuffle join (inner or left) in which only hot keys are salted.

    Rows of a hot key are dealt to as many tasks as it needs and the matching rows of
    ``right`` are repeated for each of them; all other keys are joined as they
    are.  Both sides look up the same exact hot set, so no match is lost.
    """
    _check_how(how)
    hot = F.broadcast(hot_keys(left, on, hot_rows, salts))
    dealt = (
        left.withColumn("_hot_key", F.xxhash64(*on))
        .join(hot, "_hot_key", "left")
        .withColumn("_salt", F.when(F.col("_salts").isNotNull(), _deal(on, F.col("_salts"))).otherwise(0))
        .drop("_hot_key", "_salts")
    )
    copies = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    repeated = (
        right.withColumn("_hot_key", F.xxhash64(*on))
        .join(hot, "_hot_key", "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_hot_key", "_salts")
    )
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def unique_cards(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards whose (lang, color, card_id) is unique, and the ids that are not.

    A doubled id has no single text, so its plays cannot be built; taking such
    cards out gives that result without multiplying rows.
    """
    keys = ["lang", "color", "card_id"]
    counted = cards.where(F.col("card_id").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), F.min("card_text").alias("card_text")
    )
    return counted.where("copies = 1").drop("copies"), counted.where("copies > 1").select(*keys, "copies")
