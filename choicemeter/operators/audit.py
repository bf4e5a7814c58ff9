"""Checks of the input data: frequencies, uniformity, correlation, descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemeter.functions import text
from choicemeter.functions.stats import chi_square_p

ALPHA = 0.05
NO_PATTERN = 0.05
ID_BLOCK = 65536
# Tasks that fill up the ids nobody was assigned, at least.
FILL_TASKS = 200
# Characters of a text that are shuffled with its digest.
HEAD = 32
# Values a column that are counted exactly, counters of a column, and the deviation of the number of distinct values.
CANDIDATES = 1000
BUCKETS = 65536
UNIQUE_ERROR = 0.01


def filled_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): every filled cell of ``columns`` as text."""
    cells = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "column", "value")
    return cells.where(F.col("value").isNotNull())


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: filled values, distinct values, the most frequent one and its count.

    Of equally frequent values the smallest is shown.  Values are counted by their MD5
    digest, and only the beginnings of texts are shuffled with it.  The smallest of the most frequent
    values has the smallest beginning, so whole texts are looked at again only where a
    value begins like that and is as frequent.
    """
    cells = filled_values(df, columns)
    digest = F.unhex(F.md5("value")).alias("_digest")
    counted = cells.groupBy("column", digest).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.substring("value", 1, HEAD)).alias("_head")
    )
    described = counted.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.max("n").alias("freq"),
        F.min(F.struct(-F.col("n"), "_head")).alias("_first"),
    )
    # One row per column.
    like = F.broadcast(described.select("column", F.col("_first._head").alias("_head"), "freq"))
    tied = counted.withColumnRenamed("n", "freq").join(like, ["column", "_head", "freq"], "left_semi")
    starts = cells.join(like.drop("freq"), "column").where(F.col("value").startswith(F.col("_head")))
    top = (
        starts.select("column", "value", digest)
        .join(tied.select("column", "_digest"), ["column", "_digest"], "left_semi")
        .groupBy("column")
        .agg(F.min("value").alias("top"))
    )
    return described.join(F.broadcast(top), "column").select("column", "count", "unique", "top", "freq")


def describe_frequent(
    df: DataFrame, columns: Sequence[str], candidates: int = CANDIDATES, buckets: int = BUCKETS, error: float = UNIQUE_ERROR
) -> DataFrame:
    """``describe_text`` from sketches: nothing is shuffled that grows with the number of distinct values.

    Columns: column, count, unique (HyperLogLog++, relative deviation ``error``), top, freq,
    others (no other value occurs more often than that) and settled.  A sketch of frequent items
    names up to ``candidates`` values a column (each with over 1 / ``candidates`` of the cells
    is among them), which are then counted exactly.  Every value
    also adds to one of ``buckets`` counters by its hash, and what a counter holds beyond the
    candidates in it bounds every value that is none.  ``settled``: all of these bounds are
    below ``freq``, so top and freq are those of ``describe_text``.  Otherwise the column has
    no value that stands out, and top is the best candidate, or null.

    ``df`` is read three times; a task shuffles ``buckets`` counters a column at most.
    """
    cells = filled_values(df, columns).withColumn("_hash", F.xxhash64("value"))
    bucket = F.pmod("_hash", F.lit(buckets)).alias("_bucket")
    frequent = F.expr(f"approx_top_k(_hash, {int(candidates)}, {10 * int(candidates)})")
    whole = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"),
        F.approx_count_distinct("_hash", error).alias("unique"),
        F.transform(frequent, lambda x: x["item"]).alias("_likely"),
    )
    # At most ``candidates`` hashes a column.
    likely = F.broadcast(whole.select("column", F.explode("_likely").alias("_hash")))
    counted = cells.join(likely, ["column", "_hash"]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("top"), F.max("n").alias("freq"))
    ranked = counted.withColumn("_hash", F.xxhash64("value"))
    taken = ranked.groupBy("column", bucket).agg(F.sum("n").alias("_taken"))
    held = cells.groupBy("column", bucket).agg(F.count(F.lit(1)).alias("_held"))
    beyond = F.col("_held") - F.coalesce("_taken", F.lit(0))
    rest = held.join(taken, ["column", "_bucket"], "left").groupBy("column").agg(F.max(beyond).alias("others"))
    joined = whole.drop("_likely").join(F.broadcast(best), "column", "left").join(F.broadcast(rest), "column")
    settled = F.coalesce(F.col("others") < F.col("freq"), F.lit(False))
    return joined.withColumn("settled", settled)


def audit_blank_count(black_cards: DataFrame) -> DataFrame:
    """Whether every template has exactly one blank."""
    blanks = text.blank_count("card_text")
    return black_cards.agg(
        F.min(blanks).alias("fewest"), F.max(blanks).alias("most"), F.bool_and(blanks == 1).alias("all_single")
    )


def audit_group_size(rows: DataFrame, key: str = "black_id", size: int = 5) -> DataFrame:
    """Whether every key has exactly ``size`` rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("groups"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        F.bool_and(F.col("n") == size).alias("all_equal"),
    )


def used_ids(rows: DataFrame, key: str = "white_id") -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(key).distinct()


def cards_used(cards: DataFrame, rows: DataFrame) -> DataFrame:
    """The cards whose ids occur in ``rows``; the ids are distinct, so no card is repeated."""
    ids = used_ids(rows).select(F.col("white_id").alias("card_id"))
    return cards.join(ids, "card_id", "left_semi")


def id_blocks(sets: DataFrame, id_count: Column | int) -> DataFrame:
    """Every row of ``sets`` with ``_block`` and the block's first id and the one behind its last, for ids from 1 to ``id_count``."""
    last = (id_count if isinstance(id_count, Column) else F.lit(id_count)).cast("bigint")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((last - 1) / ID_BLOCK))
    start = F.col("_block") * ID_BLOCK + 1
    dealt = sets.where(last >= 1).withColumn("_block", F.explode(blocks))
    return dealt.withColumns({"white_num": start, "_end": F.least(start + ID_BLOCK, last + 1)})


def frequency_zero_filled(assignments: DataFrame, id_count: Column | int, by: str = "config", tasks: int | None = None) -> DataFrame:
    """Per set: how often each id from 1 to ``id_count`` was assigned, 0 included.

    ``assignments`` has ``by`` and white_num, a whole number.  The result has a row per set and id,
    whatever was assigned, so only the assigned ids and the first of each block are shuffled, to
    ``tasks`` tasks (``FILL_TASKS`` at least, or the session's number), block by block.  Each of
    these ids is then unfolded up to the next one of its block.
    """
    counts = (
        assignments.dropna(subset=[by, "white_num"]).groupBy(by, "white_num").agg(F.count(F.lit(1)).alias("n"))
    )
    # A condition on the count, as otherwise the sets would be an aggregate of their own over the rows.
    sets = counts.groupBy(by).agg(F.max("n").alias("_most")).where("_most > 0").select(by)
    firsts = id_blocks(sets, id_count)
    block = F.floor((F.col("white_num") - 1) / ID_BLOCK)
    used = counts.withColumn("white_num", F.col("white_num").cast("bigint"))
    marks = firsts.select(by, "_block", "white_num", F.lit(0).cast("bigint").alias("n"), "_end").unionByName(
        used.select(by, block.alias("_block"), "white_num", "n", F.lit(None).cast("bigint").alias("_end"))
    )
    # The number is given, as the rows behind the shuffle are not in proportion to its bytes.
    tasks = tasks or max(FILL_TASKS, int(assignments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = marks.repartition(tasks, by, "_block").groupBy(by, "_block", "white_num").agg(F.sum("n").alias("n"), F.max("_end").alias("_end"))
    of_block = Window.partitionBy(by, "_block")
    # Ids beyond the range lie in blocks without an end, or behind it.
    inside = dealt.withColumn("_end", F.max("_end").over(of_block)).where(F.col("white_num") < F.col("_end"))
    behind = F.lead("white_num").over(of_block.orderBy("white_num"))
    spans = inside.withColumn("_next", F.coalesce(behind, F.col("_end")))
    ids = F.posexplode(F.sequence("white_num", F.col("_next") - 1)).alias("_pos", "_id")
    return spans.select(by, "n", ids).select(by, F.col("_id").alias("white_num"), F.when(F.col("_pos") == 0, F.col("n")).otherwise(F.lit(0)).alias("n"))


def chi_square_uniform(assignments: DataFrame, id_count: Column | int, by: str = "config") -> DataFrame:
    """Goodness of fit of assigned ids against the uniform distribution: statistic, degrees, p and verdict.

    Ids that do not occur add nothing to the sum of squares, so only those that do are counted.
    """
    counts = assignments.dropna(subset=[by, "white_num"]).groupBy(by, "white_num").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("_squares"))
    ids = (id_count if isinstance(id_count, Column) else F.lit(id_count)).cast("bigint")
    statistic = F.try_divide(F.col("_squares") * ids, F.col("total")) - F.col("total")
    tested = sums.select(by, "total", (ids - 1).alias("degrees"), statistic.alias("statistic"))
    return tested.withColumn("p_value", chi_square_p("statistic", "degrees")).withColumn(
        "uniform", F.col("p_value") >= ALPHA
    )


def id_correlation(assignments: DataFrame, by: str = "config") -> DataFrame:
    """Pearson correlation of black and white numbers per set; null when one is constant."""
    spread = F.stddev_pop("black_num") * F.stddev_pop("white_num")
    value = F.try_divide(F.covar_pop("black_num", "white_num"), F.nullif(spread, F.lit(0.0)))
    return assignments.groupBy(by).agg(value.alias("correlation")).withColumn(
        "no_pattern", F.abs("correlation") < NO_PATTERN
    )
