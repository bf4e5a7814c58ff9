"""Calls of slow services that survive a failure: replies are kept slice by slice.

The rows to ask are dealt into slices by a digest of the call.  A slice's replies
are appended to a store in one job, so they are either all there or not at all; before a
slice is asked, calls that the store holds are taken out by an anti-join.  A run that
is repeated after a failure therefore asks again only for the slice that failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicemeter.session import scratch_dir

SLICES = 8


def stored(df: DataFrame, store: str) -> DataFrame:
    """The replies in a store, ``_call`` and the columns of ``df``; none if there is no store yet."""
    schema = T.StructType([*df.schema.fields, T.StructField("_call", T.StringType())])
    try:
        return df.sparkSession.read.schema(schema).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return df.sparkSession.createDataFrame([], schema)


def ask_in_slices(asked: DataFrame, ask: Callable[[DataFrame], DataFrame], store: str, slices: int = SLICES) -> DataFrame:
    """What ``ask`` makes of all rows, each row asked once per store.

    ``ask`` takes some of the rows and returns a row for each, with ``_call``, the digest of
    the row that it was given, carried along.  Rows that are equal in all columns are
    one call, and come back as often as they were asked.
    """
    spark = asked.sparkSession
    digest = F.sha2(F.to_json(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(asked.columns))), {"ignoreNullFields": "false"}), 256)
    folder = f"{scratch_dir(spark, 'calls')}/calls"
    asked.withColumn("_call", digest).write.parquet(folder)
    rows = spark.read.schema(asked.withColumn("_call", digest).schema).parquet(folder)
    calls = rows.dropDuplicates(["_call"])
    shape = ask(calls.where("false")).drop("_call")
    for i in range(slices):
        due = calls.where(F.pmod(F.xxhash64("_call"), F.lit(slices)) == i).join(stored(shape, store).select("_call"), "_call", "left_anti")
        ask(due).select(*shape.columns, "_call").write.mode("append").parquet(store)
    return rows.select("_call").join(stored(shape, store), "_call").drop("_call")
