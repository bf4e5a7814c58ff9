"""Helpers shared by the operators: written tables, Arrow text as bytes, tokenizer files."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from choicemeter.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frozen(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a table that survives lost executors, and gives Spark the
    true size of the table for its choice of joins.
    """
    path = f"{scratch_dir(df.sparkSession, label)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its len + 1 offsets; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text has at most ``limit`` bytes, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size) if len(size) else size
    begin = 0
    while begin < len(size):
        before = run[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(run, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def per_process(key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, once in each worker process, whatever number of tasks it runs.

    Held outside this package, so that it never travels with a job's functions.
    """
    held = sys.modules.setdefault("_choicemeter_held", types.ModuleType("_choicemeter_held")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]
