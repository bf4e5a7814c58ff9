"""Writing of results, partitioned by run."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemeter.functions.text import run_id_from_name
from choicemeter.names import ATTRIBUTES
from choicemeter.operators import distribution, states

# Folders below a table's that Spark's readers pass over.
ATTEMPTS, PUBLISHED = "_attempts", "_published"
MANIFEST = "values string, attempt string, at long"


def write_partitioned(df: DataFrame, path: str, by: list[str], file_type: str = "parquet") -> None:
    """Write a table with one folder per value of ``by``.

    Rows are rebalanced on the partition columns first: small partitions go to
    few files and a large one is split over tasks by size.  Only the partitions
    present in ``df`` are replaced, so repeating a run's stage is safe.
    """
    balanced = df.hint("rebalance", *by)
    writer = balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    if file_type == "csv":
        writer.options(header=True, escape='"').csv(path)
    elif file_type == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def write_part(df: DataFrame, path: str, **values: str) -> None:
    """Write one partition and publish it.

    Rows go to a folder of this attempt.  Only when all are there does a row of the
    manifest name the attempt as the partition's, so a reader, and a writer that fails
    half-way, leave the partition as it was; also a table without rows replaces it.
    Attempts that are no longer named stay; ``unpublished`` lists them.  A task's rows are
    written as they come, without a shuffle of whole rows: equal texts that a join has
    brought together stay together.
    """
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/{ATTEMPTS}/{attempt}")
    keys = json.dumps(values, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(keys, attempt, time.time_ns())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/{PUBLISHED}")


def published(spark: SparkSession, path: str) -> DataFrame:
    """(values, attempt): the attempt that stands for each partition, the one published last."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/{PUBLISHED}")
    return rows.groupBy("values").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))


def read_parts(spark: SparkSession, path: str, **values: str) -> DataFrame:
    """The published partitions that have these values, with the partition's values as columns.

    Attempts are few: one for each partition.  Their schemas are merged.
    """
    rows = [(json.loads(r["values"]), r.attempt) for r in published(spark, path).collect()]
    some = [(have, attempt) for have, attempt in rows if all(have.get(k) == v for k, v in values.items())]
    names = list(dict.fromkeys(k for have, _ in rows for k in have))
    if not some:
        some = [({}, attempt) for _, attempt in rows]
    folders = [f"{path}/{ATTEMPTS}/{attempt}" for _, attempt in some]
    attempt = F.regexp_extract("_metadata.file_path", f"/{ATTEMPTS}/([0-9a-f]+)/", 1)
    found = F.create_map(*(F.lit(x) for have, a in some for x in (a, json.dumps(have))))
    df = spark.read.options(mergeSchema=True).parquet(*folders).withColumn("_values", F.try_element_at(found, attempt))
    if not some[0][0]:
        df = df.where("false")
    return df.withColumns({n: F.get_json_object("_values", f"$.{n}") for n in names}).drop("_values")


def unpublished(spark: SparkSession, path: str) -> list[str]:
    """The folders of attempts that no partition names, for the caller to remove once no reader uses them."""
    named = {r.attempt for r in published(spark, path).collect()}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/{ATTEMPTS}")
    attempts = files.select(F.regexp_extract("path", f"/{ATTEMPTS}/([0-9a-f]+)/", 1).alias("attempt")).distinct().collect()
    return sorted(f"{path}/{ATTEMPTS}/{r.attempt}" for r in attempts if r.attempt not in named)


def write_responses(responses: DataFrame, root: str, run_id: str) -> None:
    write_part(responses, f"{root}/raw_responses", run_id=run_id)


def write_rejects(rejects: DataFrame, root: str, run_id: str, reason: str) -> None:
    """Keep rejected rows by run; the table is named after the reason, which is a column, too.

    The few rows of many tasks are put into few files.
    """
    named = rejects.withColumn("reason", F.lit(reason)) if "reason" not in rejects.columns else rejects
    write_part(named.hint("rebalance"), f"{root}/rejects_{reason}", run_id=run_id)


def write_sentences(sentences: DataFrame, root: str, run_id: str, kind: str) -> None:
    """Winners and combinations are separate tables."""
    write_part(sentences, f"{root}/{kind}", run_id=run_id)


def write_scores(scored: DataFrame, root: str, run_id: str, kind: str, classifier: str) -> None:
    """One table per kind for all runs and classifiers, with every attribute; those a classifier lacks are null.

    ``scored_files`` notes what was scored, so that a run without rows is not forgotten.
    """
    missing = {a: F.lit(None).cast("double") for a in ATTRIBUTES if a not in scored.columns}
    whole = scored.withColumns({a: F.col(a).cast("double") for a in ATTRIBUTES if a in scored.columns} | missing)
    write_part(whole, f"{root}/scored_{kind}", classifier=classifier, run_id=run_id)
    note = scored.sparkSession.range(1).select(F.current_timestamp().alias("written"))
    write_part(note, f"{root}/scored_files", kind=kind, classifier=classifier, run_id=run_id)


def write_states(scored: DataFrame, root: str, run_id: str, kind: str, classifier: str) -> None:
    """Keep the aggregate states of one run's scores, so that analyses of all runs need not read them again."""
    found = states.score_states(distribution.with_clean_config(scored), states.STATE_KEYS, ATTRIBUTES)
    write_part(found, f"{root}/score_states", kind=kind, classifier=classifier, run_id=run_id)


def write_manifest(configs: DataFrame, path: str) -> None:
    """Store run configurations: ``configs`` has run_id and ``value``, the JSON text.

    Each run gets a folder ``run_id=<id>`` with one text file.
    """
    named = configs.where(run_id_from_name(F.col("run_id")).isNotNull())
    writer = named.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").text(path)
