"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemeter.llm import decontamination, line_runs, oracle, packing, phrases, ppm, prefix_tokens, quality, repetition, secrets, simhash, suffixes, webpage, whitening
from choicemeter.llm.common import table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(oracle.SQL)


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_quality(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op3_decontamination(spark, sf):
    return decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op4_repetition(spark, sf):
    return repetition.repetition(table(spark, sf, "documents"))


@query
def op5_secrets(spark, sf):
    return secrets.scan(table(spark, sf, "documents"))


@query
def op6_line_runs(spark, sf):
    found = line_runs.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id",
        F.col("_ld_n_lines").alias("n_lines"),
        F.col("_ld_n_removed").alias("n_removed"),
        F.length(kept).cast("long").alias("kept_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


@query
def op7_html(spark, sf):
    return webpage.extract(table(spark, sf, "pages"))


@query
def op8_tokens(spark, sf):
    return prefix_tokens.token_counts(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op9_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_suffixes(spark, sf):
    return suffixes.dedup_bytes(table(spark, sf, "documents"))


@query
def op11_whitening(spark, sf):
    return whitening.whitened(table(spark, sf, "embeddings"))


@query
def op12_language(spark, sf):
    return ppm.identify(table(spark, sf, "documents"))


@query
def op13_phrases(spark, sf):
    return phrases.phrases(table(spark, sf, "documents"))
