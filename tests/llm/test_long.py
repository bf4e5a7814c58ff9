"""Texts of hundreds of kilobytes: one word, one line, very many lines; results against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from choicemeter.llm import decontamination, line_runs, packing, ppm, prefix_tokens, quality, repetition, simhash, suffixes
from choicemeter.llm.common import tokenizer_path, utf8
from tests.frames import frame

from .cases import documents, sample
from .test_counts import plain_counts, plain_fingerprint, plain_statistics
from .test_native import plain_contamination
from .test_suffixes import plain as plain_suffixes
from .test_tokens import check_packing

RNG = random.Random(8)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(RNG.randint(2, 9))) for _ in range(20_000)]
ONE_LINE = " ".join(RNG.choice(VOCABULARY) for _ in range(60_000))
MANY_LINES = "\n".join(" ".join(RNG.choice(VOCABULARY[:300]) for _ in range(RNG.randint(0, 9))) for _ in range(12_000))
PASSAGE = " ".join(VOCABULARY[:60])
TEXTS = [ONE_LINE, f"{PASSAGE} end", "a" * 300_000, "a." * 100_000, MANY_LINES, f"{MANY_LINES[:5000]}\n{PASSAGE}\n{ONE_LINE[-100_000:]}", "\n" * 100_000, " x" * 60_000, "short"]
WHOLE = list(enumerate(TEXTS))


@pytest.fixture
def docs(spark):
    return documents(spark, TEXTS).repartition(3)


def test_repetition(docs):
    for r in repetition.repetition(docs).collect():
        want = plain_counts(TEXTS[r.doc_id])
        assert {k: r[k] for k in want} == want, r.doc_id


def test_quality(spark, docs):
    found = quality.statistics(*utf8(pa.array(TEXTS)))
    for row, text in zip(found, TEXTS, strict=True):
        assert np.allclose(row, plain_statistics(text), rtol=1e-9, atol=1e-9)
    labels = frame(spark, [(i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    scores = quality.classify(docs, labels).collect()
    assert len(scores) == len(TEXTS) and all(0 <= r.score <= 1 for r in scores)


def test_simhash(docs):
    found = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: plain_fingerprint(t) for i, t in WHOLE}


def test_bytes(docs):
    assert sorted(tuple(r) for r in suffixes.dedup_bytes(docs).collect()) == plain_suffixes(WHOLE)


def test_tokens(docs):
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in WHOLE}
    assert {r.doc_id: r.n_tokens for r in prefix_tokens.token_counts(docs, path).collect()} == want


def test_packing(docs):
    check_packing(packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect(), WHOLE, 2048, 16, queues_mixed=False)


def test_contamination(spark, docs):
    items = [(1, PASSAGE), (2, ONE_LINE[200_000:201_000]), (3, "a " * 20), (4, " ".join(["x"] * 20)), (5, "nothing of the kind")]
    found = decontamination.contamination(docs, frame(spark, items, "item_id long, text string")).collect()
    want = plain_contamination(WHOLE, items)
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_line_runs(spark):
    lines = [f"{i} {VOCABULARY[i]} {VOCABULARY[-i]} is a line" for i in range(8000)]
    new = "z" * 300_000
    texts = ["\n".join(lines), "\n".join([*lines[:3000], new, *lines[5000:], "end"]), f"{new}\nx", "\n" * 100_000]
    rows = line_runs.dedup_lines(documents(spark, texts)).select("text", "_ld_n_lines", "_ld_n_removed").collect()
    want = [(texts[0], 8000, 0), (f"{new}\nend", 6002, 6000), ("x", 2, 1), (texts[3], 0, 0)]
    assert sorted(tuple(r) for r in rows) == sorted(want)


def test_language(spark):
    known = sample(spark).where("lang is not null")
    long = known.groupBy("lang").agg(F.repeat(F.array_join(F.collect_list("text"), " "), 3).alias("text"))
    rows = long.select(F.crc32("lang").alias("doc_id"), "text", "lang")
    found = ppm.identify(known.select("doc_id", "text", "lang").union(rows))
    right = found.join(rows.select("doc_id", "lang"), "doc_id").where("lang_pred = lang")
    assert right.count() == rows.count() > 1
