"""The pipeline, stage by stage, against the brute-force versions of its operators."""

import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from choicemeter.llm import line_runs, quality
from choicemeter.llm.common import utf8

from .cases import TEXTS, documents
from .test_counts import plain_components, plain_fingerprint
from .test_native import plain_contamination, plain_line_runs
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def plain_accepted(rows, labels):
    x = quality.statistics(*utf8(pa.array([t or "" for _, t in rows])))
    known = {i: q for i, q in labels if zlib.crc32(str(i).encode()) % 5}
    logs = []
    for k in (0, 1):
        mine = x[[known.get(i) == k for i, _ in rows]]
        cov = np.cov(mine.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-4 * np.eye(quality.N)
        d = x - mine.mean(0)
        logs.append(np.log(len(mine)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    return {i for (i, _), a, b in zip(rows, *logs) if 1 / (1 + np.exp(np.clip((a - b) * 0.5, -700, 700))) >= 0.3}


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "simhash", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    before = texts(docs)
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]

    docs1 = stages["quality"](spark, docs, SF).cache()
    accepted = plain_accepted(before, labels)
    assert docs1.columns == docs.columns
    assert texts(docs1) == [r for r in before if r[0] in accepted] and 0 < len(accepted) < len(before)

    docs2 = stages["line_dedup"](spark, docs1, SF).cache()
    assert docs2.columns == docs.columns
    assert texts(docs2) == [(i, t) for i, t, _, _ in plain_line_runs(texts(docs1), line_runs.MIN_CHARS)]
    assert all(r.n_chars == len(r.text) for r in docs2.collect())

    docs3 = stages["simhash"](spark, docs2, SF).cache()
    rows = texts(docs2)
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    assert texts(docs3) == [rows[i] for i, r in enumerate(roots) if i == r] and docs3.columns == docs.columns

    docs4 = stages["decontamination"](spark, docs3, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in plain_contamination(texts(docs3), items) if r[5]}
    assert texts(docs4) == [r for r in texts(docs3) if r[0] not in bad] and bad and docs4.columns == docs.columns

    pieces = stages["packing"](spark, docs4, SF).collect()
    check_packing(pieces, texts(docs4), 2048, 16)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in whole.collect()) and {r.doc_id for r in whole.collect()} == {i for i, _ in texts(docs4)}


def test_stages_with_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage."""
    docs = documents(spark, [*TEXTS, TEXTS[6], "x"], [*range(len(TEXTS)), 6, None])
    for none in (False, True):
        some = docs.where("false") if none else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, SF)
            assert some.columns == docs.columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, some, SF).collect()
        assert none == (not pieces)
