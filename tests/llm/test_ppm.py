import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from choicemeter.llm import ppm
from choicemeter.llm.common import utf8

from .cases import TEXTS, documents, sample


class PlainTree:
    """Counts by context in dictionaries; a byte's code is worked out context by context."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for text in texts:
            data = b"\n" * order + text.encode()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.after[data[i - k : i]][data[i]] += 1

    def bits(self, context, byte):
        cost, gone, unit = 0, set(), ppm.UNIT
        log = lambda x: round(math.log2(x) * unit)
        for k in range(self.order, -1, -1):
            seen = self.after.get(context[len(context) - k :])
            if not seen:
                continue
            left = {b: c for b, c in seen.items() if b not in gone}
            if not left:
                continue
            whole = log(sum(left.values()) + len(left))
            if byte in left:
                return cost + whole - log(left[byte])
            cost += whole - log(len(left))
            gone |= set(left)
        return cost + log(256 - len(gone))

    def length(self, text):
        data = b"\n" * self.order + text.encode()
        return sum(self.bits(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))


def plain(rows, order):
    """rows: (doc_id, text, lang)."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows]
    by_lang = defaultdict(list)
    for (_, text, lang), out in zip(rows, held, strict=True):
        if lang is not None and not out and text:
            by_lang[lang].append(text)
    trees = {lang: PlainTree(texts, order) for lang, texts in sorted(by_lang.items())}
    result = []
    for (i, text, _), out in zip(rows, held, strict=True):
        if not trees or not any(c.isalpha() for c in text or ""):
            result.append((i, out, "und", 0.0))
            continue
        bits = {lang: tree.length(text) for lang, tree in trees.items()}
        best = min(bits, key=lambda lang: (bits[lang], lang))
        result.append((i, out, best, 1 / sum(2.0 ** ((bits[best] - b) / ppm.UNIT) for b in bits.values())))
    return sorted(result, key=str)


def check(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-6)


@pytest.mark.parametrize("order, part, step", [(4, ppm.PART, ppm.STEP), (2, 40, 7), (0, 1, 1000), (5, 300, 64)])
def test_brute_force(spark, monkeypatch, order, part, step):
    monkeypatch.setattr(ppm, "STEP", step)
    texts = [t if t is None else t[:3000] for t in TEXTS]
    odd = ["der die das und ist", "the cat and the dog", "\n\n\nle chat", "12345 !!", "ß", "日本語", "the the", "the the"]
    docs = documents(spark, [*texts, *odd], [None, None, *range(len(texts) + len(odd) - 4), 0, 0])
    docs = docs.selectExpr("* except (lang)", "case n_chars % 4 when 0 then 'de' when 1 then 'en' when 2 then 'a b' end as lang").repartition(3)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    check(ppm.identify(docs, order, part).collect(), plain(rows, order))


@pytest.mark.parametrize("part", [ppm.PART, 2000])
def test_sample(spark, part):
    docs = sample(spark, 60)
    rows = [(r.doc_id, (r.text or "")[:4000], r.lang) for r in docs.collect()]
    docs = docs.selectExpr("doc_id", "substring(text, 1, 4000) as text", "lang")
    check(ppm.identify(docs, 3, part).collect(), plain(rows, 3))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ppm.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    right = sum(r.lang == r.lang_pred for r in rows) / len(rows)
    assert len(rows) > 100 and right > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn(spark):
    docs = documents(spark, ["a text", "b", None])
    rows = ppm.identify(docs.selectExpr("* except (lang)", "cast(null as string) as lang")).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)} and len(rows) == 3
    assert ppm.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in ppm.identify(documents(spark, ["", None])).collect()} == {"und"}


def test_codes_fill_the_unit_interval():
    """The shares 2 ** -bits of all bytes after a context add up to 1, or less where every byte is known."""
    rng = random.Random(3)
    data, offsets = utf8(pa.array(["".join(rng.choice("abcdé ") for _ in range(300)) for _ in range(5)]))
    keys, counts = np.unique(ppm.runs(data, offsets, 4, 0, len(data))[0], return_counts=True)
    tree = ppm.Tree(keys, counts, np.bincount(data, minlength=256), 4)
    for context in (0x61626364, 0x0A0A0A0A, 0x7A7A7A7A, 0x7A7A6162):
        bits = tree.costs((context << 8) + np.arange(256)) / ppm.UNIT
        assert abs((2.0**-bits).sum() - 1) < 1e-3
