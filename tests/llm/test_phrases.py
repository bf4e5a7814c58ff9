import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from choicemeter.llm import phrases

from tests.frames import frame

from .cases import TEXTS, documents, sample


def plain(rows, least, most, top, cover=50):
    """rows: (lang, text).  Counts of all phrases, every cut and every longer phrase."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, most + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right, p))
        inside = Counter()
        for p, a in f.items():
            if a >= least:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = sorted(x for x in found if 100 * inside[x[-1]] < cover * -x[1])
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(found[:top])]
    return sorted(out)


def of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, most, top, held", [(2, 3, 2000, 1 << 22), (1, 4, 40, 97), (3, 2, 7, 1000), (2, 1, 5, 50)])
def test_brute_force(spark, monkeypatch, least, most, top, held):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "CUT", 64 if held < 1000 else 1 << 20)
    monkeypatch.setattr(phrases, "HOT", 50 if held < 1000 else 5000)
    odd = ["a b, a b. A B! a\tb  a b:c", "x\x1cy z\x85w \xa0 x\x1cy z", "ÀB àb Ab", "é\x00 é\x00 é\x00 é\x00", "w " * 300, "a b c a b c\rd a b c", "?!", "\t \n"]
    texts = [*TEXTS, *odd, *odd[:3]]
    docs = documents(spark, texts, [None, *range(len(texts) - 1)]).selectExpr("* except (lang)", "case n_chars % 3 when 0 then 'und' when 1 then 'en' end as lang")
    want = plain([(r.lang, r.text) for r in docs.collect()], least, most, top)
    got = of(phrases.phrases(docs.repartition(3), least, most, top))
    assert got == want and (want or most == 1)


def test_sample(spark):
    docs = sample(spark)
    want = plain([(r.lang, r.text) for r in docs.collect()], phrases.LEAST, phrases.MOST, phrases.TOP)
    assert of(phrases.phrases(docs)) == want and want
    assert phrases.phrases(docs.where("false")).count() == 0


def test_sample_without_broadcast(spark, shuffle_joins):
    docs = sample(spark)
    want = plain([(r.lang, r.text) for r in docs.collect()], 5, 3, 50)
    assert of(phrases.phrases(docs, 5, 3, 50)) == want


def test_products_beyond_64_bits(spark):
    counts = [("en", "", "a", 5 * 10**14), ("en", "", "b", 5 * 10**14 + 1), ("en", "a", "b", 4 * 10**14 + 7)]
    saved, phrases.phrase_counts = phrases.phrase_counts, lambda docs, *_: docs
    try:
        docs = spark.createDataFrame(pa.Table.from_pylist([dict(zip(("lang", "prefix", "next", "count"), c, strict=True)) for c in counts]))
        row = phrases.phrases(docs).first()
    finally:
        phrases.phrase_counts = saved
    left, right, a = (c[3] for c in counts)
    assert (row.a, row.l, row.r, row.n, row.score) == (a, left, right, left + right, 10**6 * a * a // (left * right))


def test_bit_map(spark):
    rows = [("en", ["a"]), ("en", ["a", "b"]), ("de", ["a", "b", "\u00e9"])]
    have = phrases.bit_map(frame(spark, rows, "lang string, words array<string>"))
    hashed = lambda x: xxhash.xxh64_intdigest(x.encode(), 42)
    for lang, words in [*rows, ("fr", ["a"]), ("en", ["b", "a"])]:
        code = np.array([hashed(lang)], np.uint64)
        for w in words:
            code = phrases.lengthened(code, np.array([hashed(w)], np.uint64))
        assert (int(code[0]) in have) == ((lang, words) in rows)


def test_a_long_text_is_cut_between_words():
    parts = list(phrases.cuts(b"aa bb\xffcc dddddddd e", 4))
    assert b"".join(parts) == b"aa bb\xffcc dddddddd e" and len(parts) > 2
    assert all(p[:1] in (b"a", b" ", b"\xff") for p in parts)
