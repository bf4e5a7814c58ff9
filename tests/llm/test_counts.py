import re
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from choicemeter.llm import quality, repetition, simhash
from choicemeter.llm.common import utf8
import pyarrow as pa

from .cases import TEXTS, documents, sample

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORDS.findall(text)
    runs = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            dup_chars += len(line) if line in seen else 0
            seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(hit), "line_chars": dup_chars}
    for n in repetition.LIMITS:
        runs = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = {i + j for i in range(len(words) - n + 1) if runs[tuple(words[i : i + n])] > 1 for j in range(n)}
        out[f"run_{n}_chars"] = sum(len(words[i]) for i in hit)
    return out


def test_repetition_brute_force(spark):
    run = " ".join("word" * 5 + chr(97 + i) for i in range(10))
    plain_words = " ".join(f"{i}x" for i in range(40))
    # few repeated words, but most of the characters; a run of five words only; a repeated line
    heavy = [f"{run} {plain_words} {run}", f"{run[:104]} {plain_words} {run[:104]}", f"{plain_words}\n{run[:62]}\n{plain_words[:30]}\n{run[:62]}"]
    docs = documents(spark, [*TEXTS, *heavy]).unionByName(sample(spark).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", "1 as n", "'k' as key"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = repetition.repetition(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_counts(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, r.doc_id
        assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        within = want["line_chars"] <= repetition.LINE_LIMIT * want["word_chars"]
        within = within and all(want[f"run_{n}_chars"] <= limit * want["word_chars"] for n, limit in repetition.LIMITS.items())
        assert r.kept == (within and not r.base_failed), r.doc_id
    assert {r.kept for r in rows} == {True, False} and any(not r.kept and not r.base_failed for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é\t", max_size=60), max_size=5))
def test_repetition_any_texts(texts):
    found = repetition.measure(*utf8(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        want = plain_counts(text)
        assert {k: found[k][i] for k in want} == want


def plain_statistics(text):
    """The classifier's statistics of one text, counted byte by byte."""
    data = (text or "").encode()
    of = lambda group: sum(b in group for b in data)
    words, lines, n = data.split(), data.split(b"\n"), len(data)
    solid, w = max(1, n - of(b" \t\n\r\x0b\x0c")), max(1, len(words))
    upper, digits, lower = of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of(b"0123456789"), sum(97 <= b <= 122 or b >= 128 for b in data)
    shares = [upper / solid, digits / solid, of(b"#*$%&<>@^~=+_\\") / solid, of(b"!?") / solid, of(b".") / w, of(b",;:") / w, of(b"|") / solid, data.count(b"\n") / w]
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(solid / w), *np.sqrt(shares),
        np.sqrt(1 - len(set(lines)) / len(lines)), len(set(words)) / w * np.log1p(len(words)), np.sqrt(lower / max(1, n)),
    ]


def test_statistics_brute_force(spark):
    texts = [t or "" for t in TEXTS] + [r.text or "" for r in sample(spark).limit(60).collect()] + ["A!B?c.,;:|\n\n#<>\\", "\n" * 5, "É é 12"]
    found = quality.statistics(*utf8(pa.array(texts)))
    assert found.shape == (len(texts), quality.N)
    for row, text in zip(found, texts, strict=True):
        assert np.allclose(row, plain_statistics(text), rtol=1e-12, atol=1e-12), text[:40]


def plain_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_brute_force(spark):
    docs = documents(spark).unionByName(sample(spark).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", "1 as n", "'k' as key"))
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [plain_fingerprint(t) for _, t in texts]
    want = {texts[i][0]: (fps[i], texts[r][0]) for i, r in enumerate(plain_components(fps))}
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in rows} == want and len(rows) == len(texts)
    stay = simhash.keep_first(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_simhash_nulls_and_repeats(spark):
    docs = documents(spark, ["x y z", "x y z", "x y z", None, "", "q r s t"], [7, 7, None, None, None, 1])
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows if r.component_id is not None) == [(False, 1), (False, 7), (False, 7), (True, 7)]
    assert sorted(r.doc_id or -1 for r in simhash.keep_first(docs).collect()) == [-1, -1, -1, 1, 7]
    # one doc_id, two texts, of which one is a copy of another document's
    docs = documents(spark, ["a b c", "a b c", "d e f", "d e f", "g h i"], [1, 5, 5, 6, 6])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_first(docs).collect()) == [(1, "a b c"), (5, "d e f"), (6, "g h i")]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_links_with_large_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(-(1 << 63), 1 << 63, 6)
    fps = set(map(int, rng.integers(-(1 << 63), 1 << 63, 300)))
    for c in centre:
        for _ in range(200):
            x = int(c)
            for b in rng.integers(0, 63, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    want = plain_components([f % (1 << 64) for f in fps])
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for split in (4096, 3):
        monkeypatch.setattr(simhash, "SPLIT", split)
        root = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
        assert [root.get(f, f) for f in fps] == [fps[r] for r in want]


def test_forest_has_no_more_links_than_needed():
    fps = np.arange(1 << 12, dtype=np.int64)
    assert len(list(simhash.forest(fps, 2))) == len(fps) - 1


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    auc = (good[:, None] > bad[None, :]).mean()
    assert auc > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_equals_plain_numpy(spark):
    docs = sample(spark)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    import zlib

    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = docs.orderBy("doc_id").collect()
    x = quality.statistics(*utf8(pa.array([r.text for r in rows])))
    logs = []
    pick = {k: x[[known.get(r.doc_id) == k for r in rows]] for k in (0, 1)}
    for k in (0, 1):
        cov = np.cov(pick[k].T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-4 * np.eye(quality.N)
        d = x - pick[k].mean(0)
        logs.append(np.log(len(pick[k])) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    want = 1 / (1 + np.exp((logs[0] - logs[1]) * 0.5))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=1e-6)


def test_quality_odd_tables(spark):
    docs = documents(spark, [*TEXTS, "x"], [*range(len(TEXTS)), None])
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 1), (1, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, labels).collect()} == {1.0}
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(docs.where("false"), labels).count() == 0
    two = labels.union(spark.createDataFrame([(6, 0, 0), (10, 0, 0)], labels.schema))
    rows = quality.classify(docs, two).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in rows)
