import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from choicemeter.llm import packing, prefix_tokens
from choicemeter.llm.common import tokenizer_path

from .cases import TEXTS, documents, sample

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def test_counts_equal_the_library(spark, library):
    docs = documents(spark).unionByName(sample(spark).selectExpr("*", "1 as n", "'k' as key"))
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = sorted((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    rows = prefix_tokens.token_counts(docs, BYTE).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é'sreld 1\n\t #你<|endoftext|>　\x1c")), max_size=40))
def test_every_prefix(text):
    own, library = prefix_tokens.counter(BYTE), Tokenizer.from_file(BYTE) if not hasattr(test_every_prefix, "lib") else test_every_prefix.lib
    test_every_prefix.lib = library
    prefix = own.prefix(text)
    for chars in range(len(text) + 1):
        assert prefix.at(chars) == len(library.encode(text[:chars], add_special_tokens=False).ids), (text, chars)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é'sreld 1\n\t #你<|endoftext|>　\x1c")), max_size=30), st.integers(0, 12))
def test_every_budget(text, budget):
    prefix = prefix_tokens.counter(BYTE).prefix(text)
    fits = [c for c in range(len(text) + 1) if prefix.at(c) <= budget]
    got = prefix.fit(budget)
    assert got == max(fits), (text, budget)


@pytest.mark.parametrize("text", ["a" * 100_000, "".join(chr(97 + i * i * 7 % 26) for i in range(100_000)), " " * 100_000 + "x", "é" * 50_000, "#" * 100_000, "x " * 50_000, "1" * 100_000])
def test_long_runs_fit_at_once(text, library):
    counter = prefix_tokens.counter(BYTE)
    counter.prefix("warm up")
    prefix = counter.prefix(text)
    assert prefix.total == len(library.encode(text, add_special_tokens=False).ids)
    chars = prefix.fit(3)
    began = time.monotonic()
    for budget in (3, 100, 5000, prefix.total):
        chars = prefix.fit(budget)
        assert prefix.at(chars) <= budget and (chars == len(text) or prefix.at(chars + 1) > budget)
    assert time.monotonic() - began < 1
    for chars in (1, 17, 999, len(text) - 1):
        assert prefix.at(chars) == len(library.encode(text[:chars], add_special_tokens=False).ids)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="pattern"):
        prefix_tokens.PrefixCounter(WORD)


def test_budget(library):
    prefix = prefix_tokens.counter(BYTE).prefix(TEXTS[10][:900])
    for budget in (0, 1, 7, 100, 10**6):
        chars = prefix.fit(budget)
        assert prefix.at(chars) <= budget
        assert all(prefix.at(c) > budget for c in range(chars + 1, min(chars + 4, 901)))


def test_empty_tables(spark):
    none = documents(spark).where("false")
    assert prefix_tokens.token_counts(none, BYTE).count() == 0
    assert packing.pack(none, WORD).count() == 0


def check_packing(rows, docs, size, window_sequences, queues_mixed=True):
    """Exact round trip: every id in one piece, sequences gapless and full or a power of two."""
    library = Tokenizer.from_file(WORD)
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.doc_tokens, r.start, r.length, r.ids_crc32))
    lengths = []
    for s in sorted(by_seq):
        at = 0
        for offset, length in sorted(by_seq[s]):
            assert offset == at and length > 0
            at += length
        lengths.append(at)
    assert sorted(by_seq) == list(range(len(by_seq)))
    full = [n for n in lengths if n == size]
    assert lengths[: len(full)] == full and all(n & (n - 1) == 0 for n in lengths)
    assert by_doc.keys() == want.keys()
    for i, texts in want.items():
        if len(texts) > 1:
            continue
        ids, at = texts[0], 0
        for total, start, length, crc in sorted(by_doc[i], key=lambda p: p[1]):
            assert total == len(ids) // 4 and start == at
            assert crc == zlib.crc32(ids[4 * start : 4 * (start + length)])
            at += length
        assert at == len(ids) // 4


@pytest.mark.parametrize("size, windows, weights", [(2048, 16, None), (64, 2, None), (64, 2, {"s1": 3, "s2": 1}), (32, 1, {"s0": 1, "s1": 5, "s2": 1, "src1": 2})])
def test_packing_round_trip(spark, size, windows, weights):
    docs = documents(spark).repartition(3).unionByName(sample(spark, 150).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", "1 as n", "'k' as key"))
    pieces = packing.pack(docs, WORD, size, windows, weights).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], size, windows)


def test_repeated_ids_and_nulls(spark):
    docs = documents(spark, ["a b c", "a b c", None, "d"], [None, 5, 5, None])
    rows = packing.pack(docs, WORD, 4, 1).collect()
    assert sum(r.length for r in rows) == 4 + 4 + 1 + 2
    assert {r.sequence_id: 0 for r in rows}.keys() == set(range(4))  # 4 + 4 + 2 + 1


def test_many_sources_in_source_order(spark):
    """Beyond MAX_QUEUES sources, named or not, every window holds the mixture."""
    sources = [f"s{i:04d}" for i in range(1500)]
    rows = [(2 * i + k, "a b c d e f g h", s) for i, s in enumerate(sources) for k in (0, 1)]
    rows += [(3000 + k, "a b c d e f g h", "big") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(4, "source")
    source_of = {i: s for i, _, s in rows}
    size, per_window = 64, 32
    pieces = packing.pack(docs, WORD, size, per_window).collect()
    check_packing(pieces, [(i, t) for i, t, _ in rows], size, per_window)
    total = sum(r.length for r in pieces)
    windows = total // (size * per_window)
    got = {s: np.zeros(windows + 1) for s in [*sources, "big"]}
    for r in pieces:
        got[source_of[r.doc_id]][min(windows, r.sequence_id // per_window)] += r.length
    for counts in got.values():
        ideal = np.arange(1, windows + 1) * size * per_window * counts.sum() / total
        assert np.abs(counts[:windows].cumsum() - ideal).max() <= 2


def test_given_weights_hold_beyond_the_limit_of_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    weights = {"a": 26, "b": 1, "c": 1, "d": 1, "e": 1, "f": 2}
    docs = spark.createDataFrame([(i, "a b c " * 100, s) for i, s in enumerate(weights)], "doc_id long, text string, source string")
    first = {s: 0 for s in weights}
    for r in packing.pack(docs, WORD, 64, 1, weights).collect():
        first[[*weights][r.doc_id]] += r.length * (r.sequence_id == 0)
    assert first == {s: 2 * w for s, w in weights.items()}


def test_windows_hold_the_mixture():
    totals = [900_000, 70_001, 30_303, 333]
    plan = packing.Plan(totals, totals, 1024)
    cells = np.zeros((len(totals), plan.phases[-1].first + 1), int)
    for s, n in enumerate(totals):
        at = 0
        while at < n:
            step = min(n - at, random.Random(at).randint(1, 5000))
            for window, _, a, b in plan.cells(s, at, at + step):
                cells[s, window] += b - a
            at += step
    assert (cells.sum(0)[:-1] == 1024).all() and (cells.sum(1) == totals).all()
    total = sum(totals)
    run = cells[:, :-1].cumsum(1)
    for s, n in enumerate(totals):
        ideal = np.arange(1, run.shape[1] + 1) * 1024 * n / total
        assert np.abs(run[s] - ideal).max() <= 1  # the carried deficit


def test_weights_until_a_queue_is_empty():
    plan = packing.Plan([1000, 5000, 300], [1, 1, 2], 128)
    first = plan.phases[0]
    assert plan.share(first, 0, 1) == 32 and plan.share(first, 2, 1) == 64
    spots = set()
    for s, n in enumerate(plan.totals):
        for window, place, a, b in plan.cells(s, 0, n):
            for i in range(b - a):
                assert (window, place + i) not in spots
                spots.add((window, place + i))
    assert len(spots) == 6300 and max(p for _, p in spots) < 128


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZÉéßİŉ\u0301'sretl12.,#&<|>end of text\x1c\x85\u00a0 \n你ﬁ")), max_size=30))
def test_ids_of_chunks(text):
    own = packing.chunk_ids(WORD)
    assert own.of(text) == np.array(own.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_the_sample(spark):
    own = packing.chunk_ids(WORD)
    for r in sample(spark).collect():
        assert own.of(r.text) == np.array(own.library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()
