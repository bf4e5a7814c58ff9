import hashlib
import random
import zlib

import numpy as np
import pytest

from choicemeter.llm import suffixes

from .cases import TEXTS, documents, sample


def plain(docs, length=100):
    """docs in order: bytes covered by a string that also starts earlier."""
    seen, out = set(), []
    for i, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            s = data[a : a + length]
            if s in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij é") for _ in range(rng.randint(2, 9)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passage)[rng.randint(0, 60) : rng.randint(90, 240)] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    base = " ".join(word() for _ in range(200))
    for _ in range(30):  # near copies
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t)[rng.randint(0, 30) :])
    periodic = ["ab" * 300, "abc" * 100 + "ab" * 120, "x" * 99, "x" * 100, "x" * 101, "y" * 3000, "\0" * 250]
    return [*TEXTS[:9], *texts, *periodic, *TEXTS[9:], base, base]


@pytest.mark.parametrize("hot, hold", [(suffixes.HOT, suffixes.HOLD), (1, suffixes.HOLD), (suffixes.HOT, 1)])
def test_brute_force(spark, monkeypatch, hot, hold):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "HOLD", hold)
    texts = cases()
    docs = documents(spark, texts).repartition(5)
    got = sorted(tuple(r) for r in suffixes.dedup_bytes(docs).collect())
    assert got == plain(list(enumerate(texts)))


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(tuple(r) for r in suffixes.dedup_bytes(docs).collect()) == plain(rows)
    assert suffixes.dedup_bytes(docs.where("false")).count() == 0


def test_null_and_repeated_ids(spark):
    a, b = "Some text of more than a hundred bytes. " * 3, "Another text that goes on for a hundred bytes and then some, as it must."
    docs = documents(spark, [a, a, a + b * 2, a + b * 2, None, a], [5, None, 3, 3, 3, 5])
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed) for r in suffixes.dedup_bytes(docs).collect())
    gone_self = plain([(0, a)])[0][2]
    both = plain([(0, a), (1, a + b * 2)])[1][2]
    assert rows == sorted([(-1, len(a), gone_self), (5, len(a), len(a)), (5, len(a), len(a)), (3, 0, 0)] + [(3, len(a + b * 2), both)] * 2)


def test_shared_ids_with_the_same_crc(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    twice, once = letters(300) * 2, letters(600)
    ends = {zlib.crc32((twice + e).encode()) & 0x7FFFFFFF: e for e in (letters(12) for _ in range(150_000))}
    other = next(e for e in (letters(12) for _ in range(2_000_000)) if zlib.crc32((once + e).encode()) & 0x7FFFFFFF in ends)
    repeats, fresh = twice + ends[zlib.crc32((once + other).encode()) & 0x7FFFFFFF], once + other
    got = sorted(tuple(r)[1:] for r in suffixes.dedup_bytes(documents(spark, [repeats, fresh], [None, None])).collect())
    assert got == sorted(plain([(None, text)])[0][1:] for text in (repeats, fresh))


def test_intervals():
    text = np.frombuffer(b"banana", np.uint8)
    order = sorted(range(6), key=lambda i: text[i:].tobytes())
    common = np.zeros(6, np.int64)
    for k in range(1, 6):
        x, y = text[order[k - 1] :].tobytes(), text[order[k] :].tobytes()
        common[k] = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    first, end, depth, parent = suffixes.intervals(common, 1)
    assert sorted(zip(first.tolist(), end.tolist(), depth.tolist(), parent.tolist())) == [(0, 3, 1, 0), (1, 3, 3, 1), (4, 6, 2, 0)]


def test_repeat_groups_hold_all_occurrences():
    suffix = [b"s" * 60 + bytes([c]) * 40 for c in b"aab"]
    common = np.array([0, 100, 60])
    before = np.array([[ord("l")] * 68] * 3, np.int16)
    groups = list(suffixes.repeat_groups(common, before, np.array([68, 68, 68]), np.array([2, 0, 1])))
    _, member, need, depth = groups[0]
    assert len(suffix) == 3
    assert {m for m, n in zip(member.tolist(), need.tolist()) if n == 40} == {0, 1, 2}  # all share 40 + 60 bytes
    assert {m for m, d in zip(member.tolist(), depth.tolist()) if d == 100} == {0, 1}
    assert max(need.max() for _, _, need, _ in groups) == 68  # the shared left side is followed to its end
