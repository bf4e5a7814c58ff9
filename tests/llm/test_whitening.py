import math

import numpy as np
import pytest

from choicemeter.llm import whitening
from tests.frames import frame

DDL = "vec_id long, embedding array<double>, component int, n string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return frame(spark, [(i, v, 5, "x") for i, v in zip(ids, vectors, strict=True)], DDL)


def plain(rows, wanted=32):
    """rows: (vec_id, vector).  Whole numbers in Python, eigenvectors by the library."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, size = len(good), len(good[0][1])
    sums = [sum(x[k] for _, x in good) for k in range(size)]
    x = np.array([[n * a - s for a, s in zip(x, sums)] for _, x in good], object)
    centred = x.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    whitened = centred @ vectors / np.sqrt(values)
    return n, {i: sum(int(a) ** 2 for a in row) for (i, _), row in zip(good, x)}, values / np.trace(centred.T @ centred / n), {i: w for (i, _), w in zip(good, whitened)}


def check(df, rows, wanted=32, atol=1e-6):
    n, deviation, explained, white = plain(rows, wanted)
    got = df.collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, k + 1) for i in white for k in range(len(explained)))
    assert {r.n for r in got} == {n} and all(r.deviation == deviation[r.vec_id] for r in got)
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error <= 1e-4
    for r in got:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-6
    for k in range(len(explained)):
        mine, his = np.array([(r.whitened, white[r.vec_id][k]) for r in got if r.component == k + 1]).T
        assert min(np.abs(mine - his).max(), np.abs(mine + his).max()) < atol


def test_sample(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    out = whitening.whitened(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out, [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = (rng.standard_normal((40, 5)) * [9, 4, 2, 1, 0.5]).tolist()
    odd = [None, [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e30] * 5, [1.0, 2.0], [], [0.0, -float("inf"), 1.0, 1.0, 1.0]]
    vectors = [*good[:7], *odd, *good[7:]]
    df = table(spark, vectors).repartition(4)
    check(whitening.whitened(df), [(i, v) for i, v in enumerate(vectors) if v in good])
    check(whitening.whitened(df, wanted=2), [(i, v) for i, v in enumerate(vectors) if v in good], wanted=2)
    twice = table(spark, good + good[:3], [None, 1, 1, *range(3, 43)])
    rows = whitening.whitened(twice).collect()
    assert len(rows) == 43 * 5 and len([r for r in rows if r.vec_id is None]) == 5 and len([r for r in rows if r.vec_id == 1]) == 10


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None], [[]]])
def test_without_variance(spark, vectors):
    assert whitening.whitened(table(spark, vectors)).count() == 0


def test_a_flat_direction(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (60, 2))
    rows = whitening.whitened(table(spark, [[float(a), float(b), float(a), 3.0] for a, b in x])).collect()
    assert {r.component for r in rows} == {1, 2} and abs(sum({r.component: r.explained for r in rows}.values()) - 1) < 1e-9


def test_deviations_beyond_64_bits():
    model = whitening.Whitening(10**6, np.array([0, 5]), np.ones(1), np.ones((2, 1)), 2.0)
    x = np.array([[3, 4], [10**9, 1], [10**12, 1]])
    assert model.deviations(x).to_pylist() == [9 * 10**12 + (4 * 10**6 - 5) ** 2, None, None]
    assert model.deviations(x[:1]).to_pylist() == [9 * 10**12 + (4 * 10**6 - 5) ** 2]


CASES = {
    "random": lambda rng, n: rng.standard_normal(n) ** 2,
    "wide": lambda rng, n: 10.0 ** -np.linspace(0, 12, n),
    "one great": lambda rng, n: np.r_[1e6, rng.random(n - 1)],
    "equal": lambda rng, n: np.r_[np.full(n // 2, 3.0), np.full(n - n // 2, 1.0)],
    "all equal": lambda rng, n: np.full(n, 2.0),
    "zeros": lambda rng, n: np.r_[rng.random(n // 3), np.zeros(n - n // 3)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("n", [1, 2, 3, 17, 128])
def test_components(case, n):
    rng = np.random.default_rng(n)
    turn = np.linalg.qr(rng.standard_normal((n, n)))[0]
    a = whitening.symmetric(turn @ np.diag(CASES[case](rng, n)[:n]) @ turn.T)
    for wanted in (n, max(1, n // 3)):
        values, vectors = whitening.components(a, wanted)
        scale = np.linalg.norm(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:wanted], atol=1e-13 * scale)
        assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale


def test_sign():
    rng = np.random.default_rng(0)
    a = whitening.symmetric(rng.standard_normal((30, 30)))
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.halley(a) - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-11
