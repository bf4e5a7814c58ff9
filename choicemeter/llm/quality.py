"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics.  Per class, count, sums and
sums of products are added up over all labelled rows (partial sums before the shuffle,
one small row per class); mean and covariance follow.  Covariances shrink towards their
diagonal.  A score is the logistic of the difference of the two log densities, their
Mahalanobis distances taken with Cholesky factors that are worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemeter.llm.common import frozen, slices, utf8

NAMES = ("length", "words", "word_length", "upper", "digits", "marks", "shouts", "stops", "commas", "bars", "lines", "same_lines", "fresh_words", "letters")
N = len(NAMES)


def byte_classes() -> np.ndarray:
    """For each byte a bit per class of characters."""
    groups = [b" \t\n\r\x0b\x0c", bytes(range(65, 91)), b"0123456789", b"#*$%&<>@^~=+_\\", b"!?", b".", b",;:", b"|", b"\n"]
    classes = np.zeros(256, np.int64)
    for i, group in enumerate(groups):
        classes[list(group)] |= 1 << (7 * i)
    return classes


CLASSES = byte_classes()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One transformed vector per text."""
    rows = np.zeros((len(offsets) - 1, N))
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        n = b - a
        counts = np.bincount(data[a:b], minlength=256)
        space, upper, digits, marks, shouts, stops, commas, bars, lines = (counts[group].sum() for group in GROUPS)
        text = raw[a:b]
        words = text.split()
        split = text.split(b"\n")
        w, k = len(words), len(split)
        solid = max(1, n - space)
        rows[i] = (
            np.log1p(n),
            np.log1p(w),
            np.log1p(solid / max(1, w)),
            np.sqrt(upper / solid),
            np.sqrt(digits / solid),
            np.sqrt(marks / solid),
            np.sqrt(shouts / solid),
            np.sqrt(stops / max(1, w)),
            np.sqrt(commas / max(1, w)),
            np.sqrt(bars / solid),
            np.sqrt(lines / max(1, w)),
            np.sqrt(1 - len(set(split)) / k),
            # distinct words grow about as the square root of all words
            len(set(words)) / max(1, w) * np.log1p(w),
            np.sqrt((counts[97:123].sum() + counts[128:].sum()) / max(1, n)),
        )
    return rows


GROUPS = [np.nonzero(CLASSES >> (7 * i) & 1)[0] for i in range(9)]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the vector ``x`` of every row; a null text counts as empty."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = statistics(*utf8(part.column("text")))
                flat = pa.array(rows.ravel(), pa.float64())
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * N, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), x], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "doc_id long, x array<double>")


def moments(labelled: DataFrame) -> DataFrame:
    """One row per label and slice of the input: n, sum of x and of x x', added up within tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(-1, N)
            label = batch.column("label").to_numpy()
            for k in np.unique(label):
                some = x[label == k]
                n, s, q = sums.get(int(k), (0, 0.0, 0.0))
                sums[int(k)] = (n + len(some), s + some.sum(0), q + some.T @ some)
        for k, (n, s, q) in sums.items():
            yield pa.RecordBatch.from_pydict({"label": pa.array([k], pa.int32()), "n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    return labelled.select("label", "x").mapInArrow(add, "label int, n long, s array<double>, q array<double>")


@dataclass
class Discriminant:
    """Means, Cholesky factors and log weights of the two classes; None where a class was not seen."""

    classes: list[tuple[float, np.ndarray, np.ndarray] | None]
    scale: float

    @staticmethod
    def fit(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float, floor: float, scale: float) -> Discriminant:
        total = sum(n for n, _, _ in sums.values())
        found: list = []
        for label in (0, 1):
            if label not in sums:
                found.append(None)
                continue
            n, s, q = sums[label]
            mean = s / n
            cov = q.reshape(N, N) / n - np.outer(mean, mean)
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + floor * np.eye(N)
            factor = np.linalg.cholesky((cov + cov.T) / 2)
            found.append((np.log(n / total) - np.log(np.diag(factor)).sum(), mean, np.linalg.inv(factor)))
        return Discriminant(found, scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        if None in self.classes:
            # without both classes: what is known of the labels
            return np.full(len(x), 0.5 if self.classes == [None, None] else float(self.classes[1] is not None))
        low, high = (bias - 0.5 * np.square((x - mean) @ inverse.T).sum(1) for bias, mean, inverse in self.classes)
        return 1 / (1 + np.exp(np.clip((low - high) * self.scale, -700, 700)))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(vectors: DataFrame, labels: DataFrame, shrink: float = 0.1, floor: float = 1e-4, scale: float = 0.5) -> Discriminant:
    """A discriminant from all labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(~held_out() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = moments(vectors.join(known, "doc_id"))
    place = lambda name, size: F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(size)))
    whole = parts.groupBy("label").agg(F.sum("n").alias("n"), place("s", N).alias("s"), place("q", N * N).alias("q"))
    rows = {r.label: (r.n, np.array(r.s), np.array(r.q)) for r in whole.collect()}  # two rows at most
    return Discriminant.fit(rows, shrink, floor, scale)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null text scores as the empty text.  Rows with a null doc_id are never learnt from
    and not held out; rows with the same doc_id are scored one by one.  A document with
    several labels counts with the highest, null labels are left out.  With labels of one
    class only every score is that class, without labels 0.5.  Other columns are ignored.
    """
    vectors = frozen(features(docs), "features")
    model = fit(vectors, labels, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, N)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    scored = vectors.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options: float) -> DataFrame:
    """The rows that the classifier predicts to be of quality, with all their columns.

    The model is fitted as in ``classify``; then each row is judged where it is read, so
    texts are not shuffled and rows with a null or repeated doc_id are judged one by one.
    """
    model = fit(frozen(features(docs), "features"), labels, **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.score(statistics(*utf8(part.column("text")))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
