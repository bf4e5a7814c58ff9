"""Repetition rules: how much of a text lies in repeated runs of words and lines.

Words get hash numbers; for each length n a rolling hash of n words is built by numpy
over all texts of a slice at once, repeats are found by sorting (text, hash), and the
characters of the words covered by a repeated run are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemeter.llm.common import per_process, slices, utf8

# Most share of the words' characters that may lie in repeated runs of so many words, and in repeated lines.
LIMITS = {5: 0.45, 7: 0.4, 10: 0.35}
LINE_LIMIT = 0.3
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
MARK = np.zeros(256, bool)
MARK[list(b"#*$%&|<>")] = True
LEAD = (np.arange(256) & 0xC0) != 0x80
LETTER = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base^1 ... base^n modulo 2^64."""
    out = np.empty(n, np.uint64)
    if n:
        out[0] = base % (1 << 64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * out[done - 1]
        done += step
    return out


def ladder(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n bytes at least."""
    size = max(1 << 20, 1 << n.bit_length())
    return per_process(("powers", size), lambda: (powers(int(BASE), size), powers(pow(int(BASE), -1, 1 << 64), size)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    n = len(data)
    up, down = ladder(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTER[data] * up[:n], out=run[1:])
    h = (run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def covered(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The words that lie in a run of n words found twice or more in their text."""
    mask = np.zeros(len(hashes), bool)
    if len(hashes) < n:
        return mask
    roll = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        roll = roll * BASE + hashes[i : i + len(roll)]
    inside = doc[n - 1 :] == doc[: len(roll)]
    at = np.nonzero(inside)[0]
    twice, _ = again(mixed(roll[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text: arrays of len(offsets) - 1."""
    texts = len(offsets) - 1
    total = lambda where, size=None: np.bincount(where, size, minlength=texts)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    solid = ~SPACE[data]
    bound = np.ones(len(data) + 1, bool)
    bound[1:-1] = owner[1:] != owner[:-1]
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    starts = np.nonzero(solid & (~before | bound[:-1]))[0]
    ends = np.nonzero(solid & (~after | bound[1:]))[0] + 1
    doc = owner[starts] if len(starts) else np.zeros(0, np.int64)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LEAD[data], out=chars[1:])
    size = chars[ends] - chars[starts]
    hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    out = {
        "n_words": total(doc),
        "word_chars": total(doc, size).astype(np.int64),
        "n_symbols": total(owner[MARK[data]]) if len(data) else total(owner),
        "n_repeat_words": total(doc[covered(hashes, doc, 3)]),
    }
    for n in LIMITS:
        hit = covered(hashes, doc, n)
        out[f"run_{n}_chars"] = total(doc[hit], size[hit]).astype(np.int64)
    # lines: from a text's begin or after a newline, to the next newline or the text's end
    newline = np.nonzero(data == 10)[0]
    begins = np.concatenate([offsets[:-1], newline + 1])
    stops = np.concatenate([offsets[1:], newline])
    begins.sort()
    stops.sort()
    line_doc = np.concatenate([np.arange(texts), owner[newline] if len(data) else newline])
    line_doc.sort()
    words = np.searchsorted(starts, stops) - np.searchsorted(starts, begins)
    full = words > 0
    keys = span_hashes(data, begins[full], stops[full]) if full.any() else np.zeros(0, np.uint64)
    _, later = again(mixed(keys + line_doc[full].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    out["n_dup_lines"] = total(line_doc[full][later])
    out["line_chars"] = total(line_doc[full][later], (chars[stops[full]] - chars[begins[full]])[later]).astype(np.int64)
    return out


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"run_{n}_chars" for n in LIMITS), "line_chars"]


def repetition(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row, with the characters that repeated runs and lines cover.

    A null or blank text has no words and fails the base rule.  Rows with a null or
    repeated doc_id are judged one by one, an empty table gives an empty result, other
    columns are ignored.  Words are runs of bytes other than ASCII white space.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = measure(*utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in COLUMNS)], ["doc_id", *COLUMNS])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = slim.mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.col("line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, limit in LIMITS.items():
        within &= F.col(f"run_{n}_chars") <= limit * F.col("word_chars")
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & within)
