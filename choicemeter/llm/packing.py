"""Mixture-controlled packing of token streams into sequences of fixed length.

Every source is a queue of tokens.  A window is a fixed number of sequences; in each
window every queue gets its share of the target proportions.  Shares are rarely whole
numbers of tokens: the unspent part of a queue's quantum is its deficit, which is
carried on.  Queue s has received floor(w * Q[s]) - floor(w * Q[s-1]) tokens after w
windows, Q being the running sum of quanta in queue order, so the carried deficits are
the fractions of w * Q and never exceed one token, a window is always full, and any
task knows the state of all queues at any window without replaying the ones before.
Small sources share a queue, the pool, and are dealt inside it round by round; their running sums are
computed and joined in Spark.

The stream of a queue is ordered by the blocks in which the token table was written.
Only token sums by block and source are shuffled; texts and ids stay where they are.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicemeter.llm.common import frozen, per_process, slices
from choicemeter.llm.prefix_tokens import byte_letters

END = 1
MAX_QUEUES = 1024
PARTS = 4096
# Words, and runs of a word and marks, whose ids are kept in a worker.
WORDS, CHUNKS = 300_000, 150_000


# A word of Latin letters with ASCII marks behind it: the pattern cuts between the two.
WORD = re.compile("([A-Za-zÀ-ÖØ-öø-įĲ-ɏ]+)([!\"#$%&()*+,./:;=?@^_`{|}~-]*)")


class ChunkIds(dict):
    """Ids, as little-endian 32-bit bytes, by run of bytes without ASCII white space.

    The vocabulary's rules drop white space and never look across it, so the ids of a
    text are those of its runs one after the other.  Most runs are a word and marks; both
    are kept apart, so that a word is encoded once whatever stands behind it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        value = self.words.get(word)
        if value is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            value = self.words[word] = np.array([t.id for t in self.merge(mapped)], "<u4").tobytes()
        return value

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CHUNKS:
            self.clear()
        text = chunk.decode()
        if m := WORD.fullmatch(text):
            value = self.word(m[1].lower()) + (self.word(m[2]) if m[2] else b"")
        else:
            value = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = value
        return value

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


def chunk_ids(path: str) -> ChunkIds:
    return per_process(("chunk_ids", path), lambda: ChunkIds(path))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Every row's ids with the end id, its block, and the tokens of its source before it in the block."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, run = chunk_ids(path), TaskContext.get().partitionId(), {}
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [own.of(text) + end for text in part.column("text").to_pylist()]
                before, count = [], []
                for source, value in zip(part.column("source").to_pylist(), ids, strict=True):
                    before.append(run.get(source, 0))
                    count.append(len(value) // 4)
                    run[source] = before[-1] + count[-1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "source": part.column("source"),
                        "block": pa.array([block] * len(ids), pa.int32()),
                        "before": pa.array(before, pa.int64()),
                        "n": pa.array(count, pa.int64()),
                        "ids": pa.array(ids, pa.binary()),
                    }
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    return slim.mapInArrow(encode, "doc_id long, source string, block int, before long, n long, ids binary")


@dataclass
class Phase:
    """Windows from ``first`` on with the same active queues; ``given``: tokens each has given before."""

    first: int
    count: int
    given: list[int]
    sums: list[int]


@dataclass
class Plan:
    """Which tokens of each queue lie in which window; at most MAX_QUEUES + 1 queues, or one more than weights are given."""

    totals: list[int]
    weights: list[int]
    window: int
    phases: list[Phase] = field(default_factory=list)

    def __post_init__(self):
        given, first = [0] * len(self.totals), 0
        while True:
            left = [t - g for t, g in zip(self.totals, given, strict=True)]
            active = [w if n else 0 for w, n in zip(self.weights, left, strict=True)]
            if sum(left) < self.window or not any(active):
                break
            sums = list(np.cumsum(np.array(active, object)))
            phase = Phase(first, 0, given, sums)
            most = sum(left) // self.window
            # The most windows that no queue runs out in; what queues have given only grows.
            count = bisect.bisect_right(range(1, most + 1), False, key=lambda w: any(self.share(phase, s, w) > n for s, n in enumerate(left)))
            if count:
                phase.count = count
                self.phases.append(phase)
                given = [g + self.share(phase, s, count) for s, g in enumerate(given)]
                first += count
                continue
            # One window in which a queue runs out: it gives what it has, the others fill up in order.
            take = [min(n, self.share(phase, s, 1)) for s, n in enumerate(left)]
            gap = self.window - sum(take)
            for s, n in enumerate(left):
                more = min(gap, n - take[s])
                take[s], gap = take[s] + more, gap - more
            # share(1) of weights that sum to the window are the weights themselves
            self.phases.append(Phase(first, 1, given, list(np.cumsum(np.array(take, object)))))
            given = [g + t for g, t in zip(given, take, strict=True)]
            first += 1
        self.phases.append(Phase(first, 1, given, list(np.cumsum(np.array([t - g for t, g in zip(self.totals, given, strict=True)], object)))))
        self.rest = int(self.phases[-1].sums[-1]) if self.totals else 0
        self.starts = [[p.given[s] for p in self.phases] for s in range(len(self.totals))]

    def share(self, phase: Phase, s: int, windows: int) -> int:
        """Tokens of queue s in the first ``windows`` windows of a phase."""
        return windows * self.window * phase.sums[s] // phase.sums[-1] - self.below(phase, s, windows)

    def below(self, phase: Phase, s: int, windows: int) -> int:
        """Tokens of the queues before s in the first ``windows`` windows of a phase."""
        return windows * self.window * (phase.sums[s - 1] if s else 0) // phase.sums[-1]

    def cells(self, s: int, begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(window, place in the window, from, to) of the tokens [begin, end) of queue s."""
        while begin < end:
            # of phases with the same start only the last gives tokens of this queue
            i = bisect.bisect_right(self.starts[s], begin) - 1
            phase, last = self.phases[i], i == len(self.phases) - 1
            at = begin - phase.given[s]
            if last:
                low = phase.sums[s - 1] if s else 0
                yield phase.first, int(low) + at, begin, end
                return
            w = bisect.bisect_right(range(1, phase.count + 1), at, key=lambda w: self.share(phase, s, w))
            start = self.share(phase, s, w)
            stop = min(end, phase.given[s] + self.share(phase, s, w + 1))
            place = self.below(phase, s, w + 1) - self.below(phase, s, w)
            yield phase.first + w, place + at - start, begin, stop
            begin = stop

    def sequences(self, window: int, place: int, length: int, size: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, tokens) of a run of tokens in a window.

        The last window's rest beyond whole sequences is cut into powers of two, so
        that nothing needs padding.
        """
        base = window * (self.window // size)
        whole = self.rest // size * size if window == self.phases[-1].first else self.window
        while length:
            if place < whole:
                sequence, offset, room = base + place // size, place % size, size - place % size
            else:
                sequence, begin, left = base + whole // size, whole, self.rest - whole
                while True:
                    step = 1 << (left.bit_length() - 1)
                    if place < begin + step:
                        break
                    sequence, begin, left = sequence + 1, begin + step, left - step
                offset, room = place - begin, begin + step - place
            n = min(room, length)
            yield sequence, offset, n
            place, length = place + n, length - n


def interleaved(low: int, n: int, total: int, step: int, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """(place in the pool, tokens) of the tokens [begin, end) of a source that has ``low`` tokens of others before it.

    Token g of all the pool's tokens, source after source, lies in the round whose number is
    g's last bits reversed, so that any run of tokens is spread evenly over the rounds, and
    a source of less than a token a round too.
    """
    bits = max(0, (-(-total // step) - 1).bit_length())
    rounds = 1 << bits

    def bound(w: int, tokens: int) -> int:
        """How many of the first ``tokens`` lie in the first ``w`` rounds."""
        count, rest = tokens // rounds * w, tokens % rounds
        if w == rounds:
            return count + rest
        low_bits = 0  # of the tokens whose round agrees with w so far
        for i in range(bits):
            if w >> (bits - 1 - i) & 1:
                count += max(0, rest - low_bits + (2 << i) - 1 >> i + 1)
                low_bits |= 1 << i
        return count

    def given(w: int) -> int:
        return bound(w, low + n) - bound(w, low)

    while begin < end:
        w = bisect.bisect_right(range(1, rounds + 1), begin, key=given)
        stop = min(end, given(w + 1))
        yield bound(w, total) + bound(w + 1, low) - bound(w, low) + begin - given(w), stop - begin
        begin = stop


def running_sums(sums: DataFrame) -> DataFrame:
    """(source, low, size): the tokens of each source and of those before it, in order of a hash."""
    parts = frozen(sums.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(PARTS)).cast("int")), "pooled_sources")
    low, lows = 0, []
    for r in sorted(parts.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # at most PARTS rows
        lows.append((r.part, low))
        low += r.n
    table = sums.sparkSession.createDataFrame(lows, "part int, begin long")
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("source")) - F.col("n")
    return parts.withColumn("inner", inner).join(F.broadcast(table), "part").select("source", (F.col("begin") + F.col("inner")).alias("low"), F.col("n").alias("size"))


def pack(docs: DataFrame, path: str, size: int = 2048, window_sequences: int = 16, weights: dict[str, int] | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``size`` tokens (a power of two).

    Every document is its ids and an end id; pieces lie gapless in sequences, each id in
    one piece.  All sequences are full but the last few, which are powers of two.
    ``weights`` sets the target proportions by source, else they are the sources' shares
    of all tokens.  Without weights the sources with less than 1 / MAX_QUEUES of all tokens
    are one queue, else those without a weight, which have the least weight together; each
    has its share of every round of that queue, which is what a window holds of it.

    Null text: only the end id.  Null source: the source ''.  Null and repeated doc_ids
    and repeated rows are packed row by row.  An empty table gives no piece.  Other
    columns are ignored.
    """
    tokens = frozen(tokenized(docs, path), "tokens")
    by_source = tokens.groupBy("source", "block").agg(F.sum("n").alias("n"))
    by_source = frozen(by_source, "token_sums")
    total = by_source.agg(F.sum("n")).first()[0] or 0
    sums = by_source.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        named = sums.where(F.col("n") * MAX_QUEUES >= total)
    else:
        named = sums.where(F.col("source").isin([*weights]))
    # At most MAX_QUEUES rows: each has at least 1 / MAX_QUEUES of all tokens; or those named in ``weights``.
    rows = sorted((r.source, r.n) for r in named.collect())
    others = total - sum(n for _, n in rows)
    if weights is None and rows and 0 < others * MAX_QUEUES < total:
        rows.remove(min(rows, key=lambda row: (row[1], row[0])))  # too little for a queue of its own
    queues = {source: i for i, (source, _) in enumerate(rows)}
    counts = [n for _, n in rows]
    shares = counts if weights is None else [weights[s] for s, _ in rows]
    pool, others, window = len(queues), total - sum(counts), size * window_sequences
    if others:
        least = others if weights is None else min(weights.values(), default=1)
        counts, shares = [*counts, others], [*shares, least]
        step = max(1, -(-window * least // (sum(shares) or 1)))
    if weights is not None:
        shares = [max(w, -(-sum(shares) // window)) for w in shares]  # a queue gives a token a window at least
    plan = Plan(counts, shares, window)

    spark = docs.sparkSession
    queue_table = spark.createDataFrame([*queues.items()], "source string, queue int") if queues else spark.range(0).selectExpr("'' as source", "0 as queue")
    placed = by_source.join(F.broadcast(queue_table), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(pool)))
    starts = placed.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("block")) - F.col("n")).drop("n")
    if others:
        starts = starts.join(running_sums(sums.join(F.broadcast(queue_table), "source", "left_anti")), "source", "left")
    else:
        starts = starts.selectExpr("*", "0L as low", "0L as size")
    starts = frozen(starts.select("source", "block", "queue", "base", "low", "size"), "queue_starts")

    def runs(queue: int, low: int, size: int, begin: int, n: int) -> Iterator[tuple[int, int]]:
        return interleaved(low, size, others, step, begin, begin + n) if queue == pool else iter([(begin, n)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                out: list[tuple] = []
                columns = (part.column(c).to_pylist() for c in ("doc_id", "queue", "low", "size", "begin", "n", "ids"))
                for doc_id, queue, low, tokens_of_source, begin, n, ids in zip(*columns, strict=True):
                    at = 0
                    for first, length in runs(queue, low, tokens_of_source, begin, n):
                        for window, place, a, b in plan.cells(queue, first, first + length):
                            for sequence, offset, count in plan.sequences(window, place, b - a, size):
                                out.append((doc_id, at, count, zlib.crc32(ids[4 * at : 4 * (at + count)]), n, sequence, offset, queue))
                                at += count
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                arrays = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([*arrays[:7], arrays[7].cast(pa.int32())], [*names, "queue"])

    slim = tokens.join(starts, ["source", "block"]).select("doc_id", "queue", "low", "size", (F.col("base") + F.col("before")).alias("begin"), "n", "ids")
    return slim.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int")
