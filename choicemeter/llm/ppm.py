"""Language of a text by prediction by partial matching over bytes.

Each language has a tree of byte contexts of length 0 to ``ORDER``.  The code of a byte
begins at the longest context that its language knows; where the byte did not follow that
context, an escape leads to the next shorter one, which no longer counts the bytes that
the longer one would have taken.  An escape weighs as much as there are different bytes
(method C).  Bytes a language never saw share the last escape.  Statistics are frozen
before scoring, so the length of a byte's code follows from the bytes before it alone, and
a text's language is the one with the shortest code.

Learning counts the runs of ORDER + 1 bytes of every text that may be learnt from, within
tasks and then in a shuffle; all shorter contexts are sums of these.  Nothing is left out, so
the trees grow with the corpus.  They are dealt into parts by the byte before the coded one,
which settles all contexts of a place but the empty one; a part is sent out only up to
``PART`` runs (or the runs of one byte), and code lengths are whole numbers, so what the parts
add up to is exactly what one part would give.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicemeter.llm.common import frozen, per_process, slices, utf8

ORDER = 4
# A text begins behind line ends.
BEFORE = 10
# Different runs sent out at once, all languages together; 24 bytes each in a worker's trees.
PART = 3_000_000
# Parts of a bit in which code lengths are counted.
UNIT = 1 << 16
# Bytes looked at in one step, and different runs a task holds before it hands them on.
STEP, HELD = 1 << 20, 1 << 21
UNKNOWN = "und"


def runs(data: np.ndarray, offsets: np.ndarray, order: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """For the places a to b of all texts' bytes: the last order + 1 bytes as one number, and the place's text."""
    owner = np.searchsorted(offsets, np.arange(a, b), side="right") - 1 if len(offsets) > 2 else np.zeros(b - a, np.int64)
    inside = np.arange(a, b) - offsets[owner]
    keys = data[a:b].astype(np.int64)
    for back in range(1, order + 1):
        first = max(0, back - a)
        byte = np.full(b - a, BEFORE, np.int64)
        byte[first:] = data[a + first - back : max(0, b - back)]
        byte[inside < back] = BEFORE
        keys |= byte << (8 * back)
    return keys, owner


def steps(offsets: np.ndarray, size: int = STEP) -> Iterator[tuple[int, int]]:
    for a in range(0, int(offsets[-1]), size):
        yield a, min(int(offsets[-1]), a + size)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_runs(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, run, count) of a task's texts."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, counts = added(*map(np.concatenate, zip(*parts, strict=True)))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "run": keys, "count": counts.astype(np.int64)})

    for batch in batches:
        for part in slices(batch, "text", STEP):
            langs = part.column("lang")
            for lang in pc.unique(langs).to_pylist():
                data, offsets = utf8(part.filter(pc.equal(langs, lang)).column("text"))
                for a, b in steps(offsets):
                    keys, counts = np.unique(runs(data, offsets, order, a, b)[0], return_counts=True)
                    held.setdefault(lang, []).append((keys, counts))
                    size += len(keys)
            if size > HELD:
                held = {lang: [added(*map(np.concatenate, zip(*parts, strict=True)))] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from out()
                    held, size = {}, 0
    yield from out()


class Tree:
    """Code lengths of one language: per context length the known runs and contexts with their costs, in UNITs of a bit."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, zero: np.ndarray, order: int):
        """``keys``: different runs of order + 1 bytes; ``zero``: the count of each of the 256 bytes in all of the language."""
        bits = lambda x: np.rint(np.log2(np.maximum(x, 1)) * UNIT).astype(np.int64)
        self.order = order
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        keys, counts = added(keys, counts)
        for k in range(order, 0, -1):
            keys, counts = added(keys & ((1 << (8 * (k + 1))) - 1), counts)
            levels.insert(0, (keys, counts))
        levels.insert(0, (np.flatnonzero(zero), zero[np.flatnonzero(zero)]))
        self.runs, self.contexts, self.found, self.plain = [], [], [], []
        self.escape, self.then_whole, self.then_escape = [], [], []
        before = None
        for k, (keys, counts) in enumerate(levels):
            context = keys >> 8
            first = np.flatnonzero(np.diff(context, prepend=-1))
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            total, kinds = np.add.reduceat(counts, first) if len(first) else counts, np.bincount(owner, minlength=len(first))
            whole = bits(total + kinds)
            self.runs.append(keys)
            self.contexts.append(context[first])
            self.found.append(bits(counts))
            self.plain.append(whole[owner] - bits(counts))  # coded where the code begins
            self.escape.append(whole - bits(kinds))
            if before is not None:
                # after an escape from here: the shorter context without the bytes that follow this one
                shorter_keys, shorter_counts, shorter_total, shorter_kinds, shorter_contexts = before
                mask = (1 << (8 * k)) - 1
                gone = np.add.reduceat(shorter_counts[np.searchsorted(shorter_keys, keys & mask)], first) if len(first) else total
                at = np.searchsorted(shorter_contexts, (context[first] & (mask >> 8)))
                left_total, left_kinds = shorter_total[at] - gone, shorter_kinds[at] - kinds
                self.then_whole.append(bits(left_total + left_kinds))
                self.then_escape.append(bits(left_total + left_kinds) - bits(left_kinds))  # 0 if nothing is left
            before = (keys, counts, total, kinds, context[first])
        self.never = int(bits(np.array([256 - np.count_nonzero(zero)]))[0])

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each run."""
        cost = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        # the place of the longer context that was escaped from; -1: none yet
        above = np.full(len(keys), -1, np.int64)
        for k in range(self.order, -1, -1):
            known, contexts = self.runs[k], self.contexts[k]
            if not len(known):
                continue
            key = keys[left] & ((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[at] == key
            entered = above[left] >= 0
            begun, after = hit & ~entered, hit & entered
            cost[left[begun]] += self.plain[k][at[begun]]
            if after.any():
                cost[left[after]] += self.then_whole[k][above[left[after]]] - self.found[k][at[after]]
            left, key, entered = left[~hit], key[~hit], entered[~hit]
            at = np.minimum(np.searchsorted(contexts, key >> 8), len(contexts) - 1)
            seen = contexts[at] == key >> 8
            if entered.any():
                cost[left[entered]] += self.then_escape[k][above[left[entered]]]
            cost[left[seen & ~entered]] += self.escape[k][at[seen & ~entered]]
            above[left] = np.where(seen, at, -1)
        cost[left] += self.never
        return cost


def code_lengths(column: pa.Array, trees: list[Tree], own: np.ndarray | None, order: int) -> np.ndarray:
    """(texts, languages): code lengths of whole texts over the places whose byte before is in the part."""
    data, offsets = utf8(column)
    out = np.zeros((len(column), len(trees)), np.int64)
    for a, b in steps(offsets):
        keys, owner = runs(data, offsets, order, a, b)
        if own is not None:
            keep = own[(keys >> 8) & 255]
            keys, owner = keys[keep], owner[keep]
        if not len(keys):
            continue
        # a place's run among the different ones, within its text
        different, inverse = np.unique(keys, return_inverse=True)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for j, tree in enumerate(trees):
            out[owner[first], j] += np.add.reduceat(tree.costs(different)[inverse], first)
    return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Languages:
    """Frozen statistics of all languages: names, counts of single bytes, and written runs in parts."""

    def __init__(self, docs: DataFrame, order: int = ORDER, part: int = PART):
        """Learn from the rows of ``docs`` with a lang."""
        self.spark: SparkSession = docs.sparkSession
        self.order = order
        some = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        found = some.mapInArrow(lambda batches: count_runs(batches, order), "lang string, run long, count long")
        self.table = frozen(found.groupBy("lang", "run").agg(F.sum("count").alias("count")), "byte_runs")
        # at most 65536 rows a language: its pairs of bytes
        pairs = self.table.groupBy("lang", F.col("run").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("runs")).collect()
        self.names = sorted({r.lang for r in pairs})
        self.zero = {name: np.zeros(256, np.int64) for name in self.names}
        load = np.zeros(256, np.int64)
        for r in pairs:
            self.zero[r.lang][r.pair & 255] += r["count"]
            load[r.pair >> 8] += r.runs
        self.parts: list[list[int]] = [[]]
        held = 0
        for byte in np.flatnonzero(load):
            if held and held + load[byte] > part:
                self.parts.append([])
                held = 0
            self.parts[-1].append(int(byte))
            held += int(load[byte])

    def send(self, part: int) -> tuple[Broadcast, str]:
        """One part's runs by language, to all executors, and a name for the trees made of them."""
        before = F.shiftright("run", 8).bitwiseAND(255)
        rows = self.table.where(before.isin(self.parts[part])) if len(self.parts) > 1 else self.table
        data = rows.select(F.array_position(F.array(*map(F.lit, self.names)), F.col("lang")).cast("int").alias("at"), "run", "count").toArrow()
        at, run, count = (data.column(c).combine_chunks().to_numpy() for c in ("at", "run", "count"))
        model = [(run[at == i + 1], count[at == i + 1], self.zero[name]) for i, name in enumerate(self.names)]
        return self.spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def lengths(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns and ``bits``, the code length of the text in each language in 1 / UNIT bits."""
        order, found = self.order, None
        slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
        schema = slim.drop("text").schema.add("bits", T.ArrayType(T.LongType()))
        for i, bytes_before in enumerate(self.parts):
            model, name = self.send(i)
            own = None
            if len(self.parts) > 1:
                # a byte no language has before another is priced by the first part
                own = np.isin(np.arange(256), bytes_before) | (i == 0) & ~np.isin(np.arange(256), sum(self.parts, []))

            def score(batches: Iterator[pa.RecordBatch], model=model, name=name, own=own) -> Iterator[pa.RecordBatch]:
                trees = per_process(("ppm", name), lambda: [Tree(*runs_of, order) for runs_of in model.value])
                for batch in batches:
                    for some in slices(batch, "text", STEP):
                        bits = code_lengths(some.column("text"), trees, own, order)
                        lists = pa.ListArray.from_arrays(np.arange(0, bits.size + 1, max(1, bits.shape[1]), dtype=np.int32)[: len(bits) + 1], pa.array(bits.ravel()))
                        yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), lists], [*keep, "bits"])

            one = slim.mapInArrow(score, schema)
            found = one if found is None else found.union(one)
        if len(self.parts) == 1:
            return found
        # Sums over the parts; rows that are equal in all that is kept come in each part equally often.
        sums = F.array(*(F.sum(F.get("bits", F.lit(i))) for i in range(len(self.names))))
        added_up = found.groupBy(*keep).agg(sums.alias("bits"), F.count(F.lit(1)).alias("_rows"))
        copies = (F.col("_rows") / len(self.parts)).cast("int")
        return added_up.select(*keep, F.transform("bits", lambda x: (x / copies).cast("long")).alias("bits"), F.explode(F.sequence(F.lit(1), copies)).alias("_copy")).drop("_copy")


def identify(docs: DataFrame, order: int = ORDER, part: int = PART) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of the rows that are not held out; a row without
    doc_id is not held out, and repeated rows are learnt as often as they occur.
    ``score`` is the share of the best language if languages weigh 2 to the power of
    minus their code length.  Equal code lengths give the first name.  A null text, one without
    a letter, or any text where nothing could be learnt, is ``und`` with score 0.  Rows
    with the same doc_id are judged one by one; an empty table gives no rows; other
    columns are ignored.  Long texts are coded whole, a megabyte at a time.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    languages = Languages(slim.where(~held_out()), order, part)
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    result = [F.col("doc_id"), held_out().alias("held_out")]
    if not languages.names:
        return slim.select(*result, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    texts = slim.withColumn("letters", letters)
    if len(languages.parts) > 1:
        texts = texts.withColumn("digest", F.xxhash64("text"))
    keep = [c for c in texts.columns if c not in ("text", "lang")]
    coded = languages.lengths(texts, keep).withColumn("least", F.array_min("bits"))
    weights = F.aggregate("bits", F.lit(0.0), lambda total, x: total + F.pow(F.lit(2.0), (F.col("least") - x) / UNIT))
    name = F.element_at(F.array(*map(F.lit, languages.names)), F.array_position("bits", F.col("least")).cast("int"))
    return coded.select(
        *result, F.when(F.col("letters"), name).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("letters"), 1 / weights).otherwise(F.lit(0.0)).alias("score")
    )
