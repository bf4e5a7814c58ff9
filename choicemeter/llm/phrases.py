"""Phrases whose words belong together, mined by the stripes pattern.

A prefix of no, one or two words keys a stripe: an associative counter of the words that
follow it.  Tasks fill stripes for a bounded number of words at a time; merged element by
element they answer everything: an element is the count of prefix and next word, the
stripe of the empty prefix has the totals of all words, and the greatest elements of the
longer phrases around a phrase tell whether one of them subsumes it.

A stripe of a common prefix holds the whole vocabulary, so no task ever takes a merged
stripe: those of hot prefixes are dealt in parts by a hash of the next word, elements are
added up, and those below the least count go at once.  All parts of a phrase are as frequent as the phrase, so what is
left answers for every candidate, and prefixes are lengthened level by level: a bit map of
the frequent phrases of one level, of a bounded size, keeps out most of what cannot
be frequent on the next.  A bit set by another phrase lets some more through, and costs
no more than their shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemeter.llm.common import frozen, slices, utf8

LEAST, MOST, TOP, COVER = 10, 3, 2000, 50
# 0xFF, which UTF-8 lacks, stands for the end of a piece.
END = b"\xff"
SPACE = pa.scalar(" ", pa.large_string())
SIGNS = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + END * 10 + b" ")
# Words whose stripes a task fills before it hands them on, and the bytes cut into words at once.
HELD, CUT = 1 << 21, 1 << 20
# Parts that the stripe of a hot prefix is dealt in, by a hash of the next word; that of the empty prefix, which holds all words,
# is dealt in more.  A prefix with 1 / HOT of all words is hot.
PARTS, FIRST_PARTS, HOT = 64, 4096, 5000
# The greatest bit map (16 MB); Spark's seed of xxhash64, and how far a code is turned for each word.
BITS, SEED, TURN = 1 << 27, 42, 21
# Parts a language's candidates are ranked in before the best of all are.
RANK_PARTS = 64


class Bits:
    """A bit map of phrases: each sets two bits by its code."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __contains__(self, code: int) -> bool:
        return bool(self.have(np.array([code], np.uint64))[0])

    def have(self, codes: np.ndarray) -> np.ndarray:
        found = np.ones(len(codes), bool)
        for a in range(0, len(codes), 1 << 18):
            some = slice(a, a + (1 << 18))
            for half in (codes[some], codes[some] >> np.uint64(32)):
                at = half & np.uint64(64 * len(self.words) - 1)
                found[some] &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


@dataclass
class Before:
    """What a level learns from the one before: its frequent phrases, and the codes of those that hold 1 / HOT of all words or more."""

    frequent: Bits
    hot: np.ndarray


def coded(lang: Column, words: Column) -> Column:
    """The code of a phrase: hashes of its language and words, each turned and mixed in."""
    turned = lambda c: F.shiftleft(c, TURN).bitwiseOR(F.shiftrightunsigned(c, 64 - TURN))
    return F.aggregate(words, F.xxhash64(lang), lambda code, w: turned(code).bitwiseXOR(F.xxhash64(w)))


def lengthened(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Codes of phrases with one word more."""
    return (codes << np.uint64(TURN) | codes >> np.uint64(64 - TURN)) ^ words


def bit_map(phrases: DataFrame) -> Bits:
    """The bit map of (lang, words) rows: 16 bits a phrase or more, up to BITS in all."""
    some = phrases.select(coded(F.col("lang"), F.col("words")).alias("code"))
    size = min(BITS, max(1 << 10, 1 << (16 * some.count()).bit_length()))
    places = some.select(F.explode(F.array(F.col("code").bitwiseAND(size - 1), F.shiftrightunsigned("code", 32).bitwiseAND(size - 1))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    rows = words.toArrow()  # size / 64 rows at most
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Bits(out)


class Stripes:
    """Counters of next words by prefixes of ``level`` - 1 words, for a bounded number of words of several languages."""

    def __init__(self, level: int, before: Before | None = None):
        self.level, self.before = level, before
        self.ids: dict[bytes, int] = {END: 0}
        self.held: dict[str, list[np.ndarray]] = {}
        self.known: dict[str, int] = {}  # words at a begin that stripes before these counted
        self.size = 0

    def add(self, lang: str, words: list[bytes], known: int = 0) -> None:
        ids = self.ids
        fresh = [w for w in set(words) if w not in ids]
        ids.update(zip(fresh, range(len(ids), len(ids) + len(fresh)), strict=True))
        if known:
            self.known[lang] = known
        self.held.setdefault(lang, []).append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def starts(self, lang: str, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where phrases of ``level`` words begin whose parts may be frequent."""
        count = max(0, len(ids) - self.level + 1)
        fits = np.ones(count, bool)
        for j in range(self.level):
            fits &= ids[j : j + count] > 0
        fits[: max(0, self.known.get(lang, 0) - self.level + 1)] = False
        if self.before:
            codes = np.full(count + 1, xxhash.xxh64_intdigest(lang.encode(), SEED), np.uint64)
            for j in range(self.level - 1):
                codes = lengthened(codes, hashes[ids[j : j + count + 1]])
            have = self.before.frequent.have(codes)
            fits &= have[:-1] & have[1:]
        return np.flatnonzero(fits)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(lang, prefix, part, next, count) rows: a stripe's words in a part, and their counts, each in one text."""
        listed = list(self.ids)
        words = pa.array([b"", *listed[1:]], pa.large_binary()).cast(pa.large_string())
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in listed), np.uint64, len(listed))
        parts_of = (hashes % np.uint64(PARTS if self.before else FIRST_PARTS)).astype(np.int64)
        for lang in list(self.held):
            ids = np.concatenate(self.held.pop(lang))
            starts = self.starts(lang, ids, hashes)
            # the prefix so far, as its place among all of them
            place, texts = np.zeros(len(starts), np.int64), pa.array([""], pa.large_string())
            codes = np.full(1, xxhash.xxh64_intdigest(lang.encode(), SEED), np.uint64)
            for j in range(self.level - 1):
                pairs, place = np.unique(place * len(words) + ids[starts + j], return_inverse=True)
                tail = words.take(pa.array(pairs % len(words)))
                texts = tail if j == 0 else pc.binary_join_element_wise(texts.take(pa.array(pairs // len(words))), tail, SPACE)
                codes = lengthened(codes[pairs // len(words)], hashes[pairs % len(words)])
            pairs, count = np.unique(place * len(words) + ids[starts + self.level - 1], return_counts=True)
            del ids, starts, place
            hot = np.isin(codes, self.before.hot) if self.before else np.ones(1, bool)
            prefix = pairs // len(words)
            key = prefix * FIRST_PARTS + np.where(hot[prefix], parts_of[pairs % len(words)], 0)
            yield from self._rows(lang, texts, words, key, pairs, count)

    def _rows(self, lang: str, texts: pa.Array, words: pa.Array, key: np.ndarray, pairs: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key, kind="stable")
        key, pairs, count = key[order], pairs[order], count[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        for a in range(0, len(first), 1 << 15):
            some = first[a : a + (1 << 15)]
            end = first[a + len(some)] if a + len(some) < len(first) else len(pairs)
            offsets = pa.array(np.append(some, end) - some[0], pa.int64())
            joined = lambda values: pc.binary_join(pa.LargeListArray.from_arrays(offsets, values), SPACE).cast(pa.string())  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(some), pa.string()),
                    "prefix": texts.take(pa.array(key[some] // FIRST_PARTS)).cast(pa.string()),
                    "part": pa.array(key[some] % FIRST_PARTS, pa.int32()),
                    "next": joined(words.take(pa.array(pairs[some[0] : end] % len(words)))),
                    "count": joined(pa.array(count[some[0] : end], pa.int64()).cast(pa.large_string())),
                }
            )


def cuts(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes; no word is cut."""
    begin = 0
    while begin < len(text):
        end = begin + size
        if end >= len(text):
            yield text[begin:]
            return
        after = [x for x in (text.find(b" ", end), text.find(END, end)) if x >= 0]
        end = min(after) if after else len(text)
        yield text[begin:end]
        begin = end


def fill(batches: Iterator[pa.RecordBatch], level: int, before: Before | None) -> Iterator[pa.RecordBatch]:
    """Stripes of all texts of a task."""
    stripes = Stripes(level, before)
    for batch in batches:
        for part in slices(batch, "text", CUT):
            langs = part.column("lang")
            for lang in pc.unique(langs).to_pylist():
                data, at = utf8(part.filter(pc.equal(langs, lang)).column("text"))
                raw = data.tobytes()
                text = END.join(raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)).translate(SIGNS) + END
                for some in cuts(text, CUT):
                    words = some.replace(END, b" " + END + b" ").split()
                    stripes.add(lang, words)
                    if stripes.size >= HELD:
                        # a phrase may go on behind the words counted so far
                        carried = np.concatenate(stripes.held[lang])[1 - level :] if level > 1 else []
                        listed = list(stripes.ids)
                        yield from stripes.batches()
                        stripes = Stripes(level, before)
                        stripes.add(lang, [listed[i] for i in carried], len(carried))
    yield from stripes.batches()


def phrase_counts(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(lang, prefix, next, count): the merged stripes, written.

    Elements of fewer than ``least`` occurrences are left out but for the empty prefix,
    whose stripe counts all words.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    levels: list[DataFrame] = []
    sent: Broadcast | None = None
    for level in range(1, most + 1):

        def count(batches: Iterator[pa.RecordBatch], level=level, sent=sent) -> Iterator[pa.RecordBatch]:
            yield from fill(batches, level, Before(Bits(sent.value[0]), sent.value[1]) if sent else None)

        # Tasks have added up what they hold, so stripes are dealt at once, in parts, and cut into elements where these are added up.
        stripes = texts.mapInArrow(count, "lang string, prefix string, part int, next string, count string").repartition("lang", "prefix", "part")
        elements = stripes.select("lang", "prefix", "part", F.inline(F.arrays_zip(F.split("next", " ").alias("next"), F.split("count", " ").alias("count"))))
        merged = elements.groupBy("lang", "prefix", "part", "next").agg(F.sum(F.col("count").cast("long")).alias("count")).drop("part")
        levels.append(frozen(merged.where((F.col("count") >= least) | F.lit(level == 1)), f"stripes_{level}"))
        if level < most:
            words = F.concat(F.filter(F.split("prefix", " "), lambda w: w != ""), F.array("next"))
            total = levels[0].agg(F.sum("count")).first()[0] or 0
            hot = levels[-1].where(F.col("count") * HOT > total).select(coded(F.col("lang"), words).alias("code")).toArrow()  # fewer than HOT
            bits = bit_map(levels[-1].where(F.col("count") >= least).select("lang", words.alias("words")))
            sent = docs.sparkSession.sparkContext.broadcast((bits.words, hot.column("code").to_numpy().view(np.uint64)))
    return reduce(DataFrame.union, levels)


def phrases(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """Per language its ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A null lang is ``und``; a null or wordless text has no words; repeated rows count as
    often as they occur, whatever their ids.  An empty table, or one without a phrase of
    ``least`` occurrences, gives no rows; other columns are ignored.  Equal scores go by
    ``a``, then by the phrase's bytes.  Texts are cut into words a megabyte at a time
    (one word may be longer), so a very long one needs no more memory than others.
    Counts up to 10^15 are exact.
    """
    counts = phrase_counts(docs, least, most)
    total = counts.where("prefix = ''").groupBy("lang").agg(F.sum("count").alias("n"))
    named = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    frequent = counts.where(F.col("count") >= least).select("lang", named.alias("phrase"), F.col("count").alias("a"))
    frequent = frozen(frequent.withColumn("size", F.size(F.split("phrase", " "))), "frequent_phrases")
    candidates = frequent.where("size > 1")

    words = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first, rest = F.slice(words, F.lit(1), F.col("k")), F.slice(words, F.col("k") + 1, F.col("size") - F.col("k"))
    cut = cut.withColumn("first", F.array_join(first, " ")).withColumn("rest", F.array_join(rest, " "))
    cut = cut.join(frequent.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cut = cut.join(frequent.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    wide = lambda name: F.col(name).cast("decimal(16,0)")
    cut = cut.withColumn("above", wide("a") * wide("a") * F.lit(1000000).cast("decimal(7,0)")).withColumn("below", wide("l") * wide("r"))
    cut = cut.withColumn("score", F.expr("above div below").cast("long"))
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Phrases within a longer one, with the greatest count of those around them.
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, n), " ")),
        )
    )
    around = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    kept = frozen(kept, "kept_phrases")
    # Most phrases are out of reach by their score alone: counts by steps of it (and by size of a for the highest score,
    # which many may share) tell from which step on the best lie.
    step = F.when(F.col("score") >= 1000000, 1000 + F.length(F.bin("a"))).otherwise(F.floor(F.col("score") / 1000)).cast("int")
    steps = kept.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("phrases"))
    above = F.coalesce(F.sum("phrases").over(Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = frozen(steps.withColumn("above", above).where(F.col("above") < top).groupBy("lang").agg(F.min("step").alias("reach")), "reach")
    kept = kept.join(reach, "lang").where(step >= F.col("reach")).drop("reach")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = some.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.where(F.col("rank") <= top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
