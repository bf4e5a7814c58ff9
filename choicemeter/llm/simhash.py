"""SimHash near-duplicates: bit-sliced comparison within buckets, then components.

Fingerprints within ``radius`` 2 of each other differ in at most two of four blocks of
16 bits, so they agree in some pair of blocks: six keys of 32 bits each.  Distinct
fingerprints that share a key are compared bit-sliced: bit b of all of them is one long
plane of bits, mismatches with a fingerprint are added into carry-save counters for
all at once, and the comparison is abandoned as soon as every counter is beyond the radius.
A key with many fingerprints is split by the same rule within its other 32 bits, which
leaves at most 2^16 fingerprints a bucket.  A bucket gives a spanning forest of its links,
never its pairs, and components come from alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemeter.llm.common import frozen, slices

SPLIT = 4096


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bits set in over half the hashes of the text's shingles, as a signed number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (a hash of the text) and fp of every row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = [fingerprint(text) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(fp, pa.int64())], ["doc_id", "digest", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return slim.mapInArrow(build, "doc_id long, digest long, fp long")


def forest(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what ``radius`` joins among distinct fingerprints, at most one less than there are."""
    n, raw = len(fps), fps.view(np.uint64)
    full = (1 << n) - 1
    differing = int(np.bitwise_or.reduce(raw) ^ np.bitwise_and.reduce(raw))
    planes = []
    for b in range(64):
        if differing >> b & 1:
            ones = np.packbits((raw >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little")
            planes.append((b, int.from_bytes(ones.tobytes(), "little")))
    # Counters start so that the count beyond the radius carries out of the top bit.
    width = (radius + 1).bit_length()
    start = (1 << width) - 1 - radius
    zero = [full if start >> i & 1 else 0 for i in range(width)]
    values, left, queue = raw.tolist(), full, []
    while left or queue:
        if not queue:
            first = left & -left
            queue.append(first.bit_length() - 1)
            left ^= first
        at = queue.pop()
        own, counters, over = values[at], list(zero), full ^ left
        for b, plane in planes:
            carry = plane ^ full if own >> b & 1 else plane
            for i in range(width):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
            if over == full:
                break
        near = full ^ over
        left ^= near
        while near:
            low = near & -near
            near ^= low
            other = low.bit_length() - 1
            queue.append(other)
            yield int(fps[at]), int(fps[other])


def block(bits: Column, i: int) -> Column:
    return F.shiftrightunsigned(bits, 16 * i).bitwiseAND(0xFFFF)


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) links whose components are those of all fingerprints within the radius (2 at most)."""
    if radius > 2:
        raise ValueError("two of four blocks agree only up to a radius of 2")
    pairs = list(combinations(range(4), 2))
    keys = nodes.select("fp", F.explode(F.array(*(F.lit(i) * (1 << 32) + block(F.col("fp"), a) * 65536 + block(F.col("fp"), b) for i, (a, b) in enumerate(pairs)))).alias("key"))
    # Written, so that the join below is one of two plain shuffles, which Spark splits where a key is hot.
    sizes = frozen(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "simhash_key_sizes")
    shared = frozen(keys.join(sizes, "key"), "simhash_keys")
    # The other 32 bits of a large key, as 4 blocks of 8.
    rest = F.element_at(F.array(*(block(F.col("fp"), c) * 65536 + block(F.col("fp"), d) for c, d in reversed(pairs))), (F.shiftright("key", 32) + 1).cast("int"))
    octet = lambda i: F.shiftrightunsigned("rest", 8 * i).bitwiseAND(0xFF)
    parts = F.array(*(F.lit(1 + i) * 65536 + octet(a) * 256 + octet(b) for i, (a, b) in enumerate(pairs)))
    buckets = shared.withColumn("rest", rest).select("fp", "key", F.explode(F.when(F.col("size") > SPLIT, parts).otherwise(F.array(F.lit(0).cast("long")))).alias("sub"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def found(runs: list[np.ndarray]) -> pa.RecordBatch | None:
            fps = np.concatenate(runs)
            out = list(forest(fps, radius)) if len(fps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"]) if out else None

        for batch in batches:
            fp, key, sub = (batch.column(c).to_numpy() for c in ("fp", "key", "sub"))
            if not len(fp):
                continue
            cuts = np.nonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                name = (key[a], sub[a])
                if name != last and held:
                    if (out := found(held)) is not None:
                        yield out
                    held = []
                held.append(fp[a:b])
                last = name
        if held and (out := found(held)) is not None:
            yield out

    dealt = buckets.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return dealt.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node with a link; the root is the least node of its component."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Written, so that the join is one of two plain shuffles: Spark splits the root of a giant component, which has all its edges.
        least = frozen(least, "least")
        joined = both.join(least, "a")
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = frozen(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = frozen(stars(stars(edges, True), False), "stars")
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, digest, fp and component_id of every row.

    A text without words (null included) has fingerprint 0 and links like any other.
    Rows with the same fingerprint are linked, so repeated rows share a component.  Rows
    without doc_id take part but never name a component: component_id is null where no
    row of the component has a doc_id.  An empty table gives an empty result, other
    columns are ignored.
    """
    rows = frozen(fingerprints(docs), "fingerprints")
    nodes = frozen(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = frozen(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = frozen(named.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "digest", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The documents that stay: of each component the one with the smallest doc_id.

    Rows without doc_id can't be named and all stay.  Rows with the same doc_id are told
    apart by their text; of several that could stay, one stays.
    """
    found = near_duplicates(docs, radius).where("doc_id is not null")
    first = F.col("doc_id") == F.col("component_id")
    several = frozen(
        found.where(first).groupBy("doc_id").agg(F.min("digest").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated_ids"
    )
    others = found.where(first).join(several, "doc_id").where("digest <> least")
    copies = found.where(~first).select("doc_id", "digest").union(others.select("doc_id", "digest")).distinct()
    # Those to go are fewer than those to stay, and those in several rows rarer still.
    copies = frozen(copies.select(F.col("doc_id").alias("_copy_id"), F.col("digest").alias("_copy_digest")), "copies")
    several = several.select(F.col("doc_id").alias("_again_id"))
    number = F.col("doc_id").cast("long")
    rest = docs.join(copies, (number == F.col("_copy_id")) & (F.xxhash64("text") == F.col("_copy_digest")), "left_anti")
    once = rest.join(several, number == F.col("_again_id"), "left_anti")
    more = rest.join(several, number == F.col("_again_id"), "left_semi").dropDuplicates(["doc_id"])
    return once.union(more)
