"""Exact removal of repeated byte strings with a sampled, enhanced suffix array.

Strings of ``LENGTH`` bytes are looked for.  Suffixes are sampled so that none is missed:
in each string the least hash of its 32-byte grams marks an anchor, and equal strings mark
the same one (ties mark all).  Anchors are dealt by the hash of their gram, so suffixes
that share their first 32 bytes meet; about one suffix in 35 is dealt at all.

  1. Occurrences with the same surroundings (all strings around the anchor equal) form a
     class.  Its first occurrence stands for it; the others repeat it wholly.  Classes are
     reduced within tasks before the shuffle.
  2. Where a gram has several classes, their first occurrences are sorted as suffixes.  A
     stack scan over the common prefix lengths gives the tree of prefix intervals; in
     each interval occurrences are parted by ever longer left extensions, which gives
     the groups of repeats with all their occurrences.  In a group all but the first repeat.

Spark deals and sorts the rows; a task sees the suffixes of some grams at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemeter.llm.common import frozen, slices, utf8
from choicemeter.llm.repetition import BASE, LETTER, ladder, mixed

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # grams of a string
LEFT = LENGTH - GRAM  # bytes before an anchor that a string with it may have
NO_ID = -(1 << 63)
HOLD = 40_000  # suffixes that are treated together at least
HOT = 200_000  # suffixes of one gram beyond which its strings are compared one by one


def power(e: int) -> np.uint64:
    return np.uint64(pow(int(BASE), e, 1 << 64))


def grams(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place, by doubling."""
    h, width = LETTER[data], 1
    while width < GRAM:
        h = h[:-width] * power(width) + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of ``width`` neighbours from each place, by doubling."""
    n = 1
    while 2 * n <= width:
        x = best(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return best(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, gram hash, surroundings hash, bytes left, bytes right) of every anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none, none
    h = grams(data)
    least = slide(h, SPAN, np.minimum)
    for end in offsets[1:-1]:  # strings must not cross texts
        least[max(0, end - LENGTH + 1) : end] = 0
    pad = np.zeros(SPAN - 1, np.uint64)
    at = np.nonzero((slide(np.concatenate([pad, least, pad]), SPAN, np.maximum)[: len(h)] == h) & (h > 0))[0]
    text = np.searchsorted(offsets, at, side="right") - 1
    begin, end = offsets[text], offsets[text + 1]
    left, right = np.minimum(at - begin, LEFT), np.minimum(end - at, LENGTH)
    up, down = ladder(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTER[data] * up[: len(data)], out=run[1:])
    around = (run[at + right] - run[at - left]) * down[at - left] + (left * 128 + right).astype(np.uint64)
    return text, at - begin, h[at].view(np.int64), mixed(around).view(np.int64), left, right


def texts(docs: DataFrame) -> DataFrame:
    """id (null ids first), tag and text; the tag tells rows apart that share a doc_id but not the text."""
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    twice = frozen(slim.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("shared")), "shared_ids")
    tag = F.when(F.col("shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return slim.join(twice, "id", "left").select("id", tag.alias("tag"), "text")


def sampled(rows: DataFrame) -> DataFrame:
    """Anchors (key: their gram) and, with a negative ``ext``, occurrences already known to repeat (any key)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(batch, "text", 1 << 18):
                text, at, gram, around, left, right = anchors(*utf8(part.column("text")))
                ids, tags = part.column("id").to_numpy(), part.column("tag").to_numpy()
                found.append((gram, around, ids[text], tags[text], at, left << 8 | right))
            if not found:
                continue
            key, around, ids, tags, loc, ext = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((loc, tags, ids, around, key))
            key, around, ids, tags, loc, ext = (c[order] for c in (key, around, ids, tags, loc, ext))
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (around[1:] == around[:-1])
            same_place = np.zeros(len(key), bool)
            same_place[1:] = again[1:] & (ids[1:] == ids[:-1]) & (tags[1:] == tags[:-1]) & (loc[1:] == loc[:-1])
            # Repeats need not meet their gram: they are dealt evenly.
            key = np.where(again, mixed((loc.astype(np.uint64) * BASE + tags.astype(np.uint64)) * BASE + ids.astype(np.uint64)).view(np.int64), key)
            keep = ~same_place
            columns = (key, np.where(again, 0, around), ids, tags, loc, np.where(again, -ext, ext))
            for i in range(0, len(key), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(c[part][keep[part]]) for c in columns], ["key", "around", "id", "tag", "loc", "ext"])

    return rows.mapInArrow(build, "key long, around long, id long, tag long, loc long, ext long")


def classes(dealt: DataFrame) -> DataFrame:
    """Repeats (gram null) and the first occurrences of grams with several classes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_around = pending = last_place = None
        several = False
        names = ["id", "tag", "loc", "ext", "gram"]

        def rows(ids, tags, loc, ext, gram=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags), pa.array(loc), pa.array(ext), pa.nulls(len(ids), pa.int64()) if gram is None else pa.array(gram)], names)

        for batch in batches:
            key, around, ids, tags, loc, ext = (batch.column(c).to_numpy() for c in ("key", "around", "id", "tag", "loc", "ext"))
            known = ext < 0
            if known.any():
                yield rows(ids[known], tags[known], loc[known], -ext[known])
                key, around, ids, tags, loc, ext = (c[~known] for c in (key, around, ids, tags, loc, ext))
            if not len(key):
                continue
            new_key, new_class, moved = (np.ones(len(key), bool) for _ in range(3))
            new_key[1:] = key[1:] != key[:-1]
            new_class[1:] = new_key[1:] | (around[1:] != around[:-1])
            moved[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (loc[1:] != loc[:-1])
            new_key[0] = key[0] != last_key
            new_class[0] = new_key[0] or around[0] != last_around
            moved[0] = (ids[0], tags[0], loc[0]) != last_place
            repeats = ~new_class & moved
            if repeats.any():
                yield rows(ids[repeats], tags[repeats], loc[repeats], ext[repeats])
            run = np.cumsum(new_key)  # 0: goes on with the last gram of the batch before
            count = np.bincount(run[new_class], minlength=run[-1] + 1)
            if count[0]:  # another class of that gram
                if pending is not None:
                    yield rows(*pending)
                    pending = None
                several = True
            many = count > 1
            many[0] = several
            out = new_class & many[run]
            if out.any():
                yield rows(ids[out], tags[out], loc[out], ext[out], key[out])
            if run[-1]:
                several = bool(many[-1])
                pending = None
                if not several:
                    i = int(np.nonzero(new_key)[0][-1])
                    pending = tuple(c[i : i + 1].copy() for c in (ids, tags, loc, ext, key))
            last_key, last_around, last_place = key[-1], around[-1], (ids[-1], tags[-1], loc[-1])

    return dealt.mapInArrow(scan, "id long, tag long, loc long, ext long, gram long")


def packed(rows: DataFrame) -> DataFrame:
    """Texts compressed for a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, "text"):
                data = [squeeze(t.encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), pa.array(data, pa.binary())], ["id", "tag", "data"])

    return rows.mapInArrow(pack, "id long, tag long, data binary")


def contexts(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The bytes around first occurrences: gram, id, tag, loc, before (the last byte first) and suffix."""
    wanted = firsts.groupBy("id", "tag").agg(F.collect_list(F.struct("loc", "gram")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expand = zstandard.ZstdDecompressor().decompress
            for one in slices(batch, "data"):
                out = []
                for id_, tag, data, places in zip(*(one.column(c).to_pylist() for c in ("id", "tag", "data", "wanted")), strict=True):
                    data = expand(data)
                    for at, gram in {(p["loc"], p["gram"]) for p in places}:
                        out.append((gram, id_, tag, at, data[max(0, at - LEFT) : at][::-1], data[at : at + LENGTH]))
                if out:
                    columns = zip(*out, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gram", "id", "tag", "loc", "before", "suffix"])

    return packed(rows).join(wanted, ["id", "tag"]).select("id", "tag", "data", "wanted").mapInArrow(cut, "gram long, id long, tag long, loc long, before binary, suffix binary")


def padded(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of ``width`` numbers (256 beyond their end), and their lengths."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(1, np.uint8)
    size = np.diff(at)
    spots = at[:-1, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    return np.where(inside, raw[np.minimum(spots, len(raw) - 1)], 256).astype(np.int16), size


def intervals(common: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(first, end, depth, parent's depth) of the prefix intervals of depth ``least`` or more.

    ``common[i]``: common prefix of suffixes i - 1 and i.  One scan with a stack.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []  # depth, first
    for i, depth in enumerate([*common.tolist(), -1]):
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            above = max(depth, stack[-1][0] if stack else -1, least - 1)
            out.append((first, i, top, above))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def repeat_groups(common: np.ndarray, before: np.ndarray, before_size: np.ndarray, order: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Groups of repeats of ``length`` bytes or more: (group, member, left extension, depth), the first of a group first.

    An interval of depth d needs left extensions of length - d; its members are parted by
    ever longer ones, as long as some are shared and no wider interval has the string.
    """
    first, end, depth, parent = intervals(common, gram)
    n, most = before.shape
    lefts = np.zeros((most + 1, n), np.uint64)
    for i in range(most):
        lefts[i + 1] = lefts[i] * BASE + LETTER[np.minimum(before[:, i], 255)] + np.uint64(1)
    need = np.maximum(length - depth, 0)
    alive = np.arange(len(first))
    while len(alive):
        size = (end - first)[alive]
        node = np.repeat(alive, size)
        member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[node]
        fits = before_size[member] >= need[node]
        node, member = node[fits], member[fits]
        value = lefts[need[node], member]
        by = np.lexsort((order[member], value, node))
        node, member, value = node[by], member[by], value[by]
        opens = np.ones(len(node), bool)
        opens[1:] = (node[1:] != node[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(opens) - 1
        shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else opens
        yield group[shared], member[shared], need[node[shared]], depth[node[shared]]
        alive = np.unique(node[shared])
        need[alive] += 1
        alive = alive[(need[alive] <= most) & (length - need[alive] > parent[alive])]


def repeats(around: DataFrame) -> DataFrame:
    """The places (id, tag, loc, ext) around which a string of an earlier place repeats."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        # a document that stands in several rows has its places once
        place = np.stack([rows[c].to_numpy() for c in ("gram", "id", "tag", "loc")])
        fresh = np.ones(rows.num_rows, bool)
        fresh[1:] = (place[:, 1:] != place[:, :-1]).any(0)
        rows = rows.filter(pa.array(fresh)).combine_chunks()
        suffix, suffix_size = padded(rows["suffix"].chunk(0), LENGTH)
        before, before_size = padded(rows["before"].chunk(0), LEFT)
        gram, ids, tags, loc = (rows[c].to_numpy() for c in ("gram", "id", "tag", "loc"))
        common = np.zeros(len(gram), np.int64)
        unequal = suffix[1:] != suffix[:-1]
        common[1:] = np.where(unequal.any(1), unequal.argmax(1), LENGTH)
        common[1:] = np.minimum(common[1:], np.minimum(suffix_size[1:], suffix_size[:-1]))
        common[1:][gram[1:] != gram[:-1]] = 0
        order = np.empty(len(gram), np.int64)
        order[np.lexsort((loc, tags, ids))] = np.arange(len(gram))
        left, right = np.full(len(gram), -1), np.zeros(len(gram), np.int64)
        for group, member, need, depth in repeat_groups(common, before, before_size, order):
            later = np.zeros(len(group), bool)
            later[1:] = group[1:] == group[:-1]
            np.maximum.at(left, member[later], need[later])
            np.maximum.at(right, member[later], depth[later])
        hit = left >= 0
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(tags[hit]), pa.array(loc[hit]), pa.array(left[hit] << 8 | right[hit])], ["id", "tag", "loc", "ext"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            # whole grams up to the last one of the batch, which may go on
            cut = 0 if gram[0] == gram[-1] else int(np.nonzero(gram != gram[-1])[0][-1]) + 1
            if count >= HOLD and held[-1].column("gram")[-1].as_py() != gram[0]:
                yield from solve(pa.Table.from_batches(held))
                held, count = [], 0
            if cut and count + cut >= HOLD:
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, count = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield from solve(pa.Table.from_batches(held))

    dealt = around.repartition("gram").sortWithinPartitions("gram", "suffix", "id", "tag", "loc")
    return dealt.mapInArrow(scan, "id long, tag long, loc long, ext long")


def repeats_of_hot_grams(around: DataFrame) -> DataFrame:
    """The same for grams of too many suffixes for a task: their strings are grouped, one row each."""
    lefts = F.explode(F.sequence(F.lit(0), F.lit(LEFT))).alias("l")
    strings = around.select("id", "tag", "loc", "suffix", "before", lefts).where(f"l <= length(before) and {LENGTH} - l <= length(suffix)")
    both = [F.expr("substring(before, 1, l)"), F.expr(f"substring(suffix, 1, {LENGTH} - l)")]
    strings = strings.select("id", "tag", "loc", "l", F.xxhash64(*both).alias("h1"), F.xxhash64(F.lit(1), *both).alias("h2"))
    keys = ["l", "h1", "h2"]
    first = strings.groupBy(*keys).agg(F.min(F.struct("id", "tag", "loc")).alias("first"))
    later = strings.join(first, keys).where("struct(id, tag, loc) <> first")
    return later.select("id", "tag", "loc", F.shiftleft(F.col("l").cast("long"), 8).bitwiseOR(LENGTH - F.col("l")).alias("ext"))


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts, and the stretches (id, tag, loc, ext) of them that repeat earlier strings."""
    rows = texts(docs)
    dealt = sampled(rows).repartition("key").sortWithinPartitions("key", "around", "id", "tag", "loc")
    marks = frozen(classes(dealt), "marks")
    firsts = marks.where("gram is not null")
    hot = frozen(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("gram"), "hot_grams")
    found = repeats(contexts(rows, firsts.join(hot, "gram", "left_anti")))
    if not hot.isEmpty():
        found = found.union(repeats_of_hot_grams(contexts(rows, firsts.join(hot, "gram", "left_semi"))))
    return rows, marks.where("gram is null").select("id", "tag", "loc", "ext").union(found)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    Removed is each byte within a string of LENGTH bytes that also starts earlier: at a
    smaller doc_id, or earlier in the same text.  Null ids come first.  Rows that share a
    doc_id (null included) but not the text are ordered by the text's 64-bit hash; rows equal in
    both are one document and come out alike.  A null or empty text has no bytes.  Long
    texts are treated whole.  An empty table gives an empty result; other columns are
    ignored.
    """
    rows, found = spans(docs)
    pieces = found.groupBy("id", "tag").agg(F.collect_list(stretch("loc", "ext")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, "data"):
                out = []
                for id_, data, some in zip(*(part.column(c).to_pylist() for c in ("id", "data", "spans")), strict=True):
                    data, kept, at, gone, runs = expand(data), hashlib.sha256(), 0, 0, 0
                    last = -1
                    for value in sorted(some or ()):
                        begin, end = value >> 32, value & 0xFFFFFFFF
                        if begin > last:
                            runs += 1
                            kept.update(data[at:begin])
                        begin = max(begin, at)
                        if end > begin:
                            gone += end - begin
                            at = last = end
                    kept.update(data[at:])
                    out.append((None if id_ == NO_ID else id_, len(data), gone, runs, kept.hexdigest()))
                if out:
                    kinds = (pa.int64(),) * 4 + (pa.string(),)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    whole = packed(rows).join(pieces, ["id", "tag"], "left").select("id", "data", "spans")
    return whole.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def stretch(loc: str, ext: str) -> Column:
    """Begin and end of a stretch as one number, in order of begin."""
    return F.shiftleft(F.col(loc) - F.shiftright(ext, 8), 32).bitwiseOR(F.col(loc) + F.col(ext).bitwiseAND(0xFF))
