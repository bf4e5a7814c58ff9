"""Records of CSV files, read by as many tasks as the files have blocks.

A quoted cell may hold line ends, so where a block begins, only what lies before it tells
whether its first line begins a record.  A first pass reads every block on its own and
finds, for either answer, where it ends and how many records begin in it.  These small
rows are composed along each file: a block either keeps, turns or settles the state, so
running sums and the last settled block give every block's state and its first record's number.
A second pass then cuts each block into records with their numbers.  A record that goes over
the end of a block comes in pieces, which are put together by file and number.

What tasks get to know of the blocks has some 40 bytes a block, whatever the block holds.

A record with more cells than its file's header, or a quote that is never closed, is a
fault; one with fewer cells has nulls.  Lines end with a line feed, before which one
carriage return is dropped.  A file's header must lie in its first block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicemeter.session import scratch_dir

RECORD, FAULT, ROW, PATH = "_record", "_fault", "_row", "_path"
OPEN_QUOTE = "a quote is not closed"


class Rules:
    """Patterns of cells and lines for one separator."""

    def __init__(self, sep: str):
        c = re.escape(sep)
        cell = rf'(?:"[^"]*+(?:""[^"]*+)*+"[^{c}]*+|[^"{c}][^{c}]*+|)'
        self.sep = sep
        self.whole = re.compile(rf"{cell}(?:{c}{cell})*+\Z")
        self.closes = re.compile(rf'[^"]*+(?:""[^"]*+)*+"[^{c}]*+(?:{c}{cell})*+\Z')
        self.cell = re.compile(rf'(?:"([^"]*+(?:""[^"]*+)*+)"([^{c}]*+)|([^{c}]*+)){c}')

    def after(self, line: str, inside: bool) -> bool:
        """Whether a line that begins inside a quoted cell, or at a record, ends inside one."""
        return not (self.closes if inside else self.whole).match(line)

    def cells(self, record: str) -> list[str]:
        return [m[3] if m[1] is None else m[1].replace('""', '"') + m[2] for m in self.cell.finditer(record + self.sep)]


def lines(spark: SparkSession, path: str | list[str], **listing) -> DataFrame:
    meta = F.col("_metadata.file_path")
    start = F.col("_metadata.file_block_start")
    return spark.read.options(lineSep="\n", **listing).text(path).select("value", meta.alias(PATH), F.xxhash64(meta).alias("file"), start.alias("start"))


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The rows of a batch by block, in order: file, start, rows."""
    file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
    cut = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    edges = [0, *cut.tolist(), len(file)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield int(file[a]), int(start[a]), batch.slice(a, b - a)


def quoted_lines(values: pa.Array) -> list[tuple[int, str]]:
    places = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
    return list(zip(places.tolist(), values.take(pa.array(places)).to_pylist(), strict=True))


def solid(values: pa.Array) -> np.ndarray:
    """Lines that hold more than blanks."""
    return pc.greater(pc.binary_length(pc.ascii_trim_whitespace(values)), 0).to_numpy(zero_copy_only=False)


def states(quoted: list[tuple[int, str]], count: int, inside: bool, rules: Rules | None) -> tuple[np.ndarray, bool]:
    """Whether each of ``count`` lines begins inside a quoted cell, and whether the last ends so; without rules none does."""
    out = np.zeros(count, bool)
    if rules is None:
        return out, False
    at = 0
    for place, line in quoted:
        out[at : place + 1] = inside
        at, inside = place + 1, rules.after(line, inside)
    out[at:] = inside
    return out, inside


@dataclass
class BlockState:
    """What a block comes to so far if it begins outside (0) or inside (1) a quoted cell."""

    path: str
    end: list[bool] = field(default_factory=lambda: [False, True])
    begun: list[int] = field(default_factory=lambda: [0, 0])
    first: list[str] | None = None  # the lines of the first record
    header: list[str] | None = None


def survey(batches: Iterator[pa.RecordBatch], sep: str, multi_line: bool) -> Iterator[pa.RecordBatch]:
    """A row per block; see ``BlockState``."""
    rules = Rules(sep)
    found: dict[tuple[int, int], BlockState] = {}
    for batch in batches:
        for file, start, rows in stretches(batch):
            values = rows.column("value")
            block = found.setdefault((file, start), BlockState(rows.column(PATH)[0].as_py()))
            quoted, filled = quoted_lines(values) if multi_line else [], solid(values)
            for s in (0, 1):
                inside, block.end[s] = states(quoted, len(values), block.end[s], rules if multi_line else None)
                block.begun[s] += int((filled & ~inside).sum())
            if start == 0 and block.header is None:
                for value in values.to_pylist():
                    if block.first is None and not value.strip():
                        continue
                    block.first = [*(block.first or []), value]
                    text = "\n".join(block.first)
                    if not multi_line or rules.whole.match(text):
                        block.header = rules.cells(text.removesuffix("\r").removeprefix("\ufeff"))
                        break
    columns = [
        pa.array([f for f, _ in found], pa.int64()),
        pa.array([s for _, s in found], pa.int64()),
        pa.array([b.path for b in found.values()], pa.string()),
        *(pa.array([getattr(b, name)[s] for b in found.values()], kind) for s in (0, 1) for name, kind in (("end", pa.bool_()), ("begun", pa.int64()))),
        pa.array([b.header for b in found.values()], pa.list_(pa.string())),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["file", "start", "path", "end0", "begun0", "end1", "begun1", "header"])


SURVEY = "file long, start long, path string, end0 boolean, begun0 long, end1 boolean, begun1 long, header array<string>"


def composed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``inside`` (its begin lies in a quoted cell), ``base`` (records begun before it), ``kind`` of header, and the number of the file's unclosed record."""
    in_file = Window.partitionBy("path").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    settled = F.col("end0") == F.col("end1")
    turns = (F.col("end0") & ~F.col("end1")).cast("long")
    # states of blocks as 0 and 1: a turning block adds 1, a settled one starts anew
    counted = blocks.withColumn("turned", F.sum(turns).over(in_file))
    last = F.last(F.when(settled, F.struct(F.col("end0").cast("long").alias("state"), "turned")), ignorenulls=True).over(before)
    counted = counted.withColumn("last", last).withColumn("before", F.coalesce(F.lag("turned").over(in_file), F.lit(0)))
    state = F.coalesce(F.col("last.state") + F.col("before") - F.col("last.turned"), F.col("before")) % 2 == 1
    known = counted.withColumn("inside", state).withColumn("begun", F.when(F.col("inside"), F.col("begun1")).otherwise(F.col("begun0")))
    whole = Window.partitionBy("path")
    end = F.max_by(F.when(F.col("inside"), F.col("end1")).otherwise(F.col("end0")), "start").over(whole)
    return known.select(
        "file",
        "start",
        "path",
        "inside",
        F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("base"),
        F.xxhash64(F.max("header").over(whole)).alias("kind"),
        F.when(end, F.sum("begun").over(whole) - 1).otherwise(F.lit(-1)).alias("open"),
    )


@dataclass
class Layout:
    """What tasks know of the blocks, sorted by file and start, and the different headers."""

    file: np.ndarray
    start: np.ndarray
    inside: np.ndarray
    base: np.ndarray
    kind: np.ndarray
    open: np.ndarray
    headers: dict[int, list[str]]

    def block(self, file: int, start: int) -> tuple[bool, int, list[str] | None, int]:
        """State, first record's number, header and unclosed record; blocks that were not surveyed count from 1, behind the header."""
        a, b = np.searchsorted(self.file, [file, file + 1])
        at = a + int(np.searchsorted(self.start[a:b], start, side="right")) - 1
        surveyed = self.start[at] == start
        return bool(self.inside[at]) if surveyed else False, int(self.base[at]) if surveyed else 1, self.headers.get(int(self.kind[at])), int(self.open[at])

    @staticmethod
    def of(blocks: pa.Table, headers: dict[int, list[str]]) -> Layout:
        columns = {c: blocks.column(c).to_numpy() for c in ("file", "start", "inside", "base", "kind", "open")}
        order = np.lexsort((columns["start"], columns["file"]))
        columns = {c: v[order] for c, v in columns.items()}
        if ((np.diff(columns["file"]) == 0) & (np.diff(columns["start"]) == 0)).any():
            raise ValueError("two files have the same hash of their path")
        return Layout(**columns, headers=headers)


def layout(blocks: DataFrame) -> Layout:
    """Collect the composed blocks: some 40 bytes each, and each different header once."""
    headers = blocks.where(F.col("header").isNotNull()).select(F.xxhash64("header").alias("kind"), "header").distinct().collect()
    table = composed(blocks).select("file", "start", "inside", "base", "kind", "open").toArrow()
    return Layout.of(table, {r.kind: r.header for r in headers})


def first_records(spark: SparkSession, path: str | list[str], sep: str, **listing) -> list[tuple[str, list[str]]]:
    """(path, header) of each file that has one.

    Spark lists the files; the driver opens each for its first line only, some at a time, so
    what is read of a file is bounded by a buffer.  A task could not stop so early: Spark
    goes on reading ahead of the Python worker it feeds.
    """
    jvm, conf, rules = spark._jvm, spark._jsc.hadoopConfiguration(), Rules(sep)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(name: str) -> tuple[str, list[str]] | None:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = place.getFileSystem(conf).open(place)
        codec = codecs.getCodec(place)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            line = reader.readLine()
            while line is not None and not line.strip():
                line = reader.readLine()
        finally:
            reader.close()
        return None if line is None else (name, rules.cells(line.removeprefix("\ufeff")))

    listed = spark.read.format("binaryFile").options(**listing).load(path).select(F.col("_metadata.file_path").alias("path"))
    with ThreadPoolExecutor(16) as pool:
        return [x for x in pool.map(first, [r.path for r in listed.collect()]) if x]


def first_lines(spark: SparkSession, path: str | list[str], sep: str, **listing) -> Layout:
    """The layout of files whose rows are not numbered and whose records are lines: their headers."""
    found = first_records(spark, path, sep, **listing)
    kinds = list(dict.fromkeys(tuple(header) for _, header in found))
    file = np.array([xxhash64_of(name) for name, _ in found], np.uint64).view(np.int64)
    zero = np.zeros(len(found), np.int64)
    columns = {"file": file, "start": zero, "inside": zero > 0, "base": zero, "kind": np.array([kinds.index(tuple(h)) for _, h in found], np.int64), "open": zero - 1}
    return Layout.of(pa.table(columns), {i: list(k) for i, k in enumerate(kinds)})


def xxhash64_of(text: str) -> int:
    """Spark's xxhash64 of a text."""
    return xxhash.xxh64_intdigest(text.encode(), 42)


class Rows:
    """Records as columns: the cells of given names, path, number, and what is wrong."""

    def __init__(self, names: list[str], rules: Rules, multi_line: bool):
        self.names, self.rules, self.multi_line = names, rules, multi_line
        self.schema = pa.schema([*((f"c{i}", pa.string()) for i in range(len(names))), (PATH, pa.string()), (ROW, pa.int64()), (RECORD, pa.string()), (FAULT, pa.string()), ("piece", pa.int64()), ("kind", pa.int64())])

    def places(self, header: list[str]) -> list[int]:
        return [header.index(n) if n in header else -1 for n in self.names]

    def plain(self, values: pa.Array, paths: pa.Array, numbers: np.ndarray, header: list[str]) -> pa.RecordBatch:
        """Records of one line without quotes."""
        lists = pc.split_pattern(values, self.rules.sep)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        count = np.diff(offsets)
        many = count > len(header)
        columns = []
        for p in self.places(header):
            has = (count > p) & ~many & (p >= 0)
            columns.append(flat.take(pa.array(np.where(has, offsets[:-1] + max(p, 0), 0), mask=~has)))
        fault = pa.array([surplus(int(n), header) if m else None for n, m in zip(count, many, strict=True)] if many.any() else [None] * len(count), pa.string())
        none = pa.nulls(len(count), pa.int64())
        return pa.RecordBatch.from_arrays([*columns, paths, pa.array(numbers), pc.if_else(pa.array(many), values, None), fault, none, none], schema=self.schema)

    def parsed(self, records: list[tuple[str, str, int]], header: list[str]) -> pa.RecordBatch:
        """(record, path, number) of any records."""
        places = self.places(header)
        columns: list[list] = [[] for _ in self.names]
        raw, fault = [], []
        for text, _, _ in records:
            cells = self.rules.cells(text)
            wrong = OPEN_QUOTE if not self.rules.whole.match(text) else surplus(len(cells), header) if len(cells) > len(header) else None
            raw.append(text if wrong else None)
            fault.append(wrong)
            for column, p in zip(columns, places, strict=True):
                column.append(cells[p] if wrong is None and 0 <= p < len(cells) else None)
        none = pa.nulls(len(records), pa.int64())
        arrays = [*(pa.array(c, pa.string()) for c in columns), pa.array([p for _, p, _ in records], pa.string()), pa.array([n for _, _, n in records], pa.int64())]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(raw, pa.string()), pa.array(fault, pa.string()), none, none], schema=self.schema)

    def piece(self, text: str, path: str, number: int, start: int | None, kind: int, fault: str | None) -> pa.RecordBatch:
        values = [*([None] * len(self.names)), path, number, text, fault, start, kind]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, self.schema, strict=True)], schema=self.schema)


def surplus(count: int, header: list[str]) -> str:
    return f"found {count} cells, the header has {len(header)}"


@dataclass
class Cursor:
    """Where a task stands in a block."""

    path: str
    start: int
    inside: bool
    record: int  # the number of the record that begins next; 0 is the header
    header: list[str] | None
    open: int
    held: list[str] = field(default_factory=list)
    whole: bool = True  # the held lines include the record's begin


def cut(batches: Iterator[pa.RecordBatch], known: Layout, rows: Rows) -> Iterator[pa.RecordBatch]:
    """The records of all blocks of a task."""
    block: Cursor | None = None
    kind_of = {id(h): k for k, h in known.headers.items()}

    def flush(closed: bool) -> Iterator[pa.RecordBatch]:
        """What is held: a record, or a piece of one that another block has more of."""
        assert block is not None
        if not block.held:
            return
        text, number = "\n".join(block.held), block.record - 1
        block.held = []
        if number > 0 and block.header is not None:
            if number == block.open:
                yield rows.piece(text, block.path, number - 1, None, 0, OPEN_QUOTE)
            elif block.whole and closed:
                yield rows.parsed([(text.removesuffix("\r"), block.path, number - 1)], block.header)
            else:
                yield rows.piece(text, block.path, number - 1, block.start, kind_of[id(block.header)], None)
        block.whole = True

    at = None
    for batch in batches:
        for file, start, part in stretches(batch):
            if at != (file, start):
                if block is not None:
                    yield from flush(False)
                inside, base, header, unclosed = known.block(file, start)
                block, at = Cursor(part.column(PATH)[0].as_py(), start, inside, base, header, unclosed), (file, start)
                block.whole = not inside
            assert block is not None
            values = part.column("value")
            quoted = quoted_lines(values)
            inside, block.inside = states(quoted, len(values), block.inside, rows.rules if rows.multi_line else None)
            begins = solid(values) & ~inside
            # a record of one line ends before a line outside quotes; those without a quote are handled together
            ends = np.append(~inside[1:], not block.inside)
            alone = begins & ends
            numbers = block.record + np.cumsum(begins) - 1
            bare = alone & (numbers > 0)
            bare[[i for i, _ in quoted]] = False
            if block.header is not None and bare.any():
                mask = pa.array(bare)
                yield rows.plain(pc.replace_substring_regex(values.filter(mask), "\r$", ""), part.column(PATH).filter(mask), numbers[bare] - 1, block.header)
            single: list[tuple[str, str, int]] = []
            rest = inside | (begins & ~ends)
            rest[[i for i, _ in quoted]] |= begins[[i for i, _ in quoted]]
            for i in np.flatnonzero(rest).tolist():
                value = values[i].as_py()
                if begins[i] and alone[i]:
                    if numbers[i] > 0 and block.header is not None:
                        single.append((value.removesuffix("\r"), block.path, int(numbers[i]) - 1))
                    continue
                if begins[i]:
                    block.record = int(numbers[i]) + 1
                block.held.append(value)
                if ends[i]:
                    yield from flush(True)
            block.record = int(numbers[-1]) + 1
            if single:
                yield rows.parsed(single, block.header)
    if block is not None:
        yield from flush(False)


def read_records(
    spark: SparkSession, path: str | list[str], columns: list[str] | None = None, multi_line: bool = True, numbered: bool = True, sep: str = ",", **listing
) -> DataFrame:
    """All data records as text columns, with _path, _row, and _record and _fault of those that are faulty.

    ``_row`` is the place among the file's data records, from 0; without ``multi_line``
    and ``numbered`` the files are read once and it is the place within a block.
    """
    surveyed = multi_line or numbered
    if surveyed:
        folder = f"{scratch_dir(spark, 'blocks')}/blocks"
        lines(spark, path, **listing).mapInArrow(lambda batches: survey(batches, sep, multi_line), SURVEY).write.parquet(folder)
        blocks = spark.read.schema(SURVEY).parquet(folder)
        known = layout(blocks)
    else:
        known = first_lines(spark, path, sep, **listing)
    names = columns or list(dict.fromkeys(n for kind in sorted(known.headers.values(), key=lambda k: (-len(k), k)) for n in kind if n))
    sent = spark.sparkContext.broadcast(vars(known))  # plain values, so that workers need no copy of the class

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(batches, Layout(**sent.value), Rows(names, Rules(sep), multi_line))

    cells = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    schema = T.StructType([*cells, *(T.StructField(n, t) for n, t in ((PATH, T.StringType()), (ROW, T.LongType()), (RECORD, T.StringType()), (FAULT, T.StringType()), ("piece", T.LongType()), ("kind", T.LongType())))])
    found = lines(spark, path, **listing).mapInArrow(records, schema)
    whole = found.where(F.col("piece").isNull())
    if surveyed and known.inside.any():
        pieces = found.where(F.col("piece").isNotNull()).groupBy(PATH, ROW, "kind")
        texts = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", RECORD))), lambda p: p[RECORD]), "\n").alias(RECORD))

        def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = Rows(names, Rules(sep), True)
            for batch in batches:
                for r in batch.to_pylist():
                    yield rows.parsed([(r[RECORD].removesuffix("\r"), r[PATH], r[ROW])], sent.value["headers"][r["kind"]])

        whole = whole.union(texts.mapInArrow(put_together, schema))
    named: list[Column] = [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    return whole.select(*named, PATH, ROW, RECORD, FAULT)
