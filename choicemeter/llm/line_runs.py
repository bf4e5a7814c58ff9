"""Removal of repeated runs of lines by prefix doubling, in DataFrame operations alone.

The lines that aren't blank form one sequence over all documents.  Prefix doubling ranks
runs: the rank of the run of 2^k lines at a position is the place of the first run equal
to it, found by grouping the pair of ranks of its two halves.  Positions with the same
rank are the common-prefix interval of depth 2^k or more of the suffix array of lines;
positions whose interval holds nothing else leave the doubling.

A repeated run counts if its lines have ``min_chars`` characters or more.  Every line of
such a run lies in a shortest run of that weight, one that begins or ends somewhere in
it, so the shortest runs at each line's begin and end, named by two overlapping runs of
2^k lines, reveal all maximal repeated runs; later copies are deleted.  A shortest run has
at most ``min_chars`` lines, which bounds the number of doublings whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemeter.llm.common import frozen

# About four words: what a line of boilerplate weighs.  Shorter lines, such as headings, names and numbers, are often equal without being copies.
MIN_CHARS = 25
BLANK = " \t\r\x0b\x0c"


def shortest(sizes: Column, min_chars: int) -> Column:
    """For each line, how many lines from it have ``min_chars`` characters; 0: all that follow have fewer."""

    def count(x: Column, i: Column) -> Column:
        step = lambda a, y: F.when(a["sum"] >= min_chars, a).otherwise(F.struct((a["sum"] + y).alias("sum"), (a["n"] + 1).alias("n")))
        run = F.aggregate(F.slice("sizes", i + 1, F.lit(min_chars)), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), step)
        return F.when(x >= min_chars, F.lit(1)).otherwise(F.when(run["sum"] >= min_chars, run["n"]).otherwise(0))

    return F.transform(sizes, count)


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that isn't blank: pos, its document and number, lines left, hashes, shortest runs.

    ``pos`` grows by one from line to line of a document; it is fixed when the table is written.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"))
    texts = texts.withColumn("lines", F.filter("lines", lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    texts = texts.withColumn("sizes", F.transform("lines", F.length)).withColumn("ahead", shortest(F.col("sizes"), min_chars))
    back = texts.withColumn("sizes", F.reverse("sizes"))
    back = back.withColumn("back", F.reverse(shortest(F.col("sizes"), min_chars))).withColumn("n", F.size("lines"))
    each = F.arrays_zip("lines", "ahead", "back")
    lines = back.select("doc_id", "digest", "n", F.posexplode(each).alias("line", "z"))
    return lines.select(
        F.monotonically_increasing_id().alias("pos"),
        "doc_id",
        "digest",
        "line",
        (F.col("n") - F.col("line")).alias("left"),
        F.xxhash64("z.lines").alias("h1"),
        F.xxhash64("z.lines", F.lit(1)).alias("h2"),
        F.col("z.ahead").alias("ahead"),
        F.col("z.back").alias("back"),
    )


PLACE = ["doc_id", "digest", "line"]


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` that share their keys with another place, and ``rank``: the pos of the first of them."""
    place = F.struct(*PLACE, "pos")
    # the same document in repeated rows is one place
    groups = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(F.struct(*PLACE)).alias("last"))
    groups = groups.where(~F.col("last").eqNullSafe(F.struct(*(F.col(f"first.{c}").alias(c) for c in PLACE))))
    # Written, so that the join is one of two plain shuffles, which Spark splits where a line or run is hot.
    return rows.join(frozen(groups.select(*keys, "first"), "ranked"), keys)


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, digest, line, run): the later copies of repeated runs, by first line (blank ones not counted) and number of lines."""
    lines = frozen(line_table(docs, min_chars), "lines")
    ahead = lines.where("ahead > 0").select("pos", *PLACE, F.col("ahead").alias("run"))
    back = lines.where("back > 0").select((F.col("pos") - F.col("back") + 1).alias("pos"), "doc_id", "digest", (F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("run"))
    active = frozen(ranked(lines.select("pos", *PLACE, "left", "h1", "h2"), ["h1", "h2"]).select("pos", *PLACE, "left", F.col("first.pos").alias("rank")), "ranks")
    longest = lines.agg(F.greatest(F.max("ahead"), F.max("back"))).first()[0] or 0
    found, width = None, 1
    while width <= longest:
        at = active.select("pos", "rank")
        these = ahead.union(back.where("run > 1")).where(F.col("run").between(width, 2 * width - 1)).distinct()
        named = these.join(at, "pos").withColumn("second", F.col("pos") + F.col("run") - width)
        named = named.join(at.select(F.col("pos").alias("second"), F.col("rank").alias("rank2")), "second")
        runs = ranked(named, ["run", "rank", "rank2"])
        later = ~F.struct(*PLACE).eqNullSafe(F.struct(*(F.col(f"first.{c}").alias(c) for c in PLACE)))
        later = runs.where(later).select(*PLACE, "run")
        found = later if found is None else found.union(later)
        if 2 * width <= longest:
            second = at.select((F.col("pos") - width).alias("pos"), F.col("rank").alias("rank2"))
            pairs = active.where(F.col("left") >= 2 * width).join(second, "pos")
            active = frozen(ranked(pairs, ["rank", "rank2"]).select("pos", *PLACE, "left", F.col("first.pos").alias("rank")), "ranks")
        width *= 2
    if found is None:
        return lines.select(*PLACE, F.col("ahead").alias("run")).where("false")
    return found


def copied_stretches(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, digest, line, n_lines): the longest stretches of lines that repeated runs cover, by first line and length.

    Only later copies; ``digest`` is the hash of the text.  Blank lines are not counted.
    """
    lines = repeated_runs(docs, min_chars).select("doc_id", "digest", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("run") - 1)).alias("line"))
    in_text = Window.partitionBy("doc_id", "digest").orderBy("line")
    joined = lines.distinct().withColumn("stretch", F.col("line") - F.row_number().over(in_text))
    return joined.groupBy("doc_id", "digest", "stretch").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n_lines")).drop("stretch")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with later copies of repeated runs taken out; n_lines and n_removed count lines that aren't blank.

    Copies are later in (doc_id, text hash, line) order, null ids first, and may lie in
    the same document.  Rows with equal doc_id and text are one document: they are not
    copies of each other and come out alike.  A document of which no line is left gets
    the empty text.  Null stays null.  Blank lines stay unless nothing else does.  Other
    columns are kept; ``n_chars`` follows the text.  A very long text's lines are rows of
    their own while runs are looked for; its removed lines are put together in one array.
    """
    runs = repeated_runs(docs, min_chars)
    gone = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("line", "run")), lambda r: F.sequence(r["line"], r["line"] + r["run"] - 1))))
    gone = frozen(runs.groupBy("doc_id", "digest").agg(gone.alias("_ld_gone")).select(F.col("doc_id").alias("_ld_id"), F.col("digest").alias("_ld_digest"), "_ld_gone"), "removed_lines")
    rows = docs.withColumn("_ld_hash", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_hash") == F.col("_ld_digest"))
    # merged at every size: whether the table of removed lines is small says nothing of the next corpus
    rows = rows.join(gone.hint("merge"), same, "left").withColumn("_ld_lines", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))
    solid = F.filter(F.transform("_ld_lines", lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) != "", i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_ld_solid", solid).withColumn("_ld_n", F.size("_ld_solid"))
    out = F.transform("_ld_gone", lambda i: F.get("_ld_solid", i))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), out)
    rest = F.array_join(F.transform(stay, lambda i: F.get("_ld_lines", i)), "\n")
    text = F.when(F.col("_ld_gone").isNull(), F.col("text")).when(F.size("_ld_gone") == F.col("_ld_n"), F.lit("")).otherwise(rest)
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_ld_gone").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns, F.col("_ld_n").cast("long").alias("_ld_n_lines"), F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("_ld_n_removed"))
