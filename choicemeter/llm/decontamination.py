"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Every window of 13 words keeps the least hash of its 8-word grams.  Equal windows have
equal grams, so equal least hashes: a shared span of 13 words always shares a
fingerprint.  Fingerprints of documents and benchmark are joined, each hit is extended to
the windows that could have made it, and those are compared word for word.  Items of
fewer words are one window; their hash is looked up at every position.

The benchmark's fingerprints and windows are written first, so Spark knows their true
size and broadcasts them only below its limit; beyond, both sides are shuffled.  Each
fingerprint stands once on the benchmark's side, so hits never multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemeter.llm.common import frozen

WINDOW, GRAM = 13, 8
SPAN = WINDOW - GRAM + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column, lower: bool = True) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER) if lower else text, BETWEEN), "")


def span(first: int | Column, last: Column) -> Column:
    """first ... last, nothing if last is smaller."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def paired(name: str, step: int, combine) -> Column:
    """combine(a[i], a[i + step]) at every i.  The array must be a column: a lambda works out what it holds for each element."""
    return F.transform(name, lambda x, i: combine(x, F.get(name, i + step)))


def hashed(df: DataFrame) -> DataFrame:
    """``words`` becomes their number ``n``, their hashes and the least gram hash of each window."""
    hashes = df.withColumn("n", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    grams = hashes.withColumn("grams", paired("hashes", 1, F.xxhash64))
    grams = grams.withColumn("grams", paired("grams", 2, F.xxhash64)).withColumn("grams", paired("grams", 4, F.xxhash64))
    grams = grams.withColumn("grams", F.slice("grams", 1, F.greatest(F.col("n") - (GRAM - 1), F.lit(0))))
    two = grams.withColumn("two", paired("grams", 1, F.least))
    least = two.withColumn("four", paired("two", 2, F.least)).withColumn("six", F.transform("four", lambda x, i: F.least(x, F.get("two", i + 4))))
    return least.withColumn("least", F.slice("six", 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0)))).drop("grams", "two", "four", "six")


def fingerprints(df: DataFrame, short: list[int], every: bool) -> Column:
    """(pos, len, fp) structs: where the least hash changes, every SPAN windows at least, and the short lengths at all positions.

    With ``every`` a text of fewer than WINDOW words is one window, as items are.
    """
    at = lambda i: F.struct(i.alias("pos"), F.lit(WINDOW).alias("len"), F.get("least", i).alias("fp"))
    changes = F.filter(span(0, F.col("n") - WINDOW), lambda i: (i % SPAN == 0) | (F.get("least", i) != F.get("least", i - 1)))
    found = [F.transform(changes, at)]
    if every:
        whole = F.struct(F.lit(0).alias("pos"), F.col("n").alias("len"), F.xxhash64(F.slice("hashes", 1, F.greatest("n", F.lit(0)))).alias("fp"))
        found.append(F.when(F.col("n").between(1, WINDOW - 1), F.array(whole)).otherwise(F.array().cast("array<struct<pos:int,len:int,fp:bigint>>")))
    return F.concat(*found, *map(at_every_place, short))


def at_every_place(size: int) -> Column:
    """The hash of ``size`` words at each of their places.  Single elements are asked for: a slice copies all of the text's array."""
    some = lambda i: F.array(*(F.get("hashes", i + j) for j in range(size)))
    return F.transform(
        span(0, F.col("n") - size),
        lambda i: F.struct(i.alias("pos"), F.lit(size).alias("len"), F.xxhash64(some(i)).alias("fp")),
    )


def windows(starts: Column) -> Column:
    """(start, len, key) of the windows of ``words`` at (start, len), WINDOW words at most."""
    some = lambda s: F.array(*(F.when(s["len"] > j, F.get("words", s["start"] + j)) for j in range(WINDOW)))
    return F.transform(starts, lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), F.array_join(some(s), " ").alias("key")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word of a document is hit if it lies in any occurrence of a window of any item.  A
    null or wordless text has no words and no hits; a null or wordless item no windows.
    Rows with equal doc_id (null included) and text are judged alike, rows that differ in
    text apart.  A null item_id counts as hit but is not listed.  Empty tables give no
    rows or no hits; other columns are ignored.  Very long texts are read whole; a row's
    arrays hold some 30 bytes a word.
    """
    return judged(docs, benchmark).drop("digest")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What ``contamination`` returns, and ``digest``, the hash of the row's text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = frozen(hashed(items.distinct()), "items")
    # at most WINDOW - 1 lengths
    short = sorted(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    marks = frozen(items.select(F.explode(fingerprints(items, [], True)).alias("f")).select("f.fp", "f.len").distinct(), "item_fingerprints")
    starts = F.when(F.col("n") < WINDOW, F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("len")))).otherwise(
        F.transform(span(0, F.col("n") - WINDOW), lambda i: F.struct(i.alias("start"), F.lit(WINDOW).alias("len")))
    )
    spans = items.select("item", F.explode(windows(starts)).alias("w")).select("w.key", "item")
    spans = frozen(spans.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items")), "item_windows")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("string").alias("text"))
    rows = hashed(texts.select("doc_id", "digest", words(F.col("text")).alias("words")))
    found = rows.select("doc_id", "digest", F.explode(fingerprints(rows, short, False)).alias("f")).select("doc_id", "digest", "f.pos", "f.len", "f.fp")
    hits = found.join(marks, ["fp", "len"], "left_semi")
    hits = frozen(hits.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("pos", "len")).alias("hits")), "hits")

    # Texts with a hit, matched by their digest first, so that others are not shuffled.
    digests = frozen(hits.select("digest").distinct(), "hit_digests")
    some = texts.join(digests, "digest", "left_semi")
    same = some.doc_id.eqNullSafe(hits.doc_id) & (some.digest == hits.digest)
    some = some.join(hits, same).select(some.doc_id, some.digest, words(some.text).alias("words"), "hits")
    # A change of the least hash at pos stands for the windows from pos to the next mark, SPAN - 1 further at most.
    reach = lambda h: F.when(h["len"] < WINDOW, F.array(h["pos"])).otherwise(span(h["pos"], F.least(h["pos"] + SPAN - 1, F.size("words") - WINDOW)))
    # Numbers, 16 * start + len, are told apart by a hash set; structs would be compared each with each.
    coded = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(reach(h), lambda i: i.cast("long") * 16 + h["len"]))))
    candidates = F.transform(coded, lambda c: F.struct(F.shiftright(c, 4).cast("int").alias("start"), c.bitwiseAND(15).cast("int").alias("len")))
    exact = some.select("doc_id", "digest", F.explode(windows(candidates)).alias("w")).select("doc_id", "digest", "w.start", "w.len", "w.key").join(spans, "key")
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "len")), lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    result = exact.groupBy("doc_id", "digest").agg(F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    result = frozen(result, "contaminated")

    counts = texts.select("doc_id", "digest", F.size(words(F.col("text"), lower=False)).cast("long").alias("n_words"))
    whole = counts.join(result, counts.doc_id.eqNullSafe(result.doc_id) & (counts.digest == result.digest), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(
        counts.doc_id,
        counts.digest,
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated.

    A row goes by its doc_id and its text: of rows that share an id, or have none, only
    those whose own text is contaminated go.  All columns are kept.
    """
    bad = judged(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest"))
    bad = frozen(bad.distinct(), "contaminated_rows")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_digest"))
    return docs.join(bad, same, "left_anti")
