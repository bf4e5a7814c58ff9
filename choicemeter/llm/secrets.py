"""Secret scan with linking of multipart credentials, in DataFrame operations alone.

One pass over the texts finds the parts: for each kind the matches and the text between
them, whose lengths add up to positions.  Certain parts stand for themselves.  Weak parts
(a user name, an opaque run of characters, an endpoint) mean something only together:
an interval join by bins of the scope's size pairs parts that lie within the scope, and a
weak part is reported if the parts that complete it are there.  A bin holds a bounded
number of parts, so a text full of secrets gives rows in proportion to its length.

No pattern repeats a group, so none recurses; an endpoint without a scheme is a host name of
at most 253 characters before ``.amazonaws.com``, so a pass is linear in the text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemeter.llm.common import frozen

# The patterns of the certain kinds, in the order in which ties are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{24,}"}
WEAK = {
    "login": r"""\b((?i:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""",
    "opaque": "[A-Za-z0-9+/_-]{32,}={0,2}",
    "endpoint": r"""(?:https?|wss?|ftps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\x00-\x20"'<>]+|[a-z0-9.-]{1,253}\.amazonaws\.com""",
}
KINDS = [*BASE, *WEAK]
# A text without any of these has no match; looking for them is cheaper than the pattern.
NEEDLES = {"access": ("AKIA",), "endpoint": ("://", ".amazonaws.com")}
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "opaque": "secret", "endpoint": "endpoint"}
# What must lie within the scope of a weak part.
NEEDS = {"login": ("secret",), "opaque": ("identifier",), "endpoint": ("identifier", "secret")}
SCOPE = 300


def valid(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6
    if kind == "access":
        return F.length(match) >= 20
    if kind == "opaque":
        return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return F.lit(True)


def parts(text: Column, kind: str, pattern: str) -> Column:
    """(kind, i, gap, len, ok) of every match; gap: the characters since the match before."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.zip_with(matches, between, lambda m, b: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(b).alias("gap"), F.length(m).alias("len"), valid(kind, m).alias("ok")))
    numbered = F.transform(zipped, lambda z, i: F.struct(z["kind"].alias("kind"), i.alias("i"), z["gap"].alias("gap"), z["len"].alias("len"), z["ok"].alias("ok")))
    literals = NEEDLES.get(kind)
    some = reduce(or_, (text.contains(n) for n in literals)) if literals else text.rlike(pattern)
    return F.when(some, F.filter(numbered, lambda z: z["len"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"))


def text_of(kind: Column, start: Column, end: Column) -> Column:
    names = F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)
    return F.concat_ws(":", names, start.cast("string"), end.cast("string"))


def linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans whose complements lie within ``scope`` characters and that overlap no certain span."""
    role = F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), F.col("kind") + 1)
    certain = F.col("kind") < len(BASE)
    cell = lambda c: F.floor(c / scope).cast("long")
    weak = spans.where(~certain).select("row", "kind", "start", "end", F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope))).alias("bin"))
    other = spans.select(
        "row", F.col("start").alias("from"), F.col("end").alias("to"), role.alias("role"), certain.alias("certain"), F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("bin")
    )
    near = (F.col("from") <= F.col("end") + scope) & (F.col("to") >= F.col("start") - scope)
    pairs = weak.join(other, ["row", "bin"]).where(near)
    over = (F.col("from") < F.col("end")) & (F.col("to") > F.col("start"))
    has = lambda r: F.max((F.col("role") == r) & ~over)
    found = pairs.groupBy("row", "kind", "start", "end").agg(has("identifier").alias("identifier"), has("secret").alias("secret"), F.max(over & F.col("certain")).alias("covered"))
    complete = F.lit(False)
    for kind, needs in NEEDS.items():
        whole = F.col("kind") == KINDS.index(kind)
        for need in needs:
            whole &= F.col(need)
        complete |= whole
    return found.where(complete & ~F.col("covered")).select("row", "kind", "start", "end")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Positions are code points, ends exclusive.  A null or empty text has no spans (the
    hash is that of the empty string).  Rows with a null or repeated doc_id are scanned
    one by one; an empty table gives an empty result; other columns are ignored.  Very long
    texts are scanned whole, in time linear in their length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(*(parts(text, kind, pattern) for kind, pattern in (BASE | WEAK).items()))
    # The numbers are fixed when the table is written.
    rows = frozen(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")), "parts")
    each = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("p")).select("row", "p.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(so_far)
    spans = each.select("row", "kind", "ok", (end - F.col("len")).alias("start"), end.alias("end")).where("ok").drop("ok")
    spans = frozen(spans, "spans")
    base = spans.where(F.col("kind") < len(BASE))
    all_spans = base.union(linked(spans, scope))
    count = lambda kind: F.count(F.when(F.col("kind") == KINDS.index(kind), 1))
    listed = lambda keep: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("start", "kind", "end")))), lambda s: text_of(s["kind"], s["start"], s["end"])), ","
    )
    counts = [count(kind).alias(f"n_{kind}") for kind in BASE]
    texts = all_spans.groupBy("row").agg(*counts, listed(F.col("kind") < len(BASE)).alias("base"), listed(F.lit(True)).alias("spans"))
    whole = rows.select("row", "doc_id").join(texts, "row", "left")
    zero = [F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in BASE]
    blank = lambda name: F.coalesce(name, F.lit(""))
    return whole.select("doc_id", *zero, F.sha2(blank("base"), 256).alias("base_sha256"), blank("spans").alias("spans"))
