"""Score expressions: coercion, clipping, flags, rates, ratios, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from choicemeter.functions.text import strip

# Flag thresholds by suffix (the flags test >=), and the tail threshold.
FLAG_THRESHOLDS = {"gt_05": 0.5, "gt_08": 0.8}
TAIL_THRESHOLD = 0.8


# How numbers are written.  Spark itself also reads 1d, 0.5f and 0x1p3.
NUMBER = r"(?i)^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"
WHOLE = r"^[+-]?\d+(\.0*)?$"


def text_number(c: Column, pattern: str = NUMBER) -> Column:
    """Text as a double where it is written as a number; white space around it is dropped."""
    text = strip(c)
    return F.when(text.rlike(pattern), text.try_cast("double"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_score(c: Column | str) -> Column:
    """Any value as a double; text that is no number, and NaN, become null."""
    column = _col(c)
    # typeof is known when the query is planned: numbers keep no trace of the text branch
    value = F.when(F.typeof(column) == "string", text_number(column.cast("string"))).otherwise(column.try_cast("double"))
    return F.when(~F.isnan(value), value)


def clip_score(c: Column | str) -> Column:
    """Score limited to [0, 1]; null and NaN stay null."""
    value = to_score(c)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def threshold_flag(c: Column | str, threshold: float) -> Column:
    """1 where the score reaches the threshold, else 0; a missing score gives 0."""
    return F.when(to_score(c) >= threshold, 1).otherwise(0)


def flag_columns(c: Column | str, prefix: str = "severe_toxicity") -> list[Column]:
    """The two flags of a score, named after it."""
    return [threshold_flag(c, t).alias(f"{prefix}_{suffix}") for suffix, t in FLAG_THRESHOLDS.items()]


def tail_percent(c: Column | str, threshold: float = TAIL_THRESHOLD) -> Column:
    """Aggregate: share of rows that reach the threshold, in percent."""
    return F.avg(threshold_flag(c, threshold)) * 100


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def round_half_even(c: Column, digits: int) -> Column:
    """Round as numpy does: scale, round to the even neighbour, scale back."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale
