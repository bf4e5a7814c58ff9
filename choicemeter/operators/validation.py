"""Row contracts as column expressions: valid rows, rejects, messages, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicemeter.functions.scores import WHOLE, text_number, to_score
from choicemeter.sources.contracts import Contract
from choicemeter.sources.records import FAULT, RECORD

# Start of a row message, and the place of the first data row in a sheet.
ROW_MESSAGE = "Fila %s (Excel): "
FIRST_ROW = 2

_INT_MIN, _INT_MAX = -(2**31), 2**31 - 1


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    fixed = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def as_number(column: Column) -> Column:
    """A value as a double; text must be written as a number, NaN counts as null."""
    return to_score(column)


def as_int(column: Column) -> Column:
    """A whole number (``3``, ``'3'``, ``3.0``) as an int; anything else is null, also the text ``1e3``."""
    text = F.typeof(column) == "string"
    value = F.when(text, text_number(column.cast("string"), WHOLE)).otherwise(to_score(column))
    whole = (value == F.floor(value)) & value.between(_INT_MIN, _INT_MAX)
    return F.when(whole, value).try_cast("int")


def _checked(df: DataFrame, name: str, kind: str) -> tuple[Column, Column]:
    """The coerced value of a declared column, and its message (null when fine)."""
    if name not in df.columns:
        return F.lit(None).cast("string" if kind == "string" else kind), F.lit(f"{name}: Field required")
    column = F.col(name)
    data_type = df.schema[name].dataType
    if kind == "string":
        if not isinstance(data_type, T.StringType):
            return F.lit(None).cast("string"), F.lit(f"{name}: Input should be a valid string")
        return column, F.when(column.isNull(), F.lit(f"{name}: Input should be a valid string"))
    source = column.cast("int") if isinstance(data_type, T.BooleanType) else column
    value = as_int(source) if kind == "int" else as_number(source)
    noun = "integer" if kind == "int" else "number"
    return value, F.when(value.isNull(), F.lit(f"{name}: Input should be a valid {noun}"))


def too_few_options(df: DataFrame, prefix: str, least: int) -> Column:
    """Message for rows with fewer than ``least`` filled columns of a prefix; else null."""
    names = [c for c in df.columns if c.startswith(prefix)]
    filled = F.size(F.filter(F.array(*names), lambda v: v.isNotNull())) if names else F.lit(0)
    message = F.concat(F.lit(f"at least {least} {prefix}* columns must be filled, found "), filled.cast("string"))
    return F.when(filled < least, message)


def check_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """Coerced columns of the contract, kept extras, and ``errors`` (array, empty when valid).

    Undeclared columns are dropped unless the contract is open.  Columns whose
    names start with ``_`` are carried along.  A row with a ``_fault`` could not be read: that is
    its only error, and its text in ``_record`` is what came in.
    """
    df = clean_nan(df)
    values: list[Column] = []
    messages: list[Column] = []
    for name, kind in contract.columns:
        value, message = _checked(df, name, kind)
        values.append(value.alias(name))
        messages.append(message)
    if contract.min_filled:
        messages.append(too_few_options(df, *contract.min_filled))
    extras = [
        F.col(c)
        for c in df.columns
        if c not in contract.names and c not in (RECORD, FAULT) and (contract.open_columns or c.startswith("_"))
    ]
    errors, raw = F.filter(F.array(*messages), lambda m: m.isNotNull()), _raw_row(df, contract)
    if FAULT in df.columns:
        errors = F.when(F.col(FAULT).isNotNull(), F.array(FAULT)).otherwise(errors)
        raw = F.coalesce(F.col(RECORD), raw)
    return df.select(*values, *extras, errors.alias("errors"), raw.alias("_raw"))


def _raw_row(df: DataFrame, contract: Contract) -> Column:
    """The declared columns as they came in, as JSON, so that a reject can be repaired."""
    given = [c for c in contract.names if c in df.columns]
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in given))) if given else F.lit("{}")


def split_valid(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Valid rows in the contract's types, and rejected rows with ``errors`` and ``raw``."""
    checked = check_rows(df, contract)
    valid = checked.where(F.size("errors") == 0).drop("errors", "_raw")
    extras = [c for c in checked.columns if c not in contract.names and c not in ("errors", "_raw")]
    rejects = checked.where(F.size("errors") > 0).select(*extras, F.col("_raw").alias("raw"), "errors")
    return valid, rejects


def row_messages(rejects: DataFrame, ordinal: str = "_row") -> DataFrame:
    """One readable message per reject; ``ordinal`` is the row's 0-based place in its file."""
    row = (F.col(ordinal) + FIRST_ROW).cast("bigint")
    prefix = F.format_string(ROW_MESSAGE, row.cast("string"))
    return rejects.withColumn("message", F.concat(prefix, F.concat_ws("; ", "errors")))


def validation_status(checked: DataFrame) -> DataFrame:
    """One row: status, message, number of valid and of rejected rows."""
    counts = checked.agg(
        F.count_if(F.size("errors") == 0).alias("valid_rows"), F.count_if(F.size("errors") > 0).alias("rejected_rows")
    )
    status = (
        F.when(F.col("rejected_rows") == 0, "success").when(F.col("valid_rows") > 0, "partial_error").otherwise("fatal_error")
    )
    message = F.when(F.col("rejected_rows") == 0, "Successful validation").otherwise(
        F.format_string("There were found %d validation errors.", "rejected_rows")
    )
    return counts.select(status.alias("status"), message.alias("message"), "valid_rows", "rejected_rows")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value: one aggregated row decides."""
    df = clean_nan(df)
    filled = df.agg(*(F.bool_or(F.col(c).isNotNull()).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if filled[c]))


def numeric_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what is no number becomes null."""
    return df.withColumns({c: as_number(F.col(c)) for c in columns})
