"""Reading of tables, of folders of game files and of run configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemeter.functions.scores import text_number
from choicemeter.functions.text import run_id_from_name
from choicemeter.operators.validation import row_messages, split_valid
from choicemeter.sources import records
from choicemeter.sources.contracts import contract_for

# Cell texts that count as missing.
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

def file_stem(path: Column | str) -> Column:
    """Name of the file, or of the folder that a Spark writer filled, without extension.

    Worked out for every row, so only paths with escapes are decoded and only names with a dot are matched.
    """
    given = F.col(path) if isinstance(path, str) else path
    decoded = F.when(given.contains("%"), F.url_decode(F.replace(given, F.lit("+"), F.lit("%2B")))).otherwise(given)
    last = F.substring_index(decoded, "/", -1)
    above = F.substring_index(F.substring_index(decoded, "/", -2), "/", 1)
    named = F.substring_index(F.when(last.startswith("part-"), above).otherwise(last), "=", -1)
    return F.when(named.contains("."), F.regexp_replace(named, r"\.(csv|parquet|json)$", "")).otherwise(named)


def file_part(path: Column | str) -> Column:
    """Name of a part file below its configuration's folder; empty for a file of its own."""
    last = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    return F.when(last.startswith("part-"), last).otherwise("")


def tag_files(df: DataFrame, tag: str) -> DataFrame:
    """Add the name of a row's file: a few string operations, no join and no list of files."""
    return df.withColumn(tag, file_stem("_path"))


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    numbered: bool = False,
    multi_line: bool = True,
    faults: bool = False,
    sep: str = ",",
    **listing,
) -> DataFrame:
    """CSV with headers as text columns, missing cells null; each file is read by its own header.

    Cells are picked by name, and a column that a file lacks is null.  With ``columns``
    only these are returned, whatever their order in the files.  ``numbered`` adds
    ``_row``, the place of a row in its file.

    With ``multi_line`` quoted cells may hold line ends.  Either way a file is read by as many
    tasks as it has blocks (see ``records``): numbers and quoted line ends take a pass
    that surveys the blocks; without both, only headers are looked up.

    A row with more cells than its file's header, or with a quote that is not closed, makes the
    query fail; with ``faults`` it comes with null cells, its text in ``_record`` and
    what is wrong in ``_fault``.
    """
    df = records.read_records(spark, path, columns, multi_line, numbered, sep, **listing)
    names = [c for c in df.columns if c not in (records.PATH, records.ROW, records.RECORD, records.FAULT)]
    cells = [F.when(~F.col(f"`{c}`").isin(*NA_TEXTS), F.col(f"`{c}`")).alias(c) for c in names]
    number = [records.ROW] if numbered else []
    if faults:
        return df.select(*cells, records.PATH, *number, records.RECORD, records.FAULT)
    place = F.concat(F.lit("CSV row of "), F.col(records.PATH), F.lit(": "), F.col(records.FAULT))
    # a condition, as a column nobody asks for would not be worked out
    fine = F.coalesce(F.when(F.col(records.FAULT).isNotNull(), F.raise_error(place).cast("boolean")), F.lit(True))
    return df.where(fine).select(*cells, records.PATH, *number)


def read_table(
    spark: SparkSession,
    path: str | list[str],
    file_type: str = "parquet",
    columns: list[str] | None = None,
    multi_line: bool = True,
    numbered: bool = False,
    recursive: bool = False,
    faults: bool = False,
) -> DataFrame:
    """A table with ``_path``; Parquet rows also get ``_row`` from the file itself.

    Files may differ in their columns: CSV goes by each file's header, Parquet schemas are merged.
    """
    if file_type == "csv":
        return scan_csv(spark, path, columns, numbered, multi_line, faults, recursiveFileLookup=recursive)
    if file_type == "parquet":
        row = F.col("_metadata.row_index").alias("_row")
        return spark.read.options(mergeSchema=True, recursiveFileLookup=recursive).parquet(*([path] if isinstance(path, str) else path)).select(
            "*", F.col("_metadata.file_path").alias("_path"), row
        )
    raise ValueError(f"unsupported file type {file_type!r}")


def load_validated(
    spark: SparkSession, path: str, file_type: str = "csv", name: str | None = None, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Read a table, pick its contract by name and split valid rows from rejects.

    Rejects have ``_row``, ``errors``, ``raw`` and a ``message`` that names the row.  A CSV row
    with surplus cells or a quote that is not closed is a reject; its ``raw`` is the text.
    """
    contract = contract_for(name or path.rstrip("/").rsplit("/", 1)[-1])
    table = read_table(spark, path, file_type, multi_line=multi_line, numbered=True, faults=True)
    valid, rejects = split_valid(table, contract)
    return valid.drop("_path", "_row"), row_messages(rejects)


def scan_tagged(
    spark: SparkSession, folder: str, file_type: str = "csv", tag: str = "config", columns: list[str] | None = None, multi_line: bool = True
) -> DataFrame:
    """All files of a folder as one table, each row tagged with the name of its file."""
    return tag_files(read_table(spark, folder, file_type, columns, multi_line), tag).drop("_path", "_row")


def scan_runs(spark: SparkSession, folder: str, file_type: str = "parquet") -> DataFrame:
    """Scored files of many runs as one table, routed by file name (see ``route_runs``)."""
    return route_runs(tag_files(read_table(spark, folder, file_type), "name")).drop("_path", "_row")


def read_cards(
    spark: SparkSession, cards_dir: str, languages: list[str], file_type: str = "csv", multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Black and white cards of all languages as one table, and the rejected rows.

    Files lie in ``<cards_dir>/<lang>/cards_texts/{black,white}_cards.<file_type>``.
    """
    paths = [
        f"{cards_dir}/{lang}/cards_texts/{color}_cards.{file_type}" for lang in languages for color in ("black", "white")
    ]
    contract = contract_for("cards")
    table = read_table(spark, paths, file_type, multi_line=multi_line, numbered=True, faults=True)
    valid, rejects = split_valid(table, contract)
    lang = F.regexp_extract("_path", r"/([^/]+)/cards_texts/", 1).alias("lang")
    color = F.upper(F.regexp_extract("_path", r"/(black|white)_cards", 1)).alias("color")
    return valid.select(lang, color, "card_id", "card_text"), rejects


def read_games(
    spark: SparkSession, cards_dir: str, languages: list[str], prompt_type: str, file_type: str = "csv"
) -> tuple[DataFrame, DataFrame]:
    """All game files of all languages as one table, and the rejected rows.

    Columns: config (file name), folder_lang, lang, part, play_no, black_id and
    white_ids, the options in the order of their column names.  ``play_no`` counts the rows
    of a file; ``part`` tells the files of a configuration apart that has several.
    """
    kind = {"prompt_player": "games_config", "prompt_judge": "to_judge_config"}[prompt_type]
    raw = read_table(spark, [f"{cards_dir}/{lang}/{kind}" for lang in languages], file_type, numbered=True, recursive=True, faults=True)
    valid, rejects = split_valid(raw, contract_for("games"))
    options = sorted((c for c in valid.columns if c.startswith("white_id_")), key=lambda c: (len(c), c))
    games = valid.select(
        file_stem("_path").alias("config"),
        F.regexp_extract("_path", rf"/([^/]+)/{kind}/", 1).alias("folder_lang"),
        "lang",
        file_part("_path").alias("part"),
        F.col("_row").alias("play_no"),
        "black_id",
        # the filled cells and empty ones between them; a file with fewer columns has none behind its last
        F.slice(F.array(*options), F.lit(1), last_filled(options)).alias("white_ids"),
    )
    return games, rejects


def last_filled(columns: list[str]) -> Column:
    """Place of the last column that is not null, from 1."""
    return F.greatest(F.lit(0), F.lit(0), *(F.when(F.col(c).isNotNull(), i + 1) for i, c in enumerate(columns)))


def route_runs(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``role`` (player before judge), ``kind`` and ``classifier`` from a file name.

    Names that give no role or kind are left out, as nothing analyses them.
    """
    n = F.col(name)
    role = F.when(n.contains("player"), "player").when(n.contains("judge"), "judge")
    kind = F.when(n.contains("winners"), "winners").when(n.contains("combinations"), "combinations")
    classifier = F.when(n.contains("detoxify"), "detoxify").when(n.contains("perspective"), "perspective")
    routed = df.withColumns({"role": role, "kind": kind, "classifier": classifier, "run_id": run_id_from_name(n)})
    # Both in one condition: each time a condition names a column that is worked out, a row pays for it once more.
    return routed.where(n.rlike("(?s)^(?=.*(?:player|judge)).*(?:winners|combinations)"))


def read_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per stored run configuration: run_id (from its path) and ``config``.

    ``config`` is a variant, so that types can be checked as they were written.
    Text that is no JSON gives a null ``config``.
    """
    texts = spark.read.text(paths, wholetext=True)
    return texts.select(
        run_id_from_name(F.col("_metadata.file_path")).alias("run_id"), F.try_parse_json("value").alias("config")
    ).where(F.col("run_id").isNotNull())


def run_attributes(manifest: DataFrame) -> DataFrame:
    """Run id, prompt type and description (under either of its two names) of each run."""
    get = lambda key: F.try_variant_get("config", f"$.{key}", "string")
    return manifest.select(
        "run_id",
        F.col("config").isNotNull().alias("readable"),
        get("prompt_type").alias("prompt_type"),
        F.coalesce(get("judge_description"), get("character_description")).alias("judge_description"),
    )


def _field_message(name: str, kind: str | tuple[str, ...]) -> Column:
    path = f"$.{name}"
    shape = F.schema_of_variant(F.try_variant_get("config", path, "variant"))
    as_text = F.try_variant_get("config", path, "string")
    number = text_number(as_text)
    if isinstance(kind, tuple):
        fine, message = (shape == "STRING") & as_text.isin(*kind), f"Input should be one of {', '.join(kind)}"
    elif kind == "string":
        fine, message = shape == "STRING", "Input should be a valid string"
    elif kind == "int":
        truth = shape == "BOOLEAN"
        fine = truth | (~shape.startswith("ARRAY") & ~shape.startswith("OBJECT") & (number == F.floor(number)))
        message = "Input should be a valid integer"
    elif kind == "strings":
        items = F.try_variant_get("config", path, "array<variant>")
        texts = F.forall(items, lambda i: F.coalesce(F.schema_of_variant(i) == "STRING", F.lit(False)))
        fine, message = shape.startswith("ARRAY") & texts, "Input should be a list of strings"
    else:
        items = F.try_variant_get("config", path, "array<string>")
        fine = shape.startswith("ARRAY") & F.forall(items, lambda i: F.coalesce(text_number(i).isNotNull(), F.lit(False)))
        message = "Input should be a list of numbers"
    return F.when(F.coalesce(fine, F.lit(False)), F.lit(None)).otherwise(F.lit(f"{name}: {message}"))


def check_configs(manifest: DataFrame, fields: dict[str, str | tuple[str, ...]]) -> DataFrame:
    """Per run: the messages of all fields that break the configuration contract."""
    messages = F.array(*(_field_message(name, kind) for name, kind in fields.items()))
    broken = F.when(F.col("config").isNull(), F.array(F.lit("config: Invalid JSON"))).otherwise(
        F.filter(messages, lambda m: m.isNotNull())
    )
    return manifest.select("run_id", broken.alias("errors"))
