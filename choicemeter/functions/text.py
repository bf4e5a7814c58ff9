"""Text expressions: ids, blanks, templates, normalization, keys.

All of them are built-in column expressions, so they stay in whole-stage
codegen.  Character classes are spelled out (``[0-9]``, ``[ \\t\\r\\n]``)
because the meaning of ``\\d`` and ``\\s`` differs between regex engines.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Card ids in an answer, blanks in a template, run ids in a name.
ID_PATTERN = "W[0-9]{3}"
BLANK_PATTERN = "__+"
RUN_ID_PATTERN = r"run_\w+_[0-9]{2}_[0-9]{2}_[0-9]{4}_[0-9]{2}-[0-9]{2}-[0-9]{2}"
RUN_TIME_FORMAT = "dd_MM_yyyy_HH-mm-ss"
TRAILING_MARKS = ".,;!"
BLANKS = " \t\r\n"
CONFIG_SUFFIX = "_configurations"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing blanks, tabs and line ends."""
    return F.btrim(_col(c), F.lit(BLANKS))


def extract_ids(answer: Column | str, pattern: str = ID_PATTERN) -> Column:
    """All card ids named in an answer, repeats kept, in order; null answer gives none."""
    found = F.regexp_extract_all(_col(answer), F.lit(pattern), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def blank_count(template: Column | str) -> Column:
    """Number of blanks (two or more underscores) in a template; null stays null."""
    return F.size(F.regexp_extract_all(_col(template), F.lit(BLANK_PATTERN), F.lit(0)))


def fill_template(template: Column | str, texts: Column) -> Column:
    """Replace the blanks from left to right by ``texts``.

    Surplus blanks stay as they are and surplus texts are ignored.  The texts
    are taken literally.
    """
    template = _col(template)
    blanks = F.regexp_extract_all(template, F.lit(BLANK_PATTERN), F.lit(0))
    parts = F.split(template, BLANK_PATTERN, -1)
    filled = F.transform(
        parts,
        lambda part, i: F.concat(
            F.when(i == 0, F.lit("")).otherwise(F.coalesce(F.get(texts, i - 1), F.get(blanks, i - 1))),
            part,
        ),
    )
    return F.array_join(filled, "")


def normalize_white(text: Column | str) -> Column:
    """Lower case, stripped, then without trailing ``.,;!`` (a blank before them stays)."""
    return F.rtrim(strip(F.lower(_col(text))), F.lit(TRAILING_MARKS))


def normalize_black(text: Column | str) -> Column:
    """Lower case and stripped."""
    return strip(F.lower(_col(text)))


def normalize_text(text: Column | str) -> Column:
    """Matching form of free text: as for white cards, ``__`` to blank, then blanks collapsed."""
    spaced = F.replace(normalize_white(text), F.lit("__"), F.lit(" "))
    return F.regexp_replace(spaced, r"[ \t\r\n]+", " ")


def option_label(card_id: Column | str, text: Column | str) -> Column:
    """One offered card as it is shown in a prompt."""
    return F.concat(F.lit("ID:"), _col(card_id), F.lit(" TEXT:"), _col(text), F.lit(";"))


def format_text(template: str, fields: dict[str, Column]) -> Column:
    """A Python format string as a column: literal pieces and fields, concatenated.

    Splitting the template while the plan is built means that braces inside a
    field's value are never read as placeholders.
    """
    pieces = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(fields[field].cast("string"))
    return F.concat(*pieces) if pieces else F.lit("")


def play_key(black_id: Column | str, winners: Column | str) -> Column:
    """Name of a play: ``B1|W1,W2``; null if the black card is null."""
    return F.concat(_col(black_id), F.lit("|"), F.coalesce(F.array_join(_col(winners), ","), F.lit("")))


def parse_list(text: Column | str) -> Column:
    """A list literal such as ``['W001', 'W002']`` as an array; null if it is none."""
    return F.from_json(_col(text), "array<string>", {"allowBackslashEscapingAnyCharacter": "true"})


def first_id(ids: Column | str) -> Column:
    """First id of a list, stripped; null for an empty list."""
    return strip(F.get(_col(ids), 0))


def id_number(card_id: Column | str) -> Column:
    """The digits of an id as a number; null if there are none."""
    return F.regexp_replace(_col(card_id), "[^0-9]", "").try_cast("bigint")


def run_id_from_name(name: Column | str) -> Column:
    """The run id inside a file name or path; null if there is none."""
    return F.nullif(F.regexp_extract(_col(name), RUN_ID_PATTERN, 0), F.lit(""))


def run_id(prompt_type: Column | str, started: Column | str) -> Column:
    """The id of a run from its prompt type and start time."""
    return F.concat(F.lit("run_"), _col(prompt_type), F.lit("_"), F.date_format(_col(started), RUN_TIME_FORMAT))


def run_started(run: Column | str) -> Column:
    """The start time inside a run id; null if it does not parse."""
    stamp = F.regexp_extract(_col(run), r"([0-9]{2}_[0-9]{2}_[0-9]{4}_[0-9]{2}-[0-9]{2}-[0-9]{2})$", 1)
    return F.try_to_timestamp(stamp, F.lit(RUN_TIME_FORMAT))


def clean_config(config: Column | str) -> Column:
    """Configuration name without its file-name suffix."""
    return F.replace(_col(config), F.lit(CONFIG_SUFFIX), F.lit(""))


def game_tag(config: Column | str, black_id: Column | str) -> Column:
    """Axis label of one game: ``config / black_id``."""
    return F.concat(_col(config), F.lit(" / "), _col(black_id))


def score_input(text: Column | str) -> Column:
    """Text as it is sent to a scorer: blank and null text become the empty string."""
    text = _col(text)
    return F.when(strip(text) == "", F.lit("")).otherwise(F.coalesce(text, F.lit("")))
