"""Row contracts of the tables and of the run configurations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_SPARK_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


@dataclass(frozen=True)
class Contract:
    """Required columns with their types; ``open_columns`` keeps undeclared ones.

    ``min_filled`` is (prefix, n): at least n columns that start with the
    prefix must be filled.
    """

    name: str
    columns: tuple[tuple[str, str], ...]
    open_columns: bool = False
    min_filled: tuple[str, int] | None = None

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name, _SPARK_TYPES[kind]) for name, kind in self.columns])


def _columns(text: str) -> tuple[tuple[str, str], ...]:
    pairs = (item.split(":") for item in text.split())
    return tuple((name, kind) for name, kind in pairs)


_WINNERS = "config:string iteration:int lang:string model:string temperature:double black_id:string play:string"
_OPTIONS = "config:string lang:string model:string temperature:double winners:string play:string black_id:string white_id:string sentence:string"
_SIX = "toxicity:double severe_toxicity:double obscene:double threat:double insult:double identity_attack:double"
_TWO = "sexually_explicit:double profanity:double"
_FLAGS = "severe_toxicity_gt_05:int severe_toxicity_gt_08:int"

# Columns and types of the nine tables.  The order of the dict is
# the order in which names are tried against a file name.
CONTRACTS = {
    "cards": Contract("cards", _columns("card_id:string card_text:string")),
    "games": Contract("games", _columns("lang:string black_id:string"), open_columns=True, min_filled=("white_id_", 2)),
    "raw_responses": Contract("raw_responses", _columns(f"{_WINNERS} response:string")),
    "combination_sentences": Contract("combination_sentences", _columns(_OPTIONS)),
    "winners_sentences": Contract("winners_sentences", _columns(f"{_WINNERS} winners:string sentence:string")),
    "combinations_detoxify": Contract("combinations_detoxify", _columns(f"{_OPTIONS} {_SIX} {_FLAGS}")),
    "combinations_perspective": Contract("combinations_perspective", _columns(f"{_OPTIONS} {_SIX} {_FLAGS}")),
    "winners_detoxify": Contract("winners_detoxify", _columns(f"{_WINNERS} winners:string sentence:string {_SIX} {_FLAGS}")),
    "winners_perspective": Contract(
        "winners_perspective", _columns(f"{_WINNERS} winners:string sentence:string {_SIX} {_TWO} {_FLAGS}")
    ),
}


def contract_for(name: str) -> Contract:
    """The contract whose name occurs first in a data set or file name."""
    lowered = name.lower()
    for key, contract in CONTRACTS.items():
        if key in lowered:
            return contract
    raise ValueError(f"no contract for {name!r}")


# Fields of the configuration files by stage.  A tuple lists the allowed texts.
RUN_CONFIG = {
    "cards_dir": "string",
    "results_dir": "string",
    "file_type": ("csv", "parquet"),
    "languages": "strings",
    "models": "strings",
    "temperatures": "doubles",
    "rounds": "int",
    "dataset_mode": ("test", "all"),
    "test_num_rows": "int",
    "prompt_type": ("prompt_player", "prompt_judge"),
    "character_description": "string",
}
STAGE_CONFIGS = {
    1: RUN_CONFIG,
    2: {"run_id": "string", "run_config_dir": "string"},
    3: {
        "run_id": "string",
        "run_config_dir": "string",
        "detoxify_model": "string",
        "device": "string",
        "batch_size": "int",
    },
    4: {"run_id": "string", "run_config_dir": "string"},
    5: {"analysis_dir": "string", "file_type": "string"},
}
