"""Column, table and label names shared by the operators."""

# Score attributes, in the order they are reported.
ATTRIBUTES = (
    "toxicity",
    "severe_toxicity",
    "obscene",
    "threat",
    "insult",
    "identity_attack",
    "sexually_explicit",
    "profanity",
)

# Classifier and colour names.
CLASSIFIERS = ("detoxify", "perspective")
BLACK, WHITE = "BLACK", "WHITE"

# How one experiment cell is identified.
CELL_KEYS = ("config", "lang", "model", "temperature", "black_id")

# The labels a run gets when its description cannot be found.
NO_CONFIG = "ERROR: Description not found"
NO_DESCRIPTION = "JUDGE_DESCRIPTION_MISSING"
