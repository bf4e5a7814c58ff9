"""Scoring of sentences: each distinct text once, in batches, attached by text."""

from __future__ import annotations

import json
import sys
import time
import types
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemeter.functions import scores, text
from choicemeter.names import ATTRIBUTES
from choicemeter.operators.answers import require_columns
from choicemeter.operators.lookup import match_join
from choicemeter.sources.slices import SLICES, ask_in_slices

# A scorer takes a table whose column ``input`` holds texts and adds its score columns.
Scorer = Callable[[DataFrame], DataFrame]

# Label of some checkpoints -> name used here.
ALIASES = {"sexual_explicit": "sexually_explicit"}
# Batch size of the local scorer, retry policy of the remote one.
BATCH_SIZE = 64
RETRY_STATUS = (429, 500, 502, 503, 504)
MAX_RETRIES = 5
BASE_BACKOFF = 1.0

# Word list of the default scorer, and the weight of each occurrence.
LEXICON = ("trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser", "stupid", "disgusting")
WORD_WEIGHT = 0.2


def pick_labels(available: Sequence[str], expected: Sequence[str] = ATTRIBUTES, aliases: Mapping[str, str] = ALIASES) -> list[str]:
    """Expected labels that a scorer offers, after renaming; none at all is an error."""
    offered = {aliases.get(label, label) for label in available}
    picked = [label for label in expected if label in offered]
    if not picked:
        raise ValueError(f"no matching labels: scorer offers {sorted(offered)}, expected {sorted(expected)}")
    return picked


def lexicon_score(input_text: Column | str, words: Sequence[str] = LEXICON, weight: float = WORD_WEIGHT) -> Column:
    """``weight`` per listed word in the whole text, at most 1."""
    pattern = r"\b(" + "|".join(words) + r")\b"
    lowered = F.lower(F.col(input_text) if isinstance(input_text, str) else input_text)
    return F.least(F.lit(1.0), F.regexp_count(lowered, F.lit(pattern)) * F.lit(weight))


def lexicon_scorer(lexicons: Mapping[str, Sequence[str]] | None = None, weight: float = WORD_WEIGHT) -> Scorer:
    """Scorer with one word list per label, all in column expressions."""
    lexicons = lexicons or {"toxicity": LEXICON}

    def score(texts: DataFrame) -> DataFrame:
        return texts.select("*", *(lexicon_score("input", words, weight).alias(label) for label, words in lexicons.items()))

    return score


def model_scorer(
    load: Callable[[], Callable[[list[str]], Mapping[str, Sequence[float]]]],
    labels: Sequence[str],
    batch_size: int = BATCH_SIZE,
    aliases: Mapping[str, str] = ALIASES,
) -> Scorer:
    """Scorer around a model: ``load()`` is called once per worker process and returns ``predict(texts)``.

    ``labels`` are the names that ``predict`` returns; it sees ``batch_size`` texts at a time, and
    only these are Python strings.  Columns pass through as they came, in slices of as many rows.
    """
    held = f"choicemeter-model-{uuid.uuid4().hex}"

    def score(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # kept where tasks of the same process find it, outside the function that travels with each
            models = sys.modules.setdefault("_choicemeter_models", types.ModuleType("_choicemeter_models")).__dict__
            if held not in models:
                models[held] = load()
            for batch in batches:
                for i in range(0, batch.num_rows, batch_size):
                    some = batch.slice(i, batch_size)
                    found = dict(models[held](some.column("input").to_pylist()))
                    # NaN is a missing score
                    scored = [pa.array(np.asarray(found[label], dtype="float64"), from_pandas=True) for label in labels]
                    yield pa.RecordBatch.from_arrays([*some.columns, *scored], [*some.schema.names, *labels])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
        raw = texts.mapInArrow(run, fields + "".join(f", `{label}` double" for label in labels))
        return raw.withColumnsRenamed({k: v for k, v in aliases.items() if k in labels})

    return score


def score_distinct(df: DataFrame, text_col: str, scorer: Scorer, labels: Sequence[str]) -> DataFrame:
    """One row per distinct text with its clipped scores."""
    distinct = df.select(text.score_input(text_col).alias("input")).distinct()
    scored = scorer(distinct)
    return scored.select("input", *(scores.clip_score(label).alias(label) for label in labels))


def attach_scores(df: DataFrame, scored: DataFrame, text_col: str, score_of: str = "input") -> DataFrame:
    """Join scores to every row with the same text; rows never multiply.

    ``scored`` has one row per text.  Texts are matched by their MD5 digest, so that rows
    carry their text once and the join compares 16 bytes.  A text that many rows share is
    dealt to several tasks (see ``match_join``).
    """
    require_columns(df, text_col)
    digest = lambda c: F.unhex(F.md5(c))
    keyed = df.withColumn("_digest", digest(text.score_input(text_col)))
    given = scored.select(digest(F.col(score_of)).alias("_digest"), *(c for c in scored.columns if c != score_of))
    return match_join(keyed, given, ["_digest"]).drop("_digest")


def add_scores(
    df: DataFrame,
    text_col: str,
    scorer: Scorer,
    available: Sequence[str],
    expected: Sequence[str] = ATTRIBUTES,
    aliases: Mapping[str, str] = ALIASES,
) -> DataFrame:
    """Score a table's text column: labels, clipping, flags of severe_toxicity."""
    require_columns(df, text_col)
    labels = pick_labels(available, expected, aliases)
    scored = attach_scores(df, score_distinct(df, text_col, scorer, labels), text_col)
    return with_flags(scored)


def with_flags(scored: DataFrame) -> DataFrame:
    """Add the two flags where the table has severe_toxicity."""
    if "severe_toxicity" not in scored.columns:
        return scored
    return scored.select("*", *scores.flag_columns("severe_toxicity"))


# --- remote scorer: replies as JSON --------------------------------------------------


def with_retry(
    call: Callable[[str], Mapping],
    max_retries: int = MAX_RETRIES,
    base_backoff: float = BASE_BACKOFF,
    sleep: Callable[[float], None] = time.sleep,
) -> Callable[[str], dict]:
    """Wrap a client: retry busy and server errors with doubling waits, return errors as replies.

    A client error that carries ``status`` is an HTTP error; any other
    exception ends the attempt at once.
    """

    def attempt(content: str) -> dict:
        for tries in range(max_retries + 1):
            try:
                return {**call(content), "original_text": content}
            except Exception as error:  # noqa: BLE001 - the reply row carries the failure
                status = getattr(error, "status", None)
                if status is None:
                    return {"original_text": content, "error": str(error)}
                if int(status) not in RETRY_STATUS or tries == max_retries:
                    return {"original_text": content, "error": f"HttpError {status}"}
                sleep(base_backoff * 2**tries)
        raise AssertionError("unreachable")

    return attempt


def batch_score_json(
    texts: DataFrame, text_col: str, call: Callable[[str], Mapping], tasks: int | None = None, store: str | None = None, slices: int = SLICES, **retry
) -> DataFrame:
    """Send each distinct text to a remote scorer; columns original_text, reply (JSON), error.

    With ``store``, a folder, replies are kept there slice by slice, and texts it holds
    are not sent again.
    """
    asked = texts.select(text.score_input(text_col).alias("original_text")).distinct()
    if store:
        return ask_in_slices(asked, lambda some: sent(some, call, tasks, **retry), store, slices)
    return sent(asked, call, tasks, **retry)


def sent(asked: DataFrame, call: Callable[[str], Mapping], tasks: int | None, **retry) -> DataFrame:
    """Replies to the texts; a column ``_call`` is carried along."""
    carried = [c for c in ("_call",) if c in asked.columns]
    if tasks:
        asked = asked.repartition(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = with_retry(call, **retry)
        for frame in batches:
            replies = [send(content) for content in frame["original_text"]]
            yield pd.DataFrame(
                {
                    "original_text": frame["original_text"].tolist(),
                    "reply": [None if "error" in r else json.dumps(r) for r in replies],
                    "error": [r.get("error") for r in replies],
                    **{c: frame[c].tolist() for c in carried},
                }
            )

    return asked.mapInPandas(run, "original_text string, reply string, error string" + "".join(f", {c} string" for c in carried))


def flatten_scores(replies: DataFrame, attributes: Sequence[str] = ATTRIBUTES, reply_col: str = "reply") -> DataFrame:
    """One column per attribute from the replies; failed or missing ones are null."""
    shape = "struct<attributeScores: map<string, struct<summaryScore: struct<value: double>>>>"
    parsed = replies.withColumn("_scores", F.from_json(reply_col, shape)["attributeScores"])
    value = lambda name: F.try_element_at("_scores", F.lit(name.upper()))["summaryScore"]["value"]
    flat = parsed.select(*replies.columns, *(scores.to_score(value(a)).alias(a.lower()) for a in attributes))
    return with_flags(flat)


# --- trained scorer -------------------------------------------------------------------


def train_scorer(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", features: int = 4096) -> PipelineModel:
    """Fit a bag-of-words toxicity model on labelled texts."""
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[^\p{L}]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features, binary=True),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label_col, maxIter=30, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(labelled)


def trained_scores(model: PipelineModel, texts: DataFrame, label: str = "toxicity") -> DataFrame:
    """Add the model's probability of the toxic class."""
    probability = vector_to_array("probability")[1].alias(label)
    return model.transform(texts).select(*texts.columns, probability)
