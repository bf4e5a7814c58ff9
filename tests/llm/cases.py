"""Small tables with the awkward cases."""

from tests.frames import frame

LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(9000))
TEXTS = [
    "",
    None,
    "   \n\t ",
    "one",
    "One two",
    "one two three",
    "The quick brown fox, the lazy dog.\nThe quick brown fox, the lazy dog.\n\n\nThe end",
    "Ünïcode — ça va? İstanbul ΣΑΣ   x\x1cy\x85z 你好 \U0001f600 é",
    "a" * 5000,
    "ab " * 3000,
    LONG,
    LONG,
    LONG[:-40],
    "special <|endoftext|> inside<|endoftext|><|startoftext|> it's we'll  x\n\n  y",
    "### $$$ %%% &&& *** <<< >>> |||",
]


def documents(spark, texts=TEXTS, ids=None, extra=True):
    """Documents with a null id, repeated rows and columns whose names clash with results."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{n % 3}" if n % 4 else None, None if t is None else len(t), 7, "x") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, n int, key string"
    df = frame(spark, rows, ddl)
    return df if extra else df.drop("n", "key")


def sample(spark, n=None):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df if n is None else df.where(df.doc_id < n)
