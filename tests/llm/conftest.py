import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use inside; an extra column may have any of them.
CLASHES = ["row", "th", "kept", "size", "key", "n", "span", "spans", "label", "tokens", "upto", "turn"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents out of (doc_id, text, lang, source), with clashing extra columns."""

    def make(rows, extra=True):
        data = [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]
        df = spark.createDataFrame(data, DOCS)
        return df.selectExpr("*", *[f"'x' as {c}" for c in CLASHES]) if extra else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null columns, ties, repeated rows, copies and a long text."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, long = text(60), text(20_000)
    rows = [
        (0, None, None, None),
        (1, "", "en", "a"),
        (2, " \t\n", "en", "a"),
        (3, passage, "en", "b"),
        (4, f"{text(30)}\n{passage}\n{text(5)}", "en", "b"),
        (5, f"{text(70)} {passage}", None, None),
        (6, "é ü  \U0001f600 \x00 x", "fr", ""),
        (None, f"{passage} {text(9)}", "de", "a"),
        (7, long, "en", "c"),
        (8, long[:4000], "en", "c"),
        (9, "ha " * 400, "en", "c"),
        (10, text(80), "de", "a"),
        (10, text(80), "de", "a"),
        (11, "single", "en", "b"),
        (12, "single", "en", "b"),
    ]
    same = (13, text(90), "en", "b")
    return [*rows, same, same]
