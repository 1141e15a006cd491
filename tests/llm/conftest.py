import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, score string, sequence_id string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def docs(spark):
    """Documents with columns whose names clash with those of results."""

    def make(*rows):
        full = [(d, t, *(r[0] if r else ("en", "s")), len(t) if t is not None else None, "x", "y", "z", "q") for d, t, *r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture
def awkward(docs):
    """Nulls, empty and blank texts, repeated rows, one id with two texts, one very long text."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return docs(
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six seven"), (4, "one two three four five six seven"),
        (5, "a"), (5, "b b b"), (None, "no id here at all, none"), (6, long, (None, None)), (7, "\x00\x1c  \U0001F600 é ́x"),
    )


@pytest.fixture
def nothing(docs):
    return docs()
