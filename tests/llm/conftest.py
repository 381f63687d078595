import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, _words string, _hits int, lang_pred int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (doc_id, text[, lang, source]), with extra columns whose names clash with those of the operators."""

    def build(rows, partitions=3):
        full = []
        for k, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (k, r)
            i, t, lang, source = (*r, "en", "src0")[:2] + ((*r, "en", "src0")[2:4] if len(r) == 2 else (*r[2:], "src0")[:2])
            full.append((i, t, lang, source, len(t or ""), "x", "y", "z", 1, 2))
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


#: Nulls, empty and blank texts, repeats, ties, odd characters, a very long text and one very long word.
ODD = [
    (0, "one two three four five six"), (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (4, "one two three four five six"), (None, "one two three four five six"), (None, None),
    (5, "a\nb\nc\na\nb\nc"), (6, "é 𝄞 ☃ ▁  x"), (7, "word " * 30_000), (8, "x" * 60_000), (9, "9" * 5_000), (10, "a@" * 3_000), (11, "\n" * 5_000),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)
