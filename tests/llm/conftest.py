import random

import pytest

LANGS = {
    "en": "the and of to in is that it was for with this from by are have",
    "de": "der die und das ist nicht ein eine mit auf für von dem sich auch",
    "fr": "le la les et des une est dans pour que qui sur avec pas être",
}


@pytest.fixture(scope="session")
def prose():
    """A text of so many words of a language's short vocabulary."""

    def make(seed, n=40, lang="en"):
        rnd = random.Random(seed)
        words = LANGS[lang].split()
        return " ".join(rnd.choice(words) + rnd.choice(("", "", rnd.choice(words))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names clash with results."""
    base = prose(1, 60)
    texts = [base, base, base + " tail", None, "", "   ", "one two", "ONE two", "9 9 9", prose(2, 30_000), "a b ünïcode \U0001f600 x", base.upper()]
    rows = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, 1, "x", 2.0, True, "k") for i, t in enumerate(texts)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, size double, kept boolean, component_id string")
