import pytest

LONG = "lorem ipsum dolor sit amet " * 4000

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture
def docs(spark):
    def make(*rows):
        return spark.createDataFrame([r if isinstance(r, tuple) and len(r) == 5 else row(*r) for r in rows], SCHEMA)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty, wordless and very long texts, repeated rows and ids."""
    return docs((1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one"), (5, "one"), (None, "a b c"), (6, "x\ny", None, None), (7, "!!! ... ###"), (8, "café \u00a0 日本 😀"))


def clashing(df):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["size", "words", "n_words", "id", "key", "n", "a", "b", "c", "spans", "items", "kept", "taken", "position", "bucket", "row", "line", "component", "target", "text_hash", "_hash", "marks", "score", "lang_pred"]
    return df.select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(extra)))
