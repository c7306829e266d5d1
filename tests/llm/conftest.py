import pytest

LONG = "lorem ipsum dolor sit amet " * 4000

# (doc_id, text, lang, source): nulls, empty and very long texts, repeated rows, ids that occur twice.
DOCUMENTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (3, "The Quick brown fox jumps over the lazy dog and runs away", "en", None),
    (4, None, None, None),
    (5, "", "en", "b"),
    (5, "", "en", "b"),
    (6, LONG, "en", "b"),
    (7, "same id, one text", None, "c"),
    (7, "same id, another text", "de", "c"),
    (7, "same id, another text", "de", "c"),
    (None, "no id at all", "en", "c"),
    (8, "ein kleiner Text über Öl, 'nd <|endoftext|>    \U0001f600 naïve café", "de", "d"),
    (9, "12 345 it's they'll  two  spaces\n\nlines\ttabs ", "en", "d"),
    (10, "…!? --- ###", "fr", "d"),
    (11, LONG, "en", "e"),
    (12, "word", "en", "e"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with columns whose names the operators use inside."""
    names = ["id", "digest", "group", "size", "copies", "hits", "items", "n_words", "row", "fp0", "doc", "tie", "spans", "score"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in DOCUMENTS], schema).repartition(3)


@pytest.fixture(scope="session")
def plain(docs):
    return docs.select("doc_id", "text", "lang", "source")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
