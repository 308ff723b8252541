import pytest
from pyspark.sql import types as T

#: The columns of ``documents`` and others that clash with names the operators use inside or give back.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in ("_id", "_text", "node", "label", "start", "ids", "kept", "n_lines", "size", "copies", "shard", "gram", "_row", "words", "_mix_id")]])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(*row, *["x"] * (len(SCHEMA) - 5)) for row in rows], SCHEMA)
    return make


LONG = " ".join(f"word{i % 9973} other{i % 17}" for i in range(60_000)) + "\n" + "z" * 50_000

ODD_ROWS = [
    (1, "One line of text that is quite long enough to be a line key here.\nsecond", "en", "a", 70),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "a text without an id, mail me@host.example.org", "de", "b", 10),
    (None, None, None, None, None),
    (4, LONG, "en", "a", len(LONG)),
    (5, "One line of text that is quite long enough to be a line key here.\nsecond", "en", "b", 70),
    (5, "One line of text that is quite long enough to be a line key here.\nsecond", "en", "b", 70),
    (6, " \t\n\n  \r\n", "", "", 8),
    (7, "　\xa0 éè \U0001f642 <|endoftext|> +1 (314) 555-6532 4663622617512349", "fr", "b", 40),
    (-9, "short", "en", "a", 5),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD_ROWS)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])
