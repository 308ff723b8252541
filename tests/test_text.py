import pytest
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.operators import filters
from trendloom.operators.cleaning import clean_posts
from trendloom.schema import ENTITIES

NO = (None, None, None, None, None)


def entities(symbols=None, mentions=None, hashtags=None, urls=None, media=None):
    return tuple(None if v is None else [(x,) for x in v] for v in (symbols, mentions, hashtags, urls, media))


CASES = [
    ("@united lost my bag #fail $UAL https://t.co/a &amp; again",
     entities(["UAL"], ["united"], ["fail"], ["https://t.co/a"]), "united lost my bag fail & again"),
    ("@bob are we there yet now", entities(mentions=["bob"]), "are we there yet now"),
    ("@United lost my bag today", entities(mentions=["United"]), "lost my bag today"),
    ("now just four words", NO, "now just four words"),
    ("see pic https://t.co/m of my flight", entities(media=["https://t.co/m"]), "see pic of my flight"),
    ("a &lt;b&gt; c d e", (None, None, None, [], None), "a <b> c d e"),
    ("RT so glad \U0001F600 to :) fly FAV now", NO, "so glad to fly now"),
    ("mail bob@example.com #tag now", NO, "mail bob.com now"),
    (None, NO, None),
]


@pytest.fixture(scope="module")
def frame(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("full_text", T.StringType()), T.StructField("entities", ENTITIES)])
    return lambda rows: spark.createDataFrame(rows, schema)


def test_clean_text_cases(frame):
    rows = clean_posts(frame([(t, e) for t, e, _ in CASES]), ("united",), n=0).collect()
    assert {r.full_text: r.preprocessed_text for r in rows} == {t: want for t, _, want in CASES if t is not None}


def test_cashtag_removal_eats_the_head_of_a_longer_one(frame):
    df = frame([("$A and $AAPL fly high", entities(["A", "AAPL"]))])
    assert df.select(X.strip_cashtags(F.col("full_text"), F.col("entities.symbols"))).first()[0] == " and APL fly high"


def test_missing_and_empty_entity_values_change_nothing(frame):
    df = frame([("a $ b @ c #", ([(None,)], [(None,)], [], [("",)], [(None,)]))])
    assert df.select(X.strip_entities(F.col("full_text"), F.col("entities"))).first()[0] == "a $ b @ c #"


def test_min_words_is_strict(spark):
    df = spark.createDataFrame([("too short post",), ("now just four words",), ("  a\tb\nc  d ",), ("",), (None,)], "text string")
    assert [r.text for r in filters.min_words(df).collect()] == ["now just four words", "  a\tb\nc  d "]


def test_tokens(spark):
    df = spark.createDataFrame([("Don't stop, stop! Élan_1 the",)], "t string")
    row = df.select(X.dedup_tokens(F.col("t")).alias("d"), X.feature_tokens(F.col("t")).alias("f"),
                    X.sentences(F.col("t")).alias("s"), X.word_count(F.col("t")).alias("n")).first()
    assert row.d == ["Don", "'", "t", "stop", ",", "!", "Élan_1", "the"]
    assert row.f == ["stop", "stop", "élan_1"]  # "don" is a stop word of the public list
    assert row.s == ["Don't stop, stop!", "Élan_1 the"] and row.n == 5


def test_period_and_time(spark):
    df = spark.createDataFrame([("a",), ("a.",)], "t string")
    assert [r[0] for r in df.select(X.end_with_period(F.col("t"))).collect()] == ["a.", "a."]
    one = spark.sql("SELECT timestamp'2024-01-01 12:00:00' AS b, timestamp'2024-01-01 10:30:00' AS a")
    row = one.select(X.format_time(F.col("a")).alias("f"), X.elapsed_minutes(F.col("b"), F.col("a")).alias("m"),
                     X.elapsed_hours(F.col("b"), F.col("a")).alias("h")).first()
    assert (row.f, row.m, row.h) == ("2024-01-01 10:30:00", 90.0, 1.5)


def test_unescape_covers_all_entities(spark):
    df = spark.createDataFrame([("&eacute;&#233;&#xe9; &amp;lt; x&y",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(X.html_unescape(F.col("t"))).collect()] == ["ééé &lt; x&y", "plain", None]
