"""Row-wise selection: tracking, language, length, seen ids, reposts and quotes, windows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.functions import text as X
from trendloom.schema import ENTITIES


def track(df: DataFrame, terms, text: str = "text") -> DataFrame:
    """Posts whose text holds any tracked term, ignoring case."""
    lowered = F.lower(F.col(text))
    return df.filter(reduce(Column.__or__, [lowered.contains(t.lower()) for t in terms]))


def lang_gate(df: DataFrame, lang: str = "en", column: str = "lang") -> DataFrame:
    return df.filter(F.col(column) == lang)


def min_words(df: DataFrame, n: int = 3, text: str = "text") -> DataFrame:
    """Strictly more than ``n`` whitespace-separated words."""
    return df.filter(X.word_count(F.col(text)) > n)


def skip_seen(df: DataFrame, recent: DataFrame, key: str = "post_id") -> DataFrame:
    return df.join(recent.select(key), key, "left_anti")


def expand(events: DataFrame, lang: str = "en", seen: DataFrame | None = None) -> DataFrame:
    """One event becomes 0..2 posts (``pos`` keeps their order).

    A text with the repost marker yields only its original; a quote yields the quoted original, then itself;
    anything else yields itself. ``arrived_at`` is the event's own time, however old the original is. Originals must be present, in ``lang`` and not in ``seen``.
    """
    fields = ("post_id", "text", "full_text", "lang", "created_at")
    no_entities = F.lit(None).cast(ENTITIES).alias("entities")

    def original(name: str) -> Column:
        return F.struct(*[F.col(name)[c].alias(c) for c in fields], no_entities, F.lit(name).alias("kind"))

    own_entities = F.col("entities") if "entities" in events.columns else no_entities
    itself = F.struct(*[F.col(c) for c in fields], own_entities, F.lit("self").alias("kind"))
    choices = (F.when(X.contains_marker(F.col("text")), F.array(original("retweeted")))
               .when(F.coalesce(F.col("is_quote"), F.lit(False)), F.array(original("quoted"), itself))
               .otherwise(F.array(itself)))
    allowed = F.filter(choices, lambda p: (p["kind"] == "self") | (p["post_id"].isNotNull() & (p["lang"] == lang)))
    posts = (events.select(F.col("post_id").alias("event_id"), F.col("created_at").alias("arrived_at"), F.posexplode(allowed).alias("pos", "post"))
             .select("event_id", "arrived_at", "pos", "post.*"))
    if seen is None:
        return posts
    # Only originals are looked up here; the event's own id is checked by skip_seen before expansion.
    looked_up = F.when(F.col("kind") != "self", F.col("post_id"))
    return posts.join(seen.select(F.col("post_id").alias("_seen")), looked_up == F.col("_seen"), "left_anti")


def recent(df: DataFrame, as_of: Column, minutes: int = 30, time: str = "created_at") -> DataFrame:
    """Rows strictly younger than ``minutes``."""
    return df.filter(F.col(time) > X.minutes_before(as_of, minutes))


def latest_time(df: DataFrame, time: str = "created_at") -> Column:
    """``max(time)`` as a scalar subquery, the default ``as_of``."""
    return df.select(F.max(time)).scalar()


def of_cluster(df: DataFrame, cluster_id) -> DataFrame:
    return df.filter(F.col("cluster_id") == cluster_id)


def assigned_only(clusters: DataFrame) -> DataFrame:
    return clusters.filter(F.col("cluster_id").isNotNull())


def post_record(posts: DataFrame) -> DataFrame:
    """The stored columns shown to readers; the raw payload stays behind."""
    return posts.select("post_id", "preprocessed_text", "full_text", "created_at", "cluster_id", "assignment_time")


def valid(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns or ("post_id", "full_text")))
