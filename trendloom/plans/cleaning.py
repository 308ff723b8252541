"""Registered queries for sources, filters and text functions."""

from pyspark.sql import functions as F, types as T

from trendloom.functions import lexicon as L, text as X
from trendloom.operators import filters, trends
from trendloom.operators.cleaning import clean_posts
from trendloom.plans import inputs as I
from trendloom.plans.registry import Registry
from trendloom.sources import posts as S

REG = Registry()
KEEP = ("brand",)

# --- entity removal on marked-up documents; {t} stands for the text ---

_CASH = "CASE WHEN post_id % 2 = 0 THEN replace({t}, '$T' || (post_id % 7), '') ELSE {t} END"
_MENTION = "CASE post_id % 3 WHEN 0 THEN replace({t}, '@brand', 'brand') WHEN 1 THEN replace({t}, '@other', '') ELSE {t} END"
_HASH = "replace({t}, '#', '')"
_URL = "CASE WHEN post_id % 5 = 0 THEN replace({t}, 'https://t.example/' || post_id, '') ELSE {t} END"
_MEDIA = "CASE WHEN post_id % 4 = 0 THEN replace({t}, 'https://pic.example/' || post_id, '') ELSE {t} END"
# The entities that occur in the given pages; the ampersand comes last.
_UNESCAPE = ("regexp_replace(replace(replace(replace({t}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), "
             "'&amp;?', '&', 'g')")


def social_clean_sql(text: str) -> str:
    """The clean step without look-around, which DuckDB's regular expressions lack."""
    for pattern, replacement in (
            (r"(https?://|www\.)\S+", ""), (r"@[\p{L}\p{N}_]+", ""), (r"#[\p{L}\p{N}_]+", ""),
            (r"(^|[^\p{L}\p{N}_@#])(RT|FAV)($|[^\p{L}\p{N}_])", r"\1\3"),
            (r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]", ""),
            (r"(^|\s)[:;=][''-]?[()DPpOoSs/\\|]+($|\s)", r"\1\2"), (r"\s+", " ")):
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return f"trim({text})"


def _chain(steps: list[str], source: str) -> str:
    query = f"SELECT post_id, full_text AS t FROM {source}"
    for step in steps:
        query = f"SELECT post_id, {step.replace('{t}', 't')} AS t FROM ({query})"
    return query


CLEAN_MARKED = _chain([_CASH, _MENTION, _HASH, _URL, _MEDIA, _UNESCAPE, social_clean_sql("{t}")], "marked")


def _step(name: str, expression: str, column) -> None:
    @REG.query(name, f"WITH {I.MARKED} SELECT post_id, {expression.replace('{t}', 'full_text')} AS clean FROM marked")
    def run(spark, sf):
        return I.marked(spark, sf).select("post_id", column(F.col("full_text"), F.col("entities")).alias("clean"))


_step("strip_cashtags", _CASH, lambda t, e: X.strip_cashtags(t, e["symbols"]))
_step("strip_mentions", _MENTION, lambda t, e: X.strip_mentions(t, e["user_mentions"], KEEP))
_step("strip_hash_signs", _HASH, lambda t, e: X.strip_hash_signs(t, e["hashtags"]))
_step("strip_urls", _URL, lambda t, e: X.strip_urls(t, e["urls"]))
_step("strip_media", _MEDIA, lambda t, e: X.strip_media(t, e["media"]))
_step("social_clean", social_clean_sql("{t}"), lambda t, e: X.social_clean(t))


@REG.query("clean_post", f"WITH {I.MARKED} SELECT post_id, t AS clean FROM ({CLEAN_MARKED}) "
                         r"WHERE len(regexp_extract_all(t, '\S+')) > 3")
def clean_post(spark, sf):
    return clean_posts(I.marked(spark, sf), KEEP, 3, out="clean").select("post_id", "clean")


@REG.query("html_unescape", f"SELECT page_id, {_UNESCAPE.replace('{t}', 'html')} AS text FROM pages")
def html_unescape(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", X.html_unescape(F.col("html")).alias("text"))


# --- words and tokens ---

def _text_query(name: str, sql: str, column, alias: str) -> None:
    @REG.query(name, f"SELECT doc_id, {sql} AS {alias} FROM documents")
    def run(spark, sf):
        return I.table(spark, sf, "documents").select("doc_id", column(F.col("text")).alias(alias))


_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in L.ENGLISH_STOP_WORDS)
_text_query("word_count", r"len(regexp_extract_all(text, '\S+'))", X.word_count, "words")
_text_query("dedup_tokens", r"array_to_string(list_sort(list_distinct(regexp_extract_all(text, "
            r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))), ' ')",
            lambda t: F.array_join(F.array_sort(X.dedup_tokens(t)), " "), "tokens")
_text_query("feature_tokens", r"array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), "
            f"lambda w: w NOT IN ({_STOPS})), ' ')", lambda t: F.array_join(X.feature_tokens(t), " "), "tokens")
_text_query("end_with_period", "CASE WHEN suffix(text, '.') THEN text ELSE text || '.' END", X.end_with_period, "line")


@REG.query("format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events")
def format_time(spark, sf):
    return I.table(spark, sf, "events").select("event_id", X.format_time(F.col("ts")).alias("t"))


@REG.query("time_arithmetic", """WITH last AS (SELECT max(ts) AS as_of FROM events)
SELECT event_id, ts - INTERVAL 30 MINUTE AS half_hour_before,
       floor(epoch(as_of - ts)) / 60.0 AS minutes_old, floor(epoch(as_of - ts)) / 3600.0 AS hours_old
FROM events, last""")
def time_arithmetic(spark, sf):
    e = I.table(spark, sf, "events")
    as_of = e.select(F.max("ts")).scalar()
    return e.select("event_id", X.minutes_before(F.col("ts"), 30).alias("half_hour_before"),
                    X.elapsed_minutes(as_of, F.col("ts")).alias("minutes_old"), X.elapsed_hours(as_of, F.col("ts")).alias("hours_old"))


@REG.query("contains_marker", f"WITH {I.POSTS}" + """, first_copy AS (
  SELECT md5(full_text) AS same, min(post_id) AS o_id FROM posts GROUP BY 1)
SELECT 'd' || p.post_id AS post_id, p.post_id <> f.o_id OR contains(p.full_text, 'RT @') AS is_repost
FROM posts p JOIN first_copy f ON md5(p.full_text) = f.same
UNION ALL SELECT 'c' || conv_id || '-' || turn, contains(text, 'RT @') FROM conversations""")
def contains_marker(spark, sf):
    return I.social_events(spark, sf).select("post_id", X.contains_marker(F.col("text")).alias("is_repost"))


# --- filters ---

@REG.query("track_filter", f"""WITH {I.MARKED}
SELECT post_id FROM marked WHERE contains(lower(full_text), '@brand') OR contains(lower(full_text), '#src7')""")
def track_filter(spark, sf):
    return filters.track(I.marked(spark, sf), ["@Brand", "#src7"], "full_text").select("post_id")


@REG.query("language_gate", f"WITH {I.POSTS} SELECT post_id, created_at FROM posts WHERE lang = 'en'")
def language_gate(spark, sf):
    return filters.lang_gate(I.posts(spark, sf), "en").select("post_id", "created_at")


@REG.query("min_words", r"SELECT doc_id, n_chars FROM documents WHERE len(regexp_extract_all(text, '\S+')) > 3")
def min_words(spark, sf):
    return filters.min_words(I.table(spark, sf, "documents"), 3).select("doc_id", "n_chars")


@REG.query("skip_seen", f"""WITH {I.POSTS}
SELECT post_id, created_at FROM posts WHERE created_at > (SELECT max(created_at) FROM posts) - INTERVAL 1 DAY""")
def skip_seen(spark, sf):
    p = I.posts(spark, sf)
    held = p.filter(F.col("created_at") <= filters.latest_time(p) - F.expr("INTERVAL 1 DAY"))
    return filters.skip_seen(p, held).select("post_id", "created_at")


@REG.query("expand_posts", f"""WITH {I.SOCIAL_EVENTS},
seen AS (SELECT 'd' || post_id AS id FROM posts WHERE source = 'src3')
SELECT event_id, pos, post_id, kind, text FROM (
  SELECT 'd' || post_id AS event_id, 0 AS pos, CASE WHEN repost THEN 'd' || o_id ELSE 'd' || post_id END AS post_id,
         CASE WHEN repost THEN 'retweeted' ELSE 'self' END AS kind, full_text AS text
  FROM doc_events WHERE lang = 'en' AND (NOT repost OR (o_lang = 'en' AND 'd' || o_id NOT IN (SELECT id FROM seen)))
  UNION ALL
  SELECT 'c' || conv_id || '-' || turn, 0, 'c' || conv_id || '-' || (turn - 1), 'quoted', quoted_text
  FROM talk_events WHERE english AND is_quote
  UNION ALL
  SELECT 'c' || conv_id || '-' || turn, CASE WHEN is_quote THEN 1 ELSE 0 END, 'c' || conv_id || '-' || turn, 'self', text
  FROM talk_events WHERE english)""")
def expand_posts(spark, sf):
    events = filters.lang_gate(I.social_events(spark, sf), "en")
    seen = I.table(spark, sf, "documents").filter(F.col("source") == "src3").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("post_id"))
    return filters.expand(events, "en", seen).select("event_id", "pos", "post_id", "kind", "text")


@REG.query("valid_post", """SELECT event_id AS post_id, text AS full_text FROM events JOIN documents ON doc_id = event_id
WHERE text IS NOT NULL""")
def valid_post(spark, sf):
    e = I.table(spark, sf, "events").select(F.col("event_id").alias("post_id"))
    d = I.table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("full_text"))
    return filters.valid(trends.enrich(e, d)).select("post_id", "full_text")


@REG.query("enrich_full_text", """SELECT event_id AS post_id, ts AS created_at, text AS full_text, lang
FROM events LEFT JOIN documents ON doc_id = event_id""")
def enrich_full_text(spark, sf):
    e = I.table(spark, sf, "events").select(F.col("event_id").alias("post_id"), F.col("ts").alias("created_at"))
    d = I.table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("full_text"), "lang")
    return trends.enrich(e, d)


# --- raw records ---

_DOC = T.StructType([T.StructField("post_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def _documents(spark, sf):
    return I.table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), "text", "lang", "source")


@REG.query("raw_payload", "SELECT doc_id AS post_id, text, lang, source FROM documents")
def raw_payload(spark, sf):
    kept = S.with_raw(_documents(spark, sf)).select("raw")
    return kept.select(F.from_json("raw", _DOC).alias("r")).select("r.*")


@REG.query("quarantine", """SELECT doc_id AS post_id,
CASE lang WHEN 'es' THEN 'corrupt' WHEN 'fr' THEN 'missing text' ELSE 'good' END AS outcome FROM documents""")
def quarantine(spark, sf):
    """Spanish records lose their last character and French ones their text, then all are read as JSON."""
    d = _documents(spark, sf)
    damaged = d.withColumn("text", F.when(F.col("lang") != "fr", F.col("text")))
    lines = S.with_raw(damaged, "value").select("post_id", F.when(F.col("lang") == "es", F.expr("left(value, length(value) - 1)"))
                                                .otherwise(F.col("value")).alias("value"))
    good, bad = S.split_bad(lines, _DOC)
    return (good.select("post_id", F.lit("good").alias("outcome"))
            .unionByName(bad.select("post_id", F.col("reason").alias("outcome"))))
