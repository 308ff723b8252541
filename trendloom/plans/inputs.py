"""How the given tables become posts and clusters; the SQL texts say the same for the checks."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from trendloom.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts that arrive at the time of the event with the same id; their source is a given cluster."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"), F.col("text").alias("full_text"), "lang", "source")
    arrivals = table(spark, sf_dir, "events").select(F.col("event_id").alias("post_id"), F.col("ts").alias("created_at"))
    joined = documents.join(arrivals, "post_id")
    return (joined.withColumn("cluster_id", F.expr("substr(source, 4)").cast("bigint"))
            .withColumn("preprocessed_text", F.col("full_text")).withColumn("assignment_time", F.col("created_at")))


POSTS = """posts AS (
  SELECT d.doc_id AS post_id, d.text AS full_text, d.lang, d.source, e.ts AS created_at,
         CAST(substr(d.source, 4) AS BIGINT) AS cluster_id, d.text AS preprocessed_text, e.ts AS assignment_time
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""


def actions(spark: SparkSession, sf_dir: str, cluster: str = "user_id") -> DataFrame:
    """Events as a denser stream of posts; the user (or the type) is a given cluster."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("post_id"), F.col("ts").alias("created_at"), F.col(cluster).alias("cluster_id"))


ACTIONS = "actions AS (SELECT event_id AS post_id, ts AS created_at, user_id AS cluster_id FROM events)"
TYPED = "typed AS (SELECT event_id AS post_id, ts AS created_at, event_type AS cluster_id FROM events)"


def one_day():
    return F.expr("INTERVAL 1 DAY")


def clusters(members: DataFrame) -> DataFrame:
    """Cluster rows of given posts: total count, and the last day's count as the rate."""
    day_ago = members.select(F.max("created_at")).scalar() - one_day()
    return members.groupBy("cluster_id").agg(
        F.concat(F.lit("topic "), F.col("cluster_id").cast("string")).alias("summary"),
        F.count(F.lit(1)).alias("post_count"), F.count_if(F.col("created_at") > day_ago).alias("post_rate"))


def clusters_sql(members: str, name: str = "clusters") -> str:
    return f"""{name} AS (
  SELECT cluster_id, 'topic ' || CAST(cluster_id AS VARCHAR) AS summary, count(*) AS post_count,
         count(*) FILTER (created_at > (SELECT max(created_at) FROM {members}) - INTERVAL 1 DAY) AS post_rate
  FROM {members} GROUP BY cluster_id)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with social markup added, and the entities of that markup."""
    doc = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    num = F.col("doc_id")

    def rest(n: int):
        return num % n

    def having(cond, *parts):
        return F.when(cond, F.concat(*parts)).otherwise(F.lit(""))

    handle = F.when(rest(3) == 0, F.lit("brand")).when(rest(3) == 1, F.lit("other"))
    ticker = F.when(rest(2) == 0, F.concat(F.lit("T"), rest(7).cast("string")))
    url = F.when(rest(5) == 0, F.concat(F.lit("https://t.example/"), num.cast("string")))
    media = F.when(rest(4) == 0, F.concat(F.lit("https://pic.example/"), num.cast("string")))
    full = F.concat(having(handle.isNotNull(), F.lit("@"), handle, F.lit(" ")), F.col("text"), F.lit(" #"), F.col("source"),
                    having(ticker.isNotNull(), F.lit(" $"), ticker), having(url.isNotNull(), F.lit(" "), url),
                    having(media.isNotNull(), F.lit(" "), media))

    def entity(value, field):
        return F.when(value.isNotNull(), F.array(F.struct(value.alias(field))))

    entities = F.struct(entity(ticker, "text").alias("symbols"), entity(handle, "screen_name").alias("user_mentions"),
                        entity(F.col("source"), "text").alias("hashtags"), entity(url, "url").alias("urls"),
                        entity(media, "url").alias("media"))
    return doc.select(num.alias("post_id"), full.alias("full_text"), entities.alias("entities"))


MARKED = """marked AS (
  SELECT doc_id AS post_id, source,
         CASE doc_id % 3 WHEN 0 THEN '@brand ' WHEN 1 THEN '@other ' ELSE '' END || text || ' #' || source
         || CASE WHEN doc_id % 2 = 0 THEN ' $T' || (doc_id % 7) ELSE '' END
         || CASE WHEN doc_id % 5 = 0 THEN ' https://t.example/' || doc_id ELSE '' END
         || CASE WHEN doc_id % 4 = 0 THEN ' https://pic.example/' || doc_id ELSE '' END AS full_text
  FROM documents)"""


def social_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, reposts and quotes: a later document with the same text reposts the first one, and an answer in a
    conversation quotes the turn before it."""
    p = posts(spark, sf_dir).withColumn("same", F.md5("full_text"))
    first = (p.groupBy("same").agg(F.min(F.struct("post_id", "created_at", "lang")).alias("o")))
    linked = p.join(first, "same")
    repost = F.col("post_id") != F.col("o.post_id")

    def ref(post_id, text, lang, created_at):
        return F.struct(post_id.alias("post_id"), text.alias("text"), text.alias("full_text"), lang.alias("lang"),
                        created_at.cast("timestamp").alias("created_at"))

    def doc_id(c):
        return F.concat(F.lit("d"), c.cast("string"))

    text = F.col("full_text")
    none = F.lit(None).cast("struct<post_id:string,text:string,full_text:string,lang:string,created_at:timestamp>")
    docs = linked.select(
        doc_id(F.col("post_id")).alias("post_id"),
        F.when(repost, F.concat(F.lit("RT @x "), text)).otherwise(text).alias("text"), text.alias("full_text"), "lang",
        F.col("created_at").cast("timestamp").alias("created_at"), F.lit(False).alias("is_quote"),
        F.when(repost, ref(doc_id(F.col("o.post_id")), text, F.col("o.lang"), F.col("o.created_at"))).alias("retweeted"),
        none.alias("quoted"))
    turns = table(spark, sf_dir, "conversations")
    lang = F.when(F.col("conv_id") % 2 == 0, F.lit("en")).otherwise(F.lit("de"))
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))

    def turn_id(turn):
        return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    quoted = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("quoted_text"))
    talk = turns.join(quoted, ["conv_id", "turn"], "left")
    is_quote = (F.col("role") == "assistant") & F.col("quoted_text").isNotNull()
    talk = talk.select(
        turn_id(F.col("turn")).alias("post_id"), "text", F.col("text").alias("full_text"), lang.alias("lang"), when.alias("created_at"),
        is_quote.alias("is_quote"), none.alias("retweeted"),
        F.when(is_quote, ref(turn_id(F.col("turn") - 1), F.col("quoted_text"), lang, when)).alias("quoted"))
    return docs.unionByName(talk)


SOCIAL_EVENTS = POSTS + """, first_copy AS (
  SELECT md5(full_text) AS same, arg_min(post_id, post_id) AS o_id, arg_min(lang, post_id) AS o_lang FROM posts GROUP BY 1),
doc_events AS (
  SELECT p.post_id, p.full_text, p.lang, f.o_id, f.o_lang, p.post_id <> f.o_id AS repost
  FROM posts p JOIN first_copy f ON md5(p.full_text) = f.same),
talk_events AS (
  SELECT t.conv_id, t.turn, t.text, q.text AS quoted_text, t.role = 'assistant' AND q.text IS NOT NULL AS is_quote,
         t.conv_id % 2 = 0 AS english
  FROM conversations t LEFT JOIN conversations q ON q.conv_id = t.conv_id AND q.turn + 1 = t.turn)"""


# --- shared SQL for text mining ---

TOKENS = r"""tokens AS (
  SELECT post_id, unnest(list_distinct(regexp_extract_all(full_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))) AS token FROM posts)"""


def greedy_sql(edges: str, order: str) -> str:
    """One-by-one first-come selection over ``edges`` (l, r); gives ``kept`` and ``dropped`` among connected rows.

    ``order``: table with (id, created_at)."""
    return f"""linked AS (SELECT DISTINCT id FROM (SELECT l AS id FROM {edges} UNION ALL SELECT r FROM {edges})),
steps AS (
  SELECT o.id, row_number() OVER (ORDER BY o.created_at, o.id) AS i,
         (SELECT list(r) FROM {edges} x WHERE x.l = o.id) AS earlier
  FROM {order} o JOIN linked USING (id)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept
  UNION ALL
  SELECT w.i + 1, CASE WHEN list_has_any(w.kept, coalesce(s.earlier, [])) THEN w.kept ELSE list_append(w.kept, s.id) END
  FROM walk w JOIN steps s ON s.i = w.i + 1),
dropped AS (
  SELECT id FROM linked WHERE id NOT IN (SELECT unnest(kept) FROM walk WHERE i = (SELECT max(i) FROM walk)))"""


def vectors_sql(source: str, stop_words) -> str:
    """Unit term vectors of ``source`` (post_id, full_text)."""
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words)
    return rf"""raw_terms AS (
  SELECT post_id, unnest(regexp_extract_all(lower(full_text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {source}),
tf AS (SELECT post_id, term, count(*) AS tf FROM raw_terms WHERE term NOT IN ({stops}) GROUP BY ALL),
vec AS (SELECT post_id, term, tf, tf / sqrt(sum(tf * tf) OVER (PARTITION BY post_id)) AS w FROM tf)"""
