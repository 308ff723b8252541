"""Registered queries for stored tables: creation, appends, replacement, moves and updates."""

from pyspark.sql import functions as F

from trendloom.operators import filters, retention, trends
from trendloom.operators.neardup import recent_tokens
from trendloom.plans import inputs as I
from trendloom.plans.registry import Registry
from trendloom.schema import STORED_POSTS
from trendloom.session import scratch_dir
from trendloom.sources import tables

REG = Registry()
_STORED = ["post_id", "preprocessed_text", "full_text", "created_at", "cluster_id", "assignment_time"]
_DAY_AGO = "(SELECT max(created_at) FROM {0}) - INTERVAL 1 DAY"


@REG.query("post_tables", f"""WITH {I.POSTS}
SELECT time_bucket(INTERVAL 4 HOUR, created_at) AS epoch, count(*) AS posts, count(DISTINCT cluster_id) AS clusters
FROM posts GROUP BY 1""")
def post_tables(spark, sf):
    """Create the tables, store all posts in the partitioned one and count them from there."""
    base = scratch_dir(spark, "tables")
    names = tables.ensure_tables(spark, base, prefix=f"t{base.rsplit('-', 1)[1]}_")
    p = retention.with_epoch(I.posts(spark, sf)).withColumn("raw", F.lit(None).cast("string"))
    row = p.select(*[F.col(f.name).cast(f.dataType) for f in STORED_POSTS.fields])
    row.repartition("epoch", F.pmod(F.xxhash64("post_id"), F.lit(16))).write.insertInto(names["recent_posts"])
    stored = spark.table(names["recent_posts"])
    return stored.groupBy("epoch").agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("cluster_id").alias("clusters")).select(
        F.col("epoch").cast("timestamp_ntz").alias("epoch"), "posts", "clusters")


@REG.query("recent_scan", r"""SELECT doc_id AS post_id,
array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))), ' ') AS tokens FROM documents""")
def recent_scan(spark, sf):
    stored = I.table(spark, sf, "documents").withColumnsRenamed({"doc_id": "post_id", "text": "preprocessed_text"})
    return recent_tokens(stored).select("post_id", F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


@REG.query("append_new_posts", f"""WITH {I.POSTS}
SELECT post_id, created_at, CASE WHEN created_at <= {_DAY_AGO.format('posts')} THEN 'stored' ELSE 'incoming' END AS origin FROM posts""")
def append_new_posts(spark, sf):
    """All posts arrive twice; those older than a day are stored already."""
    p = I.posts(spark, sf).select("post_id", "created_at")
    recent = p.filter(F.col("created_at") <= filters.latest_time(p) - I.one_day()).withColumn("origin", F.lit("stored"))
    incoming = p.withColumn("origin", F.lit("incoming"))
    return recent.unionByName(tables.append_posts(incoming.unionByName(incoming), recent))


@REG.query("upsert_clusters", f"""WITH {I.ACTIONS},
new AS (SELECT cluster_id, count(*) AS post_count FROM actions WHERE created_at > {_DAY_AGO.format('actions')} GROUP BY 1),
cur AS (SELECT cluster_id, count(*) AS post_count FROM actions GROUP BY 1)
SELECT cluster_id, post_count, 'new' AS version FROM new
UNION ALL SELECT cluster_id, post_count, 'current' FROM cur WHERE cluster_id NOT IN (SELECT cluster_id FROM new)""")
def upsert_clusters(spark, sf):
    p = I.actions(spark, sf)

    def counted(rows, version):
        return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("post_count")).withColumn("version", F.lit(version))

    new = p.filter(F.col("created_at") > filters.latest_time(p) - I.one_day())
    return tables.upsert(counted(p, "current"), counted(new, "new"), "cluster_id")


@REG.query("upsert_history", f"""WITH {I.POSTS}
SELECT post_id, full_text, CASE WHEN created_at > {_DAY_AGO.format('posts')} THEN cluster_id ELSE -1 END AS cluster_id FROM posts""")
def upsert_history(spark, sf):
    p = I.posts(spark, sf).select("post_id", "full_text", "cluster_id", "created_at")
    history = p.withColumn("cluster_id", F.lit(-1).cast("bigint"))
    moved = p.filter(F.col("created_at") > filters.latest_time(p) - I.one_day())
    return tables.upsert(history, moved, "post_id").select("post_id", "full_text", "cluster_id")


@REG.query("latest_per_key", f"""WITH {I.ACTIONS}
SELECT post_id, created_at, cluster_id FROM actions
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, post_id DESC) = 1""")
def latest_per_key(spark, sf):
    return trends.latest(I.actions(spark, sf), "cluster_id", ["created_at", "post_id"])


@REG.query("expire_posts", f"""WITH {I.ACTIONS}
SELECT post_id, cluster_id, CASE WHEN created_at < (SELECT max(created_at) FROM actions) - INTERVAL 30 MINUTE
       THEN 'history' ELSE 'recent' END AS place FROM actions""")
def expire_posts(spark, sf):
    """Posts older than two days are archived already, with another cluster; the move replaces them."""
    p = I.actions(spark, sf)
    as_of = filters.latest_time(p)
    history = p.filter(F.col("created_at") < as_of - F.expr("INTERVAL 2 DAYS")).withColumn("cluster_id", F.lit(-1).cast("bigint"))
    kept, archived = retention.expire(p, history, as_of, 30, "created_at")
    return (kept.withColumn("place", F.lit("recent")).unionByName(archived.withColumn("place", F.lit("history")))
            .select("post_id", "cluster_id", "place"))


@REG.query("epoch_reset", f"""WITH {I.ACTIONS},
keyed AS (SELECT post_id, time_bucket(INTERVAL 4 HOUR, created_at) AS epoch FROM actions)
SELECT post_id, epoch, CASE WHEN epoch = (SELECT max(epoch) FROM keyed) THEN 'recent' ELSE 'history' END AS place FROM keyed""")
def epoch_reset(spark, sf):
    p = I.actions(spark, sf)
    current, closed = retention.epoch_reset(p, filters.latest_time(p))
    return (current.withColumn("place", F.lit("recent")).unionByName(closed.withColumn("place", F.lit("history")))
            .select("post_id", "epoch", "place"))


@REG.query("retire_clusters", f"""WITH {I.ACTIONS}, {I.clusters_sql('actions')},
gone AS (SELECT c.cluster_id FROM clusters c LEFT JOIN actions a ON a.cluster_id = c.cluster_id
         AND a.created_at > {_DAY_AGO.format('actions')} GROUP BY 1 HAVING count(a.post_id) < 3)
SELECT c.cluster_id, CASE WHEN g.cluster_id IS NULL THEN c.summary ELSE '' END AS summary,
       CASE WHEN g.cluster_id IS NULL THEN c.post_count ELSE 0 END AS post_count,
       CASE WHEN g.cluster_id IS NULL THEN c.post_rate ELSE 0 END AS post_rate,
       CASE WHEN g.cluster_id IS NULL THEN c.post_count ELSE 0 END AS recent_posts,
       CASE WHEN g.cluster_id IS NULL THEN 0 ELSE c.post_count END AS history_posts
FROM clusters c LEFT JOIN gone g USING (cluster_id)""")
def retire_clusters(spark, sf):
    p = I.actions(spark, sf)
    listed = I.clusters(p)
    idle = trends.inactive(listed, p, filters.latest_time(p) - I.one_day(), 3)
    blanked, recent, history = retention.retire(listed, p, p.filter(F.lit(False)), idle)

    def counted(rows, name):
        return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias(name))

    return (blanked.join(counted(recent, "recent_posts"), "cluster_id", "left")
            .join(counted(history, "history_posts"), "cluster_id", "left").fillna(0, ["recent_posts", "history_posts"]))


@REG.query("reassign_posts", f"""WITH {I.POSTS}
SELECT post_id, CASE WHEN created_at > {_DAY_AGO.format('posts')} THEN cluster_id + 100 ELSE cluster_id END AS cluster_id,
       CASE WHEN created_at > {_DAY_AGO.format('posts')} THEN (SELECT max(created_at) FROM posts) ELSE created_at END AS assignment_time
FROM posts""")
def reassign_posts(spark, sf):
    p = I.posts(spark, sf).select(*_STORED)
    as_of = filters.latest_time(p)
    moved = p.filter(F.col("created_at") > as_of - I.one_day()).select(
        "post_id", (F.col("cluster_id") + 100).alias("cluster_id"), as_of.alias("assignment_time"))
    return retention.reassign(p, moved).select("post_id", "cluster_id", "assignment_time")


@REG.query("update_cluster_fields", f"""WITH {I.ACTIONS}, {I.clusters_sql('actions')},
changes AS (SELECT cluster_id, count(*) AS post_count FROM actions WHERE created_at > {_DAY_AGO.format('actions')} GROUP BY 1)
SELECT c.cluster_id, c.summary, coalesce(n.post_count, c.post_count) AS post_count, c.post_rate
FROM clusters c LEFT JOIN changes n USING (cluster_id)""")
def update_cluster_fields(spark, sf):
    p = I.actions(spark, sf)
    changes = p.filter(F.col("created_at") > filters.latest_time(p) - I.one_day()).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("post_count"))
    return retention.update(I.clusters(p), changes)
