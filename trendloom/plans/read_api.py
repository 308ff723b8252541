"""Registered queries over given clusters: counts, rates, overviews. Each has its SQL twin next to it."""

from pyspark.sql import functions as F

from trendloom.operators import clustering, filters, ranking, summary, trends, vectors
from trendloom.functions import lexicon as L
from trendloom.plans import inputs as I
from trendloom.plans.registry import Registry

REG = Registry()
AS_OF = "(SELECT max(created_at) FROM {})"


@REG.query("recent_window", f"""WITH {I.POSTS}
SELECT post_id, created_at, cluster_id FROM posts WHERE created_at > {AS_OF.format('posts')} - INTERVAL 30 MINUTE""")
def recent_window(spark, sf):
    p = I.posts(spark, sf)
    return filters.recent(p, filters.latest_time(p)).select("post_id", "created_at", "cluster_id")


@REG.query("cluster_filter", f"WITH {I.POSTS} SELECT post_id, created_at, cluster_id FROM posts WHERE cluster_id = 7")
def cluster_filter(spark, sf):
    return filters.of_cluster(I.posts(spark, sf), 7).select("post_id", "created_at", "cluster_id")


@REG.query("assigned_only", f"""WITH {I.POSTS},
marked AS (SELECT CASE WHEN lang <> 'es' THEN cluster_id END AS cluster_id, created_at FROM posts),
{I.clusters_sql('marked')}
SELECT cluster_id, post_count FROM clusters WHERE cluster_id IS NOT NULL""")
def assigned_only(spark, sf):
    p = I.posts(spark, sf).withColumn("cluster_id", F.when(F.col("lang") != "es", F.col("cluster_id")))
    return filters.assigned_only(I.clusters(p)).select("cluster_id", "post_count")


@REG.query("post_record", f"""WITH {I.POSTS}
SELECT post_id, preprocessed_text, full_text, created_at, cluster_id, assignment_time FROM posts""")
def post_record(spark, sf):
    return filters.post_record(I.posts(spark, sf))


@REG.query("recent_counts", f"""WITH {I.TYPED}
SELECT cluster_id, count(post_id) AS points FROM typed
WHERE created_at > {AS_OF.format('typed')} - INTERVAL 30 MINUTE GROUP BY cluster_id""")
def recent_counts(spark, sf):
    p = I.actions(spark, sf, "event_type")
    return trends.recent_counts(p, filters.latest_time(p))


@REG.query("override_recent_count", f"""WITH {I.ACTIONS}, {I.clusters_sql('actions')},
recent AS (SELECT cluster_id, count(*) AS points FROM actions
           WHERE created_at > {AS_OF.format('actions')} - INTERVAL 30 MINUTE GROUP BY cluster_id)
SELECT c.cluster_id, c.post_count, coalesce(r.points, c.post_count) AS shown_count
FROM clusters c LEFT JOIN recent r USING (cluster_id)""")
def override_recent_count(spark, sf):
    p = I.actions(spark, sf)
    counts = trends.recent_counts(p, filters.latest_time(p))
    return trends.overview(I.clusters(p), counts).select("cluster_id", "post_count", "shown_count")


@REG.query("cluster_detail", f"""WITH {I.POSTS}, {I.clusters_sql('posts')}
SELECT p.post_id, p.preprocessed_text, p.created_at, p.cluster_id, c.summary
FROM posts p JOIN clusters c USING (cluster_id) WHERE p.cluster_id = 7""")
def cluster_detail(spark, sf):
    p = I.posts(spark, sf)
    return trends.detail(I.clusters(p), p, 7).select("post_id", "preprocessed_text", "created_at", "cluster_id", "summary")


@REG.query("touched_clusters", f"""WITH {I.ACTIONS}
SELECT post_id, cluster_id FROM actions WHERE cluster_id IN (
  SELECT cluster_id FROM actions WHERE created_at > {AS_OF.format('actions')} - INTERVAL 1 DAY)""")
def touched_clusters(spark, sf):
    p = I.actions(spark, sf)
    batch = p.filter(F.col("created_at") > filters.latest_time(p) - I.one_day())
    return trends.touched(p, batch).select("post_id", "cluster_id")


@REG.query("cluster_counts", f"WITH {I.ACTIONS} SELECT cluster_id, count(*) AS n FROM actions GROUP BY cluster_id")
def cluster_counts(spark, sf):
    p = I.actions(spark, sf)
    day_ago = filters.latest_time(p) - I.one_day()
    state = p.filter(F.col("created_at") <= day_ago).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return trends.update_counts(state, p.filter(F.col("created_at") > day_ago))


@REG.query("centroid_mean", f"""WITH {I.POSTS}, {I.vectors_sql('posts', L.ENGLISH_STOP_WORDS)}
SELECT p.cluster_id, v.term, round(sum(v.w) / any_value(n.n), 6) AS weight
FROM vec v JOIN posts p USING (post_id)
JOIN (SELECT cluster_id, count(*) AS n FROM posts GROUP BY 1) n ON n.cluster_id = p.cluster_id
GROUP BY p.cluster_id, v.term""")
def centroid_mean(spark, sf):
    p = I.posts(spark, sf)
    rows = vectors.vectors(p, ("cluster_id", "post_id"))
    stats = p.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return vectors.centroids(rows, stats).select("cluster_id", "term", F.round("weight", 6).alias("weight"))


@REG.query("inactive_clusters", f"""WITH {I.ACTIONS}
SELECT c.cluster_id, count(a.post_id) AS n FROM (SELECT DISTINCT cluster_id FROM actions) c
LEFT JOIN actions a ON a.cluster_id = c.cluster_id AND a.created_at > {AS_OF.format('actions')} - INTERVAL 1 DAY
GROUP BY c.cluster_id HAVING count(a.post_id) < 3""")
def inactive_clusters(spark, sf):
    p = I.actions(spark, sf)
    return trends.inactive(I.clusters(p), p, filters.latest_time(p) - I.one_day(), 3)


@REG.query("cluster_text", f"""WITH {I.POSTS}
SELECT cluster_id, created_at, post_id,
       CASE WHEN suffix(preprocessed_text, '.') THEN preprocessed_text ELSE preprocessed_text || '.' END AS line FROM posts""")
def cluster_text(spark, sf):
    return trends.cluster_text(I.posts(spark, sf))


@REG.query("cluster_terms", rf"""WITH {I.POSTS},
words AS (SELECT cluster_id, unnest(regexp_extract_all(preprocessed_text, '\S+')) AS term FROM posts)
SELECT cluster_id, term, count(*) AS freq FROM words GROUP BY ALL""")
def cluster_terms(spark, sf):
    return trends.term_freq(I.posts(spark, sf))


@REG.query("summary_eligible", f"""WITH {I.ACTIONS}, {I.clusters_sql('actions')}
SELECT cluster_id, CASE WHEN post_count > 65 THEN summary ELSE '' END AS summary FROM clusters""")
def summary_eligible(spark, sf):
    p = I.actions(spark, sf)
    listed = I.clusters(p)
    return trends.with_summaries(listed, listed.join(trends.eligible(p, 65), "cluster_id", "left_semi")).select("cluster_id", "summary")


def _rate_sql(source: str, unit: str) -> str:
    return f"""per AS (SELECT cluster_id, date_trunc('{unit}', created_at) AS tick, count(*) AS added FROM {source} GROUP BY ALL),
run AS (SELECT cluster_id, tick, CAST(sum(added) OVER (PARTITION BY cluster_id ORDER BY tick) AS BIGINT) AS n FROM per)
SELECT cluster_id, tick, n, n - coalesce(lag(n) OVER (PARTITION BY cluster_id ORDER BY tick), 0) AS rate FROM run"""


@REG.query("rate_delta", f"WITH {I.ACTIONS}, {_rate_sql('actions', 'hour')}")
def rate_delta(spark, sf):
    return trends.rate(trends.counts_per_tick(I.actions(spark, sf), 60)).select("cluster_id", "tick", "n", "rate")


@REG.query("cluster_rate", f"WITH {I.TYPED}, {_rate_sql('typed', 'minute')}")
def cluster_rate(spark, sf):
    return trends.cluster_rate(I.actions(spark, sf, "event_type"))


@REG.query("allocate_cluster_ids", f"""WITH {I.POSTS}
SELECT post_id, 100 + row_number() OVER (ORDER BY created_at, post_id) AS cluster_id FROM posts""")
def allocate_cluster_ids(spark, sf):
    seeds = I.posts(spark, sf).select("post_id", "created_at")
    return ranking.allocate(seeds, 100, ["created_at", "post_id"]).select("post_id", "cluster_id")


@REG.query("recent_top_clusters", rf"""WITH {I.POSTS}
SELECT cluster_id, count(post_id) AS points FROM posts
WHERE len(regexp_extract_all(full_text, '\S+')) > 3
  AND created_at > (SELECT max(created_at) FROM posts) - INTERVAL 1 DAY
GROUP BY cluster_id ORDER BY points DESC, cluster_id LIMIT 10""")
def recent_top_clusters(spark, sf):
    p = I.posts(spark, sf)
    as_of = filters.latest_time(p)
    gated = filters.min_words(p, 3, "full_text")
    return trends.recent_top(gated, as_of, 10, minutes=24 * 60)


@REG.query("recent_overview", f"""WITH {I.ACTIONS}, {I.clusters_sql('actions')},
recent AS (SELECT cluster_id, count(*) AS points FROM actions
           WHERE created_at > {AS_OF.format('actions')} - INTERVAL 30 MINUTE GROUP BY cluster_id)
SELECT c.cluster_id, c.summary, coalesce(r.points, c.post_count) AS shown_count, c.post_rate
FROM clusters c LEFT JOIN recent r USING (cluster_id) ORDER BY c.post_count DESC, c.cluster_id""")
def recent_overview(spark, sf):
    p = I.actions(spark, sf)
    return trends.recent_overview(I.clusters(p), p, filters.latest_time(p))


@REG.query("recent_overview_as_stored", f"""WITH {I.ACTIONS}, {I.clusters_sql('actions')}
SELECT cluster_id, summary, post_count AS shown_count, post_rate FROM clusters ORDER BY post_count DESC, cluster_id""")
def recent_overview_as_stored(spark, sf):
    p = I.actions(spark, sf)
    return trends.recent_overview(I.clusters(p), p, filters.latest_time(p), override=False)


@REG.query("full_overview", f"""WITH {I.ACTIONS}, {I.clusters_sql('actions')}
SELECT cluster_id, summary, post_count, post_rate FROM clusters ORDER BY post_count DESC, cluster_id LIMIT 10""")
def full_overview(spark, sf):
    return trends.full_overview(I.clusters(I.actions(spark, sf)))


@REG.query("word_sample", rf"""WITH {I.POSTS},
texts AS (SELECT post_id, regexp_extract_all(preprocessed_text, '\S+') AS words FROM posts WHERE cluster_id = 7),
words AS (SELECT post_id, CAST(unnest(generate_series(1, len(words))) - 1 AS INTEGER) AS pos, unnest(words) AS word FROM texts)
SELECT post_id, pos, word FROM words
ORDER BY md5(concat_ws('|', CAST(post_id AS VARCHAR), CAST(pos AS VARCHAR), '11')), post_id, pos LIMIT 1000""")
def word_sample(spark, sf):
    return trends.word_sample(I.posts(spark, sf), 7, 1000, seed=11)


@REG.query("preview_rows", f"""WITH {I.ACTIONS}, {I.clusters_sql('actions')}
SELECT cluster_id, post_count, (SELECT count(*) FROM clusters) > 15 AS has_more FROM clusters
ORDER BY post_count DESC, cluster_id LIMIT 15""")
def preview_rows(spark, sf):
    listed = I.clusters(I.actions(spark, sf)).select("cluster_id", "post_count")
    return trends.preview(listed, 15, [F.desc("post_count"), "cluster_id"])


@REG.query("recent_cluster_detail", f"""WITH {I.POSTS}, {I.clusters_sql('posts')}
SELECT p.post_id, p.preprocessed_text, p.created_at, p.cluster_id, c.summary
FROM posts p JOIN clusters c USING (cluster_id)
WHERE p.cluster_id = 7 AND p.created_at > (SELECT max(created_at) FROM posts WHERE cluster_id = 7) - INTERVAL 30 MINUTE""")
def recent_cluster_detail(spark, sf):
    """Posts of one cluster that are younger than 30 minutes, as of its last post."""
    p = I.posts(spark, sf)
    as_of = filters.latest_time(filters.of_cluster(p, 7))
    return trends.detail(I.clusters(p), filters.recent(p, as_of), 7).select("post_id", "preprocessed_text", "created_at", "cluster_id", "summary")
