"""Counts, rates and overviews over clustered posts."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from trendloom.functions import text as X
from trendloom.operators import filters


# --- joins ---

def enrich(df: DataFrame, statuses: DataFrame, key: str = "post_id") -> DataFrame:
    """Look up the extended record. Catalyst broadcasts ``statuses`` only if its size is below the threshold."""
    return df.join(statuses, key, "left")


def overview(clusters: DataFrame, counts: DataFrame, override: bool = True) -> DataFrame:
    """Cluster list; with ``override`` the recent count replaces the stored total where there is one."""
    listed = filters.assigned_only(clusters)
    if not override:
        return listed.withColumn("shown_count", F.col("post_count"))
    joined = listed.join(counts.select("cluster_id", "points"), "cluster_id", "left")
    return joined.withColumn("shown_count", F.coalesce("points", "post_count")).drop("points")


def detail(clusters: DataFrame, posts: DataFrame, cluster_id) -> DataFrame:
    """Posts of one cluster with its summary. Both sides are filtered before they meet."""
    head = filters.of_cluster(clusters, cluster_id).select("cluster_id", "summary")
    body = filters.post_record(filters.of_cluster(posts, cluster_id))
    return body.join(head, "cluster_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def touched(posts: DataFrame, batch: DataFrame, key="cluster_id") -> DataFrame:
    """Posts of the clusters that received something in ``batch``."""
    keys = [key] if isinstance(key, str) else list(key)
    return posts.join(batch.select(*keys).distinct(), keys, "left_semi")


# --- aggregates ---

def recent_counts(posts: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    return filters.recent(posts, as_of, minutes).groupBy("cluster_id").agg(F.count("post_id").alias("points"))


def update_counts(stats: DataFrame, batch: DataFrame) -> DataFrame:
    """Running counts after a batch; the batch is counted before it meets the state."""
    added = batch.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return stats.select("cluster_id", "n").unionByName(added).groupBy("cluster_id").agg(F.sum("n").alias("n"))


def inactive(clusters: DataFrame, posts: DataFrame, since: Column, limit: int = 50) -> DataFrame:
    """Clusters with fewer than ``limit`` posts after ``since``, those without any included."""
    counted = posts.filter(F.col("created_at") > since).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    joined = clusters.select("cluster_id").join(counted, "cluster_id", "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))).filter(F.col("n") < limit)


def cluster_text(posts: DataFrame, text: str = "preprocessed_text") -> DataFrame:
    """The text of a cluster as ordered lines, each ending in a period.

    The lines stay rows: reading them by (cluster_id, created_at, post_id) gives the text, however big the cluster.
    """
    return posts.select("cluster_id", "created_at", "post_id", X.end_with_period(F.col(text)).alias("line"))


def term_freq(posts: DataFrame, cluster_id=None, text: str = "preprocessed_text") -> DataFrame:
    chosen = posts if cluster_id is None else filters.of_cluster(posts, cluster_id)
    exploded = chosen.select("cluster_id", F.explode(X.words(F.col(text))).alias("term"))
    return exploded.groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("freq"))


def eligible(posts: DataFrame, n: int = 20) -> DataFrame:
    """Clusters with more than ``n`` posts."""
    return posts.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("posts")).filter(F.col("posts") > n)


def with_summaries(clusters: DataFrame, summaries: DataFrame) -> DataFrame:
    """Clusters without a summary get an empty one."""
    joined = clusters.drop("summary").join(summaries.select("cluster_id", "summary"), "cluster_id", "left")
    return joined.withColumn("summary", F.coalesce("summary", F.lit("")))


# --- rates ---

def counts_per_tick(posts: DataFrame, minutes: int = 1, time: str = "created_at") -> DataFrame:
    """Posts per cluster and tick, and the running total. Only these counts enter the window, never the posts."""
    per_tick = (posts.groupBy(F.window(time, f"{int(minutes)} minutes").alias("w"), "cluster_id")
                .agg(F.count(F.lit(1)).alias("added"))
                .select("cluster_id", F.col("w.start").alias("tick"), "added"))
    order = Window.partitionBy("cluster_id").orderBy("tick")
    return per_tick.withColumn("n", F.sum("added").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def rate(ticks: DataFrame) -> DataFrame:
    """Count now minus count at the previous tick (0 before the first)."""
    order = Window.partitionBy("cluster_id").orderBy("tick")
    return ticks.withColumn("rate", F.col("n") - F.coalesce(F.lag("n").over(order), F.lit(0)))


def cluster_rate(posts: DataFrame, minutes: int = 1, time: str = "created_at") -> DataFrame:
    return rate(counts_per_tick(posts, minutes, time)).select("cluster_id", "tick", "n", "rate")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key; ``max_by`` combines on the map side, so a hot key does not meet in one task."""
    picked = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return picked.select("r.*")


# --- overviews ---

def recent_top(posts: DataFrame, as_of: Column, k: int = 10, minutes: int = 30) -> DataFrame:
    return recent_counts(posts, as_of, minutes).orderBy(F.desc("points"), "cluster_id").limit(k)


def recent_overview(clusters: DataFrame, posts: DataFrame, as_of: Column, override: bool = True, minutes: int = 30) -> DataFrame:
    """All clusters, ordered by stored total even where the recent count is shown."""
    shown = overview(clusters, recent_counts(posts, as_of, minutes), override)
    return (shown.orderBy(F.desc("post_count"), "cluster_id")
            .select("cluster_id", "summary", "shown_count", "post_rate"))


def full_overview(clusters: DataFrame, k: int | None = 10) -> DataFrame:
    """Stored totals; the ``k`` biggest clusters with their summary, or all with ``k=None``."""
    ordered = (filters.assigned_only(clusters).orderBy(F.desc("post_count"), "cluster_id")
               .select("cluster_id", "summary", "post_count", "post_rate"))
    return ordered if k is None else ordered.limit(k)


def word_sample(posts: DataFrame, cluster_id, n: int = 1000, seed: int = 0, text: str = "preprocessed_text") -> DataFrame:
    """Random word occurrences of one cluster. Hash order makes reruns agree; the top-n runs per partition first."""
    words = (filters.of_cluster(posts, cluster_id)
             .select("post_id", F.posexplode(X.words(F.col(text))).alias("pos", "word")))
    key = F.md5(F.concat_ws("|", F.col("post_id").cast("string"), F.col("pos").cast("string"), F.lit(str(seed))))
    return words.orderBy(key, "post_id", "pos").limit(n)


def preview(df: DataFrame, n: int, order: list, more_over: int = 15) -> DataFrame:
    """First ``n`` rows, and whether the whole list is longer than ``more_over``."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(n).withColumn("has_more", total > more_over)
