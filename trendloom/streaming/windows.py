"""Windowed and stateful streams; every function also works on a batch DataFrame.

Window counts come out when the watermark has passed the end of the window.
"""

from pyspark.sql import DataFrame, functions as F

from trendloom.session import scratch_dir


def minute_counts(posts: DataFrame, minutes: int = 1, late_minutes: int = 10, time: str = "created_at") -> DataFrame:
    """Posts per cluster and tumbling window: the rate, without any further difference."""
    counted = (posts.withWatermark(time, f"{late_minutes} minutes")
               .groupBy(F.window(time, f"{minutes} minutes"), "cluster_id").agg(F.count(F.lit(1)).alias("n")))
    return counted


def flat(counted: DataFrame) -> DataFrame:
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "cluster_id", "n")


def tumbling_rate(posts: DataFrame, minutes: int = 1, late_minutes: int = 10) -> DataFrame:
    return flat(minute_counts(posts, minutes, late_minutes))


def tumbling_activity(posts: DataFrame, minutes: int = 30, late_minutes: int = 10) -> DataFrame:
    return flat(minute_counts(posts, minutes, late_minutes))


def epoch_window(posts: DataFrame, hours: int = 4, late_minutes: int = 10) -> DataFrame:
    return flat(minute_counts(posts, hours * 60, late_minutes))


def sliding_recent_counts(posts: DataFrame, minutes: int = 30, slide: int = 1, late_minutes: int = 10) -> DataFrame:
    """Posts per cluster in the last ``minutes``, every ``slide`` minutes.

    Posts are first counted per slide, so each meets one window; only those counts go to all the windows they are in.
    """
    per_slide = minute_counts(posts, slide, late_minutes).select(F.window_time("window").alias("t"), "cluster_id", "n")
    return flat(per_slide.groupBy(F.window("t", f"{minutes} minutes", f"{slide} minutes"), "cluster_id")
                .agg(F.sum("n").alias("n")))


def stream_dedup(posts: DataFrame, key: str = "post_id", time: str = "created_at", hours: int = 4) -> DataFrame:
    """First row per key; ids are held for one epoch of event time, so the state stays bounded."""
    return posts.withWatermark(time, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, label: str, base: str | None = None) -> DataFrame:
    """Process everything there is into a parquet table and return it; the same ``base`` continues where it stopped."""
    spark = stream.sparkSession
    base = base or scratch_dir(spark, label)
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
             .option("path", f"{base}/rows").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
