"""Clusters retire when a window of activity closes and they had too few posts in it."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from trendloom.session import scratch_scope, written
from trendloom.sources import tables
from trendloom.streaming.windows import tumbling_activity

JUDGED = T.StructType([
    T.StructField("cluster_id", T.StringType()),
    T.StructField("opened", T.TimestampType()),
    T.StructField("post_count", T.LongType()),
    T.StructField("retired_at", T.TimestampType()),
    T.StructField("judged_to", T.TimestampType()),
])


@dataclass
class ActivityWatch:
    """State below ``base``: a version of ``judged`` a batch, one row a cluster.

    Each closed window is judged once: a batch starts from the version before it, so one that is replayed gives the same version again. A
    cluster is judged from the window it opens in; a window in which it has no post counts as 0. Retired clusters keep the end of the window that
    retired them, have no posts, and do not come back. Windows count as closed up to the latest one that the watermark has passed and that has posts.
    """

    spark: SparkSession
    base: str
    limit: int = 50
    minutes: int = 30
    late_minutes: int = 10

    def start(self, posts: DataFrame) -> StreamingQuery:
        closed = tumbling_activity(posts, self.minutes, self.late_minutes)
        writer = closed.writeStream.outputMode("append").foreachBatch(self.commit)
        return writer.option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()

    def clusters(self, before: int | None = None) -> DataFrame:
        return tables.read_version(self.spark, self.base, "judged", JUDGED, before)

    def commit(self, windows: DataFrame, batch_id: int) -> None:
        with scratch_scope(self.spark):
            self._commit(windows, batch_id)
        tables.drop_versions(self.spark, self.base, "judged", batch_id)

    def _commit(self, windows: DataFrame, batch_id: int) -> None:
        rows = written(windows.withColumn("cluster_id", F.col("cluster_id").cast("string")), "closed-windows", spark=self.spark)
        end = rows.agg(F.max("window_end")).first()[0]
        if end is None:
            return
        step = F.expr(f"INTERVAL {self.minutes} MINUTES")
        fresh = rows.groupBy("cluster_id").agg(F.min("window_start").alias("first"), F.sum("n").alias("added"))
        known = self.clusters(batch_id).join(fresh, "cluster_id", "full")
        known = known.withColumn("opened", F.coalesce("opened", "first")).withColumn("_from", F.coalesce("judged_to", "opened"))
        alive = known.filter(F.col("retired_at").isNull() & (F.col("_from") < F.lit(end)))
        due = alive.select("cluster_id", F.explode(F.sequence("_from", F.lit(end) - step, step)).alias("window_start"))
        counted = due.join(rows.select("cluster_id", "window_start", "n"), ["cluster_id", "window_start"], "left")
        idle = F.min(F.when(F.coalesce("n", F.lit(0)) < self.limit, F.col("window_start") + step))
        fallen = counted.groupBy("cluster_id").agg(idle.alias("fell"))
        judged = known.join(fallen, "cluster_id", "left").withColumn("retired_at", F.coalesce("retired_at", "fell"))
        total = F.coalesce("post_count", F.lit(0)) + F.coalesce("added", F.lit(0))
        judged = judged.withColumn("post_count", F.when(F.col("retired_at").isNull(), total).otherwise(F.lit(0))).withColumn("judged_to", F.lit(end))
        tables.write_version(judged.select(*[F.col(f.name).cast(f.dataType) for f in JUDGED.fields]), self.base, "judged", batch_id)
