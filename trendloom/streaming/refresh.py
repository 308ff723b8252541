"""A view that is recomputed on a timer and can be paused and resumed."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trendloom.session import scratch_dir
from trendloom.sources import tables


@dataclass
class Refresher:
    """``view`` turns a stream into the refreshed rows; each refresh is a new version below ``base``, so readers never meet
    a table that is being replaced."""

    stream: DataFrame
    view: Callable[[DataFrame], DataFrame]
    seconds: int = 30
    base: str | None = None
    query: StreamingQuery | None = field(default=None, init=False)

    def __post_init__(self):
        self.spark = self.stream.sparkSession
        self.base = self.base or scratch_dir(self.spark, "refresh")

    def resume(self) -> "Refresher":
        """Start, or go on from the checkpoint after a pause."""
        def replace(rows: DataFrame, batch_id: int) -> None:
            tables.write_version(rows, self.base, "view", batch_id)

        self.query = (self.view(self.stream).writeStream.outputMode("complete").foreachBatch(replace)
                      .option("checkpointLocation", f"{self.base}/checkpoint")
                      .trigger(processingTime=f"{self.seconds} seconds").start())
        return self

    def pause(self) -> "Refresher":
        self.query.processAllAvailable()
        self.query.stop()
        self.query = None
        return self

    def read(self) -> DataFrame:
        newest = tables.latest_version(self.spark, self.base, "view")
        return self.spark.read.parquet(tables.version_path(self.base, "view", newest))
