"""Nearest of the centres of dense vectors by cosine distance, without a limit on the distance."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from trendloom.operators.ranking import with_rank
from trendloom.session import written

BLOCK_BYTES = 32 << 20
_PRODUCTS = 1 << 20
_DIGITS = 9


def _directions(df: DataFrame, array: str, dims: int) -> DataFrame:
    """Rows whose vector has ``dims`` finite components and a length, with column ``_unit``."""
    finite = F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    length = F.sqrt(F.aggregate(array, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    usable = df.filter((F.size(array) == dims) & finite & (length > 0) & (length < float("inf")))
    return usable.withColumn("_length", length).withColumn("_unit", F.transform(array, lambda x: x.cast("double") / F.col("_length"))).drop("_length")


def mean_directions(df: DataFrame, key: str, array: str, dims: int) -> DataFrame:
    """(cluster_id, center): the mean of the unit vectors of each ``key``. One sum a component, combined on the map side; nothing is exploded."""
    rows = _directions(df, array, dims)
    means = rows.groupBy(F.col(key).alias("cluster_id")).agg(*[F.avg(F.get("_unit", F.lit(i))).alias(f"_{i}") for i in range(dims)])
    return means.select("cluster_id", F.array(*[f"_{i}" for i in range(dims)]).alias("center"))


def _nearest_in(block, ids: pa.Array, dims: int):
    """Arrow batches (row, unit vector) -> (row, cluster_id, distance) over one broadcast block of centres, the first of the nearest."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = block.value
        step = max(1, _PRODUCTS // len(centers))
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            parts = [np.round(1 - flat[i:i + step] @ centers.T, _DIGITS) for i in range(0, len(flat), step)]
            at = np.concatenate([p.argmin(axis=1) for p in parts] or [np.empty(0, np.int64)])
            distance = np.concatenate([p.min(axis=1) for p in parts] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.take(pa.array(at)), pa.array(distance, pa.float64())], ["_row", "cluster_id", "distance"])
    return scan


def nearest_center(df: DataFrame, key: str, array: str, centers: DataFrame, dims: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(``key``, cluster_id, distance) of the nearest of ``centers`` (cluster_id, center), the lowest id on equal distance, for each row of ``df``.

    Centres are broadcast in blocks of at most ``block_bytes``, numbered by id: one block as a rule. More blocks mean one scan of the vectors each, and
    the best of each row is kept. Vectors and centres without a direction (null, of another size, zero or with components that are not finite) are left out.
    """
    scaled = written(with_rank(_directions(centers, "center", dims).select("cluster_id", F.col("_unit").alias("center")), ["cluster_id"], "_k", 0), "centers")
    number, per_block = scaled.count(), max(1, block_bytes // (8 * dims))
    rows = _directions(df.select(key, array), array, dims).select(F.col(key).alias("_key"), "_unit")
    schema = T.StructType([T.StructField("_row", rows.schema["_key"].dataType), scaled.schema["cluster_id"], T.StructField("distance", T.DoubleType())])

    def against(first: int, left: DataFrame) -> DataFrame:
        table = scaled.filter((F.col("_k") >= first) & (F.col("_k") < first + per_block)).sort("_k").select("cluster_id", "center").toArrow()
        table = table.combine_chunks()
        values = table.column("center").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        block = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(values))
        ids = table.column("cluster_id").combine_chunks()
        schema["_row"].dataType = left.schema["_row"].dataType
        return left.mapInArrow(_nearest_in(block, ids, dims), schema)

    if number == 0:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("_row", key)
    if number <= per_block:
        return against(0, rows.withColumnRenamed("_key", "_row")).withColumnRenamed("_row", key)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "directions")
    found = None
    for first in range(0, number, per_block):
        near = written(against(first, rows.select("_row", "_unit")), "nearest")
        found = near if found is None else found.unionByName(near)
    best = found.groupBy("_row").agg(F.min(F.struct("distance", "cluster_id")).alias("m"))
    return rows.select("_row", F.col("_key").alias(key)).join(best, "_row").select(key, "m.cluster_id", "m.distance")


def dimensions(df: DataFrame, array: str) -> int:
    """The commonest number of components, the smaller on a tie; 1 if there is none."""
    sizes = df.filter(F.size(array) > 0).groupBy(F.size(array).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return sizes.dims if sizes else 1
