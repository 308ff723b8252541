"""Connected components by contraction, for graphs of any size and any degree."""

from pyspark.sql import DataFrame, functions as F

from trendloom.session import written


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` -> ``node, label``: the smallest node of each node's component, for the nodes that edges name.

    Each round a node goes over to the one of smallest hash among itself and its neighbours, and edges are drawn anew between
    what their ends became; loops and repeated edges fall out. Hashes differ from round to round, so the rest
    shrinks by a constant factor whatever the names and the shape, and all rounds together join about as many rows as the first. Minima
    combine on the map side, whatever a node's degree. At last the steps are put together from the last to the first.
    No edges give no rows.
    """
    named = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a").isNotNull()).distinct(), "edges")
    steps, graph = [], named.where(F.col("a") != F.col("b"))
    while not graph.isEmpty():
        def order(node: str):
            return F.struct(F.xxhash64(F.lit(len(steps)), node), F.col(node).alias("to"))  # noqa: B023

        both = graph.union(graph.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("_near"))
        step = written(near.select("node", F.least("_near", order("node"))["to"].alias("to")), "step")
        for end in ("a", "b"):
            graph = graph.join(step.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        graph = graph.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
        graph = written(graph.distinct(), "contracted")
        steps.append(step)
    nodes = named.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if not steps:
        return nodes.select("node", F.col("node").alias("label"))
    roots = steps.pop()
    while steps:
        after = roots.select(F.col("node").alias("to"), F.col("to").alias("_root"))
        roots = steps.pop().join(after, "to", "left").select("node", F.coalesce("_root", "to").alias("to"))
    roots = written(nodes.join(roots, "node", "left").select("node", F.coalesce("to", "node").alias("root")), "roots")
    smallest = roots.groupBy("root").agg(F.min("node").alias("label"))
    return written(roots.join(smallest, "root").select("node", "label"), "labels")
