"""Short-text trend analytics as Spark jobs."""
