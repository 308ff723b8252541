from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trendloom.operators import ranking, trends

T0 = datetime(2024, 1, 1, 12)
POSTS = "post_id int, cluster_id int, created_at timestamp, preprocessed_text string"


def posts(spark, rows):
    return spark.createDataFrame([(i, c, t, x) for i, (c, t, x) in enumerate(rows)], POSTS)


def test_override_and_order(spark):
    clusters = spark.createDataFrame([(1, "a", 100, 1), (2, "b", 200, 1), (None, "c", 300, 1)],
                                     "cluster_id int, summary string, post_count long, post_rate long")
    p = posts(spark, [(1, T0 - timedelta(minutes=m), "x") for m in range(7)])
    shown = trends.recent_overview(clusters, p, F.lit(T0)).collect()
    assert [(r.cluster_id, r.shown_count) for r in shown] == [(2, 200), (1, 7)]
    stored = trends.recent_overview(clusters, p, F.lit(T0), override=False).collect()
    assert [(r.cluster_id, r.shown_count) for r in stored] == [(2, 200), (1, 100)]


def test_top_has_ten_and_table_has_all(spark):
    p = posts(spark, [(c, T0, "x") for c in range(12) for _ in range(c + 1)])
    clusters = p.groupBy("cluster_id").agg(F.lit("").alias("summary"), F.count("*").alias("post_count"), F.lit(0).alias("post_rate"))
    assert [r.cluster_id for r in trends.recent_top(p, F.lit(T0)).collect()] == list(range(11, 1, -1))
    assert trends.full_overview(clusters).count() == 10 and trends.full_overview(clusters, None).count() == 12


def test_rates_are_differences(spark):
    ticks = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 3, 8)], "cluster_id int, tick int, n long")
    assert [r.rate for r in trends.rate(ticks).orderBy("tick").collect()] == [3, 0, 5]


def test_inactive_counts_zero(spark):
    p = posts(spark, [(1, T0, "x")] * 49 + [(2, T0, "x")] * 50 + [(3, T0 - timedelta(hours=1), "x")] * 60)
    clusters = spark.createDataFrame([(1,), (2,), (3,), (4,)], "cluster_id int")
    found = trends.inactive(clusters, p, F.lit(T0 - timedelta(minutes=30)), 50).collect()
    assert sorted((r.cluster_id, r.n) for r in found) == [(1, 49), (3, 0), (4, 0)]


def test_eligible_is_strict(spark):
    p = posts(spark, [(1, T0, "x")] * 20 + [(2, T0, "x")] * 21)
    assert [r.cluster_id for r in trends.eligible(p).collect()] == [2]


def test_word_sample_sizes_and_repeatability(spark):
    p = posts(spark, [(1, T0, " ".join(f"w{i}" for i in range(1500))), (2, T0, "a b a " * 100)])
    first = [tuple(r) for r in trends.word_sample(p, 1, seed=3).collect()]
    assert len(first) == 1000 and first == [tuple(r) for r in trends.word_sample(p.repartition(5), 1, seed=3).collect()]
    assert first != [tuple(r) for r in trends.word_sample(p, 1, seed=4).collect()]
    assert trends.word_sample(p, 2).count() == 300


def test_preview_flag(spark):
    df = spark.range(16)
    assert [(r.id, r.has_more) for r in trends.preview(df, 2, ["id"]).collect()] == [(0, True), (1, True)]
    assert trends.preview(spark.range(15), 10, ["id"]).first().has_more is False


def test_touched_and_detail(spark):
    p = (posts(spark, [(1, T0, "x"), (2, T0, "y"), (1, T0, "z")]).withColumn("full_text", F.col("preprocessed_text"))
         .withColumn("assignment_time", F.col("created_at")))
    assert trends.touched(p, p.filter("post_id = 0")).count() == 2
    clusters = spark.createDataFrame([(1, "sum")], "cluster_id int, summary string")
    assert {(r.post_id, r.summary) for r in trends.detail(clusters, p, 1).collect()} == {(0, "sum"), (2, "sum")}


def test_ranks_are_consecutive_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g")).repartition(13)
    ranked = ranking.with_rank(df, ["v"]).collect()
    assert all(r.seq == r.v + 1 for r in ranked) and len(ranked) == 1000
    for r in ranking.rank_within(df, "g", ["v"]).groupBy("g").agg(
            F.min("rank").alias("a"), F.max("rank").alias("b"), F.countDistinct("rank").alias("d")).collect():
        assert r.a == 1 and r.b == r.d
