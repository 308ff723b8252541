import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.models import keep_first
from trendloom.config import Config
from trendloom.functions import text as X
from trendloom.schema import ENTITIES
from trendloom.session import scratch_dir
from trendloom.sources import tables
from trendloom.sources.posts import read_posts
from trendloom.streaming import windows as W
from trendloom.streaming.ingest import Ingest, ingest_available, post_stream, raw_post_stream
from trendloom.streaming.refresh import Refresher

T0 = datetime(2024, 1, 1, 12)
CFG = Config(track_terms=(), drop_limit=2, summary_min_posts=2)


def record(post_id, text, at, lang="en", **more):
    return {"post_id": str(post_id), "text": text, "full_text": text, "lang": lang, "created_at": at.isoformat(), "is_quote": False, **more}


def add(spark, folder, records):
    """One more file in the watched folder."""
    spark.createDataFrame([(json.dumps(r),) for r in records], "value string").coalesce(1).write.mode("append").text(folder)


def texts(n, kind):
    return [f"{kind} topic number {kind}{i} seen by {kind}user{i} at {kind}gate{i} and {kind}door{i}" for i in range(n)]


def stored(job):
    return {r.post_id: r.preprocessed_text for r in job.posts().collect()}


def run(spark, folder, base, **options):
    return ingest_available(post_stream(read_posts(spark, folder), CFG), base, cfg=CFG, **options)


@pytest.fixture()
def places(spark):
    return scratch_dir(spark, "in"), scratch_dir(spark, "out")


def test_gates_duplicates_and_restart(spark, places):
    folder, base = places
    add(spark, folder, [record(1, "my bag was lost in paris today", T0), record(2, "mein koffer ist weg seit gestern", T0, lang="de"),
                        record(3, "my bag was lost in paris today !", T0 + timedelta(seconds=1)),
                        record(4, "way too short", T0), record(5, "RT @x something", T0, retweeted={
                            "post_id": "50", "text": "the original post about food", "full_text": "the original post about food", "lang": "en",
                            "created_at": T0.isoformat()})])
    job = run(spark, folder, base, retire_inactive=False)
    assert set(stored(job)) == {"1", "50"}
    add(spark, folder, [record(6, "my bag was lost in paris today", T0 + timedelta(minutes=1)), record(1, "an old id with new words here", T0),
                        record(7, "the bag lost in rome yesterday sadly", T0 + timedelta(minutes=2))])
    job = run(spark, folder, base, retire_inactive=False)
    assert set(stored(job)) == {"1", "50", "7"}
    ids = {r.post_id: r.cluster_id for r in job.posts().collect()}
    assert sorted(ids.values()) == [1, 2, 3] or ids["7"] == ids["1"]
    counts = {r.cluster_id: r.post_count for r in job.clusters().collect()}
    assert sum(counts.values()) == 3


def test_replay_of_a_batch_changes_nothing(spark, places):
    folder, base = places
    add(spark, folder, [record(i, t, T0 + timedelta(seconds=i)) for i, t in enumerate(texts(6, "a") + texts(6, "b"))])
    job = run(spark, folder, base, retire_inactive=False)
    before = sorted(map(tuple, job.posts().collect())), sorted(map(tuple, job.clusters().collect()))
    batch = post_stream(read_posts(spark, folder, stream=False), CFG)
    job.commit(batch, 0)
    assert (sorted(map(tuple, job.posts().collect())), sorted(map(tuple, job.clusters().collect()))) == before


def test_unfinished_batch_is_not_seen(spark, places):
    folder, base = places
    add(spark, folder, [record(1, "my bag was lost in paris today", T0)])
    job = run(spark, folder, base)
    job.posts().drop("batch").write.partitionBy("epoch").parquet(f"{base}/posts/batch=7")
    assert job.posts().count() == 1


def test_same_posts_in_one_or_many_batches(spark):
    rows = [record(i, t, T0 + timedelta(minutes=i)) for i, t in enumerate(texts(4, "a") + texts(4, "a") + texts(3, "b"))]
    one, many = scratch_dir(spark, "one"), scratch_dir(spark, "many")
    add(spark, one, rows)
    whole = stored(run(spark, one, scratch_dir(spark, "out"), retire_inactive=False))
    base = scratch_dir(spark, "out")
    for part in (rows[:3], rows[3:6], rows[6:]):
        add(spark, many, part)
        job = run(spark, many, base, retire_inactive=False)
    tokens = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "i int, t string").select(
        "i", X.dedup_tokens(F.col("t")).alias("s")).orderBy("i").collect()
    assert stored(job) == whole and sorted(map(int, whole)) == keep_first([set(r.s) for r in tokens])


def test_late_rows_are_put_aside(spark, places):
    folder, base = places
    add(spark, folder, [record(1, "my bag was lost in paris today", T0)])
    run(spark, folder, base)
    add(spark, folder, [record(2, "a late post from long before that", T0 - timedelta(minutes=11)),
                        record(3, "a slightly late post that still counts", T0 - timedelta(minutes=9))])
    job = run(spark, folder, base)
    assert set(stored(job)) == {"1", "3"}
    assert [r.post_id for r in spark.read.parquet(f"{base}/late").collect()] == ["2"]
    add(spark, folder, [record(4, "nothing but late posts in this one", T0 - timedelta(minutes=30))])
    job = run(spark, folder, base)
    assert set(stored(job)) == {"1", "3"}
    assert sorted(r.post_id for r in spark.read.parquet(f"{base}/late").collect()) == ["2", "4"]


def test_inactive_clusters_retire_and_give_up_their_posts(spark, places):
    folder, base = places
    busy = [f"delay delay delay word{i} thing{i} other{i} more{i}" for i in range(4)]
    add(spark, folder, [record(1, "lost bag bag bag in paris", T0)] + [record(10 + i, t, T0 + timedelta(seconds=i)) for i, t in enumerate(busy[:3])])
    run(spark, folder, base)
    add(spark, folder, [record(20, busy[3], T0 + timedelta(minutes=31))])
    job = run(spark, folder, base)
    retired = {(r.cluster_id, r.post_count, r.summary) for r in job.clusters().filter("post_count = 0").collect()}
    assert retired == {(1, 0, "")}
    assert {r.post_id for r in job.history_posts().collect()} == {"1"}
    assert {r.post_id for r in job.recent_posts().collect()} == {"10", "11", "12", "20"}
    add(spark, folder, [record(30, "lost bag bag bag in paris", T0 + timedelta(minutes=32))])
    job = run(spark, folder, base)
    assert {r.cluster_id for r in job.posts().filter("post_id = '30'").collect()} == {3}


def test_new_epoch_starts_empty(spark, places):
    folder, base = places
    add(spark, folder, [record(1, "my bag was lost in paris today", T0)])
    run(spark, folder, base)
    add(spark, folder, [record(2, "my bag was lost in paris today", T0 + timedelta(hours=5))])
    job = run(spark, folder, base)
    assert set(stored(job)) == {"1", "2"}
    assert [(r.cluster_id, r.post_count) for r in job.clusters().collect()] == [(1, 1)]
    assert {r.post_id for r in job.history_posts().collect()} == {"1"}


def test_lookup_brings_text_and_entities(spark, places):
    folder, base = places
    add(spark, folder, [record(1, "short form of the post text …", T0)])
    statuses = spark.createDataFrame([("1", "@united the full form of $UAL text", ([("UAL",)], [("united",)], None, None, None))],
                                     f"post_id string, full_text string, entities {ENTITIES.simpleString()}")
    job = ingest_available(post_stream(read_posts(spark, folder), Config(track_terms=()), statuses), base, cfg=CFG)
    assert stored(job) == {"1": "united the full form of text"}


@pytest.fixture(scope="module")
def actions(spark):
    rows = [(i, T0 + timedelta(seconds=37 * i), i % 3) for i in range(300)]
    folder = scratch_dir(spark, "actions")
    df = spark.createDataFrame(rows, "post_id long, created_at timestamp, cluster_id int")
    df.coalesce(1).write.parquet(folder)
    return df, spark.readStream.schema(df.schema).parquet(folder)


@pytest.mark.parametrize("view", [W.tumbling_rate, W.tumbling_activity, W.epoch_window, W.sliding_recent_counts])
def test_streams_equal_batches_for_closed_windows(actions, view):
    batch, stream = actions
    closed = T0 + timedelta(seconds=37 * 299) - timedelta(minutes=10)
    want = {tuple(r) for r in view(batch).filter(F.col("window_end") <= F.lit(closed)).collect()}
    assert {tuple(r) for r in W.run_available(view(stream), "view").collect()} == want


def test_stream_dedup_over_batches(spark):
    folder, base = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    schema = "post_id string, created_at timestamp"
    for ids in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(i, T0) for i in ids], schema).coalesce(1).write.mode("append").parquet(folder)
        rows = W.run_available(W.stream_dedup(spark.readStream.schema(schema).parquet(folder)), "dedup", base)
    assert sorted(r.post_id for r in rows.collect()) == ["a", "b", "c"]


def test_refresh_pauses_and_resumes(spark):
    folder = scratch_dir(spark, "in")
    spark.range(5).write.parquet(folder)
    view = Refresher(spark.readStream.schema("id long").parquet(folder), lambda s: s.groupBy().agg(F.count("*").alias("n")), seconds=1)
    assert view.resume().pause().read().first().n == 5
    spark.range(3).write.mode("append").parquet(folder)
    assert view.read().first().n == 5
    assert view.resume().pause().read().first().n == 8


def test_tables_of_finished_versions_only(spark, places):
    _, base = places
    job = Ingest(spark, base)
    assert job.posts().count() == 0 and job.clusters().count() == 0 and tables.latest_version(spark, base, "progress") is None


def test_old_originals_unlabelled_posts_and_bad_lines_are_not_lost(spark, places):
    from trendloom.functions.language import train_language_model

    folder, base = places
    labelled = [(t, "en") for t in texts(20, "a")] + [(f"der koffer nummer {i} ist seit gestern weg und keiner weiß wohin", "de") for i in range(20)]
    model = train_language_model(spark.createDataFrame(labelled, "text string, lang string"))
    hour_ago = {"post_id": "50", "text": texts(1, "b")[0], "full_text": texts(1, "b")[0], "lang": None, "created_at": (T0 - timedelta(hours=1)).isoformat()}
    lines = [json.dumps(record(1, texts(1, "c")[0], T0)), json.dumps(record(2, "RT @x something", T0 + timedelta(minutes=1), retweeted=hour_ago)),
             json.dumps(record(3, texts(1, "d")[0], T0, lang=None)), json.dumps(record(4, labelled[-1][0], T0, lang=None)), '{"post_id": "5", "text": "cut o']
    for part in (lines[:1], lines[1:]):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(folder)
        posts, bad = raw_post_stream(spark.readStream.text(folder), CFG, model=model)
        job = Ingest(spark, base, cfg=CFG, retire_inactive=False)
        job.start(posts).awaitTermination()
        job.keep_bad(bad).awaitTermination()
    got = {r.post_id: r for r in job.posts().collect()}
    assert {"1", "3", "50"} <= set(got) and "4" not in got
    assert got["50"].created_at == T0 - timedelta(hours=1) and got["50"].assignment_time == T0 + timedelta(minutes=1)
    assert [(r.value, r.reason) for r in spark.read.parquet(f"{base}/quarantine").collect()] == [(lines[-1], "corrupt")]


def folders(base, table):
    import os
    path = f"{base}/{table}".removeprefix("file:")
    return sorted(n for n in os.listdir(path) if n.startswith("v=")) if os.path.exists(path) else []


def test_state_is_compacted_and_old_versions_go(spark, places, monkeypatch):
    """Many small batches equal one, with every second batch merging the deltas, and neither versions nor scratch tables pile up."""
    import os

    from trendloom import session
    folder, base = places
    rows = [record(i, t, T0 + timedelta(minutes=i)) for i, t in enumerate(texts(3, "a") + texts(3, "a") + texts(2, "b"))]
    whole = scratch_dir(spark, "whole")
    add(spark, whole, rows)
    want = stored(run(spark, whole, scratch_dir(spark, "out"), retire_inactive=False, summaries=False))
    scratch = os.path.join(session.scratch_root(spark).removeprefix("file:"), "trendloom")
    left = []
    for k in range(0, 8, 2):
        add(spark, folder, rows[k:k + 2])
        job = run(spark, folder, base, retire_inactive=False, summaries=False, compact_every=2)
        left.append(len(os.listdir(scratch)))
    assert stored(job) == want
    assert len(set(left)) == 1                                   # no scratch table outlives its batch
    assert len(folders(base, "clusters")) == len(folders(base, "progress")) == 2
    assert all(len(folders(base, t)) <= 3 and len(folders(base, f"{t}-base")) <= 2 for t in ("seen", "token_sets", "token_index", "cluster_terms", "activity"))


def test_batches_do_not_read_stored_texts(spark, places):
    """With the stored texts taken away, the next batch still finds ids, near-duplicates and clusters."""
    folder, base = places
    add(spark, folder, [record(i, t, T0 + timedelta(seconds=i)) for i, t in enumerate(texts(4, "a"))])
    run(spark, folder, base, retire_inactive=False, summaries=False)
    import shutil
    shutil.move(f"{base}/posts".removeprefix("file:"), f"{base}/elsewhere".removeprefix("file:"))
    add(spark, folder, [record(9, texts(4, "a")[1] + " !", T0 + timedelta(minutes=1)), record(2, "an id seen before with other words", T0 + timedelta(minutes=1)),
                        record(10, "something new to be stored here", T0 + timedelta(minutes=1))])
    job = run(spark, folder, base, retire_inactive=False, summaries=False)
    assert set(stored(job)) == {"10"}


def test_restore_without_state(spark, places):
    """Posts are there, all state is gone: expired posts go to the history, the rest is clustered anew, and the stream goes on."""
    import glob
    import shutil

    from trendloom.operators import clustering as C
    folder, base = places
    add(spark, folder, [record(1, "an old story about trains in wales", T0 - timedelta(minutes=40))]
        + [record(10 + i, t, T0 + timedelta(seconds=i)) for i, t in enumerate(texts(3, "a") + texts(3, "b"))])
    job = run(spark, folder, base, retire_inactive=False, summaries=False)
    before = stored(job)
    lost = scratch_dir(spark, "lost").removeprefix("file:")
    for path in glob.glob(f"{base}/*".removeprefix("file:")):
        if not path.endswith(("/posts", "/checkpoint")):
            shutil.move(path, f"{lost}/{path.rsplit('/', 1)[1]}")
    job = Ingest(spark, base, cfg=CFG, retire_inactive=False, summaries=False)
    assert job.state_lost()
    job.restore()
    assert not job.state_lost() and stored(job) == before
    recent = job.recent_posts().select("post_id", "preprocessed_text", "cluster_id", "epoch", F.col("assignment_time").alias("created_at"))
    assert {r.post_id for r in job.history_posts().collect()} == {"1"}
    want = {r.post_id: r.cluster_id for r in C.recluster(recent, "epoch", cfg=CFG)[0].collect()}
    assert {r.post_id: r.cluster_id for r in recent.collect()} == want and len(want) == 6
    counts = {r.cluster_id: r.post_count for r in job.clusters().collect()}
    assert counts == {c: list(want.values()).count(c) for c in want.values()}
    add(spark, folder, [record(30, texts(3, "a")[0] + " !", T0 + timedelta(minutes=1)), record(31, "a wholly new story to tell here", T0 + timedelta(minutes=1))])
    job = run(spark, folder, base, retire_inactive=False, summaries=False)
    assert set(stored(job)) == set(before) | {"31"}


def test_clusters_retire_once_when_windows_close(spark, places):
    from trendloom.streaming.activity import ActivityWatch
    _, base = places
    at = lambda half_hours: T0 + timedelta(minutes=30 * half_hours)
    closed = [[(0, "a", 3), (0, "b", 1), (1, "a", 2)], [(2, "a", 5), (2, "c", 2)], [(5, "c", 4)]]
    frames = [spark.createDataFrame([(at(w), at(w + 1), c, n) for w, c, n in rows], "window_start timestamp, window_end timestamp, cluster_id string, n long") for rows in closed]
    watch = ActivityWatch(spark, base, limit=2)

    def got():
        return {(r.cluster_id, r.post_count, r.retired_at) for r in watch.clusters().collect()}

    watch.commit(frames[0], 0)
    assert got() == {("a", 5, None), ("b", 0, at(1))}
    for _ in range(2):                       # a replay changes nothing
        watch.commit(frames[1], 1)
        assert got() == {("a", 10, None), ("b", 0, at(1)), ("c", 2, None)}
    watch.commit(frames[2].limit(0), 2)
    watch.commit(frames[2], 3)               # two windows without any post lie between
    assert got() == {("a", 0, at(4)), ("b", 0, at(1)), ("c", 0, at(4))}
