"""Nearest dense centres, hot keys in the candidate search, entities."""

import html
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.operators import dense, neardup, salting
from trendloom.sources import tables


def _brute(vectors, centers):
    out = []
    for key, v in vectors:
        v = np.array(v, float)
        scored = [(round(1 - float(v @ np.array(c) / np.linalg.norm(v) / np.linalg.norm(c)), 9), name) for name, c in centers]
        out.append((key, *min(scored)[::-1]))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [dense.BLOCK_BYTES, 3 * 8 * 4])
def test_nearest_center_by_brute_force(spark, block_bytes):
    draw = random.Random(3)
    vectors = [(i % 50, [draw.uniform(-1, 1) for _ in range(4)]) for i in range(60)]  # ids repeat
    centers = [(f"c{i}", [draw.uniform(-1, 1) for _ in range(4)]) for i in range(8)]
    centers += [("c90", [2 * x for x in centers[0][1]])]  # a tie with c0
    odd = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [0.0] * 4), (904, [1.0, None, 0.0, 0.0]), (905, [1.0, float("nan"), 0.0, 0.0]), (906, [float("inf"), 1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(k, v, "x") for k, v in vectors + odd], "id long, vec array<float>, _row string")
    exact = [(k, [float(np.float32(x)) for x in v]) for k, v in vectors]
    table = spark.createDataFrame(centers + [("zero", [0.0] * 4), ("null", None)], "cluster_id string, center array<double>")
    got = dense.nearest_center(df, "id", "vec", table, 4, block_bytes).collect()
    want = _brute(exact, centers)
    assert sorted((r.id, r.cluster_id) for r in got) == [w[:2] for w in want]
    assert np.allclose(sorted(r.distance for r in got), sorted(w[2] for w in want), atol=1e-8)


def test_no_vectors_or_centers(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<float>")
    none = spark.createDataFrame([], "cluster_id string, center array<double>")
    some = spark.createDataFrame([("a", [1.0, 1.0])], none.schema)
    assert dense.nearest_center(df, "id", "vec", none, 2).collect() == [] == dense.nearest_center(df.limit(0), "id", "vec", some, 2).collect()
    assert dense.dimensions(df, "vec") == 2 and dense.dimensions(df.limit(0), "vec") == 1


def test_mean_directions(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [0.0, 2.0]), ("a", [0.0, 0.0]), (None, [1.0, 0.0])], "label string, vec array<float>")
    got = {r.cluster_id: r.center for r in dense.mean_directions(df, "label", "vec", 2).collect()}
    assert np.allclose(got["a"], [0.3, 0.9]) and got[None] == [1.0, 0.0]


def test_hot_text_meets_the_same_candidates(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    old = spark.createDataFrame([(i, " ".join(draw.sample(words, 8))) for i in range(30)], "post_id long, preprocessed_text string")
    hot = old.first().preprocessed_text
    new = spark.createDataFrame([(100 + i, hot if i % 3 == 0 else " ".join(draw.sample(words, 8))) for i in range(60)] + [(200, None), (201, "")], old.schema)
    plain = sorted(neardup.candidates(new, old).collect())
    monkeypatch.setattr(salting, "ROWS_PER_SALT", 4)
    assert sorted(neardup.candidates(new, old).collect()) == plain and len(plain) >= 20


def test_positions_lose_no_pair(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(draw.sample(words, draw.randrange(2, 14))) for _ in range(150)]
    df = spark.createDataFrame([(i, f"2026-01-01 00:{i // 60:02d}:{i % 60:02d}", t) for i, t in enumerate(texts)], "post_id long, created_at string, preprocessed_text string")
    df = df.withColumn("created_at", F.col("created_at").cast("timestamp"))
    sets, kept = [set(t.split()) for t in texts], []
    for i, s in enumerate(sets):
        if not any(100 * len(s & sets[k]) >= 55 * len(s | sets[k]) for k in kept):
            kept.append(i)
    assert sorted(r.post_id for r in neardup.drop_near_dups(df).collect()) == kept and len(kept) < 150


def test_entities_as_the_standard_library(spark):
    names = ["&amp;", "&lt", "&notit;", "&ampfoo;", "&am;", "&NotEqualTilde;", "&CounterClockwiseContourIntegral;", "&x;", "&;", "&copy2", "&eacute", "&Eacute;x", "&nbsp;", "&Zopf;", "&ngE;",
             "&ampamp;", "&notinva;", "&thetasymx;", "&a", "&ltlt;", "&frac12345;", "&sup", "&supx", "&é;", "&amp&lt&gt;"]
    df = spark.createDataFrame([(n,) for n in names + ["".join(names)]], "t string")
    assert [r[0] for r in df.select(X.html_unescape(F.col("t"))).collect()] == [html.unescape(n) for n in names + ["".join(names)]]


def test_upsert_by_order_of_arrival(spark):
    new = spark.createDataFrame([(1, "a", 3), (1, "b", 9), (1, "c", 5), (2, "d", 1)], "id long, v string, arrived long")
    got = tables.upsert(new.limit(0), new, "id", ("arrived",))
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "b"), (2, "d")]
