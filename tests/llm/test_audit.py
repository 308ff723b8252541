"""Centroid clusters, decontamination, source audit and the whole corpus pipeline against one-by-one versions."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from tests.llm.conftest import LONG
from trendloom.llm import decontaminate, sourceaudit, vantage

# --- centroid clusters

points = st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=60)


@settings(max_examples=60, deadline=None)
@given(points, points, st.integers(1, 5))
def test_tree_finds_the_nearest_and_the_smaller_number(centers, rows, leaf):
    number, distance, _ = vantage.VantageTree(np.array(centers), leaf).nearest(np.array(rows, dtype=np.int64))
    for row, n, d in zip(rows, number, distance):
        assert (d, n) == min((sum((a - b) ** 2 for a, b in zip(row, c)), i) for i, c in enumerate(centers))


def test_tree_leaves_branches_out():
    centers = np.array([[x * 1000 + dx, y * 1000] for x in range(8) for y in range(8) for dx in (0, 3)])
    rows = centers + 1
    _, _, computed = vantage.VantageTree(centers).nearest(rows)
    assert computed < 0.35 * len(rows) * len(centers)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")


def clusters_by_hand(rows, k, rounds):
    kept = [(i, [max(-vantage.LARGEST, min(vantage.LARGEST, math.floor(256 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(centers)]
    return centers, collections.Counter((i, nearest(v)[1], nearest(v)[0]) for i, v in kept)


def test_clusters_of_odd_vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=2).round(2)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [float("nan"), 0.0]), (105, [float("inf"), 0.0]), (None, [0.5, -0.5]), (None, [0.5, -0.5]),
             (7, [0.25, 0.25]), (106, [1e300, -1e300]), (107, [0.0, -0.0]), (107, [0.0, 0.0])]
    centers, want = clusters_by_hand(rows, 7, 3)
    assigned, found = vantage.cluster(vectors(spark, rows), k=7, rounds=3, dims=2)
    assert found.tolist() == centers and collections.Counter(map(tuple, assigned.collect())) == want
    report = vantage.report(assigned, found).collect()
    assert {r.inertia for r in report} == {sum(d * n for (_, _, d), n in want.items())}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest() for r in report)


def test_clusters_of_few_or_no_vectors(spark):
    assigned, found = vantage.cluster(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), k=5, dims=2)
    assert [(r.vec_id, r.cluster, r.distance) for r in assigned.orderBy("vec_id").collect()] == [(1, 0, 0), (2, 0, 0)] and len(found) == 2
    assigned, found = vantage.cluster(vectors(spark, [(1, None)]), k=5, dims=2)
    assert vantage.report(assigned, found).count() == 0


# --- decontamination

def read(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination_by_hand(docs, items, window):
    grams = collections.defaultdict(set)
    for item, text in items:
        w = read(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[i:i + window])].add(item)
    out = collections.Counter()
    for doc_id, text in docs:
        w, hit, found = read(text), set(), set()
        for n in range(1, window + 1):
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in grams[tuple(w[i:i + n])] if x is not None}
        out[doc_id, len(w), len(hit), tuple(sorted(found))] += 1
    return out


ITEMS = [(1, "The quick brown fox jumps, over the lazy dog!"), (10, "quick BROWN fox jumps over a fence"), (2, "É ab"), (2, "brown fox jumps over the"), (3, None), (4, " .,; "),
         (None, "lost words here now"), (5, "ab")]
DOCS = [(1, "Say: the QUICK brown fox jumps over the lazy dog. The end"), (2, None), (3, ""), (None, "é AB"), (None, "lost words here now"), (4, "x ab y É\nab"), (5, "fox jumps over"),
        (5, "fox jumps over"), (5, "the quick brown fox the quick brown fox jumps"), (6, LONG), (7, "K ſ ab")]


def tables(spark, docs=DOCS, items=ITEMS):
    clash = [(i, t, "x", 1, 2) for i, t in docs]
    return (spark.createDataFrame(clash, "doc_id long, text string, gram string, gid int, start int"),
            spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, len string, start int"))


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_contamination_by_hand(spark, block_bytes):
    docs, items = tables(spark)
    found = decontaminate.contamination(docs, items, window=4, block_bytes=block_bytes).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found) == contamination_by_hand(DOCS, ITEMS, 4)
    assert all(sum(s["end"] - s["start"] for s in r.spans) == r.n_hit for r in found)


def test_contamination_of_nothing(spark):
    docs, items = tables(spark)
    assert {(r.n_hit, len(r.item_ids)) for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {(0, 0)}
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_third_of_the_rows_share_id_and_text(spark):
    docs = [(None, "the quick brown fox")] * 300 + [(i, f"clean {i} text of its own") for i in range(600)]
    found = decontaminate.contamination(*tables(spark, docs), window=4).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found) == contamination_by_hand(docs, ITEMS, 4)


def test_spans_and_documents_are_removed(spark):
    docs, items = tables(spark)
    left = {(r.doc_id, r.text) for r in decontaminate.decontaminated(docs, items, "spans", window=4).collect()}
    assert (1, "Say: . The end") in left and (2, None) in left and (3, "") in left and (5, "fox jumps over") in left and (5, "the quick brown fox ") not in left
    assert (4, "x  y ") in left and (6, LONG) in left and (5, "the quick brown fox ".strip()) not in left
    whole = decontaminate.decontaminated(docs, items, "documents", window=4)
    want = collections.Counter({k[0]: 0 for k in contamination_by_hand(DOCS, ITEMS, 4)})
    for (doc_id, _, n_hit, _), n in contamination_by_hand(DOCS, ITEMS, 4).items():
        want[doc_id] += n * (n_hit == 0)
    assert whole.columns == docs.columns and collections.Counter(r.doc_id for r in whole.collect()) == +want


# --- source audit

@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_gallop_finds_common_values(a, b):
    x, y = np.array(sorted(a), dtype=np.int64), np.array(sorted(b), dtype=np.int64)
    i, j = sourceaudit.gallop(x, y)
    assert x[i].tolist() == y[j].tolist() == sorted(a & b)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 8 * 10 ** 15), st.integers(1, 10 ** 14))
def test_share_is_exact(n, more):
    assert int(sourceaudit.share(n, n + more)) == 1 + 10 ** 9 * (n + 1) // (n + more)


def audit_by_hand(docs, least, top):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    counts, spread = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        counts[lang or "", source or ""].update(words)
        spread[lang or ""].update(set(words))
    out = set()
    for (lang, source), own in counts.items():
        kept = [t for t, n in spread[lang].items() if n >= least]
        sums = {s: sum(c[t] for t in kept) for (x, s), c in counts.items() if x == lang}
        p = lambda c, n, t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        pairs = [(sum(f(p(own, sums[source], t), p(counts[lang, s], sums[s], t)) for t in kept), s) for s in sums if s != source]
        whole = sum((c for (x, _), c in counts.items() if x == lang), collections.Counter())
        shares = [(p(own, sums[source], t), p(whole, sum(sums.values()), t), t) for t in kept if own[t]]
        terms = [(f(a, b), t) for a, b, t in shares if a > b]
        for part, rows, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:limit]
            out |= {(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("chunk,block", [(16_384, 16), (3, 2)])
def test_audit_by_hand(spark, chunk, block):
    draw = np.random.default_rng(5)
    words = ["the", "The", "é", "ab1cd", "x_y", "ñandú", "漢字", "K", "zz", "rare", "a-b"]
    docs = [(" ".join(draw.choice(words[:3 + i % 9], size=draw.integers(0, 30))), ["en", "de", None][i % 3], f"s{i * i % 7}") for i in range(60)]
    docs += [(None, "en", "empty"), ("", "en", None), ("only here once", "fr", "a"), ("other", "fr", "b"), (None, None, None), ("lone", "it", "one"), (LONG, "en", "s1"), ("12 34", "es", "x")]
    docs += [("the hot source", "en", "hot")] * 40
    rows = spark.createDataFrame([(t, la, s, 1, "x", 2) for t, la, s in docs], "text string, lang string, source string, n int, term string, chunk int")
    got = [tuple(r) for r in sourceaudit.source_audit(rows, top=4, chunk=chunk, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(docs, 3, 4)


def test_audit_of_nothing(spark):
    assert sourceaudit.source_audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


# --- the pipeline

def pipeline(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_by_hand(spark, tmp_path, make_docs):
    """Good prose, noise the classifier rejects, a line many share, near copies, two sources: what is left is known beforehand."""
    shared = "This very line stands in all of the documents, and stays in one."
    draw = np.random.default_rng(1)
    vocabulary = [f"w{a}{b}" for a, b in itertools.product("aeiou", "bdglmnrst")]
    prose = [" ".join(draw.choice(vocabulary, size=60)) for _ in range(40)]
    rows = [(i, p + ("\n" + shared if i < 8 else ""), "en", "a" if i % 2 else "b", 0) for i, p in enumerate(prose)]
    rows += [(100, prose[20] + " more", "en", "a", 0), (None, prose[21], "en", "b", 0), (101, "#§%&@ " * 60, "en", "a", 0), (102, None, "en", "a", None), (102, "", None, None, 0)]
    labels = [(i, 1, 0) for i in range(40)]
    done = pipeline(spark, tmp_path, make_docs(rows), labels).collect()
    ids = collections.Counter(r.doc_id for r in done)
    assert 101 not in ids and 100 not in ids and 21 not in ids                 # rejected, near copy of 20, copy of the null id's text
    assert set(ids) <= {None, 102, *range(40)} - {21} and max(ids.values()) <= 2
    hashes = {r.doc_id: r.decoded_sha256 for r in done}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in rows[:40] if i >= 8}
    want |= {i: hashlib.sha256(prose[i].encode()).hexdigest() for i in range(7)} | {7: hashlib.sha256(rows[7][1].encode()).hexdigest()}
    assert all(hashes[i] == want[i] for i in hashes if i in want)
    words = lambda rs: sum(60 for r in rs if r.doc_id != 102)
    assert words(done) == pytest.approx(1.5 * 60 * 40, rel=0.1)               # 150 % of what reached the mix


def test_pipeline_of_odd_and_no_rows(spark, tmp_path, odd, none):
    done = pipeline(spark, tmp_path / "odd", odd, [(1, 1, 0), (4, 0, 0), (99, 1, 0)])
    assert done.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(done.columns)
    assert pipeline(spark, tmp_path / "none", none, []).count() == 0
