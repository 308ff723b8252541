"""Registered queries for near-duplicates, vectors, clusters, summaries and languages."""

import re

from pyspark.sql import functions as F

from trendloom.functions import language, lexicon as L, minhash as M, text as X
from trendloom.operators import clustering, dense, filters, neardup, retention, summary, trends, vectors
from trendloom.plans import inputs as I
from trendloom.plans.registry import Registry
from trendloom.session import written

REG = Registry()
NUM_PERM, BANDS = 128, 32

_PERM = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(M.permutations(NUM_PERM)))
SIGNATURES = f"""{I.TOKENS},
hashed AS (SELECT post_id, ('0x' || substr(md5(token), 1, 7))::BIGINT AS h FROM tokens),
perm AS (SELECT * FROM (VALUES {_PERM}) p(i, a, b)),
sig AS (SELECT post_id, i, min((a::BIGINT * h + b) % {M.PRIME}) AS v FROM hashed, perm GROUP BY ALL)"""

# All pairs at or above the threshold, later post first, by counting common tokens.
EDGES = f"""{I.TOKENS},
sizes AS (SELECT post_id, count(*) AS n FROM tokens GROUP BY 1),
common AS (SELECT a.post_id AS l, b.post_id AS r, count(*) AS c FROM tokens a JOIN tokens b USING (token)
           WHERE a.post_id <> b.post_id GROUP BY ALL),
alike AS (SELECT l, r, c / (x.n + y.n - c) AS jaccard FROM common JOIN sizes x ON x.post_id = l JOIN sizes y ON y.post_id = r
            WHERE 100 * c >= 55 * (x.n + y.n - c)),
edges AS (SELECT l, r FROM alike JOIN posts p ON p.post_id = l JOIN posts q ON q.post_id = r
          WHERE (q.created_at, r) < (p.created_at, l)),
arrivals AS (SELECT post_id AS id, created_at FROM posts)"""
KEPT = f"{EDGES}, {I.greedy_sql('edges', 'arrivals')}"


@REG.query("minhash_signature", f"""WITH {I.POSTS}, {SIGNATURES}
SELECT post_id, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY i) AS signature FROM sig GROUP BY post_id""")
def minhash_signature(spark, sf):
    # Texts without tokens have no signature; a filter on the signature itself would compute it twice.
    filled = I.posts(spark, sf).filter(F.size(X.dedup_tokens(F.col("preprocessed_text"))) > 0)
    signed = neardup.signatures(filled, NUM_PERM)
    return signed.select("post_id", F.array_join(F.col("signature").cast("array<string>"), " ").alias("signature"))


def _halves(spark, sf):
    """(later posts, kept earlier posts), cut in the middle of the time span. The stored side holds no near-duplicates,
    as in the ingest, so a bucket with many new copies meets few stored posts."""
    p = I.posts(spark, sf)
    seconds = F.unix_micros(F.col("created_at").cast("timestamp"))
    middle = p.select((F.min(seconds) + F.max(seconds)) / 2).scalar()
    kept = neardup.drop_near_dups(p.filter(seconds <= middle))
    return p.filter(seconds > middle), kept.select("post_id", "preprocessed_text")


_CANDIDATES = f"""{KEPT}, {SIGNATURES.removeprefix(I.TOKENS).lstrip(", ")},
bands AS (SELECT post_id, i // {NUM_PERM // BANDS} AS band, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY i) AS bucket FROM sig GROUP BY ALL),
late AS (SELECT post_id, epoch_us(created_at) > (SELECT (min(epoch_us(created_at)) + max(epoch_us(created_at))) / 2 FROM posts) AS late FROM posts),
met AS (SELECT DISTINCT a.post_id, b.post_id AS candidate_id FROM bands a JOIN bands b USING (band, bucket)
        JOIN late x ON x.post_id = a.post_id AND x.late JOIN late y ON y.post_id = b.post_id AND NOT y.late
        WHERE b.post_id NOT IN (FROM dropped)),
scored AS (SELECT m.post_id, m.candidate_id, count(*) FILTER (a.v = b.v) AS equal
           FROM met m JOIN sig a ON a.post_id = m.post_id JOIN sig b ON b.post_id = m.candidate_id AND b.i = a.i GROUP BY ALL),
best AS (SELECT post_id, candidate_id, equal / {NUM_PERM}.0 AS estimate FROM scored
         QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY equal DESC, candidate_id) = 1)"""


@REG.query("near_dup_candidates", f"WITH RECURSIVE {I.POSTS}, {_CANDIDATES} SELECT post_id, candidate_id, estimate::DOUBLE AS estimate FROM best")
def near_dup_candidates(spark, sf):
    """Most similar kept post of the first half of the time span for each post of the second."""
    later, earlier = _halves(spark, sf)
    return neardup.candidates(later, earlier, NUM_PERM, BANDS)


@REG.query("dup_candidate_lookup", f"""WITH RECURSIVE {I.POSTS}, {_CANDIDATES}
SELECT b.post_id, b.candidate_id, t.tokens FROM best b JOIN (
  SELECT post_id, string_agg(token, ' ' ORDER BY token) AS tokens FROM tokens GROUP BY 1) t ON t.post_id = b.candidate_id""")
def dup_candidate_lookup(spark, sf):
    later, earlier = _halves(spark, sf)
    found = neardup.candidates(later, earlier, NUM_PERM, BANDS)
    looked_up = neardup.candidate_text(found, neardup.recent_tokens(earlier))
    return looked_up.select("post_id", "candidate_id", F.array_join(F.array_sort("candidate_tokens"), " ").alias("tokens"))


@REG.query("drop_near_dups", f"WITH RECURSIVE {I.POSTS}, {KEPT} SELECT id AS post_id, created_at FROM arrivals WHERE id NOT IN (FROM dropped)")
def drop_near_dups(spark, sf):
    return neardup.drop_near_dups(I.posts(spark, sf)).select("post_id", "created_at")


@REG.query("jaccard_pairs", f"""WITH RECURSIVE {I.POSTS}, {KEPT}
SELECT l AS post_id, r AS kept_id, round(jaccard, 6) AS jaccard FROM alike WHERE r NOT IN (FROM dropped)""")
def jaccard_pairs(spark, sf):
    """Each post with the kept posts it resembles."""
    p = I.posts(spark, sf)
    kept = neardup.drop_near_dups(p).select("post_id", "created_at", "preprocessed_text")
    return neardup.jaccard_pairs(p, kept).withColumn("jaccard", F.round("jaccard", 6))


@REG.query("hashed_unit_vectors", f"""WITH {I.POSTS}, {I.vectors_sql('posts', L.ENGLISH_STOP_WORDS)}
SELECT post_id, term, tf, round(w, 6) AS w FROM vec""")
def hashed_unit_vectors(spark, sf):
    return vectors.vectors(I.posts(spark, sf)).select("post_id", "term", "tf", F.round("w", 6).alias("w"))


@REG.query("hashed_unit_vectors_ml")
def hashed_unit_vectors_ml(spark, sf):
    """The bounded-vocabulary form; its hash has no SQL twin."""
    return vectors.hashed_vectors(I.posts(spark, sf)).select("post_id", F.col("vector").cast("string").alias("vector"))


_CENTERS = """centers AS (SELECT p.cluster_id, v.term, sum(v.w) AS weight FROM vec v JOIN posts p USING (post_id) GROUP BY ALL),
lengths AS (SELECT cluster_id, sqrt(sum(weight * weight)) AS length FROM centers GROUP BY 1),
dist AS (SELECT v.post_id, c.cluster_id, round(1 - sum(v.w * c.weight / l.length), 9) + 0.0 AS distance
         FROM vec v JOIN centers c USING (term) JOIN lengths l ON l.cluster_id = c.cluster_id GROUP BY ALL)"""


@REG.query("assign_nearest", f"""WITH {I.POSTS}, {I.vectors_sql('posts', L.ENGLISH_STOP_WORDS)}, {_CENTERS},
best AS (SELECT post_id, cluster_id, distance FROM dist WHERE distance < 0.6
         QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY distance, cluster_id) = 1)
SELECT p.post_id, b.cluster_id, round(b.distance, 4) AS distance FROM posts p LEFT JOIN best b USING (post_id)""")
def assign_nearest(spark, sf):
    """All posts against the centroids of the given clusters; a post without a match keeps nulls."""
    p = I.posts(spark, sf)
    rows = written(vectors.packed_vectors(p, ("cluster_id", "post_id")), "packed-vectors")
    centers = vectors.entries(rows).groupBy("cluster_id", "term").agg(F.sum("w").alias("weight"))
    found = vectors.assign_all(vectors.scoped(rows.select("terms", "weights", F.col("post_id").alias("id"))), vectors.scoped(centers)).select(F.col("id").alias("post_id"), "cluster_id", "distance")
    return p.select("post_id").join(found, "post_id", "left").select("post_id", "cluster_id", F.round("distance", 4).alias("distance"))


@REG.query("nearest_centroid_join", """WITH flat AS (
  SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
unit AS (SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM flat),
means AS (SELECT label, i, avg(x) AS x FROM unit GROUP BY ALL),
scaled AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM means),
dist AS (SELECT u.vec_id, s.label AS nearest_label, round(1 - sum(u.x * s.x), 9) AS distance
         FROM unit u JOIN scaled s USING (i) GROUP BY ALL)
SELECT vec_id, nearest_label, round(distance, 4) AS distance FROM dist
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest_label) = 1""")
def nearest_centroid_join(spark, sf):
    """Every embedding against the mean of every label, without a distance limit."""
    e = I.table(spark, sf, "embeddings")
    dims = dense.dimensions(e, "embedding")
    found = dense.nearest_center(e, "vec_id", "embedding", dense.mean_directions(e, "label", "embedding", dims), dims)
    return found.select("vec_id", F.col("cluster_id").alias("nearest_label"), F.round("distance", 4).alias("distance"))


_OPENED = f"""WITH RECURSIVE {I.POSTS}, {I.vectors_sql('posts', L.ENGLISH_STOP_WORDS)},
near AS (SELECT a.post_id AS l, b.post_id AS r, round(1 - sum(a.w * b.w), 9) + 0.0 AS distance
         FROM vec a JOIN vec b USING (term) WHERE a.post_id <> b.post_id GROUP BY ALL HAVING round(1 - sum(a.w * b.w), 9) < 0.6),
edges AS (SELECT l, r, distance FROM near JOIN posts p ON p.post_id = l JOIN posts q ON q.post_id = r
          WHERE (q.created_at, r) < (p.created_at, l)),
arrivals AS (SELECT post_id AS id, created_at FROM posts),
{I.greedy_sql('edges', 'arrivals')},
joined AS (SELECT l, r, distance FROM edges JOIN posts q ON q.post_id = r WHERE l IN (FROM dropped) AND r NOT IN (FROM dropped)
           QUALIFY row_number() OVER (PARTITION BY l ORDER BY distance, q.created_at, r) = 1)"""


@REG.query("open_clusters", f"""{_OPENED}
SELECT a.id AS post_id, coalesce(j.r, a.id) AS leader, round(coalesce(j.distance, 0), 4) + 0.0 AS distance
FROM arrivals a LEFT JOIN joined j ON j.l = a.id""")
def open_clusters(spark, sf):
    """All posts as one batch of unmatched posts."""
    p = I.posts(spark, sf).select("post_id", "created_at", "preprocessed_text")
    ordered = neardup.with_rank(vectors.scoped(p), ["created_at", "post_id"], "id")
    index, _ = clustering.index_vectors(vectors.vectors(ordered, ("scope", "id")).drop("tf"))
    opened, _ = clustering.open_clusters(ordered.select("scope", "id"), index)
    names = ordered.select("id", "post_id")
    return (opened.join(names, "id").join(names.select(F.col("id").alias("leader"), F.col("post_id").alias("_l")), "leader")
            .select("post_id", F.col("_l").alias("leader"), F.round("distance", 4).alias("distance")))


_MERGE_WALK = re.sub(r"\b(linked|steps|walk|dropped)\b", r"\g<1>_again", I.greedy_sql("cluster_edges", "cluster_order"))


@REG.query("merge_passes", f"""{_OPENED},
ids AS (SELECT id AS leader, row_number() OVER (ORDER BY created_at, id) AS cluster_id FROM arrivals WHERE id NOT IN (FROM dropped)),
opened AS MATERIALIZED (SELECT a.id AS post_id, i.cluster_id FROM arrivals a LEFT JOIN joined j ON j.l = a.id JOIN ids i ON i.leader = coalesce(j.r, a.id)),
sums AS (SELECT cluster_id, term, sum(w) AS w FROM opened JOIN vec USING (post_id) GROUP BY ALL),
middles AS MATERIALIZED (SELECT cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id)) AS w FROM sums),
cluster_edges AS MATERIALIZED (SELECT x.cluster_id AS l, y.cluster_id AS r, round(1 - sum(x.w * y.w), 9) + 0.0 AS distance FROM middles x JOIN middles y USING (term)
          WHERE y.cluster_id < x.cluster_id GROUP BY ALL HAVING round(1 - sum(x.w * y.w), 9) < 0.6),
cluster_order AS (SELECT cluster_id AS id, cluster_id AS created_at FROM ids),
{_MERGE_WALK},
moves AS (SELECT l, r FROM cluster_edges WHERE l IN (FROM dropped_again) AND r NOT IN (FROM dropped_again)
          QUALIFY row_number() OVER (PARTITION BY l ORDER BY distance, r) = 1)
SELECT post_id, coalesce(r, cluster_id) AS cluster_id FROM opened LEFT JOIN moves ON l = cluster_id""")
def merge_passes(spark, sf):
    """All posts as one huge batch; then one pass joins clusters whose centroids are close."""
    p = I.posts(spark, sf).select("post_id", "created_at", "preprocessed_text")
    ordered = neardup.with_rank(vectors.scoped(p), ["created_at", "post_id"], "id")
    index, frequency = clustering.index_vectors(vectors.vectors(ordered, ("scope", "id")).drop("tf"))
    assigned, added, stats = clustering.cluster_batch(ordered.select("scope", "id"), index, frequency, None, None)
    merged, _, _ = clustering.merge_opened(assigned, added, None, stats, None, frequency)
    return merged.join(ordered.select("id", "post_id"), "id").select("post_id", "cluster_id")


def _recluster_sql(slices: int = 12) -> str:
    """The slices one after another, each on the centroids that the ones before left."""
    steps = []
    for k in range(slices):
        greedy = re.sub(r"\b(linked|steps|walk|dropped)\b", rf"\g<1>{k}", I.greedy_sql(f"e{k}", f"u{k}"))
        if k:
            steps.append(f"""len{k} AS (SELECT scope, cluster_id, sqrt(sum(weight * weight)) AS length FROM state{k} GROUP BY ALL),
dist{k} AS (SELECT scope, v.post_id, c.cluster_id, round(1 - sum(v.w * c.weight / l.length), 9) + 0.0 AS distance FROM vec v
  JOIN (FROM b WHERE k = {k}) n USING (post_id) JOIN state{k} c USING (scope, term) JOIN len{k} l USING (scope, cluster_id) GROUP BY ALL),
m{k} AS MATERIALIZED (SELECT scope, post_id, cluster_id, distance FROM dist{k} WHERE distance < 0.6
  QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY distance, cluster_id) = 1)""")
        else:
            steps.append("m0 AS (SELECT scope, post_id, 0::BIGINT AS cluster_id, 0.0::DOUBLE AS distance FROM b WHERE false)")
        steps.append(f"""u{k} AS MATERIALIZED (SELECT scope, post_id AS id, created_at FROM b WHERE k = {k} AND post_id NOT IN (SELECT post_id FROM m{k})),
e{k} AS MATERIALIZED (SELECT x.id AS l, y.id AS r, round(1 - sum(p.w * q.w), 9) + 0.0 AS distance FROM u{k} x JOIN vec p ON p.post_id = x.id
  JOIN vec q USING (term) JOIN u{k} y ON y.id = q.post_id WHERE x.scope = y.scope AND (y.created_at, y.id) < (x.created_at, x.id)
  GROUP BY ALL HAVING round(1 - sum(p.w * q.w), 9) < 0.6),
{greedy},
ids{k} AS MATERIALIZED (SELECT scope, id AS leader, coalesce((SELECT max(cluster_id) FROM a{k - 1} o WHERE o.scope = u{k}.scope), 0)
    + row_number() OVER (PARTITION BY scope ORDER BY created_at, id) AS cluster_id FROM u{k} WHERE id NOT IN (FROM dropped{k})),
j{k} AS (SELECT l, r, distance FROM e{k} JOIN u{k} y ON y.id = r WHERE l IN (FROM dropped{k}) AND r NOT IN (FROM dropped{k})
  QUALIFY row_number() OVER (PARTITION BY l ORDER BY distance, y.created_at, r) = 1),
d{k} AS MATERIALIZED (FROM m{k} UNION ALL SELECT scope, leader, cluster_id, 0.0 FROM ids{k}
  UNION ALL SELECT scope, l, cluster_id, distance FROM j{k} JOIN ids{k} ON leader = r),
a{k} AS MATERIALIZED (FROM d{k}{f" UNION ALL FROM a{k - 1}" if k else ""}),
state{k + 1} AS MATERIALIZED (SELECT scope, cluster_id, term, sum(w) AS weight FROM a{k} JOIN vec USING (post_id) GROUP BY ALL)""".replace(
                "coalesce((SELECT max(cluster_id) FROM a-1 o WHERE o.scope = u0.scope), 0)", "0"))
    return rf"""WITH RECURSIVE {I.POSTS}, {I.vectors_sql('posts', L.ENGLISH_STOP_WORDS).replace('vec AS (', 'vec AS MATERIALIZED (')},
b AS MATERIALIZED (SELECT post_id, created_at, scope, ((row_number() OVER (PARTITION BY scope ORDER BY created_at, post_id) - 1) * {slices}) // count(*) OVER (PARTITION BY scope) AS k
  FROM (SELECT *, time_bucket(INTERVAL 4 HOUR, created_at) AS scope FROM posts WHERE len(regexp_extract_all(preprocessed_text, '\S+')) > 3)),
{", ".join(steps)}
SELECT scope AS epoch, post_id, cluster_id, round(distance, 4) + 0.0 AS distance FROM a{slices - 1}"""


@REG.query("recluster", _recluster_sql())
def recluster(spark, sf):
    """All posts, clusters per 4-hour epoch, in batches of a twelfth of the epoch."""
    p = retention.with_epoch(filters.min_words(I.posts(spark, sf), 3, "preprocessed_text"))
    assigned, _, _ = clustering.recluster(p, "epoch")
    return assigned.select(F.col("scope").cast("timestamp_ntz").alias("epoch"), "post_id", "cluster_id", F.round("distance", 4).alias("distance"))


def _summary_sql(min_posts: int, rounds: int = summary.ROUNDS, damping: float = summary.DAMPING) -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in L.ENGLISH_STOP_WORDS)
    steps = ["score0 AS MATERIALIZED (SELECT sid, 1.0::DOUBLE AS score FROM nodes)",
             "lost0 AS MATERIALIZED (SELECT cluster_id, loose::DOUBLE AS lost FROM loose)"]
    for k in range(1, rounds + 1):
        steps += [
            f"y{k} AS MATERIALIZED (SELECT a.cluster_id, a.term, sum(a.a * s.score / n.degree) AS y FROM a "
            f"JOIN nodes n USING (sid) JOIN score{k-1} s USING (sid) WHERE n.degree > 0 GROUP BY ALL)",
            f"z{k} AS MATERIALIZED (SELECT a.sid, sum(a.a * y.y) AS z FROM a JOIN y{k} y USING (cluster_id, term) GROUP BY 1)",
            f"score{k} AS MATERIALIZED (SELECT n.sid, {1 - damping} + {damping} * l.lost / t.total + CASE WHEN n.degree > 0 "
            f"THEN {damping} * (z.z - n.own * s.score / n.degree) ELSE 0 END AS score "
            f"FROM nodes n JOIN totals t USING (cluster_id) JOIN lost{k-1} l USING (cluster_id) JOIN score{k-1} s USING (sid) LEFT JOIN z{k} z USING (sid))",
            f"lost{k} AS MATERIALIZED (SELECT o.cluster_id, o.loose * ({1 - damping} + {damping} * l.lost / t.total) AS lost "
            f"FROM loose o JOIN lost{k-1} l USING (cluster_id) JOIN totals t USING (cluster_id))"]
    return rf"""WITH {I.POSTS},
big AS (SELECT cluster_id FROM posts GROUP BY 1 HAVING count(*) > {min_posts}),
parts AS (SELECT cluster_id, created_at, post_id, unnest(s) AS sentence, unnest(generate_series(1, len(s))) AS pos
          FROM (SELECT *, list_filter(list_transform(regexp_extract_all(preprocessed_text, '[^.!?\n]+[.!?]*'), lambda x: trim(x)),
                                      lambda x: regexp_matches(x, '\S')) AS s FROM posts WHERE cluster_id IN (FROM big))),
sentences AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cluster_id, created_at, post_id, pos) AS sid,
              len(regexp_extract_all(sentence, '\S+')) AS words FROM parts),
totals AS MATERIALIZED (SELECT cluster_id, count(*) AS total FROM sentences GROUP BY 1),
raw AS (SELECT cluster_id, sid, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM sentences),
tf AS (SELECT cluster_id, sid, term, count(*) AS tf FROM raw WHERE term NOT IN ({stops}) GROUP BY ALL),
unit AS (SELECT cluster_id, sid, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY sid)) AS w FROM tf),
df AS (SELECT cluster_id, term, count(*) AS df FROM tf GROUP BY ALL),
a AS MATERIALIZED (SELECT cluster_id, sid, term, w * ln(total / df) AS a FROM unit JOIN df USING (cluster_id, term) JOIN totals USING (cluster_id)
      WHERE df > 1 AND df < total),
col AS (SELECT cluster_id, term, sum(a) AS s FROM a GROUP BY ALL),
ties AS (SELECT sid, sum(a.a * col.s) - sum(a.a * a.a) AS degree, sum(a.a * a.a) AS own FROM a JOIN col USING (cluster_id, term) GROUP BY 1),
nodes AS MATERIALIZED (SELECT s.cluster_id, s.sid, coalesce(t.degree, 0) AS degree, coalesce(t.own, 0) AS own FROM sentences s LEFT JOIN ties t USING (sid)),
loose AS MATERIALIZED (SELECT cluster_id, count(*) FILTER (degree = 0) AS loose FROM nodes GROUP BY 1),
{", ".join(steps)},
ranked AS (SELECT s.cluster_id, s.sid, s.sentence, s.words,
                  row_number() OVER (PARTITION BY s.cluster_id ORDER BY round(r.score, 6) DESC, s.sid) AS k
           FROM sentences s JOIN score{rounds} r USING (sid)),
summed AS (SELECT *, sum(words) OVER (PARTITION BY cluster_id ORDER BY k) AS total FROM ranked)
SELECT c.cluster_id, coalesce(s.summary, '') AS summary FROM (SELECT DISTINCT cluster_id FROM posts) c LEFT JOIN (
  SELECT cluster_id, string_agg(sentence, ' ' ORDER BY sid) AS summary FROM summed
  WHERE k = 1 OR abs(total - 25) <= abs(total - words - 25) GROUP BY cluster_id) s USING (cluster_id)"""


@REG.query("cluster_summary", _summary_sql(20))
def cluster_summary(spark, sf):
    """A summary for every given cluster, empty where it has too few posts."""
    p = I.posts(spark, sf)
    return trends.with_summaries(I.clusters(p), summary.summarize(p)).select("cluster_id", "summary")


@REG.query("detect_language", """WITH rows AS (SELECT doc_id, lang, lower(text) AS t FROM documents),
grams AS (SELECT doc_id, lang, unnest(list_transform(generate_series(1, length(t) - 2), lambda i: substr(t, i, 3))) AS gram FROM rows WHERE length(t) > 2),
own AS MATERIALIZED (SELECT doc_id, gram, count(*) AS c FROM grams GROUP BY ALL),
counts AS MATERIALIZED (SELECT lang, gram, count(*) AS n FROM grams GROUP BY ALL),
langs AS (SELECT r.lang, r.docs, coalesce(g.grams, 0) AS grams, (SELECT count(DISTINCT gram) FROM counts) AS distinct_grams
          FROM (SELECT lang, count(*) AS docs FROM rows GROUP BY 1) r LEFT JOIN (SELECT lang, sum(n) AS grams FROM counts GROUP BY 1) g USING (lang)),
met AS (SELECT doc_id, lang, sum(c * ln(n + 1)) AS own FROM own JOIN counts USING (gram) GROUP BY ALL),
scored AS (SELECT r.doc_id, r.lang, l.lang AS predicted_lang,
             round(ln(docs) - greatest(length(t) - 2, 0) * ln(grams + distinct_grams) + coalesce(own, 0), 6) AS score
           FROM rows r, langs l LEFT JOIN met m ON m.doc_id = r.doc_id AND m.lang = l.lang)
SELECT doc_id, lang, predicted_lang FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, predicted_lang) = 1""")
def detect_language(spark, sf):
    """Counted on the given labels, then applied to every document."""
    d = I.table(spark, sf, "documents").select("doc_id", "text", "lang")
    counts, langs = language.trigram_counts(d)
    found = language.detect_by_counts(d, counts, written(langs, "languages"))
    return d.select("doc_id", "lang").join(found, "doc_id")


@REG.query("detect_language_ml")
def detect_language_ml(spark, sf):
    """The bounded-size ``pyspark.ml`` form, which also labels streams; its hash has no SQL twin."""
    d = I.table(spark, sf, "documents").select("doc_id", "text", "lang")
    rows = written(language.with_features(d).drop("text"), "language-features")
    return language.detect_lang(rows, language.train_language_model(rows)).select("doc_id", "lang", "predicted_lang")
