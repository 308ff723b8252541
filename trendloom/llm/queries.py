"""The operators over the given tables, next to the SQL that must give the same rows where SQL can express them."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from trendloom.llm import (bpe, decontaminate, divergence, fingerprint, forest, idfiles, linededup, mixing, perplexity, pii, sourceaudit,
                           toolcalls, vantage)
from trendloom.llm.common import documents, table
from trendloom.plans.registry import Registry

REG = Registry()

FINGERPRINT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
p AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM t),
e AS (SELECT doc_id, 'o' AS which, text FROM t
      UNION ALL SELECT doc_id, 'e', substr(text, 1, n - n // 2) || substr(following, 1, n // 2) FROM p),
s AS (SELECT doc_id, which, unnest(string_split(text, chr(10) || chr(10))) AS section,
             generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS si FROM e),
q AS (SELECT doc_id, which, si, unnest(string_split(section, chr(10))) AS paragraph,
             generate_subscripts(string_split(section, chr(10)), 1) AS pi FROM s),
l AS (SELECT doc_id, which, si, pi, list_transform(regexp_extract_all(paragraph,
        '[^.!?;:,]{1,64}(?:[.!?;:,]+[\x20\x09]*)?|[.!?;:,]+[\x20\x09]*'), lambda x: sha256(x)) AS leaves FROM q),
ph AS (SELECT *, sha256('p' || array_to_string(leaves, ',')) AS ph FROM l),
sh AS (SELECT doc_id, which, si, sha256('s' || string_agg(ph, ',' ORDER BY pi)) AS sh,
         string_agg(array_to_string(list_prepend(ph[1:10], list_transform(leaves, lambda x: x[1:10])), ','), ';' ORDER BY pi) AS body
       FROM ph GROUP BY ALL),
f AS (SELECT doc_id, which, sha256('r' || string_agg(sh, ',' ORDER BY si)) || '|'
         || string_agg(sh[1:10] || ':' || body, '|' ORDER BY si) AS mark FROM sh GROUP BY ALL),
w AS (SELECT t.doc_id, t.n AS n_chars, sha256(ed.text) AS edited_sha256, o.mark AS fingerprint, x.mark AS edited_fingerprint,
        coalesce(lead(o.mark) OVER (ORDER BY t.doc_id), first_value(o.mark) OVER (ORDER BY t.doc_id)) AS next_mark
      FROM t JOIN e ed ON ed.doc_id = t.doc_id AND ed.which = 'e'
      JOIN f o ON o.doc_id = t.doc_id AND o.which = 'o' JOIN f x ON x.doc_id = t.doc_id AND x.which = 'e'),
k AS (SELECT *, list_distinct(list_transform(regexp_split_to_array(fingerprint, '[|:;,]'), lambda x: x[1:10])) AS a,
        list_distinct(list_transform(regexp_split_to_array(edited_fingerprint, '[|:;,]'), lambda x: x[1:10])) AS b,
        list_distinct(list_transform(regexp_split_to_array(next_mark, '[|:;,]'), lambda x: x[1:10])) AS c FROM w)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END AS near_edited,
  CASE WHEN fingerprint = next_mark THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, c)) / (len(a) + len(c)) END AS near_next
FROM k
"""


@REG.query("op1_document_fingerprints", FINGERPRINT_SQL)
def op1_document_fingerprints(spark, sf_dir):
    """Merkle fingerprints of every text and of its edited text, with their likeness."""
    return fingerprint.edit_fingerprints(documents(spark, sf_dir))


LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@REG.query("op6_line_dedup", LINE_DEDUP_SQL)
def op6_line_dedup(spark, sf_dir):
    """Lines of 40 code points and more that five documents share stay in the last of them."""
    kept = linededup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


MIXING_SQL = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5(coalesce(text, '')) AS text_md5 FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
        [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS total FROM s),
level(step, clamped, level) AS (
  SELECT 0, -1::BIGINT, 0::DOUBLE
  UNION ALL
  SELECT step + 1, n, CASE WHEN n = clamped OR free = 0 THEN level ELSE (total - full_) / free END FROM (
    SELECT step, clamped, level, total, count(*) FILTER (WHERE weight * level > cap) AS n,
           coalesce(sum(cap) FILTER (WHERE weight * level > cap), 0)::DOUBLE AS full_,
           coalesce(sum(weight) FILTER (WHERE NOT weight * level > cap), 0)::DOUBLE AS free
    FROM level, s, total GROUP BY ALL) WHERE n > clamped),
t AS (SELECT s.*, least(weight * l, cap::DOUBLE) AS target FROM s, (SELECT max_by(level, step) AS l FROM level)),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
o AS (SELECT *, md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, text_md5))) AS ord FROM sized),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o)
SELECT c.doc_id, c.source, size, source_size, target,
       least(whole + CASE WHEN start + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END, 2) AS copies,
       size * least(whole + CASE WHEN start + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END, 2) AS taken
FROM c JOIN w ON c.source IS NOT DISTINCT FROM w.source
"""


@REG.query("op10_source_mixing", MIXING_SQL)
def op10_source_mixing(spark, sf_dir):
    """Sources at weights 5, 2, 1, at 150 % of all words and two epochs at most."""
    return mixing.plan_mix(documents(spark, sf_dir))


@REG.query("op7_bpe")
def op7_bpe(spark, sf_dir):
    """Every text to ids and back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.bpe_decode(bpe.bpe_encode(documents(spark, sf_dir), path), path)
    return bpe.digests(both)


@REG.query("op9_id_files")
def op9_id_files(spark, sf_dir):
    """Ids of every text in files of frequency ranks, as they are read back."""
    return idfiles.id_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257)


@REG.query("op5_distribution_divergence")
def op5_distribution_divergence(spark, sf_dir):
    """Base rules of every text, and its distance from its language's characters and common words."""
    return divergence.quality_rules(documents(spark, sf_dir))


@REG.query("op8_pii")
def op8_pii(spark, sf_dir):
    """Personal data in every text: the base rules' spans and those the trees add."""
    return pii.digests(pii.pii_spans(documents(spark, sf_dir)))


@REG.query("op4_quality_perplexity")
def op4_quality_perplexity(spark, sf_dir):
    """Every text's perplexity under the model of the trusted texts, against its language's threshold."""
    return perplexity.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@REG.query("op3_jaccard_forest")
def op3_jaccard_forest(spark, sf_dir):
    """Classes of texts with five-word shingles in common to 0.8 or more, and each text's links."""
    return forest.near_duplicates(documents(spark, sf_dir))


REG.query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


TOOL_CALLS_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text AS content, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                       (conv_id + turn) % 8 AS w, coalesce(length(conv_id::VARCHAR) || ':' || conv_id, '-:') AS conv FROM conversations),
c AS (SELECT *, conv || turn AS key, turn::VARCHAR AS call_id,
        CASE WHEN w < 3 THEN 'search' WHEN w < 5 THEN 'translate' WHEN w < 7 THEN 'summarise' ELSE 'dance' END AS name,
        CASE WHEN w < 3 THEN '{"limit":' || n || ',"query":' || to_json(text) || '}'
             WHEN w < 5 THEN CASE WHEN n % 5 = 0 THEN '{"text":' || to_json(text) || '}' ELSE '{"target":"en","text":' || to_json(text) || '}' END
             WHEN w < 7 THEN CASE WHEN n % 3 = 0 THEN '{"max_words":"' || n || '","text":' || to_json(text) || '}'
                                  ELSE '{"deep":true,"max_words":' || n || ',"text":' || to_json(text) || '}' END ELSE '{}' END AS args,
        CASE WHEN w < 3 THEN '' WHEN w < 5 THEN CASE WHEN n % 5 = 0 THEN 'missing:target' ELSE '' END
             WHEN w < 7 THEN CASE WHEN n % 3 = 0 THEN 'type:max_words' ELSE 'extra:deep' END ELSE 'unknown_tool' END AS errors,
        CASE WHEN role = 'user' AND turn >= 2 AND n % 4 IN (0, 3) THEN conv || (turn - 2) END AS before,
        CASE WHEN role = 'user' AND n % 4 IN (1, 3) THEN conv || (turn + 2) END AS after,
        count(*) OVER (PARTITION BY conv, turn) AS n_calls, row_number() OVER (PARTITION BY conv, turn ORDER BY text, rid) AS nth
      FROM t WHERE role IS DISTINCT FROM 'assistant'),
one AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY conv) AS conv_calls FROM c WHERE nth = 1 AND turn IS NOT NULL),
r AS (SELECT *, conv || (turn - 1) AS key, (turn - 1)::VARCHAR AS call_id, count(*) OVER (PARTITION BY conv, turn) AS n_results,
        row_number() OVER (PARTITION BY conv, turn ORDER BY content NULLS FIRST, rid) AS nth FROM t WHERE role = 'assistant'),
wanted AS (SELECT key, before AS need FROM one WHERE before IS NOT NULL UNION SELECT key, after FROM one WHERE after IS NOT NULL),
lacking AS (SELECT DISTINCT key FROM wanted WHERE need NOT IN (SELECT key FROM one)),
walk(key, node, steps) AS (
  SELECT key, key, 0 FROM one
  UNION
  SELECT walk.key, need, steps + 1 FROM walk JOIN wanted ON wanted.key = walk.node JOIN one ON one.key = wanted.need WHERE steps < one.conv_calls),
places AS (SELECT walk.key, max(steps) >= any_value(one.conv_calls) AS cyclic, max({'k': one.turn, 'd': steps}) AS place
           FROM walk JOIN one ON one.key = walk.node GROUP BY walk.key),
first_rows AS (SELECT o.conv_id AS call_conv, a.conv_id AS result_conv, coalesce(o.call_id, a.call_id) AS call_id, o.turn AS seq, name, args, errors, a.content,
    CASE WHEN n_calls IS NULL THEN 'orphan_result' WHEN o.key IN (FROM lacking) THEN 'missing_need' WHEN n_results IS NULL THEN 'no_result' ELSE 'linked' END AS status,
    coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, CASE WHEN NOT cyclic THEN place.k END AS order_key, CASE WHEN NOT cyclic THEN place.d END AS order_depth
  FROM one o FULL JOIN (FROM r WHERE nth = 1 AND turn IS NOT NULL) a ON a.key = o.key LEFT JOIN places p ON p.key = o.key),
every AS (SELECT coalesce(call_conv, result_conv) AS conv_id, call_id, seq, name, status, errors, n_calls, n_results, order_key, order_depth, args, content FROM first_rows
  UNION ALL SELECT conv_id, call_id, turn, name, CASE WHEN turn IS NULL THEN 'no_id' ELSE 'duplicate_call' END, errors, 1, 0, NULL, NULL, args, NULL
    FROM c WHERE nth > 1 OR turn IS NULL
  UNION ALL SELECT conv_id, call_id, turn, NULL, CASE WHEN turn IS NULL THEN 'no_id' ELSE 'duplicate_result' END, NULL, 0, 1, NULL, NULL, NULL, content
    FROM r WHERE nth > 1 OR turn IS NULL)
SELECT conv_id, call_id, seq, name, status, errors, n_calls, n_results, order_key, order_depth,
  '{"arguments":' || coalesce(args, 'null') || ',"call_id":' || coalesce('"' || call_id || '"', 'null') || ',"name":' || coalesce('"' || name || '"', 'null')
    || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS canonical
FROM every
"""


@REG.query("op2_tool_calls", TOOL_CALLS_SQL)
def op2_tool_calls(spark, sf_dir):
    """All turns of all conversations read as tool calls and results: linked, ordered, checked and in canonical JSON."""
    calls, results = toolcalls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return toolcalls.link_calls(calls, results, toolcalls.TOOLS)


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT * FROM (SELECT vec_id, k, sum((x - c) * (x - c))::BIGINT AS d FROM v JOIN c{r} USING (i) GROUP BY vec_id, k)
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""

    def moved(r: int) -> str:
        return f"""s{r} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM c{r} LEFT JOIN s{r} USING (k, i))"""

    steps = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(rounds))
    return f"""WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
v AS MATERIALIZED (SELECT vec_id, unnest(generate_series(1, 64)) AS i, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM kept ORDER BY k LIMIT {k}),
c0 AS MATERIALIZED (SELECT k, i, x AS c FROM first JOIN v USING (vec_id)),
{steps},
{assigned(rounds)},
inertia AS (SELECT k, sum(d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY k),
marks AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a{rounds}) AS inertia, centroid_sha256
FROM a{rounds} JOIN inertia USING (k) JOIN marks USING (k)"""


@REG.query("op11_centroid_clusters", _clusters_sql())
def op11_centroid_clusters(spark, sf_dir):
    """Every usable embedding with its centroid after five rounds from 40 hashed starts."""
    return vantage.report(*vantage.cluster(table(spark, sf_dir, "embeddings")))


_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
CONTAMINATION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT *, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, l, w, unnest(generate_series(1, len(w) - l + 1)) AS s FROM bl),
grams AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS gram FROM bs),
ds AS (SELECT rid, l, w, unnest(generate_series(1, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM grams) WHERE len(w) >= l),
hits AS (SELECT rid, s, l, item_id FROM (SELECT rid, s, l, array_to_string(w[s:s + l - 1], ' ') AS gram FROM ds) JOIN grams USING (l, gram)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + l - 1)) AS p FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""


@REG.query("op12_decontamination", CONTAMINATION_SQL)
def op12_decontamination(spark, sf_dir):
    """Every document's words that lie in ten consecutive words of a benchmark item, and the items."""
    return decontaminate.digests(decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_ASCII}) AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
cnt AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
n AS MATERIALIZED (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT + coalesce(any_value(v), 0) AS size
      FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN cnt USING (lang, source) LEFT JOIN v ON v.lang = g.lang GROUP BY ALL),
p AS MATERIALIZED (SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // size AS p
      FROM n JOIN kept k ON k.lang = n.lang LEFT JOIN cnt ON cnt.lang = n.lang AND cnt.source = n.source AND cnt.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c) + 1) // (sum(sum(c)) OVER (PARTITION BY lang) + v) AS q FROM cnt JOIN v USING (lang) GROUP BY lang, term, v),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM n a JOIN n b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tops AS (SELECT p.lang, p.source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
WHERE part = 'pair' OR rank <= 200
"""


@REG.query("op13_source_audit", AUDIT_SQL)
def op13_source_audit(spark, sf_dir):
    """Divergence of every two sources of a language, and each source's 200 most excessive terms."""
    return sourceaudit.source_audit(documents(spark, sf_dir))
