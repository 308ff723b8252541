"""How far the sources of a language diverge in their vocabulary, pair by pair and term by term, in integers only.

Counts by (language, source, term) are reduced in each task before they are shuffled. Kept terms are numbered; a group's counts become arrays sorted by
term number, cut into chunks of numbers, so that no array grows with the vocabulary. A unit of work co-groups the arrays of two blocks of sources over one
chunk and merges each unordered pair sparsely: the shorter array gallops through the longer, which prices the terms of both, of either one,
and counts them; the terms of neither all cost the same and follow from their number. Partial sums add up to the pair's two values.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trendloom.llm.pieces import short_batches
from trendloom.operators.ranking import with_rank
from trendloom.session import written

#: A term is a run of A-Z, a-z and anything beyond ASCII; only A-Z are lower-cased. By bytes, since UTF-8 has none below 128 in other characters.
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000
_HELD = 300_000
_PARTIAL = "lang string, source string, term string, n long, docs long"


# --- counting ---

def _partial_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents by (lang, source, term), reduced as far as a task's memory goes; each group also has a row without a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        documents: dict = {}

        def flush():
            rows = [(lang, source, term, n, documents[lang, source][term]) for (lang, source), own in counts.items() for term, n in own.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in counts]
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
            arrays[2] = arrays[2].cast(pa.string())
            counts.clear()
            documents.clear()
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

        held = 0
        for batch in short_batches(batches):
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for group, data in zip(groups, batch.column(2).cast(pa.binary())):
                own, seen = counts.setdefault(group, Counter()), documents.setdefault(group, Counter())
                before = len(own)
                found = Counter(data.as_py().translate(_TERMS).split())
                own.update(found)
                seen.update(found.keys())
                held += len(own) - before
                if held > _HELD:
                    yield flush()
                    held = 0
        yield flush()

    return docs.mapInArrow(run, _PARTIAL)


def counted_terms(docs: DataFrame, least_docs: int = 3, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written (lang, source, term, n, lang_n) of the kept terms a group holds, and (lang, source, total, lang_total, vocabulary) of every group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # Dealt by language and term once: both sums and the join below need no other shuffle.
    dealt = _partial_counts(read).repartition("lang", "term")
    counts = written(dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    groups = written(counts.where(F.col("term").isNull()).select("lang", "source"), "groups")
    by_term = counts.where(F.col("term").isNotNull()).repartition("lang", "term")
    kept = by_term.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs")
    terms = written(by_term.drop("docs").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # A term's rows are its groups, so each term of a language is counted once by the first of them.
    vocabulary = terms.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("lang_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return terms, written(groups.select("lang", "source", zero("total"), zero("lang_total"), zero("vocabulary")), "sized-groups")


# --- prices ---

def share(n: np.ndarray | int, size: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / size), by long division in three steps of a thousand, so that nothing leaves 64 bits."""
    out, rest = np.divmod(np.asarray(n, dtype=np.int64) + 1, np.int64(size))
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, np.int64(size))
        out = out * 1000 + digit
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _share(n: Column, size: Column) -> Column:
    """``share`` as a column: decimals are exact there."""
    return F.expr("1L") + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), size.cast("decimal(20,0)"))


def _price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# --- pairs ---

def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two sorted arrays of distinct values: in ``short`` and in ``long``.

    All values of a stretch of ``short`` start where the stretch's first one belongs; steps double until they pass the value wanted, then halve.
    """
    if not len(short) or not len(long):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    stretch = 16
    low = np.repeat(np.searchsorted(long, short[::stretch]), stretch)[:len(short)].astype(np.int64)
    high, step = low.copy(), 1
    behind = np.flatnonzero(high < len(long))
    behind = behind[long[high[behind]] < short[behind]]
    while len(behind):
        low[behind] = high[behind] + 1
        high[behind] = np.minimum(high[behind] + step, len(long))
        step *= 2
        behind = behind[high[behind] < len(long)]
        behind = behind[long[high[behind]] < short[behind]]
    while True:  # the place is in low..high
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        less = long[middle] < short[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    hit = np.flatnonzero(low < len(long))
    hit = hit[long[low[hit]] == short[hit]]
    return hit, low[hit]


def merge(a: tuple, b: tuple) -> tuple[int, int, int]:
    """Two groups' (term numbers, shares, share of an absent term): price of the first against the second, the other way, and how many terms either holds."""
    if len(a[0]) > len(b[0]):
        back, forth, either = merge(b, a)
        return forth, back, either
    (ids, p, p0), (other, q, q0) = a, b
    i, j = gallop(ids, other)
    only, rest = np.ones(len(ids), dtype=bool), np.ones(len(other), dtype=bool)
    only[i], rest[j] = False, False
    forth = price(p[i], q[j]).sum() + price(p[only], q0).sum() + price(p0, q[rest]).sum()
    back = price(q[j], p[i]).sum() + price(q0, p[only]).sum() + price(q[rest], p0).sum()
    return int(forth), int(back), len(ids) + len(other) - len(i)


_UNIT = ["lang", "chunk", "low", "high"]
_PAIR_SUMS = "lang string, a string, b string, forth long, back long, either long"


def _merged_pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums of all pairs of a source of the left block with a later one of the right block over one chunk."""
    def loaded(rows):
        found = []
        for r in rows.itertuples():
            ids, n = np.asarray(r.ids, dtype=np.int64), np.asarray(r.counts, dtype=np.int64)
            found.append((r.source, (ids, share(n, r.size), share(0, r.size))))
        return found

    if not len(left) or not len(right):
        return pd.DataFrame({c: [] for c in ("lang", "a", "b", "forth", "back", "either")})
    lang, others = left["lang"].iat[0], loaded(right)
    rows = [(lang, a, b, *merge(x, y)) for a, x in loaded(left) for b, y in others if a.encode() < b.encode()]
    return pd.DataFrame(rows, columns=["lang", "a", "b", "forth", "back", "either"])


def pair_values(terms: DataFrame, groups: DataFrame, chunk: int = 16_384, block: int = 16) -> DataFrame:
    """``lang, source, item, value`` of every ordered pair of sources of a language."""
    # Numbers are by language and term, over all languages; a chunk of them may belong to two.
    numbered = with_rank(terms.select("lang", "term").distinct(), ["lang", "term"], "tid")
    placed = terms.select("lang", "source", "term", "n").join(numbered, ["lang", "term"])
    cut = F.floor(F.col("tid") / chunk).cast("int").alias("chunk")
    arrays = placed.select("lang", "source", cut, F.struct("tid", "n").alias("e")).groupBy("lang", "source", "chunk").agg(F.array_sort(F.collect_list("e")).alias("e"))
    place = with_rank(groups, ["lang", "source"], "_nth").withColumn("block", F.floor(F.col("_nth") / block).cast("int"))
    sized = place.withColumn("size", F.col("total") + F.col("vocabulary"))
    # A group also takes part in the chunks it has nothing in: there all terms are the other one's alone.
    chunks = numbered.select("lang", cut).distinct()
    full = sized.select("lang", "source", "block", "size").join(chunks, "lang").join(arrays, ["lang", "source", "chunk"], "left")
    none = F.array().cast("array<bigint>")
    full = written(full.select("lang", "source", "chunk", "block", "size", F.coalesce("e.tid", none).alias("ids"), F.coalesce("e.n", none).alias("counts")), "term-arrays")
    blocks = sized.select("lang", "block").distinct()
    partners = written(blocks.join(blocks.withColumnRenamed("block", "_with"), "lang").where(F.col("block") <= F.col("_with")), "block-pairs")
    left = full.join(partners, ["lang", "block"]).withColumn("low", F.col("block")).withColumn("high", F.col("_with"))
    right = full.withColumnRenamed("block", "_with").join(partners, ["lang", "_with"]).withColumn("low", F.col("block")).withColumn("high", F.col("_with"))
    # Columns under new names for Spark on either side, as both come from one table.
    left, right = (side.select(*[F.col(c).alias(c) for c in (*_UNIT, "source", "size", "ids", "counts")]).groupBy(*_UNIT) for side in (left, right))
    merged = left.cogroup(right).applyInPandas(_merged_pairs, _PAIR_SUMS)
    sums = merged.groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("forth", "back", "either")])
    one = groups.select("lang", F.col("source").alias("a"), "vocabulary", (F.col("total") + F.col("vocabulary")).alias("size_a"))
    two = groups.select("lang", F.col("source").alias("b"), (F.col("total") + F.col("vocabulary")).alias("size_b"))
    pairs = one.join(two, "lang").where(F.col("a") < F.col("b")).join(sums, ["lang", "a", "b"], "left")
    nothing = F.col("vocabulary") - F.coalesce("either", F.lit(0))
    p0, q0 = (F.when(F.col("vocabulary") > 0, _share(F.lit(0), F.col(c))).otherwise(F.lit(1)) for c in ("size_a", "size_b"))
    pairs = pairs.select("lang", "a", "b", (F.coalesce("forth", F.lit(0)) + nothing * _price(p0, q0)).alias("forth"),
                         (F.coalesce("back", F.lit(0)) + nothing * _price(q0, p0)).alias("back"))
    return pairs.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("forth").alias("value")),
                                                 F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("value")))))


# --- terms ---

def term_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the terms that a group uses more than its language does."""
    sized = terms.join(groups, ["lang", "source"])
    p = _share(F.col("n"), F.col("total") + F.col("vocabulary"))
    q = _share(F.col("lang_n"), F.col("lang_total") + F.col("vocabulary"))
    shares = sized.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
    return shares.select("lang", "source", "item", _price(F.col("p"), F.col("q")).alias("value"))


def source_audit(docs: DataFrame, least_docs: int = 3, top: int = 200, chunk: int = 16_384, block: int = 16, lang_col: str = "lang", source_col: str = "source",
                 text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: each source against every other one of its language (part ``pair``, all ranks), and its most excessive
    terms against the language (part ``term``, ranks to ``top``).

    A group's share of a term is 1 + floor(10^9 (n + 1) / (N + V)), V being the terms found in at least ``least_docs`` documents of the language and N the group's
    occurrences of them; a difference costs floor((p - q)^2 / q). Ranks go by value, the larger first, then by item in the order of its bytes.

    Null texts, languages and sources are empty ones, and empty languages and sources are groups like others. Groups without any term, and those of a
    language without kept terms, have pairs too, the latter of value 0. Repeated rows are documents of their own, ids and other columns are not
    used. A lone source has no pair. Empty table: no rows. Occurrences may sum to 9 * 10^15 a language.
    """
    terms, groups = counted_terms(docs, least_docs, lang_col, source_col, text_col)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_values(terms, groups, chunk, block).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    tops = term_values(terms, groups).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.select(columns).unionByName(tops.select(columns))
