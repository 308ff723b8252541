"""Quality classifier: interpolated modified Kneser-Ney over characters, trained on trusted text.

Texts travel packed, by shard. A shard hands on its distinct n-grams with their counts in trusted text; the
counts are summed by n-gram over all shards, and the model is built from them by grouped sums and joins on n-grams, contexts
and suffixes. Log-probabilities go to every task if there are few enough distinct n-grams, which is counted first; else each
shard is joined with those it asked for. What moves is distinct n-grams a shard; their number still grows with the texts.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trendloom.llm.common import text_of
from trendloom.llm.pieces import give_back, short_batches, slices
from trendloom.session import written

START = "\x02"  # stands before the first character; a text's own ones are treated alike
_TABLE = 16_000_000
_SCORED = "doc_id long, lang string, text_hash long, n_chars long, perplexity double, held_out double"


def _shard(column: str, shards: int, instead: str | None = None) -> Column:
    """The shard of an id; rows without one, which are never trusted, are dealt by the column ``instead``."""
    key = F.xxhash64(column)
    key = F.when(F.col(column).isNull(), F.xxhash64(instead)).otherwise(key) if instead else key
    return F.pmod(key, F.lit(shards)).cast("int")


def _held(column: str) -> Column:
    """A quarter of the ids by hash. Thresholds come from its trusted texts, scored without them."""
    return F.coalesce(F.pmod(F.xxhash64(F.lit(4), column), F.lit(4)) == 0, F.lit(False))


def packed(docs: DataFrame, shards: int, chars: int = 8_000_000) -> DataFrame:
    """``shard, blob``: rows ``doc_id, lang, text_hash, held, text`` of one shard, compressed together; a task holds so many characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(tables):
            whole = pa.Table.from_batches(tables)
            order = whole.column("shard").to_numpy()
            for s in np.unique(order):
                part = whole.filter(pa.array(order == s)).drop_columns(["shard"]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], type=pa.int32()), pa.array([sink.getvalue().to_pybytes()])], ["shard", "blob"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= chars:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    rows = docs.select(_shard("doc_id", shards, "text_hash").alias("shard"), "doc_id", "lang", "text_hash", "held", "text")
    return rows.mapInArrow(run, "shard int, blob binary")


def _unpacked(blobs, chars: int = 500_000) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for blob in blobs:
        held.append(pa.ipc.open_stream(blob).read_all().to_pandas())
        size += int(held[-1]["text"].str.len().sum())
        if size >= chars:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _numbered(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes below ``size`` -> their numbers among the distinct ones, and the distinct ones in order."""
    if size > _TABLE:
        distinct, numbers = np.unique(codes, return_inverse=True)
        return numbers.astype(np.int64), distinct
    seen = np.zeros(size, dtype=bool)
    seen[codes] = True
    distinct = np.flatnonzero(seen)
    numbers = np.zeros(size, dtype=np.int32)
    numbers[distinct] = np.arange(len(distinct), dtype=np.int32)
    return numbers[codes].astype(np.int64), distinct


def ngrams(texts: list[str], order: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each character of all texts in turn the number of the n-gram that ends there; the n-grams; each text's length."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    pad = START * (order - 1)
    points = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if not lengths.sum():
        return np.zeros(0, dtype=np.int64), [], lengths
    symbols, alphabet = _numbered(points, 0x110000)
    letters = [chr(c) for c in alphabet]
    base = len(letters)
    numbers, names = symbols, letters
    for _ in range(order - 1):  # the n-gram before this symbol, then the symbol
        numbers, distinct = _numbered(numbers[:-1] * base + symbols[len(symbols) - len(numbers) + 1:], len(names) * base)
        names = [names[d // base] + letters[d % base] for d in distinct.tolist()]
    # Position i of ``numbers`` ends at character i + order - 1; those that end inside a text are wanted.
    starts = np.cumsum(lengths + order - 1) - lengths
    at = np.repeat(starts - (order - 1) - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    used, distinct = _numbered(numbers[at], len(names))  # without n-grams over two texts
    return used, [names[d] for d in distinct.tolist()], lengths


class SortedTable:
    """Log-probabilities by n-gram in flat arrays, which take a sixth of a dict's memory and are given back as a whole."""

    def __init__(self, grams: np.ndarray, *columns: np.ndarray):
        self._grams, self._columns = grams, columns

    def of(self, names: list[str], which: int) -> np.ndarray:
        return self._columns[which][np.searchsorted(self._grams, np.array(names, dtype=self._grams.dtype))]


def _scores(texts: list[str], held: list[bool], known: SortedTable, order: int) -> tuple[list[float | None], list[float | None], list[int]]:
    """Perplexities, null for empty texts; those without the held-out quarter, null for other texts; and lengths."""
    numbers, names, lengths = ngrams(texts, order)
    ends = np.cumsum(lengths).tolist()

    def of(which: int, wanted: list[bool]) -> list[float | None]:
        logp = known.of(names, which)
        sums = np.concatenate([[0.0], np.cumsum(logp[numbers])]) if len(names) else np.zeros(1)
        return [math.exp((sums[e - n] - sums[e]) / n) if n and w else None for e, n, w in zip(ends, lengths.tolist(), wanted)]

    return of(0, [True] * len(texts)), of(1, held), lengths.tolist()


def shard_counts(blobs: DataFrame, trusted: DataFrame, order: int) -> DataFrame:
    """``shard, gram, n, n_part``: a shard's distinct n-grams, their number in trusted texts, which may be 0, and in those not held out."""
    def count(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        good, part, total = set(right["doc_id"].tolist()), set(right["doc_id"][~right["held"]].tolist()), {}
        for docs in _unpacked(left["blob"]):
            numbers, names, lengths = ngrams(docs["text"].tolist(), order)
            found = []
            for ids in (good, part):
                weight = np.repeat(np.array([i in ids for i in docs["doc_id"].tolist()], dtype=float), lengths)
                found.append(np.bincount(numbers, weights=weight, minlength=len(names)).astype(np.int64).tolist())
            for g, n, m in zip(names, *found):
                before = total.get(g, (0, 0))
                total[g] = before[0] + n, before[1] + m
        give_back()
        n = np.array(list(total.values()), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"shard": np.int32(key[0]), "gram": pd.Series(list(total), dtype=object), "n": n[:, 0], "n_part": n[:, 1]})

    return blobs.groupBy("shard").cogroup(trusted.groupBy("shard")).applyInPandas(count, "shard int, gram string, n long, n_part long")


def _level(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts ``gram, n`` of one order -> ``gram, own`` (discounted share) and ``context, weight`` (what is left for shorter ones).

    Discounts are the modified ones from the numbers of n-grams counted once to four times; where a
    number is missing, the simple ones 0.5, 1 and 1.5.
    """
    of = grams.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in range(1, 5)]).first()
    n = [of[f"n{k}"] or 0 for k in range(1, 5)]
    cut = [0.5, 1.0, 1.5]
    if all(n[:3]):
        y = n[0] / (n[0] + 2 * n[1])
        cut = [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]
    discount = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
    rows = grams.withColumn("context", F.expr("left(gram, char_length(gram) - 1)")).withColumn("_cut", discount)
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("_cut").alias("_left")).withColumn("weight", F.col("_left") / F.col("total"))
    own = rows.join(contexts, "context").select("gram", ((F.col("n") - F.col("_cut")) / F.col("total")).alias("own"))
    return own, contexts.select("context", "weight")


def log_probabilities(counts: DataFrame, order: int) -> DataFrame:
    """``gram, logp`` for each n-gram of ``counts`` (``gram, n``), those not in trusted text included."""
    counts = written(counts.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    levels, grams = {}, counts.where(F.col("n") > 0)
    for m in range(order, 0, -1):
        levels[m] = _level(grams)
        # Continuation counts: by how many different characters a shorter n-gram is preceded.
        grams = written(grams.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")), "shorter") if m > 1 else grams
    symbols = counts.select(F.right("gram", F.lit(1))).distinct().count() + 1  # one more for what never occurs
    asked = {order: counts.select("gram")}
    for m in range(order - 1, 0, -1):
        asked[m] = asked[m + 1].select(F.expr("substring(gram, 2)").alias("gram")).distinct()
    shorter = None
    for m in range(1, order + 1):
        own, contexts = levels[m]
        rows = asked[m].withColumn("context", F.expr("left(gram, char_length(gram) - 1)")).withColumn("suffix", F.expr("substring(gram, 2)"))
        rows = rows.join(own, "gram", "left").join(contexts, "context", "left")
        if shorter is None:
            below = F.lit(1.0 / symbols)
        else:
            rows, below = rows.join(shorter.withColumnsRenamed({"gram": "suffix", "p": "below"}), "suffix"), F.col("below")
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * below
        shorter = written(rows.select("gram", p.alias("p")), "probabilities")
    return shorter.select("gram", F.log("p").alias("logp"))


def _score_broadcast(rows: DataFrame, logs: DataFrame, order: int) -> DataFrame:
    """For a table that is small enough to go to every task; texts stay where they are read."""
    found = logs.toPandas()
    grams = found["gram"].to_numpy(dtype=f"<U{order}")  # all of one length, so that no two fall together
    by_gram = np.argsort(grams, kind="stable")
    table = rows.sparkSession.sparkContext.broadcast((grams[by_gram], found["logp"].to_numpy()[by_gram], found["logp_part"].to_numpy()[by_gram]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = SortedTable(*table.value)
        for batch in short_batches(batches):
            texts, held = batch.column(4).to_pylist(), batch.column(3).to_pylist()
            for a, b in slices(texts, 500_000):
                values, apart, lengths = _scores(texts[a:b], held[a:b], known, order)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in range(3)], pa.array(lengths, type=pa.int64()),
                                                  pa.array(values, type=pa.float64()), pa.array(apart, type=pa.float64())], ["doc_id", "lang", "text_hash", "n_chars", "perplexity", "held_out"])
        give_back()

    return rows.select("doc_id", "lang", "text_hash", "held", "text").mapInArrow(score, _SCORED)


def _score_by_shard(blobs: DataFrame, counts: DataFrame, logs: DataFrame, order: int) -> DataFrame:
    """For a table of any size: each shard is joined with the n-grams it has."""
    asked = counts.select("shard", "gram").join(logs, "gram").select("shard", "gram", "logp", "logp_part")

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("gram", key=lambda c: c.to_numpy(dtype=f"<U{order}"))
        known, found = SortedTable(right["gram"].to_numpy(dtype=f"<U{order}"), right["logp"].to_numpy(), right["logp_part"].to_numpy()), [pd.DataFrame({"doc_id": [], "lang": pd.Series(dtype=object), "text_hash": pd.Series(dtype="int64"), "n_chars": [], "perplexity": [], "held_out": []})]
        for part in _unpacked(left["blob"]):
            values, apart, lengths = _scores(part["text"].tolist(), part["held"].tolist(), known, order)
            found.append(pd.DataFrame({"doc_id": part["doc_id"], "lang": part["lang"], "text_hash": part["text_hash"], "n_chars": lengths, "perplexity": values, "held_out": apart}))
        return pd.concat(found, ignore_index=True).astype({"doc_id": "Int64", "text_hash": "int64", "n_chars": "int64", "perplexity": "float64", "held_out": "float64"})

    return blobs.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(score, _SCORED)


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = 4, most_broadcast: int = 1_000_000, id_col: str = "doc_id",
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, lang, text_hash, n_chars, perplexity, held_out`` of each row; ``trusted`` has the ``doc_id`` of the trusted texts.

    ``held_out`` is the perplexity under the trusted texts outside the held-out quarter, for rows inside it. Null or empty text: null perplexity. Without trusted text all characters are alike. If there are at most ``most_broadcast`` distinct
    n-grams they go to every task, else each shard gets its own; results are the same.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ids as longs before anything is hashed, as those of the trusted texts are.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    rows = rows.withColumn("held", _held("doc_id"))
    blobs = packed(rows, shards)
    good = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumns({"shard": _shard("doc_id", shards), "held": _held("doc_id")})
    counts = written(shard_counts(blobs, good, order), "shard-grams")
    whole, part = (log_probabilities(counts.select("gram", F.col(n).alias("n")), order) for n in ("n", "n_part"))
    logs = written(whole.join(part.withColumnRenamed("logp", "logp_part"), "gram"), "log-probabilities")
    if logs.count() <= most_broadcast:
        return _score_broadcast(rows, logs, order)
    return _score_by_shard(blobs, counts, logs, order)


def classify(docs: DataFrame, labels: DataFrame, order: int = 4, quantile: float = 0.99, slack: float = 1.02, min_trusted: int = 20, min_chars: int = 50,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, threshold, kept`` for each row of ``docs``.

    Trusted texts are all those labelled ``quality`` 1. A language's threshold is ``slack`` times the quantile of the perplexities of its trusted texts of
    ``min_chars`` characters or more: those of a quarter under a model without that quarter, as texts that trained the model look better than
    others, or of all if that is higher. A text of ``min_chars`` characters or more above it is rejected. Languages (null is one) with fewer than ``min_trusted`` trusted texts have no threshold and keep all.
    Null or empty texts have no perplexity and are kept. Null ids are never trusted; repeated rows are each judged, and a trusted one counts as
    often as it is there. Empty tables: no rows. Ids must be integers. Other columns are not used.
    """
    return _judged(docs, labels, order, quantile, slack, min_trusted, min_chars, id_col, text_col, lang_col).drop("text_hash")


def kept_rows(docs: DataFrame, labels: DataFrame, order: int = 4, quantile: float = 0.99, slack: float = 1.02, min_trusted: int = 20, min_chars: int = 50,
              id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, each by its own verdict.

    The key of a verdict is id, language and text, so null and repeated ids with other texts do not decide for each other.
    """
    judged = _judged(docs, labels, order, quantile, slack, min_trusted, min_chars, id_col, text_col, lang_col)
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.col("lang").alias("_gone_lang"), F.col("text_hash").alias("_gone_hash"))
    gone = written(gone.distinct(), "rejected")
    # The rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(text_of(text_col)).alias("_hash"))
    same = (rows._hash == gone._gone_hash) & rows._id.eqNullSafe(gone._gone_id) & rows._lang.eqNullSafe(gone._gone_lang)
    return rows.join(gone, same, "left_anti").select("row.*")


def _judged(docs: DataFrame, labels: DataFrame, order: int, quantile: float, slack: float, min_trusted: int, min_chars: int,
            id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """What ``classify`` returns, and ``text_hash``."""
    trusted = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    scored = written(perplexities(docs, trusted, order, id_col=id_col, text_col=text_col, lang_col=lang_col), "perplexities")
    judged = F.col("n_chars") >= min_chars
    limit = lambda c: F.percentile_approx(F.when(judged, F.col(c)), F.lit(quantile), F.lit(10_000))
    own = scored.join(trusted, "doc_id", "left_semi").groupBy("lang").agg(F.greatest(limit("held_out"), limit("perplexity")).alias("_q"), F.count("perplexity").alias("_n"))
    limits = own.where(F.col("_n") >= min_trusted).select(F.col("lang").alias("_lang"), (F.col("_q") * slack).alias("threshold"))
    limits = written(limits, "thresholds")  # one row a language; Catalyst knows the size
    judged = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    return judged.withColumn("kept", F.coalesce((F.col("perplexity") <= F.col("threshold")) | (F.col("n_chars") < min_chars), F.lit(True)))
