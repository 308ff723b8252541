"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from pyspark.sql import DataFrame, Window, functions as F

from trendloom.llm.common import text_of, word_count
from trendloom.operators.ranking import with_rank
from trendloom.session import written

#: Hex digits of the seeded hash that cut a source into parts, so that no source is summed up in one task.
PART_DIGITS = 3


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``source``, ``source_size`` -> with ``weight``: the cycle's values in code point order of the source, null last."""
    ordered = with_rank(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_at", start=0)
    values = F.array(*[F.lit(w) for w in cycle])
    return ordered.withColumn("weight", F.get(values, (F.col("_at") % len(cycle)).cast("int"))).drop("_null", "_at")


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which min(weight * level, cap) sums up to ``total``.

    Sources above their cap are clamped and what they leave is shared anew by weight, until none is above.
    Each step is one small aggregate of the sources; the level only rises, so the clamped set only grows.
    """
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(F.sum(above.cast("long")).alias("n"),
                          F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("full"),
                          F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("free")).first()
        if row.n is None or row.n == clamped or not row.free:
            return level
        clamped, level = row.n, (total - float(row.full)) / float(row.free)


def plan_mix(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    ``share`` of all words is dealt to the sources by weight; no source gives more than ``epochs`` times its words.
    A source gives all its documents as often as fits whole, and for the rest documents in the order of a
    seeded hash of their id, up to the document whose middle passes what is left; so its words miss the target
    by half a document at most. A document is never given more than ``epochs`` times.

    Null source: a source of its own. Null or wordless text: size 0, whatever its copies it takes 0 words. Without an id
    the text is hashed. Repeated rows each count and each get copies of their own. Empty table: no rows. Settings are those of ``_planned``.
    """
    return _planned(docs, **settings).drop("text_hash")


def _planned(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2,
             seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What ``plan_mix`` returns, and ``text_hash``."""
    text = text_of(text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"),
                        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.md5(text)))).alias("_order"))
    sized = written(sized, "mix-sizes").withColumn("_part", F.substring("_order", 1, PART_DIGITS))
    parts = written(sized.groupBy("source", "_part").agg(F.sum("size").alias("_words")), "mix-parts")
    sources = parts.groupBy("source").agg(F.sum("_words").alias("source_size"))
    sources = written(cyclic_weights(sources, cycle).withColumn("cap", F.col("source_size") * epochs), "mix-sources")
    total = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, total)
    sources = sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))

    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    offsets = offsets.join(sources, offsets.source.eqNullSafe(sources.source)).select(
        offsets.source.alias("_s"), F.col("_part").alias("_p"), "_offset", "source_size", "target", "_whole", "_rest")
    joined = sized.join(offsets, sized.source.eqNullSafe(offsets._s) & (sized._part == offsets._p))
    inside = (Window.partitionBy("source", "_part").orderBy("_order", "doc_id", "size", "text_hash")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    copies = F.col("_whole") + (start + F.col("size") / 2 <= F.col("_rest")).cast("long")
    return (joined.withColumn("copies", copies).withColumn("copies", F.least(F.col("copies"), F.lit(epochs)))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken"), "text_hash"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``plan_mix`` takes it, with its columns unchanged.

    Nulls, ties and repeated rows as in ``plan_mix``. Rows of one id, text and source are told apart by all their columns, so reruns give the
    same rows. Empty table: no rows.
    """
    plan = _planned(docs, **settings).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "source", "copies")
    plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy("id", "hash").orderBy("source", "copies")))
    # The rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(settings.get("id_col", "doc_id")).alias("doc_id"),
                       F.col(settings.get("source_col", "source")).alias("_source"), F.xxhash64(text_of(settings.get("text_col", "text"))).alias("_hash"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy("_source", "row")))
    both = rows.join(plan, rows.doc_id.eqNullSafe(plan.id) & (rows._hash == plan.hash) & (rows._nth == plan.nth))
    # Zero copies: an empty array, so no row.
    return both.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
