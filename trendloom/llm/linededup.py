"""Line dedup: lines that many documents share stay in one document only."""

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.llm.common import BLANKS, id_key, text_of
from trendloom.session import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lowered(key: Column) -> Column:
    """A-Z in lower case and nothing else; the quick ``lower`` does just that where all is ASCII."""
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _text_hash, _positions``: which lines of which text have to go.

    Line keys travel as 128 hash bits with their position. Counting distinct documents combines on the
    map side, so a line of a third of all documents is summed up, never gathered; in the join back its
    rows may be split, since the other side has one row per key.
    """
    keys = F.transform(_lines(text_of(text_col)), lambda line: F.btrim(line, F.lit(BLANKS)))
    rows = docs.select(id_key(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_text_hash"), F.posexplode(keys).alias("_pos", "_key"))
    rows = rows.where(F.char_length("_key") >= min_chars).withColumn("_key", _lowered(F.col("_key")))
    rows = rows.select("_id", "_text_hash", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    rows = written(rows, "lines")
    frequent = (rows.groupBy("_h1", "_h2").agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_keeper"))
                .where(F.col("_n") >= min_docs).drop("_n"))
    dropped = rows.join(frequent, ["_h1", "_h2"]).where(F.col("_id") != F.col("_keeper"))
    return dropped.groupBy("_id", "_text_hash").agg(F.sort_array(F.collect_set("_pos")).alias("_positions"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text without shared lines, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of ``min_chars`` code points found in ``min_docs``
    distinct ids lose all their lines but those of the largest id. Null text: one empty line. Null ids count as one id,
    the smallest. Repeated rows are treated alike. Rows with one id and different texts are one document with several texts.
    Empty table: no rows. Columns ``n_lines`` and ``n_dropped`` of the input are replaced.
    """
    gone = shared_lines(docs, min_chars, min_docs, id_col, text_col).select(
        F.col("_id").alias("_gone_id"), F.col("_text_hash").alias("_gone_hash"), F.col("_positions").alias("_gone_at"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # The rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*columns).alias("row"), id_key(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_text_hash"))
    joined = rows.join(gone, (rows._id == gone._gone_id) & (rows._text_hash == gone._gone_hash), "left")
    joined = joined.select("row", F.col(f"row.{text_col}").alias("_text"), "_gone_at").withColumn("_all", _lines(text_of("_text")))
    # What stays are the runs of lines between two dropped ones, in order: one pass, however many go.
    joined = joined.withColumn("_cut", F.concat(F.array(F.lit(-1)), F.coalesce("_gone_at", F.array().cast("array<int>")), F.array(F.size("_all"))))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_cut") - 1), lambda j: F.slice(
        F.col("_all"), F.get("_cut", j - 1) + 2, F.get("_cut", j) - F.get("_cut", j - 1) - 1)))
    text = F.when(F.col("_gone_at").isNull(), F.col("_text")).otherwise(F.concat_ws("\n", kept))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in columns],
                         F.size("_all").cast("long").alias("n_lines"), (F.size("_cut") - 2).cast("long").alias("n_dropped"))
