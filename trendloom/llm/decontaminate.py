"""Benchmark decontamination by word n-grams.

The distinct n-grams of the test items form a hash set that is broadcast, in blocks of bounded size if there are very many. Documents are
read once a block: where two words in a row begin some n-gram, the whole window is looked up in it, and as the set holds the words themselves, not their hashes, what is found is verified. Only
hits leave the scan; they are merged to word ranges by document, which can then lose these words, or go.
"""

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.llm.common import text_of
from trendloom.session import written

#: A word is a run of a-z, 0-9 and anything beyond ASCII, after A-Z were lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PIECE = _ANY_CASE + r"|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW_BYTES = 64
_OPENING = 2  # words of an n-gram that are looked up first


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _windows(of: Column, length: int) -> Column:
    """All windows of so many words, as (number of the first word, words)."""
    def window(i: Column) -> Column:
        return F.struct(i.alias("start"), F.concat_ws(" ", *[F.get(of, i + k) for k in range(-1, length - 1)]).alias("gram"))

    size = F.size(of)
    return F.when(size >= length, F.transform(F.sequence(F.lit(1), size - length + 1), window)).otherwise(F.array().cast("array<struct<start:int,gram:string>>"))


def _openings(of: Column, length: int) -> Column:
    """All places of so many words, as (number of the first word, how many, words): what an n-gram may begin with."""
    def opening(i: Column) -> Column:
        words_ = F.concat_ws(" ", *[F.get(of, i + k) for k in range(-1, length - 1)])
        return F.struct(i.alias("start"), F.lit(length).alias("width"), words_.alias("opening"))

    size = F.size(of)
    none = F.array().cast("array<struct<start:int,width:int,opening:string>>")
    return F.when(size >= length, F.transform(F.sequence(F.lit(1), size - length + 1), opening)).otherwise(none)


def test_ngrams(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written (gram, len, gid), each distinct n-gram once, and (gid, item_id). An item of fewer words than ``window`` is one n-gram of all of them."""
    read = items.select(F.col(id_col).cast("string").alias("item_id"), words(text_of(text_col)).alias("_words"))
    whole = F.array(F.struct(F.lit(1).alias("start"), F.array_join("_words", " ").alias("gram")))
    found = F.when(F.size("_words") >= window, _windows(F.col("_words"), window)).otherwise(whole)
    rows = read.where(F.size("_words") > 0).select("item_id", F.least(F.size("_words"), F.lit(window)).alias("len"), F.inline(found)).select("item_id", "len", "gram")
    rows = written(rows.distinct(), "test-windows")
    grams = written(rows.select("gram", "len").distinct().withColumn("gid", F.monotonically_increasing_id()), "test-ngrams")
    return grams, rows.where(F.col("item_id").isNotNull()).join(grams, ["gram", "len"]).select("gid", "item_id")


def _merged(spans: Column) -> Column:
    """Sorted (start, len) as disjoint (start, end), ends exclusive, touching ones joined."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        end = s["start"] + s["len"]
        alone = F.concat(done, F.array(F.named_struct(F.lit("start"), s["start"], F.lit("end"), end)))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.named_struct(F.lit("start"), last["start"], F.lit("end"), F.greatest(last["end"], end))))
        return F.when(F.size(done) == 0, alone).when(s["start"] > last["end"], alone).otherwise(grown)

    return F.aggregate(F.sort_array(spans), empty, step)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, n_words, n_hit, spans, item_ids``.

    A document word is hit if it lies in any occurrence of an n-gram of an item; ``spans`` are the hit words' ranges (number of the first,
    from 1, and of the one after the last), ``n_hit`` their words; ``item_ids`` the items found, as strings in their order, each once. ``text_key`` names
    the text, so that rows of one id with other texts stay apart. ``block_bytes`` bounds what is broadcast at a time.

    Null and empty texts have no words and no hits; null ids are kept, an item without an id hits but is not listed. Repeated rows come back
    as often as they are there. No items: no hits. No documents: no rows. Other columns are not used.
    """
    grams, owners = test_ngrams(items, window, item_col)
    size = grams.agg(F.sum(F.octet_length("gram") + _ROW_BYTES)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most ``window``
    read = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("text_key"), words(text_of(text_col)).alias("_words"))
    mark = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("width"), F.lit(None).cast("string").alias("opening")))
    places = [_openings(F.col("_words"), n) for n in sorted({min(n, _OPENING) for n in lengths})]
    hits = None
    for k in range(blocks):
        part = grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k)
        opening = F.substring_index("gram", " ", _OPENING)
        starts = part.select(opening.alias("opening"), F.least("len", F.lit(_OPENING)).alias("width"), F.col("len").alias("size")).distinct()
        # The first scan also gives a mark for each document, which stands for it where nothing is found.
        found = F.concat(mark, *places) if k == 0 else F.concat(*places)
        rows = read.select("doc_id", "text_key", "_words", F.inline(found))
        rows = rows.join(F.broadcast(starts), ["opening", "width"], "left").where((F.col("start") == 0) | (F.col("start") + F.col("size") - 1 <= F.size("_words")))
        # Only where the first words are those of some n-gram are all its words put together.
        gram = F.when(F.col("size").isNotNull(), F.array_join(F.slice("_words", F.col("start"), F.col("size")), " "))
        rows = rows.select("doc_id", "text_key", F.size("_words").cast("long").alias("n_words"), "start", gram.alias("gram"))
        rows = rows.join(F.broadcast(part), "gram", "left").where((F.col("start") == 0) | F.col("gid").isNotNull()).drop("gram")
        hits = rows if hits is None else hits.unionByName(rows)
    hit = F.when(F.col("gid").isNotNull(), F.struct("start", "len"))
    by_doc = hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("start") == 0).alias("_copies"), F.collect_set(hit).alias("_hits"), F.collect_set("gid").alias("_gids"))
    by_doc = by_doc.select("doc_id", "text_key", "n_words", "_copies", _merged(F.col("_hits")).alias("spans"), F.explode_outer("_gids").alias("gid"))
    named = by_doc.join(owners, "gid", "left").groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"), F.first("_copies").alias("_copies"), F.first("spans").alias("spans"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, p: s + p["end"] - p["start"])
    return (named.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
            .select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), "spans", "item_ids"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _without(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` and what lies between them."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    ahead = F.when(F.regexp_like(text, F.lit("^" + _ANY_CASE)), F.lit(0)).otherwise(F.lit(1))

    def stays(_: Column, k: Column) -> Column:
        place = k - ahead                                 # words at even places, what follows each at the next odd one
        word = F.floor(place / 2).cast("int") + 1
        after = F.pmod(place, F.lit(2))
        return ~F.exists(spans, lambda s: (place >= 0) & (s["start"] <= word) & (word + after < s["end"]))

    return F.array_join(F.filter(pieces, stays), "")


def decontaminated(docs: DataFrame, items: DataFrame, remove: str = "spans", window: int = 10, block_bytes: int = 32 << 20, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the hit words (``remove="spans"``) or without the documents that have any (``"documents"``); same columns, all of them kept.

    Nulls, repeats and empty tables as in ``contamination``; a text without hits, a null one too, stays as it is.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: {remove}")
    found = contamination(docs, items, window, block_bytes, id_col, text_col, item_col).where("n_hit > 0")
    found = written(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans").dropDuplicates(["_id", "_key"]), "contaminated")
    # The rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_own"), F.unhex(F.md5(text_of(text_col))).alias("_text_key"))
    on = rows._own.eqNullSafe(found._id) & (rows._text_key == found._key)
    if remove == "documents":
        return rows.join(found, on, "left_anti").select("row.*")
    text = F.when(F.col("spans").isNull(), F.col("row")[text_col]).otherwise(_without(F.col("row")[text_col], F.col("spans")))
    return rows.join(found, on, "left").select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
