"""Document fingerprints: Merkle trees over sections, paragraphs and the clauses in them.

A text is cut into sections at empty lines, into paragraphs at line ends, and these after punctuation, at
most ``LEAF_CHARS`` code points each. The cuts lose no character, so equal roots mean equal texts. Node hashes
are SHA-256 over the hashes below. The printed fingerprint holds the whole root and ``NODE_DIGITS`` digits of each node
below it, which serve to locate edits and to tell likeness:

    root|section:paragraph,leaf,leaf;paragraph,leaf|section:...
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from trendloom.llm.common import id_key, text_of

LEAF_CHARS = 64
NODE_DIGITS = 10
PARTS = 8
#: After punctuation with the blanks that follow it, or after so many code points without.
_LEAF = r"(?s)[^.!?;:,]{1,%d}+(?:[.!?;:,]++[\x20\x09]*+)?|[.!?;:,]++[\x20\x09]*+" % LEAF_CHARS


def _node(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.concat_ws(",", children)), 256)


def _short(hashes: Column) -> Column:
    return F.substring(hashes, 1, NODE_DIGITS)


def merkle(text: Column) -> Column:
    """Array of sections, each with its hash and its paragraphs, each with its hash and its leaves' hashes."""
    def paragraph(p):
        leaves = F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
        return F.transform(F.array(leaves), lambda a: F.struct(_node("p", a).alias("h"), F.transform(a, _short).alias("leaves")))[0]

    def section(s):
        paragraphs = F.transform(F.split(s, "\n", -1), paragraph)
        return F.transform(F.array(paragraphs), lambda a: F.struct(_node("s", F.transform(a, lambda x: x.h)).alias("h"), a.alias("paragraphs")))[0]

    return F.transform(F.split(text, "\n\n", -1), section)


def printed(tree: Column) -> Column:
    paragraph = lambda p: F.concat_ws(",", F.concat(F.array(_short(p.h)), p.leaves))
    section = lambda s: F.concat(_short(s.h), F.lit(":"), F.concat_ws(";", F.transform(s.paragraphs, paragraph)))
    return F.concat(_node("r", F.transform(tree, lambda s: s.h)), F.lit("|"), F.concat_ws("|", F.transform(tree, section)))


def fingerprint(text: Column) -> Column:
    return printed(merkle(text))


def nodes(mark: Column) -> Column:
    """The distinct node hashes of a printed fingerprint, the root's first digits among them."""
    return F.array_distinct(F.transform(F.split(mark, "[|:;,]"), _short))


def likeness(a: Column, b: Column) -> Column:
    """Share of the two trees' distinct nodes that both have (Dice); 1 only for equal roots, null without a partner."""
    mine, theirs = nodes(a), nodes(b)
    return F.when(a == b, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(mine, theirs)) / (F.size(mine) + F.size(theirs)))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers, from 0 over the whole text, of the paragraphs of ``a`` that are not in ``b``: where edits are."""
    def paragraphs(mark):
        sections = F.split(mark, "[|]")
        return F.flatten(F.transform(F.slice(sections, F.lit(2), F.size(sections)), lambda x: F.split(F.substring_index(x, ":", -1), ";")))

    own = F.transform(paragraphs(a), lambda p, i: F.struct(F.substring_index(p, ",", 1).alias("h"), i.alias("at")))
    other = F.transform(paragraphs(b), lambda p: F.substring_index(p, ",", 1))
    gone = F.array_except(F.transform(own, lambda x: x.h), other)
    return F.transform(F.filter(own, lambda x: F.array_contains(gone, x.h)), lambda x: x["at"])


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """The smallest id key and approximate quantiles: real ids, at most ``parts`` of them."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    row = docs.agg(F.min("_id").alias("low"), F.percentile_approx("_id", shares, F.lit(10_000)).alias("cuts")).first()
    return [] if row.low is None else sorted({row.low, *row.cuts})


def _part(key: Column, bounds: list[int]) -> Column:
    """Number of the last bound that the key reaches, found among about sqrt(n) groups and then inside one."""
    step = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    firsts = F.array(*[F.lit(r[0]) for r in rows])
    groups = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    row = F.size(F.filter(firsts, lambda b: b <= key)) - 1
    return row * step + F.size(F.filter(F.get(groups, row), lambda b: b <= key)) - 1


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """``docs`` in parts by id range with a guest row, the first of the following part, at the end of each.

    The text that follows is then the next row of the same part; the last part's guest is the first document of all. One
    shuffle of the texts; there are ``PARTS`` parts for each shuffle partition, so that tasks come out even.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), id_key(id_col).alias("_id"), text_of(text_col).alias("_text"))
    bounds = _bounds(rows, PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = Window.partitionBy("_part").orderBy("_guest", "_id", "_text")
    if not bounds:
        return rows.withColumn("_part", F.lit(0)).withColumn("_guest", F.lit(False)), order
    own = rows.withColumn("_part", _part(F.col("_id"), bounds)).withColumn("_guest", F.lit(False))
    guests = rows.where(F.col("_id").isin(bounds))
    guests = guests.withColumn("_part", (_part(F.col("_id"), bounds) + F.lit(len(bounds) - 1)) % len(bounds)).withColumn("_guest", F.lit(True))
    return own.unionByName(guests), order


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit: its second half replaced by as much of the next document's start.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Next is by
    (id, text), after the last the first; a single document follows itself. Null text: empty. Null ids come first. Repeated rows follow
    each other. Empty table: no rows. Other columns of the input are not used.
    """
    rows, order = with_next(docs, id_col, text_col)
    rows = rows.withColumn("_next", F.lead("_text").over(order))
    n = F.char_length("_text")
    tail = F.floor(n / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - tail), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), tail)))
    rows = rows.select("doc_id", "_part", "_guest", "_id", "_text", n.cast("long").alias("n_chars"),
                       F.sha2("_edited", 256).alias("edited_sha256"), fingerprint(F.col("_text")).alias("fingerprint"),
                       F.when(~F.col("_guest"), fingerprint(F.col("_edited"))).alias("edited_fingerprint"))
    rows = rows.withColumn("_following", F.lead("fingerprint").over(order)).where(~F.col("_guest"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"))
