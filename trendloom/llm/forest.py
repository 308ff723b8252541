"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each text has one path of smallest hashes in each of several trees, at full depth, as bytes that sort like the tree: a prefix of the path is a node of
the trie. Prefixes that meet others are shortened level by level. A text stops at the first level at which whatever is alike enough to it shares a prefix
in some tree with the recall wanted; that level follows from the smallest similarity at or above the threshold that a set of its size can have at all.
Two texts are compared if they share a prefix as long as the shorter of their two stops asks. Texts of equal words are one node of the graph from the start. Texts that
share trie nodes, directly or through others, make a candidate group; groups are cut into blocks, and each pair of blocks
is one unit of work that counts common shingles for all its pairs and gives back sums by text and a spanning forest, never pairs.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame, functions as F

from trendloom.llm.common import NO_ID, id_key, text_of
from trendloom.llm.components import components
from trendloom.llm.pieces import give_back, short_batches, slices
from trendloom.llm.shingles import PATH_HEAD, PATH_STEP, MinHash, sequence_keys, shingle_lists, shingle_sets
from trendloom.session import written

_CHARS = 100_000  # of the texts that a worker takes apart at a time
_SMALL = 64  # sets up to this size are looked at one by one for the similarities they can have


def prefix_length(trees: int, depth: int, similarity: float, recall: float) -> int:
    """The longest prefix at which a pair of that similarity meets in some tree with probability ``recall``."""
    for length in range(depth, 0, -1):
        if 1 - (1 - similarity ** length) ** trees >= recall:
            return length
    return 1


def least_similarity(size: int, similarity: float) -> float:
    """The smallest Jaccard similarity of at least ``similarity`` that a set of so many members can have with another."""
    least = 1.0
    for common in range(size, 0, -1):
        union = math.floor(common / similarity + 1e-9)
        if union < size:
            break
        least = min(least, common / union)
    return least


def stops(trees: int, depth: int, similarity: float, recall: float) -> list[int]:
    """The level at which a set of 1, 2, ... ``_SMALL`` members stops, and at last that of bigger ones."""
    small = [prefix_length(trees, depth, least_similarity(n, similarity), recall) for n in range(1, _SMALL + 1)]
    return [*small, prefix_length(trees, depth, similarity, recall)]


def _signed(docs: DataFrame, trees: int, depth: int, levels: list[int], words: int) -> DataFrame:
    """``_id, _hash, node, paths, stop``: the key of a text's words, its paths in all trees in a row, none for a text without words, and the level it stops at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(trees, depth)
        for batch in short_batches(batches):
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, _CHARS):
                sets = shingle_lists(texts[a:b], words)
                some = [s for s in sets if len(s)]
                # A longer list may have few distinct members; it then stops later than it needs to.
                stop = [levels[len(np.unique(s)) - 1 if len(s) <= _SMALL else -1] if len(s) else depth for s in sets]
                paths = hashes.paths(hashes.signatures(some)) if some else np.zeros((0, 1), dtype=np.uint8)  # all trees of a text lie together
                whole = iter(paths.reshape(len(some), -1) if some else ())
                labels = pa.array([next(whole).tobytes() if len(s) else b"" for s in sets], type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sequence_keys(texts[a:b]), type=pa.binary()),
                                                  labels, pa.array(stop, type=pa.int32())], ["_id", "_hash", "node", "paths", "stop"])
        give_back()

    return docs.select("_id", "_hash", "_text").mapInArrow(run, "_id long, _hash long, node binary, paths binary, stop int")


def _candidates(nodes: DataFrame, levels: list[int], trees: int, depth: int) -> DataFrame:
    """``a, b``: each member of a trie node that is asked for, with the node's smallest member, which stands for all.

    First the places whose shortest prefix meets no other are left out. Of the rest, each level asks for the nodes in which a text stops; longer
    prefixes of that text lie inside them.
    """
    def prefix(level):
        return F.substring("path", 1, PATH_HEAD + PATH_STEP * level)

    size = PATH_HEAD + PATH_STEP * depth
    places = nodes.where(F.octet_length("paths") > 0).select("node", "stop", "paths", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    places = places.select("node", "stop", F.substring("paths", F.col("tree") * size + 1, F.lit(size)).alias("path"))
    root = prefix(min(levels))
    met = places.groupBy(root.alias("root")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("root")
    matched = written(places.withColumn("root", root).join(met, "root", "left_semi").drop("root"), "matched")
    edges = None
    for level in sorted(set(levels), reverse=True):
        at = matched.select("node", "stop", prefix(level).alias("prefix"))
        hubs = at.groupBy("prefix").agg(F.min("node").alias("hub"), F.max(F.col("stop") == level).alias("_asked"), F.count(F.lit(1)).alias("_n"))
        found = at.join(hubs.where((F.col("_n") > 1) & F.col("_asked")).select("prefix", "hub"), "prefix").where(F.col("node") != F.col("hub"))
        found = found.select(F.col("node").alias("a"), F.col("hub").alias("b"))
        edges = found if edges is None else edges.union(found)
    return written(edges.distinct(), "candidates")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` of the wanted nodes, from the text of their first document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short_batches(batches):
            texts, nodes = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in slices(texts, _CHARS):
                found = [(n, s.tobytes()) for n, k, s in zip(nodes[a:b], sequence_keys(texts[a:b]), shingle_sets(texts[a:b], words)) if n == k]
                columns = list(zip(*found)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.binary()) for c in columns], ["node", "shingles"])
        give_back()

    rows = docs.join(wanted.withColumnRenamed("first_id", "_id"), "_id").select("node", "_text")
    return rows.mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``, by products of 0-1 matrices in strips."""
    sizes = [len(s) for s in left + right]
    values, inverse, counts = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = counts[inverse] > 1  # a shingle of one set alone is common to none
    owner, column = owner[keep], shared[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right)), dtype=np.float64)
    width = int(shared[-1]) + 1 if len(values) else 0
    for low in range(0, width, columns):
        a, b = np.searchsorted(column, [low, low + columns])
        matrix = np.zeros((len(sizes), min(columns, width - low)), dtype=np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        total += matrix[:len(left)] @ matrix[len(left):].T
    return total


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of ``n`` items' component under ``pairs``."""
    parent = np.arange(n)
    while True:
        low = parent.copy()
        np.minimum.at(low, pairs[:, 0], parent[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], parent[pairs[:, 0]])
        low = low[low]
        if (low == parent).all():
            return low
        parent = low


def _verified(members: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """``node, root, links``: for each unit of work a member's links in it and a member it is connected with."""
    sized = members.join(members.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), "label")
    sized = sized.withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    sized = sized.withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    units = sized.join(sets, "node").select("label", "node", "shingles", "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_with"))
    units = units.select("label", F.least("_block", "_with").alias("_low"), F.greatest("_block", "_with").alias("_high"),
                         (F.col("_block") > F.col("_with")).alias("_second"), "node", "shingles")

    def verify(key, rows: pd.DataFrame) -> pd.DataFrame:
        inside = key[1] == key[2]
        rows = rows.sort_values("_second", kind="stable") if not inside else rows
        nodes = rows["node"].tolist()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
        first = len(sets) if inside else int((~rows["_second"]).sum())
        left, right = sets[:first], sets if inside else sets[first:]
        if not left or not right:
            return pd.DataFrame({"node": pd.Series(dtype=object), "root": pd.Series(dtype=object), "links": pd.Series(dtype="int64")})
        common = common_counts(left, right)
        union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - common
        alike = common >= similarity * union - 1e-9
        if inside:
            np.fill_diagonal(alike, False)
            links = alike.sum(axis=1)
        else:
            links = np.concatenate([alike.sum(axis=1), alike.sum(axis=0)])
        pairs = np.argwhere(alike)
        if not inside:
            pairs[:, 1] += first
        roots = _forest(pairs, len(nodes))
        hit = np.flatnonzero(links)
        return pd.DataFrame({"node": pd.Series([nodes[i] for i in hit], dtype=object), "root": pd.Series([nodes[roots[i]] for i in hit], dtype=object), "links": links[hit].astype("int64")})

    return units.groupBy("label", "_low", "_high").applyInPandas(verify, "node binary, root binary, links long")


def _classed(docs: DataFrame, similarity: float, words: int, trees: int, depth: int, recall: float, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``_id, node`` of each row, and ``node, n_copies, label, n_links, first_id, first_hash`` of each text; ``label`` names its class."""
    levels = stops(trees, depth, similarity, recall)
    rows = docs.select(id_key(id_col).cast("long").alias("_id"), F.xxhash64(text_of(text_col)).alias("_hash"), text_of(text_col).alias("_text"))
    signed = written(_signed(rows, trees, depth, levels, words), "forest")
    nodes = written(signed.groupBy("node").agg(F.min(F.struct("_id", "_hash")).alias("_first"), F.count(F.lit(1)).alias("n_copies"), F.first("paths").alias("paths"), F.first("stop").alias("stop")), "forest-nodes")
    nodes = nodes.select("node", F.col("_first._id").alias("first_id"), F.col("_first._hash").alias("first_hash"), "n_copies", "paths", "stop")
    groups = components(_candidates(nodes, levels, trees, depth))
    sets = written(_sets(rows, nodes.join(groups, "node", "left_semi").select("node", "first_id"), words), "sets")
    found = written(_verified(groups, sets, similarity, block), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.drop("paths", "stop").join(classes, "node", "left").join(links, "node", "left")
    named = named.select("node", "n_copies", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "first_id", "first_hash")
    return signed.select("_id", "node"), named


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, trees: int = 24, depth: int = 8, recall: float = 0.999,
                    block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, n_copies``.

    Sets are those of ``words``-word shingles; texts of fewer words have one shingle, all of them. A link is a pair of texts of different words whose
    Jaccard similarity is ``similarity`` or more, ties included; ``n_links`` counts a text's links, ``n_copies`` the rows of its very
    words. ``class_id`` is the smallest id of the texts that links and copies connect. A pair just at the threshold is found with
    probability ``recall``, likelier ones more often; of what is found all is exact. Null and empty texts are copies of each other and have
    no links. A null id counts as the smallest and makes a null ``class_id``. Repeated rows are copies. Empty table: no rows.
    Ids must be integers. Other columns are not used.
    """
    signed, named = _classed(docs, similarity, words, trees, depth, recall, block, id_col, text_col)
    smallest = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = named.join(smallest, "label").select("node", "class_id", "n_links", "n_copies")
    whole = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return signed.join(named, "node").select(whole("_id").alias("doc_id"), whole("class_id").alias("class_id"), "n_links", "n_copies")


def one_of_each_class(docs: DataFrame, similarity: float = 0.8, words: int = 5, trees: int = 24, depth: int = 8, recall: float = 0.999,
                      block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of ``near_duplicates``, whatever its id: that of the smallest id, then of the smallest key of the words.

    Null ids are the smallest, and no two texts are taken for one because of their ids. Of rows that repeat both id and text the smallest by all
    columns stays, so reruns give the same rows. Empty table: no rows.
    """
    _, named = _classed(docs, similarity, words, trees, depth, recall, block, id_col, text_col)
    firsts = named.groupBy("label").agg(F.min(F.struct("first_id", "node", "first_hash")).alias("_first"))
    firsts = written(firsts.select(F.col("_first.first_id").alias("_first_id"), F.col("_first.first_hash").alias("_first_hash")), "firsts")
    # The rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), id_key(id_col).cast("long").alias("_id"), F.xxhash64(text_of(text_col)).alias("_hash"))
    kept = rows.join(firsts, (rows._id == firsts._first_id) & (rows._hash == firsts._first_hash), "left_semi")
    return kept.groupBy("_id", "_hash").agg(F.min("row").alias("row")).select("row.*")
