"""Token ids in files: frequency ranks in one to four bytes each, their lengths apart in control bytes.

A file row is a block of whole documents in ascending id order: ``control`` holds two bits a value, four values a byte, the
lowest first, each the value's number of bytes less one; ``data`` holds the values' bytes, low byte first. Values
are ranks: id ``ranking[0]`` is the most frequent one. ``counts`` has the number of ids of each document of the block. Blocks
are rows of Parquet files, so Spark's commit protocol decides which attempt of a task counts, in any store.
"""

import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trendloom.llm.common import id_key, text_of
from trendloom.llm.pieces import PieceCoder, short_batches, slices
from trendloom.session import scratch_dir, written

BLOCK_IDS = 1 << 16

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1  # of the four values of each control byte
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Unsigned 32-bit values -> control bytes, data bytes."""
    values = values.astype("<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[:len(values)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= extra[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """``pack`` undone: lengths come from a table by control byte, values are cut from four bytes at each start."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    words = np.ndarray(shape=(max(len(padded) - 3, 0),), dtype="<u4", buffer=padded, strides=(1,))
    return words[starts] & _MASKS[lengths - 1]


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> PieceCoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    opens = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
    opens[[i for t, i in tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True  # tokens that begin with a blank

    def one_by_one(pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(pieces: list[str]) -> list[bytes]:
        """Pieces with one blank, at their start, are encoded in lines of 500 and parted where a token begins with a blank."""
        blank = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == " " and " " not in p[1:]]
        out: list = [None] * len(pieces)
        lines = [blank[i:i + 500] for i in range(0, len(blank), 500)]
        coded = tokenizer.encode_batch_fast(["".join(pieces[i] for i in line) for line in lines], add_special_tokens=False)
        for line, e in zip(lines, coded):
            ids = np.array(e.ids, dtype="<u4")
            starts = np.flatnonzero(opens[ids])
            if len(starts) == len(line):
                raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                for i, low, high in zip(line, cuts, cuts[1:]):
                    out[i] = raw[low:high]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, one_by_one([pieces[i] for i in rest])):
            out[i] = x
        return out

    specials = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
    return PieceCoder(encode, specials, room=1_000_000)


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, vocabulary: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: each whole text's ids and the end id, as compressed little-endian integers.

    Null text: the end id alone. Null and repeated ids are carried through.
    """
    kind = _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, press = _coder(path), zstandard.ZstdCompressor(level=1)
        for batch in short_batches(batches):
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 500_000):  # few enough pieces at a time for the processor's caches
                blobs = [press.compress(np.append(np.frombuffer(x, dtype="<u4"), end_id).astype(kind).tobytes()) for x in coder.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(blobs, type=pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def _ids(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=kind)


def id_ranking(coded: DataFrame, vocabulary: int) -> list[int]:
    """Ids by falling frequency, then by id: as many as the vocabulary has, whatever the number of documents."""
    kind = _kind(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            for low in range(0, len(blobs), 500):
                total += np.bincount(np.concatenate([_ids(x, kind) for x in blobs[low:low + 500]]), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    seen = [r.id for r in counts.orderBy(F.desc("n"), "id").limit(vocabulary).collect()]  # at most the vocabulary
    return seen + sorted(set(range(vocabulary)) - set(seen))


def write_ids(coded: DataFrame, ranking: list[int], path: str, order_id: str = "_id") -> None:
    """Write blocks: documents in ascending id order, by range partitions; ``part`` numbers the files in order."""
    kind = _kind(len(ranking))
    rank = np.empty(len(ranking), dtype="<u4")
    rank[ranking] = np.arange(len(ranking))
    table = coded.sparkSession.sparkContext.broadcast(rank)  # one entry for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, ids, counts, doc_ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        fields = ["part", "part_start", "doc_ids", "counts", "control", "data"]

        def block():
            values = np.concatenate(ids)
            control, data = pack(table.value[values])
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([start]), pa.array([doc_ids], type=pa.list_(pa.int64())),
                                               pa.array([counts], type=pa.list_(pa.int64())), pa.array([control]), pa.array([data])], fields)

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(_ids(blob.as_py(), kind))
                doc_ids.append(doc_id)
                counts.append(len(ids[-1]))
                held += counts[-1]
                if held >= BLOCK_IDS:
                    yield block()
                    start, ids, counts, doc_ids, held = start + held, [], [], [], 0
        if ids:
            yield block()

    rows = coded.withColumn(order_id, id_key("doc_id"))
    n = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, order_id).sortWithinPartitions(order_id, "ids").select(F.col("doc_id").cast("long"), "ids")
    rows.mapInArrow(run, "part long, part_start long, doc_ids array<long>, counts array<long>, control binary, data binary").write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, ranking: list[int]) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: what the files hold, ``start`` counting the ids of all documents before."""
    blocks = spark.read.parquet(path)
    names = np.array(ranking, dtype="<u4")
    table = spark.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], dtype=np.int64)
                ids = table.value[unpack(row["control"], row["data"], int(counts.sum()))]
                ends = np.cumsum(counts)
                starts = ends - counts
                blobs = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], type=pa.int64()), pa.array(starts + row["part_start"] + row["before"]),
                                                  pa.array(counts), pa.array(blobs, type=pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    sizes = blocks.groupBy("part").agg(F.max(F.col("part_start") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row a file: at most the number of shuffle partitions.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(offsets), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def id_files(docs: DataFrame, path: str, vocabulary: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write and read back: ``doc_id, start, n_tokens, ids_crc32`` of each document, from the files.

    Null text: the end id alone. A null id sorts first and stays null. Rows of one id follow each other. Empty table: no rows, no blocks.
    Ids must be integers. Other columns are not used. Texts are encoded once: a lost executor costs the files' range
    at most, since ids are kept in the shared folder before they are ranked.
    """
    coded = written(encoded(docs, path, vocabulary, end_id, id_col, text_col), "ids")
    ranking = id_ranking(coded, vocabulary)
    target = scratch_dir(docs.sparkSession, "id-files")
    write_ids(coded, ranking, target)
    return checksums(read_ids(docs.sparkSession, target, ranking))


def checksums(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
