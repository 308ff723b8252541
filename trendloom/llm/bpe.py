"""Byte-level BPE: a segment tree over the ranks of adjacent pairs, whose root is the leftmost lowest-rank merge."""

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from trendloom.llm.common import text_of
from trendloom.llm.pieces import PieceCoder, give_back, short_batches, slices

#: Fixed value: the public split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
_BEYOND = re.compile("[^\x00-\u024f]")
_NONE = np.int64(1) << 62
_WIDEST = 128  # wider words are merged one by one


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in vocabulary files: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Vocabulary:
    """A tokenizer file's ids and merges. Pairs are looked up in one sorted array, for single pairs in a dict."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        values = {c: b for b, c in letters.items()}
        ids = data["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = 1 + max([*ids.values(), *self.specials.values()])
        self.tokens = [b""] * size
        for token, i in ids.items():
            self.tokens[i] = bytes(values[c] for c in token)
        for token, i in self.specials.items():
            self.tokens[i] = token.encode()
        self.of_byte = np.array([ids[letters[b]] for b in range(256)], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.scale = size
        keys = np.array([ids[a] * size + ids[b] for a, b in merges], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self.rank_of = {int(k): r for r, k in enumerate(keys)}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, ``_NONE`` where there is no merge or an id is negative."""
        keys = left * self.scale + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self._keys[at] == keys), self._ranks[at], _NONE)


def merge_one(word: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one word of any length: the tree's leaf i holds (rank, i) of the pair that starts at symbol i."""
    ids = vocab.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
    n = len(ids)
    width = 1 << max(1, (n - 1).bit_length())
    none, scale, rank_of, made = width << 32, vocab.scale, vocab.rank_of, vocab.made
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> int:
        j = after[i]
        rank = rank_of.get(ids[i] * scale + ids[j]) if j < n else None
        return none if rank is None else rank * width + i

    tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                return
            tree[node] = low

    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        j = after[i]
        ids[i], ids[j] = int(made[rank]), -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        put(j, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    return [x for x in ids if x >= 0]


def _merge_same_width(words: list[bytes], width: int, vocab: Vocabulary) -> list[np.ndarray]:
    """``merge_one`` for many words of at most ``width`` bytes at once: one tree a row, one merge in each row a round."""
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ids = np.full((n, width + 1), -1, dtype=np.int64)  # the last column stands for the end
    filled = np.arange(width) < lengths[:, None]
    ids[:, :width][filled] = vocab.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    place = np.arange(width, dtype=np.int64)
    after = np.tile(place + 1, (n, 1))
    before = np.tile(place - 1, (n, 1))
    before = np.concatenate([before, np.zeros((n, 1), dtype=np.int64)], axis=1)
    ends = after == lengths[:, None]
    after[ends] = width
    tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
    ranks = vocab.ranks(ids[:, :width], np.concatenate([ids[:, 1:width], np.full((n, 1), -1)], axis=1))
    tree[:, width:] = np.where(ranks == _NONE, _NONE, ranks * width + place)
    node = width // 2
    while node >= 1:
        tree[:, node:2 * node] = np.minimum(tree[:, 2 * node:4 * node:2], tree[:, 2 * node + 1:4 * node:2])
        node //= 2

    def put(rows, at, value):
        at = at + width
        tree[rows, at] = value
        while width > 1 and at[0] > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        rank, i = np.divmod(tree[rows, 1], width)
        j = after[rows, i]
        k = after[rows, j]
        ids[rows, i], ids[rows, j], after[rows, i], before[rows, k] = vocab.made[rank], -1, k, i
        put(rows, j, _NONE)
        fresh = vocab.ranks(ids[rows, i], ids[rows, k])
        put(rows, i, np.where(fresh == _NONE, _NONE, fresh * width + i))
        has = np.flatnonzero(before[rows, i] >= 0)
        if len(has):
            left, mid, r = before[rows, i][has], i[has], rows[has]
            fresh = vocab.ranks(ids[r, left], ids[r, mid])
            put(r, left, np.where(fresh == _NONE, _NONE, fresh * width + left))
        rows = rows[tree[rows, 1] != _NONE]
    kept = ids >= 0
    flat = ids[kept]
    return np.split(flat, np.cumsum(kept.sum(axis=1))[:-1])


def merge_many(words: list[bytes], vocab: Vocabulary, cells: int = 1 << 19) -> list[np.ndarray]:
    """Ids of each word, by segment trees; words of like width share rounds, ``cells`` bounds the arrays."""
    out: list = [None] * len(words)
    by_width: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        by_width.setdefault(1 << max(1, (len(word) - 1).bit_length()), []).append(at)
    for width, places in by_width.items():
        if width > _WIDEST:
            for at in places:
                out[at] = np.array(merge_one(words[at], vocab), dtype=np.int64)
            continue
        step = max(1, cells // width)
        for low in range(0, len(places), step):
            part = places[low:low + step]
            for at, ids in zip(part, _merge_same_width([words[x] for x in part], width, vocab)):
                out[at] = ids
    return out


def split_words(text: str) -> list[str]:
    """Pre-tokens. Beyond Latin letters, where Unicode versions of the two libraries differ, the tokenizers library splits."""
    if not _BEYOND.search(text):
        return _SPLIT.findall(text)
    return [text[a:b] for _, (a, b) in _byte_level().pre_tokenize_str(text)]


@functools.lru_cache(maxsize=1)
def _byte_level():
    from tokenizers.pre_tokenizers import ByteLevel
    return ByteLevel(add_prefix_space=False, use_regex=True)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    vocab = vocabulary(path)

    def encode(pieces: list[str]) -> list[bytes]:
        lists = [split_words(p) for p in pieces]
        distinct = list({w for words in lists for w in words})
        ids = dict(zip(distinct, (x.astype("<i4").tobytes() for x in merge_many([w.encode() for w in distinct], vocab))))
        return [b"".join(map(ids.__getitem__, words)) for words in lists]

    return PieceCoder(encode, {s: np.array([i], dtype="<i4").tobytes() for s, i in vocab.specials.items()}, room=200_000)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    return coder(path).encode(texts)


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD. Ids outside the vocabulary raise IndexError."""
    return b"".join(map(vocabulary(path).tokens.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, special tokens' strings included as such.

    Null text: no ids, as for an empty one. Null and repeated ids are carried through; a row out for each row in.
    ``path`` must be readable on the executors, as the tokenizer's package is. Other columns are not used.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short_batches(batches):
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 500_000):
                coded = encode_texts(texts[a:b], path)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` -> with ``text``, decoded with special tokens kept. Null ids: an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for i in range(len(lists)):
                ids = lists[i].values
                text = decode_ids(ids.to_numpy(zero_copy_only=False), path) if ids is not None else ""
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), lists.slice(i, 1), pa.array([text])], ["doc_id", "ids", "text"])

    rows = coded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def digests(both: DataFrame) -> DataFrame:
    """What tells a coding apart: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return both.select("doc_id", F.size(ids).cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))
