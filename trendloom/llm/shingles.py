"""Hashes of words and of word shingles for whole batches of texts at once."""


import numpy as np

from trendloom.llm.common import BLANKS

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finalizer of a common generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


PATH_HEAD, PATH_STEP = 2, 2  # bytes of a path's tree, and of each of its hashes
_KEPT = 1 << 19
_POWERS: list[np.ndarray] = []


def _series(n: int) -> list[np.ndarray]:
    out = []
    for base in (int(_ODD), _inverse(int(_ODD))):
        p = np.full(n, np.uint64(base), dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the odd base and of its inverse, at least ``n``. The worker keeps the first ones; for a longer text more are made anew."""
    if n > _KEPT:
        return _series(n)
    if not _POWERS:
        _POWERS[:] = _series(_KEPT)
    return _POWERS


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in turn, and each text's number of words.

    A word's hash is its bytes' polynomial, from differences of running sums, taken back to power 0 and mixed with its length.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
    blank = _IS_BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    powers, back = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * back[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
    text_ends = np.cumsum([len(b) + 1 for b in raw]) + 1 if raw else np.zeros(0, dtype=np.int64)
    upto = np.searchsorted(starts, text_ends)
    return words, np.diff(np.concatenate([[0], upto])).astype(np.int64)


def shingle_lists(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Shingle hashes of each text as they come. Texts of fewer words have one shingle of all their words, those of none have none."""
    words, counts = word_hashes(texts)

    def marks(own: np.ndarray, width: int) -> np.ndarray:
        out = np.full(max(0, len(own) - width + 1), np.uint64(width), dtype=np.uint64)
        for k in range(width):
            out *= _ODD
            out += own[k:k + len(out)]
            out ^= out >> np.uint64(29)
        return _mix(out)

    whole, at, out = marks(words, size), 0, []  # windows over two texts are left out below
    for n in counts.tolist():
        out.append(whole[at:at + n - size + 1] if n >= size else marks(words[at:at + n], n) if n else words[:0])
        at += n
    return out


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """``shingle_lists`` sorted, each hash once."""
    return [np.unique(x) for x in shingle_lists(texts, size)]


def sequence_keys(texts: list[str]) -> list[bytes]:
    """Equal for texts of equal words in equal order, whatever the blanks; 128 bits."""
    import hashlib
    return [hashlib.blake2b(" ".join(_words(t)).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]


def _words(text: str) -> list[str]:
    for blank in BLANKS[1:]:
        if blank in text:
            text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


class MinHash:
    """``trees * depth`` smallest hashes of a set, under multiply-shift functions drawn from a seed."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self._a = draw.integers(0, 1 << 63, size=trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Row by row for non-empty sets: uint32 minima, tree after tree."""
        flat = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out = np.empty((len(sets), len(self._a)), dtype=np.uint32)
        for k, a in enumerate(self._a):  # the hashes are mixed already; the high bits of a product are as good as new ones
            out[:, k] = np.minimum.reduceat(flat * a, starts) >> np.uint64(32)
        return out

    def paths(self, signatures: np.ndarray) -> np.ndarray:
        """Row by row, tree after tree, the tree's number and 16 bits of each of its hashes, as bytes in the order in which they sort.

        Equal hashes have equal bits. Unequal ones seldom do, which makes a candidate too many and loses none.
        """
        n = len(signatures)
        out = np.empty((n, self.trees, 1 + self.depth), dtype=">u2")
        out[:, :, 0] = np.arange(self.trees)
        out[:, :, 1:] = (_mix(signatures.astype(np.uint64) + np.uint64(1)) >> np.uint64(48)).reshape(n, self.trees, self.depth)
        return out.view(np.uint8).reshape(n * self.trees, PATH_HEAD + PATH_STEP * self.depth)
