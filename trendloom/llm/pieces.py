"""Cutting texts where no token can cross, so that each distinct piece is encoded once per worker.

A byte-level vocabulary's pre-tokens never join a non-blank with a blank after it, and of a run of blanks only the last joins
what follows. So a text may be cut before the last blank of each run without changing its tokens.
"""

import ctypes
import re
from collections.abc import Callable, Iterator
from itertools import compress, islice
from operator import not_

import pyarrow as pa

#: The code points with Unicode's White_Space property, as the byte-level pattern's \s has them.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{WHITE}]?[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}][^{WHITE}])|[{WHITE}]+")
_ODD = re.compile(f"\\A[{WHITE}]|[ \n](?:[{WHITE}]|\\Z)")
_BLANK_START = re.compile(f"(?:\\A|[ \n])(?:[{WHITE.replace(chr(10), '')}]|\\Z)")
#: Marks that are no letters, digits or blanks in any Unicode version, and letters that are in each. Between such a letter and
#: a run of such marks the split pattern always cuts; the apostrophe is left out, as contractions begin with it.
_MARKS = ".,!?;:$%&#*"
_LETTER = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]")


def _some_start_blank(pieces: set[str]) -> bool:
    """Whether any piece cut at a blank or line feed has nothing or another blank after it; pieces hold no blank, and a line feed at their start only."""
    return bool(pieces) and _BLANK_START.search(" ".join(pieces)) is not None


class PieceCoder:
    """Texts to their ids as little-endian bytes. ``encode`` does the work for pieces not seen yet.

    The table of known pieces takes ``room`` entries at most and keeps the first ones, which in any text are
    mostly the frequent ones; others are encoded once per call. Pieces over ``longest`` characters are never kept.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], specials: dict[str, bytes], room: int = 700_000, longest: int = 48):
        self._encode, self._specials, self._room, self._longest = encode, specials, room, longest
        self._known: dict[str, bytes] = {}   # by the piece without the blank before it, or with its line feed
        self._exact: dict[str, bytes] = {}   # by the piece as it stands
        self._feed = len(encode(["\n"])[0])
        self._cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def encode(self, texts: list[str]) -> list[bytes]:
        plain, odd = {}, {}
        for i, text in enumerate(texts):
            if any(s in text for s in self._specials):
                odd[i] = None
            elif text:  # every blank and line feed starts a piece; the first piece is given a line feed, taken off again
                plain[i] = ("\n" + text.replace("\n", " \n")).split(" ")
        found, new = self._look_up(self._known, plain)
        if _some_start_blank(new):  # some texts have blanks in a row or at an end
            odd |= {i: None for i in plain if _ODD.search(texts[i])}
            plain = {i: pieces for i, pieces in plain.items() if i not in odd}
            found, new = self._look_up(self._known, plain)
        for i in odd:
            odd[i] = [p for part in (self._cut.split(texts[i]) if self._cut else [texts[i]])
                      for p in ([part] if part in self._specials else _PIECE.findall(part))]
        out = [b""] * len(texts)
        fresh = self._learn(self._known, new, lambda p: p if p[:1] == "\n" else " " + p)
        for i, pieces in plain.items():
            out[i] = b"".join([x or fresh[p] for p, x in zip(pieces, found[i])])[self._feed:]
        found, new = self._look_up(self._exact, odd)
        fresh = self._learn(self._exact, new, lambda p: p)
        for i, pieces in odd.items():
            out[i] = b"".join([x or fresh[p] for p, x in zip(pieces, found[i])])
        return out

    @staticmethod
    def _look_up(known: dict, texts: dict[int, list[str]]) -> tuple[dict[int, list], set[str]]:
        """What is known of each text's pieces, None for others, and the set of those others."""
        found, new = {}, set()
        for i, pieces in texts.items():
            found[i] = got = list(map(known.get, pieces))
            new.update(compress(pieces, map(not_, got)))
        return found, new

    def _learn(self, known: dict, new: set[str], whole: Callable[[str], str]) -> dict[str, bytes]:
        """The ids of ``new``, kept in ``known`` as far as there is room. Marks at a word's end are coded apart, so each word is encoded once."""
        ends = {p: core for p in new if p[-1:] in _MARKS and (core := p.rstrip(_MARKS)) and _LETTER.match(core[-1]) and p not in self._specials}
        fresh = {p: self._specials[p] for p in self._specials if p in new}
        words = [p for p in new if p not in ends and p not in fresh]
        words += {c for c in ends.values() if c not in known and c not in new}
        fresh.update(zip(words, self._encode([whole(p) for p in words])))
        marks = list({p[len(core):] for p, core in ends.items()})
        coded = dict(zip(marks, self._encode(marks)))
        fresh.update([(p, (fresh.get(core) or known[core]) + coded[p[len(core):]]) for p, core in ends.items()])
        if len(known) < self._room:  # words come first into what room is left
            known.update(islice(((p, x) for p, x in fresh.items() if len(p) <= self._longest), self._room - len(known)))
        return fresh


def give_back() -> None:
    """Hand memory that a task no longer uses back to the system: the worker stays alive for a while, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def short_batches(batches: Iterator, rows: int = 500) -> Iterator:
    """The same rows in batches of at most ``rows``, so that only so many texts are Python strings at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def slices(texts: list, chars: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about so many characters, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
