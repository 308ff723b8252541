"""Quality rules by distribution divergence: how far a text's characters and words are from its language's.

Each text has two histograms: its characters by class, and its words by the language's most common words with one bin
for all others. The language's reference is the sum over all its documents. Distance is Jensen-Shannon's (square root, base 2: 0 to 1).
"""

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trendloom.llm.common import BLANKS, text_of
from trendloom.session import written

#: What counts as a symbol in ``n_symbols``.
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "symbol", "punctuation", "other")
WINDOW = 5


def _class_of(c: str) -> int:
    kind = unicodedata.category(c)
    name = ("blank" if c in BLANKS or kind[0] == "Z" else "symbol" if c in SYMBOLS or kind[0] == "S" else "lower" if kind == "Ll"
            else "upper" if kind in ("Lu", "Lt") else "digit" if kind[0] == "N" else "punctuation" if kind[0] == "P" else "other")
    return CLASSES.index(name)


_TABLE: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    """Characters by class; those beyond U+FFFF are ``other``."""
    if not _TABLE:
        _TABLE.append(np.array([_class_of(chr(c)) for c in range(1 << 16)] + [CLASSES.index("other")], dtype=np.uint8))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(_TABLE[0][np.minimum(points, 1 << 16)], minlength=len(CLASSES))


def words_of(text: str) -> list[str]:
    for blank in BLANKS[1:]:
        if blank in text:
            text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of ``WINDOW`` words found at two or more places."""
    if len(words) <= WINDOW:
        return 0
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    marks = np.zeros(len(words) - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        marks = (marks ^ (marks >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + len(marks)]
    order = np.argsort(marks, kind="stable")
    same = marks[order][1:] == marks[order][:-1]
    found = np.zeros(len(marks), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(found)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Between two histograms of like bins; 0 if either is empty."""
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def references(docs: DataFrame, common: int = 50, text_col: str = "text", lang_col: str = "lang", room: int = 300_000) -> DataFrame:
    """One row a language (null is one): ``lang, words, word_counts, n_words, class_counts``, over all documents.

    Tasks count words on their own and hand on counts when they hold ``room`` distinct ones; the top words of a
    language are cut per task before they meet.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(words, classes):
            found = [(lang, w, None, n) for (lang, w), n in words.items()]
            found += [(lang, None, k, int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
            totals = Counter()
            for (lang, _), n in words.items():
                totals[lang] += n
            found += [(lang, None, -1, n) for lang, n in totals.items()]
            columns = list(zip(*found)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], ["lang", "word", "class", "n"])

        by_lang: dict = {}
        classes: dict = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                counter = by_lang.setdefault(lang, Counter())
                held -= len(counter)
                counter.update(words_of(text))
                held += len(counter)
                classes[lang] = classes.get(lang, 0) + class_counts(text)
                if held >= room:
                    yield rows({(x, w): n for x, c in by_lang.items() for w, n in c.items()}, classes)
                    by_lang, classes, held = {}, {}, 0
        yield rows({(x, w): n for x, c in by_lang.items() for w, n in c.items()}, classes)

    counted = (docs.select(F.col(lang_col).alias("lang"), text_of(text_col).alias("text")).mapInArrow(count, "lang string, word string, class int, n long")
               .groupBy("lang", "word", "class").agg(F.sum("n").alias("n")))
    counted = written(counted, "word-counts")
    words = counted.where(F.col("word").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = words.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= common)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("_at", "word", "n"))).alias("top"))
    sums = counted.where(F.col("word").isNull()).groupBy("lang").agg(
        F.sum(F.when(F.col("class") < 0, F.col("n")).otherwise(0)).alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("class") >= 0, F.struct("class", "n")))).alias("classes"))
    top = top.withColumnRenamed("lang", "_lang")
    both = sums.join(top, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    none = F.array().cast("array<struct<_at:int,word:string,n:bigint>>")
    both = both.withColumn("top", F.coalesce("top", none))
    # Written, so that Catalyst knows the size and broadcasts it only if it is small.
    return written(both.select("lang", F.transform("top", lambda x: x.word).alias("words"), F.transform("top", lambda x: x.n).alias("word_counts"),
                               "n_words", F.transform("classes", lambda x: x.n).alias("class_counts")), "references")


def quality_rules(docs: DataFrame, max_class_distance: float = 0.28, max_word_distance: float = 0.45, min_chars: int = 250,
                  min_words: int = 50, min_reference_words: int = 1000, common: int = 50, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: the base counts and verdict, both distances, and whether the text is kept.

    A distance counts against a text only if the text has ``min_chars`` characters or ``min_words`` words, and the language
    ``min_reference_words`` words in all; else it is null. Null text: no words, which the base rule refuses. Null language: a language of
    its own. Null and repeated ids are carried through. Empty table: no rows. Other columns are not used.
    """
    refs = references(docs, common, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.col(lang_col).alias("lang"))
    refs = refs.withColumnRenamed("lang", "_lang")
    rows = rows.join(refs, F.col("lang").eqNullSafe(F.col("_lang")), "left").select("doc_id", "text", "lang", "words", "word_counts", "n_words", "class_counts")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = (f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, class_distance double, word_distance double, kept boolean")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            judged = []
            for i, lang in enumerate(batch.column(2).to_pylist()):
                if lang not in known:
                    if len(known) > 100:
                        known.clear()
                    names, counts, total, classes = (batch.column(k)[i].as_py() for k in range(3, 7))
                    known[lang] = ({w: k for k, w in enumerate(names)}, np.array([*counts, total - sum(counts)], dtype=float), total, np.array(classes, dtype=float))
                places, word_ref, total, class_ref = known[lang]
                text = batch.column(1)[i].as_py()
                words = words_of(text)
                base = base_counts(text, words)
                failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
                by_class = by_word = None
                if total >= min_reference_words and len(text) >= min_chars:
                    by_class = js_distance(class_counts(text), class_ref)
                if total >= min_reference_words and base[0] >= min_words:
                    rest = len(places)
                    by_word = js_distance(np.bincount([places.get(w, rest) for w in words], minlength=rest + 1), word_ref)
                far = (by_class or 0) > max_class_distance or (by_word or 0) > max_word_distance
                judged.append((*base, failed, by_class, by_word, not failed and not far))
            columns = list(zip(*judged)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=k) for c, k in zip(columns, kinds)]],
                                             [x.strip().split(" ")[0] for x in out.split(",")])

    return rows.mapInArrow(judge, out)
