"""BPE, id files, the Jaccard join, perplexity and distribution rules, against one-by-one versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import LONG, ODD_ROWS
from trendloom.llm import bpe, divergence, forest, idfiles, perplexity, shingles
from trendloom.llm.common import documents, table
from trendloom.llm.components import components
from trendloom.llm.pieces import PieceCoder
from trendloom.session import written

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- BPE

PARTS = st.sampled_from(["a", "the", " ", "  ", "\n", "\n\n", "\t", "\xa0", "　", "\x1c", "é", "ß", "'s", "'LL", "12", "²", "日本", "\U0001f642", "<|endoftext|>", "!?", "\r\n", "զ", "x" * 40])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(PARTS, st.text(max_size=3)), max_size=12).map("".join))
def test_ids_equal_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    for coded in (bpe.encode_texts([text], PATH), idfiles._coder(PATH).encode([text])):
        assert np.frombuffer(coded[0], "<u4").tolist() == ids
    assert bpe.decode_ids(np.array(ids), PATH) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_wide_words_by_one_tree_each():
    vocab = bpe.vocabulary(PATH)
    words = [b"a", b"ab" * 300, "é".encode() * 200, b"thethethe" * 40, bytes(range(256)), b"z" * 5000]
    for word, many in zip(words, bpe.merge_many(words, vocab)):
        assert bpe.merge_one(word, vocab) == many.tolist()
        if len(word) <= 4096:
            assert bpe._merge_same_width([word], 1 << max(1, (len(word) - 1).bit_length()), vocab)[0].tolist() == many.tolist()


def test_a_full_table_of_pieces_changes_nothing():
    small = bpe.PieceCoder(bpe.coder(PATH)._encode, bpe.coder(PATH)._specials, room=3)
    texts = [r[1] or "" for r in ODD_ROWS] + ["one two  three one", "one two three four five"]
    for _ in range(2):
        assert small.encode(texts) == bpe.encode_texts(texts, PATH)
    assert len(small._known) <= 3 and len(small._exact) <= 3


def test_coding_of_odd_rows(odd, none):
    got = sorted(map(tuple, bpe.digests(bpe.bpe_decode(bpe.bpe_encode(odd, PATH), PATH)).collect()), key=str)
    want = []
    for doc_id, text, *_ in ODD_ROWS:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.digests(bpe.bpe_decode(bpe.bpe_encode(none, PATH), PATH)).count() == 0


# --- id files

@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2 ** 24 - 1, 2 ** 24, 2 ** 32 - 1]) | st.integers(0, 2 ** 32 - 1), max_size=40))
def test_packing_round_trip(values):
    control, data = idfiles.pack(np.array(values, dtype="<u4"))
    assert len(control) == -(-len(values) // 4) and len(data) == sum(max(1, -(-v.bit_length() // 8)) for v in values)
    assert idfiles.unpack(control, data, len(values)).tolist() == values


def test_files_of_odd_rows(odd, none):
    got = idfiles.id_files(odd, PATH, 50_257).collect()
    coded = [(-(1 << 63) if r[0] is None else r[0], LIBRARY.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in ODD_ROWS]
    key = lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id)
    got.sort(key=lambda r: r.start)
    assert [key(r) for r in got] == sorted(i for i, _ in coded)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    want = collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in coded)
    assert collections.Counter((key(r), r.n_tokens, r.ids_crc32) for r in got) == want
    assert idfiles.id_files(none, PATH, 50_257).count() == 0


def test_frequent_ids_rank_first(make_docs):
    docs = make_docs([(1, "a a a a b b", "en", "s", 1), (2, " a", "en", "s", 1)])
    ranking = idfiles.id_ranking(idfiles.encoded(docs, PATH, 50_257), 50_257)
    counts = collections.Counter(i for t in ("a a a a b b", " a") for i in LIBRARY.encode(t).ids + [0])
    assert ranking[:len(counts)] == sorted(counts, key=lambda i: (-counts[i], i)) and sorted(ranking) == list(range(50_257))


# --- Jaccard join

def sets_of(text):
    words = WORD.findall(text or "")
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def classes_by_brute_force(rows, similarity=0.8):
    parent, links = list(range(len(rows))), [set() for _ in rows]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, words = [sets_of(r[1]) for r in rows], [tuple(WORD.findall(r[1] or "")) for r in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        alike = common and common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9
        if words[a] == words[b] or alike:
            parent[find(a)] = find(b)
        if alike and words[a] != words[b]:
            links[a].add(words[b])
            links[b].add(words[a])
    low = {}
    ids = [-(1 << 63) if r[0] is None else r[0] for r in rows]
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), 1 << 62), ids[i])
    return collections.Counter((r[0], None if low[find(i)] == -(1 << 63) else low[find(i)], len(links[i]), words.count(words[i])) for i, r in enumerate(rows))


def near_copies(n, seed, length=120):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(length)]
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(1, 5)):
            words[draw.randrange(length)] = f"new{draw.randrange(10 ** 6)}"
        yield " ".join(words)


@pytest.mark.parametrize("block", [256, 7])
def test_join_by_brute_force(make_docs, block):
    rows = list(ODD_ROWS)
    for seed, n in enumerate([40, 12, 3, 2]):
        rows += [(100 * (seed + 1) + i, t, "en", "s", 1) for i, t in enumerate(near_copies(n, seed))]
    rows += [(900 + i, t, "en", "s", 1) for i, t in enumerate(["a b c d", "a b c d", "a  b\nc d", "a b c e", "a b c d e f g h i j", "a b c d e f g h i j k", "a b c d e f g h i j", "x" * 30])]
    got = forest.near_duplicates(make_docs(rows), block=block).collect()
    assert collections.Counter(map(tuple, got)) == classes_by_brute_force(rows)


def test_threshold_itself_is_a_link(make_docs):
    words = [f"w{i}" for i in range(13)]  # 9 shingles; with one word more 10, of which 9 are common, and so on to 8 of 10
    a, b = " ".join(words[:12]), " ".join(words[:12] + ["x", "y"])
    assert len(sets_of(a) & sets_of(b)) / len(sets_of(a) | sets_of(b)) == 0.8
    got = forest.near_duplicates(make_docs([(1, a, "en", "s", 1), (2, b, "en", "s", 1)]), trees=64, depth=4).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(1, 1, 1), (2, 1, 1)}


def test_join_of_nothing(none):
    assert forest.near_duplicates(none).count() == 0


def test_one_of_each_class_by_content(make_docs):
    other, third = "a quite different text of the same id, and not short", "one more text that has no id at all"
    near = [" ".join("new" if i == k else f"w{i}" for i in range(120)) for k in (30, 60, 90)]
    rows = list(ODD_ROWS) + [(5, other, "en", "s", 1), (None, third, "en", "s", 1), (None, " " + third, "en", "s", 1)]
    rows += [(50, near[0], "en", "s", 1), (51, near[1], "en", "s", 1), (51, "a text that repeats the id of a near copy", "en", "s", 1), (None, near[2], "en", "s", 1)]
    rows += [(60, "said twice by one id", "en", "s", 1), (60, "said twice by one id", "en", "b", 2)]
    kept = [forest.one_of_each_class(make_docs(r)) for r in (rows, rows[::-1])]
    assert kept[0].columns == make_docs([]).columns
    got = [collections.Counter((r.doc_id, " ".join(WORD.findall(r.text or "")), r.source) for r in k.collect()) for k in kept]
    words = lambda i: " ".join(WORD.findall(ODD_ROWS[i][1] or ""))
    # ODD_ROWS: 2, 3, 6 and a null id have no words; 5 copies 1.
    want = [(1, words(0), "a"), (None, words(3), "b"), (None, "", None), (4, words(5), "a"), (7, words(9), "b"), (-9, "short", "a"),
            (5, other, "s"), (None, third, "s"), (None, near[2], "s"), (51, "a text that repeats the id of a near copy", "s"), (60, "said twice by one id", "b")]
    assert got[0] == got[1] == collections.Counter(want)


def test_one_of_each_class_of_nothing(none):
    assert forest.one_of_each_class(none).count() == 0


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(draw.randrange(100, 160), 100) for _ in range(80)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(v == 100 for k, v in got.items() if 100 <= k < 200)
    assert got[200] == 200 and got[301] == got[300] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_contract_long_paths(spark, monkeypatch):
    import trendloom.llm.components as module
    sizes = {}

    def counted(df, label, **more):
        out = written(df, label, **more)
        sizes.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(module, "written", counted)
    path = [(i, i + 1) for i in range(400)] + [(1000 + (i * 37) % 101, 1000 + (i * 37 + 37) % 101) for i in range(101)] + [(5000, 5000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(401)}, **{1000 + i: 1000 for i in range(101)}, 5000: 5000}
    assert len(sizes["contracted"]) <= 20 and sum(sizes["contracted"]) <= 2 * len(path)  # edges fall away round by round



def test_prefixes_shorten_until_the_recall():
    assert forest.prefix_length(24, 7, 0.8, 0.999) == 6 and forest.prefix_length(24, 7, 0.8, 0.9) == 7
    assert forest.prefix_length(1, 5, 0.5, 0.999) == 1


def test_least_similarity_by_trying_all_sizes():
    for t in (0.5, 0.7, 0.8, 0.95, 1.0):
        for n in range(1, 41):
            able = [c / (n + m - c) for m in range(1, 100) for c in range(1, min(n, m) + 1) if c >= t * (n + m - c) - 1e-9]
            assert math.isclose(forest.least_similarity(n, t), min(able))


def test_small_sets_stop_at_longer_prefixes():
    levels = forest.stops(24, 8, 0.8, 0.999)
    assert levels[:9] == [8, 8, 8, 6, 6, 7, 8, 6, 6] and levels[-1] == 6
    for n, level in enumerate(levels[:-1], 1):
        s = forest.least_similarity(n, 0.8)
        assert 1 - (1 - s ** level) ** 24 >= 0.999 and (level == 8 or 1 - (1 - s ** (level + 1)) ** 24 < 0.999)


def test_a_node_is_asked_for_by_the_text_that_stops_there(spark):
    def path(tree, *hashes):
        return np.array([tree, *hashes], dtype=">u2").tobytes()

    nodes = spark.createDataFrame([
        (b"a", path(0, 1, 2, 3) + path(1, 9, 9, 9), 3), (b"b", path(0, 1, 2, 3) + path(1, 8, 9, 9), 3),  # meet at their stop
        (b"c", path(0, 1, 2, 4) + path(1, 7, 9, 9), 2),  # stops earlier: meets both at level 2
        (b"d", path(0, 5, 5, 5) + path(1, 6, 9, 9), 3), (b"e", path(0, 5, 5, 6) + path(1, 5, 9, 9), 3),  # meet at level 2, where none of them stops
        (b"f", path(0, 9, 2, 3) + path(1, 1, 2, 3), 2), (b"g", b"", 3)], "node binary, paths binary, stop int")
    got = {(bytes(r.a), bytes(r.b)) for r in forest._candidates(nodes, [3, 2], trees=2, depth=3).collect()}
    assert got == {(b"b", b"a"), (b"c", b"a")}


@pytest.mark.parametrize("similarity, least", [(0.8, 0.995), (0.85, 0.999), (0.9, 0.9999)])
def test_measured_recall_of_the_default_forest(similarity, least):
    draw, n, pairs = np.random.default_rng(5), 360, 3000
    common = round(2 * n * similarity / (1 + similarity))  # members of both among n and n
    assert abs(common / (2 * n - common) - similarity) < 1e-9 or similarity != 0.8
    pool = draw.integers(0, 1 << 63, size=(pairs, 2 * n), dtype=np.uint64)
    hashes = shingles.MinHash(24, 8)
    left, right = (hashes.paths(hashes.signatures(list(part))).reshape(pairs, 24, -1) for part in (pool[:, :n], pool[:, n - common:2 * n - common]))
    level = forest.stops(24, 8, 0.8, 0.999)[-1]
    head = shingles.PATH_HEAD + shingles.PATH_STEP * level
    met = (left[:, :, :head] == right[:, :, :head]).all(axis=2).any(axis=1)
    assert met.mean() >= least
    print(similarity, met.mean())


def test_word_hashes_tell_words_apart():
    texts = ["a b ab", "", "  a\tb\nab ", "é éé", LONG[:1000]]
    words, counts = shingles.word_hashes(texts)
    assert counts.tolist() == [len(WORD.findall(t)) for t in texts]
    flat = [w for t in texts for w in WORD.findall(t)]
    assert len(set(words.tolist())) == len(set(flat)) and len(dict(zip(words.tolist(), flat))) == len(set(zip(words.tolist(), flat)))


# --- perplexity

def kneser_ney(texts, order, symbols):
    counts = {order: collections.Counter()}
    for t in texts:
        padded = perplexity.START * (order - 1) + t
        counts[order].update(padded[i:i + order] for i in range(len(t)))
    for m in range(order - 1, 0, -1):
        counts[m] = collections.Counter(g[1:] for g in counts[m + 1])
    cuts, contexts = {}, {}
    for m, c in counts.items():
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n[:3]) else None
        cuts[m] = [0.5, 1.0, 1.5] if y is None else [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]
        total, left = collections.Counter(), collections.Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            left[g[:-1]] += cuts[m][min(v, 3) - 1]
        contexts[m] = total, left

    def p(g):
        if not g:
            return 1 / (symbols + 1)
        total, left = contexts[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        v = counts[len(g)].get(g, 0)
        return (v - cuts[len(g)][min(v, 3) - 1] if v else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])
    return p


def labelled_docs():
    draw = random.Random(5)
    parts = ["an", "ther", "ing", "e ", "st ", "ou", "re", ". ", "éa ", "\n"]
    rows = [(i, "".join(draw.choices(parts, k=draw.randrange(20, 60))), "en" if i % 2 else "fr", "s", 1) for i in range(60)]
    return rows + [(100 + i, "#" .join(draw.choices("XQ%&", k=80)), "en", "s", 1) for i in range(5)] + list(ODD_ROWS)


@pytest.mark.parametrize("most_broadcast", [1_000_000, 0])
def test_perplexity_by_brute_force(spark, make_docs, most_broadcast):
    rows = labelled_docs()
    good = [(i,) for i in range(10, 60)]
    got = perplexity.perplexities(make_docs(rows), spark.createDataFrame(good, "doc_id long"), order=3, most_broadcast=most_broadcast).collect()
    texts = {i: t for i, t, *_ in rows[:60]}
    p = kneser_ney([texts[i] for (i,) in good], 3, len({c for r in rows for c in r[1] or ""}))
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.perplexity for r in got if r.doc_id is not None and r.doc_id >= 10}
    for i, text, *_ in rows[10:65]:
        padded = perplexity.START * 2 + text
        want = math.exp(-sum(math.log(p(padded[k:k + 3])) for k in range(len(text))) / len(text))
        assert by_id[i] == pytest.approx(want, rel=1e-6)
    assert sum(r.perplexity is None for r in got) == sum(not r[1] for r in rows)


def test_junk_goes_and_clean_texts_stay(spark, make_docs, none):
    labels = spark.createDataFrame([(i, 1) for i in range(10, 60)] + [(100, 0), (None, 1)], "doc_id long, quality int")
    got = perplexity.classify(make_docs(labelled_docs()), labels, order=3).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(10, 60)) and not any(kept[i] for i in range(100, 105))
    assert all(r.kept for r in got if r.perplexity is None)
    assert perplexity.classify(none, labels, order=3).count() == 0
    untrained = perplexity.classify(make_docs(labelled_docs()), labels.where("quality = 7"), order=3).collect()
    assert all(r.kept and r.threshold is None for r in untrained)


def test_few_bad_texts_pass_and_clean_ones_stay(spark):
    sf_dir = "/root/testdata/sf0.01"
    judged = perplexity.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kept = {r.quality: (r.n, r.kept) for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert kept[0][0] == 58 and kept[0][1] <= 4 and kept[1][1] >= 0.99 * kept[1][0]
    # A seventh of the labelled texts is bad; of the others, which did not train the model, no more go.
    assert kept[None][1] >= 0.85 * kept[None][0]


def test_each_row_goes_by_its_own_verdict(spark, make_docs, none):
    labels = spark.createDataFrame([(i, 1) for i in range(10, 60)], "doc_id long, quality int")
    rows = labelled_docs()[:65]
    junk, clean = rows[60:65], rows[10:13]
    rows += [(None, t, "en", "s", 1) for _, t, *_ in junk] + [(5, junk[0][1], "en", "s", 1), (None, clean[1][1], "en", "s", 1), (100, clean[1][1], "en", "s", 1)]
    got = perplexity.kept_rows(make_docs(rows), labels, order=3)
    bad = {t for _, t, *_ in junk}
    assert got.columns == none.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(r[:2] for r in rows if r[1] not in bad)
    assert perplexity.kept_rows(none, labels, order=3).count() == 0


# --- distribution rules

def base_by_brute_force(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeated = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), doubled, len(repeated)


def test_base_counts_by_brute_force(make_docs, none):
    draw = random.Random(9)
    rows = [(200 + i, "".join(draw.choices(["a", "b", "é", " ", "\n", "\t", "a b c d e ", "#", "|", "x\n"], k=draw.randrange(0, 120))), "en", "s", 1) for i in range(150)] + list(ODD_ROWS)
    got = divergence.quality_rules(make_docs(rows)).collect()
    want = collections.Counter((r[0], *base_by_brute_force(r[1] or "")) for r in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert divergence.quality_rules(none).count() == 0


def test_far_texts_go(make_docs):
    draw = random.Random(4)
    common = ["the", "of", "and", "in", "to"] * 3 + [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(draw.choices(common, k=100)), "en", "s", 1) for i in range(80)]
    rows += [(100, " ".join(w.upper() + "!!" for w in draw.choices(common, k=100)), "en", "s", 1), (101, " ".join(f"zq{i}x" for i in range(200)), "en", "s", 1), (102, "A B C D E F G H I J K L", "en", "s", 1)]
    got = {r.doc_id: r for r in divergence.quality_rules(make_docs(rows)).collect()}
    assert all(got[i].kept for i in range(80)) and not got[100].kept and not got[101].kept
    assert got[102].kept and got[102].class_distance is None  # too short to tell


def test_references_by_brute_force(make_docs):
    rows = [(1, "a b a", "en", "s", 1), (2, "B a", "en", "s", 1), (3, "c", None, "s", 1), (4, None, "de", "s", 1)]
    got = {r.lang: r for r in divergence.references(make_docs(rows), common=2).collect()}
    assert (got["en"].words, got["en"].word_counts, got["en"].n_words) == (["a", "B"], [3, 1], 5)
    assert (got[None].words, got[None].n_words, got["de"].words, got["de"].n_words) == (["c"], 1, [], 0)
    assert got["en"].class_counts == [4, 1, 0, 3, 0, 0, 0]


def test_js_distance():
    a, b = np.array([1.0, 0, 3]), np.array([0, 5.0, 0])
    assert divergence.js_distance(a, b) == pytest.approx(1) and divergence.js_distance(a, 2 * a) == pytest.approx(0)
    assert divergence.js_distance(a, np.zeros(3)) == 0


def test_null_ids_are_dealt_over_the_shards(make_docs):
    rows = [(None if i % 3 == 0 else i, f"text number {i}", "en", "s", 1) for i in range(900)]
    docs = make_docs(rows).withColumn("text_hash", F.xxhash64("text"))
    shards = collections.Counter(r[0] for r in docs.select(perplexity._shard("doc_id", 8, "text_hash")).collect())
    assert len(shards) == 8 and max(shards.values()) < 2 * 900 / 8


def test_a_word_before_marks_is_coded_once():
    seen = []

    def encode(pieces):
        seen.extend(pieces)
        return [p.encode() for p in pieces]

    text = "\nword, word. word!! word other; x"
    assert PieceCoder(encode, {}).encode(["a word, word. word!! word other; x"]) == [b"a word, word. word!! word other; x"]
    assert seen.count(" word") == 1 and " word," not in seen and " other" in seen
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [text, "don't, we're. I'll! it's", "été, Ǆ. ×, ÷. 5, a5. ª. ²!", "a ,b . , c", "...", ", x.", "l’été.«ok».", "a,, b,\n\nc. \td.", "中文, 中文.", "<|endoftext|>, a.<|endoftext|>"] * 2
    library = Tokenizer.from_file(path)
    coder = idfiles._coder(path)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert PieceCoder(encode, {}, room=2).encode(["b c, d. e", "c, c d."]) == [b"b c, d. e", b"c, c d."]


def test_the_pipeline_codes_and_decodes_in_stages_of_their_own(odd):
    import corpus_pipeline
    plan = corpus_pipeline.bpe_coding(odd.sparkSession, odd, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
