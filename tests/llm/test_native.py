"""Fingerprints, tool calls, line dedup, personal data, mixing."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, ODD_ROWS
from trendloom.llm import fingerprint, linededup, mixing, pii, toolcalls


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fingerprints

def edited(rows):
    ordered = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    texts = [r[1] or "" for r in ordered]
    out = []
    for i, (row, text) in enumerate(zip(ordered, texts)):
        n, following = len(text), texts[(i + 1) % len(texts)]
        out.append((row[0], n, sha(text[:n - n // 2] + following[:n // 2])))
    return out


def test_edits_by_brute_force(odd):
    got = fingerprint.edit_fingerprints(odd).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(edited(ODD_ROWS), key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_equal_texts_and_only_they_have_equal_roots(make_docs):
    texts = ["a. b\n\nc", "a. b\n\nc", "a. b\nc", "a.  b\n\nc", "", "\n", "\n\n", "c\n\na. b", "x" * 64, "x" * 65]
    rows = make_docs([(i, t, "en", "s", 0) for i, t in enumerate(texts)]).select("doc_id", fingerprint.fingerprint(F.col("text")).alias("f")).collect()
    marks = {r.doc_id: r.f for r in rows}
    assert marks[0] == marks[1] and len({m.split("|")[0] for m in marks.values()}) == len(set(texts))


def test_likeness_and_place_of_an_edit(make_docs):
    old = "First section, first paragraph.\nIts second one, quite plain.\n\nSecond section here.\nAnd its end."
    new = old.replace("quite plain", "quite changed")
    df = make_docs([(1, old, "en", "s", 0)]).withColumn("b", F.lit(new)).select(fingerprint.fingerprint(F.col("text")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    row = df.select(fingerprint.likeness(F.col("a"), F.col("b")).alias("x"), fingerprint.likeness(F.col("a"), F.col("a")).alias("same"),
                    fingerprint.differing_paragraphs(F.col("a"), F.col("b")).alias("at")).first()
    assert 0.5 < row.x < 1 and row.same == 1 and row["at"] == [1]


def test_no_documents(none):
    assert fingerprint.edit_fingerprints(none).count() == 0
    assert linededup.line_dedup(none).count() == 0
    assert pii.pii_spans(none).count() == 0
    assert mixing.plan_mix(none).count() == 0 and mixing.mixed(none).count() == 0


# --- line dedup

def test_lines_stay_in_the_largest_id(make_docs):
    shared = "This line is shared by many documents of the corpus, it is."
    rows = [(i, f"head {i}\n\t{shared.upper() if i % 2 else shared}  \n{shared}\ntail", "en", "s", 1) for i in range(6)]
    rows += [(10 + i, "An equal line that only four documents have, so it stays.\n", "en", "s", 1) for i in range(4)]
    rows += [(20 + i, "ab" + "É" * 40, "en", "s", 1) for i in range(3)] + [(30 + i, "ab" + "é" * 40, "en", "s", 1) for i in range(3)]
    got = {r.doc_id: r for r in linededup.line_dedup(make_docs(rows)).collect()}
    assert all(got[i].text == f"head {i}\ntail" and got[i].n_dropped == 2 and got[i].n_lines == 4 for i in range(5))
    assert got[5].text == rows[5][1] and got[5].n_dropped == 0
    assert all(got[r[0]].text == r[1] and got[r[0]].n_dropped == 0 for r in rows[6:])  # only A-Z are lowered


def test_all_lines_of_a_text_may_go(make_docs):
    line = "x" * 40
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.line_dedup(make_docs([(i, line, "en", "s", 1) for i in range(5)])).collect()}
    assert got[0] == ("", 1, 1) and got[4] == (line, 1, 0)


def test_odd_rows_keep_their_columns(odd):
    got = linededup.line_dedup(odd, min_docs=2)
    assert set(got.columns) == set(odd.columns) | {"n_dropped"} and got.count() == len(ODD_ROWS)
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].n_dropped == 1 and [r.n_dropped for r in by_id[5]] == [0, 0]
    assert by_id[2][0].text is None and by_id[2][0].n_lines == 1 and by_id[4][0].text == LONG


# --- mixing

def test_targets_and_taken(make_docs):
    rows = [(s * 1000 + i, "w " * (1 + (i * 7 + s) % 40), "en", name, 1) for s, name in enumerate(["a", "b", "c", None]) for i in range(20 if s == 1 else 200)]
    got = mixing.plan_mix(make_docs(rows)).collect()
    total = sum(r.size for r in got)
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    targets = {s: rs[0].target for s, rs in by_source.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert targets["b"] == 2 * by_source["b"][0].source_size  # the small one is clamped
    free = [s for s in targets if targets[s] < 2 * by_source[s][0].source_size]
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    assert len({round(targets[s] / weight[s], 6) for s in free}) == 1
    for rs in by_source.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1
        assert all(r.taken in (0, r.size, 2 * r.size) for r in rs)
    again = mixing.plan_mix(make_docs(rows[::-1])).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mixed_rows_follow_the_plan(odd):
    plan = mixing.plan_mix(odd).collect()
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r.copies for r in plan)
    assert {r.size for r in plan if r.doc_id in (2, 3, 6)} == {0}


def test_a_third_of_all_ids_null(make_docs):
    rows = [(None if i % 3 == 0 else i, f"text number {i} of so many words", "en", "ab"[i % 2], i) for i in range(300)]
    rows += [(700, "five words in this text", "en", "a", n) for n in (1, 2)] + [(700, "other five words of 700", "en", "a", 3)]
    kept = [sorted(map(str, mixing.mixed(make_docs(r)).collect())) for r in (rows, rows[::-1])]
    assert kept[0] == kept[1]
    plan = mixing._planned(make_docs(rows)).collect()
    assert sum(r.copies for r in plan) == len(kept[0])
    # Rows without an id have places of their own in their source's order, not one that all share.
    taken = {r.copies for r in plan if r.doc_id is None and r.source == "b"}
    assert len(taken) == 2 or taken == {2}


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
            "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right_check_digit(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and right_check_digit(digits or "1"), "phone": 8 <= len(digits) <= 15}[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = ["a@b.c_d@e.f", "x..y@z-.q.", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.0.0.1", "4111 1111-1111 1111", "4111111111111112", "+1 (314) 555-6532 4663622617512349",
          "++1 23 45 67 8)", "a@@b.c", "@b.c", "\U0001f642 me@x.yz é 10.0.0.1", "+12345678 +1234567", "1" * 5000 + " 9" * 3000, "a" * 20000 + "@", "k@k.k " * 300,
          "4663622617512349 4663622617512349", "+1-202-555-0143.", "12.34.56.78 9"]


def test_base_spans_by_brute_force(make_docs):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*TRICKY, *[r[1] for r in ODD_ROWS if r[1] is not None]])]
    got = {r.doc_id: r for r in pii.digests(pii.pii_spans(make_docs(rows))).collect()}
    for i, t, *_ in rows:
        want = base_spans(t)
        assert got[i].base_sha256 == sha(",".join(want)), t[:80]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(w.startswith(k) for w in want) for k in PATTERNS)
        assert set(want) <= set(got[i].spans.split(","))


def test_cards_of_single_digits(make_docs):
    spaced, hyphened = " ".join("4" + "1" * 15), "-".join("4" + "1" * 15)
    texts = [spaced, f"pay {hyphened} now", "4 1-1 1 1-1 1 1 1-1 1 1 1 1 1 1", " ".join("4" + "1" * 14 + "2"), "1.2.3.4", "1 2", "5"]
    got = {r.doc_id: r for r in pii.digests(pii.pii_spans(make_docs([(i, t, "en", "s", 0) for i, t in enumerate(texts)]))).collect()}
    assert [got[i].n_card for i in range(len(texts))] == [1, 1, 1, 0, 0, 0, 0] and got[4].n_ip == 1
    assert all(got[i].spans == ",".join(base_spans(t)) and got[i].base_sha256 == sha(",".join(base_spans(t))) for i, t in enumerate(texts))


def test_trees_add_what_stands_side_by_side(make_docs):
    def card(i):
        body = f"4{i * 7919 % 10 ** 14:014d}"
        return next(body + str(d) for d in range(10) if right_check_digit(body + str(d)))

    rows = [(i, f"call +1 (3{i % 90 + 10}) 555-{1000 + i} or pay {card(i)} from 10.{i % 256}.3.4, me{i}@mail{i % 7}.example.com ok", "en", "s", 0) for i in range(300)]
    both = f"so +1 (314) 555-6532 {card(5)} ok"
    rows += [(1000, both, "en", "s", 0), (1001, "version 3 of 12 parts, 1.2 and 4711081547110815 too", "en", "s", 0), (1002, "none at all", "en", "s", 0)]
    got = {r.doc_id: r for r in pii.digests(pii.pii_spans(make_docs(rows))).collect()}
    a, b = both.index("+1"), both.index("4", 20)
    assert got[1000].n_card == got[1000].n_phone == 0
    assert got[1000].spans == f"card:{b}:{b + 16},phone:{a}:{a + 17}"
    assert got[1001].spans == "" and got[1002].spans == ""
    assert all(got[i].spans == ",".join(base_spans(rows[i][1])) for i in range(300))


def test_spelled_addresses(make_docs):
    rows = [(i, f"host {i * 37 % 224}.{i % 256}.{i * 11 % 256}.{i * 7 % 256} and 400.{i}.1.2, write to me{i}@mail{i % 7}.example.com ok", "en", "s", 0) for i in range(300)]
    spelled = {1000: "10[.]20[.]30[.]40", 1001: "10 (dot) 20 (dot) 30 (dot) 40", 1002: "192[dot]168[dot]1[dot]254"}
    wrong = {2000: "400[.]20[.]30[.]40", 2001: "10[.]20[.]30", 2002: "see [1] (dot) 2", 2003: "999(.)999(.)999(.)999"}
    rows += [(i, f"é host {t} ok", "en", "s", 0) for i, t in {**spelled, **wrong}.items()]
    got = {r.doc_id: r for r in pii.digests(pii.pii_spans(make_docs(rows))).collect()}
    assert {i: got[i].spans for i in spelled} == {i: f"ip:7:{7 + len(t)}" for i, t in spelled.items()}
    assert all(got[i].spans == "" for i in wrong) and all(got[i].n_ip == 0 for i in [*spelled, *wrong])


def test_redaction(make_docs):
    spans = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for k, a, b in ((3, 2, 5), (0, 4, 7), (1, 9, 10))])
    assert make_docs([(1, "abédefghij", "en", "s", 0)]).select(pii.redacted(F.col("text"), spans).alias("t")).first().t == "ab[phone]hi[ip]"


# --- tool calls

CALLS = "conv_id long, seq long, call_id string, name string, arguments string, needs array<string>"


def link(spark, calls, results):
    rows = toolcalls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "call_id string, seq long, content string"), toolcalls.TOOLS)
    return {r.call_id: r for r in rows.collect()}


def test_links_order_and_errors(spark):
    ok = '{"limit": 3, "query": "q"}'
    calls = [(1, 1, "late", "search", ok, ["b"]), (1, 2, "child", "search", ok, ["late"]), (1, 3, "b", "search", ok, []), (1, 4, "x", "search", ok, ["y"]),
             (1, 5, "y", "search", ok, ["x"]), (1, 6, "z", "search", ok, ["nowhere"]), (1, 7, "own", "search", ok, ["b"]), (1, 9, "b", "dance", "{}", []), (1, 8, None, "search", ok, []),
             (2, 1, "bad", "search", '{"query": 4, "limit": 1.5, "more": null}', []), (2, 2, "no", "search", "[1]", None), (2, 3, "twice", "search", '{"query":"a","query":"b"}', None),
             (2, 4, "what", None, "{}", None), (2, 5, "nul", "translate", '{"text": null, "target": "é\\n"}', None), (2, 6, "empty", "search", None, None)]
    got = link(spark, calls, [("b", 2, "second"), ("b", 1, "first"), ("ghost", 1, "?"), (None, 1, "!"), ("own", 1, None)])
    assert (got["b"].status, got["b"].n_calls, got["b"].n_results, got["b"].order_key) == ("linked", 2, 2, 3)
    place = {k: (r.order_key, r.order_depth) for k, r in got.items() if r.order_key is not None}
    assert place["b"] < place["late"] < place["child"] and place["b"] < place["own"] == (7, 0)
    assert "x" not in place and "y" not in place and got["z"].status == "missing_need" and got["ghost"].status == "orphan_result" and None not in got
    assert got["bad"].errors == "extra:more,type:limit,type:query" and got["no"].errors == got["twice"].errors == got["empty"].errors == "not_an_object"
    assert got["what"].errors == "unknown_tool" and got["nul"].errors == "missing:text"
    assert got["b"].canonical == '{"arguments":{"limit":3,"query":"q"},"call_id":"b","name":"search","result":"first"}'
    assert '"arguments":{"target":"é\\n","text":null}' in got["nul"].canonical


def test_ids_that_recur_keep_all_their_rows(spark):
    ok = '{"limit": 3, "query": "q"}'
    calls = [(c, 1, "call_0", "search", ok, []) for c in (1, 2, 3, None)] + [(c, 2, "call_1", "search", ok, ["call_0"]) for c in (1, 2)]
    calls += [(1, 3, "call_0", "dance", "{}", []), (2, 4, None, "search", ok, []), (2, 5, None, "search", ok, []), (4, 1, "call_1", "search", ok, ["call_0"])]
    results = [(c, "call_0", 2, f"of {c}") for c in (1, 2, None)] + [(2, "call_0", 3, "again"), (2, None, 6, "lost"), (5, "call_0", 1, "orphan")]
    rows = toolcalls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, call_id string, seq long, content string"), toolcalls.TOOLS)
    got = sorted(((r.conv_id or 0, r.call_id or "", r.seq or 0, r.status, r.n_calls, r.n_results, r.order_key, json.loads(r.canonical)["result"]) for r in rows.collect()), key=str)
    want = [(0, "call_0", 1, "linked", 1, 1, 1, "of None"), (1, "call_0", 1, "linked", 2, 1, 1, "of 1"), (1, "call_0", 3, "duplicate_call", 1, 0, None, None),
            (1, "call_1", 2, "no_result", 1, 0, 2, None), (2, "", 4, "no_id", 1, 0, None, None), (2, "", 5, "no_id", 1, 0, None, None), (2, "", 6, "no_id", 0, 1, None, "lost"),
            (2, "call_0", 1, "linked", 1, 2, 1, "of 2"), (2, "call_0", 3, "duplicate_result", 0, 1, None, "again"), (2, "call_1", 2, "no_result", 1, 0, 2, None),
            (3, "call_0", 1, "no_result", 1, 0, 1, None), (4, "call_1", 1, "missing_need", 1, 0, 1, None), (5, "call_0", 0, "orphan_result", 0, 1, None, "orphan")]
    assert got == sorted(want, key=str)


def _places(n: dict[str, int], needs: dict[str, list[str]]) -> dict[str, tuple[int, int] | None]:
    """One by one: the last (seq, number of calls in between) over all ways down; None in and behind cycles."""
    def of(c, above):
        if c in above:
            return None
        lower = [of(d, above | {c}) for d in needs.get(c, []) if d in n]
        return None if None in lower else max([(n[c], 0), *[(k, d + 1) for k, d in lower]])
    return {c: of(c, frozenset()) for c in n}


@pytest.mark.parametrize("seed", range(3))
def test_places_one_by_one(spark, seed):
    """Chains forward, calls with several needs, hubs, cycles, calls behind cycles, equal seqs, unknown and repeated needs."""
    draw = random.Random(seed)
    n = {f"c{i}": draw.randrange(30) for i in range(40)}
    reach = lambda i: i + 4 if seed and draw.random() < 0.06 else i
    needs = {c: [f"c{draw.randrange(max(0, i - 6), reach(i))}" for _ in range(draw.choice([0, 1, 1, 2, 3]) if i else 0)] for i, c in enumerate(n)}
    needs.update({f"c{i}": ["c0", "c0"] for i in range(36, 40)} | ({"c32": ["c33"], "c33": ["c32", "c5"], "c34": ["c33"]} if seed else {}))
    edges = [(c, d) for c, found in needs.items() for d in found] + [(None, "c1"), ("c1", None)]
    got = toolcalls.topological(spark.createDataFrame(list(n.items()), "call_id string, seq long"), spark.createDataFrame(edges, "call_id string, need string"))
    want = _places(n, needs)
    assert {r.call_id: r.order_key is not None and (r.order_key, r.order_depth) or None for r in got.collect()} == want
    assert any(p is not None and p[1] > 1 for p in want.values()) and (seed == 0 or None in want.values())


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, real = [], toolcalls.written
    monkeypatch.setattr(toolcalls, "written", lambda df, label: rounds.append(label) or real(df, label))
    calls = spark.range(1000).select(F.col("id").cast("string").alias("call_id"), F.col("id").alias("seq"))
    edges = spark.range(999).select(F.col("id").cast("string").alias("call_id"), (F.col("id") + 1).cast("string").alias("need"))
    places = {int(r.call_id): (r.order_key, r.order_depth) for r in toolcalls.topological(calls, edges).collect()}
    assert places == {i: (999, 999 - i) for i in range(1000)} and rounds.count("jumps") <= 12


def test_turns_keep_all_their_rows(spark):
    """Null ids and conversations, repeated turns, all roles, empty and long texts, clashing names."""
    turns = [(1, 0, "system", "s"), (1, 1, "user", "abcde"), (1, 2, "assistant", "r"), (1, 3, "user", "ab"), (1, 3, "user", "ab"), (1, 4, "assistant", None), (1, 4, "assistant", "again"),
             (None, 1, "user", "x" * 100_000), (None, 2, "assistant", ""), (2, None, "user", "t"), (2, None, "assistant", "t"), (3, 0, None, None), (4, 0, "user", ""), (4, 7, "assistant", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("other") for c in ("call_id", "seq", "name", "_row", "need")})
    rows = toolcalls.link_calls(*toolcalls.turns_as_calls(df), toolcalls.TOOLS).collect()
    assert sum(r.n_calls for r in rows if r.status.startswith(("no_id", "dup"))) == 2 and len(rows) == 11
    got = {(r.conv_id, r.call_id): r for r in rows if not r.status.startswith(("no_id", "dup"))}
    assert (got[1, "1"].order_key, got[1, "1"].order_depth, got[1, "3"].n_calls, got[1, "3"].n_results) == (3, 1, 2, 2)
    assert {k: r.status for k, r in got.items()} == {(1, "0"): "no_result", (1, "1"): "linked", (1, "3"): "linked", (None, "1"): "linked", (3, "0"): "no_result",
                                                     (4, "0"): "no_result", (4, "6"): "orphan_result"}


def test_no_calls(spark):
    assert link(spark, [], []) == {}
    assert [r.status for r in link(spark, [], [("a", 1, "x")]).values()] == ["orphan_result"]


def test_thresholds_come_from_all_that_is_held_out(make_docs):
    docs = make_docs([(i, f"write to person{i}@host{i % 7}.example.org or call +1 314 555 {1000 + i}, not 300.{i}.1.2", "en", "a", 0) for i in range(120)])
    spans = pii.candidates(docs).select("_row", F.inline("found")).cache()
    (few, held), (many, same) = (tuple(rows.count() for rows in pii.examples(spans, n)) for n in (3, 10_000))
    accepted = spans.where("rule AND base").count()
    assert held == same > 3 * 2 * 4 and few < many and many + held == spans.where("rule").count() + 2 * accepted
