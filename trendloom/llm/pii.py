"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

The base rules' spans always stay. What the trees add are spans the base rules miss, above all data that stand
next to each other, where a base pattern takes both and then drops the match. Labels come from the base
rules themselves: their accepted spans, against the ones they refuse, spoiled copies, and copies inside longer
tokens. All of it is DataFrame work; the trees are ``pyspark.ml``'s.
"""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from trendloom.llm.common import text_of
from trendloom.session import written

KINDS = ("email", "ip", "card", "phone")

#: The base rules' patterns. Possessive where nothing can be given back, and started only where a match can
#: start, so that no long run of letters or digits is read again and again or fills the stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the generators look for besides.
WIDER = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{4,7}(?![0-9A-Za-z])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])"),
    ("phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
#: Spelled marks in what the generators find, and what they stand for.
_SPELLED = ((r"\x20?(?:\(at\)|\[at\])\x20?", "@"), (r"\x20?(?:\(dot\)|\[dot\]|\(\.\)|\[\.\])\x20?", "."))
#: What a text must have for a pattern of the kind to match in it; cheaper to look for than the pattern.
_GATES = {"ip": r"[0-9]\.", "card": r"[0-9][\x20-]?[0-9]", "phone": "[0-9]{2}"}
CONTEXT = 16
_PARTS = 64
FEATURES = ("kind", "n_chars", "n_digits", "n_letters", "n_signs", "n_groups", "longest_group", "plus", "at", "tail_letters",
            "check_digit", "largest_part", "letter_before", "digit_before", "letter_after", "digit_after", "mark_before")


def _sums_before(lengths: Column) -> Column:
    """Exclusive running sums. Runs of 64 first, then over the runs, so that long arrays are not copied for each item."""
    def sums(a):  # one entry more than ``a``: the last is the total
        return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(64)), lambda i: sums(F.slice(lengths, i + 1, 64)))
    whole = F.transform(F.array(runs), lambda r: F.zip_with(r, F.slice(sums(F.transform(r, lambda x: F.element_at(x, -1))), F.lit(1), F.size(r)),
                        lambda run, offset: F.transform(F.slice(run, F.lit(1), F.size(run) - 1), lambda x: x + offset)))[0]
    return F.flatten(whole)


def _found(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Spans of a pattern, leftmost and non-overlapping, in code points from 0, with what stands around them."""
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: g)

    def located(both):
        gaps, spans = both["gaps"], both["spans"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(spans)), spans, lambda g, s: (F.char_length(g) + F.char_length(s)).cast("long"))
        return F.transform(F.zip_with(_sums_before(steps), spans, lambda p, s: F.struct(p.alias("p"), s.alias("s"))), lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), (x.p + F.char_length(F.get(gaps, i))).alias("start"),
            (x.p + F.char_length(F.get(gaps, i)) + F.char_length(x.s)).alias("end"), F.lit(base).alias("rule"), x.s.alias("span"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")))

    some = F.transform(F.array(F.struct(gaps.alias("gaps"), spans.alias("spans"))), located)[0]
    may = F.contains(text, F.lit("@")) | F.contains(text, F.lit("at")) if kind == "email" else F.contains(text, F.lit("+")) if pattern == BASE["phone"] else text.rlike(_GATES[kind])
    if pattern == BASE["email"]:
        may = F.contains(text, F.lit("@"))
    elif kind == "ip" and not base:
        may = text.rlike(r"[0-9]\x20?[\[(][.d]")
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,rule:boolean,span:string,before:string,after:string>>")
    return F.when(may & (F.size(spans) > 0), some).otherwise(empty)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(span: Column) -> Column:
    """Whether the span's digits have a right check digit."""
    reverse = F.reverse(_digits(span))
    places = F.sequence(F.lit(1), F.greatest(F.length(reverse), F.lit(1)))
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + F.transform(F.array(F.coalesce(F.substring(reverse, i, F.lit(1)).try_cast("int"), F.lit(0)) * (2 - i % 2)),
                                                                          lambda x: F.when(x > 9, x - 9).otherwise(x))[0])
    return (F.length(reverse) > 0) & (total % 10 == 0)


def _parts_fit(span: Column) -> Column:
    short = lambda x: F.ltrim(x, F.lit("0"))
    return F.forall(F.split(span, r"\."), lambda x: (F.length(short(x)) <= 2) | ((F.length(short(x)) == 3) & (short(x) <= "255")))


def accepted(kind: Column, span: Column) -> Column:
    """The base rules' verdict on a match of a base pattern."""
    n = F.length(_digits(span))
    return (F.when(kind == 0, F.lit(True)).when(kind == 1, _parts_fit(span)).when(kind == 2, F.when(n.between(16, 19), luhn(span)).otherwise(False))
            .otherwise(n.between(8, 15)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, doc_id, found``: every generator's spans of each text; ``rule``: by a base pattern, ``base``: and accepted by its rule."""
    text = F.col("_text")
    arrays = [_found(text, p, k, True) for k, p in BASE.items()] + [_found(text, p, k, False) for k, p in WIDER]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    rows = rows.select("_row", "doc_id", F.concat(*arrays).alias("found"))
    return rows.select("_row", "doc_id", F.transform("found", lambda x: x.withField("base", x.rule & accepted(x.kind, x.span))).alias("found"))


def featured(spans: DataFrame) -> DataFrame:
    """With ``FEATURES`` of ``kind, span, before, after``: format and context, no text and no position. Spelled marks count as what they stand for."""
    for spelled, mark in _SPELLED:
        spans = spans.withColumn("span", F.regexp_replace("span", spelled, mark))
    span, count = F.col("span"), lambda p: F.regexp_count("span", F.lit(p))
    groups = F.transform(F.regexp_extract_all(span, F.lit("[0-9]+"), F.lit(0)), F.length)
    before, after = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    parts = F.transform(F.split(span, r"\."), lambda x: F.coalesce(F.left(F.regexp_replace(x, "[^0-9]", ""), F.lit(6)).try_cast("int"), F.lit(0)))
    values = {
        "n_chars": F.char_length("span"), "n_digits": F.length(_digits(span)), "n_letters": count("[A-Za-z]"),
        "n_signs": count(r"[\x20().-]"), "n_groups": F.size(groups), "longest_group": F.coalesce(F.array_max(groups), F.lit(0)),
        "plus": F.startswith("span", F.lit("+")), "at": F.contains("span", F.lit("@")),
        "tail_letters": F.length(F.regexp_extract(span, "[A-Za-z]*$", 0)), "check_digit": F.when(F.col("kind") == 2, luhn(span)).otherwise(False),
        "largest_part": F.when(F.col("kind") == 1, F.array_max(parts)).otherwise(0),
        "letter_before": before.rlike(r"\p{L}"), "digit_before": before.rlike("[0-9]"), "letter_after": after.rlike(r"\p{L}"),
        "digit_after": after.rlike("[0-9]"), "mark_before": before.rlike("[=:/#&?_]"),
    }
    spans = spans.withColumns({k: v.cast("double") for k, v in values.items()})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(spans.withColumn("kind", F.col("kind").cast("double")))


def _spoiled(good: DataFrame) -> DataFrame:
    """Copies of accepted spans that no rule should accept: a wrong check digit, part, length or ending, or inside a longer token."""
    pick = F.pmod(F.xxhash64("span", "start"), F.lit(8)).cast("int")
    kind, span = F.col("kind"), F.col("span")
    wrong = (F.when(kind == 2, F.concat(F.left(span, F.length(span) - 1), ((F.right(span, F.lit(1)).cast("int") + 1 + pick) % 10).cast("string")))
             .when(kind == 1, F.concat((F.lit(256) + pick * 90).cast("string"), F.regexp_extract(span, r"\..*$", 0)))
             .when((kind == 3) & (pick % 2 == 0), F.left(span, F.lit(6)))
             .when(kind == 3, F.concat(span, F.regexp_replace(span, "[^0-9]", "")))
             .otherwise(F.concat(F.regexp_extract(span, "^[^@]*@[^.]*", 0), F.lit("."), (pick + 10).cast("string"))))
    inside = good.withColumn("before", F.when(pick % 2 == 0, F.concat("before", F.lit("x"))).otherwise(F.concat("before", F.lit("7")))).withColumn(
        "after", F.when(pick % 3 == 0, F.concat(F.lit("7"), "after")).otherwise(F.concat(F.lit("x"), "after")))
    return good.withColumn("span", wrong).unionByName(inside)


def examples(spans: DataFrame, per_kind: int) -> tuple[DataFrame, DataFrame]:
    """(to fit on, held out): labelled spans of the base rules, and spoiled copies of those accepted.

    A quarter by hash is held out, all of it. Of the others at most ``per_kind`` accepted and as many refused ones a kind, those of the smallest hashes, are
    fitted on. They are cut in ``_PARTS`` parts of each kind and class first, so that no task orders all spans of one.
    """
    known = spans.where("rule").withColumn("_hash", F.xxhash64("span", "before", "after")).withColumn("_fold", F.pmod("_hash", F.lit(4)) == 0)
    chosen = known.where("NOT _fold").withColumn("_part", F.pmod(F.xxhash64("_row", "start"), F.lit(_PARTS)))
    for parts in (["_part"], []):
        order = Window.partitionBy("kind", "base", *parts).orderBy("_hash", "span", "start")
        chosen = chosen.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= per_kind)

    def labelled(rows: DataFrame) -> DataFrame:
        rows = rows.select("kind", "start", "span", "before", "after", "base")
        return rows.withColumn("label", F.col("base").cast("double")).unionByName(_spoiled(rows.where("base")).withColumn("label", F.lit(0.0)))

    return labelled(chosen), labelled(known.where("_fold"))


def scored(spans: DataFrame, per_kind: int = 4000, precision: float = 0.99, bins: int = 50, trees: int = 16, depth: int = 4) -> DataFrame | None:
    """The wider generators' spans with ``score`` and ``chosen``; None where there is nothing to learn from.

    The trees are fitted on the bounded part of ``examples``. Thresholds are calibrated on all that is held out: for each kind the lowest score, 0.5 at
    least, from which on ``precision`` of what is selected is right.
    """
    fitted, held = examples(spans, per_kind)
    fitted, held = written(fitted, "pii-examples").coalesce(4), written(held, "pii-held-out")
    if any(rows.agg(F.count_distinct("label")).first()[0] < 2 for rows in (fitted, held)):
        return None
    model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, seed=7, maxMemoryInMB=64).fit(featured(fitted))
    score = vector_to_array("probability")[1]
    held = model.transform(featured(held)).select("kind", "label", F.floor(score * bins).alias("bin"))
    down = Window.partitionBy("kind").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    held = held.groupBy("kind", "bin").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n"))
    held = held.withColumn("share", F.sum("right").over(down) / F.sum("n").over(down)).where(F.col("share") >= precision)
    limits = {int(r.kind): max(0.5, r.low / bins) for r in held.groupBy("kind").agg(F.min("bin").alias("low")).collect()}  # four at most
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()], F.lit(2.0))
    rest = model.transform(featured(spans.where("NOT rule")))
    return rest.select("_row", F.col("kind").cast("int").alias("kind"), "start", "end", score.alias("score")).withColumn("chosen", F.col("score") >= limit)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``doc_id, base, added``: each text's spans (kind, start, end), ordered by kind, then start.

    ``base`` has what the base rules accept, ``added`` what the trees select beyond that: spans that overlap no base one,
    and of those that overlap each other the one with the best score. Null text: no spans. Null and repeated ids are carried through, a row for
    each row. Without labelled spans of both classes nothing is added. Empty table: no rows. Other columns are not used.
    """
    rows = written(candidates(docs, id_col, text_col), "pii-candidates")
    spans = rows.select("_row", F.posexplode("found").alias("_i", "c")).select("_row", "c.*")
    order = F.array_sort(F.transform(F.filter("found", lambda x: x.base), lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    base = rows.select("_row", "doc_id", order.alias("base"))
    chosen = scored(spans, **settings)
    if chosen is None:
        return base.select("doc_id", "base", none.alias("added"))
    picked = chosen.where("chosen").groupBy("_row").agg(F.collect_set(F.struct("kind", "start", "end", "score")).alias("picked"))
    picked = picked.withColumnRenamed("_row", "_picked")
    both = base.join(picked, base._row == picked._picked, "left")
    overlap = lambda a, b: (a.start < b.end) & (b.start < a.end)
    free = F.filter("picked", lambda x: ~F.exists("base", lambda b: overlap(x, b)))
    rank = lambda x: F.struct(x.score, x.end - x.start, -x.start, -x.kind)
    best = F.transform(F.array(free), lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: overlap(x, y) & (rank(y) > rank(x)))))[0]
    added = F.array_sort(F.transform(best, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))))
    return both.select("doc_id", "base", F.coalesce(added, none).alias("added"))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(F.greatest(acc["at"], x.end).alias("at"), F.when(x.start < acc["at"], acc["out"]).otherwise(F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x.start - acc["at"]).cast("int")), F.get(names, x.kind))).alias("out"))
    return F.aggregate(by_start, state, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))


def digests(found: DataFrame) -> DataFrame:
    """Counts, base digest and all spans, as text."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
                        shown(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
