"""Tool-call linking: calls joined with their results by id, ordered after what they need, checked against schemas, as canonical JSON."""

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.session import written

#: JSON type -> what the type of a parsed value begins with.
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"],
          "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def canonical(arguments: Column) -> Column:
    """JSON text with keys in code point order, no blanks, numbers in shortest form; null if it is not JSON or repeats a key."""
    return F.to_json(F.try_parse_json(arguments))


def schema_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments, in code point order; empty if nothing.

    ``schemas``: tool -> parameter -> (JSON type, required). A null value counts as missing.
    """
    parsed = F.try_parse_json(arguments)
    whole = F.schema_of_variant(parsed)

    def against(parameters: dict[str, tuple[str, bool]]) -> Column:
        found = []
        for p, (kind, required) in parameters.items():
            # Not a path that can fail: the key is a literal of the schema.
            has = F.schema_of_variant(F.try_variant_get(parsed, f"$['{p}']", "variant"))
            missing = has.isNull() | (has == "VOID")
            fits = has.rlike("^(" + "|".join(_TYPES[kind]) + ")")
            found.append(F.when(missing, F.lit(f"missing:{p}") if required else F.lit(None).cast("string")).when(~fits, F.lit(f"type:{p}")))
        extra = F.transform(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, parameters))), lambda k: F.concat(F.lit("extra:"), k))
        return F.array_sort(F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), F.coalesce(extra, F.array().cast("array<string>"))))

    checked = F.array(F.lit("unknown_tool"))
    for tool, parameters in schemas.items():
        checked = F.when(name == tool, against(parameters)).otherwise(checked)
    return F.when(whole.isNull() | ~F.startswith(whole, F.lit("OBJECT")), F.array(F.lit("not_an_object"))).otherwise(checked)


def _shifted(at: Column, hops: Column) -> Column:
    """A place seen from ``hops`` calls further on; null if there is none."""
    return F.when(at.isNotNull(), F.struct(at["key"].alias("key"), (at["depth"] + hops).alias("depth")))


def _chain_ends(edges: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Where the calls with one open need lead to: (call_id, to, hops, at), and those that only lead round a cycle.

    Pointers are doubled: after k rounds each has passed 2^k calls, or stands at a call without or with several open needs. ``at`` is the last place
    among the calls passed, as seen from ``call_id``.
    """
    single = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("to"), F.first("hops").alias("hops")).where("n = 1")
    jumps = written(single.drop("n").join(state, "call_id"), "jumps")
    before = None
    while True:
        on = jumps.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"), F.col("at").alias("passed"))
        live = jumps.join(on.select("to"), "to", "left_semi").count()
        if live == 0 or live == before:
            break
        before = live
        jumps = written(jumps.join(on, "to", "left").select(
            "call_id", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0).cast("long"))).alias("hops"),
            F.greatest("at", _shifted(F.col("passed"), F.col("hops"))).alias("at")), "jumps")
    if live == 0:
        return jumps, None
    # Distances to an end have no gaps, so a round that ends no chain has met all that end.
    pointers = jumps.select(F.col("call_id").alias("to"))
    return jumps.join(pointers, "to", "left_anti"), jumps.join(pointers, "to", "left_semi").select("call_id")


def topological(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``call_id, seq`` and ``call_id, need`` -> ``call_id, order_key, order_depth``: needed calls sort first by (key, depth).

    A call's place is the last (seq, calls in between) of all calls it needs, directly or not, itself included: one that needs earlier ones only
    keeps its own seq and depth 0, the others come after the last of what they need, one depth below it. Chains are passed by doubling pointers, so one of n
    calls takes log n rounds; then the calls with several open needs are placed, a round for each such call on a path. What waits for itself has
    null keys. Needs that are no known call and null ids or needs are ignored, repeated needs count once. ``call_id`` must be unique; no calls: no rows.
    """
    calls = calls.select("call_id", F.col("seq").cast("long").alias("seq"))
    needs = calls.select(F.col("call_id").alias("need"), F.col("seq").alias("need_seq"))
    edges = written(edges.join(calls, "call_id").join(needs, "need").select("call_id", "seq", "need", "need_seq").distinct(), "needs")
    if edges.where(F.col("need_seq") >= F.col("seq")).isEmpty():
        return calls.select("call_id", F.col("seq").alias("order_key"), F.lit(0).cast("long").alias("order_depth"))
    start = calls.select("call_id", F.struct(F.col("seq").alias("key"), F.lit(0).cast("long").alias("depth")).alias("at"))
    edges = edges.select("call_id", "need", F.lit(1).cast("long").alias("hops"))
    needing = edges.select("call_id").distinct()
    placed = written(start.join(needing, "call_id", "left_anti"), "placed")
    state = written(start.join(needing, "call_id", "left_semi"), "open-calls")
    while True:
        jumps, stuck = _chain_ends(edges, state)
        if stuck is not None:
            edges = edges.join(stuck, "call_id", "left_anti")
        via = jumps.select(F.col("call_id").alias("need"), "to", F.col("hops").alias("more"), F.col("at").alias("passed"))
        done = placed.select(F.col("call_id").alias("to"), F.col("at").alias("there"))
        moved = edges.join(via, "need", "left").select(
            "call_id", F.coalesce("to", "need").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0).cast("long"))).alias("hops"),
            _shifted(F.col("passed"), F.col("hops")).alias("passed"))
        moved = written(moved.join(done, "to", "left").select(
            "call_id", "to", "hops", F.greatest("passed", _shifted(F.col("there"), F.col("hops"))).alias("gained"), F.col("there").isNull().alias("open")), "moved")
        gains = moved.groupBy("call_id").agg(F.max("gained").alias("gained"), F.max("open").alias("open"))
        state = written(state.join(gains, "call_id").select("call_id", F.greatest("at", "gained").alias("at"), "open"), "open-calls")
        ready = state.where(~F.col("open")).select("call_id", "at")
        if ready.isEmpty():
            break
        placed = written(placed.unionByName(ready), "placed")
        state = state.where("open").select("call_id", "at")
        edges = written(moved.where("open").groupBy("call_id", F.col("to").alias("need")).agg(F.max("hops").alias("hops")), "needs")
    return calls.select("call_id").join(placed, "call_id", "left").select(
        "call_id", F.col("at.key").alias("order_key"), F.col("at.depth").alias("order_depth"))


def _line(call_id: Column) -> Column:
    return F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), call_id.alias("call_id"), F.col("name"), F.col("content").alias("result")),
                     {"ignoreNullFields": "false"})


def _linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]], shown=lambda call_id: call_id, row: tuple[str, ...] = ()) -> DataFrame:
    """One row an id. ``row`` names a column of row numbers: the call's is returned, and the result's as ``_result_row``."""
    fields = ["seq", "conv_id", "name", "arguments", "needs", *row]
    one = calls.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min(F.struct(*fields)).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    one = written(one.select("call_id", "c.*", "n_calls"), "calls")
    answers = results.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(
        F.min(F.struct("seq", "content", *row)).alias("r"), F.count(F.lit(1)).alias("n_results"))
    answers = answers.select("call_id", F.col("r.content").alias("content"), "n_results", *[F.col(f"r.{c}").alias("_result_row") for c in row])

    edges = one.select("call_id", F.explode("needs").alias("need"))
    known = one.select(F.col("call_id").alias("need"))
    lacking = edges.join(known, "need", "left_anti").select("call_id").distinct().withColumn("_lacks", F.lit(True))
    order = topological(one.select("call_id", "seq"), edges)

    both = one.join(answers.hint("shuffle_hash"), "call_id", "full").join(order, "call_id", "left").join(lacking, "call_id", "left")
    status = (F.when(F.col("n_calls").isNull(), "orphan_result").when(F.col("_lacks"), "missing_need")
              .when(F.col("n_results").isNull(), "no_result").otherwise("linked"))
    line = _line(shown(F.col("call_id")))
    errors = F.when(F.col("n_calls").isNotNull(), F.concat_ws(",", schema_errors(F.col("name"), F.col("arguments"), schemas)))
    return both.select("conv_id", "call_id", "seq", "name", status.alias("status"), errors.alias("errors"),
                       F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
                       "order_key", "order_depth", line.alias("canonical"), *row, *["_result_row" for _ in row])


def _key(conv_id: Column, call_id: Column) -> Column:
    """Conversation and id as one text, which ``_conversation`` and ``_id_of`` take apart; null for a null id."""
    conv = conv_id.cast("string")
    return F.concat(F.coalesce(F.concat(F.char_length(conv).cast("string"), F.lit(":"), conv), F.lit("-:")), call_id)


def _conversation(key: Column) -> Column:
    head = F.substring_index(key, ":", 1)
    return F.substring(key, F.char_length(head) + 2, head.try_cast("int"))


def _id_of(key: Column) -> Column:
    head = F.substring_index(key, ":", 1)
    return F.substring(key, F.char_length(head) + 2 + F.coalesce(head.try_cast("int"), F.lit(0)), F.char_length(key))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """``calls`` (conv_id, seq, call_id, name, arguments, needs) with ``results`` (call_id, seq, content, and conv_id unless ids are unique).

    Returns ``conv_id, call_id, seq, name, status, errors, n_calls, n_results, order_key, order_depth, canonical``. Status: ``linked``, ``no_result``,
    ``orphan_result`` for results of no call, ``missing_need`` if a needed id is no call. Of calls that repeat an id the first by seq stands,
    and of results the first by seq; both are counted, and reduced on the map side, so an id of a third of all rows does no
    harm to the join. Without ``conv_id`` in ``results`` ids stand alone: one row an id, and rows with null ids are left out.

    With it, calls, needs and results meet by (conv_id, call_id), a null conversation being one of its own, and no row is left out: the other calls of a
    repeated id follow as ``duplicate_call``, its other results as ``duplicate_result``, and rows with a null id as ``no_id``. These are not linked:
    they count themselves only, calls are checked against their schema, and their place is null; n_calls and n_results of the first row count all. Within a conversation (order_key, order_depth) sorts calls after
    what they need; it is null in a cycle, and for orphans. Null names or arguments fail their schema. Empty tables: no rows. Other
    columns are not used.
    """
    if "conv_id" not in results.columns:
        return _linked(calls, results, schemas)
    # Numbered once and written, so that a row can be told from its repetitions without a join on the id.
    calls = written(calls.select("conv_id", "seq", "call_id", "name", "arguments", "needs", F.monotonically_increasing_id().alias("_row")), "all-calls")
    results = written(results.select("conv_id", "seq", "call_id", "content", F.monotonically_increasing_id().alias("_row")), "all-results")
    key = _key(F.col("conv_id"), F.col("call_id"))
    needs = F.transform("needs", lambda n: _key(F.col("conv_id"), n))
    linked = written(_linked(calls.withColumns({"call_id": key, "needs": needs}), results.withColumn("call_id", key), schemas, _id_of, ("_row",)), "linked")
    first = linked.withColumns({"conv_id": _conversation(F.col("call_id")).cast(calls.schema["conv_id"].dataType), "call_id": _id_of(F.col("call_id"))})
    other = lambda rows, at: rows.join(linked.select(F.col(at).alias("_row")).where("_row IS NOT NULL"), "_row", "left_anti")
    left_calls = other(calls, "_row").withColumns({"content": F.lit(None).cast("string"), "_call": F.lit(True)})
    left_results = other(results, "_result_row").withColumns({"name": F.lit(None).cast("string"), "arguments": F.lit(None).cast("string"), "_call": F.lit(False)})
    rest = left_calls.drop("needs").unionByName(left_results)
    status = F.when(F.col("call_id").isNull(), "no_id").when(F.col("_call"), "duplicate_call").otherwise("duplicate_result")
    errors = F.when(F.col("_call"), F.concat_ws(",", schema_errors(F.col("name"), F.col("arguments"), schemas)))
    nowhere = F.lit(None).cast("long")
    rest = rest.select("conv_id", "call_id", "seq", "name", status.alias("status"), errors.alias("errors"), F.col("_call").cast("long").alias("n_calls"),
                       (~F.col("_call")).cast("long").alias("n_results"), nowhere.alias("order_key"), nowhere.alias("order_depth"), _line(F.col("call_id")).alias("canonical"))
    return first.drop("_row", "_result_row").unionByName(rest)


#: The tools that turns of plain conversations are read as calls of.
TOOLS = {"search": {"query": ("string", True), "limit": ("integer", False)},
         "translate": {"text": ("string", True), "target": ("string", True)},
         "summarise": {"text": ("string", True), "max_words": ("integer", True)}}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations read as tool use: a turn of any role but assistant is a call, the assistant's turn after it its result.

    By its number of characters a user's turn needs the call two turns before, the one two turns after, none or both, so there are chains that
    point forward and cycles. The tool, and what is wrong with some calls, follow from conversation, turn and length. Every turn gives one row: a null
    text is empty, a null turn gives a null id, null conversations are one of their own, repeated turns repeat an id.
    """
    text, n = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    at = lambda steps: (F.col("turn") + steps).cast("string")
    which = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8))
    search = F.to_json(F.struct(text.alias("query"), n.alias("limit")))
    translate = F.when(n % 5 == 0, F.to_json(F.struct(text.alias("text")))).otherwise(F.to_json(F.struct(text.alias("text"), F.lit("en").alias("target"))))
    summarise = F.when(n % 3 == 0, F.to_json(F.struct(text.alias("text"), n.cast("string").alias("max_words")))).otherwise(
        F.to_json(F.struct(text.alias("text"), n.alias("max_words"), F.lit(True).alias("deep"))))
    user = F.col("role").eqNullSafe("user") & F.col("turn").isNotNull()
    before, after = F.when(user & (n % 4).isin(0, 3) & (F.col("turn") >= 2), at(-2)), F.when(user & (n % 4).isin(1, 3), at(2))
    calls = turns.where(~F.col("role").eqNullSafe("assistant")).select(
        "conv_id", F.col("turn").cast("long").alias("seq"), at(0).alias("call_id"),
        F.when(which < 3, "search").when(which < 5, "translate").when(which < 7, "summarise").otherwise("dance").alias("name"),
        F.when(which < 3, search).when(which < 5, translate).when(which < 7, summarise).otherwise(F.lit("{}")).alias("arguments"),
        F.array_compact(F.array(before, after)).alias("needs"))
    replies = turns.where(F.col("role") == "assistant").select("conv_id", at(-1).alias("call_id"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("content"))
    return calls, replies
