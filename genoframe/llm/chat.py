"""Tool calls linked with their results, ordered, validated and written as canonical JSON.

All of it is DataFrame operations: no Python runs on rows.

Identifiers count within their conversation. Calls and results are joined by both.
Results are first brought to one for each identifier, so repeated rows do not multiply,
and a call takes the earliest result.

The order within a conversation is topological. A dependency that stands before its
call costs nothing, since the order of the messages has it right; one that stands
behind raises its call's level by one. Levels are the largest such sums over all chains
of dependencies, and calls are ordered by level and then by message. They are found by
letting each call follow the dependency that now has the highest level, adding these
chains up by pointer jumping, whose rounds double their reach, and choosing again until
nothing rises. Calls in or behind a cycle never reach the end of a chain; they come last.
Positions come from a sort over all rows that may split a conversation over many tasks.

Arguments are parsed as variants. A variant's objects have sorted keys, so writing it
gives canonical JSON: sorted keys at every level and no spaces. Schemas are tables: a row for
each place in a schema with its rules, and one for each step from a place to a property or to
the items. A call's arguments are taken apart level by level along these steps, by joins, as
deep as schemas go; only what breaks a rule is brought together again. An object with
``properties`` takes no others unless ``additionalProperties`` says so. A schema with a
keyword that is not among RULES or NOTES is an error.

Defined results: a call without a result, a result without a call, a repeated result
and a null identifier are statuses; a null conversation is one of its own; arguments that
are null or not a JSON object are invalid, and those that can't be parsed (which includes
objects that repeat a key) stand as text in the canonical record; calls of unknown tools are invalid; repeated
calls are rows of their own; an empty table gives none. Columns that are not named are
not read.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm.ranking import positions
from genoframe.llm.scratch import Scratch

#: Types of JSON Schema and the variant types that they take.
TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)",
    "boolean": "BOOLEAN",
    "object": "OBJECT.*",
    "array": "ARRAY.*",
    "null": "VOID",
}
#: Keywords of a schema that are checked, and those that say nothing on validity.
RULES = {"type", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "properties", "required", "additionalProperties", "items"}
NOTES = {"title", "description", "default", "examples", "$schema", "$comment", "format", "deprecated"}
NODE = (
    "node int, types array<string>, enum array<string>, minimum double, maximum double, min_length long, max_length long, min_items long, max_items long, "
    "required array<string>, names array<string>"
)
#: Rows up to which a table is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000
#: The level of calls in or behind a cycle.
NEVER = 1 << 40


def _small(df: DataFrame) -> DataFrame:
    """The written table, broadcast if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _listed(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    df = spark.createDataFrame(rows, kind)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def schema_rows(schemas: dict[str, dict]) -> tuple[list[tuple], list[tuple], list[tuple], int]:
    """Tools with their first places, places with their rules (see NODE), steps (from, name or
    null for items, to), and how many steps the longest way has."""
    nodes: list[tuple] = []
    steps: list[tuple] = []

    def add(schema, where: str) -> tuple[int, int]:
        if schema is True:
            schema = {}
        if not isinstance(schema, dict):
            raise ValueError(f"{where}: a schema must be an object, not {schema!r}")
        if unknown := set(schema) - RULES - NOTES:
            raise ValueError(f"{where}: keywords that are not checked: {', '.join(sorted(unknown))}")
        kinds = schema.get("type")
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if unknown := set(kinds or []) - set(TYPES):
            raise ValueError(f"{where}: no JSON type {', '.join(sorted(unknown))}")
        among = schema["enum"] if "enum" in schema else [schema["const"]] if "const" in schema else None
        closed = schema.get("additionalProperties", "properties" not in schema)
        if not isinstance(closed, bool):
            raise ValueError(f"{where}: additionalProperties must be true or false")
        own, number, deepest = schema.get("properties", {}), len(nodes), 0
        number_of = lambda key, kind: None if key not in schema else kind(schema[key])
        nodes.append((
            number, kinds, None if among is None else [json.dumps(x) for x in among], number_of("minimum", float), number_of("maximum", float), number_of("minLength", int), number_of("maxLength", int),
            number_of("minItems", int), number_of("maxItems", int), sorted(schema.get("required", [])), None if closed else sorted(own),
        ))
        for name, part in [*sorted(own.items()), *([(None, schema["items"])] if "items" in schema else [])]:
            to, depth = add(part, f"{where}.{name or 'items'}")
            steps.append((number, name, to))
            deepest = max(deepest, depth + 1)
        return number, deepest

    first = [(tool, *add(schema, tool)) for tool, schema in sorted(schemas.items())]
    return [f[:2] for f in first], nodes, steps, max([d for _, _, d in first], default=0)


def fits(value: Column, kinds: Column) -> Column:
    """Whether a variant is of one of the named types. A number without a fraction is an integer."""
    is_a = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    fraction_free = F.when(is_a.rlike("^DECIMAL"), text.rlike(r"^-?[0-9]+(\.0*)?$")).when(is_a.rlike("^(DOUBLE|FLOAT)"), number == F.floor(number)).otherwise(False)
    named = reduce(lambda any_, t: any_ | (F.array_contains(kinds, t) & is_a.rlike(f"^{TYPES[t]}$")), TYPES, F.lit(False))
    return F.coalesce(named | (F.array_contains(kinds, "integer") & fraction_free), F.lit(False))


def argument_errors(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``row`` and sorted ``wrong`` of calls (``row``, ``name``, ``arguments``) whose arguments
    are an object that breaks their tool's schema. A place is written as its names, with a
    slash between them, and the numbers of items."""
    spark = calls.sparkSession
    tools, nodes, steps, depth = schema_rows(schemas)
    tools, nodes = _listed(spark, tools, "tool string, node int"), _listed(spark, nodes, NODE)
    named = _listed(spark, [s for s in steps if s[1] is not None], "node int, step string, to int")
    items = _listed(spark, [(a, b) for a, n, b in steps if n is None], "node int, to int")
    parsed = F.try_parse_json("arguments")
    at = calls.select("row", "name", parsed.alias("v")).join(tools, F.col("name") == F.col("tool")).select("row", "node", F.lit("").alias("at"), "v")
    at = at.where(F.schema_of_variant("v").rlike("^OBJECT"))
    found = []
    for k in range(depth + 1):
        kind = F.schema_of_variant("v")
        with_rules = at.join(nodes, "node").withColumns({"obj": F.try_variant_get("v", "$", "map<string,variant>"), "arr": F.when(kind.rlike("^ARRAY"), F.try_variant_get("v", "$", "array<variant>"))})
        keys, number = F.map_keys("obj"), F.when(kind.rlike(f"^{TYPES['number']}$"), F.try_variant_get("v", "$", "double"))
        text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))
        below = F.when(F.col("at") == "", "").otherwise(F.concat("at", F.lit("/")))
        rule = lambda rank, what, broken: F.when(broken, F.array(F.struct(F.lit(rank).alias("rank"), F.concat(F.lit(f"{what}:"), "at").alias("text"))))
        each = lambda rank, what, names: F.transform(names, lambda n: F.struct(F.lit(rank).alias("rank"), F.concat(F.lit(f"{what}:"), below, n).alias("text")))  # noqa: E731, B023
        equal = lambda one: (F.to_json(F.parse_json(one)) == F.to_json("v")) | F.coalesce(F.try_variant_get(F.parse_json(one), "$", "double") == number, F.lit(False)) & F.schema_of_variant(F.parse_json(one)).rlike(f"^{TYPES['number']}$")  # noqa: E731, B023
        outside = (number < F.col("minimum")) | (number > F.col("maximum"))
        size = (F.length(text) < F.col("min_length")) | (F.length(text) > F.col("max_length")) | (F.size("arr") < F.col("min_items")) | (F.size("arr") > F.col("max_items"))
        parts = [
            each(0, "missing", F.array_except("required", keys)), rule(1, "type", F.col("types").isNotNull() & ~fits(F.col("v"), F.col("types"))), rule(2, "enum", ~F.exists("enum", equal)), rule(3, "range", outside),
            rule(4, "length", size), each(5, "unknown", F.when(F.col("names").isNotNull(), F.array_except(keys, "names"))),
        ]
        none = F.array().cast("array<struct<rank:int,text:string>>")
        found.append(with_rules.select("row", F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("error")))
        if k < depth:
            above = with_rules.select("row", "node", below.alias("below"), "at", "obj", "arr")
            inner = above.join(named, "node").where(F.map_contains_key("obj", F.col("step"))).select("row", F.col("to").alias("node"), F.concat("below", "step").alias("at"), F.try_element_at("obj", F.col("step")).alias("v"))
            listed = above.join(items, "node").select("row", F.col("to").alias("node"), "at", F.posexplode("arr").alias("i", "v"))
            at = inner.unionAll(listed.select("row", "node", F.concat("at", F.lit("["), "i", F.lit("]")).alias("at"), "v"))
    return reduce(DataFrame.unionAll, found).groupBy("row").agg(F.transform(F.array_sort(F.collect_list("error")), lambda e: e["text"]).alias("wrong"))


def levels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``k`` and ``level`` of all calls that depend on others: of ``edges`` (``k`` waits
    for ``dep``, which costs ``w``) the dearest chain's cost, NEVER in or behind a cycle."""
    edges = scratch.table(edges.groupBy("k", "dep").agg(F.max("w").cast("long").alias("w")), "waits")
    calls = edges.select("k").distinct().count()
    near = F.broadcast if calls <= BROADCAST_ROWS else lambda df: df
    level = None
    while True:
        known = edges.withColumn("cost", F.col("w"))
        if level is not None:
            before = near(level).select(F.col("k").alias("dep"), F.col("level").alias("dep_level"))
            known = edges.join(before, "dep", "left").withColumn("cost", F.least(F.coalesce("dep_level", F.lit(0)) + F.col("w"), F.lit(NEVER)))
        best = known.groupBy("k").agg(F.max(F.struct("cost", "dep", "w")).alias("best"))
        best = scratch.table(best.select("k", "best.cost", F.col("best.dep").alias("to"), F.col("best.w").alias("sum")), "chosen")
        if level is not None and best.join(near(level), "k").where("cost > level").isEmpty():
            scratch.drop(best, edges)
            return level
        chain = scratch.table(best.select("k", "to", "sum", F.lit(True).alias("moves")), "chain")
        for _ in range(calls.bit_length() + 1):
            further = near(chain).select(F.col("k").alias("to"), F.col("to").alias("then"), F.col("sum").alias("more"))
            over = chain.join(further, "to", "left")
            over = over.select("k", F.coalesce("then", "to").alias("to"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum"), F.col("then").isNotNull().alias("moves"))
            over = scratch.table(over, "chain")
            scratch.drop(chain)
            chain = over
            if chain.where("moves").isEmpty():
                break
        after = scratch.table(chain.select("k", F.when(F.col("moves"), NEVER).otherwise(F.least("sum", F.lit(NEVER))).alias("level")), "levels")
        scratch.drop(best, chain, *([level] if level is not None else []))
        level = after


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for every call, and for every identifier that only results have.

    ``calls`` have ``conv``, ``seq`` (place in the conversation), ``id``, ``name``,
    ``arguments`` (JSON) and ``depends`` (identifiers); ``results`` have ``conv``,
    ``seq``, ``id`` and ``content``. Out come ``conv``, ``id``, ``position`` (from 0 in
    the conversation), ``name``, ``status`` (linked, repeated_result, missing_result or
    orphan_result), ``valid``, ``errors`` and ``canonical``.
    """
    spark = calls.sparkSession
    scratch = Scratch(spark)
    none = F.array().cast("array<string>")
    # a call's key in its conversation; structs with equal nulls are equal
    key = lambda id_: F.when(F.col(id_).isNotNull(), F.struct("conv", F.col(id_).alias("id")))
    calls = scratch.table(calls.select("conv", "seq", "id", "name", "arguments", "depends", key("id").alias("k"), F.monotonically_increasing_id().alias("row")), "calls")
    one = results.where("id IS NOT NULL").groupBy(key("id").alias("k")).agg(F.min(F.struct("seq", "content")).alias("got"), F.count(F.lit(1)).alias("results"))
    one = scratch.table(one, "results")

    waits = calls.where("k IS NOT NULL").select("conv", "k", "seq", F.explode(F.array_distinct("depends")).alias("on")).withColumn("dep", key("on"))
    known = calls.where("k IS NOT NULL").groupBy(F.col("k").alias("dep")).agg(F.max("seq").alias("dep_seq"))
    waits = scratch.table(waits.join(known, "dep", "left"), "waits")
    late = scratch.table(waits.where("dep_seq >= seq").select(F.struct("conv").alias("of")).distinct(), "late")
    lost = waits.where("dep_seq IS NULL").groupBy("k").agg(F.transform(F.array_sort(F.collect_set("on")), lambda d: F.concat(F.lit("unresolved:"), d)).alias("lost"))
    level = spark.createDataFrame([], waits.select("k", F.lit(0).cast("long").alias("level")).schema)
    if not late.isEmpty():
        open_ = waits.where("dep_seq IS NOT NULL").withColumn("of", F.struct("conv")).join(_small(late), "of", "left_semi")
        level = levels(open_.select("k", "dep", (F.col("dep_seq") >= F.col("seq")).cast("long").alias("w")), scratch)

    wrong = scratch.table(argument_errors(calls, schemas), "wrong")
    tools = _listed(spark, [(tool,) for tool in sorted(schemas)], "tool string")
    rows = calls.join(one, "k", "left").join(lost, "k", "left").join(level, "k", "left").join(tools, F.col("name") == F.col("tool"), "left").join(_small(wrong), "row", "left")
    cycle = F.coalesce(F.col("level") == NEVER, F.lit(False))
    parsed = F.try_parse_json("arguments")
    known = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).rlike("^OBJECT"), F.array(F.lit("not_an_object"))).when(F.col("tool").isNull(), F.array(F.lit("unknown_tool"))).otherwise(F.coalesce("wrong", none))
    errors = F.concat(known, F.coalesce("lost", none), F.when(cycle, F.array(F.lit("cycle"))).otherwise(none))
    status = F.when(F.col("results").isNull(), "missing_result").when(F.col("results") > 1, "repeated_result").otherwise("linked")
    rows = rows.select("conv", "seq", "id", "name", "arguments", "depends", F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.col("got.content").alias("content"), status.alias("status"), errors.alias("errors"))
    orphans = one.join(calls.where("k IS NOT NULL").select("k"), "k", "left_anti").select(
        F.col("k.conv").alias("conv"), F.col("got.seq").alias("seq"), F.col("k.id").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit(None).cast("array<string>").alias("depends"), F.lit(NEVER + 1).alias("level"), F.col("got.content").alias("content"), F.lit("orphan_result").alias("status"),
        F.array(F.lit("no_call")).alias("errors"),
    )
    rows = scratch.table(rows.unionByName(orphans).withColumn("row", F.monotonically_increasing_id()), "linked")
    scratch.drop(calls, one, waits, late, level, wrong)

    placed = positions(rows.select("conv", "level", "seq", "id", "row"), ["conv", "level", "seq", "id", "row"], "placed", scratch)
    placed = scratch.table(placed.select("conv", "row", "pos"), "places")
    starts = scratch.table(placed.groupBy(F.col("conv").alias("of")).agg(F.min("pos").alias("start")), "starts")
    placed = placed.join(_small(starts), F.col("conv").eqNullSafe(F.col("of"))).select("row", (F.col("pos") - F.col("start")).alias("position"))
    record = F.struct(
        F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant")).alias("arguments"), F.array_sort(F.coalesce("depends", none)).alias("depends_on"),
        F.col("id"), F.col("name"), F.col("content").alias("result"), F.col("status"),
    )
    return rows.join(placed, "row").select("conv", "id", "position", "name", "status", (F.size("errors") == 0).alias("valid"), "errors", F.to_json(record, {"ignoreNullFields": "false"}).alias("canonical"))


def turns_as_calls(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn asks, after the turn two
    before it, and the assistant's next turn is its result; a system turn configures, once
    the turn behind it has asked."""
    m = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("seq"), F.col(role).alias("role"), F.col(text).cast("string").alias("text"))
    asks = F.col("role") == "user"
    arguments = F.when(asks, F.to_json(F.struct("text", F.col("seq").alias("turn")))).otherwise(F.to_json(F.struct("text")))
    turn_at = lambda at: F.array(F.concat_ws(":", "conv", at))
    before = F.when(~asks, turn_at(F.col("seq") + 1)).when(F.col("seq") >= 2, turn_at(F.col("seq") - 2)).otherwise(F.array().cast("array<string>"))
    calls = m.where("role IN ('user', 'system')").select(
        "conv", "seq", F.concat(F.col("conv").cast("string"), F.lit(":"), "seq").alias("id"), F.when(asks, "ask").otherwise("configure").alias("name"), arguments.alias("arguments"), before.alias("depends")
    )
    results = m.where("role NOT IN ('user', 'system')").select("conv", "seq", F.concat(F.col("conv").cast("string"), F.lit(":"), F.col("seq") - 1).alias("id"), F.col("text").alias("content"))
    return calls, results
