"""Chat records with tool calls linked to their results, as canonical JSON.

A message's text is plain, or a JSON object by which

* a system message declares tools: ``{"tools": [{"name", "parameters": <JSON Schema>}]}``,
* an assistant message makes calls: ``{"content", "tool_calls": [{"id", "name", "arguments": {..}}]}``,
* a tool message answers one: ``{"tool_call_id", "content"}``.

Arguments are validated against the tool's schema ``DEPTH`` levels deep: type (one or
a list), enum, const, required, properties, additionalProperties (true or false),
items, and the bounds of numbers, strings and arrays.  Combinations of schemas
(anyOf, oneOf, allOf, not, $ref), additionalProperties that are schemas and formats
are not looked at.

Calls and results meet in a hash join on conversation and identifier.  Only
messages that make or answer calls are joined or grouped, and each group is the
calls of one message; plain messages pass through without a shuffle, so neither
a conversation nor a first turn that most rows share is ever brought together.

Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpoint_folder

#: Levels of nested arguments that are validated.
DEPTH = 4


def _schema(depth: int) -> str:
    """The type by which a JSON Schema is parsed; what may be of several types is kept as text."""
    own = "type:string,enum:array<variant>,const:variant,minimum:double,maximum:double,exclusiveMinimum:double,exclusiveMaximum:double,minLength:int,maxLength:int,pattern:string,minItems:int,maxItems:int,required:array<string>,additionalProperties:string"
    inner = f",properties:map<string,{_schema(depth - 1)}>,items:{_schema(depth - 1)}" if depth > 1 else ""
    return f"struct<{own}{inner}>"


_PARAMETERS = _schema(DEPTH)
_CALL = "struct<id:string,name:string,arguments:string>"
_MESSAGE = f"struct<content:string,tool_call_id:string,tool_calls:array<{_CALL}>,tools:array<struct<name:string,parameters:string>>>"
_KEY = ["conv_id", "turn", "role", "text_id"]

#: What each JSON Schema type may look like as the type of a parsed value.
_TYPES = {
    "string": "^STRING", "integer": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\([0-9]+,0\\))", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID",
}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no spaces; text that is no JSON as a JSON string; null as null."""
    parsed = F.try_parse_json(json)
    as_string = F.regexp_replace(F.to_json(F.struct(json.alias("x"))), r'^\{"x":|\}$', "")
    return F.when(json.isNull(), F.lit("null")).otherwise(F.coalesce(F.to_json(parsed), as_string))


def quoted(text: Column) -> Column:
    """A JSON string; null as an empty one."""
    return F.regexp_replace(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("x"))), r'^\{"x":|\}$', "")


def _joined(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _said(what: str, path: Column) -> Column:
    return F.when(path == "", F.lit(what)).otherwise(F.concat(F.lit(f"{what} "), path))


def _errors(value: Column, schema: Column, path: Column, depth: int) -> Column:
    """An array of all that is wrong with ``value`` (a variant; null for JSON null) by ``schema``, ``path`` being where it stands."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    none = F.array().cast("array<string>")
    some = lambda bad, said: F.when(F.coalesce(bad, F.lit(False)), F.array(said)).otherwise(none)
    types = F.when(schema["type"].startswith("["), F.from_json(schema["type"], "array<string>")).otherwise(F.array(schema["type"]))
    fits = lambda t: reduce(lambda other, item: F.when(t == item[0], kind.rlike(item[1])).otherwise(other), _TYPES.items(), F.lit(True))
    as_json = F.coalesce(F.to_json(value), F.lit("null"))
    number = F.when(kind.rlike(_TYPES["number"]), value.try_cast("double"))
    text = F.when(kind.rlike(_TYPES["string"]), value.try_cast("string"))
    found = [
        some(schema["type"].isNotNull() & ~F.exists(types, fits), _said("wrong type", path)),
        some(schema["enum"].isNotNull() & ~F.exists(schema["enum"], lambda x: F.coalesce(F.to_json(x), F.lit("null")) == as_json), _said("not in enum", path)),
        some(schema["const"].isNotNull() & (F.to_json(schema["const"]) != as_json), _said("not the constant", path)),
        some(
            (number < schema["minimum"]) | (number <= schema["exclusiveMinimum"]) | (number > schema["maximum"]) | (number >= schema["exclusiveMaximum"])
            | (F.length(text) < schema["minLength"]) | (F.length(text) > schema["maxLength"]),
            _said("out of range", path),
        ),
        some((text.isNotNull() & schema["pattern"].isNotNull()) & ~F.regexp_like(text, schema["pattern"]), _said("not of the pattern", path)),
    ]
    # what is null here is false in SQL's three values: a bound that is not given breaks nothing
    is_object, is_array = kind.rlike("^OBJECT"), kind.rlike("^ARRAY")
    fields = F.when(is_object, value.try_cast("map<string,variant>"))
    keys = F.array_sort(F.map_keys(fields))
    found.append(F.when(is_object, F.transform(F.array_sort(F.array_except(F.coalesce(schema["required"], none), keys)), lambda k: F.concat(F.lit("missing "), _joined(path, k)))).otherwise(none))
    elements = F.when(is_array, value.try_cast("array<variant>"))
    found.append(some((F.size(elements) < schema["minItems"]) | (F.size(elements) > schema["maxItems"]), _said("wrong length", path)))
    if depth > 1:
        properties = schema["properties"]
        known = F.coalesce(F.map_keys(properties), none)
        found.append(
            F.when(is_object & (schema["additionalProperties"] == "false"), F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unexpected "), _joined(path, k)))).otherwise(none)
        )
        child = lambda v, of, at: F.struct(v.alias("value"), of.alias("schema"), at.alias("path"))
        inside = F.transform(F.filter(keys, lambda k: F.array_contains(known, k)), lambda k: child(F.element_at(fields, k), F.element_at(properties, k), _joined(path, k)))
        each = F.when(schema["items"].isNotNull(), F.transform(elements, lambda x, i: child(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        children = F.flatten(F.filter(F.array(inside, each), lambda x: x.isNotNull()))
        found.append(F.coalesce(F.flatten(F.transform(children, lambda c: _errors(c["value"], c["schema"], c["path"], depth - 1))), none))
    return F.flatten(F.array(*found))


def argument_error(arguments: Column, parameters: Column) -> Column:
    """Null if ``arguments`` (JSON text) fit the JSON Schema ``parameters`` (text; null: no such tool), or the first thing that is wrong.

    A schema that is no JSON object asks for an object only.
    """
    given = F.try_parse_json(arguments)
    schema = F.coalesce(F.from_json(parameters, _PARAMETERS), F.from_json(F.lit("{}"), _PARAMETERS))
    wrong = _errors(given, schema, F.lit(""), DEPTH)
    at = lambda kind: F.get(F.filter(F.array_sort(wrong), lambda e: e.startswith(kind)), F.lit(0))
    first = F.coalesce(at("missing "), at("unexpected "), at("wrong type"), at(""))
    return (
        F.when(parameters.isNull(), F.lit("unknown tool"))
        .when(given.isNull() | ~F.coalesce(F.schema_of_variant(given).startswith("OBJECT"), F.lit(False)), F.lit("arguments are no object"))
        .otherwise(first)
    )


def _first(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Of the rows with equal keys the first by ``order``; combined before the shuffle."""
    named = [*order, *values]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*named), F.struct(*order)).alias("f")).select(*keys, *[F.col(f"f.{c}").alias(c) for c in named])


def chat_records(conversations: DataFrame) -> DataFrame:
    """One record for each message, in an order in which every result follows its call.

    Columns: conv_id, turn, role; ord_turn, ord_kind, ord_pos (sorting by them
    within a conversation gives the order: messages by turn, a result that came
    too early right after its call); n_calls, n_linked (calls with a result),
    n_invalid (calls whose arguments break their tool's schema); status (plain,
    calls, linked, orphan: a result without a call, repeated: a further result of
    one call); json (canonical: keys sorted, no spaces, absent content as "").

    Of calls with one identifier in a conversation the first owns the result; of
    results of one call the first is linked, ties going to the smaller text.
    Null role or text counts as empty, null turn sorts first, null conversations
    are one conversation; text that does not parse is plain.  Repeated rows give
    equal records each.  No rows give no rows.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    looks = F.col("text").startswith("{") & F.col("role").isin("system", "assistant", "tool")
    rows = rows.withColumn("m", F.when(looks, F.from_json("text", _MESSAGE)))
    declares = (F.col("role") == "system") & (F.size("m.tools") > 0)
    makes = (F.col("role") == "assistant") & (F.size("m.tool_calls") > 0)
    answers = (F.col("role") == "tool") & F.col("m.tool_call_id").isNotNull()
    kind = F.when(makes, F.lit("calls")).when(answers, F.lit("answer")).otherwise(F.lit("plain"))
    rows = rows.withColumn("kind", F.coalesce(kind, F.lit("plain")))
    # the few messages that declare, make or answer calls, read once; a text is known by its digest from here on
    special = rows.where((F.col("kind") != "plain") | declares).select("conv_id", "turn", "role", "kind", "text", F.sha2("text", 256).alias("text_id"))
    checkpoint_folder(conversations.sparkSession)
    special = special.checkpoint().withColumn("m", F.from_json("text", _MESSAGE))

    plain = rows.where("kind = 'plain'").select(
        "conv_id", "turn", "role", F.col("turn").alias("ord_turn"), F.lit(0).alias("ord_kind"), F.lit(0).alias("ord_pos"),
        F.lit(0).alias("n_calls"), F.lit(0).alias("n_linked"), F.lit(0).alias("n_invalid"), F.lit("plain").alias("status"),
        F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")).alias("json"),
    )

    tools = special.where("role = 'system'").select("conv_id", "turn", F.posexplode("m.tools").alias("tool_pos", "tool"))
    tools = tools.select("conv_id", "turn", "tool_pos", F.col("tool.name").alias("name"), F.coalesce("tool.parameters", F.lit("{}")).alias("parameters")).where("name is not null")
    tools = _first(tools, ["conv_id", "name"], ["turn", "tool_pos", "parameters"], []).select("conv_id", "name", "parameters")

    counted = special.where("kind <> 'plain'").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("times"), F.first("text").alias("text")).withColumn("m", F.from_json("text", _MESSAGE))
    calls = counted.where("role = 'assistant'").select(*_KEY, "text", "times", F.col("m.content").alias("content"), F.posexplode("m.tool_calls").alias("pos", "call"))
    calls = calls.select(*_KEY, "text", "times", "content", "pos", F.col("call.id").alias("id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    results = counted.where("role = 'tool'").select(*_KEY, "text", "times", F.col("m.content").alias("content"), F.col("m.tool_call_id").alias("id"))

    owner = _first(calls.where("id is not null"), ["conv_id", "id"], ["turn", "text", "pos"], ["text_id"])
    owner = owner.select("conv_id", "id", F.col("turn").alias("call_turn"), F.col("text_id").alias("call_text"), F.col("pos").alias("call_pos"))
    answer = _first(results, ["conv_id", "id"], ["turn", "text"], ["text_id"]).select("conv_id", "id", F.col("turn").alias("answer_turn"), F.col("text_id").alias("answer_text"))
    calls, results = calls.drop("text"), results.drop("text")

    def joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        right = right.withColumnsRenamed({k: f"r_{k}" for k in keys}).hint("shuffle_hash")
        on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"r_{k}"]) for k in keys])
        return left.join(right, on, "left").drop(*[f"r_{k}" for k in keys])

    calls = joined(joined(joined(calls, owner, "conv_id", "id"), answer, "conv_id", "id"), tools.withColumnRenamed("name", "tool_name").withColumnRenamed("tool_name", "name"), "conv_id", "name")
    mine = F.col("call_turn").eqNullSafe(F.col("turn")) & (F.col("call_text") == F.col("text_id")) & (F.col("call_pos") == F.col("pos"))
    linked = F.coalesce(mine & F.col("answer_text").isNotNull(), F.lit(False))
    error = argument_error(F.col("arguments"), F.col("parameters"))
    one = F.concat(
        F.lit('{"arguments":'), canonical(F.col("arguments")), F.when(F.col("error").isNotNull(), F.concat(F.lit(',"error":'), quoted(F.col("error")))).otherwise(F.lit("")),
        F.lit(',"id":'), quoted(F.col("id")), F.lit(',"linked":'), F.col("linked").cast("string"), F.lit(',"name":'), quoted(F.col("name")), F.lit("}"),
    )
    calls = calls.withColumn("linked", linked).withColumn("error", error)
    message = calls.groupBy(*_KEY, "times", "content").agg(
        F.count(F.lit(1)).cast("int").alias("n_calls"), F.sum(F.col("linked").cast("int")).cast("int").alias("n_linked"), F.sum(F.col("error").isNotNull().cast("int")).cast("int").alias("n_invalid"),
        F.array_sort(F.collect_list(F.struct("pos", one.alias("one")))).alias("all"),
    )
    message = message.select(
        "conv_id", "turn", "role", F.col("turn").alias("ord_turn"), F.lit(0).alias("ord_kind"), F.lit(0).alias("ord_pos"), "n_calls", "n_linked", "n_invalid", F.lit("calls").alias("status"),
        F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"role":"assistant","tool_calls":['), F.array_join("all.one", ","), F.lit("]}")).alias("json"), "times",
    )

    results = joined(joined(results, owner, "conv_id", "id"), answer, "conv_id", "id")
    first = F.col("answer_turn").eqNullSafe(F.col("turn")) & (F.col("answer_text") == F.col("text_id"))
    status = F.when(F.col("call_text").isNull(), "orphan").when(first, "linked").otherwise("repeated")
    early = F.col("call_text").isNotNull() & (F.coalesce("turn", F.lit(-(2**62))) <= F.coalesce("call_turn", F.lit(-(2**62))))
    results = results.select(
        "conv_id", "turn", "role", F.when(early, F.col("call_turn")).otherwise(F.col("turn")).alias("ord_turn"), F.when(early, 1).otherwise(0).alias("ord_kind"), F.when(early, F.col("call_pos") + 1).otherwise(0).alias("ord_pos"),
        F.lit(0).alias("n_calls"), F.lit(0).alias("n_linked"), F.lit(0).alias("n_invalid"), status.alias("status"),
        F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"role":"tool","tool_call_id":'), quoted(F.col("id")), F.lit("}")).alias("json"), "times",
    )
    special = message.unionByName(results).withColumn("copy", F.explode(F.expr("sequence(1L, times)"))).drop("copy", "times")
    return plain.unionByName(special)
