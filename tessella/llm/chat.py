"""Chat formatting with linked tool calls.

A message whose text is a JSON object may carry `tool_calls` (objects with id, name, arguments) and, with
`tool_call_id`, be the result of one. Calls and results are joined by conversation and identifier; a result that
stands before its call is ordered behind it; arguments are checked against the tools' schemas; every message is
written as canonical JSON: keys sorted, no blanks between tokens, values of the type they had. Only DataFrame
operations run.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import drop_staged, quoted, staged

#: For each tool its parameters: JSON type, and whether a call must give it.
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("number", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True)},
}


def _fields(value: Column) -> Column:
    """The fields of a variant that is an object; null of any other."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _field(value: Column, name: str) -> Column:
    """A field as canonical JSON text; null where there is none or it is JSON null."""
    return F.nullif(F.to_json(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("null"))


def _is_type(raw: Column, kind: Column) -> Column:
    return (
        F.when(kind == "string", raw.startswith('"'))
        .when(kind == "number", raw.rlike(r"^-?[0-9]"))
        .when(kind == "boolean", raw.isin("true", "false"))
        .when(kind == "array", raw.startswith("["))
        .when(kind == "object", raw.startswith("{"))
        .otherwise(F.lit(False))
    )


def _arguments_valid(call: Column, tools: dict) -> Column:
    """Known tool, an object as arguments (or a string that holds one), all required ones there, none unknown, each of its type."""
    given = F.try_variant_get(call, "$.arguments", "variant")
    fields = F.coalesce(_fields(given), _fields(F.try_parse_json(F.try_variant_get(call, "$.arguments", "string"))))
    valid = F.lit(False)
    for tool, parameters in sorted(tools.items()):
        checks = F.coalesce(F.size(F.array_except(F.map_keys(fields), F.lit(sorted(parameters)).cast("array<string>"))) == 0, F.lit(False))
        for parameter, (kind, required) in sorted(parameters.items()):
            value = F.to_json(F.element_at(fields, parameter))
            right = F.coalesce(_is_type(value, F.lit(kind)), F.lit(False))
            checks &= right if required else value.isNull() | right
        valid = F.when(_field(call, "name") == json.dumps(tool), checks).otherwise(valid)
    return F.coalesce(valid, F.lit(False))


def _places(calls: DataFrame) -> DataFrame:
    """calls (conv_id, id, turn, parent) with `place`, the (turn, step) at which each stands: behind its parent's.

    A call in a message that is itself a result has the call it answers as parent. Places move down such chains,
    one link a round. A call in or behind a cycle, which has no topological order, keeps its own turn.
    """
    own = F.struct("turn", F.lit(0).alias("step"))
    chained = calls.filter("parent IS NOT NULL").count()
    if not chained:
        return calls.select("conv_id", "id", own.alias("place"))
    current = staged(calls.select("*", own.alias("place")), "places")
    while True:
        parents = current.select("conv_id", F.col("id").alias("parent"), F.col("place").alias("above"))
        behind = F.struct(F.col("above.turn").alias("turn"), (F.col("above.step") + 1).alias("step"))
        moved = F.when(F.col("place.step") > chained, F.col("place")).otherwise(F.greatest("place", behind))
        following = staged(current.join(parents, ["conv_id", "parent"], "left").select(*calls.columns, F.coalesce(moved, "place").alias("place"), (moved != F.col("place")).alias("changed")), "places")
        changed = following.filter("changed").limit(1).count()
        drop_staged(current)
        current = following.drop("changed")
        if not changed:
            break
    return current.select("conv_id", "id", F.when(F.col("place.step") > chained, own).otherwise(F.col("place")).alias("place"))


def chat_messages(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    *,
    tools: dict[str, dict[str, tuple[str, bool]]] = TOOLS,
) -> DataFrame:
    """One row a message: conv_id, turn, role, order_turn, order_step, n_calls, n_valid, link, message.

    (order_turn, order_step, turn) sorts a conversation topologically: a message keeps its turn, but a result whose
    call has the same turn or a later one takes that turn and the step behind it; results that call in turn move
    what answers them. link: `call` for a message with calls, `linked` or `orphan` for a result, `call+linked` or
    `call+orphan` for both in one, `none` otherwise; n_valid counts calls whose arguments fit their schema. Of calls
    that repeat an identifier in a conversation the one of the least turn counts; identifiers are equal if they are
    the same JSON value, so 5 is not "5". A message with calls or a result keeps all its fields, entries of
    `tool_calls` that are no objects too; role comes from the column.

    Null roles and texts are written as JSON null; a text that is no JSON object, repeats a key, exceeds what a
    variant holds (16 MiB, 128 MiB in later versions), or has neither field is plain content, whatever its length.
    Messages with a null conversation are never linked. Repeated rows stay; an empty table gives no rows. No
    conversation is gathered in one task: the order is in the columns.
    """
    own = df.select(
        quoted(conv_col).alias("conv_id"), quoted(turn_col).alias("turn"), quoted(role_col).cast("string").alias("role"), quoted(text_col).cast("string").alias("text")
    )
    body = F.when(F.col("text").rlike(r"^[\x20\t\r\n]*\{") & F.col("text").rlike('"tool_call(s|_id)"'), F.try_parse_json("text"))
    entries = F.filter(F.try_variant_get("body", "$.tool_calls", "array<variant>"), lambda c: _fields(c).isNotNull())
    parsed = own.withColumn("body", body).select("*", entries.alias("calls"), _field(F.col("body"), "tool_call_id").alias("answers"))
    has_calls, is_result = F.coalesce(F.size("calls") > 0, F.lit(False)), F.col("answers").isNotNull()

    # the least turn of each identifier: pre-aggregated, then joined by hash with the results alone
    made = parsed.filter(has_calls).select("conv_id", "turn", F.col("answers").alias("parent"), F.explode(F.transform("calls", lambda c: _field(c, "id"))).alias("id"))
    made = made.filter("id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "parent")).alias("m"))
    made = staged(made.select("conv_id", "id", "m.turn", "m.parent"), "calls")
    places = _places(made).select("conv_id", F.col("id").alias("answers"), "place")
    results = parsed.filter(is_result).join(places.hint("shuffle_hash"), ["conv_id", "answers"], "left")
    linked = results.unionByName(parsed.filter(~is_result).withColumn("place", F.lit(None).cast(places.schema["place"].dataType)))

    late = F.coalesce(F.col("place.turn") >= F.col("turn"), F.lit(False))
    kind = F.when(F.col("place").isNotNull(), "linked").otherwise("orphan")
    link = F.when(has_calls & is_result, F.concat(F.lit("call+"), kind)).when(has_calls, "call").when(is_result, kind).otherwise("none")

    def text(value: Column) -> Column:
        """value as a JSON string, or null."""
        return F.coalesce(_json_string(value), F.lit("null"))

    fields = _fields(F.col("body"))
    names = F.array_sort(F.array_union(F.map_keys(fields), F.array(F.lit("role"))))
    whole = F.transform(names, lambda k: F.concat(text(k), F.lit(":"), F.when(k == "role", text(F.col("role"))).otherwise(F.to_json(F.element_at(fields, k)))))
    plain = F.concat(F.lit('{"content":'), text(F.col("text")), F.lit(',"role":'), text(F.col("role")), F.lit("}"))
    message = F.when(has_calls | is_result, F.concat(F.lit("{"), F.array_join(whole, ","), F.lit("}"))).otherwise(plain)
    return linked.select(
        "conv_id",
        "turn",
        "role",
        F.when(late, F.col("place.turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(late, F.col("place.step") + 1).otherwise(0).alias("order_step"),
        F.when(has_calls, F.size("calls")).otherwise(0).alias("n_calls"),
        F.when(has_calls, F.size(F.filter("calls", lambda c: _arguments_valid(c, tools)))).otherwise(0).alias("n_valid"),
        link.alias("link"),
        message.alias("message"),
    )


def _json_string(value: Column) -> Column:
    """A string as JSON: what to_json writes for an array of it, without the brackets."""
    written = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(written, F.lit(2), F.length(written) - 2))


def schema_json(tools: dict[str, dict[str, tuple[str, bool]]] = TOOLS) -> str:
    """The tools' schemas as canonical JSON, for a system message."""
    made = [
        {
            "name": name,
            "parameters": {
                "properties": {p: {"type": kind} for p, (kind, _) in sorted(parameters.items())},
                "required": sorted(p for p, (_, required) in parameters.items() if required),
                "type": "object",
            },
        }
        for name, parameters in sorted(tools.items())
    ]
    return json.dumps(made, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Holds for conversations without tool calls, as the test tables are; CALLS_SQL covers calls.
OP4_SQL = """
SELECT conv_id, turn, role, turn AS order_turn, 0 AS order_step, 0 AS n_calls, 0 AS n_valid, 'none' AS link,
       '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS message
FROM conversations
"""


def with_calls(df: DataFrame) -> DataFrame:
    """Conversations whose odd turns call a tool and whose even ones answer: a third of all in one conversation (-1),
    identifiers that repeat, calls before and behind their results, results without a call, arguments of a wrong type."""
    code = F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.when(F.col("turn") % 2 == 1, F.col("turn") % 4).otherwise((F.col("turn") + 3) % 4))
    query = F.when(F.col("turn") % 4 == 1, F.concat(F.lit('"q'), F.col("turn"), F.lit('"'))).otherwise(F.col("turn").cast("string"))
    calls = F.concat(F.lit('{"tool_calls": [{"name":"search","id":"'), code, F.lit('","arguments":{"query": '), query, F.lit('}}, 7],"content": "123"}'))
    answer = F.concat(F.lit('{"tool_call_id":"'), code, F.lit('", "content":{"b":true,"a":'), F.col("turn").cast("string"), F.lit("}}"))
    return df.select(F.when(F.col("conv_id") % 3 == 0, -1).otherwise(F.col("conv_id")).alias("conv_id"), "turn", "role", F.when(F.col("turn") % 2 == 1, calls).otherwise(answer).alias("text"))


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_messages(with_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


CALLS_SQL = """
WITH m AS (
  SELECT CASE WHEN conv_id % 3 = 0 THEN -1 ELSE conv_id END AS conv_id, turn, role, turn % 2 = 1 AS is_call,
         'c' || conv_id || '_' || CASE WHEN turn % 2 = 1 THEN turn % 4 ELSE (turn + 3) % 4 END AS code
  FROM conversations
), c AS (
  SELECT conv_id, code, min(turn) AS call_turn FROM m WHERE is_call GROUP BY conv_id, code
)
SELECT m.conv_id, turn, role, CASE WHEN NOT is_call AND call_turn >= turn THEN call_turn ELSE turn END AS order_turn,
       CASE WHEN NOT is_call AND call_turn >= turn THEN 1 ELSE 0 END AS order_step, is_call::INTEGER AS n_calls,
       (is_call AND turn % 4 = 1)::INTEGER AS n_valid,
       CASE WHEN is_call THEN 'call' WHEN call_turn IS NULL THEN 'orphan' ELSE 'linked' END AS link,
       CASE WHEN is_call THEN '{"content":"123","role":' || to_json(role)::VARCHAR || ',"tool_calls":[{"arguments":{"query":'
                 || CASE WHEN turn % 4 = 1 THEN '"q' || turn || '"' ELSE turn::VARCHAR END || '},"id":"' || m.code || '","name":"search"},7]}'
            ELSE '{"content":{"a":' || turn || ',"b":true},"role":' || to_json(role)::VARCHAR || ',"tool_call_id":"' || m.code || '"}' END AS message
FROM m LEFT JOIN c ON m.conv_id = c.conv_id AND m.code = c.code
"""
