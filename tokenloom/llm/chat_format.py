"""Chat formatting with tool-call linking.

Messages (conv_id, turn, role, text) become canonical JSON: keys sorted, no spaces, non-ASCII letters kept.

* A message of role ``assistant`` may hold calls, ``<tool_call>{"id", "name", "arguments"}</tool_call>``.
* A message of role ``tool`` is a result: ``{"tool_call_id", "content"}``; of other tool texts the whole is the
  content and there is no identifier.
* A message of role ``system`` may declare tools: ``<tools>[{"name", "parameters"}]</tools>``, with JSON schemas.

Calls and results are hash-joined by (conv_id, identifier). A call whose arguments hold ``{"$ref": id}`` needs the
result of call ``id`` first. Calls are ordered topologically by level: 0 without needs, else one more than the
highest level needed. A conversation of at most ``SMALL`` calls and needs is ordered in one task, a larger one by
repeated joins; calls on a cycle or that need an unknown call keep level null. A message's place is (order_turn, level, turn): order_turn is its turn, or a
later one if something it needs, such as the call of a result, stands later. So a result follows its call even if the
rows have it before. Arguments are validated against the schema that the conversation declares for the name;
a schema's ``$ref`` is followed inside that schema, and one that leads elsewhere fits nothing, nor does a
malformed keyword (see ``valid``).

One row a message: conv_id, turn, role, order_turn, level, n_calls, n_linked (its calls answered, or 1 for a result
that has its call), n_invalid (calls that aren't valid JSON, or whose arguments don't fit the schema), json.

Defined cases: identical rows are one message. If an identifier is called twice in a conversation, the first call in
(turn, position) gets the results; repeated results all link. Calls that aren't valid JSON stay in the content and
count as invalid. Null text: content null. Null conv_id, turn or role: kept, but null conversations link nothing.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm._common import documents, materialize

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_TOOLS = re.compile(r"<tools>(.*?)</tools>", re.S)


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _load(text: str):
    """Parsed JSON, or None if it isn't valid: NaN, numbers beyond a double and lone surrogates aren't, nor is
    nesting too deep to be written again.
    """

    def no(name):
        raise ValueError(name)

    def number(digits):
        x = float(digits)
        if not math.isfinite(x):
            raise ValueError(digits)
        return x

    try:
        value = json.loads(text, parse_constant=no, parse_float=number)
        canonical([[[value]]]).encode()  # it will be written some levels deeper
        return value
    except (ValueError, RecursionError):
        return None


def needs(arguments) -> set[str]:
    """Identifiers that arguments refer to."""
    found, todo = set(), [arguments]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                found.add(x["$ref"])
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return found


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}


def _pointed(root, pointer: str):
    """What a pointer inside the schema (``#/...``) names; False, which nothing fits, if it names nothing here."""
    if pointer.split("/")[0] != "#":
        return False
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(root, list) and part.isdigit() and int(part) < len(root):
            root = root[int(part)]
        elif isinstance(root, dict) and part in root:
            root = root[part]
        else:
            return False
    return root


def _combined(value, schema: dict, root, trail: tuple) -> bool:
    """The keywords that hold further schemas for the same value; a call's result that isn't known yet may go either way."""
    meets = lambda s: fits(value, s, root, trail)
    unknown = bool(needs(value))
    if isinstance(schema.get("$ref"), str):
        # a reference that comes back to itself for the same value settles nothing
        if schema["$ref"] not in trail and not fits(value, _pointed(root, schema["$ref"]), root, (*trail, schema["$ref"])):
            return False
    if not all(map(meets, schema.get("allOf", []))) or "anyOf" in schema and not any(map(meets, schema["anyOf"])):
        return False
    if "oneOf" in schema:
        n = sum(map(meets, schema["oneOf"]))
        if not n or n > 1 and not unknown:
            return False
    if "not" in schema and not unknown and meets(schema["not"]):
        return False
    if "if" in schema:
        then, other = meets(schema.get("then", True)), meets(schema.get("else", True))
        return then or other if unknown else then if meets(schema["if"]) else other
    return True


#: Seconds that a schema's pattern may take on one string.
PATTERN_SECONDS = 5


def _matches(pattern: str, text: str) -> bool:
    return regex.search(pattern, text, timeout=PATTERN_SECONDS) is not None


def valid(value, schema) -> bool:
    """Whether a value meets a JSON schema; one that needs a malformed keyword (a bound that isn't a number, a
    pattern that can't be read or never ends, ...) is met by no value that the keyword would judge.
    """
    try:
        return fits(value, schema)
    except (TypeError, ValueError, AttributeError, ArithmeticError, RecursionError, TimeoutError, regex.error):
        return False


def fits(value, schema, root=None, trail: tuple = ()) -> bool:
    """Whether a value meets a well-formed JSON schema: type, enum, const, properties, patternProperties, required,
    additionalProperties, items, uniqueItems, bounds, multipleOf, allOf, anyOf, oneOf, not, if, and $ref inside the schema.
    """
    root = schema if root is None else root
    if isinstance(schema, bool):
        return schema
    if not isinstance(schema, dict):
        return False
    if isinstance(value, dict) and isinstance(value.get("$ref"), str):
        return True  # known only when the call runs
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(k in _TYPES and isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) or k == "integer" and isinstance(value, float) and value.is_integer() for k in kinds):
            return False
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        return False
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return False
    if not _combined(value, schema, root, trail):
        return False
    if isinstance(value, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            return False
        if any(k not in value for k in schema.get("required", [])):
            return False
        rest = schema.get("additionalProperties", True)
        for k, v in value.items():
            own = [*([known[k]] if k in known else []), *(s for p, s in patterns.items() if _matches(p, k))]
            if not all(fits(v, s, root) for s in own or [rest]):
                return False
        return True
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(fits(v, schema.get("items", True), root) for v in value) and not (schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value))
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) and ("pattern" not in schema or _matches(schema["pattern"], value))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        above, below = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        # older schemas have true here, for the bound beside it
        above, below = (schema.get(bound) if x is True else x for x, bound in ((above, "minimum"), (below, "maximum")))
        if above not in (None, False) and value <= above or below not in (None, False) and value >= below:
            return False
        if schema.get("multipleOf", 0) > 0 and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            return False
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    return True


ITEMS = "conv_id long, turn long, role string, content string, kind string, id string, bad int, calls array<struct<place:int,id:string,name:string,arguments:string,needs:array<string>>>, tools array<struct<name:string,schema:string>>"


def parse(messages: DataFrame) -> DataFrame:
    """One row a message with its calls, its result identifier or its tools; no shuffle."""
    call = pa.struct([("place", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("needs", pa.list_(pa.string()))])
    tool = pa.struct([("name", pa.string()), ("schema", pa.string())])

    def read(role: str | None, text: str | None):
        calls, tools, bad, kind, key = [], [], 0, "message", None
        if text and role == "assistant" and "<tool_call>" in text:

            def take(m):
                nonlocal bad
                x = _load(m.group(1))
                if not isinstance(x, dict) or not isinstance(x.get("name"), str) or not isinstance(x.get("arguments", {}), dict):
                    bad += 1
                    return m.group(0)
                own = x.get("id")
                calls.append({"place": len(calls), "id": own if isinstance(own, str) else None, "name": x["name"], "arguments": canonical(x.get("arguments", {})), "needs": sorted(needs(x.get("arguments", {})))})
                return ""

            text = _CALL.sub(take, text)
        elif text and role == "tool":
            kind = "result"
            x = _load(text)
            if isinstance(x, dict) and isinstance(x.get("tool_call_id"), str):
                key = x["tool_call_id"]
                inner = x.get("content")
                text = inner if isinstance(inner, str) else canonical(inner)
        elif text and role == "system" and "<tools>" in text:
            for m in _TOOLS.finditer(text):
                x = _load(m.group(1))
                tools += [{"name": t["name"], "schema": canonical(t.get("parameters", True))} for t in (x if isinstance(x, list) else []) if isinstance(t, dict) and isinstance(t.get("name"), str)]
        return text, kind, key, bad, calls, tools

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            role, text = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            content, kind, key, bad, calls, tools = zip(*map(read, role, text)) if role else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(content, pa.string()), pa.array(kind, pa.string()), pa.array(key, pa.string()), pa.array(bad, pa.int32()), pa.array(calls, pa.list_(call)), pa.array(tools, pa.list_(tool))],
                ["conv_id", "turn", "role", "content", "kind", "id", "bad", "calls", "tools"],
            )

    return messages.select("conv_id", "turn", "role", "text").distinct().mapInArrow(run, ITEMS)


#: A conversation with at most so many needs is ordered in one task, a larger one by joins.
SMALL = 20_000


def _ordered_small(rows: DataFrame) -> DataFrame:
    """Levels of whole conversations, one a row: conv_id, calls (structs of id, turn, needs)."""

    def order(calls: list[dict]) -> Iterator[tuple[str, int, int]]:
        waits = {c["id"]: len(c["needs"]) for c in calls}
        turn = {c["id"]: c["turn"] for c in calls}
        users: dict[str, list[str]] = {}
        for c in calls:
            for n in c["needs"]:
                users.setdefault(n, []).append(c["id"])
        level, ready = 0, [k for k, n in waits.items() if not n]
        while ready:
            following = []
            for k in ready:
                yield k, level, turn[k]
                for u in users.get(k, ()):
                    # a null turn says nothing
                    turn[u] = max((t for t in (turn[u], turn[k]) if t is not None), default=None)
                    waits[u] -= 1
                    if not waits[u]:
                        following.append(u)
            level, ready = level + 1, following

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(conv, *x) for conv, calls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in order(calls)]
            conv, key, level, after = zip(*done) if done else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(key, pa.string()), pa.array(level, pa.int32()), pa.array(after, pa.int64())], ["conv_id", "id", "level", "after"])

    return rows.mapInArrow(run, "conv_id long, id string, level int, after long")


def levels(calls: DataFrame, small: int = SMALL) -> DataFrame:
    """Topological level of each identified call (conv_id, id, turn, needs): conv_id, id, level, after (latest turn needed).

    Conversations of at most ``small`` calls and needs are ordered whole, all in one pass; the others level by level.
    """
    calls = calls.where("conv_id IS NOT NULL").select("conv_id", "id", "turn", "needs")
    size = calls.groupBy("conv_id").agg(F.sum(F.size("needs") + 1).alias("size"))
    sized = materialize(calls.join(size, "conv_id"), "chat-calls")
    # the conversations gathered are those counted as small
    whole = sized.where(F.col("size") <= small).groupBy("conv_id").agg(F.collect_list(F.struct("id", "turn", "needs")).alias("calls"))
    large = sized.where(F.col("size") > small).drop("size")
    done = _ordered_small(whole)
    return done.unionByName(levels_by_joins(large)) if large.limit(1).count() else done


def levels_by_joins(calls: DataFrame) -> DataFrame:
    """``levels`` where conversations are too large for one task: a round of joins for each level."""
    edges = calls.select("conv_id", "id", F.explode("needs").alias("need"))
    done = materialize(calls.where(F.size("needs") == 0).select("conv_id", "id", F.lit(0).alias("level"), F.col("turn").alias("after")), "chat-levels")
    waiting = materialize(edges, "chat-edges")
    count = waiting.count()
    level = 0
    while count:
        level += 1
        met = waiting.join(done.select("conv_id", F.col("id").alias("need"), F.lit(1).alias("met"), "after"), ["conv_id", "need"], "left")
        ready = met.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.count("met").alias("m"), F.max("after").alias("after")).where("n = m")
        ready = ready.join(calls.select("conv_id", "id", "turn"), ["conv_id", "id"]).select("conv_id", "id", F.lit(level).alias("level"), F.greatest("turn", "after").alias("after"))
        done = materialize(done.unionByName(ready), "chat-levels")
        waiting = materialize(waiting.join(done, ["conv_id", "id"], "left_anti"), "chat-edges")
        left = waiting.count()
        if left == count:
            break  # cycles and unknown needs
        count = left
    return done


def chat_format(messages: DataFrame) -> DataFrame:
    items = materialize(parse(messages), "chat-items")
    message = ["conv_id", "turn", "role", "content"]
    key = F.xxhash64(*message)
    calls = items.where(F.size("calls") > 0).select(key.alias("message"), "conv_id", "turn", F.explode("calls").alias("c")).select("message", "conv_id", "turn", "c.*")
    results = items.where("kind = 'result'").select("conv_id", "id", F.col("turn").alias("result_turn"))
    # the first call of an identifier takes its results
    first = calls.where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place", "message", "name", "needs")).alias("f")).select("conv_id", "id", "f.*")
    order = materialize(first.join(levels(first), ["conv_id", "id"], "left").select("conv_id", "id", "message", "place", "name", "level", "turn", F.coalesce("after", "turn").alias("after")), "chat-order")
    answers = results.where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.count("*").alias("answers"))
    tools = items.where(F.size("tools") > 0).select("conv_id", F.explode("tools").alias("t")).groupBy("conv_id", F.col("t.name").alias("name")).agg(F.min("t.schema").alias("schema"))
    linked = (
        calls.join(order.select("conv_id", "id", "message", "place", "level", "after").hint("shuffle_hash"), ["conv_id", "id", "message", "place"], "left")
        .join(answers.hint("shuffle_hash"), ["conv_id", "id"], "left")
        .withColumn("answers", F.when(F.col("after").isNotNull(), F.col("answers")))
        .join(tools.hint("shuffle_hash"), ["conv_id", "name"], "left")
    )
    fields = "message long, after long, level int, answered boolean, valid boolean, place int, json string"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, made = [], []
            for row in batch.select(["id", "name", "arguments", "schema"]).to_pylist():
                arguments = json.loads(row["arguments"])
                verdicts.append(row["schema"] is None or valid(arguments, json.loads(row["schema"])))
                made.append(canonical({"id": row["id"], "name": row["name"], "arguments": arguments}))
            cell = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([cell("message"), cell("after"), cell("level"), cell("answered"), pa.array(verdicts, pa.bool_()), cell("place"), pa.array(made, pa.string())], [f.split()[0] for f in fields.split(", ")])

    checked = linked.select("message", "after", "level", F.col("answers").isNotNull().alias("answered"), "place", "id", "name", "arguments", "schema").mapInArrow(check, fields)
    by_message = checked.groupBy("message").agg(
        F.count("*").alias("n"), F.count_if("answered").alias("answered"), F.count_if(~F.col("valid")).alias("invalid"), F.max("after").alias("after"), F.max("level").alias("level"), F.sort_array(F.collect_list(F.struct("place", "json"))).alias("made")
    )
    back = order.select("conv_id", "id", F.col("name").alias("call_name"), F.col("after").alias("call_after"), F.col("level").alias("call_level"))
    rows = items.withColumn("message", key).join(by_message, "message", "left").join(back, ["conv_id", "id"], "left")
    text = F.to_json(F.struct(F.col("content").alias("x")), {"ignoreNullFields": "false"})
    content = F.expr("substring(_x, 6, length(_x) - 6)")
    quote = lambda c: F.when(F.col(c).isNotNull(), F.expr(f"substring(to_json(struct({c} AS x)), 6, length(to_json(struct({c} AS x))) - 6)"))
    part = lambda name, value: F.concat(F.lit(f',"{name}":'), value)
    whole = F.concat(
        F.lit('{"content":'),
        content,
        F.coalesce(part("name", quote("call_name")), F.lit("")),
        F.coalesce(part("role", quote("role")), F.lit(',"role":null')),
        F.coalesce(part("tool_call_id", quote("id")), F.lit("")),
        F.coalesce(part("tool_calls", F.concat(F.lit("["), F.array_join(F.col("made.json"), ","), F.lit("]"))), F.lit("")),
        F.lit("}"),
    )
    return rows.withColumn("_x", text).select(
        "conv_id",
        "turn",
        "role",
        F.greatest("turn", "after", "call_after").alias("order_turn"),
        F.coalesce(F.when(F.col("kind") == "result", F.col("call_level") + 1), F.col("level"), F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(0))).cast("int").alias("level"),
        (F.coalesce("n", F.lit(0)) + F.col("bad")).cast("long").alias("n_calls"),
        F.coalesce(F.when(F.col("call_name").isNotNull(), F.lit(1)), F.col("answered"), F.lit(0)).cast("long").alias("n_linked"),
        (F.coalesce("invalid", F.lit(0)) + F.col("bad")).cast("long").alias("n_invalid"),
        whole.alias("json"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(documents(spark, sf_dir, "conversations"))


#: For conversations without tool calls, as the table has them.
ORACLE = """
SELECT DISTINCT conv_id, turn, role, turn AS order_turn, 0::INTEGER AS level,
       (CASE WHEN role = 'assistant' THEN len(string_split(text, '<tool_call>')) - 1 ELSE 0 END)::BIGINT AS n_calls,
       0::BIGINT AS n_linked, 0::BIGINT AS n_invalid,
       '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json
FROM conversations
"""


def with_calls(messages: DataFrame) -> DataFrame:
    """A view of plain conversations in which tools are declared, called and answered.

    Turns are doubled, so that results have room between them. The first message of each conversation gets a system
    message before it that declares the tool ``note``, of a whole number up to 300. Every assistant message calls it with
    its length; every third such call of a conversation needs none, the others the one before. Calls are answered at the
    turn after theirs, those at a turn divisible by 8 at the turn before, and each fourth one isn't.
    """
    messages.createOrReplaceTempView("_chat_plain")
    return messages.sparkSession.sql(_WITH_CALLS.format(table="_chat_plain"))


_WITH_CALLS = """
WITH said AS (SELECT conv_id, 2 * turn AS turn, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM {table} WHERE role = 'assistant'),
told AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM said)
SELECT conv_id, 2 * turn AS turn, role, text FROM {table} WHERE role <> 'assistant'
UNION ALL
SELECT conv_id, 2 * min(turn) - 1, 'system', '<tools>[{{"name":"note","parameters":{{"properties":{{"n":{{"maximum":300,"type":"integer"}}}},"required":["n"],"type":"object"}}}}]</tools>' FROM {table} GROUP BY conv_id
UNION ALL
SELECT conv_id, turn, 'assistant', concat(text, '<tool_call>{{"id":"c', turn, '","name":"note","arguments":{{"n":', n, CASE WHEN k % 3 <> 0 THEN concat(',"of":{{"$ref":"c', earlier, '"}}') ELSE '' END, '}}}}</tool_call>') FROM told
UNION ALL
SELECT conv_id, CASE WHEN turn % 8 = 0 THEN turn - 1 ELSE turn + 1 END, 'tool', concat('{{"tool_call_id":"c', turn, '","content":"noted ', k, '"}}') FROM told WHERE k % 4 <> 3
"""


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chat_format`` over ``with_calls`` of the whole table, which itself holds no calls."""
    return chat_format(with_calls(documents(spark, sf_dir, "conversations")))


LINKED_ORACLE = """
WITH said AS (SELECT conv_id, 2 * turn AS turn, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE role = 'assistant'),
told AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM said)
SELECT conv_id, 2 * turn AS turn, role, 2 * turn AS order_turn, 0::INTEGER AS level, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid,
       '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || to_json(role)::VARCHAR || '}' AS json
FROM conversations WHERE role <> 'assistant'
UNION ALL
SELECT conv_id, 2 * min(turn) - 1, 'system', 2 * min(turn) - 1, 0, 0, 0, 0,
       '{"content":' || to_json('<tools>[{"name":"note","parameters":{"properties":{"n":{"maximum":300,"type":"integer"}},"required":["n"],"type":"object"}}]</tools>')::VARCHAR || ',"role":"system"}'
FROM conversations GROUP BY conv_id
UNION ALL
SELECT conv_id, turn, 'assistant', turn, (k % 3)::INTEGER, 1, (k % 4 <> 3)::BIGINT, (n > 300)::BIGINT,
       '{"content":' || to_json(text)::VARCHAR || ',"role":"assistant","tool_calls":[{"arguments":{"n":' || n || CASE WHEN k % 3 <> 0 THEN ',"of":{"$ref":"c' || earlier || '"}' ELSE '' END || '},"id":"c' || turn || '","name":"note"}]}'
FROM told
UNION ALL
SELECT conv_id, CASE WHEN turn % 8 = 0 THEN turn - 1 ELSE turn + 1 END, 'tool', CASE WHEN turn % 8 = 0 THEN turn ELSE turn + 1 END, (k % 3 + 1)::INTEGER, 0, 1, 0,
       '{"content":"noted ' || k || '","name":"note","role":"tool","tool_call_id":"c' || turn || '"}'
FROM told WHERE k % 4 <> 3
"""
