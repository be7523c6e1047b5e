"""Tool-call linking for chat data: calls and results meet by identifier, are ordered topologically, checked against
schemas and written as canonical JSON. Built-in functions only.

A turn is read as tool traffic where its text is JSON: an assistant's {"tool_calls": [{"id", "name", "arguments",
"after"}]} and a tool's {"tool_call_id", "content"}. In plain chat a user's turn is a call of "reply" and the next turn,
where it is the assistant's, its result; such a call comes after the user's last turn but one. Other turns are messages.

Every message, call and result is one row, dealt out by (conversation, id) and joined against one row per call; joins on
an id that very many rows repeat are split by the engine, as nothing else needs these rows together. Levels: where every
call comes after one other at most, pointers are doubled; else a conversation of at most SMALL calls is levelled within
its row, and larger ones, which no row should hold, in rounds over their edges, one for each level.

Defined cases: a null text counts as empty; a very long one is parsed and written like any other, within its row; a null conversation id is a conversation of its own; a repeated call id
names one call (rows stay, each is linked); results without a call and calls without a result have linked = false; an
unknown or missing ``after`` id is ignored; calls on a cycle, or after one, have a null level; arguments that are not a
JSON object, or break the schema of their tool, are not valid; a tool without a schema takes any object; a null role is
a message; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, let, written

#: By tool: the fields that must be there, and the kind of each field that is checked (a kind may end in "+": not empty).
SCHEMAS = {"reply": {"required": ("prompt", "turn"), "kinds": {"prompt": "string+", "turn": "integer"}}}
_CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
_RESULT = "tool_call_id string, content string"
#: Calls of a conversation that one row holds at most, and edges between them per call.
SMALL, EDGES = 2_000, 4
_KINDS = {
    "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$", "object": "^OBJECT<", "array": "^ARRAY<", "null": "^VOID$",
}


def _key(conv: Column, call: Column) -> Column:
    return F.concat_ws("\x1f", F.coalesce(conv.cast("string"), F.lit("\x00")), call)


def messages(chat: DataFrame) -> DataFrame:
    """(conv_id, turn, role, kind, call_id, name, arguments, content, after) of every call, result and message."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = chat.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    boxed = F.col("text").rlike(r"^\s*\{")
    calls = F.when(boxed & (F.col("role") == "assistant"), F.from_json("text", _CALLS)["tool_calls"])
    rows = rows.withColumn("calls", calls).withColumn("answer", F.when(boxed & (F.col("role") == "tool"), F.from_json("text", _RESULT)))
    none, no_ids = F.lit(None).cast("string"), F.array().cast("array<string>")

    def row(kind: str, call: Column, name: Column, arguments: Column, content: Column, after: Column) -> Column:
        parts = {"kind": F.lit(kind), "call_id": call, "name": name, "arguments": arguments, "content": content, "after": after}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    prompt = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"})
    spoken = lambda back: F.concat(F.lit("t"), (F.col("turn") - back).cast("string"))
    made = (
        F.when(
            F.size("calls") > 0,
            F.transform("calls", lambda c: row("call", c["id"], c["name"], c["arguments"], none, F.coalesce(c["after"], no_ids))),
        )
        .when(F.col("answer.tool_call_id").isNotNull(), F.array(row("result", F.col("answer.tool_call_id"), none, none, F.coalesce("answer.content", F.lit("")), no_ids)))
        .when((F.col("role") == "user") & F.col("turn").isNotNull(), F.array(row("call", spoken(0), F.lit("reply"), prompt, none, F.array(spoken(2)))))
        .when((F.col("role") == "assistant") & F.col("turn").isNotNull(), F.array(row("result", spoken(1), none, none, F.col("text"), no_ids)))
        .otherwise(F.array(row("message", none, none, none, F.col("text"), no_ids)))
    )
    return rows.select("conv_id", "turn", "role", F.inline(made))


def valid_arguments(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Whether the arguments are a JSON object that has what the tool's schema asks for."""
    value = F.try_parse_json(arguments)
    fine = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))
    for tool, schema in schemas.items():
        good = F.lit(True)
        for field in schema.get("required", ()):
            good = good & F.try_variant_get(value, f"$['{field}']", "variant").isNotNull()
        for field, kind in schema.get("kinds", {}).items():
            own = F.try_variant_get(value, f"$['{field}']", "variant")
            fits = F.schema_of_variant(own).rlike(_KINDS[kind.rstrip("+")])
            if kind.endswith("+"):
                fits = fits & (F.length(F.try_variant_get(value, f"$['{field}']", "string")) > 0)
            good = good & (own.isNull() | F.coalesce(fits, F.lit(False)))
        fine = fine & ((name != tool) | good | name.isNull())
    return F.coalesce(fine, F.lit(False))


def levels(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, level) for nodes(node, conv, turn): the longest chain of edges(node, before) below it; null on a cycle or after
    one. Edges stay within a conversation."""
    edges = written(edges.join(nodes.select(F.col("node").alias("before")), "before", "left_semi").distinct().select("node", "before"), "edges")
    if not edges.groupBy("node").count().filter("count > 1").limit(1).count():
        return _doubled(edges, nodes)
    sizes = nodes.groupBy("conv").agg(F.count("*").alias("calls"))
    sizes = sizes.join(edges.join(nodes, "node").groupBy("conv").agg(F.count("*").alias("edges")), "conv")
    large = written(sizes.filter((F.col("calls") > small) | (F.col("edges") > small * EDGES)).select("conv"), "large")
    if not large.limit(1).count():
        return _within_rows(edges, nodes)
    many = written(nodes.join(large, "conv", "left_semi"), "many")
    few = nodes.join(large, "conv", "left_anti")
    return _within_rows(edges, few).unionByName(_in_rounds(edges.join(many.select("node"), "node", "left_semi"), many))


def _doubled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    now = nodes.select("node").join(edges, "node", "left").select("node", "before", F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("level"))
    now, open_before, far = written(now, "levels"), -1, 0
    while (left := now.filter("before is not null").count()) and far < 64:
        # on a cycle pointers never end; a chain of any length does within 64 doublings
        if left == open_before and far > 40:
            break
        open_before, far = left, far + 1
        going = now.filter("before is not null")
        step = now.select(F.col("node").alias("before"), F.col("before").alias("next"), F.col("level").alias("more"))
        moved = going.join(step, "before").select("node", F.col("next").alias("before"), (F.least(F.lit(1 << 40), F.col("level") + F.col("more"))).alias("level"))
        last, now = now, written(moved.unionByName(now.filter("before is null")), "levels")
        dropped(last)
    dropped(edges)
    return now.select("node", F.when(F.col("before").isNull(), F.col("level")).alias("level"))


def _within_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Conversations as arrays: passes over the calls by turn, each taking what is settled so far, until one changes nothing."""
    order = Window.partitionBy("conv").orderBy("turn", "node")
    numbered = written(nodes.withColumn("k", F.row_number().over(order) - 1), "numbered")
    place = numbered.select(F.col("node").alias("before"), F.col("k").alias("p"))
    below = edges.join(place, "before").groupBy("node").agg(F.collect_list("p").alias("below"))
    rows = numbered.join(below, "node", "left").withColumn("below", F.coalesce("below", F.array().cast("array<int>")))
    rows = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("k", "node", "below"))).alias("calls"))

    def settled(old: Column) -> Column:
        def next_one(out: Column, call: Column) -> Column:
            known = F.transform(call["below"], lambda p: F.when(p < F.size(out), F.get(out, p)).otherwise(F.get(old, p)))
            level = let(known, lambda m: F.when(F.size(m) == 0, F.lit(0).cast("long")).when(~F.exists(m, lambda x: x.isNull()), F.array_max(m) + 1))
            return F.concat(out, F.array(level))

        return F.aggregate("calls", F.array().cast("array<bigint>"), next_one)

    def one_pass(now: Column, _: Column) -> Column:
        after = lambda new: F.struct(new.alias("levels"), (~new.eqNullSafe(now["levels"])).alias("open"))
        return F.when(now["open"], let(settled(now["levels"]), after)).otherwise(now)

    first = F.struct(F.array_repeat(F.lit(None).cast("bigint"), F.size("calls")).alias("levels"), F.lit(True).alias("open"))
    found = F.aggregate(F.sequence(F.lit(1), F.size("calls") + 1), first, one_pass, lambda x: x["levels"])
    rows = rows.select("calls", found.alias("levels"))
    return rows.select(F.inline(F.arrays_zip(F.col("calls.node").alias("node"), F.col("levels").alias("level"))))


def _in_rounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each round tells the calls after those settled last; what is open is counted down. Tables go as soon as they are read."""
    edges = written(edges, "edges")
    left = written(edges.groupBy("node").agg(F.count("*").alias("open")).withColumn("level", F.lit(-1).cast("long")), "open")
    fresh = written(nodes.select("node").join(left, "node", "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    done = [fresh]
    while fresh.limit(1).count():
        told = edges.join(fresh.withColumnRenamed("node", "before"), "before").groupBy("node").agg(F.count("*").alias("n"), F.max("level").alias("most"))
        now = left.join(told, "node", "left").select("node", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("level", "most").alias("level"))
        now = written(now, "open")
        dropped(left)
        fresh, left = written(now.filter("open = 0").select("node", (F.col("level") + 1).alias("level")), "levels"), written(now.filter("open > 0"), "open")
        dropped(now)
        done.append(fresh)
        if len(done) == 64:
            whole = written(functools.reduce(DataFrame.unionByName, done), "levels")
            dropped(*done[:-1])
            done = [whole]
    dropped(edges)
    return functools.reduce(DataFrame.unionByName, done).unionByName(left.select("node", F.lit(None).cast("long").alias("level")))


def linked(chat: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """(conv_id, turn, kind, call_id, name, linked, level, place, valid, json), one row per call, result and message.

    level counts the calls that must come before; place orders the rows of a conversation topologically: a call's is
    2 * level, its results' one more. json has sorted keys and no spaces.
    """
    rows = messages(chat).withColumn("node", _key(F.col("conv_id"), F.col("call_id")))
    rows = written(rows, "messages")
    calls = rows.filter("kind = 'call' and call_id is not null")
    conv = F.coalesce(F.first("conv_id").cast("string"), F.lit("\x00")).alias("conv")
    nodes = calls.groupBy("node").agg(conv, F.min("turn").alias("turn"))
    edges = calls.select("node", F.explode("after").alias("id"), "conv_id").select("node", _key(F.col("conv_id"), F.col("id")).alias("before"))
    level = levels(edges, nodes)
    answered = rows.filter("kind = 'result'").select("node").distinct().withColumn("answered", F.lit(True))
    known = level.join(answered, "node", "left").select(F.col("node"), "level", "answered", F.lit(True).alias("called"))
    out = rows.join(known, "node", "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    link = F.coalesce(F.when(is_call, F.col("answered")).when(is_result, F.col("called")), F.lit(False))
    whole = {"ignoreNullFields": "false"}
    call = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null")), F.lit(","),
        F.substring(F.to_json(F.struct("call_id", "conv_id", "kind", "name"), whole), 2, 1 << 30),
    )
    result = F.to_json(F.struct("call_id", "content", "conv_id", "kind"), whole)
    plain = F.to_json(F.struct("content", "conv_id", "kind", "role"), whole)
    return out.select(
        "conv_id", "turn", "kind", "call_id", "name", link.alias("linked"), "level",
        F.when(is_call | is_result, F.col("level") * 2 + is_result.cast("long")).alias("place"),
        F.when(is_call, valid_arguments(F.col("name"), F.col("arguments"), schemas)).alias("valid"),
        F.when(is_call, call).when(is_result, result).otherwise(plain).alias("json"),
    )


def op1_tool_calls(spark, sf_dir: str) -> DataFrame:
    from .common import read

    none = {"call_id": "", "name": "", "level": -1, "place": -1, "valid": False}
    return linked(read(spark, sf_dir, "conversations")).fillna(none)


OP1_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS n
  FROM conversations
), c AS (SELECT DISTINCT conv_id, n FROM m WHERE kind = 'call'),
lv AS (
  SELECT conv_id, n, 0::BIGINT AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.n = c.n - 2)
  UNION ALL SELECT c.conv_id, c.n, lv.level + 1 FROM c JOIN lv ON c.conv_id = lv.conv_id AND c.n = lv.n + 2
), r AS (SELECT DISTINCT conv_id, n, true AS hit FROM m WHERE kind = 'result')
SELECT m.conv_id, m.turn, kind, coalesce('t' || m.n, '') AS call_id, CASE WHEN kind = 'call' THEN 'reply' ELSE '' END AS name,
       coalesce(CASE kind WHEN 'call' THEN r.hit WHEN 'result' THEN lv.level IS NOT NULL END, false) AS linked,
       coalesce(lv.level, -1) AS level, coalesce(lv.level * 2 + (kind = 'result')::BIGINT, -1) AS place,
       kind = 'call' AND text <> '' AS valid,
       CASE kind
         WHEN 'call' THEN json_object('arguments', json_object('prompt', text, 'turn', m.turn), 'call_id', 't' || m.n,
                                      'conv_id', m.conv_id, 'kind', kind, 'name', 'reply')::VARCHAR
         WHEN 'result' THEN json_object('call_id', 't' || m.n, 'content', text, 'conv_id', m.conv_id, 'kind', kind)::VARCHAR
         ELSE json_object('content', text, 'conv_id', m.conv_id, 'kind', kind, 'role', role)::VARCHAR END AS json
FROM m LEFT JOIN lv ON m.conv_id = lv.conv_id AND m.n = lv.n LEFT JOIN r ON m.conv_id = r.conv_id AND m.n = r.n
"""
