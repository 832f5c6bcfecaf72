"""Tool calls of conversations linked with their results, validated, ordered and serialised.

Only DataFrame functions: nothing here leaves the JVM.

Events. An assistant turn whose text is a JSON object with ``tool_calls`` [{id, name, arguments}]
holds calls, and a message after them where its ``content`` is not null; a turn of role ``tool`` whose text is {tool_call_id, content} is a result. In plain
conversations a user turn t is read as the call ``t`` of the tool ``reply`` with the argument
``text``, and an assistant turn t as the result of call ``t - 1``. Everything else is a message.

Link: a hash join by (conv_id, call_id). Calls and results are counted by identifier first, with
partial aggregation, so the joined side has one row an identifier: a hot identifier does not
multiply rows. Its events meet in one partition of the join, row by row; no conversation is ever
collected. Equal events of repeated rows tie in the order.

Order: (order_turn, order_rank, turn, seq) is a topological order of a conversation: a result comes
after its first call, wherever it stood. Arguments are checked against ``schemas``: tool ->
parameter -> (type, required), types as in JSON schema. JSON is canonical: no spaces, sorted keys.

Defined results: null ids, turns or identifiers link with nothing; a null text is a null argument
or content; malformed JSON is plain text; a repeated call id is invalid ("repeated id") and its
results belong to the first; repeated rows stay separate events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {"reply": {"text": ("string", True)}}
_PARSED = "tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, content string"
_EVENT = "array<struct<seq:int,kind:string,call_id:string,name:string,arguments:string,content:string>>"
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


def quoted(c: Column) -> Column:
    """A JSON string, or null's literal."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def canonical(text: Column) -> Column:
    """The JSON text without spaces and with sorted keys; null if malformed."""
    return F.to_json(F.try_parse_json(text))


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments, sorted; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.array(F.lit("unknown tool"))
    for tool, parameters in schemas.items():
        found = [F.when(keys.isNull(), F.lit("arguments are no object"))]
        found.append(F.when(F.size(F.array_except(keys, F.array(*(F.lit(p) for p in parameters)).cast("array<string>"))) > 0, F.lit("unexpected argument")))
        for p, (kind, required) in sorted(parameters.items()):
            has = F.array_contains(keys, p)
            told = F.schema_of_variant(F.try_variant_get(parsed, f"$['{p}']", "variant"))
            found.append(F.when(~has & F.lit(required), F.lit(f"{p} is missing")).when(has & ~F.coalesce(told.rlike(f"^({_TYPES[kind]})$"), F.lit(False)), F.lit(f"{p} is no {kind}")))
        out = F.when(name == tool, F.sort_array(F.array_compact(F.array(*found)))).otherwise(out)
    return out


def events(turns: DataFrame) -> DataFrame:
    """conv_id, turn, seq, kind, call_id, name, arguments, content, role: one row an event."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    looks = F.ltrim(F.col("text")).startswith("{") & F.col("role").isin("assistant", "tool")
    rows = rows.withColumn("p", F.when(looks, F.from_json("text", _PARSED)))
    none = F.lit(None).cast("string")

    def one(kind: str, call_id: Column = none, name: Column = none, arguments: Column = none, content: Column = none) -> Column:
        return F.array(F.struct(F.lit(0).alias("seq"), F.lit(kind).alias("kind"), call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"), content.alias("content"))).cast(_EVENT)

    calls = F.transform("p.tool_calls", lambda c, i: F.struct(i.alias("seq"), F.lit("call").alias("kind"), c["id"].alias("call_id"), c["name"].alias("name"), c["arguments"].alias("arguments"), none.alias("content"))).cast(_EVENT)
    beside = F.transform(one("message", content=F.col("p.content")), lambda e: e.withField("seq", F.size("p.tool_calls")))
    calls = F.when(F.col("p.content").isNull(), calls).otherwise(F.concat(calls, beside.cast(_EVENT)))
    said = F.concat(F.lit('{"text":'), quoted(F.col("text")), F.lit("}"))
    found = (
        F.when((F.col("role") == "assistant") & (F.size("p.tool_calls") > 0), calls)
        .when(F.col("role") == "tool", one("result", F.col("p.tool_call_id"), content=F.coalesce(F.col("p.content"), F.col("text"))))
        .when(F.col("role") == "user", one("call", F.col("turn").cast("string"), F.lit("reply"), said))
        .when(F.col("role") == "assistant", one("result", (F.col("turn") - 1).cast("string"), content=F.col("text")))
        .otherwise(one("message", content=F.col("text")))
    )
    return rows.select("conv_id", "turn", "role", F.inline(found))


def linked(turns: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """One row an event: conv_id, turn, seq, kind, call_id, linked, n_calls, n_results, problems,
    valid, order_turn, order_rank, json."""
    found = events(turns)
    wrong = F.when(F.col("kind") == "call", problems(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    call = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit("}"))
    result = F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"tool_call_id":'), quoted(F.col("call_id")), F.lit("}"))
    message = F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}"))
    found = found.select("conv_id", "turn", "seq", "kind", "call_id", wrong.alias("problems"), F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(message).alias("json"))
    is_call = F.col("kind") == "call"
    # turn and seq in one number: minima of numbers are kept in a hash table, those of structs are sorted
    place = F.col("turn").cast("decimal(20,0)") * F.lit(1 << 32) + F.col("seq")
    ids = found.where("call_id is not null and conv_id is not null and turn is not null").groupBy("conv_id", "call_id").agg(F.min(F.when(is_call, place)).alias("first"), F.count_if(is_call).alias("n_calls"), F.count_if(F.col("kind") == "result").alias("n_results"))
    out = found.join(ids.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    for c in ("n_calls", "n_results"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    again = is_call & (F.col("n_calls") > 1) & (place != F.col("first"))
    out = out.withColumn("linked", F.col("turn").isNotNull() & F.when(is_call, (F.col("n_results") > 0) & ~again).when(F.col("kind") == "result", F.col("n_calls") > 0).otherwise(F.lit(False)))
    out = out.withColumn("problems", F.when(again, F.array_append("problems", F.lit("repeated id"))).otherwise(F.col("problems")))
    is_result = F.col("kind") == "result"
    return out.select(
        "conv_id", "turn", F.col("seq").cast("long").alias("seq"), "kind", "call_id", "linked", "n_calls", "n_results", F.array_join("problems", "; ").alias("problems"),
        (F.size("problems") == 0).alias("valid"),
        F.when(is_result, F.greatest(F.col("turn"), F.floor(F.col("first") / F.lit(1 << 32)).cast("long"))).otherwise(F.col("turn")).alias("order_turn"),
        is_result.cast("int").alias("order_rank"),
        "json",
    )
