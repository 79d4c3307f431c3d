"""Tool calls of conversations: link results, order, validate, serialise.

Calls and results meet in a hash join on (conversation, call id). A call may
name the call whose result led to it; the depth below the first call is found by
pointer doubling, in as many rounds as the logarithm of the longest chain, so
that a conversation of any length is never gathered. Order in a conversation is
by depth, then turn, then id: a call always comes after the one it depends on.

Nulls, empty and odd input: every call has a row, and so has every result that
no call was given. Calls and results without id are ``no_id``; of calls with
one id the first turn is linked, further ones are ``duplicate``, with their own
arguments checked and no result, level or place; of results with one id the
first turn is linked, further ones are ``duplicate``; results without a call
are ``orphan``, each of them. ``kind`` tells calls, results and other turns apart;
the latter (``turn``, such as system turns) come with status ``plain``. A parent
that does not exist makes a call a root with status ``no_parent``; calls on a
cycle or below one get ``cycle``, a null level and the last places. Arguments
that are no JSON object, or are nested too deeply to be written, are invalid.
Half of a surrogate pair, which JSON can name but no text can hold, stays
escaped. Further columns do not matter.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from airtrace.llm.arrow import map_texts
from airtrace.llm.common import indexed, require
from airtrace.session import materialise

KEY = ["conv_id", "call_id"]
# JSON types and the Python types they are read as.
TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
LONE = re.compile("[\ud800-\udfff]")
#: The tool of plain conversations: a user turn asks, the assistant's next turn is the result.
REPLY_SCHEMA = {
    "reply": {
        "type": "object", "required": ["turn", "text"], "additionalProperties": False,
        "properties": {"turn": {"type": "integer", "minimum": 0}, "text": {"type": "string", "minLength": 1}},
    }
}


def problem(value: Any, schema: dict, at: str = "$") -> str | None:
    """The first breach of a schema, or None. Booleans are no numbers."""
    kind = schema.get("type")
    if kind:
        ok = isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))
        if not ok:
            return f"{at}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{at}: too long"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of range"
    if isinstance(value, list) and "items" in schema:
        return next((p for i, v in enumerate(value) if (p := problem(v, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                if p := problem(value[name], known[name], f"{at}.{name}"):
                    return p
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name}: not expected"
    return None


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks and plain characters."""
    return writable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def writable(text: str) -> str:
    """Lone surrogates as escapes: a text column cannot hold them."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def depths(calls: DataFrame) -> DataFrame:
    """Key and ``level`` of calls (conv_id, call_id, parent_id); null on and below cycles."""
    ids = calls.select(*KEY)
    up = calls.select(*KEY, F.col("parent_id").alias("up")).where(F.col("up").isNotNull())
    there = ids.select("conv_id", F.col("call_id").alias("up"))
    state = ids.join(up.join(there, ["conv_id", "up"]), KEY, "left")
    state = state.select(*KEY, "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("level"))
    state = materialise(state, "depths")
    rounds = max(int(state.count()), 1).bit_length() + 1
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            return state.select(*KEY, "level")
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
        open_rows = state.where("up is not null").join(above, ["conv_id", "up"])
        moved = open_rows.select(*KEY, F.col("up2").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        state = materialise(state.where("up is null").select(*KEY, "up", "level").unionByName(moved), "depths")
    return state.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_tool_calls(
    calls: DataFrame, results: DataFrame, schemas: dict[str, dict], others: DataFrame | None = None
) -> DataFrame:
    """One row per call, per result not linked to one and per other turn, with order, validity and canonical JSON.

    ``calls``: conv_id, turn, call_id, parent_id, name, arguments (JSON text).
    ``results``: conv_id, turn, call_id, content.
    ``others``: conv_id, turn, role, content.
    """
    require(calls, "conv_id", "turn", "call_id", "parent_id", "name", "arguments")
    require(results, "conv_id", "turn", "call_id", "content")
    calls = calls.select("conv_id", "turn", "call_id", "parent_id", "name", "arguments")
    calls = materialise(calls.withColumn("_row", F.monotonically_increasing_id()), "all-calls")
    results = results.select("conv_id", "turn", "call_id", "content")
    results = materialise(results.withColumn("_row", F.monotonically_increasing_id()), "all-results")
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    late = F.col("turn").isNull().alias("_late")
    body = F.struct(late, "turn", "parent_id", "name", "arguments", "_row")
    first = calls.where(has_id).groupBy(*KEY).agg(F.min(body).alias("c"), F.count("*").alias("n_calls"))
    first = first.select(*KEY, "c.turn", "c.parent_id", "c.name", "c.arguments", "c._row", "n_calls")
    first = materialise(first, "calls")
    answer = results.where(has_id).groupBy(*KEY).agg(F.min(F.struct(late, "turn", "content", "_row")).alias("r"))
    answer = materialise(answer, "answers")
    linked = first.join(answer.hint("shuffle_hash"), KEY, "left").join(depths(first), KEY)
    parent = first.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("has_parent"))
    linked = linked.join(parent, ["conv_id", "parent_id"], "left")
    status = (
        F.when(F.col("level").isNull(), "cycle").when(F.col("r").isNull(), "no_result")
        .when(F.col("parent_id").isNotNull() & F.col("has_parent").isNull(), "no_parent").otherwise("ok"))
    out = linked.select(
        *KEY, "turn", "name", "arguments", F.col("r.content").alias("content"), "level", "n_calls", status.alias("status"))
    out = out.withColumn("deep", F.coalesce("level", F.lit((1 << 62)))).withColumn("at", F.coalesce("turn", F.lit(1 << 62)))
    out = indexed(out, "conv_id", "deep", "at", "call_id").drop("deep", "at")
    out = materialise(out, "linked")
    begins = out.groupBy("conv_id").agg(F.min("index").alias("begin"))
    out = out.join(begins, "conv_id").withColumn("place", F.col("index") - F.col("begin")).drop("index", "begin")
    out = out.withColumn("kind", F.lit("call"))
    used = answer.join(first.select(*KEY), KEY, "left_semi").select("r._row")
    more_calls = calls.join(first.select("_row"), "_row", "left_anti").select(
        *KEY, "turn", "name", "arguments", F.when(has_id, "duplicate").otherwise("no_id").alias("status"), F.lit("call").alias("kind"))
    known = first.select(*KEY, F.lit(True).alias("known"))
    more_results = results.join(used, "_row", "left_anti").join(known, KEY, "left").select(
        *KEY, "turn", "content", F.lit("result").alias("kind"),
        F.when(~has_id, "no_id").when(F.col("known"), "duplicate").otherwise("orphan").alias("status"))
    out = more_calls.unionByName(more_results, allowMissingColumns=True).unionByName(out, allowMissingColumns=True)
    if others is not None:
        require(others, "conv_id", "turn", "role", "content")
        plain = others.select("conv_id", "turn", "role", "content", F.lit("turn").alias("kind"), F.lit("plain").alias("status"))
        out = out.unionByName(plain, allowMissingColumns=True)
    return _serialised(out, schemas)


def _serialised(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    role = [c for c in ("role",) if c in rows.columns]
    fields = ("call_id", "name", "arguments", "content", "level", "place", "status", "kind", *role)
    packed = rows.withColumn("_row", F.to_json(F.struct(*fields)))
    added = StructType([
        StructField("valid", BooleanType()), StructField("problem", StringType()), StructField("canonical", StringType())])

    def run(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"valid": [], "problem": [], "canonical": []}
        for text in texts:
            row = json.loads(text)
            if row["kind"] == "turn":
                out["valid"].append(True)
                out["problem"].append(None)
                out["canonical"].append(canonical({"content": row.get("content"), "role": row.get("role")}))
                continue
            arguments, wrong = None, None
            try:
                arguments = json.loads(row.get("arguments") or "")
            except (ValueError, RecursionError):
                wrong = "$: no JSON"
            name = row.get("name")
            if wrong is None:
                wrong = problem(arguments, schemas[name]) if name in schemas else f"unknown tool {name}"
            call = {"arguments": arguments, "id": row.get("call_id"), "name": name}
            made = {"call": call, "level": row.get("level"), "place": row.get("place"), "result": row.get("content"), "status": row["status"]}
            try:
                text = canonical(made)
            except (ValueError, RecursionError) as error:
                wrong = "$: number out of range" if isinstance(error, ValueError) else "$: nested too deeply"
                call["arguments"] = None
                text = canonical(made)
            out["valid"].append(wrong is None)
            out["problem"].append(wrong and writable(wrong))
            out["canonical"].append(text)
        return out

    return map_texts(packed, "_row", run, added).drop("_row", "arguments", "content", *role)


def replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain conversations as calls, results and other turns.

    A user turn calls ``reply`` and depends on the user turn two before; an
    assistant turn is the result of the call one turn before. Turns of other
    roles, such as system, and of no role neither call nor answer.
    """
    require(conversations, "conv_id", "turn", "role", "text")
    name = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    asked = conversations.where(F.col("role") == "user")
    calls = asked.select(
        "conv_id", "turn", name(0).alias("call_id"), F.when(F.col("turn") >= 2, name(2)).alias("parent_id"),
        F.lit("reply").alias("name"), F.to_json(F.struct("turn", "text")).alias("arguments"))
    results = conversations.where(F.col("role") == "assistant").select(
        "conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))
    neither = F.col("role").isNull() | ~F.col("role").isin("user", "assistant")
    others = conversations.where(neither).select("conv_id", "turn", "role", F.col("text").alias("content"))
    return calls, results, others
