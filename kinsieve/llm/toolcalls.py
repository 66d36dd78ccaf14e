"""Chat formatting with linked tool calls.

Calls and results are hash-joined by conversation and call id, put into topological order of their
dependencies, checked against the schemas of their tools and written as canonical JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinsieve.session import written

ROUNDS = 1_000
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def canonical(value) -> str:
    """JSON with sorted keys, no white space and no escapes but the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problem(arguments: str | None, schema: Mapping | None) -> tuple[object, str | None]:
    """The parsed arguments and what is wrong with them: the first violation in order of names, or None."""
    if schema is None:
        return None, "unknown tool"
    try:
        value = json.loads(arguments or "", parse_constant=lambda x: 1 / 0)
        canonical(value).encode()
    except (json.JSONDecodeError, ZeroDivisionError):
        return None, "arguments are not JSON"
    except (ValueError, RecursionError):
        # JSON, but too deep, or with numbers or lone surrogates that cannot be written again
        return None, "arguments have no canonical form"
    if not isinstance(value, dict):
        return value, "arguments are not an object"
    kinds, needed = schema.get("properties", {}), schema.get("required", [])
    for name in sorted({*kinds, *needed, *value}):
        if name not in value:
            if name in needed:
                return value, f"missing {name}"
            continue
        if name not in kinds:
            return value, f"unexpected {name}"
        kind = kinds[name]["type"]
        right = isinstance(value[name], _KINDS[kind]) and (kind == "boolean" or not isinstance(value[name], bool))
        if not right:
            return value, f"{name} is not {kind}"
        if "enum" in kinds[name] and value[name] not in kinds[name]["enum"]:
            return value, f"{name} is not allowed"
    return value, None


def _checked(schemas: Mapping[str, Mapping]):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, messages = [], []
            for row in batch.to_pylist():
                found, message = row["link"], None
                if found != "orphan result":
                    value, wrong = problem(row["arguments"], schemas.get(row["name"]))
                    found = found or wrong or "ok"
                    call = {"id": row["call_id"], "name": row["name"], "arguments": value if wrong is None else row["arguments"]}
                    message = {"call": call}
                else:
                    message = {"call": {"id": row["call_id"]}}
                if row["content"] is not None:
                    message["result"] = row["content"]
                status.append(found)
                messages.append(canonical(message))
            columns = {c: batch.column(c) for c in ("conv_id", "turn", "call_id", "level")}
            columns |= {"status": pa.array(status, pa.string()), "message": pa.array(messages, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return check


def levels(calls: DataFrame) -> DataFrame:
    """Topological level of every call: 0 without dependencies, else one more than its deepest dependency;
    missing for calls in, or behind, a cycle. Dependencies on calls that are not there do not count.

    All conversations advance together, one level a round, and each round joins only the calls that are still
    open; their number of rounds is the length of the longest chain.
    """
    ids = calls.select("conv_id", "call_id")
    needs = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needs")).distinct()
    needs = needs.join(ids.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi")
    needs = written(needs, "needs")
    done = written(ids.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    parts, fresh = [done], done
    for level in range(1, ROUNDS):
        reached = fresh.select("conv_id", F.col("call_id").alias("needs"))
        touched = needs.join(reached, ["conv_id", "needs"], "left_semi").select("conv_id", "call_id").distinct()
        needs = written(needs.join(reached, ["conv_id", "needs"], "left_anti"), "needs")
        fresh = written(touched.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "levels")
        if fresh.isEmpty():
            break
        parts.append(fresh)
    else:
        raise RuntimeError(f"chains of more than {ROUNDS} calls")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per call, and per result without a call: conv_id, turn, call_id, level, status, message.

    `calls` has conv_id, turn, call_id, name, arguments (JSON text), depends_on (ids); `results` has conv_id,
    turn, call_id, content. Status is, in this order: orphan result, repeated call (its id has an earlier
    call), cycle, no result, the first schema violation, or ok. The earliest of several results counts; ties
    go to the smaller content. Calls in order of (level, turn, call_id) never come before what they depend on.
    Exact repeats of a call are one call. Rows with a missing conv_id or call_id are left out; missing dependencies are none; an empty table gives
    no rows, and extra columns are ignored. `message` is canonical JSON of the call and its result; arguments that
    violate their schema, are not JSON or have no canonical form (numbers out of range, lone surrogates, too deep) are
    kept in it as text.
    """
    calls = calls.dropna(subset=["conv_id", "call_id"]).select(
        "conv_id", "turn", "call_id", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")
    ).distinct()
    results = results.dropna(subset=["conv_id", "call_id"])
    results = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    results = results.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), "r.content", F.lit(True).alias("answered"))
    key = ["conv_id", "call_id"]
    whole = F.struct("turn", "name", "arguments", "depends_on")
    firsts = calls.groupBy(*key).agg(F.min(whole).alias("c"), F.count("*").alias("times"))
    heads = written(firsts.select(*key, "c.*", "times"), "calls")
    ordered = heads.join(levels(heads), key, "left").join(results.hint("shuffle_hash"), key, "full_outer")
    known = F.col("times").isNotNull()
    state = F.when(~known, "orphan result").when(F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "no result")
    linked = ordered.select(*key, F.coalesce("turn", "result_turn").alias("turn"), "name", "arguments", "content", "level", state.alias("link"))
    again = calls.join(firsts.filter("times > 1"), key).filter(F.struct("turn", "name", "arguments", "depends_on") > F.col("c"))
    missing = lambda kind: F.lit(None).cast(kind)
    again = again.select(
        *key, "turn", "name", "arguments", missing("string").alias("content"), missing("int").alias("level"), F.lit("repeated call").alias("link")
    )
    out = "conv_id long, turn long, call_id string, level int, status string, message string"
    return linked.unionByName(again).mapInArrow(_checked(dict(schemas)), out)


# tools that the derived calls use
SCHEMAS = {
    "search": {
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}},
        "required": ["query"],
    },
    "note": {
        "properties": {"text": {"type": "string"}, "kind": {"type": "string", "enum": ["short", "long"]}},
        "required": ["text", "kind"],
    },
    "measure": {
        "properties": {"words": {"type": "integer"}, "ratio": {"type": "number"}},
        "required": ["words"],
    },
}


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results read into plain conversations (conv_id, turn, role, text).

    Every assistant turn is a call whose tool and arguments follow from its turn and whole text; the user turn
    after it is its result. A call depends on the one two turns before, within runs of eight turns. What does
    not fit (long notes without a kind, say) is left as it is: the schemas find it.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.split(F.trim(text), r"\s+"))
    call_id = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    tool = F.element_at(F.array(*[F.lit(t) for t in sorted(SCHEMAS)]), (F.pmod(turn + F.length(text), F.lit(3)) + 1).cast("int"))
    kind = F.when(F.length(text) < 200, "short").when(F.length(text) < 1_000, "long")
    arguments = (
        F.when(tool == "search", F.to_json(F.struct(text.alias("query"), (F.length(text) % 50).alias("limit"))))
        .when(tool == "note", F.to_json(F.struct(text.alias("text"), kind.alias("kind"))))
        .otherwise(F.to_json(F.struct(words.alias("words"), (F.length(text) / F.greatest(words, F.lit(1))).alias("ratio"))))
    )
    says = conversations.filter("role = 'assistant'")
    before = F.when(turn % 8 >= 2, F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>"))
    calls = says.select("conv_id", "turn", call_id(turn).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), before.alias("depends_on"))
    results = conversations.filter("role = 'user' AND turn > 0").select("conv_id", "turn", call_id(turn - 1).alias("call_id"), text.alias("content"))
    return calls, results
