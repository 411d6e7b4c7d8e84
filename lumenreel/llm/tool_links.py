"""Tool-call linking for chat formatting.

Calls and results meet in a hash join on (conversation, identifier), both reduced to one row per identifier
first. Calls that need other calls' results are ordered by level: 0 without needs, else one more than the
highest level needed. Calls of nearby turns are ordered together in bounded slots; what hangs together over longer
distances takes rounds of joins between slots, in which an edge also skips a call that has a single open need itself.
Arguments are checked against the
tools' JSON schemas and every call is written as one line of canonical JSON (keys sorted by UTF-16 units, no
blanks, shortest numbers). No conversation has to fit in one place: the order within it is (level, turn,
call_id), columns of each row.

Defined results: of calls (results) with one identifier the first by turn counts, then the smallest; others are
counted in errors (repeated_call, repeated_result). Results without a call give rows without level (orphan_result).
A null identifier links with nothing (no_id). Needs that no call has are dropped (unknown_need); calls on or
behind a cycle have no level (cycle). Null or unreadable arguments are bad_json and written as they are. A null
conversation is one of its own. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer(),
}


def faults(value: Any, schema: dict, at: str = "") -> list[str]:
    """Where ``value`` breaks ``schema`` (type, enum, bounds, lengths, properties, items)."""
    found, where = [], at or "."
    kinds = schema.get("type")
    if kinds and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"type:{where}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"enum:{where}")
    if _TYPES["number"](value):
        if value < schema.get("minimum", -math.inf):
            found.append(f"minimum:{where}")
        if value > schema.get("maximum", math.inf):
            found.append(f"maximum:{where}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"minLength:{where}")
        if len(value) > schema.get("maxLength", math.inf):
            found.append(f"maxLength:{where}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"required:{at}.{k}" for k in schema.get("required", []) if k not in value]
        for key in sorted(value):
            if key in known:
                found += faults(value[key], known[key], f"{at}.{key}")
            elif schema.get("additionalProperties") is False:
                found.append(f"unknown:{at}.{key}")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            found += faults(item, schema["items"], f"{at}[{k}]")
    return found


def canonical(value: Any) -> str:
    """Canonical JSON of a value."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if value.is_integer() and abs(value) < 1e21:
            return str(int(value))
        return re.sub(r"e([+-])0*", r"e\1", json.dumps(value))
    return json.dumps(value, ensure_ascii=False)


#: Turns that are ordered together, and calls elsewhere that one of them may hang on there.
SPAN, FAR = 4096, 64


def _first(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per (conv_id, call_id): the first by turn, and how many there are."""
    return rows.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", *columns)).alias("first"), F.count("*").alias("copies")
    )


def _same(a: DataFrame, b: DataFrame, left: str = "call_id", right: str = "call_id"):
    return a["conv_id"].eqNullSafe(b["conv_id"]) & (a[left] == b[right])


def _near(table: pa.Table) -> pa.Table:
    """Order the calls of a slot as far as it goes without calls of other slots.

    In: a row per need of a call (child, parent), parent null for calls without any. Out: a row without parent for every
    call whose level ``b`` is settled. Any other has a row per call of another slot that it hangs on: it is at least
    ``w`` above it, and at least at ``b``. Calls that hang on more than ``FAR`` keep their own needs, like those of cycles.
    """
    conversations, children, parents = (table.column(c).to_pylist() for c in ("conv_id", "child", "parent"))
    needs: dict[tuple, list[tuple]] = {}
    for conv, child, parent in zip(conversations, children, parents):
        own = needs.setdefault((conv, child), [])
        if parent is not None:
            own.append((conv, parent))
    waiting = {c: sum(p in needs for p in own) for c, own in needs.items()}
    behind: dict[tuple, list[tuple]] = {}
    for c, own in needs.items():
        for p in own:
            if p in needs:
                behind.setdefault(p, []).append(c)
    ready = [c for c, n in waiting.items() if not n]
    base: dict[tuple, int] = {}
    far: dict[tuple, dict[tuple, int]] = {}
    rows: list[tuple] = []
    while ready:
        c = ready.pop()
        level, hangs = 0, {}
        for p in needs[c]:
            if p in base:
                level = max(level, base[p] + 1)
                for q, w in far[p].items():
                    hangs[q] = max(hangs.get(q, 0), w + 1)
            else:
                hangs[p] = max(hangs.get(p, 0), 1)
        if len(hangs) > FAR:
            rows += [(*c, p[1], 1, 0) for p in needs[c]]
        else:
            base[c], far[c] = level, hangs
            rows += [(*c, q[1], w, level) for q, w in hangs.items()] or [(*c, None, 0, level)]
        for child in behind.get(c, ()):
            waiting[child] -= 1
            if not waiting[child]:
                ready.append(child)
    rows += [(*c, p[1], 1, 0) for c, n in waiting.items() if n for p in needs[c]]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.Table.from_arrays(columns, names=["conv_id", "child", "parent", "w", "b"])


def _slots(calls: DataFrame, span: int) -> DataFrame:
    """conv_id, call_id and the slot of every call: those of a range of turns are together, but never too many."""
    nodes = calls.withColumn("range", F.floor(F.coalesce("turn", F.lit(0)) / span))
    crowded = nodes.groupBy("conv_id", "range").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * span)
    crowded = crowded.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), F.ceil(F.col("n") / span).alias("cuts"))
    nodes = nodes.join(crowded, nodes.conv_id.eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r")), "left")
    cut = F.coalesce(F.pmod(F.xxhash64("call_id"), F.col("cuts")), F.lit(0))
    shuffles = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(shuffles, -(-calls.count() // (4 * span)))
    return nodes.select("conv_id", "call_id", F.pmod(F.xxhash64("conv_id", "range", cut), F.lit(slots)).alias("slot"))


def levels(calls: DataFrame, edges: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, call_id, level of every call that is not on or behind a cycle.

    ``calls``: conv_id, call_id, turn. ``edges`` (conv_id, child, parent) lead to calls that are there. Calls of nearby
    turns are ordered together in one pass. What is left are calls that hang on others far away; of these only the ones
    that others hang on take part in rounds, the rest follow from them.
    """
    slots = _slots(calls, span)
    edges = edges.select(F.col("conv_id").alias("_c"), F.col("child").alias("_i"), "parent").distinct()
    needs = slots.join(edges, slots.conv_id.eqNullSafe(F.col("_c")) & (slots.call_id == F.col("_i")), "left")
    near = written(
        needs.select("slot", "conv_id", F.col("call_id").alias("child"), "parent").groupBy("slot").applyInArrow(
            _near, "conv_id long, child string, parent string, w long, b long"
        )
    )
    settled = near.filter("parent is null").select("conv_id", F.col("child").alias("call_id"), F.col("b").alias("level"))
    open_edges = near.filter("parent is not null")
    if open_edges.isEmpty():
        return settled
    hung_on = open_edges.select(F.col("conv_id").alias("_c"), F.col("parent").alias("_p")).distinct()
    is_hung_on = lambda df, name: df.conv_id.eqNullSafe(F.col("_c")) & (df[name] == F.col("_p"))
    start = settled.join(hung_on, is_hung_on(settled, "call_id"), "left_semi")
    known = _rounds(start, open_edges.join(hung_on, is_hung_on(open_edges, "child"), "left_semi"))
    return settled.unionByName(_ready(known, open_edges))


def _ready(done: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of the children whose parents are all done."""
    known = done.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"), "level")
    at = edges.join(known, edges.conv_id.eqNullSafe(F.col("_c")) & (edges.parent == F.col("_p")), "left")
    found = at.groupBy("conv_id", "child").agg(
        F.count("*").alias("needs"), F.count("level").alias("met"),
        F.greatest(F.max(F.col("level") + F.col("w")), F.max("b")).alias("level"),
    ).filter("needs = met")
    return found.select("conv_id", F.col("child").alias("call_id"), "level")


def _rounds(done: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels by rounds of joins; an edge to a call with a single open need skips to that need."""
    done, edges = written(done), written(edges)
    while True:
        ready = written(_ready(done, edges))
        if ready.isEmpty():
            return done
        done = written(done.unionByName(ready), instead_of=done)
        edges_left = edges.join(ready, edges.conv_id.eqNullSafe(ready.conv_id) & (edges.child == ready.call_id), "left_anti")
        single = edges_left.groupBy("conv_id", "child").agg(
            F.count("*").alias("needs"), F.min("parent").alias("_next"), F.max("w").alias("_w"), F.max("b").alias("_b")
        ).filter("needs = 1").select(F.col("conv_id").alias("_c"), F.col("child").alias("_p"), "_next", "_w", "_b")
        skipped = edges_left.join(single, edges_left.conv_id.eqNullSafe(F.col("_c")) & (edges_left.parent == F.col("_p")), "left")
        most = F.lit(1 << 40)
        edges = written(
            skipped.groupBy("conv_id", "child", F.coalesce("_next", "parent").alias("parent")).agg(
                F.max(F.least(F.col("w") + F.coalesce("_w", F.lit(0)), most)).alias("w"),
                F.max(F.greatest("b", F.least(F.col("w") + F.coalesce("_b", F.lit(0)), most))).alias("b"),
            ),
            instead_of=edges,
        )


def _checked(schemas: dict[str, dict]):
    def row(x: dict) -> tuple[str, str]:
        errors = list(x["errors"])
        if x["called"]:
            try:
                arguments = json.loads(x["arguments"])
            except (TypeError, ValueError):
                arguments = x["arguments"]
                errors.append("bad_json")
            else:
                if x["name"] in schemas:
                    errors += faults(arguments, schemas[x["name"]])
                else:
                    errors.append("unknown_tool")
            message = {"arguments": arguments, "id": x["call_id"], "name": x["name"], "result": x["result"]}
        else:
            message = {"id": x["call_id"], "result": x["result"]}
        return ",".join(errors), canonical(message)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row(x) for x in batch.select(["call_id", "name", "arguments", "result", "called", "errors"]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "call_id", "name", "level", "turn", "result_turn")),
                 pa.array([e for e, _ in found], pa.string()), pa.array([m for _, m in found], pa.string())],
                names=["conv_id", "call_id", "name", "level", "turn", "result_turn", "errors", "message"],
            )

    return run


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and per result without one.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), needs (array of identifiers). ``results``: conv_id,
    call_id, turn, content. Returns conv_id, call_id, name, level, turn, result_turn, errors, message.
    """
    calls = calls.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"),
        F.col("turn").cast("bigint").alias("turn"), "name", "arguments",
        F.coalesce("needs", F.array().cast("array<string>")).alias("needs"),
    )
    results = results.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"),
        F.col("turn").cast("bigint").alias("turn"), "content",
    )
    first = written(_first(calls.filter("call_id is not null"), "name", "arguments", "needs"))
    answer = _first(results.filter("call_id is not null"), "content").select(
        F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("first").alias("answer"),
        F.col("copies").alias("answers"),
    )
    wanted = first.select("conv_id", F.col("call_id").alias("child"), F.explode("first.needs").alias("parent")).distinct()
    known = first.select("conv_id", "call_id")
    edges = wanted.join(known, _same(wanted, known, "parent"), "left_semi")
    lost = wanted.join(known, _same(wanted, known, "parent"), "left_anti").groupBy("conv_id", "child").agg(F.count("*").alias("lost"))
    level = levels(first.select("conv_id", "call_id", "first.turn"), edges)
    side = lambda df, name, *columns: df.select(F.col("conv_id").alias("_c"), F.col(name).alias("_i"), *columns)
    met = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i"))
    rows = first.join(side(level, "call_id", "level"), met, "left").drop("_c", "_i")
    rows = rows.join(side(lost, "child", "lost"), met, "left").drop("_c", "_i")
    rows = rows.join(answer, rows.conv_id.eqNullSafe(answer.r_conv) & (rows.call_id == answer.r_id), "full")
    called = F.col("call_id").isNotNull()
    errors = F.array_compact(F.array(
        F.when(~called, "orphan_result"), F.when(F.col("copies") > 1, "repeated_call"),
        F.when(F.col("answers") > 1, "repeated_result"), F.when(F.col("lost") > 0, "unknown_need"),
        F.when(called & F.col("level").isNull(), "cycle"),
        F.when(called & (F.col("answer.turn") < F.col("first.turn")), "result_before_call"),
    ))
    rows = rows.select(
        F.when(called, F.col("conv_id")).otherwise(F.col("r_conv")).alias("conv_id"),
        F.coalesce("call_id", "r_id").alias("call_id"), "first.name", "level", "first.turn",
        F.col("answer.turn").alias("result_turn"), "first.arguments", F.col("answer.content").alias("result"),
        called.alias("called"), errors.alias("errors"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    unnamed = calls.filter("call_id is null").select(
        "conv_id", "call_id", "name", F.lit(0).cast("long").alias("level"), "turn", none("long").alias("result_turn"),
        "arguments", none("string").alias("result"), F.lit(True).alias("called"), F.array(F.lit("no_id")).alias("errors"),
    ).unionByName(results.filter("call_id is null").select(
        "conv_id", "call_id", none("string").alias("name"), none("long").alias("level"), none("long").alias("turn"),
        F.col("turn").alias("result_turn"), none("string").alias("arguments"), F.col("content").alias("result"),
        F.lit(False).alias("called"), F.array(F.lit("no_id")).alias("errors"),
    ))
    return rows.unionByName(unnamed).mapInArrow(
        _checked(schemas),
        "conv_id long, call_id string, name string, level long, turn long, result_turn long, errors string, message string",
    )
