"""Nested JSON results to flat tables whose rows keep their record and parent.

Every payload is parsed once; a depth-first traversal gives each object of interest its
pre- and post-order number, and nothing else about its place. Rows are then linked by
these labels alone: a row's parent is the tightest interval that holds its own. No shuffle
but the one that drops repeated records.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRAPPERS = ("payload", "data", "result", "results", "response", "body", "value", "record", "output", "item", "items")
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null))')


def parse_deep(text: str):
    """JSON of any depth without recursion; ValueError if it is not valid."""
    pos, stack, done, value, key, expect = 0, [], False, None, None, "value"
    while True:
        m = _TOKEN.match(text, pos)
        if not m:
            if done and not text[pos:].strip(" \t\n\r"):
                return value
            raise ValueError("not JSON")
        if done:
            raise ValueError("trailing data")
        pos = m.end()
        mark, string, atom = m.groups()
        if expect in ("key", "key_or_end"):
            if string:
                key, expect = json.loads(string), "colon"
                continue
            if mark != "}" or expect == "key":
                raise ValueError("key expected")
        elif expect == "colon":
            if mark != ":":
                raise ValueError("colon expected")
            expect = "value"
            continue
        elif expect == "comma_or_end":
            if mark == ",":
                expect = "key" if isinstance(stack[-1][0], dict) else "value"
                continue
            if mark not in ("}", "]") or (mark == "}") != isinstance(stack[-1][0], dict):
                raise ValueError("comma expected")
        elif mark == "{" or mark == "[":
            stack.append(({} if mark == "{" else [], key))
            expect, key = "key_or_end" if mark == "{" else "value_or_end", None
            continue
        elif mark == "]" and expect == "value_or_end":
            pass
        elif mark:
            raise ValueError("value expected")
        if mark:  # a container ends
            value, key = stack.pop()
        else:
            value = json.loads(string or atom)
        if not stack:
            done = True
            continue
        top = stack[-1][0]
        if isinstance(top, dict):
            top[key] = value
        else:
            top.append(value)
        expect, key = "comma_or_end", None


def _not_json(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(text: str):
    try:
        return json.loads(text, parse_constant=_not_json)
    except RecursionError:
        return parse_deep(text)


def dump(value) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(value)
    except RecursionError:
        pass
    out, work = [], [(value, True)]
    while work:
        v, fresh = work.pop()
        if not fresh:
            out.append(v)
        elif isinstance(v, dict):
            items = [[(json.dumps(k) + ": ", False), (x, True)] for k, x in v.items()]
            work += reversed([("{", False), *(y for i, it in enumerate(items) for y in ([(", ", False)] if i else []) + it), ("}", False)])
        elif isinstance(v, list):
            work += reversed([("[", False), *(y for i, x in enumerate(v) for y in ([(", ", False)] if i else []) + [(x, True)]), ("]", False)])
        else:
            out.append(json.dumps(v))
    return "".join(out)


def _fold(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", key.lower())


def _fields(obj: dict) -> dict:
    return {_fold(k): v for k, v in obj.items()}


def _list(v) -> list:
    """An object or scalar in place of an array is an array of one; nulls are left out."""
    return [x for x in (v if isinstance(v, list) else [v]) if x is not None]


#: Where each entity stands and the fields its row keeps.
ARRAYS = {"block": "blocks", "edge": "edges", "caller": "callers"}
GRAPH = {"blocks", "edges", "entryid", "exitid", "function"}
MARKS = {"blocks", "edges", "callers", "callees", "references", "symbol", "root", "entrypoint", "entryid", "function"}


def documents(value):
    """The objects inside wrappings, arrays and strings of JSON."""
    work = [value]
    while work:
        v = work.pop()
        if isinstance(v, str):
            try:
                work.append(parse(v))
            except ValueError:
                pass
        elif isinstance(v, list):
            work += reversed(v)
        elif isinstance(v, dict):
            f = _fields(v)
            inner = [f[w] for w in WRAPPERS if isinstance(f.get(w), (dict, list, str))]
            if inner and not MARKS & f.keys():
                work += reversed(inner)
            else:
                yield f


def _int(v):
    return v if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 63 else None


def _text(v):
    return v if isinstance(v, str) else None if v is None else dump(v)


def _array(v, one) -> list | None:
    return None if v is None else [one(x) for x in _list(v)]


def tightest(pre: list[int], post: list[int]) -> list[int]:
    """Index of the row with the smallest interval around each row's own, -1 where there is
    none. Intervals are nested or apart, so one sweep by ``pre`` finds it."""
    out, around = [-1] * len(pre), []
    for i in sorted(range(len(pre)), key=pre.__getitem__):
        while around and post[around[-1]] < pre[i]:
            around.pop()
        if around:
            out[i] = around[-1]
        around.append(i)
    return out


#: Objects that hold others; their rows come with ``headers`` only.
HOLDERS = ("record", "graph", "trace", "flow")


def entities(value, headers: bool = False) -> list[tuple]:
    """(entity, seq, parent_seq, parent_pre, pre, post, name, file_path, line, src, dst, detail, cond,
    code, lines, end_line, language, parent, notes) of one payload; with ``headers`` a row for the
    record and for each control-flow graph, trace and flow tree in it too."""
    seq, clock, none = dict.fromkeys((*HOLDERS, *ARRAYS, "flow_node"), 0), 0, (None,) * 7
    rows: list[list] = []  # [entity, seq, pre, post, fields]

    def enter(entity: str, fields: tuple, more: tuple = none) -> int:
        nonlocal clock
        clock += 1
        seq[entity] += 1
        rows.append([entity, seq[entity], clock, 0, (*fields, *more)])
        return len(rows) - 1

    def leave(at: int) -> None:
        nonlocal clock
        clock += 1
        rows[at][3] = clock

    bare = (None,) * 6
    top = enter("record", bare)
    for f in documents(value):
        holders = []
        if GRAPH & f.keys():
            more = (None, None, None, _int(f.get("endline")), _text(f.get("language")), _text(f.get("parent")), _array(f.get("notes"), _text))
            holders.append(enter("graph", (_text(f.get("function")), _text(f.get("file")), _int(f.get("startline")), _int(f.get("entryid")), _int(f.get("exitid")), None), more))
        if {"callers", "callees", "references"} & f.keys():
            symbol = f.get("symbol")
            holders.append(enter("trace", (_text(symbol.get("name") if isinstance(symbol, dict) else symbol), *bare[1:])))
        for entity, key in ARRAYS.items():
            for x in _list(f.get(key)):
                if not isinstance(x, dict):
                    seq[entity] += 1
                    continue
                g, more = _fields(x), none
                if entity == "block":
                    row = (_text(g.get("kind")), None, None, _int(g.get("id")), None, _text(g.get("label")))
                    more = (_text(g.get("cond")), _array(g.get("code"), _text), _array(g.get("lines"), _int), *none[3:])
                elif entity == "edge":
                    row = (_text(g.get("label")), None, None, _int(g.get("from")), _int(g.get("to")), "back" if g.get("back") is True else None)
                else:
                    row = (_text(g.get("caller")), _text(g.get("callerfile")), _int(g.get("callerline")), None, None, _text(g.get("callee")))
                leave(enter(entity, row, more))
        roots = [x for x in _list(f.get("root")) if isinstance(x, dict)]
        if roots:
            holders.append(enter("flow", (_text(f.get("entrypoint")), *bare[1:])))
        work = [(x, None) for x in reversed(roots)]
        while work:
            x, at = work.pop()
            if at is not None:
                leave(at)
            elif isinstance(x, dict):
                g = _fields(x)
                marks = ",".join(k for k in ("ref", "cycle", "depthcap") if g.get(k) is True) or None
                work.append((None, enter("flow_node", (_text(g.get("name")), _text(g.get("filepath")), _int(g.get("line")), None, None, marks))))
                work += [(c, None) for c in reversed(_list(g.get("children")))]
        for at in reversed(holders):
            leave(at)
    leave(top)
    around = tightest([r[2] for r in rows], [r[3] for r in rows])
    out = []
    for (entity, number, pre, post, fields), up in zip(rows, around):
        if headers or entity not in HOLDERS:
            above = rows[up] if up >= 0 else None
            out.append((entity, number, above[1] if above and above[0] == entity == "flow_node" else 0, above[2] if above else None, pre, post, *fields))
    return out


_COLUMNS = "entity string, seq int, parent_seq int, parent_pre int, pre int, post int, name string, file_path string, line long, src long, dst long, detail string, cond string, code array<string>, lines array<long>, end_line long, language string, parent string, notes array<string>"


def flatten(df: DataFrame, id_col: str, payload_col: str, *, headers: bool = False) -> DataFrame:
    """``(id, entity, seq, parent_seq, parent_pre, pre, post, ...)``: a row per object of a payload.

    ``seq`` counts from 1 within record and entity: array position without null
    elements, for flow nodes preorder. ``parent_seq`` is the parent flow node's
    ``seq``, else 0; ``parent_pre`` is the ``pre`` of the object around it, of whatever
    entity. ``pre`` and ``post`` are interval labels within the record. A payload that is null, empty or not valid JSON gives no row, nor does a null id;
    a repeated record counts once. Key spelling, wrapping objects, arrays around
    the object and JSON inside a string do not matter. Other columns are ignored.

    A block keeps its condition, code and lines. With ``headers`` the record, each
    control-flow graph, trace and flow tree give a row too, whose interval holds its
    parts: a graph's name is its function, line and end_line its place, src and dst its
    entry and exit block; a trace's name is its symbol, a flow's its entry point.
    Numbers beyond 64 bits are null.
    """
    kind = df.schema[id_col].dataType.simpleString()
    records = df.select(F.col(id_col).alias("id"), F.col(payload_col).cast("string").alias("payload")).where("id is not null and payload is not null").dropDuplicates(["id"])
    types = [pa.string(), *[pa.int32()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches):
        for batch in batches:
            who, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    own = entities(parse(text), headers)
                except ValueError:
                    continue
                who += [i] * len(own)
                rows += own
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["id", *names])

    return records.mapInArrow(run, f"id {kind}, {_COLUMNS}")


def tables(flat: DataFrame) -> dict[str, DataFrame]:
    """One table per entity, with the columns it has; all keep ``id`` and their labels.
    ``block_lines`` has a row per line of a block; the tables of holders are empty
    without headers. A part belongs to the holder whose ``pre`` is its ``parent_pre``."""
    keep = ["id", "seq", "parent_seq", "parent_pre", "pre", "post"]
    pick = lambda e, **cols: flat.where(F.col("entity") == e).select(*keep, *(F.col(c).alias(n) for n, c in cols.items()))
    return {
        "blocks": pick("block", block_id="src", kind="name", label="detail", cond="cond", code="code", lines="lines"),
        "block_lines": flat.where("entity = 'block'").select("id", F.col("seq").alias("block_seq"), F.posexplode("lines").alias("at", "line")).where("line is not null"),
        "graphs": pick("graph", function="name", file_path="file_path", start_line="line", end_line="end_line", entry_id="src", exit_id="dst", language="language", parent="parent", notes="notes"),
        "edges": pick("edge", src="src", dst="dst", label="name", back="detail"),
        "callers": pick("caller", caller="name", caller_file="file_path", caller_line="line", callee="detail"),
        "records": pick("record"),
        "traces": pick("trace", symbol="name"),
        "flows": pick("flow", entry_point="name"),
        "flow_nodes": pick("flow_node", name="name", file_path="file_path", line="line", marker="detail"),
    }
