"""Deeply nested records into related flat tables.

Method: structural variants.  A bottom-up tree automaton gives every JSON node
a state from its kind, the normalised names of its fields and the states of its
children; the state names the node's variant (an occurrence standing alone, a
list of them, a timeline carried as text, findings as list, map or text, ...).
The state routes each part to the table of its supertype, where common keys
(report, finding, part, place) link child to parent; :func:`variant_tables`
keeps a typed subtype table for every variant.

Nothing is walked by recursion, so a part may nest as deep as it likes, and
nothing is dropped: a value of another JSON type than its column's is kept in
``rest`` (and in the column too where it converts without loss), as are unknown
fields; what stands around a report is an ``envelope`` row.

Defined results: a body that is null, no complete JSON or without a report is
one row of table ``unreadable`` with the reason; a byte order mark is passed
over; null findings, null list elements and absent parts have no rows, but null
elements keep their place in the numbering; a part carried as JSON text is
read, whatever the number of layers; a text that is no JSON is a part without
fields where a timeline is expected, and a row with the text in ``rest``
elsewhere, unless it is blank; a map whose keys are numbers gives those as places; an element that
is a list has a row for each of its own elements, all at the outer place, told
apart by ``place``; repeated deliveries give repeated rows here,
:func:`child_keys` removes them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.session import shared_dir

TABLES = (
    "child_table string, report_id bigint, finding_id string, child_pos int, part string, place string, variant string, "
    "blob_id string, pattern_name string, exposure_state string, confidence_score bigint, confidence_tier string, redacted string, line_number bigint, byte_offset bigint, is_binary boolean, "
    "commit_sha string, commit_timestamp bigint, author string, path string, "
    "earliest_commit string, removal_commit string, evidence_note string, "
    "rule string, score bigint, detail string, rest string"
)
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(c.strip().split(" ")[0], _TYPES[c.strip().split(" ")[1]]) for c in TABLES.split(",")])
KEYS = ("report_id", "finding_id", "child_pos", "part", "place", "variant")

# The fields by which a shape is told, and the column each field goes to.
FINDING = {"blobid": "blob_id", "patternname": "pattern_name", "exposurestate": "exposure_state", "confidencescore": "confidence_score", "confidencetier": "confidence_tier", "redacted": "redacted", "linenumber": "line_number", "byteoffset": "byte_offset", "isbinary": "is_binary"}
OCCURRENCE = {"commitsha": "commit_sha", "committimestamp": "commit_timestamp", "author": "author", "path": "path"}
TIMELINE = {"earliestobservedcommit": "earliest_commit", "removalobservedcommit": "removal_commit", "evidencenote": "evidence_note"}
SIGNAL = {"rule": "rule", "score": "score", "detail": "detail"}
_MARKS = {
    "finding": FINDING.keys() | {"fulldigest", "fingerprint", "occurrences", "evidencesignals", "timeline", "category", "id"},
    "occurrence": OCCURRENCE.keys() | {"commitdate"},
    "timeline": TIMELINE.keys() | {"earliestobserveddate", "earliestobservedauthor", "removalobserveddate"},
    "signal": SIGNAL.keys(),
    "report": {"schemaversion", "findings", "coveragegaps", "tool", "scan", "summary", "fatalerror"},
}
#: The parts of a finding by name, and the columns of each table.
PARTS = {"occurrences": "occurrence", "evidencesignals": "signal", "timeline": "timeline"}
COLUMNS = {"finding": FINDING, "occurrence": OCCURRENCE, "signal": SIGNAL, "timeline": TIMELINE, "report": {}, "envelope": {}, "unreadable": {"detail": "detail"}}


@lru_cache(maxsize=10_000)
def norm(name: str) -> str:
    return "".join(x for x in name if x.isalnum()).lower()


# ------------------------------------------------- JSON of any depth

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")


def _read_scalar(text: str, at: int) -> tuple[Any, int]:
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1, True)
    m = _SCALAR.match(text, at)
    if not m:
        raise ValueError(f"no JSON at {at}")
    return json.loads(m.group()), m.end()


def _deep_loads(text: str) -> Any:
    """``json.loads`` without recursion, for what nests too deep for it."""
    skip = lambda i: _SPACE.match(text, i).end()
    open_: list[tuple[Any, Any]] = []  # container, key of its value that is being read
    at = skip(0)
    while True:
        c = text[at : at + 1]
        value: Any
        if c in ("{", "["):
            value = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                key = None
                if c == "{":
                    key, at = _key(text, at, skip)
                open_.append((value, key))
                continue
            at += 1
        else:
            value, at = _read_scalar(text, at)
        while True:  # a value is complete
            at = skip(at)
            if not open_:
                if at != len(text):
                    raise ValueError(f"extra data at {at}")
                return value
            box, key = open_.pop()
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            c, at = text[at : at + 1], at + 1
            if c == ",":
                at = skip(at)
                if isinstance(box, dict):
                    key, at = _key(text, at, skip)
                open_.append((box, key))
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(f"no JSON at {at - 1}")
            value = box


def _key(text: str, at: int, skip) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no value at {at}")
    return key, skip(at + 1)


def loads(text: str) -> Any:
    try:
        return json.loads(text)
    except RecursionError:
        return _deep_loads(text)


def dumps(value: Any) -> str:
    """``json.dumps`` of any depth, non-ASCII as it is."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[Any] = [(value,)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        (x,) = x
        if isinstance(x, dict) and x:
            todo.append("}")
            for i, (k, v) in enumerate(reversed(x.items())):
                todo += ([", "] if i else []) + [(v,), json.dumps(k, ensure_ascii=False) + ": "]
            todo.append("{")
        elif isinstance(x, list) and x:
            todo.append("]")
            for i, v in enumerate(reversed(x)):
                todo += ([", "] if i else []) + [(v,)]
            todo.append("[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def inside(value: Any) -> Any:
    """What a text carries, if it carries JSON, through all layers; itself otherwise."""
    while isinstance(value, str) and value.lstrip("﻿ \t\r\n")[:1] in ("{", "[", '"', "n"):
        try:
            then = loads(value.lstrip("﻿ \t\r\n"))
        except ValueError:
            return value
        if then == value:
            return value
        value = then
    return value


# ------------------------------------------------------------ the automaton


@lru_cache(maxsize=10_000)
def _object_state(names: frozenset[str]) -> str:
    if "schemaversion" in names or len(names & _MARKS["report"]) >= 3:
        return "report"
    best = max(("occurrence", "timeline", "signal", "finding"), key=lambda k: (len(names & _MARKS[k]), k))
    return best if names and len(names & _MARKS[best]) * 2 >= len(names) else "object"


#: A state: what wraps the node, outermost first (four at most are told apart), how many wraps there are, and what lies inside.
State = tuple[tuple[str, ...], int, str]


def _wrap(how: str, states: set[State]) -> State:
    """The transition of a list, map or text over the states of what is in it."""
    if not states:
        return (), 0, f"empty {how}"
    if len(states) > 1:
        return (how,), 1, "mixed"
    outer, n, leaf = next(iter(states))
    return (how, *outer[:3]), n + 1, leaf


def classify(value: Any) -> State:
    """The state of a node, from the leaves up."""
    done: list[State] = []  # states of complete nodes
    todo: list[tuple] = [("node", value)]
    while todo:
        op, x, *more = todo.pop()
        if op == "close":
            n, how = x, more[0]
            kids = set(done[len(done) - n :])
            del done[len(done) - n :]
            done.append(((), 0, "object") if how == "map" and len(kids) > 1 else _wrap(how, kids))
        elif isinstance(x, dict):
            state = _object_state(frozenset(map(norm, x)))
            kids = [v for v in x.values() if v is not None] if state == "object" else []
            if kids:
                todo.append(("close", len(kids), "map"))
                todo += (("node", v) for v in kids)
            else:
                done.append(((), 0, state))
        elif isinstance(x, list):
            kids = [v for v in x if v is not None]
            todo.append(("close", len(kids), "list"))
            todo += (("node", v) for v in kids)
        elif isinstance(x, str) and not isinstance(then := inside(x), str):
            todo += [("close", 1, "text"), ("node", then)]
        else:
            done.append(((), 0, "text" if isinstance(x, str) else "null" if x is None else "scalar"))
    return done[0]


def variant(state: State) -> str:
    outer, n, leaf = state
    return " of ".join([*outer, *(["deeper"] if n > len(outer) else []), leaf])


# ------------------------------------------------------------------ rows


def fields(value: dict) -> dict[str, Any]:
    return {norm(k): v for k, v in value.items()}


def report_of(body: str | None) -> tuple[dict[str, Any] | None, Any]:
    """(the report with normalised names, what stands around it), or (None, the reason)."""
    if body is None:
        return None, "null body"
    try:
        value = loads(body.lstrip("﻿ \t\r\n"))
    except ValueError as e:
        return None, f"no JSON: {e}"[:200]
    around: list[Any] = [value]
    todo: list[tuple[Any, Any]] = [(around, 0)]
    for box, key in todo:  # breadth first: the outermost report counts
        x = inside(box[key])
        if isinstance(x, dict):
            if _object_state(frozenset(map(norm, x))) == "report":
                box[key] = None
                return fields(x), around[0]
            box[key] = x
            todo += ((x, k) for k in x)
        elif isinstance(x, list):
            box[key] = x
            todo += ((x, i) for i in range(len(x)))
    return None, "no report inside"


def findings_of(report: dict[str, Any]) -> Iterator[tuple[str | None, dict[str, Any]]]:
    """(id, fields) of each finding, however lists, maps and texts hold them; a map's key is the id where none is inside."""
    todo: list[tuple[str | None, Any, bool]] = [(None, report.get("findings"), False)]
    while todo:
        key, x, held = todo.pop()
        x = inside(x)
        if isinstance(x, list):
            todo += [(key, y, True) for y in reversed(x)]
        elif isinstance(x, dict):
            state = classify(x)
            if state[2] == "finding" and state[1] or not held and state[2] != "finding":  # a map of findings
                todo += [(k, y, True) for k, y in reversed(x.items())]
            else:
                f = fields(x)
                found = f.get("id", f.get("findingid"))
                yield (key if found is None else found if isinstance(found, str) else dumps(found)), f


def _typed(name: str, value: Any) -> tuple[Any, bool]:
    """(column value, whether that is all there is to tell)."""
    kind = SCHEMA.field(name).type
    if value is None:
        return None, True
    if kind == pa.int64():
        if isinstance(value, int) and not isinstance(value, bool):
            return (value, True) if -(1 << 63) <= value < 1 << 63 else (None, False)
        if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
            return int(value), False
        if isinstance(value, str) and re.fullmatch(r"-?(?:0|[1-9]\d{0,17})", value):
            return int(value), False
        return None, False
    if kind == pa.bool_():
        return (value, True) if isinstance(value, bool) else ({"true": True, "false": False}.get(value) if isinstance(value, str) else None, False)
    return (value, True) if isinstance(value, str) else (dumps(value), True)


def _row(table: str, report_id: int | None, fid: str | None, pos: int, part: str | None, place: str, how: str, value: Any, leave: frozenset[str] = frozenset()) -> dict[str, Any]:
    names = COLUMNS[table]
    out = {"child_table": table, "report_id": report_id, "finding_id": fid, "child_pos": pos, "part": part, "place": place, "variant": how}
    if not isinstance(value, dict):
        return out | {"rest": None if value is None else dumps(value)}
    rest = {}
    for k, v in value.items():
        column = names.get(k)
        if column:
            out[column], whole = _typed(column, v)
            if not whole:
                rest[k] = v
        elif k not in leave:
            rest[k] = v
    return out | {"rest": dumps(rest) if rest else None}


def _elements(value: Any, blank: bool) -> Iterator[tuple[int, str, Any]]:
    """(place in the list, whole place, element) of a part: alone, in lists, in a map of places, or as text."""
    value = inside(value)
    if isinstance(value, str) and not value.strip() and not blank:
        return
    if isinstance(value, dict) and value and all(k.isascii() and k.isdigit() and len(k) < 10 for k in value):
        first = [(int(k), k, v) for k, v in value.items()]
    else:
        first = [(i, str(i), v) for i, v in enumerate(value)] if isinstance(value, list) else [(0, "0", value)]
    todo = first[::-1]
    while todo:
        pos, place, x = todo.pop()
        x = inside(x)
        if isinstance(x, list):
            todo += [(pos, f"{place}.{i}", y) for i, y in reversed(list(enumerate(x)))]
        elif x is not None:
            yield pos, place, x


def rows_of(report_id: int | None, body: str | None) -> Iterator[dict[str, Any]]:
    report, around = report_of(body)
    if report is None:
        yield _row("unreadable", report_id, None, 0, None, "0", "unreadable", body) | {"detail": around}
        return
    yield _row("report", report_id, None, 0, None, "0", "report", report, frozenset(("findings",)))
    if around is not None:
        yield _row("envelope", report_id, None, 0, None, "0", variant(classify(around)), around)
    for fid, f in findings_of(report):
        parts = {}
        for name, value in f.items():
            named = PARTS.get(name)
            if named or isinstance(value, (dict, list)) or isinstance(value, str) and value[:1] in "[{":
                state = classify(value)
                table = state[2] if state[2] in ("occurrence", "signal", "timeline") else named
                if table and name not in FINDING:
                    parts[name] = (named or table, variant(state), value)  # what a known name holds goes to that name's table
        yield _row("finding", report_id, fid, 0, "findings", "0", "finding", f, frozenset(parts) | {"id"})
        for name, (table, how, value) in parts.items():
            for pos, place, x in _elements(value, table == "timeline"):
                yield _row(table, report_id, fid, pos, name, place, how, fields(x) if isinstance(x, dict) else x)


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for batch in batches:
        for rid, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            for r in rows_of(rid, body.as_py()):
                out.append(r)
                if len(out) == 5_000:
                    yield pa.RecordBatch.from_pylist(out, SCHEMA)
                    out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, SCHEMA)


def flat_tables(reports: DataFrame) -> DataFrame:
    """The rows of all tables of ``reports(report_id, body)``, told apart by ``child_table``.

    Repeated deliveries are dropped by digest before anything is parsed.
    """
    d = F.sha2(F.col("body"), 256)
    one = reports.select(F.col("report_id").cast("bigint").alias("report_id"), F.col("body").cast("string").alias("body")).groupBy("report_id", d.alias("_d")).agg(F.first("body").alias("body"))
    return one.select("report_id", "body").mapInArrow(_flatten, TABLES)


def typed(flat: DataFrame, child_table: str) -> DataFrame:
    """One supertype's table: the common keys, its own typed columns, and the rest."""
    return flat.where(F.col("child_table") == child_table).select(*KEYS, *dict.fromkeys(COLUMNS[child_table].values()), "rest")


def variant_tables(reports: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows to a folder per (supertype, variant), and read the whole back.

    A filter on both reads that subtype's files only; the folder is ``path`` or
    one in the shared folder.
    """
    import uuid

    spark = reports.sparkSession
    path = path or f"{shared_dir(spark)}/orelode/variants-{uuid.uuid4().hex}"
    flat_tables(reports).write.partitionBy("child_table", "variant").parquet(path)
    return spark.read.schema(TABLES).parquet(path)


def child_keys(flat: DataFrame) -> DataFrame:
    """``(child_table, report_id, finding_id, child_pos)`` of findings and of their named parts, distinct."""
    named = F.col("part").isin("findings", *PARTS)
    return flat.where(F.col("child_table").isin("finding", *PARTS.values()) & named).select("child_table", "report_id", "finding_id", "child_pos").distinct()
