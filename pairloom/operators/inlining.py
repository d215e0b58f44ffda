"""Deeply nested records into related flat tables, by shared inlining (problem 6).

A first pass analyses the schema graph of all payloads. Its nodes are elements, told by their
names, and its edges say which field of which element holds which element, and how: once, as a
list, or as an object keyed by data. An element becomes a table if it is repeated, if several
fields hold it (shared), or if it lies within itself (recursive), one table for all the places and
depths where it stands; any other is inlined into the table above it. Plain values are columns. A second
pass emits one row per element of each table with the fields, positions and keys that lead to it,
from which own and foreign keys follow. Strings that hold JSON are decoded wherever they stand, so
all shapes of a part meet in one element.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.session import dealt_out

#: An element with more distinct fields than this, over all payloads, is keyed by data.
MAP_KEYS = 64
#: More edges than this are no schema; the graph is read on the driver, so this bounds it.
MAX_EDGES = 200_000
#: The element of a payload as a whole, and the fields that hold what lies straight in a list or in an object keyed by data.
ROOT, INNER, KEYED = "$", "[]", "{}"

Edge = tuple[str, str]

LIST, MAP = "list", "map"


class Unreadable(ValueError):
    """A payload that is null, blank or not complete JSON."""


def decode(payload: str | None) -> object:
    """The value of a JSON text, NaN being a number; a text that is a JSON string of JSON is decoded again."""
    if payload is None or not payload.strip():
        raise Unreadable
    value: object = payload
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError) as e:
            raise Unreadable from e
    return value


def part(value: object) -> object:
    """A part of a value; a string that holds an object, a list, a null or such a string is decoded, any other stays."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"', "n"):
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            break
        if not (inner is None or isinstance(inner, (dict, list, str))):
            break
        value = inner
    return value


def _kind(value: object) -> str:
    return {dict: "object", list: "list", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")


def elements(value: object, mode: str, names: tuple[str, ...] = ()) -> Iterator[tuple[str, object]]:
    """(position or key, element) of a repeated part, whatever its shape.

    As a list: its elements with their positions, null ones left out; a single object is element 0.
    As a map: the entries of an object, null values too; if listed instead, the non-null elements,
    keyed by the first of ``names`` they have, or by themselves if they are text.
    """
    if mode == LIST:
        if isinstance(value, list):
            yield from ((str(i), x) for i, x in enumerate(map(part, value)) if x is not None)
        elif isinstance(value, dict):
            yield "0", value
    elif isinstance(value, dict):
        yield from ((k, part(x)) for k, x in value.items())
    elif isinstance(value, list):
        for x in map(part, value):
            if x is not None:
                keys = [x.get(n) for n in names if x.get(n) is not None] if isinstance(x, dict) else [x]
                yield str(keys[0]) if keys else "", x


def _below(element: str, field: str) -> str:
    """The element that a field holds: the one of its name."""
    return element + field if field in (INNER, KEYED) else field


def _fields(element: str, value: object, keyed: set[str]) -> Iterator[tuple[str, object]]:
    """The fields of an element and their values."""
    if isinstance(value, list):
        yield INNER, value
    elif isinstance(value, dict):
        if element in keyed:
            yield KEYED, value
        else:
            yield from ((k, part(x)) for k, x in value.items())


def _summary(payload: str, modes: dict[Edge, str], names: dict[Edge, tuple[str, ...]], keyed: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds: dict[tuple[str, str, str], int] = {}
        seen: dict[str, set[str]] = {}
        for b in batches:
            for text in b[payload]:
                try:
                    todo = [(ROOT, decode(text))]
                except Unreadable:
                    continue
                while todo:
                    element, value = todo.pop()
                    known = seen.setdefault(element, set())
                    for field, x in _fields(element, value, keyed):
                        if field not in known:
                            if len(known) > MAP_KEYS:  # it is keyed by data whatever else comes
                                continue
                            known.add(field)
                        kind = _kind(x)
                        mode = MAP if field == KEYED else modes.get((element, field)) or (LIST if kind == "list" else None)
                        inner = [x] if mode is None else [v for _, v in elements(x, mode, names.get((element, field), ()))]
                        holds = mode is not None or kind == "object"
                        kinds[element, field, kind] = kinds.get((element, field, kind), 0) + 1
                        if holds:
                            todo.extend((_below(element, field), v) for v in inner if isinstance(v, (dict, list)))
        yield pd.DataFrame([(*e, n) for e, n in kinds.items()], columns=["element", "field", "kind", "n"])

    return run


def schema_graph(docs: DataFrame, payload: str, modes: dict[Edge, str], names: dict[Edge, tuple[str, ...]], keyed: set[str]) -> DataFrame:
    """Edges of the schema graph: element, field, kind, n (values of the kind), over all rows; unreadable payloads have none."""
    schema = "element string, field string, kind string, n bigint"
    return dealt_out(docs.select(payload)).mapInPandas(_summary(payload, modes, names, keyed), schema).groupBy("element", "field", "kind").agg(F.sum("n").alias("n"))


class Graph:
    """The schema graph with what follows from it: which fields are repeated, which elements are keyed by data, and which are tables."""

    def __init__(self, docs: DataFrame, payload: str, declared: dict[Edge, str], names: dict[Edge, tuple[str, ...]]):
        self.names, self.keyed = names, set()
        while True:
            edges = schema_graph(docs, payload, declared, names, self.keyed)
            rows = edges.limit(MAX_EDGES + 1).collect()
            if len(rows) > MAX_EDGES:
                raise ValueError(f"more than {MAX_EDGES} kinds of field")
            fields: dict[str, set[str]] = {}
            for r in rows:
                fields.setdefault(r["element"], set()).add(r["field"])
            # The fields counted here are those of all tasks, so the result doesn't depend on how the rows were dealt out.
            more = {e for e, held in fields.items() if len(held) > MAP_KEYS}
            if not more:
                break
            self.keyed |= more  # what lies below them has other elements now
        self.modes = {(r["element"], r["field"]): LIST for r in rows if r["kind"] == "list"} | {(r["element"], KEYED): MAP for r in rows if r["field"] == KEYED} | declared
        self.fields = fields
        holds = {(r["element"], r["field"]) for r in rows if r["kind"] == "object"} | {(e, f) for e, f in self.modes if f in fields.get(e, ())}
        self.below: dict[str, set[str]] = {}
        degree: dict[str, int] = {}
        for e, f in holds:
            self.below.setdefault(e, set()).add(_below(e, f))
            degree[_below(e, f)] = degree.get(_below(e, f), 0) + 1
        repeated = {_below(*edge) for edge in holds if edge in self.modes}
        shared = {e for e, n in degree.items() if n > 1}
        recursive = {e for e in degree if e in self.reach(e)}
        self.tables = {ROOT} | repeated | shared | recursive

    def reach(self, element: str) -> set[str]:
        """The elements that lie below an element, at whatever depth."""
        found: set[str] = set()
        todo = list(self.below.get(element, ()))
        while todo:
            if (e := todo.pop()) not in found:
                found.add(e)
                todo.extend(self.below.get(e, ()))
        return found


def _shred(key: str, payload: str, graph: Graph, wanted: frozenset[str]):
    modes, names, keyed, tables = graph.modes, graph.names, graph.keyed, graph.tables
    toward = {e for e in {*graph.below, *wanted} if e in wanted or wanted & graph.reach(e)}

    def inlined(element: str, value: object, prefix: str, out: dict, below: list) -> None:
        """Singletons below a value into ``out``; elements of other tables into ``below``: table, field, position, value."""
        if not isinstance(value, (dict, list)):
            if value is not None:
                out[prefix[:-1] or "value"] = value
            return
        for field, x in _fields(element, value, keyed):
            name, lower = prefix + field, _below(element, field)
            if mode := modes.get((element, field)):
                if lower in toward:
                    below.extend((lower, name, step, v) for step, v in elements(x, mode, names.get((element, field), ())))
                if not isinstance(x, (dict, list, type(None))):  # text or a number where elsewhere is a repeated part
                    out[name] = x
            elif isinstance(x, dict) and lower in tables:
                if lower in toward:
                    below.append((lower, name, "", x))
            else:
                inlined(lower, x, name + ".", out, below)

    def rows(doc: object, text: str | None) -> Iterator[tuple]:
        try:
            todo: list = [(ROOT, [], decode(text), None)]
        except Unreadable:
            yield doc, "unreadable", [], None, None
            return
        while todo:
            table, steps, value, parent = todo.pop()
            out: dict = {}
            below: list = []
            inlined(table, value, "", out, below)
            if table in wanted:
                yield doc, table, steps, json.dumps(out, ensure_ascii=False), parent
            todo.extend((lower, [*steps, name, step], v, table) for lower, name, step, v in below)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):  # bounds the rows held, since a payload has many elements
                out = [r for doc, text in zip(b[key][lo : lo + 500], b[payload][lo : lo + 500]) for r in rows(doc, text)]
                yield pd.DataFrame(out, columns=[key, "node", "steps", "inlined", "parent"])

    return run


def shred(docs: DataFrame, key: str, payload: str, declared: dict[Edge, str], names: dict[Edge, tuple[str, ...]], tables: list[str] | None = None) -> DataFrame:
    """One row per element of each table: key, node (the table), steps, inlined, parent (the table above).

    ``declared`` names fields of elements known to be repeated (``list`` or ``map``); others are found by
    analysis. ``names`` gives the fields that key the elements of a map that is listed. ``tables``
    are the ones to emit, or null for all. ``steps`` holds, for each table from the root down, the field that holds the element
    and its position or key there (blank for one that isn't repeated); ``inlined`` the columns as a JSON object, by dotted name. A payload that is
    null, blank or not complete JSON gives one row with the node ``unreadable``. Repeated rows are
    shredded each for itself; an empty table gives none.
    """
    graph = Graph(docs, payload, declared, names)
    kind = docs.schema[key].dataType.simpleString()
    run = _shred(key, payload, graph, frozenset(graph.tables if tables is None else tables))
    return dealt_out(docs.select(key, payload)).mapInPandas(run, f"{key} {kind}, node string, steps array<string>, inlined string, parent string")


def element_key(key: str, steps: Column) -> Column:
    """128-bit key of an element, the same in every run: a hash of the payload's key and the steps that lead to the element."""
    return F.md5(F.to_json(F.struct(F.col(key).alias("key"), steps.alias("steps"))))


def parent_steps(steps: Column) -> Column:
    """The steps of the element above; null for the root."""
    return F.when(F.size(steps) > 0, F.slice(steps, 1, F.greatest(F.size(steps) - 2, F.lit(0))))


def array_children(rows: DataFrame, key: str, nested: str) -> DataFrame:
    """The elements of an array column: key, pos (from 0) and the element's fields. Null elements keep their position but are no children."""
    return rows.select(key, F.posexplode(nested).alias("pos", "__n")).filter("__n is not null").select(key, "pos", "__n.*")
