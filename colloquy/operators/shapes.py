"""Deeply nested records to flat tables: a bottom-up tree automaton gives every object a state that describes its shape
down to the leaves, states are routed to typed subtype tables, and every row keeps the keys that all of them share (root,
path, positions), which lead back to its parent: the parent's positions are the row's own without the last.

The automaton has two forms with the same states. JSON payloads are read by its interpreter (``Automaton``), in one Arrow
pass; typed columns are read by expressions compiled from their schema (``typed_rows``), which never leave the JVM.

States: ``s`` string, ``n`` number, ``b`` boolean; ``{a:s,b?:n}`` an object with its fields that aren't null, in order,
``?`` for those that only some of several objects have; ``list<x>`` a list whose elements have the state ``x`` joined
over all of them, ``lone<x>`` an object or scalar in place of a list, ``encoded<x>`` a string that holds one; ``x|y``
where states that can't be joined meet. Nulls and empty lists have no state. Nothing is cut off, however deep or varied.

Rules, also for odd input:

* Positions count from 0; a null element gives no row but keeps its position.
* In the fields of ``LISTS`` a lone object (or a lone scalar among tags) stands for a list of one and a string that is a
  JSON list stands for that list; null, absent and empty lists give no row; a payload that is null or no valid JSON gives
  none. Arrays in any other field give rows too, under their dotted path.
* Objects inside an element belong to its row: their scalars are attributes with dotted names.
* A scalar where an object is expected is an element without attributes: its value is the empty string.
* Values stay as written: numbers keep their digits, booleans are ``true`` and ``false``, objects are their JSON.
* Rows delivered twice give their rows once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StructType

from colloquy.session import spread

#: Rows of the common supertype: what all kinds share, the object's state, and its scalar attributes as written.
SUPERTYPE = "root_id string, path string, pos array<int>, shape string, attrs map<string,string>"
#: Fields that hold lists, by their dotted path in an export, and the kind of their elements.
LISTS = {"export.sessions": "sessions", "export.sessions.turns": "turns", "export.sessions.turns.entities": "entities", "export.sessions.turns.tags": "tags"}
#: The attribute that ``val`` reports, by kind of child.
VALUE = {"sessions": "specialty", "turns": "role", "entities": "label", "tags": "tag"}
#: The typed table of each kind: its columns with the attribute they come from and their types.
SUBTYPES = {
    "sessions": {"session_id": ("session_id", "string"), "specialty": ("specialty", "string"), "triage_level": ("triage_level", "int")},
    "turns": {"role": ("role", "string"), "text": ("text", "string")},
    "entities": {"label": ("label", "string"), "text": ("text", "string"), "from": ("span.from", "int"), "upto": ("span.upto", "int")},
    "tags": {"tag": ("tag", "string")},
}
DEPTHS = {"sessions": 1, "turns": 2, "entities": 3, "tags": 3}


class _Number(str):
    """A JSON number, kept as written."""


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parse(text: str | None):
    """(whether it is valid JSON, its value)."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False, None


def written(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return str(value) if value.isascii() else str(value).encode("utf-8", "replace").decode()
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False).encode("utf-8", "replace").decode()


class States:
    """Interned states: a state is made of its children's, so equal shapes have one number, and joins are worked out once.

    A state is a tuple of members, which are joined as one if they are of one sort: leaves, lists by their sort, and a
    single object.
    """

    def __init__(self) -> None:
        self.members: list[tuple] = [()]  # state 0: nothing
        self._known: dict[tuple, int] = {(): 0}
        self._names: dict[int, str] = {0: ""}
        self._joins: dict[tuple[int, int], int] = {}

    def _intern(self, members: tuple) -> int:
        found = self._known.get(members)
        if found is None:
            found = self._known[members] = len(self.members)
            self.members.append(members)
        return found

    def leaf(self, sort: str) -> int:
        return self._intern(((sort,),))

    def list(self, sort: str, elements: int) -> int:
        return self._intern(((sort, elements),))

    def object(self, fields: list[tuple[str, int]]) -> int:
        return self._intern((("{", tuple((name, state, False) for name, state in sorted(fields))),))

    def join(self, a: int, b: int) -> int:
        """The state of what is in one or the other."""
        if a == b or not b:
            return a
        if not a:
            return b
        key = (a, b) if a < b else (b, a)
        if key not in self._joins:
            sorts = {m[0]: m for m in self.members[a]}
            for m in self.members[b]:
                own = sorts.get(m[0])
                if own is None or len(m) == 1:
                    sorts[m[0]] = m
                elif m[0] == "{":
                    sorts["{"] = ("{", self._fields(own[1], m[1]))
                else:
                    sorts[m[0]] = (m[0], self.join(own[1], m[1]))
            self._joins[key] = self._intern(tuple(sorts[s] for s in sorted(sorts)))
        return self._joins[key]

    def _fields(self, a: tuple, b: tuple) -> tuple:
        left, right = {n: (s, o) for n, s, o in a}, {n: (s, o) for n, s, o in b}
        return tuple((n, self.join(left.get(n, (0,))[0], right.get(n, (0,))[0]), n not in left or n not in right or left[n][1] or right[n][1]) for n in sorted({*left, *right}))

    def name(self, state: int) -> str:
        if state not in self._names:
            parts = []
            for m in self.members[state]:
                if len(m) == 1:
                    parts.append(m[0])
                elif m[0] == "{":
                    parts.append("{" + ",".join(f"{n}{'?' if o else ''}:{self.name(s)}" for n, s, o in m[1]) + "}")
                else:
                    parts.append(f"{m[0]}<{self.name(m[1])}>")
            self._names[state] = "|".join(parts)
        return self._names[state]


class Automaton:
    """Bottom-up tree automaton over JSON values; each element of a list gives a row with the state it ends in."""

    def __init__(self, lists: dict[str, str] = LISTS) -> None:
        self.lists, self.states = lists, States()

    def elements(self, value) -> tuple[str, list]:
        """(sort, elements) of a value that stands for a list."""
        if value is None:
            return "list", []
        if isinstance(value, list):
            return "list", value
        if isinstance(value, str) and not isinstance(value, _Number):
            ok, inner = parse(value)
            if ok and isinstance(inner, list):
                return "encoded", inner
            if not value.strip():
                return "list", []
        return "lone", [value]

    def _children(self, path: str, sort: str, items: list, pos: tuple[int, ...], out: list) -> int:
        """State of a list; its elements give rows, children first."""
        kind, joined = self.lists.get(path, path), 0
        for i, item in enumerate(items):
            if item is None:
                continue
            attrs: dict[str, str] = {}
            state = self.run(path, item, (*pos, i), attrs, "", out)
            if not isinstance(item, dict) and kind not in ("sessions", "turns", "entities"):
                attrs["tag" if kind == "tags" else "value"] = written(item)
            elif kind in VALUE and isinstance(item, dict) and isinstance(item.get(VALUE[kind]), (dict, list)):
                attrs[VALUE[kind]] = written(item[VALUE[kind]])
            out.append((kind, (*pos, i), self.states.name(state), attrs))
            joined = self.states.join(joined, state)
        return self.states.list(sort, joined) if joined else 0

    def run(self, path: str, value, pos: tuple[int, ...], attrs: dict[str, str], prefix: str, out: list) -> int:
        """State of a value; scalars go into ``attrs`` of the element that it belongs to."""
        states = self.states
        if isinstance(value, str):
            return states.leaf("n" if isinstance(value, _Number) else "s")
        if isinstance(value, bool):
            return states.leaf("b")
        if isinstance(value, list):
            # A list inside a list is one value; its elements still shape it.
            joined = 0
            for item in value:
                joined = states.join(joined, self.run(path, item, pos, {}, "", []) if item is not None else 0)
            return states.list("list", joined) if joined else 0
        if value is None:
            return 0
        fields = []
        for key, item in value.items():
            below = f"{path}.{key}"
            if below in self.lists:
                state = self._children(below, *self.elements(item), pos, out)
            elif isinstance(item, list):
                state = self._children(below, "list", item, pos, out)
            else:
                state = self.run(below, item, pos, attrs, f"{prefix}{key}.", out)
                if item is not None and not isinstance(item, dict):
                    attrs[written(prefix + key)] = written(item)
            if state:
                fields.append((key, state))
        return states.object(fields)

    def rows(self, payload: str | None) -> list:
        """(path, positions, shape, attributes) of every list element below ``export``."""
        out: list = []
        ok, value = parse(payload)
        if ok and isinstance(value, dict):
            self.run("export", value.get("export"), (), {}, "", out)
        return out


def explode_json(df: DataFrame, root: str = "raw_id", payload: str = "payload") -> DataFrame:
    """The supertype rows of a column of nested JSON exports, in one pass and without a shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        schema = pa.schema([("root_id", pa.string()), ("path", pa.string()), ("pos", pa.list_(pa.int32())), ("shape", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, pos, shape, attrs in automaton.rows(text):
                    for col, value in zip(cols, (key, written(kind), pos, written(shape), list(attrs.items()))):
                        col.append(value)
                if len(cols[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                    cols = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return spread(df.select(F.col(root).cast("string"), F.col(payload))).mapInArrow(each, SUPERTYPE)


# ---- the automaton compiled for typed columns


def _leaf(type_: DataType) -> str:
    return "n" if isinstance(type_, NumericType) else "b" if isinstance(type_, BooleanType) else "s"


def _field(name: str):
    return lambda x: x[name]


def _state(value: Column, type_: DataType) -> Column:
    """State of a value; null if it has none."""
    if isinstance(type_, ArrayType):
        inner = _joined(F.filter(value, lambda x: x.isNotNull()), type_.elementType)
        return F.when(inner.isNotNull(), F.concat(F.lit("list<"), inner, F.lit(">")))
    if isinstance(type_, StructType):
        parts = []
        for f in sorted(type_.fields, key=lambda f: f.name):
            state = _state(value[f.name], f.dataType)
            parts.append(F.when(value[f.name].isNotNull() & state.isNotNull(), F.concat(F.lit(f"{f.name}:"), state)))
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    return F.when(value.isNotNull(), F.lit(_leaf(type_)))


def _joined(values: Column, type_: DataType) -> Column:
    """Joined state of the values of a list without nulls; null for none."""
    if isinstance(type_, ArrayType):
        inner = _joined(F.filter(F.flatten(values), lambda x: x.isNotNull()), type_.elementType)
        return F.when(inner.isNotNull(), F.concat(F.lit("list<"), inner, F.lit(">")))
    if isinstance(type_, StructType):
        parts = []
        for f in sorted(type_.fields, key=lambda f: f.name):
            told = F.filter(F.transform(values, _field(f.name)), lambda x: x.isNotNull())
            if isinstance(f.dataType, ArrayType):
                told = F.filter(told, lambda x: F.exists(x, lambda y: y.isNotNull()))
            state = _joined(told, f.dataType)
            mark = F.when(F.size(told) < F.size(values), F.lit("?")).otherwise(F.lit(""))
            parts.append(F.when(F.size(told) > 0, F.concat(F.lit(f.name), mark, F.lit(":"), state)))
        return F.when(F.size(values) > 0, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    return F.when(F.size(values) > 0, F.lit(_leaf(type_)))


def _attributes(value: Column, type_: StructType, prefix: str = "") -> list[Column]:
    out = []
    for f in type_.fields:
        if isinstance(f.dataType, StructType):
            out += _attributes(value[f.name], f.dataType, f"{prefix}{f.name}.")
        elif not isinstance(f.dataType, ArrayType):
            out.append(F.struct(F.lit(prefix + f.name).alias("key"), value[f.name].cast("string").alias("value")))
    return out


def typed_rows(df: DataFrame, root: str, lists: dict[str, str]) -> DataFrame:
    """The supertype rows of array columns, ``lists`` of (column, kind); arrays inside their elements give rows too."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def level(rows: DataFrame, type_: DataType, kind: str) -> list[DataFrame]:
        """Of rows (root_id, above, list)."""
        one = rows.select("root_id", "above", F.posexplode("list").alias("at", "e")).where("e is not null").select("root_id", F.concat("above", F.array("at")).alias("pos"), "e")
        e = F.col("e")
        if isinstance(type_, StructType):
            attrs = F.map_from_entries(F.filter(F.array(*_attributes(e, type_)), lambda x: x["value"].isNotNull())) if _attributes(e, type_) else F.create_map().cast("map<string,string>")
        else:
            attrs = F.create_map(F.lit("tag" if kind == "tags" else "value"), F.to_json(e) if isinstance(type_, ArrayType) else e.cast("string"))
        out = [one.select("root_id", F.lit(kind).alias("path"), "pos", F.coalesce(_state(e, type_), F.lit("")).alias("shape"), attrs.alias("attrs"))]
        for name, column, inner in _lists_in(e, type_):
            out += level(one.select("root_id", F.col("pos").alias("above"), column.alias("list")), inner, f"{kind}.{name}")
        return out

    parts = []
    for column, kind in lists.items():
        rows = df.select(F.col(root).cast("string").alias("root_id"), F.array().cast("array<int>").alias("above"), F.col(column).alias("list"))
        parts += level(rows, types[column].elementType, kind)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _lists_in(value: Column, type_: DataType, prefix: str = "") -> Iterator[tuple[str, Column, DataType]]:
    if isinstance(type_, StructType):
        for f in type_.fields:
            if isinstance(f.dataType, ArrayType):
                yield prefix + f.name, value[f.name], f.dataType.elementType
            elif isinstance(f.dataType, StructType):
                yield from _lists_in(value[f.name], f.dataType, f"{prefix}{f.name}.")


# ---- tables


def all_rows(chat_logs: DataFrame, ner_examples: DataFrame, raw_records: DataFrame) -> DataFrame:
    """The supertype rows of the three nested tables."""
    return typed_rows(chat_logs, "session_id", {"turns": "turns"}).unionByName(typed_rows(ner_examples, "id", {"entities": "entities", "tags": "tags"})).unionByName(explode_json(raw_records))


def _positions(n: int = 3) -> list[Column]:
    return [F.coalesce(F.get("pos", F.lit(i)), F.lit(-1)).alias(f"pos{i + 1}") for i in range(n)]


def values(rows: DataFrame) -> DataFrame:
    """(root_id, path, pos1, pos2, pos3, val) of supertype rows of the four kinds."""
    pick = F.coalesce(*(F.when(F.col("path") == kind, F.col("attrs")[name]) for kind, name in VALUE.items()), F.lit(""))
    return rows.where(F.col("path").isin(*VALUE)).select("root_id", "path", *_positions(), pick.alias("val"))


def subtype(rows: DataFrame, kind: str, shape: bool = True) -> DataFrame:
    """The typed table of one kind, with its parent's key: root and the positions above its own; with its state if asked."""
    typed = [F.expr(f"try_cast(attrs['{attribute}'] as {type_})").alias(name) for name, (attribute, type_) in SUBTYPES[kind].items()]
    return rows.where(F.col("path") == kind).select("root_id", *_positions(DEPTHS[kind]), *(["shape"] if shape else []), *typed).distinct()


def subtypes(rows: DataFrame) -> DataFrame:
    """The typed tables of all kinds in one pass, told apart by ``path``; attributes that a kind lacks are null, positions
    below its own are -1."""
    kinds_of: dict[tuple[str, str, str], list[str]] = {}
    for kind, columns in SUBTYPES.items():
        for name, (attribute, type_) in columns.items():
            kinds_of.setdefault((name, attribute, type_), []).append(kind)
    typed = [F.when(F.col("path").isin(kinds), F.expr(f"try_cast(attrs['{attribute}'] as {type_})")).alias(name) for (name, attribute, type_), kinds in kinds_of.items()]
    return rows.where(F.col("path").isin(*SUBTYPES)).select("root_id", "path", *_positions(), "shape", *typed).distinct()


def variants(rows: DataFrame) -> DataFrame:
    """(path, shape, n_rows, n_roots): how often each state occurs; the keys of its rows are in ``rows``."""
    one = rows.groupBy("path", "shape", "root_id").agg(F.count_distinct("pos").alias("n"))
    return one.groupBy("path", "shape").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_roots"))


def found(chat_logs: DataFrame, ner_examples: DataFrame, raw_records: DataFrame) -> DataFrame:
    """All child elements of the three nested tables as flat rows, each once."""
    return values(all_rows(chat_logs, ner_examples, raw_records)).distinct()
