"""Names and types of a parsed statement against table schemas. Pure: schemas come in as data."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

from . import ast
from .errors import SQLSemanticError, SQLUnsupportedError

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
MAX_NAME = 64
#: Bytes of fixed-size types in a record, and the largest record by storage.
WIDTH = {"INT": 4, "DOUBLE": 8, "BOOL": 1, "DATE": 4, "POINT": 16}
MAX_RECORD = {"HEAP": 4087, "SEQUENTIAL": 2041}
LITERAL_OF = {"INT": ("int",), "DOUBLE": ("int", "double"), "VARCHAR": ("string",), "BOOL": ("bool",), "DATE": ("date",), "POINT": ("point",), "VECTOR": ("vector",)}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    size: int | None = None
    wide: bool = False  # an INT that a registered table stores as 64 bits


@dataclass(frozen=True)
class Index:
    name: str
    column: str
    kind: str
    metric: str | None = None
    language: str | None = None


@dataclass(frozen=True)
class Schema:
    table: str
    columns: tuple[Column, ...]
    primary_key: str | None
    storage: str = "HEAP"
    indexes: tuple[Index, ...] = field(default=())

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def index(self, column: str, *kinds: str) -> Index | None:
        return next((i for i in self.indexes if i.column == column and i.kind in kinds), None)


@dataclass(frozen=True)
class BoundColumn:
    side: int
    column: Column
    output: str  # its name in the rows of the join


@dataclass(frozen=True)
class BoundSelect:
    source: ast.Select
    schemas: tuple[Schema, ...]
    items: tuple  # of (output name, BoundColumn | Aggregate with BoundColumn | ScoreCall)
    join: tuple[BoundColumn, BoundColumn] | None
    where: Any
    where_column: BoundColumn | None
    group: BoundColumn | None
    order: Any
    descending: bool
    limit: int | None


def check_name(name: str, what: str, span) -> None:
    if not NAME.match(name) or len(name) > MAX_NAME:
        raise SQLSemanticError(f"{what} name {name!r} must be letters, digits and _, {MAX_NAME} at most", span)


def bind_create_table(s: ast.CreateTable) -> Schema:
    check_name(s.table, "table", s.span)
    seen, width = set(), 0
    for c in s.columns:
        check_name(c.name, "column", c.span)
        if c.name in seen:
            raise SQLSemanticError(f"column {c.name} is declared twice", c.span)
        seen.add(c.name)
        if c.kind in ("VARCHAR", "VECTOR") and (c.size or 0) <= 0:
            raise SQLSemanticError(f"{c.kind} needs a positive size", c.span)
        if c.primary_key and c.kind in ("POINT", "VECTOR"):
            raise SQLSemanticError(f"a {c.kind} cannot be the primary key", c.span)
        width += WIDTH.get(c.kind) or (c.size + 2 if c.kind == "VARCHAR" else 4 * c.size)
        if width > MAX_RECORD[s.storage]:
            raise SQLSemanticError(f"records of {s.storage} tables hold {MAX_RECORD[s.storage]} bytes; this column goes beyond", c.span)
    keys = [c for c in s.columns if c.primary_key]
    if len(keys) != 1:
        raise SQLSemanticError(f"a table needs exactly one PRIMARY KEY, not {len(keys)}", keys[1].span if keys else s.span)
    return Schema(s.table, tuple(Column(c.name, c.kind, c.size) for c in s.columns), keys[0].name, s.storage)


def bind_create_index(s: ast.CreateIndex, schema: Schema) -> Index:
    check_name(s.name, "index", s.span)
    column = schema.column(s.column)
    if column is None:
        raise SQLSemanticError(f"table {schema.table} has no column {s.column}", s.span)
    if schema.storage != "HEAP":
        raise SQLSemanticError("indexes need a HEAP table", s.span)
    if any(i.name == s.name for i in schema.indexes):
        raise SQLSemanticError(f"index {s.name} exists already", s.span)
    needs = {"RTREE": "POINT", "FULLTEXT": "VARCHAR", "HNSW": "VECTOR", "IVF": "VECTOR"}.get(s.kind)
    if (needs and column.kind != needs) or (not needs and column.kind in ("POINT", "VECTOR")):
        raise SQLSemanticError(f"a {s.kind} index does not fit the {column.kind} column {column.name}", s.span)
    if s.kind == "FULLTEXT" and schema.index(s.column, "FULLTEXT"):
        raise SQLSemanticError(f"column {s.column} has a FULLTEXT index already", s.span)
    return Index(s.name, s.column, s.kind, s.metric, s.language)


def bind_value(literal: ast.Literal, column: Column, stored: bool = False) -> Any:
    """The literal as a value of the column's type. stored: also obey the column's size."""
    if literal.kind not in LITERAL_OF[column.kind]:
        raise SQLSemanticError(f"column {column.name} is {column.kind}, not {literal.kind}", literal.span)
    v = literal.value
    if column.kind == "INT" and not column.wide and not -(1 << 31) <= v < 1 << 31:
        raise SQLSemanticError(f"{v} is out of the range of INT", literal.span)
    if column.kind == "DOUBLE":
        try:
            v = float(v)
        except OverflowError:
            v = math.inf
        if not math.isfinite(v):
            raise SQLSemanticError("number is out of the range of DOUBLE", literal.span)
    if column.kind == "VARCHAR":
        if "\0" in v:
            raise SQLSemanticError("a string must not hold a NUL", literal.span)
        if stored and column.size and len(v.encode()) > column.size:
            raise SQLSemanticError(f"string has {len(v.encode())} bytes; {column.name} holds {column.size}", literal.span)
    if column.kind == "VECTOR":
        if column.size and len(v) != column.size:
            raise SQLSemanticError(f"vector has {len(v)} components; {column.name} has {column.size}", literal.span)
        if any(abs(x) > 3.4028234663852886e38 for x in v):
            raise SQLSemanticError("component is out of the range of 32-bit floats", literal.span)
    return v


def bind_insert(s: ast.Insert, schema: Schema) -> tuple:
    if len(s.values) != len(schema.columns):
        raise SQLSemanticError(f"table {schema.table} has {len(schema.columns)} columns, not {len(s.values)}", s.span)
    return tuple(bind_value(v, c, True) for v, c in zip(s.values, schema.columns, strict=True))


class _Scope:
    def __init__(self, schemas: tuple[Schema, ...]):
        self.schemas = schemas
        names = [{c.name for c in s.columns} for s in schemas]
        self.shared = names[0] & names[1] if len(names) == 2 else set()

    def output(self, side: int, column: Column) -> str:
        return f"{self.schemas[side].table}.{column.name}" if column.name in self.shared else column.name

    def find(self, ref: ast.ColumnRef) -> BoundColumn:
        found = [(i, s.column(ref.name)) for i, s in enumerate(self.schemas) if ref.table in (None, s.table) and s.column(ref.name)]
        if not found:
            if ref.table and ref.table not in [s.table for s in self.schemas]:
                raise SQLSemanticError(f"table {ref.table} is not in FROM", ref.span)
            raise SQLSemanticError(f"no column {ref.name}", ref.span)
        if len(found) > 1:
            tables = " and ".join(self.schemas[i].table for i, _ in found)
            raise SQLSemanticError(f"column {ref.name} is ambiguous: it is in {tables}", ref.span)
        side, column = found[0]
        return BoundColumn(side, column, self.output(side, column))

    def all(self) -> list[BoundColumn]:
        return [BoundColumn(i, c, self.output(i, c)) for i, s in enumerate(self.schemas) for c in s.columns]


def _bind_where(where, scope: _Scope, joined: bool, grouped: bool) -> tuple[Any, BoundColumn | None]:
    if where is None:
        return None, None
    if isinstance(where, ast.Similar):
        if joined or grouped:
            raise SQLUnsupportedError("SIMILAR_TO goes with neither JOIN nor GROUP BY", where.span)
        vectors = [c for c in scope.all() if c.column.kind == "VECTOR"]
        if where.column is None and len(vectors) != 1:
            raise SQLSemanticError(f"name the column: the table has {len(vectors)} VECTOR columns", where.span)
        column = scope.find(where.column) if where.column else vectors[0]
        if column.column.kind != "VECTOR":
            raise SQLSemanticError(f"column {column.column.name} is {column.column.kind}, not VECTOR", where.span)
        if where.k < 0:
            raise SQLSemanticError("k must not be negative", where.span)
        if where.target.kind == "vector":
            bind_value(where.target, column.column)
        index = scope.schemas[0].index(column.column.name, "HNSW")
        if where.index == "HNSW" and index and index.metric != where.metric:
            raise SQLSemanticError(f"the HNSW index was built for {index.metric}", where.span, f"use WITH METRIC={index.metric}")
        return where, column
    column = scope.find(where.column)
    need = {ast.Within: "POINT", ast.Inside: "POINT", ast.Match: "VARCHAR"}.get(type(where))
    if need and column.column.kind != need:
        raise SQLSemanticError(f"column {column.column.name} is {column.column.kind}, not {need}", where.column.span)
    if isinstance(where, ast.Match):
        if joined:
            raise SQLUnsupportedError("MATCH does not go with JOIN", where.span)
        if not scope.schemas[0].index(column.column.name, "FULLTEXT"):
            raise SQLSemanticError(f"column {column.column.name} has no FULLTEXT index", where.span, "CREATE INDEX ... USING FULLTEXT first")
    elif isinstance(where, ast.Within):
        if where.radius.kind not in ("int", "double") or where.radius.value < 0:
            raise SQLSemanticError("a radius is a number, 0 or more", where.radius.span)
    elif isinstance(where, ast.Inside):
        if len({p.value for p in where.ring}) < 3:
            raise SQLSemanticError("a polygon needs three distinct vertices", where.span)
    else:
        bind_value(where.low, column.column)
        if where.high:
            bind_value(where.high, column.column)
    return where, column


def bind_select(s: ast.Select, schemas: tuple[Schema, ...]) -> BoundSelect:
    scope = _Scope(schemas)
    join = None
    if s.join:
        if len(schemas) == 2 and schemas[0].table == schemas[1].table:
            a, b = (BoundColumn(i, c, f"{schemas[0].table}.{c.name}") if (c := schemas[0].column(r.name)) else None for i, r in enumerate((s.join.left, s.join.right)))
            if a is None or b is None:
                raise SQLSemanticError("no such column", s.join.span)
        else:
            a, b = scope.find(s.join.left), scope.find(s.join.right)
            if a.side == b.side:
                raise SQLSemanticError("ON must compare a column of each table", s.join.span)
            if a.side == 1:
                a, b = b, a
        if a.column.kind != b.column.kind:
            raise SQLSemanticError(f"cannot join {a.column.kind} with {b.column.kind}", s.join.span)
        join = (a, b)
    where, where_column = _bind_where(s.where, scope, s.join is not None, s.group is not None)
    group = scope.find(s.group) if s.group else None
    aggregates = [i for i in s.items if isinstance(i, ast.Aggregate)]
    scores = [i for i in s.items if isinstance(i, ast.ScoreCall)]
    if group is None and aggregates:
        raise SQLSemanticError(f"{aggregates[0].function} needs GROUP BY", aggregates[0].span)
    if group is not None and not aggregates:
        raise SQLSemanticError("GROUP BY needs an aggregate", s.group.span)
    wanted = {"score": ast.Match, "similarity_score": ast.Similar}
    for x in [*scores, *([s.order.key] if s.order and isinstance(s.order.key, ast.ScoreCall) else [])]:
        if not isinstance(where, wanted[x.kind]):
            raise SQLSemanticError(f"{x.kind.upper()}() needs {'MATCH' if x.kind == 'score' else 'SIMILAR_TO'}", x.span)
        if group is not None:
            raise SQLUnsupportedError("a score does not go with GROUP BY", x.span)
    if len(scores) > 1:
        raise SQLSemanticError("a score may be selected once", scores[1].span)

    items, names = [], {}

    def add(name: str, what) -> None:
        names[name] = names.get(name, 0) + 1
        items.append((name if names[name] == 1 else f"{name}_{names[name]}", what))

    for i in s.items:
        if isinstance(i, ast.Star):
            if group is not None:
                raise SQLSemanticError("* does not go with GROUP BY", i.span)
            if any(not isinstance(x, ast.ScoreCall) for x in s.items if x is not i):
                raise SQLSemanticError("* goes with a score only", i.span)
            for c in scope.all():
                add(c.output if len(schemas) < 2 or schemas[0].table != schemas[1].table else c.column.name, c)
        elif isinstance(i, ast.ScoreCall):
            add(i.alias, i)
        elif isinstance(i, ast.Aggregate):
            c = scope.find(i.column) if i.column else None
            if i.function in ("SUM", "AVG") and c.column.kind not in ("INT", "DOUBLE"):
                raise SQLSemanticError(f"{i.function} needs INT or DOUBLE", i.span)
            add(f"{i.function}_{c.column.name if c else 'all'}", (i.function, c))
        else:
            c = scope.find(i)
            if group is not None and (c.side, c.column.name) != (group.side, group.column.name):
                raise SQLSemanticError(f"{i.name} is neither grouped nor aggregated", i.span)
            add(c.output, c)

    order, descending = None, False
    if s.order:
        descending, key = s.order.descending, s.order.key
        alias = next((x for x in scores if isinstance(key, ast.ColumnRef) and key.table is None and key.name == x.alias), None)
        if alias or isinstance(key, ast.ScoreCall):
            order = "score"
        elif isinstance(key, ast.Within):
            c = scope.find(key.column)
            if c.column.kind != "POINT":
                raise SQLSemanticError(f"column {c.column.name} is {c.column.kind}, not POINT", key.column.span)
            if group is not None:
                raise SQLUnsupportedError("a distance does not order groups", key.column.span)
            order = (c, key.point.value, key.metric)
        else:
            order = scope.find(key)
            if group is not None and (order.side, order.column.name) != (group.side, group.column.name):
                raise SQLSemanticError("groups are ordered by their column only", key.span)
            if scores:
                raise SQLUnsupportedError("a selected score does not go with another ORDER BY", key.span)
    return BoundSelect(s, schemas, tuple(items), join, where, where_column, group, order, descending, s.limit)


def bind_delete(s: ast.Delete, schema: Schema) -> BoundColumn:
    if isinstance(s.where, ast.Match | ast.Similar):
        raise SQLUnsupportedError("DELETE takes neither MATCH nor SIMILAR_TO", s.where.span)
    return _bind_where(s.where, _Scope((schema,)), False, False)[1]
