"""Syntax of statements as parsed, before any table is known."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .errors import Span


@dataclass(frozen=True)
class Literal:
    kind: str  # int, double, string, bool, date, point, vector
    value: Any
    span: Span


@dataclass(frozen=True)
class ColumnRef:
    table: str | None
    name: str
    span: Span


@dataclass(frozen=True)
class Star:
    span: Span


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: ColumnRef | None
    span: Span


@dataclass(frozen=True)
class ScoreCall:
    kind: str  # score, similarity_score
    alias: str
    span: Span


@dataclass(frozen=True)
class Compare:
    column: ColumnRef
    op: str  # = < <= > >= between
    low: Literal
    high: Literal | None = None


@dataclass(frozen=True)
class Within:
    column: ColumnRef
    point: Literal
    metric: str
    op: str
    radius: Literal


@dataclass(frozen=True)
class Inside:
    column: ColumnRef
    ring: tuple[Literal, ...]
    span: Span


@dataclass(frozen=True)
class Match:
    column: ColumnRef
    query: str
    ranking: str
    span: Span


@dataclass(frozen=True)
class Similar:
    column: ColumnRef | None
    target: Literal
    k: int
    index: str
    metric: str
    span: Span


@dataclass(frozen=True)
class OrderBy:
    key: ColumnRef | ScoreCall | Within
    descending: bool


@dataclass(frozen=True)
class Join:
    table: str
    left: ColumnRef
    right: ColumnRef
    span: Span


@dataclass(frozen=True)
class Select:
    items: tuple
    table: str
    span: Span
    join: Join | None = None
    where: Any = None
    group: ColumnRef | None = None
    order: OrderBy | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Explain:
    select: Select
    analyze: bool


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str
    size: int | None
    primary_key: bool
    span: Span


@dataclass(frozen=True)
class Fragment:
    name: str
    below: int | None
    node: str


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]
    storage: str
    span: Span
    node: str | None = None
    partition_by: str | None = None
    fragments: tuple[Fragment, ...] = field(default=())


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    kind: str
    span: Span
    metric: str | None = None
    language: str | None = None


@dataclass(frozen=True)
class DropTable:
    table: str
    span: Span


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Literal, ...]
    span: Span


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any
    span: Span


@dataclass(frozen=True)
class Begin:
    span: Span


@dataclass(frozen=True)
class End:
    span: Span
