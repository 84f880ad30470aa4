"""Errors of the SQL dialect; each points at the piece of the statement that it is about."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    begin: int
    end: int
    line: int
    column: int


class SQLError(Exception):
    def __init__(self, message: str, span: Span | None = None, hint: str | None = None):
        self.message, self.span, self.hint = message, span, hint
        where = f" (line {span.line}, column {span.column})" if span else ""
        super().__init__(message + where + (f"; {hint}" if hint else ""))


class SQLLexError(SQLError):
    """A character or literal that is none."""


class SQLParseError(SQLError):
    """A statement that does not follow the grammar."""


class SQLSemanticError(SQLError):
    """Names or types that do not fit."""


class SQLUnsupportedError(SQLError):
    """SQL that the dialect leaves out."""


class ExecutionError(SQLError):
    """A statement that failed while running: a duplicate key, a lock, a file."""
