"""Tokens of the dialect. Keywords in any case, identifiers as written."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from .errors import Span, SQLLexError, SQLUnsupportedError


@dataclass(frozen=True)
class Token:
    kind: str  # name, int, float, string, symbol, end
    text: str
    value: Any
    span: Span

    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


_TOKEN = re.compile(
    r"""(?P<blank>\s+|--[^\n]*|/\*.*?\*/)|(?P<open>/\*)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)
      |(?P<float>-?[0-9]+\.[0-9]+)|(?P<int>-?[0-9]+)|(?P<string>'(?:[^']|'')*')|(?P<quote>')
      |(?P<not_equal><>|!=)|(?P<symbol><=|>=|[=<>(),.;*])""",
    re.VERBOSE | re.DOTALL,
)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0

    def span(begin: int, end: int) -> Span:
        return Span(begin, end, sql.count("\n", 0, begin) + 1, begin - sql.rfind("\n", 0, begin))

    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None:
            raise SQLLexError(f"unexpected character {sql[at]!r}", span(at, at + 1))
        kind, text, where = m.lastgroup, m.group(), span(m.start(), m.end())
        if kind == "open":
            raise SQLLexError("comment is not closed", where)
        if kind == "quote":
            raise SQLLexError("string is not closed", where)
        if kind == "not_equal":
            raise SQLUnsupportedError(f"{text} is not supported", where, "use =, <, <=, > or >=")
        if kind in ("int", "float"):
            if re.match(r"[A-Za-z0-9_.]", sql[m.end() : m.end() + 1] or " ") and not (kind == "int" and sql[m.end()] == "."):
                raise SQLLexError(f"malformed number {sql[at : m.end() + 1]!r}", where)
            value = int(text) if kind == "int" else float(text)
            if kind == "float" and (value in (float("inf"), float("-inf")) or (value == 0 and re.search("[1-9]", text))):
                raise SQLLexError("number is out of range", where)
            out.append(Token(kind, text, value, where))
        elif kind == "string":
            out.append(Token(kind, text, text[1:-1].replace("''", "'"), where))
        elif kind != "blank":
            out.append(Token(kind, text, text, where))
        at = m.end()
    out.append(Token("end", "", None, span(len(sql), len(sql))))
    return out
