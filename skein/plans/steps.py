"""The plan that EXPLAIN shows."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Step:
    op: str
    structure: str = ""
    table: str = ""
    column: str = ""
    detail: str = ""
    records: int = 0
    children: list[Step] = field(default_factory=list)

    def lines(self, depth: int = 0) -> list[str]:
        what = " ".join(x for x in (self.op, self.structure, self.table, self.column, self.detail) if x)
        return ["  " * depth + what, *(line for c in self.children for line in c.lines(depth + 1))]

    def find(self, op: str) -> Step | None:
        return self if self.op == op else next((f for c in self.children if (f := c.find(op))), None)
