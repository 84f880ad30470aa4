"""A bound SELECT as a DataFrame and the steps that describe it.

Only what Catalyst cannot know is decided here: boxes around spatial predicates, rankings and their limits, ties by
row id. Filters, pruning, join and aggregation strategies are left to Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, metrics
from ..operators import relational, text_search, vector_search
from . import ast
from .binder import BoundColumn, BoundSelect
from .steps import Step

RID = "_rid"
MAX_ROWS = (1 << 31) - 1


def literal(value: Any, kind: str) -> Column:
    if kind == "POINT":
        return F.struct(F.lit(value[0]).alias("latitude"), F.lit(value[1]).alias("longitude"))
    if kind == "VECTOR":
        return F.array(*(F.lit(v).cast("float") for v in value))
    return F.lit(value)


def _compare(c: Column, op: str, low: Column, high: Column | None) -> Column:
    if op == "between":
        return (c >= low) & (c <= high)
    return {"=": c == low, "<": c < low, "<=": c <= low, ">": c > low, ">=": c >= low}[op]


def predicate(where: Any, column: BoundColumn, name: str | None = None) -> Column:
    c = F.col(f"`{name or column.output}`")
    if isinstance(where, ast.Within):
        return geo.within_radius(c["latitude"], c["longitude"], where.point.value, float(where.radius.value), where.metric, where.op == "<")
    if isinstance(where, ast.Inside):
        return geo.in_polygon(c["latitude"], c["longitude"], [p.value for p in where.ring])
    kind = column.column.kind
    return _compare(c, where.op, literal(where.low.value, kind), literal(where.high.value, kind) if where.high else None)


def describe(where: Any, column: BoundColumn) -> tuple[str, str]:
    """(operator, detail) of a predicate."""
    if isinstance(where, ast.Within):
        return "radius_search", f"{where.metric} {where.op} {where.radius.value}"
    if isinstance(where, ast.Inside):
        return "polygon_search", f"{len(where.ring)} vertices"
    if isinstance(where, ast.Match):
        return "text_search", where.ranking
    if isinstance(where, ast.Similar):
        return "vector_search", f"k={where.k} {where.metric}"
    return ("point_search" if where.op == "=" else "range_search"), where.op


class Planner:
    """tables: name and maybe a condition on the primary key -> DataFrame with RID; text_index(table, column) and ivf(table, column) give side tables."""

    def __init__(self, tables: Callable[..., DataFrame], text_index: Callable, ivf: Callable, vector_of: Callable, nprobe: int = 1):
        self.tables, self.text_index, self.ivf, self.vector_of, self.nprobe = tables, text_index, ivf, vector_of, nprobe

    def access(self, b: BoundSelect) -> Step:
        schema, where, column = b.schemas[0], b.source.where, b.where_column
        scan = Step("scan", schema.storage.lower(), schema.table)
        if where is None or b.join:
            return scan
        op, detail = describe(where, column)
        kinds = {"point_search": ("HASH", "BPLUS"), "range_search": ("BPLUS",), "radius_search": ("RTREE",), "polygon_search": ("RTREE",), "text_search": ("FULLTEXT",), "vector_search": (getattr(where, "index", ""),)}[op]
        index = schema.index(column.column.name, *kinds)
        if index:
            return Step("fetch", "heap", schema.table, children=[Step(op, index.kind.lower(), schema.table, column.column.name, detail)])
        if op in ("point_search", "range_search") and column.column.name == schema.primary_key and schema.storage == "SEQUENTIAL":
            return Step(op, "sequential", schema.table, column.column.name, detail)
        if op == "vector_search":
            return Step(op, "scan", schema.table, column.column.name, detail)
        return Step("filter", "", schema.table, column.column.name, detail, children=[scan])

    def steps(self, b: BoundSelect) -> Step:
        out = self.access(b)
        if b.join:
            right = Step("scan", b.schemas[1].storage.lower(), b.schemas[1].table)
            out = Step("join", "hash", "", f"{b.join[0].output} = {b.join[1].output}", children=[out, right])
            if b.where is not None:
                op, detail = describe(b.where, b.where_column)
                out = Step("filter", "", "", b.where_column.output, detail, children=[out])
        if b.group:
            out = Step("group", "hash", "", b.group.output, children=[out])
        if b.order is not None:
            key = "score" if b.order == "score" else b.order[0].output if isinstance(b.order, tuple) else b.order.output
            knn = isinstance(b.order, tuple) and b.limit is not None and not b.descending and b.where is None and not b.join
            index = b.schemas[0].index(key, "RTREE") if knn else None
            out = Step("knn_search", "rtree", b.schemas[0].table, key) if index else Step("sort", "external", "", key, "desc" if b.descending else "asc", children=[out])
        out = Step("project", "", "", ", ".join(n for n, _ in b.items), children=[out])
        return out if b.limit is None else Step("limit", "", "", "", str(b.limit), children=[out])

    @staticmethod
    def _keys(b: BoundSelect) -> tuple | None:
        """The condition on the primary key, which range fragments are cut by."""
        w = b.where
        if b.join or w is None or b.where_column is None or b.where_column.column.name != b.schemas[0].primary_key or not hasattr(w, "low"):
            return None
        return w.op, w.low.value, w.high.value if w.high else None

    def analyse(self, b: BoundSelect) -> Step:
        """The steps with the rows that left each of them, counted in one run; 0 where Spark did not need the step."""

        def watch(df: DataFrame, name: str) -> DataFrame:
            return df.observe(name, F.count(F.lit(1)).alias("n"))

        run = self.build(b, watch).agg(F.count(F.lit(1)).alias("n"))
        returned = run.collect()[0]["n"]
        seen = run._jdf.queryExecution().observedMetrics()
        counts = {n: r.get().getLong(0) for n in ("scan", "right", "join", "where", "group") if (r := seen.get(n)).isDefined()}
        entering = [counts.get(n, 0) for n, there in (("scan", True), ("join", b.join), ("where", b.where is not None), ("group", b.group)) if there][-1]

        def fill(s: Step, place: str) -> None:
            if s.op in ("limit", "knn_search"):
                s.records = returned
            elif s.op in ("project", "sort"):
                s.records = entering if b.limit is not None else returned
            elif s.op in ("join", "group"):
                s.records = counts.get(s.op, 0)
            elif s.op == "scan":
                s.records = counts.get(place, 0)
            else:
                s.records = counts.get("where", 0)
            for i, c in enumerate(s.children):
                fill(c, "right" if s.op == "join" and i else "scan")

        plan = self.steps(b)
        fill(plan, "scan")
        plan.records = returned
        return plan

    def build(self, b: BoundSelect, watch: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
        """watch gets what leaves each of the steps scan, right, join, where and group."""
        where, limit = b.where, None if b.limit is None else min(b.limit, MAX_ROWS)
        rids = [RID]
        if b.join:
            a, c = (watch(self.tables(s.table), n).withColumnRenamed(RID, f"{RID}{i}") for i, (s, n) in enumerate(zip(b.schemas, ("scan", "right"), strict=True)))
            names = (b.schemas[0].table, b.schemas[1].table)
            if names[0] == names[1]:
                names = (names[0], names[1] + " ")
            a, c = relational.join_columns(a, c, names)
            right = b.join[1].output if b.schemas[0].table != b.schemas[1].table else f"{names[1]}.{b.join[1].column.name}"
            df = watch(a.join(c, F.col(f"`{b.join[0].output}`") == F.col(f"`{right}`")), "join")
            rids = [f"{RID}0", f"{RID}1"]
        else:
            df = watch(self.tables(b.schemas[0].table, self._keys(b)), "scan")

        score = None
        if isinstance(where, ast.Match):
            index = self.text_index(b.schemas[0].table, b.where_column.column.name)
            scores = (text_search.tfidf if where.ranking == "TF_IDF" else text_search.bm25)(index, where.query)
            # a limit on the ranking itself is taken before rows are fetched
            if limit is not None and b.group is None and (b.order is None or (b.order == "score" and b.descending)):
                scores = text_search.rank(scores, limit)
            df = df.join(scores.withColumnRenamed("rid", RID), RID)
            score, best_first = "score", True
        elif isinstance(where, ast.Similar):
            target = where.target.value if where.target.kind == "vector" else self.vector_of(b.schemas[0].table, b.where_column.column.name, where.target.value)
            name = b.where_column.output
            ivf = self.ivf(b.schemas[0].table, name) if where.index == "IVF" else None
            if ivf is not None:
                df = ivf.search(target, where.k, where.metric, self.nprobe, RID)
            else:
                df = vector_search.nearest(df, name, target, where.k, where.metric, RID)
            score, best_first = "score", metrics.higher_is_better(where.metric)
        elif where is not None:
            df = df.filter(predicate(where, b.where_column))
        if where is not None:
            df = watch(df, "where")

        if b.group:
            key = b.group.output
            items = [(n, w[0], F.col(f"`{w[1].output}`") if w[1] else None) for n, w in b.items if isinstance(w, tuple)]
            df = watch(relational.grouped(df, F.col(f"`{key}`"), items), "group")
            if b.order is not None:
                df = df.orderBy(F.col("_key").desc() if b.descending else F.col("_key"))
            if limit is not None:
                df = df.limit(limit)
            return df.select(*(F.col(f"`{n}`") if isinstance(w, tuple) else F.col("_key").alias(n) for n, w in b.items))

        ties = [F.col(r) for r in rids]
        if score and (b.order is None or b.order == "score"):
            down = best_first if b.order is None else b.descending
            natural = down == best_first
            s = F.col("score").desc() if down else F.col("score")
            df = df.orderBy(s, *(t if natural else t.desc() for t in ties))
        elif isinstance(b.order, tuple):
            column, point, metric = b.order
            c = F.col(f"`{column.output}`")
            d = geo.distance(c["latitude"], c["longitude"], point, metric)
            df = df.orderBy(d.desc() if b.descending else d, *ties)
        elif b.order is not None:
            c = F.col(f"`{b.order.output}`")
            df = df.orderBy(c.desc() if b.descending else c, *ties)
        if limit is not None:
            df = df.limit(limit)
        out = []
        for n, w in b.items:
            if isinstance(w, ast.ScoreCall):
                out.append(F.col("score").alias(n))
            else:
                same = len(b.schemas) == 2 and b.schemas[0].table == b.schemas[1].table
                source = f"{b.schemas[w.side].table}{' ' if w.side else ''}.{w.column.name}" if same else w.output
                out.append(F.col(f"`{source}`").alias(n))
        return df.select(out)
