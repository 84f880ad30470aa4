"""The engine's front: SQL statements over managed and registered tables, run as Spark DataFrames.

    db = Session(spark, root)
    db.execute("SELECT nombre, SCORE() FROM arts WHERE MATCH(texto, 'base de datos') LIMIT 5").rows
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import media
from .functions.text import TextOptions
from .operators import fragments, text_search, vector_search
from .plans import ast, binder
from .plans.errors import ExecutionError, SQLSemanticError, SQLUnsupportedError
from .plans.parser import parse_sql_script
from .plans.planner import RID, Planner, literal, predicate
from .plans.steps import Step
from .sources import csv_load, media_load
from .sources.files import shared_folder
from .sources.tables import SPARK_TYPES, Tables


@dataclass
class QueryResult:
    columns: list[str] = field(default_factory=list)
    df: DataFrame | None = None
    affected_rows: int = 0
    plan: Step | None = None
    spatial_context: dict | None = None
    is_explain: bool = False

    @property
    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []

    @property
    def column_types(self) -> list[str]:
        return [t for _, t in self.df.dtypes] if self.df is not None else []


@dataclass
class CsvReport:
    loaded: int
    rejected: int
    errors: list[tuple[str, str]]


class Locks:
    """Shared and exclusive table locks, reentrant, upgradable by their only holder; waiting too long is an error."""

    def __init__(self, timeout: float = 5.0):
        self.timeout, self.changed = timeout, threading.Condition()
        self.holders: dict[str, dict[Any, str]] = {}

    def acquire(self, owner: Any, table: str, mode: str) -> None:
        def free() -> bool:
            others = {o: m for o, m in self.holders.get(table, {}).items() if o != owner}
            return not others if mode == "exclusive" else "exclusive" not in others.values()

        with self.changed:
            if not self.changed.wait_for(free, self.timeout):
                raise ExecutionError(f"table {table} is locked")
            held = self.holders.setdefault(table, {})
            held[owner] = "exclusive" if "exclusive" in (mode, held.get(owner)) else "shared"

    def release(self, owner: Any) -> None:
        with self.changed:
            for held in self.holders.values():
                held.pop(owner, None)
            self.changed.notify_all()


_KINDS = {T.ByteType: "INT", T.ShortType: "INT", T.IntegerType: "INT", T.LongType: "INT", T.FloatType: "DOUBLE", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR", T.BooleanType: "BOOL", T.DateType: "DATE", T.ArrayType: "VECTOR"}


class Session:
    def __init__(self, spark: SparkSession, root: str, locks: Locks | None = None, vector_nprobe: int = 1, ivf_nlist: int = 16):
        self.spark, self.tables, self.locks = spark, Tables(spark, root), locks or Locks()
        self.ivf_nlist = ivf_nlist
        self.vocabularies: dict[tuple[str, str], media.Vocabulary] = {}
        self.built: dict = {}
        self.stored_indexes: dict[tuple[str, str], Callable] = {}
        self.in_transaction = False
        self.planner = Planner(self.tables.read, self._text_index, self._ivf, self._features, vector_nprobe)

    # --- tables

    def register(self, name: str, df: DataFrame, primary_key: str | None = None, rid: str | None = None, indexes: tuple = ()) -> None:
        """Query a DataFrame by SQL, read-only. rid: a unique column that breaks ties; the primary key by default."""
        columns = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType) and f.dataType.names == ["latitude", "longitude"]:
                kind = "POINT"
            else:
                kind = _KINDS.get(type(f.dataType))
            if kind:
                columns.append(binder.Column(f.name, kind, wide=isinstance(f.dataType, T.LongType)))
        key = rid or primary_key
        known = df.select(*(F.col(f"`{c.name}`") for c in columns), (F.col(key) if key else F.monotonically_increasing_id()).alias(RID))
        self.tables.outside[name] = (binder.Schema(name, tuple(columns), primary_key, "HEAP", tuple(indexes)), known)

    def table_info(self, name: str) -> dict:
        s = self._schema(name)
        count = self.tables.state[name]["rows"] if name in self.tables.state else None
        return {"table": name, "columns": [(c.name, c.kind, c.size, c.name == s.primary_key) for c in s.columns], "storage": s.storage, "indexes": [i.__dict__ for i in s.indexes], "record_count": count}

    def list_tables(self) -> list[dict]:
        return [self.table_info(n) for n in self.tables.names()]

    def _schema(self, name: str, span=None) -> binder.Schema:
        s = self.tables.schema(name)
        if s is None:
            raise SQLSemanticError(f"no table {name}", span)
        return s

    def _managed(self, name: str, span=None) -> binder.Schema:
        s = self._schema(name, span)
        if name in self.tables.outside:
            raise SQLUnsupportedError(f"table {name} is registered read-only", span)
        return s

    # --- side tables of indexes, rebuilt when their table's snapshot changes

    def _text_index(self, table: str, column: str):
        index = self._schema(table).index(column, "FULLTEXT")
        key = ("text", table, column, index.language, self.tables.version(table))
        if key not in self.built:
            options = None if index.language == "simple" else TextOptions(index.language)
            if stored := self.stored_indexes.get((table, column)):
                self.built[key] = stored()
            else:
                root = shared_folder(self.spark) if table in self.tables.outside else self.tables.store.root
                self.built[key] = text_search.build_index(self.tables.read(table), RID, column, options, folder=f"{root}/_text_index/{uuid.uuid4().hex}")
        return self.built[key]

    def _ivf(self, table: str, column: str):
        if not self._schema(table).index(column, "IVF"):
            return None
        key = ("ivf", table, column, self.tables.version(table))
        if key not in self.built:
            self.built[key] = vector_search.build_ivf(self.tables.read(table), column, RID, self.ivf_nlist)
        return self.built[key]

    def register_vocabulary(self, table: str, vocabulary: media.Vocabulary, column: str | None = None) -> None:
        self.vocabularies[table, column or ""] = vocabulary

    def _vocabulary(self, table: str, column: str) -> media.Vocabulary:
        v = self.vocabularies.get((table, column)) or self.vocabularies.get((table, ""))
        if v is None:
            raise ExecutionError(f"table {table} has no vocabulary")
        return v

    def _features(self, table: str, column: str, path: str) -> list[float]:
        found = self.spark.read.format("binaryFile").load(path).first()
        v = media.extract_features(path, bytes(found["content"]), self._vocabulary(table, column)).tolist()
        size = self._schema(table).column(column).size
        if size and len(v) != size:
            raise ExecutionError(f"the vocabulary has {len(v)} words; {column} has {size} components")
        return v

    # --- statements

    def execute(self, sql: str) -> QueryResult:
        """Run a script, parsed to the end first. The result is the last statement's, with affected rows summed."""
        statements = parse_sql_script(sql)
        if not statements:
            raise SQLSemanticError("no statement")
        affected, out = 0, QueryResult()
        for s in statements:
            out = self._run(s)
            affected += out.affected_rows
        out.affected_rows = affected
        return out

    @contextmanager
    def _locked(self, *wanted: tuple[str, str]):
        try:
            for table, mode in sorted(wanted):
                self.locks.acquire(self, table, mode)
            yield
        except Exception:
            if self.in_transaction:
                self.rollback()
            raise
        finally:
            if not self.in_transaction:
                self.locks.release(self)

    def _run(self, s) -> QueryResult:
        if isinstance(s, ast.Begin | ast.End):
            return self._transaction(s)
        if isinstance(s, ast.CreateTable | ast.CreateIndex | ast.DropTable) and self.in_transaction:
            self.rollback()
            raise SQLUnsupportedError("DDL is not allowed in a transaction", s.span)
        return {ast.Select: self._select, ast.Explain: self._explain, ast.CreateTable: self._create_table, ast.CreateIndex: self._create_index, ast.DropTable: self._drop, ast.Insert: self._insert, ast.Delete: self._delete}[type(s)](s)

    def _transaction(self, s) -> QueryResult:
        if isinstance(s, ast.Begin):
            if self.in_transaction:
                raise SQLSemanticError("a transaction is open already", s.span)
            self.tables.begin()
            self.in_transaction = True
        else:
            if not self.in_transaction:
                raise SQLSemanticError("no transaction is open", s.span)
            self.tables.commit()
            self.in_transaction = False
            self.locks.release(self)
        return QueryResult()

    def rollback(self) -> None:
        if self.in_transaction:
            self.tables.rollback()
            self.in_transaction = False
            self.locks.release(self)

    def _bound(self, s: ast.Select) -> binder.BoundSelect:
        names = [s.table, s.join.table] if s.join else [s.table]
        return binder.bind_select(s, tuple(self._schema(n, s.span) for n in names))

    def _select(self, s: ast.Select) -> QueryResult:
        with self._locked(*{(n, "shared") for n in ([s.table, s.join.table] if s.join else [s.table])}):
            b = self._bound(s)
            df = self.planner.build(b)
            return QueryResult([n for n, _ in b.items], df, 0, self.planner.steps(b), self._context(b))

    @staticmethod
    def _context(b: binder.BoundSelect) -> dict | None:
        w = b.where
        table = None if b.join or b.group else b.schemas[0].table
        if isinstance(w, ast.Within):
            return {"kind": "radius", "table": table, "center": w.point.value, "radius": float(w.radius.value), "metric": w.metric, "unit": "metres" if w.metric == "haversine" else "degrees", "operator": w.op}
        if isinstance(w, ast.Inside):
            return {"kind": "polygon", "table": table, "vertices": [p.value for p in w.ring]}
        return None

    def _explain(self, s: ast.Explain) -> QueryResult:
        b = self._bound(s.select)
        plan = self.planner.analyse(b) if s.analyze else self.planner.steps(b)
        return QueryResult([n for n, _ in b.items], None, 0, plan, None, True)

    def _create_table(self, s: ast.CreateTable) -> QueryResult:
        schema = binder.bind_create_table(s)
        if self.tables.schema(s.table):
            raise SQLSemanticError(f"table {s.table} exists already", s.span)
        parts = None
        if s.fragments:
            key = schema.column(s.partition_by)
            if s.partition_by != schema.primary_key or key.kind != "INT":
                raise SQLSemanticError("tables are partitioned by an INT primary key", s.span)
            try:
                fragments.from_bounds([(f.name, f.below, f.node) for f in s.fragments])
            except ValueError as e:
                raise SQLSemanticError(str(e), s.span) from None
            parts = [[f.name, f.below, f.node] for f in s.fragments]
        with self._locked((s.table, "exclusive")):
            self.tables.create(schema, parts)
        return QueryResult()

    def _create_index(self, s: ast.CreateIndex) -> QueryResult:
        schema = self._managed(s.table, s.span)
        index = binder.bind_create_index(s, schema)
        with self._locked((s.table, "exclusive")):
            if s.kind == "IVF" and not self.tables.state[s.table]["rows"]:
                raise ExecutionError("an IVF index needs rows", s.span)
            self.tables.add_index(s.table, index)
        return QueryResult()

    def _drop(self, s: ast.DropTable) -> QueryResult:
        self._managed(s.table, s.span)
        with self._locked((s.table, "exclusive")):
            self.tables.drop(s.table)
        return QueryResult()

    def _insert(self, s: ast.Insert) -> QueryResult:
        with self._locked((s.table, "exclusive")):
            schema = self._managed(s.table, s.span)
            values = binder.bind_insert(s, schema)
            key = next(v for v, c in zip(values, schema.columns, strict=True) if c.name == schema.primary_key)
            parts = self.tables.fragments(s.table)
            if parts and not any(f.holds(key) for f in parts):
                raise ExecutionError(f"no fragment of {s.table} holds key {key!r}", s.span)
            if self.tables.read(s.table, ("=", key, None) if parts else None).filter(F.col(schema.primary_key) == F.lit(key)).limit(1).count():
                raise ExecutionError(f"key {key!r} exists already in {s.table}", s.span)
            row = self.spark.range(1, numPartitions=1).select(*(literal(v, c.kind).cast(SPARK_TYPES[c.kind]).alias(c.name) for v, c in zip(values, schema.columns, strict=True)))
            return QueryResult(affected_rows=self.tables.append(s.table, row))

    def _delete(self, s: ast.Delete) -> QueryResult:
        with self._locked((s.table, "exclusive")):
            schema = self._managed(s.table, s.span)
            column = binder.bind_delete(s, schema)
            gone = predicate(s.where, column)
            rows = self.tables.read(s.table)
            n = rows.filter(gone).count()
            if n:
                self.tables.replace(s.table, rows.filter(~gone), self.tables.state[s.table]["rows"] - n)
            return QueryResult(affected_rows=n)

    def update(self, table: str, key, values: tuple) -> int:
        """Replace the row of a key; there is no UPDATE statement."""
        with self._locked((table, "exclusive")):
            schema = self._managed(table)
            hit = F.col(schema.primary_key) == F.lit(key)
            rows = self.tables.read(table)
            n = rows.filter(hit).count()
            if n:
                changed = [F.when(hit, literal(v, c.kind).cast(SPARK_TYPES[c.kind])).otherwise(F.col(c.name)).alias(c.name) for v, c in zip(values, schema.columns, strict=True)]
                self.tables.replace(table, rows.select(*changed, RID), self.tables.state[table]["rows"])
            return n

    # --- bulk loading

    def load_csv(self, table: str, path: str, atomic: bool = False) -> CsvReport:
        if self.in_transaction:
            raise SQLUnsupportedError("CSV loading is not allowed in a transaction")
        with self._locked((table, "exclusive")):
            schema = self._managed(table)
            good, bad = csv_load.read_csv(self.spark, path, schema)
            key = schema.primary_key
            held = self.tables.read(table).select(F.col(key).alias("_held"))
            order = F.row_number().over(Window.partitionBy(key).orderBy("_at"))
            numbered = good.withColumn("_at", F.monotonically_increasing_id()).withColumn("_nth", order)
            marked = numbered.join(held, F.col(key) == F.col("_held"), "left")
            double = F.col("_held").isNotNull() | (F.col("_nth") > 1)
            again = marked.filter(double).select(F.lit(f"{key}: duplicate key").alias("error"), F.col(key).cast("string").alias("raw"))
            rejected = bad.unionByName(again)
            if parts := self.tables.fragments(table):
                stray = fragments.owner_column(parts, F.col(key)).isNull()
                rejected = rejected.unionByName(marked.filter(~double & stray).select(F.lit(f"{key}: no fragment holds it").alias("error"), F.col(key).cast("string").alias("raw")))
                marked = marked.filter(double | ~stray)
            n_bad = rejected.count()
            errors = [tuple(r) for r in rejected.limit(csv_load.REPORTED).collect()] if n_bad else []
            if atomic and n_bad:
                return CsvReport(0, n_bad, errors)
            n = self.tables.append(table, marked.filter(~double).orderBy("_at").select(*(c.name for c in schema.columns)))
            return CsvReport(n, n_bad, errors)

    def load_media(self, table: str, folder: str) -> CsvReport:
        """Files of a folder into a table (id INT, nombre VARCHAR, ruta VARCHAR, rasgos VECTOR)."""
        with self._locked((table, "exclusive")):
            schema = self._managed(table)
            if [c.kind for c in schema.columns] != ["INT", "VARCHAR", "VARCHAR", "VECTOR"]:
                raise ExecutionError("a media table has columns id INT, nombre VARCHAR, ruta VARCHAR, rasgos VECTOR")
            key, names = schema.columns[0].name, [c.name for c in schema.columns]
            staged = f"_staged/{uuid.uuid4().hex}"
            try:
                good, bad = media_load.load_media(self.spark, folder, self._vocabulary(table, schema.columns[3].name), staged=f"{self.tables.store.root}/{staged}")
                n_bad = bad.count()
                errors = [tuple(r) for r in bad.limit(csv_load.REPORTED).collect()] if n_bad else []
                top = self.tables.read(table).agg(F.max(key)).first()[0]
                first = max(self.tables.state[table]["next_rid"], top or 0) + 1
                rows = good.orderBy("id").withColumn("id", (F.col("id") + F.lit(first)).cast("int")).toDF(*names)
                return CsvReport(self.tables.append(table, rows), n_bad, errors)
            finally:
                self.tables.store.delete(staged)
