"""Managed tables: Parquet snapshots under a root folder, named by a manifest that is swapped whole.

A statement writes a new snapshot beside the old one; committing is writing the manifest. Rolling back forgets it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fragments
from ..plans.binder import Column, Index, Schema
from .files import Store

RID = "_rid"
MANIFEST = "catalog.json"
#: Folders of a table: its snapshots, and within one the range fragments, if the table has any.
SNAPSHOT, FRAGMENT = "_snapshot", "_fragment"
SPARK_TYPES = {"INT": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOL": "boolean", "DATE": "date", "POINT": "struct<latitude: double, longitude: double>", "VECTOR": "array<float>"}


def spark_schema(schema: Schema) -> T.StructType:
    return T.StructType([*(T.StructField(c.name, T._parse_datatype_string(SPARK_TYPES[c.kind])) for c in schema.columns), T.StructField(RID, T.LongType())])


#: Bits of monotonically_increasing_id that number the rows of a partition.
PART_BITS = 33


def part_counts(rows: DataFrame, at: SparkColumn) -> dict[int, int]:
    """Rows of each partition, by written ids of monotonically_increasing_id: as many entries as there were tasks."""
    return {r["part"]: r["count"] for r in rows.groupBy(F.shiftright(at, PART_BITS).alias("part")).count().collect()}


def dense(counts: dict[int, int], at: SparkColumn) -> SparkColumn:
    """Those ids without gaps, from 0, in the same order: all rows of earlier partitions, and the place in the own one."""
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    starts = F.from_json(F.lit(str(before)), "array<bigint>")
    return F.get(starts, F.shiftright(at, PART_BITS).cast("int")) + at.bitwiseAND(F.lit((1 << PART_BITS) - 1))


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.state: dict = self.store.read_json(MANIFEST, {})
        self.outside: dict[str, tuple[Schema, DataFrame]] = {}
        self.saved: dict | None = None

    # --- what there is

    def names(self) -> list[str]:
        return sorted({*self.state, *self.outside})

    def schema(self, name: str) -> Schema | None:
        if name in self.outside:
            return self.outside[name][0]
        t = self.state.get(name)
        if t is None:
            return None
        return Schema(name, tuple(Column(*c) for c in t["columns"]), t["primary_key"], t["storage"], tuple(Index(**i) for i in t["indexes"]))

    def read(self, name: str, keys: tuple | None = None) -> DataFrame:
        """The table. With keys, (operator, low, high) of a condition on its primary key, fragments that cannot meet it are not
        read; the condition itself is left to the caller."""
        if name in self.outside:
            return self.outside[name][1]
        files = self.state[name]["snapshots"]
        if not files:
            return self.spark.createDataFrame([], spark_schema(self.schema(name)))
        return self._snapshots(name, files, keys)

    def fragments(self, name: str) -> list[fragments.Fragment]:
        """The range fragments its files are laid out by."""
        return fragments.from_bounds([tuple(f) for f in self.state[name]["fragments"]]) if self.state.get(name, {}).get("laid_out") else []

    def _snapshots(self, name: str, files: list[str], keys: tuple | None = None) -> DataFrame:
        schema = spark_schema(self.schema(name))
        paths = [f"{self.store.root}/{f}" for f in files]
        parts = self.fragments(name)
        if not parts:
            return self.spark.read.schema(schema).parquet(*paths)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.store.root}/{name}").parquet(*paths)
        if keys:
            rows = rows.filter(F.col(FRAGMENT).isNull() | F.col(FRAGMENT).isin(*(f.name for f in fragments.touched(parts, *keys))))
        return rows.select(schema.names)

    def version(self, name: str) -> tuple:
        return tuple(self.state[name]["snapshots"]) if name in self.state else ("outside",)

    # --- changes; each is one manifest write unless a transaction is open

    def _commit(self) -> None:
        if self.saved is None:
            self.store.write_json(MANIFEST, self.state)

    def begin(self) -> None:
        import copy

        self.saved = copy.deepcopy(self.state)

    def commit(self) -> None:
        self.saved = None
        self.store.write_json(MANIFEST, self.state)

    def rollback(self) -> None:
        self.state, self.saved = self.saved, None

    def create(self, schema: Schema, parts: list | None = None) -> None:
        self.state[schema.table] = {"columns": [[c.name, c.kind, c.size] for c in schema.columns], "primary_key": schema.primary_key, "storage": schema.storage, "indexes": [], "snapshots": [], "next_rid": 0, "rows": 0, "fragments": parts or [], "laid_out": bool(parts)}
        self._commit()

    def add_index(self, table: str, index: Index) -> None:
        self.state[table]["indexes"].append(index.__dict__.copy())
        self._commit()

    def drop_index(self, table: str, name: str) -> None:
        self.state[table]["indexes"] = [i for i in self.state[table]["indexes"] if i["name"] != name]
        self._commit()

    def drop(self, name: str) -> None:
        del self.state[name]
        self._commit()
        self.store.delete(name)

    def _write(self, name: str, rows: DataFrame) -> str:
        schema = self.schema(name)
        if schema.storage == "SEQUENTIAL":
            rows = rows.repartitionByRange(schema.primary_key).sortWithinPartitions(schema.primary_key)
        snapshot = f"{name}/{SNAPSHOT}={uuid.uuid4().hex}"
        if parts := self.fragments(name):
            owner = fragments.owner_column(parts, F.col(schema.primary_key))
            rows.withColumn(FRAGMENT, owner).write.partitionBy(FRAGMENT).parquet(f"{self.store.root}/{snapshot}")
        else:
            rows.write.parquet(f"{self.store.root}/{snapshot}")
        return snapshot

    def append(self, name: str, rows: DataFrame) -> int:
        """Rows without RID; they get ids above all earlier ones, without gaps, in their order."""
        t = self.state[name]
        first = t["next_rid"]
        snapshot = self._write(name, rows.withColumn(RID, F.monotonically_increasing_id() + F.lit(first)))
        written = self._snapshots(name, [snapshot])
        counts = part_counts(written, F.col(RID) - F.lit(first))
        n = sum(counts.values())
        if set(counts) - {0}:
            rough, snapshot = snapshot, self._write(name, written.withColumn(RID, dense(counts, F.col(RID) - F.lit(first)) + F.lit(first)))
            self.store.delete(rough)
        t["snapshots"].append(snapshot)
        t["next_rid"], t["rows"] = first + n, t["rows"] + n
        self._commit()
        return n

    def replace(self, name: str, rows: DataFrame, count: int) -> None:
        """The table as these rows (with RID)."""
        t = self.state[name]
        t["snapshots"], t["rows"] = [self._write(name, rows)], count
        self._commit()

    def compact(self, name: str) -> None:
        self.replace(name, self.read(name), self.state[name]["rows"])
