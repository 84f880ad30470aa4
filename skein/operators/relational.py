"""Grouping and joining with the dialect's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Powers of two that one band of exact sums spans, and bits of a double's mantissa.
BAND, MANTISSA = 8, 53
#: Bits of the low half when a band's sum is split into two doubles, both exact.
HALF = 50
#: Values below 2 ** (BAND * LOWEST) in size are summed plainly.
LOWEST = -120


def _band(value: Column) -> Column:
    """The band of a value by its exponent; null for null, zero, infinite, NaN and the very smallest values, summed plainly."""
    size = F.abs(value)
    band = F.floor(F.log2(size) / BAND).cast("int")
    return F.when((size > 0) & (size < float("inf")) & (band >= LOWEST), band)


def _total(parts: Column) -> Column:
    """Sum of an array of exact doubles, largest bands first, with the rounding errors added at the end."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(parts, start, add, lambda a: a["s"] + a["c"])


def grouped(table: DataFrame, key: Column, items: list[tuple[str, str, Column | None]]) -> DataFrame:
    """_key and one column per (name, function, column): COUNT is INT, MIN and MAX keep the type, SUM and AVG are DOUBLE and
    free of rounding between the terms, whatever the order and the partitions.

    A value is an integer times the unit of its band of exponents, so a band's values are summed exactly, as decimals, in
    ordinary partial aggregates; a group has few bands (at most 249), and their sums are added with compensation. Grouping by key
    and band first also spreads a hot key. Nulls are left out; a group of nulls has sum null; NaN and infinities add up as usual.
    """
    summed = [c for _, f, c in items if f in ("SUM", "AVG")]
    rows = [key.alias("_key"), *((c if c is not None else F.lit(1)).alias(f"_c{i}") for i, (_, _, c) in enumerate(items))]
    if not summed:
        plain = {"COUNT": lambda c: F.count(F.lit(1)).cast("int"), "MIN": F.min, "MAX": F.max}
        return table.select(*rows).groupBy("_key").agg(*(plain[f](F.col(f"_c{i}")).alias(n) for i, (n, f, _) in enumerate(items)))
    exact = [i for i, (_, f, _) in enumerate(items) if f in ("SUM", "AVG")]
    doubles = table.select(*rows).withColumns({f"_c{i}": F.col(f"_c{i}").cast("double") for i in exact})
    banded = doubles.withColumns({f"_b{i}": _band(F.col(f"_c{i}")) for i in exact})
    first, last = [F.count(F.lit(1)).alias("_n")], []
    for i, (name, function, _) in enumerate(items):
        v, b = F.col(f"_c{i}"), F.col(f"_b{i}")
        if function == "COUNT":
            last.append(F.sum("_n").cast("int").alias(name))
        elif function in ("MIN", "MAX"):
            f = getattr(F, function.lower())
            first.append(f(v).alias(f"_c{i}"))
            last.append(f(f"_c{i}").alias(name))
        else:
            units = (v * F.pow(F.lit(2.0), F.lit(float(MANTISSA)) - BAND * b)).cast("long").cast("decimal(28,0)")
            first += [F.sum(units).alias(f"_u{i}"), F.sum(F.when(b.isNull(), v)).alias(f"_p{i}"), F.count(v).alias(f"_n{i}")]
            unit = F.pow(F.lit(2.0), F.lit(float(-MANTISSA)) + BAND * b)
            high = F.expr(f"_u{i} div {1 << HALF}").cast("double") * (unit * float(1 << HALF))
            low = F.expr(f"_u{i} % {1 << HALF}").cast("long").cast("double") * unit
            bands = F.array_sort(F.collect_list(F.when(b.isNotNull(), F.struct((-b).alias("o"), high.alias("h"), low.alias("l")))))
            parts = F.flatten(F.transform(bands, lambda x: F.array(x["h"], x["l"])))
            number = F.sum(f"_n{i}")
            total = F.coalesce(_total(parts), F.lit(0.0)) + F.coalesce(F.sum(f"_p{i}"), F.lit(0.0))
            last.append(F.when(number > 0, total if function == "SUM" else total / number).alias(name))
    return banded.groupBy("_key", *(f"_b{i}" for i in exact)).agg(*first).groupBy("_key").agg(*last)


def compensated_sums(table: DataFrame, key: str, value: str) -> DataFrame:
    """key, total: sums free of rounding between the terms, in any order and partitioning."""
    return grouped(table, F.col(key), [("total", "SUM", F.col(value))]).withColumnRenamed("_key", key)


def join_columns(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with names that collide prefixed by the table's name."""
    shared = set(left.columns) & set(right.columns)

    def renamed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(f"{name}.{c}" if c in shared else c) for c in df.columns))

    return renamed(left, names[0]), renamed(right, names[1])
