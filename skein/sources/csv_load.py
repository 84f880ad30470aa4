"""CSV with a report of the rows that were not accepted.

Every field is read as text and converted by column expressions; a row's first failing field is its error. Inferred are each
file's encoding, delimiter and order of columns, by one pass over all of its lines. Files of any size are split among executors,
but for those that may hold a line break within quotes: one task reads each of these as a stream.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.binder import Column, Schema
from ..plans.errors import ExecutionError

REPORTED = 100
#: Spark's reader knows no cp1252; it differs from Latin 1 in these characters only.
_READ = {"utf-8": "utf-8", "cp1252": "iso-8859-1"}
_BYTES = bytes(i for i in range(0x80, 0xA0) if i not in b"\x81\x8d\x8f\x90\x9d")
_CP1252 = (_BYTES.decode("latin-1"), _BYTES.decode("cp1252"))


def delimiter_of(header: str) -> str:
    """That of , ; and tab which cuts the header into most columns, the first of equals."""
    return max(",;\t", key=lambda d: len(next(csv.reader([header], delimiter=d))))


@dataclass(frozen=True)
class Format:
    """What files have in common that are read alike."""

    encoding: str
    header: str
    broken_lines: bool


def formats_of(spark: SparkSession, path: str) -> dict[Format, list[str]]:
    """The files by format. Encoding, by all bytes: UTF-8, or cp1252 for a file that is not UTF-8 and has no multi-byte sequence of
    it; a file that is neither is refused. Header: the first line that is not blank. Line breaks within quotes are assumed
    where some line has an odd number of quotes."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).withColumn("n", F.monotonically_increasing_id())
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    valid = F.is_valid_utf8("value")
    neither = F.bool_or(latin.rlike(r"[\xc2-\xf4][\x80-\xbf]")) | F.bool_or(latin.rlike(r"[\x81\x8d\x8f\x90\x9d]"))
    odd = F.bool_or(F.length(F.regexp_replace(latin, '[^"]', "")) % 2 == 1)
    first = F.min_by(latin, F.when(F.trim(latin) != "", F.struct("start", "n")))
    out: dict[Format, list[str]] = {}
    for r in lines.groupBy("file").agg(F.bool_and(valid).alias("utf8"), neither.alias("neither"), odd.alias("odd"), first.alias("header")).orderBy("file").collect():
        name = unquote(r["file"])
        if not r["utf8"] and r["neither"]:
            own = lines.filter(F.col("file") == r["file"])
            bad = own.filter(~valid).orderBy("start", "n").first()
            line = own.filter((F.col("start") < bad["start"]) | (F.col("start") == bad["start"]) & (F.col("n") <= bad["n"])).count()
            raise ExecutionError(f"{name}, line {line}: a byte that is not UTF-8")
        encoding = "utf-8" if r["utf8"] else "cp1252"
        header = (r["header"] or "").encode("latin-1").decode(encoding).lstrip("\ufeff")
        out.setdefault(Format(encoding, header, r["odd"]), []).append(name)
    if not any(f.header.strip() for f in out):
        raise ExecutionError("the file is empty; a header is needed")
    return {f: files for f, files in out.items() if f.header.strip()}


def places_of(names: list[str], schema: Schema) -> list[int]:
    """Where each column of the schema stands in the header: all of them once, in any order and case, and no others."""
    used = names[: max((i + 1 for i, n in enumerate(names) if n), default=0)]
    places = []
    for c in schema.columns:
        hit = [i for i, n in enumerate(used) if n == c.name] or [i for i, n in enumerate(used) if n.lower() == c.name.lower()]
        if len(hit) != 1:
            raise ExecutionError(f"the header has no column {c.name}" if not hit else f"the header has column {c.name} twice")
        places.append(hit[0])
    if extra := [n for i, n in enumerate(used) if i not in places]:
        raise ExecutionError(f"the header has a column {extra[0]!r} that the table has not")
    return places


def _converted(column: Column, raw: SparkColumn, comma: bool) -> tuple[SparkColumn, SparkColumn]:
    """(value, error or null) of a text field."""
    text = F.trim(raw)
    if column.kind == "VARCHAR":
        v = F.coalesce(raw, F.lit(""))
        bad = F.when(F.octet_length(v) > column.size, F.lit(f"more than {column.size} bytes")) if column.size else F.lit(None)
        return v, bad
    empty = F.when(text.isNull() | (text == ""), F.lit("empty field"))
    if column.kind == "BOOL":
        low = F.lower(text)
        v = F.when(low.isin("true", "t", "1"), True).when(low.isin("false", "f", "0"), False)
    elif column.kind == "DATE":
        v = F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))
    elif column.kind == "INT":
        v = F.when(text.rlike(r"\A[+-]?\d{1,19}\z"), text.try_cast("int"))
    elif column.kind == "DOUBLE":
        number = F.replace(text, F.lit(","), F.lit(".")) if comma else text
        v = F.when(number.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), number.try_cast("double"))
        v = F.when(F.abs(v) < float("inf"), v)
    else:
        raise ExecutionError(f"column {column.name}: {column.kind} cannot be loaded from CSV")
    return v, empty.otherwise(F.when(v.isNull(), F.lit(f"not a {column.kind}")))


def read_csv(spark: SparkSession, path: str, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with the schema's columns, rejected rows: error, raw). The header is mandatory; its names may differ
    in case. Files of a folder may differ in encoding, delimiter and order of columns."""
    formats, judged = formats_of(spark, path), None
    for form, files in formats.items():
        sep = delimiter_of(form.header)
        names = [h.strip() for h in next(csv.reader([form.header], delimiter=sep))]
        places = places_of(names, schema)
        fields = T.StructType([*(T.StructField(f"_f{i}", T.StringType()) for i in range(len(names))), T.StructField("_raw", T.StringType())])
        paths = path if len(formats) == 1 else [re.sub(r"([*?\[\]{}\\])", r"\\\1", f) for f in files]
        rows = spark.read.csv(paths, schema=fields, header=True, sep=sep, encoding=_READ[form.encoding], mode="PERMISSIVE", columnNameOfCorruptRecord="_raw", enforceSchema=True, nullValue="\0", emptyValue="", escape='"', multiLine=form.broken_lines)
        if form.encoding == "cp1252":
            rows = rows.select(*(F.translate(c, *_CP1252).alias(c) for c in rows.columns))
        values, errors = [], [F.when(F.col("_raw").isNotNull(), F.lit("wrong number of fields"))]
        for c, i in zip(schema.columns, places, strict=True):
            v, e = _converted(c, F.col(f"_f{i}"), sep == ";")
            values.append(v.alias(c.name))
            errors.append(F.when(e.isNotNull(), F.concat(F.lit(f"{c.name}: "), e)))
        part = rows.select(*values, F.coalesce(*errors).alias("_error"), F.concat_ws(sep, *(f"_f{i}" for i in range(len(names)))).alias("_line"))
        judged = part if judged is None else judged.unionByName(part)
    accepted = judged.filter("_error is null").drop("_error", "_line")
    return accepted, judged.filter("_error is not null").select(F.col("_error").alias("error"), F.col("_line").alias("raw"))
