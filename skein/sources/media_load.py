"""Features of a folder of media files: read as binary files, extracted on executors, one task per group of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media
from .tables import dense, part_counts


def load_media(spark: SparkSession, folder: str, vocabulary: media.Vocabulary, pattern: str = "*.wav", staged: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, nombre, ruta, rasgos) of the files read, and (ruta, error) of those that could not be. With staged, a folder to write
    to, features are extracted once and ids number the files from 0 in the order of their paths; without it they are hashes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def extract(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows.append((name, path, media.extract_features(name, bytes(content), vocabulary).tolist(), None))
                except Exception as e:  # any broken file is reported, not fatal
                    rows.append((name, path, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["nombre", "ruta", "rasgos", "error"])

    out = files.mapInPandas(extract, "nombre string, ruta string, rasgos array<float>, error string")
    number = F.xxhash64("ruta")
    good = out.filter("error is null")
    if staged:
        out.write.parquet(f"{staged}/read")
        out = spark.read.parquet(f"{staged}/read")
        at = F.monotonically_increasing_id().alias("at")
        out.filter("error is null").repartitionByRange("ruta").sortWithinPartitions("ruta").select("*", at).write.parquet(f"{staged}/good")
        good = spark.read.parquet(f"{staged}/good")
        number = dense(part_counts(good, F.col("at")), F.col("at"))
    return good.select(number.alias("id"), "nombre", "ruta", "rasgos"), out.filter("error is not null").select("ruta", "error")
