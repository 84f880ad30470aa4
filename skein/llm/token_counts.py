"""Operator 1: token counts through a digest cache.

Each text is normalised (null becomes the empty text, nothing else: any other change could change
the count) and named by its SHA-256; the tokenizer file is named by its own. Digests are joined
to the stored counts, only distinct misses are encoded, and their counts are appended to the cache.
Text moves through one shuffle, and only that of distinct misses survives it.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, same, shared_path
from .pieces import Counter

CACHE_SCHEMA = "content_digest binary, n_tokens long, tokenizer_digest string"


def tokenizer_digest(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(name: str):
    def run(batches):
        import pyarrow as pa

        count, done = Counter(name), set()
        for b in batches:
            # repeated rows of one id and text arrive in the same task
            fresh = []
            for i, digest in enumerate(b.column(0).to_pylist()):
                if digest not in done:
                    if len(done) >= 1_000_000:  # counting one again does no harm
                        done.clear()
                    done.add(digest)
                    fresh.append(i)
            if len(fresh) < b.num_rows:
                b = b.take(pa.array(fresh, pa.int64()))
            texts = b.column(1)
            n = [count(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    return run


def _cached(spark, path: str, digest: str) -> DataFrame | None:
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    # Two runs may have appended the same digest at the same time; both counted alike.
    return found.filter(F.col("tokenizer_digest") == digest).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows and ids, and null ids, each give their own
    row; equal texts are encoded once. Further columns of docs are ignored, whatever their names. An
    empty table gives none. cache is a folder that every executor can reach; without one, a
    fresh folder in the shared directory is used, so that nothing is known beforehand. The result is a table in the shared
    folder.
    """
    with Scratch(docs.sparkSession, "tokens") as scratch:
        return scratch.result(_counts(docs, tokenizer, cache, limit, id_col, text_col, scratch))


def _counts(docs: DataFrame, tokenizer: str, cache: str | None, limit: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    cache = cache or shared_path(spark, "token-cache")
    name = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))

    wanted = keyed.groupBy("digest").agg(F.min("id").alias("first_id"))
    stored = _cached(spark, cache, name)
    if stored is not None:
        wanted = wanted.join(stored, wanted.digest == stored.content_digest, "left_anti")
    wanted = wanted.withColumnRenamed("digest", "miss")
    misses = keyed.join(wanted, (F.col("digest") == F.col("miss")) & same(F.col("id"), F.col("first_id")), "left_semi")
    counted = misses.select("digest", "text").mapInArrow(_counter(tokenizer), "content_digest binary, n_tokens long")
    counted = counted.dropDuplicates(["content_digest"])
    counted.withColumn("tokenizer_digest", F.lit(name)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)

    # Written first: then both sides of the join are shuffled by it, and Spark can split a text with many copies.
    stored = scratch.write(_cached(spark, cache, name), "token-counts")
    sized = keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    out = sized.join(stored, sized.digest == stored.content_digest, "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
