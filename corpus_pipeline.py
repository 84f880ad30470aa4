"""A corpus pipeline of the training-data operators: five stages, each over all that its predecessor kept.

run() writes each stage's rows to the shared folder, reads them again as the next stage's documents and deletes them once
they have been read. The result, token rows packed from the mixed documents, cannot be expressed in SQL, so ORACLE_SQL
is None. Tests hold the near-duplicate stage against brute force and the others on small cases; the operators that the stages
call have their own.

Stages tell rows apart by id and two hashes of the text, so a null id, or one id on unlike texts, neither loses nor keeps a
document wrongly. Rows repeated with id and text are copies: near_duplicates leaves one of them. Columns of documents keep
their values whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, jaccard_join, packing, quality_classifier, source_mix
from skein.llm.common import Scratch, few, marked, materialise, table, without
from skein.llm.queries import packed_digests


def _key():
    """Names a row by its id and text. Orders by id, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    added = ["quality_score", "quality_posterior", "quality_kept"]
    while set(added) & set(docs.columns):
        added = ["_" + c for c in added]
    judged = quality_classifier.classify(docs, added=tuple(added))
    return judged.filter(F.col(added[2])).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group linked by five-word shingles at 0.8 or more.

    Of rows repeated with id and text one stays; if they differ in other columns, the one with the least hash of all.
    """
    found = jaccard_join.jaccard_components(docs.select(_key().alias("key"), "text"), words=5, num=80, den=100, id_col="key")
    with Scratch(spark, "near-duplicates") as scratch:
        gone = scratch.result(found.filter("key <> component_id").select("key").distinct())
        first = found.filter("key = component_id").groupBy("key").count().filter("count > 1").select("key")
        again = scratch.result(first)
        scratch.drop(found)
    kept = without(docs, _key(), gone)
    if not again.limit(1).count():
        return kept
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    flagged = marked(kept.select(whole, _key().alias("mine")), F.xxhash64("mine"), again.select(F.xxhash64("key").alias("h")))
    rows, side = flagged.filter("maybe"), F.broadcast(again) if few(again) else again
    single = rows.join(side, F.col("mine") == F.col("key"), "left_semi").groupBy("mine").agg(F.min_by("whole", F.xxhash64("whole")).alias("whole"))
    others = rows.join(side, F.col("mine") == F.col("key"), "left_anti")
    return flagged.filter("not maybe").select("whole.*").unionByName(others.select("whole.*")).unionByName(single.select("whole.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.contamination(docs.select(_key().alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    with Scratch(spark, "decontaminated") as scratch:
        gone = scratch.result(found.filter("contaminated").select("key").distinct())
        scratch.drop(found)
    return without(docs, _key(), gone)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document that is taken twice stands twice; one that is not taken is left out."""
    return source_mix.mixed(docs)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token rows: written in full to the shared folder, returned as digests."""
    return packed_digests(packing.pack(docs))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_rows),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
            if before is not None:
                scratch.drop(before)
            before = docs
        return materialise(STAGES[-1][1](spark, docs, sf_dir), "token-rows")
