"""Fusing and cutting rankings, identification by threshold, and cutting texts into chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, GROUP_CAP, THRESHOLD = 60, 3, 0.55
CHUNK_WORDS, LEAST_WORDS, MOST_WORDS, OVERLAP, MOST_BYTES = 300, 200, 500, 50, 4000


def reciprocal_rank_fusion(rankings: list[DataFrame], key: str, rank: str = "rank", k: int = RRF_K) -> DataFrame:
    """key, rrf, best_rank: sum of 1 / (k + rank) over the rankings, each a bounded list of candidates. Order by rrf
    descending, then best_rank, then key."""
    every = rankings[0].select(key, rank)
    for r in rankings[1:]:
        every = every.unionByName(r.select(key, rank))
    return every.groupBy(key).agg(F.sum(F.lit(1.0) / (k + F.col(rank))).alias("rrf"), F.min(rank).alias("best_rank"))


def ranked(candidates: DataFrame, score: str, key: str, descending: bool = True) -> DataFrame:
    """candidates with rank from 1. They must be few (the result of a top-k): they are ranked in one task."""
    s = F.col(score)
    return candidates.withColumn("rank", F.row_number().over(Window.orderBy(s.desc() if descending else s, key)))


def cap_per_group(table: DataFrame, group: str, order: list[Column], cap: int = GROUP_CAP) -> DataFrame:
    """The first `cap` rows of each group. Spark cuts each partition's groups before it shuffles."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return table.withColumn("_n", n).filter(F.col("_n") <= cap).drop("_n")


def collapse(chunks: DataFrame, document: str, score: str) -> DataFrame:
    """Documents by the best of their chunks."""
    return chunks.groupBy(document).agg(F.max(score).alias(score))


def identify(nearest: DataFrame, distance: str, identity: str, threshold: float = THRESHOLD) -> DataFrame:
    """Accept the nearest neighbour if it is near enough; confidence falls from 1 to 0 at the threshold."""
    near = F.col(distance) <= threshold
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (threshold - F.col(distance)) / threshold))
    return nearest.withColumns({"identified": F.when(near, F.col(identity)), "confidence": F.when(near, sure).otherwise(0.0)})


def split_identities(photos: DataFrame, identity: str, photo: str, intruders: float = 0.3) -> DataFrame:
    """photos with role: the first 30 % of identities are intruders, at least one if any share is asked for; of the rest, the
    last photo is the query and the others are the base."""
    ids = photos.select(identity).distinct()
    n = max(1, int(ids.count() * intruders)) if intruders > 0 else 0
    place = F.row_number().over(Window.orderBy(identity))
    strangers = ids.withColumn("_p", place).filter(F.col("_p") <= n).select(F.col(identity).alias("_id"))
    last = F.max(photo).over(Window.partitionBy(identity))
    marked = photos.withColumn("_last", last).join(strangers, F.col(identity) == F.col("_id"), "left")
    role = F.when(F.col("_id").isNotNull(), "intruder").when(F.col(photo) == F.col("_last"), "query").otherwise("base")
    return marked.withColumn("role", role).drop("_last", "_id")


def sweep_thresholds(probes: DataFrame, thresholds: list[float]) -> DataFrame:
    """probes: distance, same (whether the nearest has the probe's identity), intruder. One row per threshold with
    precision, false_positive_rate and balance; one pass, whatever the number of thresholds."""
    stacked = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    rows = probes.select(stacked, "distance", "same", "intruder").withColumn("accepted", F.col("distance") <= F.col("threshold"))

    def share(hit: Column, of: Column) -> Column:
        return F.coalesce(F.sum(F.when(hit & of, 1.0).otherwise(0.0)) / F.nullif(F.sum(F.when(of, 1.0).otherwise(0.0)), F.lit(0.0)), F.lit(0.0))

    known = ~F.col("intruder")
    right, false = share(F.col("accepted") & F.col("same"), known), share(F.col("accepted"), F.col("intruder"))
    out = rows.groupBy("threshold").agg(right.alias("precision"), false.alias("false_positive_rate"))
    return out.withColumn("balance", F.col("precision") - F.col("false_positive_rate"))


def best_threshold(sweep: DataFrame) -> float:
    """The best balance; the strictest of equals."""
    return sweep.orderBy(F.desc("balance"), "threshold").first()["threshold"]


def chunk_text(text: str | None, words: int = CHUNK_WORDS, least: int = LEAST_WORDS, most: int = MOST_WORDS, overlap: int = OVERLAP, most_bytes: int = MOST_BYTES) -> list[str]:
    """Pieces of about `words` words that end at the sentence end nearest to that, overlap, and fit most_bytes."""
    every = (text or "").split()
    out, at = [], 0
    while at < len(every):
        end = len(every)
        if end - at > most or (end - at > words and end - at - words >= least):
            ends = [i for i in range(at + least, min(at + most, end) + 1) if re.search(r"[.!?]['\")\]]*$", every[i - 1])]
            end = min(ends, key=lambda i: (abs(i - at - words), i), default=at + words)
        size = sum(len(w.encode()) + 1 for w in every[at:end]) - 1
        while end - at > 1 and size > most_bytes:
            end -= 1
            size -= len(every[end].encode()) + 1
        out.append(" ".join(every[at:end]))
        if end >= len(every):
            break
        at = max(end - overlap, at + 1)
    return out


def chunks(documents: DataFrame, key: str, text: str, **sizes) -> DataFrame:
    """key, position, chunk: one row per chunk, through an Arrow UDF."""

    @F.pandas_udf("array<string>")
    def cut(texts):
        return texts.map(lambda t: chunk_text(t, **sizes))

    return documents.select(key, F.posexplode(cut(text)).alias("position", "chunk"))
