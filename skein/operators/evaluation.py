"""Measures of retrieval: precision, recall, hit rate, reciprocal rank, recall of approximate neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(results: DataFrame, relevant: DataFrame, k: int, query: str = "query", item: str = "item", rank: str = "rank") -> DataFrame:
    """query, precision, recall at k. results: query, item, rank; relevant: query, item (distinct). Queries without
    a relevant item are left out."""
    top = results.filter(F.col(rank) <= k).select(query, item).withColumn("found", F.lit(1))
    joined = relevant.join(top, [query, item], "left")
    hits = F.sum(F.coalesce("found", F.lit(0)))
    return joined.groupBy(query).agg((hits / k).alias("precision"), (hits / F.count("*")).alias("recall"))


def reciprocal_ranks(results: DataFrame, relevant: DataFrame, k: int = 10, query: str = "query", item: str = "item", rank: str = "rank") -> DataFrame:
    """query, first_rank (null if none within k), reciprocal."""
    hit = results.filter(F.col(rank) <= k).join(relevant, [query, item]).groupBy(query).agg(F.min(rank).alias("first_rank"))
    every = relevant.select(query).distinct().join(hit, query, "left")
    return every.withColumn("reciprocal", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))


def neighbour_recall(exact: DataFrame, approximate: DataFrame, query: str = "query", item: str = "item") -> DataFrame:
    """query, recall: share of the exact neighbours that the approximate list has; also the overlap of two metrics."""
    joined = exact.select(query, item).join(approximate.select(query, item).withColumn("found", F.lit(1)), [query, item], "left")
    return joined.groupBy(query).agg((F.sum(F.coalesce("found", F.lit(0))) / F.count("*")).alias("recall"))


def permutation_test(differences, rounds: int = 10_000, seed: int = 188) -> float:
    """Two-sided p-value that the mean of paired differences is 0, by random changes of sign."""
    d = np.asarray(differences, float)
    if not len(d):
        return 1.0
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (rounds, len(d)))
    return float(((np.abs((signs * d).mean(1)) >= abs(d.mean()) - 1e-12).sum() + 1) / (rounds + 1))
