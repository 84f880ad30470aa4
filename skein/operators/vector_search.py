"""Nearest neighbours over vector columns: exact scan and inverted lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media, metrics

SAMPLE, SEED, LISTS, PROBES = 4096, 188, 16, 1
MAX_ROWS = (1 << 31) - 1
#: Targets that one pass over the table answers, and targets and rows whose distances are held at once.
TARGETS, TILE = 8192, (256, 1024)


def nearest(table: DataFrame, column: str, target, k: int, metric: str = "cosine", rid: str = "_rid", score: str = "score") -> DataFrame:
    """The k rows nearest to target with their natural score, best first, ties by row id. One pass and a bounded heap
    per partition (TakeOrderedAndProject); no sort of the table."""
    d = metrics.vector_distance(F.col(column), metrics.vector_literal(target), metric)
    found = table.withColumn("_distance", d).orderBy("_distance", rid).limit(min(k, MAX_ROWS))
    return found.withColumn(score, metrics.from_distance(F.col("_distance"), metric)).drop("_distance")


def _tile(targets: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    """Distances of targets (rows) and points (columns), each summed in the order of metrics.vector_distance and so equal to
    it, wherever a vector stands."""
    out = np.zeros((len(targets), len(points)))
    for x, y in zip(targets.T, points.T, strict=True):
        out += np.subtract.outer(x, y) ** 2 if metric == "euclidean" else np.multiply.outer(x, y)
    if metric == "euclidean":
        return np.sqrt(out)
    if metric == "dot":
        return -out
    norms = np.multiply.outer(np.sqrt(_squares(targets)), np.sqrt(_squares(points)))
    return 1 - np.where(norms == 0, 0.0, np.clip(out / np.where(norms == 0, 1.0, norms), -1, 1))


def _squares(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points))
    for x in points.T:
        out += x * x
    return out


def _unit(points: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(points, axis=1, keepdims=True)
    return points / np.where(norms == 0, 1.0, norms)


def _least(targets: np.ndarray, points: np.ndarray, centre: np.ndarray, metric: str) -> np.ndarray:
    """A lower bound of each target's distance to any of the points, by the triangle inequality (dot: Cauchy-Schwarz)."""
    if metric == "cosine":
        targets, points = _unit(targets), _unit(points)
    radius = np.linalg.norm(points - centre, axis=1).max()
    if metric == "dot":
        least = -(targets @ centre + np.linalg.norm(targets, axis=1) * radius)
    else:
        least = np.maximum(0, np.linalg.norm(targets - centre, axis=1) - radius)
    least = least**2 / 2 if metric == "cosine" else least
    return least - 1e-9 * (1 + np.abs(least))


def _scan(targets: np.ndarray, k: int, metric: str, centroids: np.ndarray | None, probed: np.ndarray | None):
    """For mapInArrow over (rid, vector, list): the k nearest of the partition's rows for each target. A target sees the rows of
    its probed lists first, and of another list those batches that may hold a nearer row than its k-th so far."""

    def run(batches):
        dist, rids = np.full((len(targets), k), np.inf), np.full((len(targets), k), np.iinfo(np.int64).max)

        def see(which: np.ndarray, points: np.ndarray, ids: np.ndarray) -> None:
            for i in range(0, len(which), TILE[0]):
                some = which[i : i + TILE[0]]
                for j in range(0, len(points), TILE[1]):
                    d = np.hstack([dist[some], _tile(targets[some], points[j : j + TILE[1]], metric)])
                    r = np.hstack([rids[some], np.broadcast_to(ids[j : j + TILE[1]], (len(some), len(ids[j : j + TILE[1]])))])
                    best = np.lexsort((r, d), axis=1)[:, :k]
                    dist[some], rids[some] = np.take_along_axis(d, best, 1), np.take_along_axis(r, best, 1)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            points = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)
            held = [(i, np.flatnonzero(lists == i)) for i in np.unique(lists)]
            for i, at in held:
                see(np.flatnonzero(probed[:, i]) if probed is not None else np.arange(len(targets)), points[at], ids[at])
            for i, at in held if probed is not None else ():
                least = _least(targets, points[at], centroids[i], metric)
                see(np.flatnonzero(~probed[:, i] & (least <= dist[:, -1])), points[at], ids[at])
        t, n = np.nonzero(rids < np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(rids[t, n]), pa.array(dist[t, n])], ["_t", "_r", "_distance"])

    return run


def nearest_all(table: DataFrame, column: str, targets: DataFrame, k: int, metric: str = "cosine", rid: str = "_rid", ivf: Ivf | None = None, nprobe: int = PROBES) -> DataFrame:
    """target, rid, score, rank: for every row of targets (the same rid and column, distinct rids) the k rows of the table
    nearest to it, ties by row id; rids are integers. Blocks of TARGETS targets each go to all partitions, which are read
    once a block. With ivf (an index of the table), each target's nprobe lists are scanned first and the others only where a
    bound does not exclude them, so no neighbour is lost. Rows without a vector are no neighbours and no targets."""
    rows = (table.withColumn("_list", F.lit(0)) if ivf is None else ivf.lists.withColumnRenamed("list_id", "_list")).filter(F.col(column).isNotNull())
    rows = rows.select(F.col(rid).cast("long"), F.col(column).cast("array<double>"), F.col("_list").cast("int"))
    asked = targets.filter(F.col(column).isNotNull()).select(F.col(rid).cast("long").alias("_id"), F.col(column).cast("array<double>").alias("_v"))
    blocks = -(-asked.count() // TARGETS)
    found = None
    for b in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b).collect()
        if not held or k < 1:
            continue
        points, probed = np.array([r["_v"] for r in held], float), None
        if ivf is not None:
            probed = np.zeros((len(held), len(ivf.centroids)), bool)
            for i, p in enumerate(points):
                probed[i, ivf.probes(p, nprobe)] = True
        scan = _scan(points, k, metric, None if ivf is None else ivf.centroids, probed)
        best = rows.mapInArrow(scan, "_t int, _r long, _distance double")
        ids = table.sparkSession.createDataFrame([(i, r["_id"]) for i, r in enumerate(held)], "_t int, target long")
        best = best.join(F.broadcast(ids), "_t").select("target", F.col("_r").alias(rid), "_distance")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = table.sparkSession.createDataFrame([], f"target long, {rid} long, _distance double")
    rank = F.row_number().over(Window.partitionBy("target").orderBy("_distance", rid))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("target", rid, metrics.from_distance(F.col("_distance"), metric).alias("score"), "rank")


@dataclass
class Ivf:
    lists: DataFrame  # the table with list_id
    centroids: np.ndarray
    column: str

    def probes(self, target, n: int) -> list[int]:
        d = ((self.centroids - np.asarray(target, float)) ** 2).sum(1)
        return [int(i) for i in np.lexsort((np.arange(len(d)), d))[:n]]

    def search(self, target, k: int, metric: str = "cosine", nprobe: int = PROBES, rid: str = "_rid") -> DataFrame:
        """k nearest among the rows of the nprobe lists nearest to target; all lists give the exact answer. If the
        lists are stored partitioned by list_id, other lists are not read."""
        near = self.lists.filter(F.col("list_id").isin(*self.probes(target, nprobe)))
        return nearest(near, self.column, target, k, metric, rid).drop("list_id")


def build_ivf(table: DataFrame, column: str, rid: str = "_rid", nlist: int = LISTS, sample: int = SAMPLE, seed: int = SEED) -> Ivf:
    """Centroids come from a sample of at most `sample` rows (those of the least hash of the row id); every row is put
    into the list of its nearest centroid, the first of equals, in the JVM."""
    rows = table.orderBy(F.xxhash64(F.col(rid), F.lit(seed)), rid).limit(sample).select(column).collect()
    if not rows:
        raise ValueError("an IVF index needs rows")
    points = np.array([r[0] for r in rows], float)
    centroids = media.kmeans(points, min(nlist, len(points)), seed)
    near = F.array(*(F.struct(metrics.euclidean_distance(F.col(column), metrics.vector_literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)))
    return Ivf(table.withColumn("list_id", F.array_min(near)["i"]), centroids, column)
