"""Operator 5: quality classifier from weak labels.

Overlapping heuristic labellers vote on every document; expectation-maximisation over the counts of
all vote patterns estimates their accuracies without any true label. The posterior of a bounded sample
trains a hashed linear scorer, which then scores every whole text, also where no labeller voted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .weak import RULES, TextStats, pattern_code, posterior_by_pattern, votes

DIM = 1 << 12
#: Characters hashed at once; bounds memory.
GROUP_CHARS = 500_000


def features(texts: list[str], stats: list[dict]) -> np.ndarray:
    """Unit vectors of hashed character trigrams (square roots of shares) and of coarse text statistics."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        for at in range(0, len(text), GROUP_CHARS):
            c = np.frombuffer(text[max(0, at - 2) : at + GROUP_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(c) > 2:
                h = (c[:-2] * np.uint32(2654435761)) ^ (c[1:-1] * np.uint32(2246822519)) ^ (c[2:] * np.uint32(3266489917))
                out[i] += np.bincount((h >> np.uint32(17)) % np.uint32(DIM - 256), minlength=DIM)
        row = out[i]
        row /= max(1.0, row.sum())
        np.sqrt(row, out=row)
        s = stats[i]
        if n := s["n_words"]:
            for k, (name, whole) in enumerate((("n_symbols", n), ("n_dup_lines", s["n_lines"]), ("n_repeat_words", n), ("n_same_next", n), ("n_distinct", n), ("n_shout", n), ("n_bangs", n), ("n_stop", 10), ("n_digits", s["word_chars"]), ("word_chars", 12 * n), ("n_stops", n))):
                row[DIM - 256 + 16 * k + min(15, int(16 * s[name] / max(1, whole)))] = 0.3
    return out


def _votes():
    def run(batches):
        import pyarrow as pa

        stats = TextStats()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pattern_code(votes(stats(x.as_py()))) for x in b.column(0)], pa.int64())], ["votes"])

    return run


def _sampled():
    def run(batches):
        import pyarrow as pa

        stats = TextStats()
        for b in slices(batches):
            texts = [x or "" for x in b.column(0).to_pylist()]
            s = [stats(t) for t in texts]
            x = features(texts, s).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([pattern_code(votes(y)) for y in s], pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["votes", "x"])

    return run


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    posterior: dict[int, float]
    accuracy: dict[str, float]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def train(docs: DataFrame, sample: int = 3000, rounds: int = 150, rate: float = 3.0, ridge: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Votes of all documents give the labellers' accuracies; about `sample` documents, drawn by a hash of
    id and text, train the linear scorer on their posteriors. Both classes weigh the same there.

    An empty table, or one whose votes all agree, gives a scorer that keeps everything the votes keep.
    """
    rows = docs.select(F.col(text_col).alias("text"))
    counts = [tuple(r) for r in rows.mapInArrow(_votes(), "votes long").groupBy("votes").count().collect()]
    posterior, fit = posterior_by_pattern(counts)
    total = sum(n for _, n in counts)
    share = min(1.0, sample / max(1, total))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("quality sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    found = docs.filter(drawn).select(F.col(text_col).alias("text")).mapInArrow(_sampled(), "votes long, x binary").toArrow()
    y = np.array([posterior[v] for v in found["votes"].to_pylist()])
    weights, bias = np.zeros(DIM, np.float32), 0.0
    if len(y):
        x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float16).reshape(len(y), DIM).astype(np.float32)
        n_good, n_bad = y.sum(), (1 - y).sum()
        if min(n_good, n_bad) < 0.5:
            bias = 5.0 if n_good > n_bad else -5.0
        else:
            w = (y / n_good + (1 - y) / n_bad) / 2
            speed, fast = np.zeros_like(weights), 0.0
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
                # gradient of the weighted cross entropy against soft labels
                g = w * (p - y)
                speed = 0.9 * speed - rate * (x.T @ g.astype(np.float32) + ridge * weights)
                fast = 0.9 * fast - rate * float(g.sum())
                weights, bias = weights + speed, bias + fast
    return Scorer(weights, float(bias), posterior, dict(zip(RULES, map(float, fit["accuracy"]), strict=True)))


def _score(scorer: Scorer, names: list[str], text_at: int, dropped: list[int]):
    def run(batches):
        import pyarrow as pa

        stats = TextStats()
        for b in slices(batches, 64):
            texts = [x or "" for x in b.column(text_at).to_pylist()]
            s = [stats(t) for t in texts]
            codes = [scorer.posterior.get(pattern_code(votes(y))) for y in s]
            columns = [b.column(k) for k in range(b.num_columns) if k not in dropped]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scorer(features(texts, s)).tolist(), pa.float64()), pa.array(codes, pa.float64())], names)

    return run


ADDED = ("quality_score", "quality_posterior", "quality_kept")


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", added: tuple[str, str, str] = ADDED) -> DataFrame:
    """docs with two columns, the scorer's score and the votes' posterior (null for a pattern not seen in training);
    columns of docs by their names (the first two of added) are replaced. Null text counts as empty: it has no features,
    so it gets the scorer's bias. Every row gives one row, in the same partition.
    """
    dropped = [i for i, c in enumerate(docs.columns) if c in added[:2]]
    kept = [f for f in docs.schema.fields if f.name not in added[:2]]
    schema = T.StructType([*kept, *(T.StructField(c, T.DoubleType()) for c in added[:2])])
    return docs.mapInArrow(_score(scorer, schema.names, docs.columns.index(text_col), dropped), schema)


def classify(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id", added: tuple[str, str, str] = ADDED, **training) -> DataFrame:
    """docs scored by a model trained on docs, with a third column: score >= threshold. Columns of docs named like one of
    added are replaced; give other names to keep them. See train and score."""
    out = score(docs.drop(added[2]), train(docs, id_col=id_col, text_col=text_col, **training), text_col, added)
    return out.withColumn(added[2], F.col(added[0]) >= threshold)
