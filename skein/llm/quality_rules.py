"""Operator 3: quality rules as weak supervision.

Every rule votes good, bad or nothing on a document. Expectation-maximisation over the counts of
all vote patterns estimates each rule's accuracy, and a document's posterior probability of being good
decides, not the demand that it pass every rule. The pattern table has at most 3 ** rules rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices
from .weak import TextStats, pattern_code, posterior_by_pattern, votes

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(id_name: str):
    def run(batches):
        import pyarrow as pa

        stats = TextStats()
        for b in slices(batches):
            texts, rows = b.column(1), {k: [] for k in [*STATS, "votes"]}
            for i in range(len(texts)):
                s = stats(texts[i].as_py())
                for k in STATS:
                    rows[k].append(s[k])
                rows["votes"].append(pattern_code(votes(s)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64()) for v in rows.values())], [id_name, *rows])

    return run


def quality_rules(docs: DataFrame, threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, p_good (posterior probability of good).

    A null text has no words, so it fails the base. Repeated rows and ids each give a row; further columns
    of docs are ignored. An empty table gives none. min_words and max_repeat (per cent of words in
    repeated windows) set base_failed; kept is false there, else p_good >= threshold.
    """
    types = dict(docs.dtypes)
    schema = f"`{id_col}` {types[id_col]}, " + ", ".join(f"{k} long" for k in [*STATS, "votes"])
    measured = materialise(docs.select(id_col, text_col).mapInArrow(_measure(id_col), schema), "rule-votes")
    posterior, _ = posterior_by_pattern([tuple(r) for r in measured.groupBy("votes").count().collect()])
    table = docs.sparkSession.createDataFrame([(c, p) for c, p in posterior.items()] or [(-1, 0.0)], "votes long, p_good double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    out = measured.join(F.broadcast(table), "votes", "left").withColumn("base_failed", failed)
    return out.select(id_col, *STATS, "base_failed", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"), "p_good")
