"""Full-text index and ranking: postings, document statistics, TF-IDF cosine and BM25.

An index is three tables keyed by the row id: postings (term, rid, tf), documents (rid, length, norm) and term
statistics (term, df). A query touches only the postings of its own few terms; documents without one of them
are never scored. Written to a folder, postings lie sorted by term, so that a query reads a few row groups of them, and
no text is analysed again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TextOptions, tokenize

K1, B = 1.2, 0.75


def analyzer(options: TextOptions) -> Callable[[Column], Column]:
    """Tokenizer as an Arrow UDF: column of text -> array of terms."""

    @F.pandas_udf("array<string>")
    def tokens(texts):
        return texts.map(lambda t: tokenize(t, options))

    return tokens


def simple_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in the JVM; no stopwords, no stems."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


@dataclass
class TextIndex:
    postings: DataFrame  # term, rid, tf
    documents: DataFrame  # rid, length, and norm where the index is stored
    terms: DataFrame  # term, df
    n_documents: int
    average_length: float
    tokenize: Callable[[str], list[str]]
    log_tf: bool = True

    def norms(self) -> DataFrame:
        """rid, norm of its tf-idf vector."""
        if "norm" in self.documents.columns:
            return self.documents.filter("length > 0").select("rid", "norm")
        w = _weight(F.col("tf"), self.log_tf) * _idf(self.n_documents)
        return self.postings.join(self.terms, "term").groupBy("rid").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def build_index(table: DataFrame, rid: str, text: str, options: TextOptions | None = TextOptions(), log_tf: bool = True, folder: str | None = None) -> TextIndex:
    """Index of a text column. options None: simple_tokens. Every row counts as a document, also one without terms.

    folder: where to store it, a folder that all executors reach; without one the tables are computed when they are read.
    """
    tokens = simple_tokens if options is None else analyzer(options)
    split = table.select(F.col(rid).alias("rid"), tokens(F.col(text)).alias("tokens"))
    documents = split.select("rid", F.when(F.col("tokens").isNull(), 0).otherwise(F.size("tokens")).alias("length"))
    postings = split.select("rid", F.explode("tokens").alias("term")).groupBy("term", "rid").agg(F.count("*").alias("tf"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    if folder is not None:
        spark = table.sparkSession

        def stored(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return spark.read.parquet(f"{folder}/{name}")

        split = stored(split, "tokens")  # analysed once
        postings = split.select("rid", F.explode("tokens").alias("term")).groupBy("term", "rid").agg(F.count("*").alias("tf"))
        postings = stored(stored(postings, "unsorted").repartitionByRange("term", "rid").sortWithinPartitions("term", "rid"), "postings")
        terms = stored(postings.groupBy("term").agg(F.count("*").alias("df")), "terms")
        n = split.count()
        w = _weight(F.col("tf"), log_tf) * _idf(n)
        norms = postings.join(terms, "term").groupBy("rid").agg(F.sqrt(F.sum(w * w)).alias("norm"))
        documents = split.select("rid", F.when(F.col("tokens").isNull(), 0).otherwise(F.size("tokens")).alias("length"))
        documents = stored(documents.join(norms, "rid", "left"), "documents")
        for name in ("tokens", "unsorted"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    n, average = documents.agg(F.count("*"), F.avg("length")).first()
    import re

    python = (lambda q: re.findall("[a-z0-9]+", q.lower())) if options is None else (lambda q: tokenize(q, options))
    return TextIndex(postings, documents, terms, n, float(average or 0), python, log_tf)


def _weight(tf: Column, log: bool) -> Column:
    return 1 + F.log10(tf.cast("double")) if log else tf.cast("double")


def _idf(n: int) -> Column:
    return F.log10(F.lit(float(n)) / F.col("df"))


def _query(index: TextIndex, query: str) -> DataFrame | None:
    """term, df, qtf of the query's terms; None without any. Few rows, bounded by the query's length."""
    terms = Counter(index.tokenize(query))
    if not terms:
        return None
    spark = index.postings.sparkSession
    wanted = spark.createDataFrame(list(terms.items()), "term string, qtf long")
    return index.terms.filter(F.col("term").isin(*terms)).join(F.broadcast(wanted), "term")


def _none(index: TextIndex) -> DataFrame:
    return index.documents.select("rid", F.lit(0.0).alias("score")).filter(F.lit(False))


def tfidf(index: TextIndex, query: str) -> DataFrame:
    """rid, score: cosine of tf-idf vectors; idf = log10(N / df), so a term of every document weighs nothing."""
    found = _query(index, query)
    if found is None:
        return _none(index)
    idf = _idf(index.n_documents)
    weighted = found.withColumn("qw", _weight(F.col("qtf"), index.log_tf) * idf)
    norm = float(weighted.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw")))).first()[0] or 0)
    if not norm:
        return _none(index)
    terms = [t for t in Counter(index.tokenize(query))]
    hits = index.postings.filter(F.col("term").isin(*terms)).join(F.broadcast(weighted), "term")
    dots = hits.groupBy("rid").agg(F.sum(F.col("qw") * _weight(F.col("tf"), index.log_tf) * idf).alias("dot")).filter("dot > 0")
    if "norm" in index.documents.columns:
        norms = index.documents.select("rid", "norm")
        return dots.join(norms, "rid").select("rid", (F.col("dot") / (F.col("norm") * norm)).alias("score"))
    # norms are needed of documents with a hit only
    w = _weight(F.col("tf"), index.log_tf) * idf
    norms = index.postings.join(dots.select("rid"), "rid", "left_semi").join(index.terms, "term").groupBy("rid").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    return dots.join(norms, "rid").select("rid", (F.col("dot") / (F.col("norm") * norm)).alias("score"))


def bm25(index: TextIndex, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """rid, score; a term twice in the query counts twice."""
    found = _query(index, query)
    if found is None:
        return _none(index)
    n = float(index.n_documents)
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = list(Counter(index.tokenize(query)))
    hits = index.postings.filter(F.col("term").isin(*terms)).join(F.broadcast(found), "term").join(index.documents, "rid")
    length = (F.col("length") / index.average_length) if index.average_length else F.lit(0.0)
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
    return hits.groupBy("rid").agg(F.sum(part).alias("score")).filter("score > 0")


def rank(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Best first, ties by row id; a top-k never sorts more than k rows per partition."""
    out = scores.orderBy(F.desc("score"), "rid")
    return out if k is None else out.limit(k)
