"""The queries of the training-data operators, with production parameters, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, lang_id, packing, quality_classifier, quality_rules, source_mix, surrogates, token_counts, url_filter
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lang_id.held_out(F.col("doc_id"))
    model = lang_id.learn(docs.filter(~held & F.col("doc_id").isNotNull()))
    return lang_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "quality_score", "quality_posterior", F.col("quality_kept").alias("kept"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(packing.pack(table(spark, sf_dir, "documents")))


def packed_digests(packed: DataFrame) -> DataFrame:
    return packed.select("pack_id", "n_tokens", F.size("segments").alias("n_segments"), F.col("segments.id").alias("doc_ids"), F.col("segments.begin").alias("begins"), "cu_seqlens", "resets", F.sha2("ids", 256).alias("ids_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables are synthetic; a key of real data is a secret
    done = surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), "key of the synthetic tables")
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.col("entities.kind").alias("kinds"), F.col("entities.surrogate").alias("surrogates"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language, op3_quality_rules, op4_jaccard_join, op5_quality_classifier, op6_source_mix, op7_url_filter, op8_packing, op9_decontaminate, op10_surrogates)}


def jaccard_sql(words: int = 4, num: int = 85, den: int = 100) -> str:
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + {words}], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {words} + 1, 1))) AS s FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE {den} * o >= {num} * (na.n + nb.n - o)),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
    FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
    """


ORACLE_SQL = {"op4_jaccard_join": jaccard_sql(), "op6_source_mix": source_mix.oracle(), "op9_decontaminate": decontaminate.oracle()}
