import os

import duckdb
import pytest

from pyspark.sql import functions as F

from skein import queries
from skein.operators import evaluation, text_search

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def check(spark, run, sql):
    got = run(spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    order = sorted(names)
    assert sorted(got.columns) == order
    a = sorted(repr(tuple(plain(r[c]) for c in order)) for r in got.collect())
    b = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in want.fetchall())
    assert a == b


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLE_SQL:
        check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])
    else:
        assert queries.QUERIES[name](spark, DIR).count() > 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver tables")
@pytest.mark.parametrize("folder", [DIR, "/root/testdata/sf0.1"])
def test_recall_of_ivf_probe(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    exact = con.execute("""SELECT a.vec_id, b.vec_id FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 10""").fetchall()
    found = queries.QUERIES["ivf_probe"](spark, folder).select(F.col("target").alias("query"), F.col("vec_id").alias("item"))
    recall = evaluation.neighbour_recall(spark.createDataFrame(exact, "query long, item long"), found).collect()
    assert len(recall) == e.filter("vec_id % 100 = 0").count() and len(exact) == found.count()
    assert min(r["recall"] for r in recall) >= 0.9


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver tables")
def test_match_stemmed_indexes_all_documents(spark, monkeypatch):
    seen, build = [], text_search.build_index
    monkeypatch.setattr(queries, "_INDEXES", {})
    monkeypatch.setattr(text_search, "build_index", lambda t, *a, **b: seen.append(t.count()) or build(t, *a, **b))
    queries.QUERIES["match_stemmed"](spark, DIR)
    assert seen == [spark.read.parquet(f"{DIR}/documents.parquet").count()]
