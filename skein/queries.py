"""Queries of the engine's own operators over the driver tables, each with equivalent DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import metrics
from .functions.text import TextOptions
from .operators import evaluation, fragments, fusion, relational, spatial, text_search, vector_search
from .plans.binder import Index
from .session import Session
from .sources.files import fingerprint, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Points derived from integer keys, alike in Spark and in SQL.
LAT, LON = "((({k} * 37) % 1800) / 10.0 - 90)", "((({k} * 91) % 3600) / 10.0 - 180)"
LIMA = (-12.05, -77.04)
RING = [(-40.05, -70.05), (35.05, -60.05), (10.05, 10.05), (30.05, 80.05), (-35.05, 60.05)]
FRAGMENTS = fragments.from_bounds([("p0", 4000, "n1"), ("p1", 9000, "n2"), ("p2", None, "n3")])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _session(spark: SparkSession, d: str, *names: str) -> Session:
    """The dialect over driver tables, registered as they are; nothing is written."""
    db = Session(spark, shared_folder(spark) + "/skein-none")
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "part": "p_partkey", "documents": "doc_id", "embeddings": "vec_id", "events": "event_id"}
    for n in names:
        df = table(spark, d, n)
        key = keys.get(n)
        if n == "orders":
            df = df.withColumn("o_orderdate", F.to_date("o_orderdate"))
        if n in ("customer", "supplier"):
            lat, lon = (F.expr(x.format(k=key)).cast("double") for x in (LAT, LON))
            df = df.withColumn("place", F.struct(lat.alias("latitude"), lon.alias("longitude")))
        indexes = (Index("docs", "text", "FULLTEXT", language="simple"),) if n == "documents" else ()
        db.register(n, df, key, indexes=indexes)
    db.stored_indexes["documents", "text"] = lambda: _index(spark, d)
    return db


def dialect(name: str, tables: tuple[str, ...], statement: str, oracle: str, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A query through the SQL dialect; after: rounding for comparison."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return after(_session(spark, d, *tables).execute(statement).df)

    QUERIES[name], ORACLE_SQL[name] = run, oracle


def rounded(**columns: int):
    return lambda df: df.withColumns({c: F.round(c, n) for c, n in columns.items()})


def renamed(**names: str):
    return lambda df: df.withColumnsRenamed(names)


# --- scans, filters, joins, groups, order

dialect("scan_all", ("nation",), "SELECT * FROM nation", "SELECT * FROM nation")
dialect("project_cols", ("customer",), "SELECT c_name, c_acctbal FROM customer", "SELECT c_name, c_acctbal FROM customer")
dialect("filter_eq", ("customer",), "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
dialect("point_search", ("orders",), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
dialect("filter_range", ("orders",), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 300000.0", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 300000.0")
dialect("filter_less", ("orders",), "SELECT o_orderkey FROM orders WHERE o_orderkey < 100", "SELECT o_orderkey FROM orders WHERE o_orderkey < 100")
dialect("filter_between", ("lineitem",), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
dialect("filter_between_empty", ("orders",), "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 9 AND 3", "SELECT o_orderkey FROM orders WHERE false")
dialect("filter_date_range", ("orders",), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'", "SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
dialect("join_inner", ("orders", "customer"), "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
dialect("join_where", ("orders", "customer"), "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000.0", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
dialect("join_order_limit", ("orders", "customer"), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 25", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 25")
dialect("join_star", ("nation", "region"), "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
dialect("join_group", ("orders", "customer"), "SELECT c_mktsegment, COUNT(*), AVG(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*)::INT AS COUNT_all, round(avg(o_totalprice), 4) AS AVG_o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", rounded(AVG_o_totalprice=4))
dialect("group_count", ("events",), "SELECT event_type, COUNT(*) FROM events GROUP BY event_type", "SELECT event_type, count(*)::INT AS COUNT_all FROM events GROUP BY event_type")
dialect("group_sum_avg", ("lineitem",), "SELECT l_returnflag, SUM(l_quantity), AVG(l_discount), SUM(l_linenumber) FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity::DOUBLE), 4) AS SUM_l_quantity, round(avg(l_discount), 4) AS AVG_l_discount, round(sum(l_linenumber::DOUBLE), 4) AS SUM_l_linenumber FROM lineitem GROUP BY l_returnflag", rounded(SUM_l_quantity=4, AVG_l_discount=4, SUM_l_linenumber=4))
dialect("group_min_max", ("orders",), "SELECT o_orderpriority, MIN(o_orderdate), MAX(o_orderdate), MIN(o_orderstatus), MAX(o_totalprice) FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, min(o_orderdate::DATE) AS MIN_o_orderdate, max(o_orderdate::DATE) AS MAX_o_orderdate, min(o_orderstatus) AS MIN_o_orderstatus, max(o_totalprice) AS MAX_o_totalprice FROM orders GROUP BY o_orderpriority")
dialect("group_filter", ("orders",), "SELECT o_orderstatus, COUNT(*) FROM orders WHERE o_totalprice > 100000.0 GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*)::INT AS COUNT_all FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
dialect("group_order_limit", ("orders",), "SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey ORDER BY o_custkey DESC LIMIT 20", "SELECT o_custkey, count(*)::INT AS COUNT_all FROM orders GROUP BY o_custkey ORDER BY o_custkey DESC LIMIT 20")
dialect("order_asc", ("customer",), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC LIMIT 50", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50")
dialect("order_desc", ("orders",), "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC LIMIT 40", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 40")
dialect("order_limit", ("customer",), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000 ORDER BY c_acctbal DESC LIMIT 10", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 10")


@query('SELECT x.n_nationkey AS "x.n_nationkey", x.n_name AS "x.n_name", x.n_regionkey AS "x.n_regionkey", y.n_nationkey AS "y.n_nationkey", y.n_name AS "y.n_name", y.n_regionkey AS "y.n_regionkey" FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey')
def join_collision_names(spark, d):
    db = Session(spark, shared_folder(spark) + "/skein-none")
    for n in ("x", "y"):
        db.register(n, table(spark, d, "nation"), "n_nationkey")
    return db.execute("SELECT * FROM x JOIN y ON x.n_regionkey = y.n_regionkey").df


@query("SELECT l_returnflag, round(fsum(l_extendedprice), 6) AS total FROM lineitem GROUP BY l_returnflag")
def compensated_sum(spark, d):
    return relational.compensated_sums(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice").withColumn("total", F.round("total", 6))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 4500 AND o_orderkey < 8000")
def range_fragment_prune(spark, d):
    orders = table(spark, d, "orders").withColumn("fragment", fragments.owner_column(FRAGMENTS, F.col("o_orderkey")))
    kept = fragments.prune(orders, "fragment", fragments.touched(FRAGMENTS, "between", 4500, 7999))
    return kept.filter("o_orderkey between 4500 and 7999").select("o_orderkey", "o_totalprice")


@query("SELECT CASE WHEN o_orderkey < 4000 THEN 'p0' WHEN o_orderkey < 9000 THEN 'p1' ELSE 'p2' END AS fragment, count(*) AS n FROM orders GROUP BY 1")
def fragment_owner(spark, d):
    return table(spark, d, "orders").groupBy(fragments.owner_column(FRAGMENTS, F.col("o_orderkey")).alias("fragment")).agg(F.count("*").alias("n"))


# --- spatial

_HAV = "2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h))"


def _spatial_sql(select: str, source: str, key: str, point=LIMA, tail: str = "") -> str:
    lat, lon = LAT.format(k=key), LON.format(k=key)
    return f"""SELECT {select} FROM (SELECT *, {_HAV} AS dist, sqrt((lon - {point[1]}) ^ 2 + (lat - {point[0]}) ^ 2) AS flat FROM
        (SELECT *, sin(radians({point[0]} - lat) / 2) ^ 2 + cos(radians(lat)) * cos(radians({point[0]})) * sin(radians({point[1]} - lon) / 2) ^ 2 AS h
         FROM (SELECT *, {lat}::DOUBLE AS lat, {lon}::DOUBLE AS lon FROM {source}))) {tail}"""


dialect("radius_haversine", ("customer",), "SELECT c_custkey FROM customer WHERE DISTANCIA(place, POINT(-12.05, -77.04)) <= 2500000.5", _spatial_sql("c_custkey", "customer", "c_custkey", tail="WHERE dist <= 2500000.5"))
dialect("radius_euclidean", ("customer",), "SELECT c_custkey FROM customer WHERE DISTANCIA(place, POINT(-12.05, -77.04), EUCLIDEAN) < 20.003", _spatial_sql("c_custkey", "customer", "c_custkey", tail="WHERE flat < 20.003"))
dialect("order_distance_desc", ("supplier",), "SELECT s_suppkey FROM supplier ORDER BY DISTANCIA(place, POINT(-12.05, -77.04)) DESC LIMIT 30", _spatial_sql("s_suppkey", "supplier", "s_suppkey", tail="ORDER BY dist DESC, s_suppkey LIMIT 30"))


def _placed(spark, d, name, key):
    return table(spark, d, name).withColumns({"lat": F.expr(LAT.format(k=key)).cast("double"), "lon": F.expr(LON.format(k=key)).cast("double")})


@query(_spatial_sql("s_suppkey, round(dist, 3) AS distance", "supplier", "s_suppkey", tail="ORDER BY dist, s_suppkey LIMIT 10"))
def knn_spatial(spark, d):
    return spatial.nearest(_placed(spark, d, "supplier", "s_suppkey"), "lat", "lon", LIMA, 10, tie="s_suppkey").select("s_suppkey", F.round("distance", 3).alias("distance"))


@query(_spatial_sql("c_custkey", "customer", "c_custkey", tail="WHERE lat BETWEEN -20 AND 15 AND lon BETWEEN -80 AND 40"))
def box_window(spark, d):
    return spatial.search_box(_placed(spark, d, "customer", "c_custkey"), "lat", "lon", (-20, 15, -80, 40)).select("c_custkey")


def _polygon_sql() -> str:
    parts = []
    for (y1, x1), (y2, x2) in zip(RING, [*RING[1:], RING[0]], strict=True):
        parts.append(f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < {(x2 - x1) / (y2 - y1)!r} * (lat - ({y1})) + ({x1}) THEN 1 ELSE 0 END")
    return _spatial_sql("c_custkey", "customer", "c_custkey", tail=f"WHERE ({' + '.join(parts)}) % 2 = 1")


dialect("polygon_inside", ("customer",), f"SELECT c_custkey FROM customer WHERE DENTRO(place, POLYGON({', '.join(f'POINT({a}, {b})' for a, b in RING)}))", _polygon_sql())

# --- full text, with the tokenizer that SQL has too

_QUERY = "the that hean tion the"
_TEXT = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
    p AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM t) GROUP BY 1, 2),
    df AS (SELECT w, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM t),
    q AS (SELECT w, count(*) AS qtf FROM (SELECT unnest(string_split('{q}', ' ')) AS w) GROUP BY 1)"""
_BM25 = f"""{_TEXT}, s AS (SELECT p.doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avgdl))) AS score
    FROM p JOIN q USING (w) JOIN df USING (w) JOIN t USING (doc_id), n GROUP BY 1)"""
_TFIDF = f"""{_TEXT}, v AS (SELECT doc_id, w, (1 + log10(tf)) * log10(n::DOUBLE / df) AS x FROM p JOIN df USING (w), n), qv AS (SELECT w, (1 + log10(qtf)) * log10(n::DOUBLE / df) AS y FROM q JOIN df USING (w), n),
    s AS (SELECT doc_id, dot / (norm * (SELECT sqrt(sum(y * y)) FROM qv)) AS score FROM (SELECT doc_id, sum(x * y) AS dot FROM v JOIN qv USING (w) GROUP BY 1) JOIN (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1) USING (doc_id) WHERE dot > 0)"""
for _name, _ranking, _cte in (("tfidf_topk", "TF_IDF", _TFIDF), ("bm25_topk", "BM25", _BM25)):
    dialect(_name, ("documents",), f"SELECT doc_id, SCORE() FROM documents WHERE MATCH(text, '{_QUERY}') USING {_ranking} LIMIT 10", f"{_cte.format(q=_QUERY)} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 10", rounded(score=6))
dialect("match_all", ("documents",), "SELECT doc_id, SCORE() AS points FROM documents WHERE MATCH(text, 'thtion hean')", f"{_BM25.format(q='thtion hean')} SELECT doc_id, round(score, 6) AS points FROM s", rounded(points=6))
dialect("match_order_by", ("documents",), "SELECT doc_id FROM documents WHERE MATCH(text, 'thtion hean') ORDER BY doc_id DESC LIMIT 15", f"{_BM25.format(q='thtion hean')} SELECT doc_id FROM s ORDER BY doc_id DESC LIMIT 15")
dialect("match_score_asc", ("documents",), "SELECT doc_id, SCORE() FROM documents WHERE MATCH(text, 'thtion hean') ORDER BY SCORE() ASC LIMIT 5", f"{_BM25.format(q='thtion hean')} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score, doc_id DESC LIMIT 5", rounded(score=6))
dialect("match_group_by", ("documents",), "SELECT lang, COUNT(*) FROM documents WHERE MATCH(text, 'thtion hean') GROUP BY lang", f"{_BM25.format(q='thtion hean')} SELECT lang, count(*)::INT AS COUNT_all FROM s JOIN documents USING (doc_id) GROUP BY lang")


_INDEXES: dict[tuple, text_search.TextIndex] = {}


def _index(spark, d, options=None):
    """The stored index of documents, built again when the table has changed."""
    path = f"{d}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, options, fingerprint(spark, path))
    if key not in _INDEXES:
        _INDEXES[key] = text_search.build_index(table(spark, d, "documents"), "doc_id", "text", options, folder=f"{shared_folder(spark)}/skein-text-index-{uuid.uuid4().hex}")
    return _INDEXES[key]


@query(f"{_TEXT.format(q='')} SELECT doc_id, len(ws)::INT AS length FROM t")
def doc_stats(spark, d):
    return _index(spark, d).documents.select(F.col("rid").alias("doc_id"), "length")


@query(f"{_TEXT.format(q='')} SELECT w AS term, df FROM df")
def term_df(spark, d):
    return _index(spark, d).terms


@query(f"{_TEXT.format(q='')} SELECT doc_id, round(sqrt(sum(((1 + log10(tf)) * log10(n::DOUBLE / df)) ^ 2)), 6) AS norm FROM p JOIN df USING (w), n GROUP BY 1")
def doc_norms(spark, d):
    return _index(spark, d).norms().select(F.col("rid").alias("doc_id"), F.round("norm", 6).alias("norm"))


@query()
def match_stemmed(spark, d):
    """The whole analyzer (stopwords, stems) in one Arrow UDF; no SQL says the same."""
    index = _index(spark, d, TextOptions())
    return text_search.rank(text_search.bm25(index, "ciones mentes"), 20)


# --- vectors

_VEC = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_SCORES = {"cosine": ("list_cosine_similarity", "DESC"), "euclidean": ("list_distance", "ASC"), "dot": ("list_inner_product", "DESC")}


def _target(spark, d) -> list[float]:
    return table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


def _knn_sql(metric: str, k: int = 10) -> str:
    f, way = _SCORES[metric]
    s = f"{f}(embedding::DOUBLE[], {_VEC}::DOUBLE[])"
    return f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {s} AS s FROM embeddings) ORDER BY s {way}, vec_id LIMIT {k}"


def _knn(metric: str):
    def run(spark, d):
        return vector_search.nearest(table(spark, d, "embeddings"), "embedding", _target(spark, d), 10, metric, "vec_id").select("vec_id", F.round("score", 6).alias("score"))

    return run


for _m in _SCORES:
    QUERIES[f"knn_{_m}"], ORACLE_SQL[f"knn_{_m}"] = _knn(_m), _knn_sql(_m)


def _knn_all_sql(metric: str, k: int = 10) -> str:
    f, way = _SCORES[metric]
    s = f"{f}(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
    return f"SELECT '{metric}' AS metric, a.vec_id AS target, b.vec_id, round({s}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {s} {way}, b.vec_id) <= {k}"


@query(" UNION ALL ".join(f"SELECT * FROM ({_knn_all_sql(m)})" for m in _SCORES))
def knn_all(spark, d):
    """The neighbours of every vec_id divisible by 100 among all rows, by each metric."""
    e = table(spark, d, "embeddings")
    found = [vector_search.nearest_all(e, "embedding", e.filter("vec_id % 100 = 0"), 10, m, "vec_id").select(F.lit(m).alias("metric"), "target", "vec_id", F.round("score", 6).alias("score")) for m in _SCORES]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(_knn_sql("cosine", 7).replace("AS score", "AS nearness"))
def similarity_score(spark, d):
    v = ", ".join(f"{x:.12f}" for x in _target(spark, d))
    out = _session(spark, d, "embeddings").execute(f"SELECT vec_id, SIMILARITY_SCORE() AS nearness FROM embeddings WHERE SIMILAR_TO(embedding, VECTOR({v}), k=7) USING IVF").df
    return out.withColumn("nearness", F.round("nearness", 6))


@query(f"SELECT * FROM ({_knn_sql('euclidean', 20)}) ORDER BY vec_id LIMIT 5")
def similar_order_limit(spark, d):
    """Neighbours first, then order and limit."""
    return vector_search.nearest(table(spark, d, "embeddings"), "embedding", _target(spark, d), 20, "euclidean", "vec_id").select("vec_id", F.round("score", 6).alias("score")).orderBy("vec_id").limit(5)


@query(_knn_sql("cosine"))
def ivf_full_probe(spark, d):
    ivf = vector_search.build_ivf(table(spark, d, "embeddings"), "embedding", "vec_id")
    return ivf.search(_target(spark, d), 10, "cosine", len(ivf.centroids), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query()
def ivf_probe(spark, d):
    """The neighbours of every target: four lists first, of the others what a bound does not exclude."""
    ivf = vector_search.build_ivf(table(spark, d, "embeddings"), "embedding", "vec_id")
    e = table(spark, d, "embeddings")
    return vector_search.nearest_all(e, "embedding", e.filter("vec_id % 100 = 0"), 10, "cosine", "vec_id", ivf, 4).select("target", "vec_id", F.round("score", 6).alias("score"))


@query("""SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot,
    round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_metrics(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    fs = {"euclidean": metrics.euclidean_distance, "dot": metrics.dot_product, "cosine": metrics.cosine_similarity}
    return a.join(b, "vec_id").select("vec_id", *(F.round(f(F.col("x"), F.col("y")), 6).alias(n) for n, f in fs.items()))


# --- fusion and evaluation

_RANKS = f"""{_BM25.format(q='thtion hean')}, tr AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 30),
    vr AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_VEC}::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 30)"""


def _rankings(spark, d) -> tuple[DataFrame, DataFrame]:
    text = text_search.rank(text_search.bm25(_index(spark, d), "thtion hean"), 30).withColumnRenamed("rid", "id")
    near = vector_search.nearest(table(spark, d, "embeddings"), "embedding", _target(spark, d), 30, "cosine", "vec_id").select(F.col("vec_id").alias("id"), "score")
    return fusion.ranked(text, "score", "id"), fusion.ranked(near, "score", "id")


@query(f"{_RANKS} SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(rank)::INT AS best_rank FROM (SELECT * FROM tr UNION ALL SELECT * FROM vr) GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + rank)) DESC, min(rank), id LIMIT 20")
def rrf_hybrid(spark, d):
    fused = fusion.reciprocal_rank_fusion(list(_rankings(spark, d)), "id")
    return fused.orderBy(F.desc("rrf"), "best_rank", "id").limit(20).withColumn("rrf", F.round("rrf", 9))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def per_group_cap(spark, d):
    return fusion.cap_per_group(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def collapse_documents(spark, d):
    return fusion.collapse(table(spark, d, "orders"), "o_custkey", "o_totalprice")


_PROBES = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, max(vec_id) OVER (PARTITION BY label) AS last, dense_rank() OVER (ORDER BY label) AS place FROM embeddings),
    r AS (SELECT *, CASE WHEN place <= greatest(1, floor(0.3 * (SELECT max(place) FROM e))) THEN 'intruder' WHEN vec_id = last THEN 'query' ELSE 'base' END AS role FROM e),
    x AS (SELECT pr.vec_id, pr.label, pr.role, b.label AS found, b.vec_id AS base, 1 - list_cosine_similarity(pr.v, b.v) AS d FROM r pr, r b WHERE pr.role <> 'base' AND b.role = 'base'),
    n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, base) = 1)"""


def _probes(spark, d) -> DataFrame:
    """Labels as identities: of every query and every intruder photo, the nearest vector of the base."""
    photos = fusion.split_identities(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id")
    base, probes = photos.filter("role = 'base'"), photos.filter("role <> 'base'")
    near = vector_search.nearest_all(base, "embedding", probes, 1, "cosine", "vec_id").select(F.col("vec_id").alias("base"), "target", (1 - F.col("score")).alias("d"))
    found = near.join(base.select(F.col("vec_id").alias("base"), F.col("label").alias("found")), "base").withColumnRenamed("target", "vec_id")
    return probes.select("vec_id", "label", "role").join(found, "vec_id").drop("base")


@query(f"{_PROBES} SELECT vec_id, CASE WHEN d <= 0.55 THEN found END AS identified, round(CASE WHEN d <= 0.55 THEN least(1, greatest(0, (0.55 - d) / 0.55)) ELSE 0 END, 6) AS confidence FROM n")
def threshold_identify(spark, d):
    out = fusion.identify(_probes(spark, d), "d", "found")
    return out.select("vec_id", "identified", F.round("confidence", 6).alias("confidence"))


_STEPS = [round(0.05 * i + 0.0025, 4) for i in range(1, 20)]


@query(f"""{_PROBES}, th AS (SELECT unnest([{', '.join(map(str, _STEPS))}])::DOUBLE AS threshold)
    SELECT threshold, round(coalesce(sum((d <= threshold AND found = label AND role = 'query')::INT) / nullif(sum((role = 'query')::INT), 0), 0), 6) AS "precision",
    round(coalesce(sum((d <= threshold AND role = 'intruder')::INT) / nullif(sum((role = 'intruder')::INT), 0), 0), 6) AS false_positive_rate FROM n, th GROUP BY threshold""")
def threshold_sweep(spark, d):
    probes = _probes(spark, d).select(F.col("d").alias("distance"), (F.col("found") == F.col("label")).alias("same"), (F.col("role") == "intruder").alias("intruder"))
    out = fusion.sweep_thresholds(probes, _STEPS)
    return out.select("threshold", F.round("precision", 6).alias("precision"), F.round("false_positive_rate", 6).alias("false_positive_rate"))


_RELEVANT = f"""{_BM25.format(q='thtion hean')}, r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM s JOIN documents USING (doc_id) QUALIFY rank <= 10),
    rel AS (SELECT DISTINCT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"""


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    scored = text_search.bm25(_index(spark, d), "thtion hean").withColumnRenamed("rid", "doc_id").join(docs, "doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))
    results = scored.withColumn("rank", rank).filter("rank <= 10").select(F.col("lang").alias("query"), F.col("doc_id").alias("item"), "rank")
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()
    return results, docs.join(good, "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("item")).distinct()


@query(f"{_RELEVANT} SELECT rel.lang AS query, round(count(r.doc_id) / 10.0::DOUBLE, 6) AS \"precision\", round(count(r.doc_id)::DOUBLE / count(*), 6) AS recall FROM rel LEFT JOIN r USING (lang, doc_id) GROUP BY rel.lang")
def precision_recall_at_k(spark, d):
    out = evaluation.precision_recall(*_judged(spark, d), 10)
    return out.select("query", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"{_RELEVANT} SELECT rel.lang AS query, min(r.rank)::INT AS first_rank, round(coalesce(1.0::DOUBLE / min(r.rank), 0), 6) AS reciprocal FROM rel LEFT JOIN r USING (lang, doc_id) GROUP BY rel.lang")
def mrr(spark, d):
    return evaluation.reciprocal_ranks(*_judged(spark, d)).withColumn("reciprocal", F.round("reciprocal", 6))


@query(f"SELECT 0 AS query, count(b.vec_id)::DOUBLE / count(*) AS recall FROM ({_knn_sql('cosine')}) a LEFT JOIN ({_knn_sql('euclidean')}) b USING (vec_id)")
def metric_agreement(spark, d):
    lists = [QUERIES[f"knn_{m}"](spark, d).select(F.lit(0).alias("query"), F.col("vec_id").alias("item")) for m in ("cosine", "euclidean")]
    return evaluation.neighbour_recall(*lists)


@query("SELECT max(c_custkey) + 1 AS next_id, count(*) FILTER (WHERE starts_with(lower(c_name), 'customer#00000000')) AS alike FROM customer")
def registry_lookup(spark, d):
    return table(spark, d, "customer").agg((F.max("c_custkey") + 1).alias("next_id"), F.count_if(F.lower("c_name").startswith("customer#00000000")).alias("alike"))


@query("SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey BETWEEN 3 AND 15 AND n_name LIKE '%A%' GROUP BY n_name")
def library_listing(spark, d):
    n = table(spark, d, "nation").filter(F.col("n_nationkey").between(3, 15) & F.col("n_name").contains("A"))
    return n.join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query()
def chunker(spark, d):
    return fusion.chunks(table(spark, d, "documents"), "doc_id", "text")
