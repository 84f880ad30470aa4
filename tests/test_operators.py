import io
import math
import random
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from skein.functions import geo, media, metrics
from skein.operators import evaluation, fragments, fusion, relational, spatial, vector_search
from skein.sources.media_load import load_media

CITIES = {"lima": (-12.0464, -77.0428), "arequipa": (-16.4090, -71.5375)}


def brute_haversine(a, b):
    (p, q), (r, s) = ([math.radians(x) for x in v] for v in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


def points(spark, ps):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ps)], "_rid long, lat double, lon double")


def test_radius_agrees_with_brute_force_near_poles_and_the_antimeridian(spark):
    rng = np.random.default_rng(1)
    ps = [(89.9, 10), (-89.5, 0), (0, 179.9), (0, -179.9), (10, 180), (0, 0)] + list(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300), strict=True))
    df = points(spark, ps)
    for centre in ((89, 0), (0, 179.5), (0.0, 0.0), (-45.5, -170.1)):
        for r in (0.0, 50_000, 3e6, 2.1e7):
            got = {x._rid for x in spatial.search_radius(df, "lat", "lon", centre, r).collect()}
            assert got == {i for i, p in enumerate(ps) if brute_haversine(centre, p) <= r}
    assert [x._rid for x in spatial.nearest(df, "lat", "lon", (0, 0), 3).collect()] == sorted(range(len(ps)), key=lambda i: (brute_haversine((0, 0), ps[i]), i))[:3]


def test_polygon_border_is_inside(spark):
    shape = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    ps = {(1, 1): True, (0, 2): True, (4, 4): True, (3, 1): False, (3, 2): True, (2, 1): True, (5, 3): False, (3, 3): True, (-1, 0): False}
    for ring in (shape, shape[::-1]):
        got = {(int(r.lat), int(r.lon)) for r in spatial.search_polygon(points(spark, list(ps)), "lat", "lon", ring).collect()}
        assert got == {p for p, inside in ps.items() if inside}
    with pytest.raises(ValueError):
        geo.in_polygon(None, None, [(0, 0), (1, 1), (0, 0)])


def test_vectors_and_ivf(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(60, [0.0] * 4)]
    df = spark.createDataFrame(rows, "_rid long, v array<float>")
    ivf = vector_search.build_ivf(df, "v", nlist=5)
    q = [0.3, -1.0, 0.2, 0.5]
    for metric in ("cosine", "euclidean", "dot"):
        exact = [(r._rid, round(r.score, 9)) for r in vector_search.nearest(df, "v", q, 7, metric).collect()]
        assert [(r._rid, round(r.score, 9)) for r in ivf.search(q, 7, metric, nprobe=5).collect()] == exact
        def near(v, metric=metric):
            a, b = np.array(v, np.float32).astype(float), np.array(q)
            return {"euclidean": np.linalg.norm(a - b), "dot": -(a @ b), "cosine": 1 - (a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if a.any() else 0)}[metric]
        assert [i for i, _ in exact] == sorted(range(61), key=lambda i: (near(rows[i][1]), i))[:7]
    assert vector_search.nearest(df, "v", q, 0).count() == 0


def test_fragments():
    parts = fragments.from_bounds([("a", 10, "n1"), ("b", 20, "n2"), ("c", None, "n3")])
    for key in (-5, 9, 10, 19, 20, 99):
        mine = fragments.owner(parts, key)
        for op, keep in (("=", lambda k, x: k == x), ("<", lambda k, x: k < x), ("<=", lambda k, x: k <= x), (">", lambda k, x: k > x), (">=", lambda k, x: k >= x)):
            reach = {fragments.owner(parts, k).name for k in range(-30, 130) if keep(k, key)}
            assert reach <= {f.name for f in fragments.touched(parts, op, key)}, (op, key)
        assert mine.holds(key) and [f.name for f in fragments.touched(parts, "=", key)] == [mine.name]
    assert [f.name for f in fragments.touched(parts, "between", 12, 25)] == ["b", "c"]
    with pytest.raises(ValueError):
        fragments.from_bounds([("a", 10, ""), ("b", 5, "")])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["uno", "dos.", "tres", "fin!"]), max_size=900))
def test_chunks_cover_every_word_in_order(words):
    text = " ".join(words)
    got = fusion.chunk_text(text)
    assert got == fusion.chunk_text(text)
    covered = 0
    for c in got:
        n = len(c.split())
        assert n <= 500 and len(c.encode()) <= 4000
    covered = sum(len(c.split()) for c in got)
    assert (covered >= len(words)) and (not got or (text.startswith(got[0]) and text.endswith(got[-1])))


def test_compensated_sum(spark):
    df = spark.createDataFrame([("k", 1e16)] + [("k", 1.0)] * 10_000 + [("k", -1e16)], "k string, v double").repartition(4)
    assert relational.compensated_sums(df, "k", "v").collect()[0].total == 10_000.0


def test_grouped_sums_equal_fsum_in_any_order(spark):
    rng = random.Random(3)
    groups = {"near": [rng.uniform(900, 100_000) for _ in range(3000)], "wide": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-200, 200) for _ in range(2000)], "cancel": [1e100, 1.5, -1e100, 2.0**-40], "edges": [2.0**k for k in range(-64, 65, 8)] + [0.0, -0.0, None], "tiny": [5e-324, 2.0**-1000], "none": [None, None], "ten": [0.1] * 10}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, ("inf", float("inf")), ("inf", 1.0), ("nan", float("nan")), ("nan", 2.0), (None, 1.5)], "k string, v double")
    items = [("s", "SUM", F.col("v")), ("a", "AVG", F.col("v")), ("n", "COUNT", None), ("m", "MIN", F.col("v"))]
    for parts in (1, 7):
        got = {r["_key"]: r for r in relational.grouped(df.repartition(parts), F.col("k"), items).collect()}
        for k, vs in groups.items():
            held = [v for v in vs if v is not None]
            assert got[k]["n"] == len(vs) and got[k]["s"] == (math.fsum(held) if held else None), k
            assert got[k]["a"] == (math.fsum(held) / len(held) if held else None) and got[k]["m"] == (min(held) if held else None)
        assert got["inf"]["s"] == float("inf") and math.isnan(got["nan"]["s"]) and got[None]["s"] == 1.5 and len(got) == len(groups) + 3


def test_evaluation_and_permutation(spark):
    res = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "query string, item int, rank int")
    rel = spark.createDataFrame([("q", 2), ("q", 9), ("z", 1)], "query string, item int")
    assert {r.query: (r.precision, r.recall) for r in evaluation.precision_recall(res, rel, 2).collect()} == {"q": (0.5, 0.5), "z": (0.0, 0.0)}
    assert {r.query: r.reciprocal for r in evaluation.reciprocal_ranks(res, rel).collect()} == {"q": 0.5, "z": 0.0}
    assert evaluation.permutation_test([0.0] * 5) == 1.0 and evaluation.permutation_test([1.0] * 30) < 0.01


def test_identities_and_thresholds(spark):
    photos = spark.createDataFrame([(i // 3, i) for i in range(30)], "who int, photo int")
    got = fusion.split_identities(photos, "who", "photo").groupBy("role").count().collect()
    assert {r.role: r["count"] for r in got} == {"intruder": 9, "query": 7, "base": 14}
    probes = spark.createDataFrame([(0.1, True, False), (0.5, True, False), (0.3, False, True)], "distance double, same boolean, intruder boolean")
    sweep = fusion.sweep_thresholds(probes, [0.05, 0.2, 0.25, 0.4, 0.6])
    assert fusion.best_threshold(sweep) == 0.2


def wav(seconds=0.5, rate=16_000):
    t = np.arange(int(seconds * rate)) / rate
    x = (np.sin(2 * np.pi * (200 + 300 * t) * t) * 20_000).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(x.tobytes())
    return out.getvalue()


def test_audio_features(spark, tmp_path):
    x, rate = media.read_wav(wav())
    d = media.mfcc(x, rate)
    assert d.shape == (48, 13) and np.isfinite(d).all() and media.mfcc(x[:10], rate).shape == (0, 13)
    assert (media.kmeans(d, 4) == media.kmeans(d, 4)).all()
    v = media.build_vocabulary([d, d[:20] + 1, np.zeros((0, 13))], 4)
    v.save(str(tmp_path / "v.npz"))
    assert media.Vocabulary.load(str(tmp_path / "v.npz")).fingerprint == v.fingerprint
    assert not v.histogram(np.zeros((0, 13))).any()
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.wav").write_bytes(wav())
    (tmp_path / "m/b.wav").write_bytes(b"broken")
    good, bad = load_media(spark, str(tmp_path / "m"), v)
    row = good.collect()[0]
    assert row.nombre == "a.wav" and len(row.rasgos) == 4 and bad.count() == 1


def test_neighbours_of_many_targets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vs = rng.normal(size=(400, 6)) + 6 * rng.integers(0, 3, (400, 1))
    vs[100:140] = vs[7]  # ties
    vs[200] = 0
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(vs)), (400, None)], "_rid long, v array<double>").repartition(5)
    monkeypatch.setattr(vector_search, "TARGETS", 3)
    ids = [0, 7, 110, 200, 399]
    ivf = vector_search.build_ivf(df.filter("v is not null"), "v", nlist=5)
    for metric in metrics.METRICS:
        want = {i: [(r._rid, round(r.score, 9)) for r in vector_search.nearest(df.filter("v is not null"), "v", vs[i].tolist(), 12, metric).collect()] for i in ids}
        for index in (None, ivf):
            got = vector_search.nearest_all(df, "v", df.filter(df._rid.isin(ids)), 12, metric, ivf=index).orderBy("target", "rank").collect()
            assert {i: [(r._rid, round(r.score, 9)) for r in got if r.target == i] for i in ids} == want
    assert vector_search.nearest_all(df, "v", df.filter("false"), 3).count() == 0
