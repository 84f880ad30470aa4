import pytest

from skein.functions.text import TextOptions, stem_english, stem_spanish, stopwords, tokenize
from skein.operators import text_search

PLAIN = TextOptions("spanish", stopwords=False, stem=False)


def test_stopword_lists_have_their_published_sizes():
    assert len(stopwords("spanish")) == 313
    assert len(stopwords("english")) == 127
    with pytest.raises(ValueError):
        stopwords("klingon")


@pytest.mark.parametrize("word, stem", [("amigas", "amig"), ("información", "inform"), ("haciéndola", "hac"), ("rápidamente", "rapid"), ("canciones", "cancion"), ("nacionalidades", "nacional"), ("corriendo", "corr"), ("biología", "biolog"), ("ejecución", "ejecu"), ("existencia", "existent"), ("contribuyendo", "contribu"), ("paguen", "pag"), ("y", "y")])
def test_spanish_stems(word, stem):
    assert stem_spanish(word) == stem


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"), ("generously", "generous"), ("skies", "sky"), ("dying", "die"), ("sing", "sing"), ("happiness", "happi"), ("controlling", "control"), ("indexes", "index"), ("agreed", "agre"), ("say", "say"), ("cry", "cri")])
def test_english_stems(word, stem):
    assert stem_english(word) == stem


@pytest.mark.parametrize("text, terms", [
    ("Hola, mundo! (base_de-datos)  2026;fin", ["hola", "mundo", "base", "de", "datos", "2026", "fin"]),
    ("La O.N.U. y la ONU", ["la", "onu", "y", "la", "onu"]),
    ("3.14", ["3", "14"]),
    ("café niño", ["cafe", "niño"]),
    ("x" * 65 + " y", ["y"]),
    (b"hola \xff\xfe mundo", ["hola", "mundo"]),
    ("", []), (None, []),
])
def test_tokens(text, terms):
    assert tokenize(text, PLAIN) == terms


def test_stopwords_are_compared_without_accents_and_digits_are_not_stemmed():
    assert tokenize("mas más the amigas a1s", TextOptions("spanish")) == ["the", "amig", "a1s"]


def _scores(df):
    return {r.rid: r.score for r in df.collect()}


def test_tfidf_golden(spark):
    docs = spark.createDataFrame([(1, "Cargamento de oro dañado por el fuego"), (2, "La entrega de la plata llegó en el camión color plata"), (3, "El cargamento de oro llegó en un camión")], "id long, t string")
    for log, want in ((False, {2: 0.756154506695, 3: 0.327184574214, 1: 0.080104517540}), (True, {2: 0.639862424655, 3: 0.327184574214, 1: 0.080104517540})):
        index = text_search.build_index(docs, "id", "t", TextOptions("spanish", stem=False), log_tf=log)
        got = _scores(text_search.tfidf(index, "oro plata camión"))
        assert got == pytest.approx(want, abs=1e-11)
    assert _scores(text_search.tfidf(index, "de la")) == {}


def test_a_term_of_every_document_weighs_nothing_in_tfidf(spark):
    docs = spark.createDataFrame([(1, "casa sol"), (2, "casa"), (3, "casa luna")], "id long, t string")
    index = text_search.build_index(docs, "id", "t", PLAIN)
    assert _scores(text_search.tfidf(index, "casa")) == {}
    assert _scores(text_search.tfidf(index, "casa sol")) == pytest.approx({1: 1.0})
    assert len(_scores(text_search.bm25(index, "casa"))) == 3


def test_bm25_golden(spark):
    docs = spark.createDataFrame([(1, "gato"), (2, "gato" + " perro" * 9), (3, "perro"), (4, "pez")], "id long, t string")
    index = text_search.build_index(docs, "id", "t", PLAIN)
    assert _scores(text_search.bm25(index, "gato")) == pytest.approx({1: 0.967024847025, 2: 0.374744978526}, abs=1e-11)
    assert _scores(text_search.bm25(index, "perro")) == pytest.approx({2: 1.137132468299, 3: 0.967024847025}, abs=1e-11)
    twice, once = _scores(text_search.bm25(index, "gato gato")), _scores(text_search.bm25(index, "gato"))
    assert twice == pytest.approx({k: 2 * v for k, v in once.items()})


def test_stored_index_ranks_like_the_computed_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, "oro plata camión oro"), (2, "plata"), (3, None), (4, ""), (5, "camión camión"), (6, "zinc")], "id long, t string")
    plain, stored = (text_search.build_index(docs, "id", "t", PLAIN, folder=f) for f in (None, f"file://{tmp_path}/index"))
    assert (plain.n_documents, plain.average_length) == (stored.n_documents, stored.average_length) == (6, 8 / 6)
    for run in (text_search.tfidf, text_search.bm25):
        a, b = ({r.rid: round(r.score, 9) for r in run(i, "oro camión").collect()} for i in (plain, stored))
        assert a == b and a
    assert {r.rid: round(r.norm, 9) for r in plain.norms().collect()} == {r.rid: round(r.norm, 9) for r in stored.norms().collect()}
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["documents", "postings", "terms"]
