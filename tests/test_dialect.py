import pytest

from skein.plans import ast
from skein.plans.binder import Column, Index, Schema, bind_create_table, bind_select
from skein.plans.errors import SQLLexError, SQLParseError, SQLSemanticError, SQLUnsupportedError
from skein.plans.parser import parse_sql, parse_sql_script

A = Schema("a", (Column("id", "INT"), Column("x", "DOUBLE"), Column("t", "VARCHAR", 10), Column("p", "POINT"), Column("v", "VECTOR", 2)), "id", indexes=(Index("f", "t", "FULLTEXT", language="spanish"),))
B = Schema("b", (Column("id", "INT"), Column("y", "INT"), Column("z", "DOUBLE")), "id")


def bound(sql):
    s = parse_sql(sql)
    return bind_select(s, (A, B) if s.join else (A,))


@pytest.mark.parametrize("word", "AS DISTINCT HAVING OFFSET UNION EXCEPT INTERSECT LIKE IN IS NOT OR".split())
def test_words_left_out_are_named(word):
    with pytest.raises(SQLUnsupportedError) as e:
        parse_sql(f"SELECT id FROM a WHERE id {word} 3" if word in ("LIKE", "IN", "IS", "NOT", "OR") else f"SELECT id FROM a {word} 3")
    assert word in str(e.value) and e.value.span.line == 1


@pytest.mark.parametrize("sql, error", [
    ("UPDATE a SET x = 1", SQLUnsupportedError), ("ROLLBACK", SQLUnsupportedError), ("SELECT id FROM a WHERE id <> 1", SQLUnsupportedError), ("SELECT id FROM a WHERE id != 1", SQLUnsupportedError),
    ("SELECT id FROM a WHERE id = 1 AND x = 2", SQLUnsupportedError), ("SELECT id FROM a WHERE id = x", SQLUnsupportedError), ("SELECT id FROM a WHERE id = NULL", SQLUnsupportedError),
    ("SELECT id FROM a WHERE DISTANCIA(p, POINT(0,0)) > 1", SQLUnsupportedError), ("SELECT COUNT(id) FROM a GROUP BY id", SQLUnsupportedError), ("SELECT id FROM a GROUP BY id, x", SQLUnsupportedError),
    ("SELECT id FROM", SQLParseError), ("SELECT FROM a", SQLParseError), ("SELECT id FROM a LIMIT -1", SQLParseError), ("SELECT id FROM a WHERE p = POINT(91, 0)", SQLParseError), ("INSERT INTO a VALUES (DATE '2024-02-30')", SQLParseError),
    ("SELECT 'open", SQLLexError), ("SELECT id /* open", SQLLexError), ("SELECT id FROM a WHERE id = 1e5", SQLLexError), ("SELECT @", SQLLexError),
])
def test_rejections(sql, error):
    with pytest.raises(error) as e:
        parse_sql(sql)
    assert type(e.value) is error and e.value.span is not None


@pytest.mark.parametrize("sql", [
    "SELECT nope FROM a", "SELECT c.id FROM a", "SELECT id FROM a WHERE id = 1.0", "SELECT id FROM a WHERE id = 3000000000", "SELECT id FROM a WHERE t = 3", "SELECT id FROM a JOIN b ON a.id = b.id",
    "SELECT x FROM a JOIN b ON a.id = z", "SELECT SUM(x) FROM a", "SELECT id FROM a GROUP BY id", "SELECT x, COUNT(*) FROM a GROUP BY id", "SELECT * FROM a GROUP BY id", "SELECT SUM(t) FROM a GROUP BY id",
    "SELECT SCORE() FROM a", "SELECT id FROM a WHERE MATCH(x, 'q')", "SELECT id FROM a WHERE SIMILAR_TO(VECTOR(1), 2) USING IVF", "SELECT id FROM a WHERE DENTRO(p, POLYGON(POINT(0,0), POINT(0,0), POINT(1,1)))", "SELECT id FROM a WHERE DISTANCIA(x, POINT(0,0)) < 1",
])
def test_semantic_errors(sql):
    with pytest.raises(SQLSemanticError):
        bound(sql)


@pytest.mark.parametrize("sql", ["SELECT a.id FROM a JOIN b ON a.id = b.id WHERE MATCH(t, 'q')", "SELECT t, COUNT(*) FROM a WHERE SIMILAR_TO(v, VECTOR(1,2), 3) USING HNSW GROUP BY t"])
def test_combinations_left_out(sql):
    with pytest.raises(SQLUnsupportedError):
        bound(sql)


def test_output_names():
    assert [n for n, _ in bound("SELECT * FROM a JOIN b ON a.id = b.id").items] == ["a.id", "x", "t", "p", "v", "b.id", "y", "z"]
    assert [n for n, _ in bound("SELECT t, COUNT(*), SUM(x), SUM(x) FROM a GROUP BY t").items] == ["t", "COUNT_all", "SUM_x", "SUM_x_2"]
    assert [n for n, _ in bound("SELECT *, SCORE() AS s FROM a WHERE MATCH(t, 'q')").items][-1] == "s"


def test_literals_comments_and_scripts():
    got = parse_sql_script("select id from a where t = 'it''s' -- note\n; /* x */ SELECT ID FROM a LIMIT 1267650600228229401496703205376;")
    assert got[0].where.low.value == "it's" and got[1].limit == 2**100
    assert parse_sql("SELECT id FROM a WHERE x >= -2.5").where.low == ast.Literal("double", -2.5, parse_sql("SELECT id FROM a WHERE x >= -2.5").where.low.span)


@pytest.mark.parametrize("sql", ["CREATE TABLE t (a INT)", "CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)", "CREATE TABLE t (a INT PRIMARY KEY, a INT)", "CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(0))", "CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(5000))", "CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(2100)) USING SEQUENTIAL"])
def test_tables_that_cannot_be(sql):
    with pytest.raises(SQLSemanticError):
        bind_create_table(parse_sql(sql))
