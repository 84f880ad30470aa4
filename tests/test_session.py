import datetime
import threading
import wave

import numpy as np
import pytest

from skein.functions import media
from skein.plans.errors import ExecutionError, SQLSemanticError, SQLUnsupportedError
from skein.session import Locks, Session
from skein.sources import csv_load


@pytest.fixture()
def db(spark, tmp_path):
    return Session(spark, str(tmp_path / "db"))


def fill(db, table, rows):
    for r in rows:
        db.execute(f"INSERT INTO {table} VALUES ({r})")


def test_groups_and_order(db):
    db.execute("CREATE TABLE ventas (id INT PRIMARY KEY, region VARCHAR(8), unidades INT, monto DOUBLE, fecha DATE)")
    fill(db, "ventas", ["1, 'norte', 2, 10.0, DATE '2024-01-01'", "2, 'sur', 4, 10, DATE '2024-02-01'", "3, 'norte', 3, 20.0, DATE '2024-01-03'", "4, 'este', 7, 5.0, DATE '2024-03-01'"])
    got = db.execute("SELECT region, AVG(monto), COUNT(*), SUM(unidades), MAX(fecha) FROM ventas GROUP BY region ORDER BY region")
    assert got.columns == ["region", "AVG_monto", "COUNT_all", "SUM_unidades", "MAX_fecha"]
    assert got.rows == [("este", 5.0, 1, 7.0, datetime.date(2024, 3, 1)), ("norte", 15.0, 2, 5.0, datetime.date(2024, 1, 3)), ("sur", 10.0, 1, 4.0, datetime.date(2024, 2, 1))]
    assert db.execute("SELECT id FROM ventas ORDER BY monto DESC LIMIT 3").rows == [(3,), (1,), (2,)]
    assert db.table_info("ventas")["record_count"] == 4 and [t["table"] for t in db.list_tables()] == ["ventas"]


def test_keys_deletes_updates_and_reopening(db, spark):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(4)) USING SEQUENTIAL")
    fill(db, "t", ["2, 'b'", "1, 'a'", "3, 'c'"])
    with pytest.raises(ExecutionError):
        db.execute("INSERT INTO t VALUES (2, 'x')")
    with pytest.raises(SQLSemanticError):
        db.execute("INSERT INTO t VALUES (9, 'ñññ')")
    assert db.execute("DELETE FROM t WHERE id BETWEEN 1 AND 2").affected_rows == 2
    assert db.execute("DELETE FROM t WHERE id = 77").affected_rows == 0
    assert db.update("t", 3, (3, "z")) == 1
    again = Session(spark, db.tables.store.root)
    assert again.execute("SELECT * FROM t").rows == [(3, "z")]
    again.execute("DROP TABLE t")
    with pytest.raises(SQLSemanticError):
        again.execute("SELECT * FROM t")


def test_transactions(db):
    db.execute("CREATE TABLE c (id INT PRIMARY KEY, v INT)")
    assert db.execute("BEGIN TRANSACTION; INSERT INTO c VALUES (1, 1); INSERT INTO c VALUES (2, 2); END TRANSACTION").affected_rows == 2
    db.execute("BEGIN TRANSACTION; DELETE FROM c WHERE id = 1")
    db.rollback()
    assert db.execute("SELECT * FROM c ORDER BY id").rows == [(1, 1), (2, 2)]
    with pytest.raises(ExecutionError):
        db.execute("BEGIN TRANSACTION; INSERT INTO c VALUES (3, 3); INSERT INTO c VALUES (1, 9)")
    assert not db.in_transaction and len(db.execute("SELECT * FROM c").rows) == 2
    with pytest.raises(SQLUnsupportedError):
        db.execute("BEGIN TRANSACTION; DROP TABLE c")


def test_locks():
    locks, me, you = Locks(0.05), object(), object()
    locks.acquire(me, "t", "shared")
    locks.acquire(you, "t", "shared")
    with pytest.raises(ExecutionError):
        locks.acquire(me, "t", "exclusive")
    locks.release(you)
    locks.acquire(me, "t", "exclusive")
    locks.acquire(me, "t", "shared")
    done = []
    slow = Locks(2)
    slow.acquire(me, "t", "exclusive")
    t = threading.Thread(target=lambda: (slow.acquire(you, "t", "shared"), done.append(1)))
    t.start()
    slow.release(me)
    t.join(3)
    assert done == [1]


def test_text_and_index_rules(db):
    db.execute("CREATE TABLE arts (id INT PRIMARY KEY, texto VARCHAR(160), v VECTOR(2), p POINT)")
    fill(db, "arts", ["1, 'base de datos vectorial', VECTOR(1, 0), POINT(0, 0)", "2, 'datos', VECTOR(0, 1), POINT(10, 10)", "3, 'nada que ver', VECTOR(-1, 0), POINT(0, 1)"])
    with pytest.raises(SQLSemanticError):
        db.execute("SELECT id FROM arts WHERE MATCH(texto, 'datos')")
    db.execute("CREATE INDEX f ON arts (texto) USING FULLTEXT; CREATE INDEX r ON arts (p) USING RTREE; CREATE INDEX h ON arts (v) USING HNSW WITH METRIC=euclidean; CREATE INDEX i ON arts (v) USING IVF")
    assert [r[0] for r in db.execute("SELECT id, SCORE() FROM arts WHERE MATCH(texto, 'bases de datos') LIMIT 5").rows] == [1, 2]
    assert db.execute("SELECT id FROM arts WHERE MATCH(texto, 'de la')").rows == []
    db.execute("INSERT INTO arts VALUES (4, 'datos datos', VECTOR(1, 1), POINT(1, 1))")
    assert {r[0] for r in db.execute("SELECT id FROM arts WHERE MATCH(texto, 'datos')").rows} == {1, 2, 4}
    for bad in ("CREATE INDEX f2 ON arts (texto) USING FULLTEXT", "CREATE INDEX x ON arts (v) USING BPLUS", "CREATE INDEX x ON arts (id) USING RTREE"):
        with pytest.raises(SQLSemanticError):
            db.execute(bad)
    with pytest.raises(SQLSemanticError):
        db.execute("SELECT id FROM arts WHERE SIMILAR_TO(v, VECTOR(1, 0), 2) USING HNSW WITH METRIC=cosine")
    near = db.execute("SELECT id, SIMILARITY_SCORE() AS d FROM arts WHERE SIMILAR_TO(VECTOR(1, 0), 2) USING HNSW WITH METRIC=euclidean").rows
    assert near == [(1, 0.0), (4, 1.0)]
    assert db.execute("SELECT id FROM arts WHERE SIMILAR_TO(VECTOR(1, 0), 0) USING HNSW WITH METRIC=euclidean").rows == []
    assert [r[0] for r in db.execute("SELECT id FROM arts ORDER BY DISTANCIA(p, POINT(0, 0)) LIMIT 2").rows] == [1, 3]
    got = db.execute("SELECT id FROM arts WHERE DISTANCIA(p, POINT(0,0)) <= 112000 ORDER BY id")
    assert got.rows == [(1,), (3,)] and got.spatial_context["unit"] == "metres" and got.plan.find("radius_search").structure == "rtree"
    assert db.execute("EXPLAIN SELECT id FROM arts ORDER BY DISTANCIA(p, POINT(0,0)) LIMIT 1").plan.find("knn_search")
    assert db.execute("EXPLAIN ANALYZE SELECT id FROM arts WHERE id < 3").plan.records == 2


def test_csv(db, tmp_path):
    db.execute("CREATE TABLE n (id INT PRIMARY KEY, nombre VARCHAR(5), x DOUBLE, ok BOOL, d DATE)")
    f = tmp_path / "n.csv"
    f.write_text("ID;nombre;x;ok;d\n1;ana;1,5;true;2024-01-01\n2;;2;false;2024-01-02\nx;b;1;true;2024-01-01\n3;larguísimo;1;true;2024-01-01\n4;c;;true;2024-01-01\n1;dup;1;true;2024-01-01\n5;e;1;true;2024-02-30\n6;short\n", encoding="utf-8")
    got = db.load_csv("n", str(f), atomic=True)
    assert got.loaded == 0 and got.rejected == 6
    got = db.load_csv("n", str(f))
    assert (got.loaded, got.rejected) == (2, 6) and {e.split(":")[0] for e, _ in got.errors} == {"id", "nombre", "x", "d", "wrong number of fields"}
    assert db.execute("SELECT * FROM n ORDER BY id").rows == [(1, "ana", 1.5, True, datetime.date(2024, 1, 1)), (2, "", 2.0, False, datetime.date(2024, 1, 2))]
    assert db.load_csv("n", str(f)).loaded == 0
    db.execute("CREATE TABLE p (id INT PRIMARY KEY, p POINT)")
    (tmp_path / "p.csv").write_text("id,p\n1,2\n")
    with pytest.raises(ExecutionError):
        db.load_csv("p", str(tmp_path / "p.csv"))


def test_csv_encoding_is_of_all_bytes(db, tmp_path):
    db.execute("CREATE TABLE e (id INT PRIMARY KEY, s VARCHAR(80))")
    plain = "".join(f"{i},{'x' * 60}\n" for i in range(2000))
    f = tmp_path / "late.csv"
    f.write_bytes(("id,s\n" + plain + "2000,señal €\n").encode("cp1252"))
    assert db.load_csv("e", str(f)).loaded == 2001
    assert db.execute("SELECT s FROM e WHERE id = 2000").rows == [("señal €",)]
    folder = tmp_path / "a folder [1]"
    folder.mkdir()
    (folder / "u.csv").write_text("id,s\n3000,añoש\n", encoding="utf-8")
    (folder / "c {x}.csv").write_bytes("id,s\n3001,café\n".encode("cp1252"))
    assert db.load_csv("e", str(folder).replace("[", "\\[").replace("]", "\\]")).loaded == 2
    assert db.execute("SELECT s FROM e WHERE id >= 3000 ORDER BY id").rows == [("añoש",), ("café",)]
    for name, body, line in [("mixed", "id,s\n4000,ñu\n".encode() + b"4001,\xf1u\n", 3), ("late-mixed", ("id,s\n4002,ñu\n" + plain).encode() + b"4003,\xf1u\n", 2003), ("undefined", b"id,s\n4004,\x81\n", 2)]:
        (tmp_path / f"{name}.csv").write_bytes(body)
        with pytest.raises(ExecutionError, match=f"line {line}: a byte that is not UTF-8"):
            db.load_csv("e", str(tmp_path / f"{name}.csv"))
    assert len(db.execute("SELECT id FROM e").rows) == 2003


def test_partitioned_tables_are_checked(db):
    db.execute("CREATE TABLE items (id INT PRIMARY KEY, s VARCHAR(8)) PARTITION BY RANGE (id) (PARTITION a VALUES LESS THAN (10) ON n1, PARTITION b VALUES LESS THAN (MAXVALUE) ON n2)")
    with pytest.raises(SQLSemanticError):
        db.execute("CREATE TABLE j (id INT PRIMARY KEY) PARTITION BY RANGE (id) (PARTITION a VALUES LESS THAN (10) ON n1, PARTITION b VALUES LESS THAN (5) ON n2)")


def test_all_unreadable_media_are_counted(db, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_load, "REPORTED", 2)
    for i in range(5):
        (tmp_path / f"{i}.wav").write_bytes(b"no sound")
    db.execute("CREATE TABLE m (id INT PRIMARY KEY, nombre VARCHAR(40), ruta VARCHAR(400), rasgos VECTOR(4))")
    db.register_vocabulary("m", media.build_vocabulary([np.random.default_rng(1).normal(size=(40, 13))], 4))
    got = db.load_media("m", str(tmp_path))
    assert (got.loaded, got.rejected, len(got.errors)) == (0, 5, 2)


def _wav(path, hertz):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16_000)
        w.writeframes((np.sin(np.arange(8000) * hertz / 2500) * 20_000).astype("<i2").tobytes())


def test_media_ids_follow_the_keys_and_paths(db, tmp_path):
    for i in range(9):
        _wav(tmp_path / f"{i}.wav", 200 + 50 * i)
    (tmp_path / "x.wav").write_bytes(b"no sound")
    db.execute("CREATE TABLE m (id INT PRIMARY KEY, nombre VARCHAR(40), ruta VARCHAR(400), rasgos VECTOR(4)); INSERT INTO m VALUES (5, 'a', 'b', VECTOR(1, 0, 0, 0))")
    db.register_vocabulary("m", media.build_vocabulary([np.random.default_rng(1).normal(size=(40, 13))], 4))
    got = db.load_media("m", str(tmp_path))
    assert (got.loaded, got.rejected) == (9, 1)
    assert db.execute("SELECT id, nombre FROM m WHERE id > 5 ORDER BY id").rows == [(6 + i, f"{i}.wav") for i in range(9)]
    assert db.tables.state["m"]["next_rid"] == 10


def test_row_ids_have_no_gaps(db, spark, tmp_path):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(4)); INSERT INTO t VALUES (-1, 'a')")
    folder = tmp_path / "csv"
    spark.range(1000).selectExpr("id", "'x' AS s").repartition(6).write.csv(str(folder), header=True)
    assert db.load_csv("t", f"{folder}/*.csv").loaded == 1000
    db.execute("INSERT INTO t VALUES (2000, 'z')")
    rows = db.tables.read("t").orderBy("_rid").collect()
    assert [r["_rid"] for r in rows] == list(range(1002)) and (rows[0]["id"], rows[-1]["id"]) == (-1, 2000)


def test_csv_quotes_headers_and_delimiters(db, tmp_path):
    db.execute("CREATE TABLE q (id INT PRIMARY KEY, s VARCHAR(40))")
    (tmp_path / "a.csv").write_text('\nid,s\n1,"two\nlines"\n2,"a ""quoted"" word, and comma"\n\n3,back\\slash\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("S;ID;\nx,y;4;\n", encoding="utf-8")
    got = db.load_csv("q", str(tmp_path / "*.csv"))
    assert (got.loaded, got.rejected) == (4, 0), got.errors
    assert db.execute("SELECT * FROM q ORDER BY id").rows == [(1, "two\nlines"), (2, 'a "quoted" word, and comma'), (3, "back\\slash"), (4, "x,y")]
    for body, message in [("id,s,t\n5,a,b\n", "'t'"), ("id\n5\n", "no column s"), ("id,s,S,ID\n", "column"), ("", "empty"), ("\n \n", "empty")]:
        (tmp_path / "bad.txt").write_text(body)
        with pytest.raises(ExecutionError, match=message):
            db.load_csv("q", str(tmp_path / "bad.txt"))


def test_fragments_are_laid_out_and_pruned(db, tmp_path):
    db.execute("CREATE TABLE f (id INT PRIMARY KEY, s VARCHAR(8)) PARTITION BY RANGE (id) (PARTITION a VALUES LESS THAN (10) ON n1, PARTITION b VALUES LESS THAN (20) ON n2, PARTITION c VALUES LESS THAN (30) ON n1)")
    (tmp_path / "f.csv").write_text("id,s\n" + "".join(f"{i},x{i}\n" for i in range(33)))
    got = db.load_csv("f", str(tmp_path / "f.csv"))
    assert (got.loaded, got.rejected) == (30, 3) and got.errors[0][0] == "id: no fragment holds it"
    with pytest.raises(ExecutionError, match="no fragment"):
        db.execute("INSERT INTO f VALUES (30, 'x')")
    with pytest.raises(ExecutionError, match="exists"):
        db.execute("INSERT INTO f VALUES (15, 'x')")
    db.execute("INSERT INTO f VALUES (-4, 'x'); DELETE FROM f WHERE id = 12")
    for where, rows, read in [("id = 15", [15], "b"), ("id < 3", [-4, 0, 1, 2], "a"), ("id >= 18", [*range(18, 30)], "bc"), ("id BETWEEN 9 AND 10", [9, 10], "ab"), ("id BETWEEN 9 AND 3", [], None), ("s = 'x11'", [11], "abc")]:
        got = db.execute(f"SELECT id FROM f WHERE {where} ORDER BY id")
        assert [r[0] for r in got.rows] == rows
        if read:
            assert {f.split("_fragment=")[1].split("/")[0] for f in db.tables.read("f", _keys_of(db, where)).inputFiles()} >= set(read)
            plan = got.df._jdf.queryExecution().executedPlan().toString()
            assert ("PartitionFilters: []" in plan) == (where.startswith("s"))


def _keys_of(db, where):
    from skein.plans import parser

    return db.planner._keys(db._bound(parser.parse_sql_script(f"SELECT id FROM f WHERE {where}")[0]))


def test_explain_analyze_counts_each_step(db):
    db.execute("CREATE TABLE a (id INT PRIMARY KEY, g INT, x DOUBLE); CREATE TABLE b (k INT PRIMARY KEY, s VARCHAR(8))")
    fill(db, "a", [f"{i}, {i % 3}, {i}.5" for i in range(8)])
    fill(db, "b", ["0, 'zero'", "1, 'one'"])

    def counts(sql):
        def walk(s):
            return [(s.op, s.records), *(x for c in s.children for x in walk(c))]

        return walk(db.execute("EXPLAIN ANALYZE " + sql).plan)

    assert counts("SELECT id FROM a WHERE x > 3.0 ORDER BY x LIMIT 2") == [("limit", 2), ("project", 5), ("sort", 5), ("filter", 5), ("scan", 8)]
    assert counts("SELECT g, SUM(x) FROM a GROUP BY g") == [("project", 3), ("group", 3), ("scan", 8)]
    assert counts("SELECT id, s FROM a JOIN b ON g = k WHERE x > 3.0") == [("project", 4), ("filter", 4), ("join", 6), ("scan", 8), ("scan", 2)]
    assert counts("SELECT id FROM a WHERE id BETWEEN 9 AND 3")[0] == ("project", 0)
    assert {r for _, r in counts("SELECT id FROM a")} == {8}
