"""Stored tables: definitions, writes, conflicts, transactions, sessions, copies, driver."""

import io
import threading

import pytest

from quillon import database, dbapi
from quillon.__main__ import main
from quillon.database import ScanOptions
from quillon.sources.files import Files
from quillon.errors import CheckFailed, Corrupt, DuplicateKey, Exists, Locked, NotFound, NotNull, QueryMemory, ReadOnly, SessionError, SqlError


@pytest.fixture
def db(spark, tmp_path):
    with database.open(str(tmp_path / "db"), spark) as d:
        yield d


def rows(db, text, params=()):
    return db.query(text, params).rows()


def cause(db, text, kind, params=()):
    with pytest.raises(SqlError) as e:
        db.execute(text, params)
    assert isinstance(e.value.cause, kind), e.value
    return e.value


def test_keys_and_defaults(db):
    db.execute("CREATE TABLE log (line TEXT); INSERT INTO log VALUES ('second'), (NULL), ('first')")
    assert rows(db, "SELECT rowid, * FROM log ORDER BY rowid") == [(1, "second"), (2, None), (3, "first")]
    db.execute("CREATE TABLE pallet (no INTEGER PRIMARY KEY, mark TEXT NOT NULL DEFAULT 'none', kg REAL DEFAULT 25, seal BLOB DEFAULT X'0d', ok BOOLEAN DEFAULT FALSE)")
    assert db.execute("INSERT INTO pallet (no) VALUES (-12)").last_insert_id == -12
    assert db.execute("INSERT INTO pallet (mark, kg) VALUES ('p', 3), ('q', NULL)").last_insert_id == -10
    cause(db, "INSERT INTO pallet (no) VALUES (9223372036854775807), (NULL)", Exception)
    assert rows(db, "SELECT * FROM pallet ORDER BY no") == [(-12, "none", 25.0, b"\r", False), (-11, "p", 3.0, b"\r", False), (-10, "q", None, b"\r", False)]
    cause(db, "INSERT INTO pallet (mark) VALUES (NULL)", NotNull)
    for text in ("CREATE TABLE no1 (a TEXT NOT NULL DEFAULT NULL)", "CREATE TABLE no2 (rowid TEXT)", "CREATE TABLE no3 (a INTEGER DEFAULT 'x')", "INSERT INTO pallet (no) VALUES ('7')", "INSERT INTO pallet (kg) VALUES (9007199254740993)"):
        with pytest.raises(SqlError):
            db.execute(text)
    db.execute("CREATE TABLE seen (no INTEGER PRIMARY KEY, at TIMESTAMP NOT NULL DEFAULT CURRENT_TIMESTAMP); INSERT INTO seen (no) VALUES (7), (8), (9)")
    assert rows(db, "SELECT count(DISTINCT at), min(at) IS NULL FROM seen") == [(1, False)]


def test_checks_and_uniques(db):
    db.execute("CREATE TABLE slot (no INTEGER PRIMARY KEY UNIQUE CHECK (no > 0), door TEXT UNIQUE, opens INTEGER, shuts INTEGER, UNIQUE (opens, shuts), UNIQUE (shuts, opens), CHECK (opens < shuts))")
    assert sorted(db.view().state.indexes) == ["slot_unique_1", "slot_unique_2"]
    db.execute("INSERT INTO slot VALUES (5, 'north', 8, 12), (6, NULL, NULL, 12), (7, NULL, NULL, 12)")
    cause(db, "INSERT INTO slot VALUES (0, 'south', 9, 12)", CheckFailed)
    cause(db, "INSERT INTO slot VALUES (8, 'south', 13, 12)", CheckFailed)
    cause(db, "INSERT INTO slot VALUES (8, 'north', 9, 12)", DuplicateKey)
    cause(db, "INSERT INTO slot VALUES (8, 'south', 8, 12)", DuplicateKey)
    cause(db, "INSERT INTO slot VALUES (8, 'south', 1, 2), (8, 'east', 3, 4)", DuplicateKey)
    cause(db, "UPDATE slot SET shuts = 7 WHERE no = 5", CheckFailed)
    cause(db, "UPDATE slot SET door = 'north' WHERE no = 6", DuplicateKey)
    assert rows(db, "SELECT count(*), count(door) FROM slot") == [(3, 1)]
    db.execute("CREATE TABLE ratio (part INTEGER, CHECK (60 / part > 3))")
    with pytest.raises(SqlError, match="division by zero"):
        db.execute("INSERT INTO ratio VALUES (0)")
    with pytest.raises(SqlError, match="subquery"):
        db.execute("CREATE TABLE odd (n INTEGER CHECK (n IN (SELECT part FROM ratio)))")


def test_update_and_delete(db):
    db.execute("CREATE TABLE shelf (aisle TEXT, bay INTEGER, low INTEGER, high INTEGER, PRIMARY KEY (aisle, bay))")
    db.execute("INSERT INTO shelf VALUES ('k', 4, 10, 20)")
    db.execute("INSERT INTO shelf VALUES ('k', 5, 30, NULL), ('m', 4, 50, 60)")
    assert db.execute("UPDATE shelf SET low = high, high = low").rows_affected == 3
    assert rows(db, "SELECT low, high FROM shelf ORDER BY aisle, bay") == [(20, 10), (None, 30), (60, 50)]
    cause(db, "UPDATE shelf SET bay = bay + 1", DuplicateKey)  # (k, 4) would meet (k, 5) before that has moved
    assert db.execute("UPDATE shelf SET bay = bay - 1").rows_affected == 3
    cause(db, "UPDATE shelf SET aisle = 'k', bay = 4 WHERE aisle = 'm'", DuplicateKey)  # which lies in another part
    cause(db, "UPDATE shelf SET aisle = NULL", NotNull)
    assert db.execute("UPDATE shelf SET low = 0 WHERE bay > 90").rows_affected == 0
    assert db.execute("DELETE FROM shelf WHERE low > 15").rows_affected == 2
    assert rows(db, "SELECT aisle, bay FROM shelf") == [("k", 4)]
    with pytest.raises(SqlError, match="set twice"):
        db.execute("UPDATE shelf SET low = 1, low = 2")
    with pytest.raises(SqlError, match="no such column"):
        db.execute("UPDATE shelf SET depth = 1 WHERE bay > 90")
    assert db.execute("DELETE FROM shelf").rows_affected == 1 and rows(db, "SELECT * FROM shelf") == []


def test_upsert(db):
    db.execute("CREATE TABLE stock (no INTEGER PRIMARY KEY, sku TEXT UNIQUE, n INTEGER NOT NULL DEFAULT 0); INSERT INTO stock VALUES (100, 'bolt', 40), (200, 'nut', 9)")
    assert db.execute("INSERT INTO stock VALUES (100, 'gear', 1), (300, 'nut', 1), (400, 'cog', 1), (500, 'cog', 2) ON CONFLICT DO NOTHING").rows_affected == 1
    out = db.execute("INSERT INTO stock (sku, n) VALUES ('bolt', 2), ('pin', 6), ('pin', 3), ('bolt', 5) ON CONFLICT (sku) DO UPDATE SET n = stock.n - excluded.n")
    assert out.rows_affected == 4
    assert rows(db, "SELECT sku, n FROM stock ORDER BY no") == [("bolt", 33), ("nut", 9), ("cog", 1), ("pin", 3)]
    db.execute("INSERT INTO stock VALUES (200, 'washer', 0) ON CONFLICT (no) DO UPDATE SET no = 201, sku = excluded.sku WHERE stock.n = 9")
    assert rows(db, "SELECT no, sku FROM stock WHERE no IN (200, 201)") == [(201, "washer")]
    cause(db, "INSERT INTO stock VALUES (100, 'cog', 0) ON CONFLICT (no) DO UPDATE SET sku = excluded.sku", DuplicateKey)
    with pytest.raises(SqlError, match="no key"):
        db.execute("INSERT INTO stock VALUES (1, 'x', 1) ON CONFLICT (n) DO NOTHING")
    with pytest.raises(SqlError, match="subquery"):
        db.execute("INSERT INTO stock VALUES (100, 'x', 1) ON CONFLICT (no) DO UPDATE SET n = (SELECT 3)")


def test_alter_and_drop(db):
    db.execute("CREATE TABLE box (no INTEGER PRIMARY KEY); INSERT INTO box VALUES (3); ALTER TABLE box ADD COLUMN \"No\" TEXT NOT NULL DEFAULT 'plain'; INSERT INTO box VALUES (4, 'lined')")
    assert rows(db, 'SELECT "No", no FROM box ORDER BY no') == [("plain", 3), ("lined", 4)]
    db.execute("UPDATE box SET no = no + 10 WHERE no = 3")
    assert rows(db, 'SELECT no, "No" FROM box ORDER BY no') == [(4, "lined"), (13, "plain")]
    cause(db, "ALTER TABLE box ADD depth REAL DEFAULT 8 CHECK (depth > 9.5)", CheckFailed)
    with pytest.raises(SqlError):
        db.execute("ALTER TABLE box ADD tag TEXT UNIQUE")
    cause(db, 'CREATE TABLE lid (a INTEGER); CREATE UNIQUE INDEX lid ON box ("No")', Exists)
    db.execute("DROP TABLE IF EXISTS crate; CREATE TABLE IF NOT EXISTS box (other TEXT)")
    cause(db, "DROP INDEX crate", NotFound)


def parts(db, table):
    return [p.rows for p in db.view().state.tables[table].parts]


def test_only_parts_with_a_hit_are_written(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a INTEGER UNIQUE)")
    for k in range(3):
        db.execute("INSERT INTO t VALUES " + ", ".join(f"({10 * k + i}, {10 * k + i})" for i in range(4 + 6 * k)))
    names = lambda: [p.path for p in db.view().state.tables["t"].parts]
    before = names()
    db.execute("UPDATE t SET a = a + 1000 WHERE id = 12")
    assert len(set(names()) & set(before)) == 2
    db.execute("DELETE FROM t WHERE id < 2")
    db.execute("INSERT INTO t VALUES (21, 5000) ON CONFLICT (id) DO UPDATE SET a = excluded.a")
    assert rows(db, "SELECT count(*), sum(a) FROM t") == [(28, sum([2, 3, *range(10, 20), *range(20, 36)]) + 1000 + 5000 - 21)]
    unchanged = names()
    assert db.execute("DELETE FROM t WHERE a < 0").rows_affected == 0 and names() == unchanged
    assert db.execute("DELETE FROM t WHERE id >= 10 AND id < 20").rows_affected == 10  # a part that has no row left
    assert len(names()) < len(unchanged) and 0 not in parts(db, "t")


def test_small_parts_are_merged(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT); ALTER TABLE t ADD b INTEGER DEFAULT 5")
    for k in range(20):
        db.execute("INSERT INTO t (id, a) VALUES (?, ?)", (50 - k, f"r{k}"))
    assert len(parts(db, "t")) < 8 and sum(parts(db, "t")) == 20
    with db.update() as tx:
        tx.compact("t")
    assert parts(db, "t") == [20] and rows(db, "SELECT min(id), max(id), sum(b) FROM t") == [(31, 50, 100)]


def test_views_and_results_outlive_a_checkpoint(db):
    db.execute("CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1), (2)")
    view, result = db.view(), db.query("SELECT a FROM t WHERE a > 1")
    db.execute("DELETE FROM t; INSERT INTO t VALUES (3)")
    db.checkpoint()
    assert view.query("SELECT sum(a) FROM t").rows() == [(3,)] and result.rows() == [(2,)]
    assert rows(db, "SELECT a FROM t") == [(3,)]
    del view, result
    assert db.checkpoint() >= 1 and rows(db, "SELECT a FROM t") == [(3,)]
    db.execute("INSERT INTO t VALUES (4)")
    assert db.checkpoint(keep_seconds=3600) == 0


def test_nothing_is_returned_past_the_memory_bound(db):
    db.execute("CREATE TABLE t (a TEXT); INSERT INTO t VALUES " + ", ".join(["('0123456789')"] * 40))
    db.query_memory = 700
    seen = []
    with pytest.raises(QueryMemory):
        for row in db.query("SELECT a FROM t"):
            seen.append(row)
    assert not seen and len(rows(db, "SELECT a FROM t LIMIT 20")) == 20


def test_a_writer_waits_for_another_thread(db):
    db.execute("CREATE TABLE t (a INTEGER)")
    first, seen = db.begin(), []

    def second():
        with db.update() as tx:
            tx.execute("INSERT INTO t VALUES (2)")
            seen.append(tx.query("SELECT count(*) FROM t").rows())

    other = threading.Thread(target=second)
    other.start()
    first.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(SessionError):
        db.begin()  # this thread would wait for itself
    assert not seen
    first.commit()
    other.join(60)
    assert seen == [[(2,)]] and rows(db, "SELECT a FROM t ORDER BY a") == [(1,), (2,)]


def test_two_writers_never_share_a_version(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    files.mkdirs("m")
    assert files.publish("m/v1", "one") and not files.publish("m/v1", "two")
    assert files.read("m/v1") == "one" and files.names("m") == ["v1"]


def test_check_finds_other_values(spark, tmp_path):
    """A part that reads well and has the right number of rows, but not the rows that were written."""
    path = str(tmp_path / "d")
    with database.open(path, spark) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT, x REAL); INSERT INTO t VALUES (1, 'x', 0.5), (2, NULL, NULL)")
        part = db.view().state.tables["t"].parts[0]
        schema = db.storage.schema(db.view().state.tables["t"])
    assert database.check(path, spark).rows == 2
    spark.createDataFrame([(1, "x", 0.5), (2, None, 0.25)], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{part.path}")
    with pytest.raises(Corrupt, match="other values"):
        database.check(path, spark)


def test_check_finds_flipped_bytes(spark, tmp_path):
    path = str(tmp_path / "d")
    with database.open(path, spark) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT); INSERT INTO t VALUES " + ", ".join(f"({k}, 'text {k}')" for k in range(50)))
    (file,) = (tmp_path / "d" / "data").rglob("*.parquet")
    (file.parent / f".{file.name}.crc").unlink()
    good = file.read_bytes()
    for at in range(4, 300, 37):  # the pages come first
        file.write_bytes(good[:at] + bytes([good[at] ^ 0x10]) + good[at + 1 :])
        with pytest.raises(Corrupt):
            database.check(path, spark)


def test_transactions(db):
    s = db.session()
    s.script("CREATE TABLE t (a INTEGER); BEGIN; INSERT INTO t VALUES (1)")
    assert s.query("SELECT * FROM t").rows() == [(1,)] and rows(db, "SELECT * FROM t") == []
    with pytest.raises(SqlError):
        s.execute("INSERT INTO t VALUES (2), ('x')")  # the statement alone is undone
    s.execute("COMMIT")
    assert rows(db, "SELECT * FROM t") == [(1,)]
    with pytest.raises(SessionError):
        s.execute("COMMIT")
    old = db.view()
    db.execute("DELETE FROM t")
    assert old.query("SELECT * FROM t").rows() == [(1,)]
    s.begin_read()
    with pytest.raises(SessionError):
        s.execute("DELETE FROM t")
    s.rollback()
    with pytest.raises(SqlError):
        s.script("INSERT INTO t VALUES (9); SELEC 1")
    assert rows(db, "SELECT * FROM t") == []
    with pytest.raises(ValueError), db.update() as tx:
        tx.execute("INSERT INTO t VALUES (3)")
        raise ValueError
    assert rows(db, "SELECT * FROM t") == []


def test_typed_api_and_scans(db):
    with db.update() as tx:
        tx.create_table("k", [("x", "INTEGER"), ("y", "TEXT"), ("z", "REAL")], ["x", "y"], {"z"})
        tx.create_index("by_z", "k", ["z"])
        for x, y, z in [(0, "a", 3.0), (0, "b", 1.0), (1, "a", None), (1, "c", 2.0)]:
            tx.insert("k", (x, y, z))
        assert (tx.next("n"), tx.next("n")) == (1, 2)
        with pytest.raises(DuplicateKey):
            tx.insert("k", (0, "a", 1.0))
        tx.update("k", (0, "b", 9.0))
        tx.delete("k", 1, "c")
        with pytest.raises(NotFound):
            tx.delete("k", 7, "c")
    v = db.view()
    assert v.get("k", 0, "b") == (0, "b", 9.0) and v.get("k", 5, "b") is None and v.counter("n") == 2
    scan = lambda **o: [r[:2] for r in v.scan("k", ScanOptions(**o))]
    assert scan(prefix=(0,)) == [(0, "a"), (0, "b")]
    assert scan(reverse=True) == [(1, "a"), (0, "b"), (0, "a")]
    assert scan(lower=(0, "a"), lower_exclusive=True, upper=(1, "a")) == [(0, "b")]
    assert scan(upper=(1, "a"), upper_inclusive=True, lower=(0, "b")) == [(0, "b"), (1, "a")]
    assert scan(index="by_z") == [(1, "a"), (0, "a"), (0, "b")]
    assert scan(after=v.cursor("k", (0, "a", 3.0)), limit=1) == [(0, "b")]
    assert scan(index="by_z", after=v.cursor("k", (1, "a", None), "by_z")) == [(0, "a"), (0, "b")]


def test_explain(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, g INTEGER, name TEXT UNIQUE); CREATE INDEX gi ON t (g, name)")
    plan = lambda q: [r[0] for r in rows(db, "EXPLAIN " + q)]
    assert plan("SELECT * FROM t") == ["SCAN t"]
    assert plan("SELECT * FROM t WHERE id = 3") == ["SEARCH t USING PRIMARY KEY ((id = 3))"]
    assert plan("SELECT * FROM t WHERE g = 1 AND name > 'a' ORDER BY g") == ["SEARCH t USING INDEX gi ((g = 1) AND (name > 'a')) IN ORDER"]
    assert plan("SELECT * FROM t ORDER BY id DESC") == ["SCAN t IN ORDER DESC"]
    assert plan("SELECT DISTINCT g FROM t x WHERE 5 >= id ORDER BY g") == ["SEARCH t USING PRIMARY KEY ((5 >= id)); DISTINCT; SORT"]
    assert plan("SELECT 1") == ["ONE ROW"]
    assert plan("SELECT a.id FROM t a LEFT JOIN t b ON b.id = a.g")[0] == "SCAN t AS a; LEFT SEARCH t USING PRIMARY KEY ((b.id = a.g)) AS b"
    assert plan("SELECT id FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.g = t.id)")[1] == "SUBQUERY 1 (SELECT 1 FROM t AS u WHERE (u.g = t.id)), CORRELATED: SEARCH t USING INDEX gi ((u.g = t.id))"
    assert plan("DELETE FROM t WHERE g IN (1, 2)") == ["DELETE FROM t: SEARCH t USING INDEX gi ((g IN (1, 2)))"]
    with pytest.raises(SqlError):
        db.execute("EXPLAIN SELECT 1")


def test_copies_and_check(spark, tmp_path):
    path = str(tmp_path / "a")
    with database.open(path, spark) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, b BLOB, at TIMESTAMP); INSERT INTO t VALUES (1, X'00ff', CAST('2024-01-02T03:04:05.5Z' AS TIMESTAMP)); DELETE FROM t WHERE id = 7")
        with pytest.raises(Locked):
            database.open(path, spark)
        db.backup(str(tmp_path / "b"))
        with pytest.raises(Exists):
            db.backup(str(tmp_path / "b"))
    report = database.check(path, spark)
    assert (report.tables, report.rows) == (1, 1)
    database.restore(str(tmp_path / "b"), str(tmp_path / "c"), spark)
    with database.open(str(tmp_path / "c"), spark, read_only=True) as db:
        assert len(rows(db, "SELECT * FROM t")) == 1
        with pytest.raises(ReadOnly):
            db.execute("DELETE FROM t")
    for p in (tmp_path / "c" / "data").rglob("*.parquet"):
        p.write_bytes(b"damage")
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Corrupt):
        database.check(str(tmp_path / "c"), spark)


def test_command_line(spark, tmp_path):
    path, out, err = str(tmp_path / "d"), io.StringIO(), io.StringIO()
    script = "CREATE TABLE parcel (no INTEGER PRIMARY KEY, label TEXT, kg REAL, paid BOOLEAN, seal BLOB); INSERT INTO parcel VALUES (9, 'to: NULL', 0.5, FALSE, X'beef'), (12, 'NULL', 2e18, NULL, NULL), (15, NULL, NULL, TRUE, X''), (18, 'two\nlines', 3.0, TRUE, NULL); SELECT * FROM parcel ORDER BY no"
    assert main(["sql", path, script], out, err, spark) == 0
    assert out.getvalue().splitlines() == ["no\tlabel\tkg\tpaid\tseal", "9\tto: NULL\t0.5\tFALSE\tX'beef'", "12\t'NULL'\t2.0e+18\tNULL\tNULL", "15\tNULL\tNULL\tTRUE\tX''", "18\t'two\\nlines'\t3.0\tTRUE\tNULL"]
    assert main(["sql", path, "SELECT no,\nprice FROM parcel"], out, err, spark) == 1 and "line 2, column 1" in err.getvalue()
    assert main(["check", path], out, err, spark) == 0
    assert main(["nonsense"], out, err, spark) == 2


def test_driver(spark, tmp_path):
    with dbapi.connect(str(tmp_path / "e"), spark, autocommit=False) as c:
        k = c.cursor()
        k.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT)")
        k.executemany("INSERT INTO t (a) VALUES (?)", [("x",), ("y",)])
        assert (k.rowcount, k.lastrowid) == (2, 2)
        c.rollback()
        with pytest.raises(dbapi.ProgrammingError):
            k.execute("SELECT * FROM t")
        k.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT)")
        k.execute("INSERT INTO t VALUES (1, 'x'), (2, 'y')")
        c.commit()
        k.execute("SELECT id, a FROM t WHERE id > ? ORDER BY id", (0,))
        assert [d[:2] for d in k.description] == [("id", "INTEGER"), ("a", "TEXT")]
        assert k.fetchone() == (1, "x") and k.fetchmany(5) == [(2, "y")] and k.fetchone() is None
        with pytest.raises(dbapi.IntegrityError):
            k.execute("INSERT INTO t VALUES (1, 'z')")
    c.close()
