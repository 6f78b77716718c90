"""Queries that create, change and read a stored database, with their end state as SQL."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import dbapi, suite
from quillon.__main__ import main
from quillon.database import Database, ScanOptions, check, restore
from quillon.errors import QueryMemory, SqlError
from quillon.plans.run import query as run_query
from quillon.sources.folders import shared_folder
from quillon.sources.parquet import relation


def _database(spark: SparkSession) -> Database:
    return Database(f"{shared_folder(spark)}/quillon-db-{uuid.uuid4().hex}", spark)


def _after(script: str, final: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with _database(spark) as db:
            db.session().script(script)
            return db.query(final).df

    return run


_T = "CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT UNIQUE, n INTEGER NOT NULL DEFAULT 0, r REAL, CHECK (n >= 0)); INSERT INTO t (a, n, r) VALUES ('x', 1, 0.5), ('y', 2, NULL), ('z', 3, 2);"


def _load(spark: SparkSession, sf_dir: str) -> Database:
    """A database with the customers of the test tables as a stored, keyed table."""
    db = _database(spark)
    with db.update() as tx:
        tx.execute("CREATE TABLE customer (c_custkey INTEGER PRIMARY KEY, c_name TEXT NOT NULL, c_nationkey INTEGER, c_acctbal REAL, c_mktsegment TEXT); CREATE INDEX by_nation ON customer (c_nationkey, c_acctbal)")
        state = tx.state.copy()
        t = state.table("customer")
        rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(*[F.col(c.name).alias(c.id) for c in t.columns])
        t.parts.append(db.storage.write(t, rows.repartitionByRange(4, t.columns[0].id).sortWithinPartitions(t.columns[0].id)))
        tx.state = state
    return db


def _keyed(how: Callable[[Database], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with _load(spark, sf_dir) as db:
            return how(db)

    return run


def _page(db: Database) -> DataFrame:
    v = db.view()
    first = list(v.scan("customer", ScanOptions(limit=20)))
    return v.scan_frame("customer", ScanOptions(after=v.cursor("customer", first[-1]), limit=20)).select("c_custkey", "c_name")


def _changed(statement: str, final: str) -> Callable[[Database], DataFrame]:
    def run(db: Database) -> DataFrame:
        db.execute(statement)
        return db.query(final).df

    return run


def _explain(db: Database) -> DataFrame:
    return db.query("EXPLAIN SELECT c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 10.0 ORDER BY c_name").df


def _rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _database(spark) as db:
        s = db.session()
        s.script(_T + "BEGIN; DELETE FROM t; INSERT INTO t (a) VALUES ('gone'); ROLLBACK; BEGIN TRANSACTION; UPDATE t SET n = n + 10 WHERE id = 2; COMMIT")
        return db.query("SELECT id, a, n FROM t").df


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _small(how: Callable[[Database, SparkSession], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over a database with the small table t."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with _database(spark) as db:
            db.session().script(_T)
            return how(db, spark)

    return run


def _get(db: Database) -> DataFrame:
    v = db.view()
    keys = [r[0] for r in v.query("SELECT min(c_custkey) FROM customer").rows()] + [77, 100, -5]
    found = [v.get("customer", k) for k in keys]
    return _rows(db.spark, "k bigint, name string, bal double", [(k, r and r[1], r and r[3]) for k, r in zip(keys, found)])


def _typed(db: Database, spark: SparkSession) -> DataFrame:
    with db.update() as tx:
        tx.create_table("k", [("x", "INTEGER"), ("y", "TEXT"), ("z", "REAL")], ["x", "y"], {"z"})
        for row in [(1, "a", 2.5), (1, "b", None), (2, "a", 4), (3, "c", -0.5)]:
            tx.insert("k", row)
        tx.update("k", (1, "b", 9.0))
        tx.delete("k", 2, "a")
    return db.query("SELECT x, y, z FROM k").df


def _counters(db: Database, spark: SparkSession) -> DataFrame:
    with db.update() as tx:
        first = [tx.next("invoice"), tx.next("invoice"), tx.next("order")]
    tx = db.begin()
    lost = tx.next("invoice")
    tx.rollback()
    with db.update() as tx:
        after = tx.next("invoice")
    v = db.view()
    return _rows(spark, "what string, n bigint", [("first", first[1]), ("lost", lost), ("after", after), ("order", v.counter("order")), ("none", v.counter("none"))])


def _outcomes(db: Database, spark: SparkSession) -> DataFrame:
    texts = ["INSERT INTO t (a) VALUES ('p'), ('q')", "INSERT INTO t (id, a) VALUES (50, 'r')", "UPDATE t SET n = n + 1 WHERE id >= 4", "UPDATE t SET n = 0 WHERE id < 0", "DELETE FROM t WHERE a = 'p'", "CREATE TABLE other (a TEXT)"]
    out = [db.execute(x) for x in texts]
    return _rows(spark, "statement string, affected bigint, last bigint", [(x, o.rows_affected, o.last_insert_id) for x, o in zip(texts, out)])


def _atomic(db: Database, spark: SparkSession) -> DataFrame:
    s = db.session()
    s.execute("BEGIN")
    s.execute("UPDATE t SET n = 7 WHERE id = 1")
    for text in ("INSERT INTO t (a, n) VALUES ('ok', 1), ('x', 2)", "UPDATE t SET n = n - 5", "INSERT INTO t (a, n) VALUES ('late', 1), ('bad', -1)"):
        try:
            s.execute(text)
        except SqlError:
            continue
        raise AssertionError(text)
    s.execute("COMMIT")
    return db.query("SELECT id, a, n FROM t").df


def _snapshot(db: Database, spark: SparkSession) -> DataFrame:
    old = db.view()
    db.execute("DELETE FROM t WHERE id = 1; UPDATE t SET n = 99; INSERT INTO t (a) VALUES ('new')")
    db.checkpoint()
    rows = [("old", *r) for r in old.query("SELECT id, n FROM t").rows()] + [("now", *r) for r in db.query("SELECT id, n FROM t").rows()]
    return _rows(spark, "seen string, id bigint, n bigint", rows)


def _copied(db: Database) -> DataFrame:
    spark, at = db.spark, shared_folder(db.spark)
    names = [f"{at}/quillon-db-{uuid.uuid4().hex}" for _ in range(2)]
    db.backup(names[0])
    db.execute("DELETE FROM customer")
    restore(names[0], names[1], spark)
    with Database(names[1], spark, read_only=True) as copy:
        return copy.query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey").df


def _checked(db: Database) -> DataFrame:
    db.execute("UPDATE customer SET c_name = 'x' WHERE c_custkey = 3")
    r = check(db.path, db.spark)
    return _rows(db.spark, "n_tables bigint, n_indexes bigint, n_rows bigint", [(r.tables, r.indexes, r.rows)])


def _command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    path = f"{shared_folder(spark)}/quillon-db-{uuid.uuid4().hex}"
    code = main(["sql", path, _T + "UPDATE t SET a = 'NULL' WHERE id = 2; SELECT id, a, r FROM t ORDER BY id"], out, io.StringIO(), spark)
    return _rows(spark, "line string, code bigint", [(x, code) for x in out.getvalue().splitlines()])


def _cursor(db: Database) -> DataFrame:
    """Rows one after another, without the result being held."""
    result, n, total = db.query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey"), 0, 0.0
    keys = []
    for k, bal in result:
        n, total = n + 1, max(total, bal)
        keys.append(k)
    return _rows(db.spark, "columns string, n bigint, most double, ordered boolean", [("/".join(result.columns), n, total, keys == sorted(keys))])


def _driver(db: Database, spark: SparkSession) -> DataFrame:
    path = f"{shared_folder(spark)}/quillon-db-{uuid.uuid4().hex}"
    with dbapi.connect(path, spark, autocommit=False) as c:
        k = c.cursor()
        k.execute("CREATE TABLE d (id INTEGER PRIMARY KEY, a TEXT)")
        k.executemany("INSERT INTO d (a) VALUES (?)", [("x",), ("y",), ("z",)])
        c.commit()
        k.execute("DELETE FROM d")
        c.rollback()
        k.execute("SELECT id, a FROM d WHERE id > ? ORDER BY id", (1,))
        return _rows(spark, "name string, id bigint, a string", [(k.description[1][0], *r) for r in [k.fetchone(), *k.fetchall()]])


def _bounded(db: Database) -> DataFrame:
    """More rows than the memory allowed are an error, and no rows."""
    db.query_memory = 10_000
    try:
        got = len(db.query("SELECT * FROM customer").rows())
    except QueryMemory:
        got = -1
    db.query_memory = None
    return _rows(db.spark, "found bigint, allowed bigint", [(got, len(db.query("SELECT c_custkey FROM customer").rows()))])


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.run(spark, sf_dir, "SELECT c_custkey, ?3 || c_name AS v, ? AS w FROM customer WHERE c_nationkey = ?1 AND c_acctbal > ?2", (7, 100.5, "no. ", None))


def _not_a_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN stands between NULL and the numbers."""
    x = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN double('NaN') ELSE value END"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{x} AS x")
    n = "(SELECT count(*) FROM e WHERE x IS NULL)"
    text = f"SELECT event_id, x IS NULL AS none FROM e ORDER BY x, event_id LIMIT {n} + 10"
    return run_query(spark, text, {"e": relation(events)}).df


#: Statements that are refused before anything is run, with what is said.
REFUSED = [
    ("SELECT c_name FROM customer WHERE sum(c_custkey) > 1", "aggregate sum is not allowed in WHERE"),
    ("SELECT sum(count(*)) FROM customer", "aggregate count is not allowed in an aggregate"),
    ("SELECT 1 FROM customer GROUP BY max(c_custkey)", "aggregate is not allowed in GROUP BY"),
    ("SELECT sum(*) FROM customer", "sum(*) is not allowed"),
    ("SELECT * FROM customer GROUP BY c_custkey", "* does not go with grouping"),
    ("SELECT sum(c_name) FROM customer", "sum needs a number, not TEXT"),
    ("SELECT c_name FROM customer GROUP BY c_nationkey", "column c_name is neither grouped nor aggregated"),
    ("SELECT (SELECT sum(c.c_custkey) FROM customer d) FROM customer c", "sum reads columns of an outer query only"),
    ("SELECT c_custkey = c_name FROM customer", "INTEGER and TEXT do not compare"),
    ("SELECT nope FROM customer", "no such column: nope"),
    ("SELECT 1 FROM nope", "no such table: nope"),
    ("SELECT nope(1)", "no such function: nope"),
    ("CREATE TABLE x (n INTEGER CHECK (n > (SELECT 1)))", "a subquery is not allowed in CHECK"),
    ("INSERT INTO customer (c_custkey, c_name) VALUES (1, 'a') ON CONFLICT (c_custkey) DO UPDATE SET c_acctbal = (SELECT 1.0)", "a subquery is not allowed in DO UPDATE"),
]


def _refused(db: Database) -> DataFrame:
    said = []
    for text, _ in REFUSED:
        try:
            (db.query(text).rows if text.startswith("SELECT") else lambda text=text: db.execute(text))()
        except SqlError as e:
            said.append((text, e.message))
    return _rows(db.spark, "statement string, message string", said)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dml_insert_select_back": _after(_T, "SELECT * FROM t"),
    "dml_update": _after(_T + "UPDATE t SET n = n * 10, r = n WHERE id >= 2; UPDATE t SET a = a || '!' WHERE r IS NULL OR n = 1", "SELECT * FROM t"),
    "dml_delete": _after(_T + "DELETE FROM t WHERE r > 1.0", "SELECT id, a FROM t"),
    "upsert_nothing": _after(_T + "INSERT INTO t (id, a) VALUES (1, 'q'), (9, 'y'), (8, 'w') ON CONFLICT DO NOTHING", "SELECT id, a, n FROM t"),
    "upsert_update": _after(_T + "INSERT INTO t (a, n) VALUES ('x', 5), ('w', 7), ('w', 8), ('y', 1) ON CONFLICT (a) DO UPDATE SET n = t.n + excluded.n WHERE excluded.n > 1", "SELECT id, a, n FROM t"),
    "default_fill": _after("CREATE TABLE d (id INTEGER PRIMARY KEY, n INTEGER NOT NULL DEFAULT -3, r REAL DEFAULT 2, s TEXT DEFAULT 'a''b', b BOOLEAN DEFAULT TRUE, z INTEGER DEFAULT NULL); INSERT INTO d (id) VALUES (1), (5)", "SELECT * FROM d"),
    "alter_add_fill": _after(_T + "ALTER TABLE t ADD COLUMN c TEXT NOT NULL DEFAULT 'old'; INSERT INTO t (a, c) VALUES ('v', 'new')", "SELECT id, c FROM t"),
    "unique_null": _after("CREATE TABLE u (k INTEGER UNIQUE, v TEXT); INSERT INTO u VALUES (NULL, 'a'), (NULL, 'b'), (1, 'c'); CREATE UNIQUE INDEX uv ON u (v)", "SELECT rowid, k, v FROM u"),
    "drop_and_recreate": _after(_T + "DROP INDEX t_unique_1; INSERT INTO t (a) VALUES ('x'); DROP TABLE IF EXISTS nothing", "SELECT a, count(*) AS n FROM t GROUP BY a"),
    "transactions": _rolled_back,
    "update_large": _keyed(_changed("UPDATE customer SET c_acctbal = 0.0 WHERE c_acctbal < 0.0", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal = 0.0 GROUP BY c_nationkey")),
    "delete_large": _keyed(_changed("DELETE FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990.0)", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")),
    "api_prefix_scan": _keyed(lambda db: db.view().scan_frame("customer", ScanOptions(index="by_nation", prefix=(7,))).select("c_custkey", "c_nationkey", "c_acctbal")),
    "api_range_scan": _keyed(lambda db: db.view().scan_frame("customer", ScanOptions(index="by_nation", lower=(3, 100.0), upper=(5, 0.0), reverse=True)).select("c_custkey")),
    "api_keyset_page": _keyed(_page),
    "api_point_scan": _keyed(lambda db: db.query("SELECT * FROM customer WHERE c_custkey = 77").df),
    "explain_rows": _keyed(_explain),
    "api_get": _keyed(_get),
    "api_typed_writes": _small(_typed),
    "api_counters": _small(_counters),
    "api_result_cursor": _keyed(_cursor),
    "api_driver": _small(_driver),
    "api_command_line": _command_line,
    "dml_outcomes": _small(_outcomes),
    "dml_statement_atomic": _small(_atomic),
    "snapshot_reads": _small(_snapshot),
    "backup_restore": _keyed(_copied),
    "check_report": _keyed(_checked),
    "memory_bound": _keyed(_bounded),
    "parameters": _parameters,
    "order_nan": _not_a_number,
    "static_errors": _keyed(_refused),
}

ORACLE_SQL: dict[str, str] = {
    "dml_insert_select_back": "SELECT CAST(id AS BIGINT) AS id, a, CAST(n AS BIGINT) AS n, CAST(r AS DOUBLE) AS r FROM (VALUES (1, 'x', 1, 0.5), (2, 'y', 2, NULL), (3, 'z', 3, 2.0)) v(id, a, n, r)",
    "dml_update": "SELECT CAST(id AS BIGINT) AS id, a, CAST(n AS BIGINT) AS n, CAST(r AS DOUBLE) AS r FROM (VALUES (1, 'x!', 1, 0.5), (2, 'y', 20, 2.0), (3, 'z', 30, 3.0)) v(id, a, n, r)",
    "dml_delete": "SELECT CAST(id AS BIGINT) AS id, a FROM (VALUES (1, 'x'), (2, 'y')) v(id, a)",
    "upsert_nothing": "SELECT CAST(id AS BIGINT) AS id, a, CAST(n AS BIGINT) AS n FROM (VALUES (1, 'x', 1), (2, 'y', 2), (3, 'z', 3), (8, 'w', 0)) v(id, a, n)",
    "upsert_update": "SELECT CAST(id AS BIGINT) AS id, a, CAST(n AS BIGINT) AS n FROM (VALUES (1, 'x', 6), (2, 'y', 2), (3, 'z', 3), (5, 'w', 15)) v(id, a, n)",
    "default_fill": "SELECT CAST(id AS BIGINT) AS id, CAST(-3 AS BIGINT) AS n, CAST(2 AS DOUBLE) AS r, 'a''b' AS s, TRUE AS b, CAST(NULL AS BIGINT) AS z FROM (VALUES (1), (5)) v(id)",
    "alter_add_fill": "SELECT CAST(id AS BIGINT) AS id, c FROM (VALUES (1, 'old'), (2, 'old'), (3, 'old'), (4, 'new')) v(id, c)",
    "unique_null": "SELECT CAST(rowid_ AS BIGINT) AS rowid, CAST(k AS BIGINT) AS k, v FROM (VALUES (1, NULL, 'a'), (2, NULL, 'b'), (3, 1, 'c')) x(rowid_, k, v)",
    "drop_and_recreate": "SELECT a, CAST(n AS BIGINT) AS n FROM (VALUES ('x', 2), ('y', 1), ('z', 1)) v(a, n)",
    "transactions": "SELECT CAST(id AS BIGINT) AS id, a, CAST(n AS BIGINT) AS n FROM (VALUES (1, 'x', 1), (2, 'y', 12), (3, 'z', 3)) v(id, a, n)",
    "update_large": "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer WHERE c_acctbal <= 0.0 GROUP BY c_nationkey",
    "delete_large": "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990.0) GROUP BY c_nationkey",
    "api_prefix_scan": "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer WHERE c_nationkey = 7",
    "api_range_scan": "SELECT c_custkey FROM customer WHERE (c_nationkey > 3 OR c_nationkey = 3 AND c_acctbal >= 100.0) AND (c_nationkey < 5 OR c_nationkey = 5 AND c_acctbal < 0.0)",
    "api_keyset_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 20",
    "api_point_scan": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 77",
    "api_get": "SELECT k.k, c_name AS name, c_acctbal AS bal FROM (SELECT min(c_custkey) AS k FROM customer UNION ALL SELECT unnest([77, 100, -5])) k LEFT JOIN customer ON c_custkey = k.k",
    "api_typed_writes": "SELECT CAST(x AS BIGINT) AS x, y, CAST(z AS DOUBLE) AS z FROM (VALUES (1, 'a', 2.5), (1, 'b', 9.0), (3, 'c', -0.5)) v(x, y, z)",
    "api_counters": "SELECT what, CAST(n AS BIGINT) AS n FROM (VALUES ('first', 2), ('lost', 3), ('after', 3), ('order', 1), ('none', 0)) v(what, n)",
    "api_result_cursor": "SELECT 'c_custkey/c_acctbal' AS columns, count(*) AS n, max(c_acctbal) AS most, TRUE AS ordered FROM customer",
    "api_driver": "SELECT name, CAST(id AS BIGINT) AS id, a FROM (VALUES ('a', 2, 'y'), ('a', 3, 'z')) v(name, id, a)",
    "api_command_line": "SELECT line, CAST(0 AS BIGINT) AS code FROM (VALUES ('id' || chr(9) || 'a' || chr(9) || 'r'), ('1' || chr(9) || 'x' || chr(9) || '0.5'), ('2' || chr(9) || '''NULL''' || chr(9) || 'NULL'), ('3' || chr(9) || 'z' || chr(9) || '2.0')) v(line)",
    "dml_outcomes": "SELECT statement, CAST(affected AS BIGINT) AS affected, CAST(last AS BIGINT) AS last FROM (VALUES ('INSERT INTO t (a) VALUES (''p''), (''q'')', 2, 5), ('INSERT INTO t (id, a) VALUES (50, ''r'')', 1, 50), ('UPDATE t SET n = n + 1 WHERE id >= 4', 3, NULL), ('UPDATE t SET n = 0 WHERE id < 0', 0, NULL), ('DELETE FROM t WHERE a = ''p''', 1, NULL), ('CREATE TABLE other (a TEXT)', 0, NULL)) v(statement, affected, last)",
    "dml_statement_atomic": "SELECT CAST(id AS BIGINT) AS id, a, CAST(n AS BIGINT) AS n FROM (VALUES (1, 'x', 7), (2, 'y', 2), (3, 'z', 3)) v(id, a, n)",
    "snapshot_reads": "SELECT seen, CAST(id AS BIGINT) AS id, CAST(n AS BIGINT) AS n FROM (VALUES ('old', 1, 1), ('old', 2, 2), ('old', 3, 3), ('now', 2, 99), ('now', 3, 99), ('now', 4, 0)) v(seen, id, n)",
    "backup_restore": "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey",
    "check_report": "SELECT CAST(1 AS BIGINT) AS n_tables, CAST(1 AS BIGINT) AS n_indexes, count(*) AS n_rows FROM customer",
    "memory_bound": "SELECT CAST(-1 AS BIGINT) AS found, count(*) AS allowed FROM customer",
    "parameters": "SELECT c_custkey, 'no. ' || c_name AS v, NULL AS w FROM customer WHERE c_nationkey = 7 AND c_acctbal > 100.5",
    "order_nan": "WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS k, value FROM events) SELECT event_id, k = 0 AS none FROM e ORDER BY k, CASE WHEN k = 2 THEN value END, event_id LIMIT (SELECT count(*) + 10 FROM e WHERE k = 0)",
    "static_errors": "SELECT * FROM (VALUES " + ", ".join("('" + x.replace("'", "''") + "', '" + y.replace("'", "''") + "')" for x, y in REFUSED) + ") v(statement, message)",
    "explain_rows": "SELECT 'SEARCH customer USING INDEX by_nation ((c_nationkey = 3) AND (c_acctbal > 10.0)); SORT' AS plan",
}
