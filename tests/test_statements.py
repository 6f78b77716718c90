"""Values, errors, joins, groups and subqueries over a small fleet: depots, vans and trips, with NULLs and ties."""

import datetime
import decimal
import math

import pytest

from quillon.errors import SessionError, SqlError
from quillon.plans.run import query
from quillon.sources.parquet import relation

INF, NAN = float("inf"), float("nan")
EPOCH = datetime.datetime(1970, 1, 1)

VALUES = {
    # integers
    "9 - 4 * 2": 1,
    "17 / 5": 3,
    "-17 / 5": -3,
    "-17 % 5": -2,
    "17 % -5": 2,
    "-9223372036854775808 % -1": 0,
    "- (3 - 8)": 5,
    "abs(4 - 11)": 7,
    # reals
    "0.75 + 2": 2.75,
    "1.0 / 8": 0.125,
    "-(0.0)": 0.0,
    "abs(-3.25)": 3.25,
    "4503599627370497 < 4503599627370497.5": True,
    "9007199254740995 = 9007199254740996.0": False,
    "9007199254740995 < 9007199254740996.0": True,
    "9223372036854775807 < 9223372036854775808.0": True,
    # rounding, on the exact binary value
    "round(0.285, 2)": 0.28,
    "round(3.5)": 4.0,
    "round(-4.5)": -5.0,
    "round(-0.2)": 0.0,
    "round(-0.004, 2)": -0.0,
    "round(7, 3)": 7.0,
    "round(65.5, -2)": 66.0,
    "round(1.1, 22)": 1.1,
    "round(6.5e-24, 23)": 1e-23,
    "round(-6.5e-24, 24)": -6e-24,
    "round(1.5e-30, 25)": 0.0,
    "round(2.6e-27, 27)": 3e-27,
    "round(4e-320, 319)": 0.0,
    "round(1e300, 390)": 1e300,
    "round(0.3, 40)": 0.3,
    # text
    "'van' || ' ' || 'No'": "van No",
    "'x' || NULL": None,
    "length('größe')": 5,
    "length(X'c3b6')": 2,
    "lower('VÄN') || upper('vän')": "vÄnVäN",
    "trim('  two  ') || '.'": "two.",
    "ltrim('zzyx', 'zy')": "x",
    "rtrim('abba', 'a')": "abb",
    "replace('banana', 'an', '-')": "b--a",
    "replace('banana', '', '-')": "banana",
    "instr('depot', 'po')": 3,
    "instr('depot', '')": 1,
    "instr(X'0a0b0c', X'0b0c')": 2,
    "substr('parcel', 3)": "rcel",
    "substr('parcel', 2, 3)": "arc",
    "substr('parcel', -2)": "el",
    "substr('parcel', -3, 2)": "ce",
    "substr('parcel', 5, -2)": "rc",
    "substr('parcel', 0, 3)": "pa",
    "substr('parcel', -9, 5)": "pa",
    "substr('parcel', 40)": "",
    "substr(X'01020304', 2, 2)": b"\x02\x03",
    # patterns
    "'Fleet' LIKE 'f%T'": True,
    "'a\\c' LIKE 'A\\_'": True,
    "'Ü' LIKE 'ü'": False,
    "'10%' LIKE '__%'": True,
    "NULL LIKE '%'": None,
    # unknown
    "NULL IS NULL": True,
    "2 IS NOT 2.0": False,
    "NULL = NULL": None,
    "5 IN (6, NULL)": None,
    "5 IN (5, NULL)": True,
    "5 NOT IN (6, 7)": True,
    "NULL NOT IN (6)": None,
    "3 BETWEEN 4 AND NULL": False,
    "3 NOT BETWEEN NULL AND 2": True,
    "NOT (NULL AND FALSE)": True,
    "NULL OR TRUE": True,
    # choices
    "CASE WHEN 2 > 3 THEN 'a' WHEN 3 > 2 THEN 'b' END": "b",
    "CASE 8 WHEN 7 THEN 'x' WHEN 8.0 THEN 'y' END": "y",
    "CASE NULL WHEN NULL THEN 1 ELSE 0 END": 0,
    "CASE WHEN FALSE THEN 1 / 0 ELSE 4 END": 4,
    "coalesce(NULL, NULL, 6)": 6,
    "ifnull(NULL, 'none')": "none",
    "nullif(4, 4.0)": None,
    "nullif('a', 'b')": "a",
    "min(5, 3, 9)": 3,
    "max('b', 'a', 'c')": "c",
    "max(2, 1.5)": 2.0,
    "min(1, NULL)": None,
    # casts
    "CAST('  -42' AS INTEGER)": -42,
    "CAST(2.9 AS INTEGER)": 2,
    "CAST('6.25e2' AS REAL)": 625.0,
    "CAST('tRuE' AS BOOLEAN)": True,
    "CAST(FALSE AS TEXT)": "false",
    "CAST(X'c3a9' AS TEXT)": "é",
    "CAST('é' AS BLOB)": b"\xc3\xa9",
    "CAST(4e21 AS TEXT)": "4.0e+21",
    "CAST(0.00025 AS TEXT)": "0.00025",
    "CAST(0.000025 AS TEXT)": "2.5e-05",
    "CAST(-1234.5 AS TEXT)": "-1234.5",
    "CAST(CAST('2031-07-01T23:30:00.25-02:00' AS TIMESTAMP) AS TEXT)": "2031-07-02T01:30:00.25Z",
    "CAST('1999-12-31T00:00:00Z' AS TIMESTAMP) < CAST('2000-01-01T00:00:00Z' AS TIMESTAMP)": True,
}

FAILS = {
    "SELECT 8 / (4 - 4)": "division by zero",
    "SELECT 8 % 0": "division by zero",
    "SELECT 1.5 / 0.0": "division by zero",
    "SELECT 9223372036854775807 * 2": "overflow",
    "SELECT -9223372036854775808 / -1": "integer overflow",
    "SELECT abs(-9223372036854775808)": "integer overflow",
    "SELECT 9e307 + 9e307": "REAL overflow",
    "SELECT 1.0 / (9e307 * 3.0)": "REAL overflow",
    "SELECT 5 || 'a'": "needs TEXT",
    "SELECT 'a' < 1": "do not compare",
    "SELECT CASE WHEN TRUE THEN 'a' ELSE 1 END": "must have one type",
    "SELECT CAST('12x' AS INTEGER)": "does not convert",
    "SELECT CAST(1e19 AS INTEGER)": "does not convert",
    "SELECT CAST(TRUE AS BLOB)": "no CAST",
    "SELECT max(1, 'a')": "do not compare",
    "SELECT round('a')": "needs INTEGER or REAL",
    "SELECT substr('a')": "arguments",
    "SELECT bogus(1)": "no such function",
    "SELECT plate FROM van": "no such column",
    "SELECT 1 FROM garage": "no such table",
    "SELECT id FROM van JOIN trip ON TRUE": "ambiguous",
    "SELECT van.id FROM van JOIN van ON TRUE": "used twice",
    "SELECT id FROM van WHERE seats": "needs BOOLEAN",
    "SELECT seats FROM van GROUP BY depot": "neither grouped",
    "SELECT max(sum(seats)) FROM van": "not allowed",
    "SELECT id FROM van WHERE count(*) > 1": "not allowed",
    "SELECT sum(depot) FROM van": "needs a number",
    "SELECT * FROM van GROUP BY id": "grouping",
    "SELECT id FROM van ORDER BY 5": "out of range",
    "SELECT id FROM van LIMIT NULL": "is NULL",
    "SELECT id FROM van LIMIT seats": "no such column",
    "SELECT (SELECT id, seats FROM van)": "2 columns",
    "SELECT id, (SELECT km FROM trip WHERE van = depots.id) FROM van depots": "more than one row",
}

ROWS = {
    "SELECT id FROM van WHERE seats >= 5 ORDER BY id DESC": [(6,), (4,), (2,)],
    "SELECT id FROM van WHERE kml <= 9.5 OR kml IS NULL ORDER BY id": [(1,), (3,), (5,), (6,)],
    "SELECT id FROM van WHERE id > 2.5 AND id <= 5.25 ORDER BY id": [(3,), (4,), (5,)],
    "SELECT van.* FROM van WHERE depot = 'E' ORDER BY id": [(1, "E", 3, 9.5), (4, "E", 8, 12.0)],
    "SELECT seats AS s, seats * 2 AS t FROM van WHERE id < 4 ORDER BY s DESC": [(5, 10), (3, 6), (None, None)],
    "SELECT id FROM van ORDER BY seats, id DESC": [(5,), (3,), (1,), (6,), (2,), (4,)],
    "SELECT id FROM van ORDER BY seats DESC, id LIMIT 3": [(4,), (2,), (6,)],
    "SELECT id FROM van ORDER BY id LIMIT 2 OFFSET 3": [(4,), (5,)],
    "SELECT id FROM van ORDER BY id LIMIT -3 OFFSET 4": [(5,), (6,)],
    "SELECT id FROM van ORDER BY id LIMIT (SELECT count(*) FROM nothing) + 2": [(1,), (2,)],
    "SELECT DISTINCT depot FROM van ORDER BY depot": [(None,), ("E",), ("N",)],
    "SELECT DISTINCT seats FROM van ORDER BY seats DESC": [(8,), (5,), (3,), (None,)],
    "SELECT DISTINCT depot FROM van WHERE depot IS NOT NULL ORDER BY length(depot), depot": [("E",), ("N",)],
    # joins
    "SELECT van.id, km FROM van JOIN trip ON van = van.id WHERE trip.id <> 13 ORDER BY km": [(1, 70), (1, 90), (4, 120)],
    "SELECT v.id, t.km FROM van v LEFT JOIN trip t ON t.van = v.id AND t.km > 50 ORDER BY v.id, t.km": [(1, 70), (1, 90), (2, None), (3, None), (4, 120), (5, None), (6, None)],
    "SELECT count(*) FROM van a JOIN van b ON a.depot = b.depot AND a.id < b.id": [(2,)],
    "SELECT count(*) FROM van a JOIN van b ON TRUE": [(36,)],
    "SELECT v.id, d.city FROM van v LEFT JOIN depot d ON d.code = v.depot JOIN trip t ON t.van = v.id WHERE t.km >= 90 ORDER BY v.id": [(1, "Elm"), (4, "Elm")],
    "SELECT v.id, t.km FROM van v JOIN trip t ON t.van = v.id AND t.km IN (SELECT max(km) FROM trip x WHERE x.van = v.id) ORDER BY v.id": [(1, 90), (2, 40), (4, 120)],
    "SELECT v.id, t.km FROM van v LEFT JOIN trip t ON t.van = v.id AND EXISTS (SELECT 1 FROM trip x WHERE x.km > t.km AND x.van = v.id) ORDER BY v.id": [(1, 70), (2, None), (3, None), (4, None), (5, None), (6, None)],
    "SELECT v.id FROM van v LEFT JOIN trip t ON (SELECT count(*) FROM nothing) > 0 WHERE t.id IS NULL ORDER BY v.id": [(k,) for k in range(1, 7)],
    # groups
    "SELECT depot, count(*), count(seats), sum(seats), avg(kml), max(kml) FROM van GROUP BY depot ORDER BY depot": [(None, 2, 1, 5, 11.0, 11.0), ("E", 2, 2, 11, 10.75, 12.0), ("N", 2, 1, 5, 7.25, 8.0)],
    "SELECT depot FROM van GROUP BY depot HAVING sum(seats) > 5 ORDER BY 1 DESC": [("E",)],
    "SELECT count(*), count(DISTINCT seats), sum(DISTINCT seats), min(depot) FROM van": [(6, 3, 16, "E")],
    "SELECT count(*), sum(n), avg(n), min(n) FROM nothing": [(0, None, None, None)],
    "SELECT seats % 2 = 1, count(*) FROM van GROUP BY seats % 2 = 1 ORDER BY 1": [(None, 2), (False, 1), (True, 3)],
    "SELECT sum(seats) FROM van HAVING count(*) > 6": [],
    "SELECT 1 FROM van HAVING count(*) = 6": [(1,)],
    "SELECT seats + 1 FROM van GROUP BY seats + 1 ORDER BY 1": [(None,), (4,), (6,), (9,)],
    # subqueries
    "SELECT id FROM van WHERE EXISTS (SELECT 1 FROM trip WHERE van = van.id) ORDER BY id": [(1,), (2,), (4,)],
    "SELECT id FROM van v WHERE EXISTS (SELECT 1 FROM trip WHERE van = v.id) ORDER BY id": [(1,), (2,), (4,)],
    "SELECT id FROM van v WHERE NOT EXISTS (SELECT 1 FROM trip WHERE van = v.id AND km > 50) ORDER BY id": [(2,), (3,), (5,), (6,)],
    "SELECT id FROM van WHERE id IN (SELECT van FROM trip) ORDER BY id": [(1,), (2,), (4,)],
    "SELECT id FROM van WHERE id NOT IN (SELECT van FROM trip)": [],
    "SELECT id FROM van WHERE id NOT IN (SELECT van FROM trip WHERE van IS NOT NULL) ORDER BY id": [(3,), (5,), (6,)],
    "SELECT id, seats IN (SELECT n FROM nothing), seats NOT IN (SELECT van FROM trip) FROM van WHERE id < 4 ORDER BY id": [(1, False, None), (2, False, None), (3, False, None)],
    "SELECT id FROM van WHERE seats IN (SELECT max(seats) FROM van GROUP BY depot) ORDER BY id": [(2,), (4,), (6,)],
    "SELECT id FROM van v WHERE kml IN (SELECT max(kml) FROM van w WHERE w.depot = v.depot) ORDER BY id": [(4,), (6,)],
    "SELECT id, (SELECT sum(km) FROM trip WHERE van = v.id), (SELECT count(*) FROM trip WHERE van = v.id) FROM van v WHERE id < 4 ORDER BY id": [(1, 160, 2), (2, 40, 1), (3, None, 0)],
    "SELECT id, (SELECT km FROM trip WHERE van = v.id ORDER BY km DESC LIMIT 1) FROM van v WHERE id < 3 ORDER BY id": [(1, 90), (2, 40)],
    "SELECT id, (SELECT sum(km + v.seats) FROM trip) FROM van v WHERE id IN (1, 3) ORDER BY id": [(1, 355), (3, None)],
    "SELECT id, CASE WHEN id > 1 THEN (SELECT km FROM trip WHERE van = v.id) END FROM van v WHERE id <= 2 ORDER BY id": [(1, None), (2, 40)],
    "SELECT id FROM van v WHERE EXISTS (SELECT 1 FROM trip t WHERE t.van = v.id AND EXISTS (SELECT 1 FROM trip u WHERE u.van = v.id AND u.km = t.km + 20))": [(1,)],
    "SELECT depot, (SELECT city FROM depot WHERE code = van.depot) FROM van GROUP BY depot ORDER BY depot": [(None, None), ("E", "Elm"), ("N", "Nook")],
    "SELECT depot FROM van GROUP BY depot HAVING max(kml) > (SELECT avg(kml) FROM van) ORDER BY depot": [(None,), ("E",)],
    "SELECT id FROM van v ORDER BY (SELECT sum(km) FROM trip WHERE van = v.id) DESC, id LIMIT 3": [(1,), (4,), (2,)],
    "SELECT (SELECT 7), (SELECT NULL), (SELECT id FROM van WHERE FALSE)": [(7, None, None)],
    "SELECT t.id FROM van v JOIN trip t ON t.van = v.id WHERE 100 / (t.km - 70) > 0 AND t.km <> 70 ORDER BY t.id": [(12,), (14,)],
    "SELECT v.id, (SELECT sum(km) FROM trip t WHERE 100 / (t.km + 1) > 0 AND t.van = v.id) FROM van v WHERE id < 3 ORDER BY id": [(1, 160), (2, 40)],
    "SELECT 3 WHERE 1 > 2": [],
}


@pytest.fixture(scope="module")
def tables(spark):
    def table(schema, rows):
        return relation(spark.createDataFrame(rows, schema))

    return {
        "van": table("id bigint, depot string, seats bigint, kml double", [(1, "E", 3, 9.5), (2, None, 5, 11.0), (3, "N", None, 6.5), (4, "E", 8, 12.0), (5, None, None, None), (6, "N", 5, 8.0)]),
        "depot": table("code string, city string", [("E", "Elm"), ("N", "Nook"), ("Z", None)]),
        "trip": table("id bigint, van bigint, km bigint", [(11, 1, 70), (12, 1, 90), (13, 2, 40), (14, 4, 120), (15, None, 20)]),
        "nothing": table("n bigint", []),
        "odd": table("id bigint, x double", [(1, NAN), (2, None), (3, 4.5), (4, INF), (5, -0.0), (6, -INF)]),
        "cancel": table("g bigint, x double", [(1, 3e17), (1, 0.5), (1, -3e17), (2, 0.2), (2, 0.2), (2, 0.2), (2, 0.2), (2, 0.2), (3, 1e308), (3, -1e308), (3, 7.0), (4, 2e-310), (4, 3e-310), (5, None), (6, INF), (6, 1.0), (7, INF), (7, -INF)]),
    }


def test_values(spark, tables):
    text = "SELECT " + ", ".join(f"{e} AS v{k}" for k, e in enumerate(VALUES))
    (got,) = query(spark, text, tables).rows()
    for (e, want), v in zip(VALUES.items(), got):
        assert repr(v) == repr(want), e


@pytest.mark.parametrize(("text", "message"), FAILS.items())
def test_errors(spark, tables, text, message):
    with pytest.raises(SqlError, match=message):
        query(spark, text, tables).rows()


@pytest.mark.parametrize(("text", "want"), ROWS.items())
def test_rows(spark, tables, text, want):
    assert query(spark, text, tables).rows() == want


def test_not_a_number(spark, tables):
    ask = lambda text: [r[0] for r in query(spark, text, tables).rows()]
    assert ask("SELECT id FROM odd ORDER BY x, id") == [2, 1, 6, 5, 3, 4]
    assert ask("SELECT id FROM odd ORDER BY x DESC, id") == [4, 3, 5, 6, 1, 2]
    assert sorted(ask("SELECT id FROM odd WHERE x < 9.0 OR x <> 1.0")) == [3, 4, 5, 6]
    assert query(spark, "SELECT max(x), min(x) FROM odd", tables).rows() == [(INF, -INF)]
    assert query(spark, "SELECT x = x, x IS x, max(x, 1.0), x IN (x) FROM odd WHERE id = 1", tables).rows() == [(None, False, None, None)]
    assert [math.isnan(v) for (v,) in query(spark, "SELECT x * 2.0 - x FROM odd WHERE id IN (1, 4) ORDER BY id", tables).rows()] == [True, True]


def test_real_sums_are_exact(spark, tables):
    want = [(1, 0.5, 0.5 / 3, 0.5), (2, 1.0, 0.2, 0.2), (3, 7.0, 7.0 / 3, 7.0), (4, 5e-310, 2.5e-310, 5e-310), (5, None, None, None), (6, INF, INF, INF)]
    assert query(spark, "SELECT g, sum(x), avg(x), sum(DISTINCT x) FROM cancel WHERE g < 7 GROUP BY g ORDER BY g", tables).rows() == want
    assert math.isnan(query(spark, "SELECT sum(x) FROM cancel WHERE g = 7", tables).rows()[0][0])
    with pytest.raises(SqlError, match="REAL overflow"):
        query(spark, "SELECT sum(x) FROM two", {"two": relation(spark.createDataFrame([(1e308,), (1e308,)], "x double"))}).rows()


def test_real_sums_at_any_size(spark):
    """What cancels does so among many rows, however they are dealt."""
    many = spark.range(200_001).selectExpr("CASE id WHEN 7 THEN 1e16D WHEN 150000 THEN -1e16D WHEN 100 THEN 1D ELSE 0D END AS x", "cast(0.1 AS double) AS y")
    for parts in (1, 7):
        t = {"t": relation(many.repartition(parts))}
        assert query(spark, "SELECT sum(x), sum(y) FROM t", t).rows() == [(1.0, math.fsum([0.1] * 200_001))]


def test_parameters(spark, tables):
    assert query(spark, "SELECT ?2 || ?2, ?, ?1, ?", tables, (True, "ab", 1.25, None)).rows() == [("abab", 1.25, True, None)]
    assert query(spark, "SELECT id FROM van WHERE seats = ?1 AND depot = ?2", tables, (5, "N")).rows() == [(6,)]
    assert query(spark, "SELECT ?, ?, ?", tables, (b"\x00", None, 2.5)).rows() == [(b"\x00", None, 2.5)]
    for params, message in (((), "no value"), (({},), "not supported"), ((2**63,), "not supported")):
        with pytest.raises(SqlError, match=message):
            query(spark, "SELECT ?", tables, params)


def test_positions(spark, tables):
    with pytest.raises(SqlError) as e:
        query(spark, "SELECT id\nFROM van\nWHERE    wheels = 4", tables)
    assert (e.value.line, e.value.col) == (3, 10)
    for text, line, col in (("SELECT km,\n\n 7 / (id - 13) FROM trip", 3, 4), ("SELECT " + "km + " * 30 + "km / (id - 13) FROM trip", 1, 161), ("SELECT 1.0 / (id - 13) +\n 1.5 FROM trip", 1, 12)):
        with pytest.raises(SqlError) as e:
            query(spark, text, tables).rows()
        assert (e.value.line, e.value.col, e.value.message) == (line, col, "division by zero")


def plan_of(spark, text, tables):
    return query(spark, text, tables).df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def files(spark, tmp_path):
    spark.range(500).selectExpr("id", "id % 9 AS g", "cast(id AS double) AS x", "'t' AS unused").write.parquet(str(tmp_path / "p"))
    return {n: relation(spark.read.parquet(str(tmp_path / "p"))) for n in ("p", "q")}


def test_plans(spark, files):
    scan = query(spark, "SELECT g, count(*) FROM p WHERE x < 10 AND id >= 2.5 GROUP BY g", files).df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(x,10.0)" in scan and "GreaterThanOrEqual(id,3)" in scan and "unused" not in scan
    for text in (
        "SELECT id FROM p WHERE EXISTS (SELECT 1 FROM q WHERE q.id = p.g)",
        "SELECT id FROM p WHERE x > 3.0 AND id IN (SELECT max(id) FROM q GROUP BY g)",
        "SELECT id FROM p WHERE id IN (SELECT id FROM q ORDER BY x LIMIT 5)",
    ):
        plan = plan_of(spark, text, files)
        assert "LeftSemi" in plan and plan.count("Join") == 1, plan
    for text in (
        "SELECT id, (SELECT sum(q.x) FROM q WHERE 10 / (q.g + 1) > 1 AND q.id = p.id) FROM p",
        "SELECT p.id FROM p JOIN q ON q.id = p.g AND EXISTS (SELECT 1 FROM q r WHERE r.g = q.g)",
        "SELECT p.id FROM p LEFT JOIN q ON q.id = p.g AND q.x IN (SELECT max(x) FROM q r WHERE r.g = q.g)",
    ):
        physical = query(spark, text, files).df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in physical and "Cartesian" not in physical, physical


def test_exists_with_one_comparison(spark):
    """The greatest or least value of a group decides; no rows are paired."""
    rows = {
        "p": [(1, 1, 4.0), (2, 1, 9.0), (3, 2, NAN), (4, 3, 0.0), (5, None, 1.0), (6, 4, None), (7, 5, INF), (8, 1, -INF), (9, 1, NAN)],
        "q": [(1, 1, 5.0), (2, 1, NAN), (3, 2, 5.0), (4, 3, -0.0), (5, None, 8.0), (6, 4, 7.0), (7, 5, INF), (8, 1, None), (9, 6, NAN)],
    }
    t = {n: relation(spark.createDataFrame(r, "id bigint, g int, x double")) for n, r in rows.items()}
    holds = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "!=": lambda a, b: a != b}

    def hits(op, keyed, low=0):
        known = lambda v: v is not None and v == v
        return [i for i, g, x in rows["p"] if any((not keyed or g is not None and g == h) and known(x) and known(y) and j > low and holds[op](y, x) for j, h, y in rows["q"])]

    ask = lambda text: [r[0] for r in query(spark, text, t).rows()]
    for op, keyed, more, low in ((">", True, "", 0), ("<=", True, " AND q.id > 2", 2), ("!=", True, "", 0), ("<", False, "", 0), (">=", False, " AND q.id > 99", 99)):
        e = f"EXISTS (SELECT q.id FROM q WHERE {'q.g = p.g AND ' if keyed else ''}q.x {op} p.x{more})"
        want = hits(op, keyed, low)
        assert ask(f"SELECT id FROM p WHERE {e} ORDER BY id") == want, e
        assert ask(f"SELECT id FROM p WHERE NOT {e} ORDER BY id") == [i for i, *_ in rows["p"] if i not in want], e
        assert query(spark, f"SELECT p.id, o.id FROM p LEFT JOIN p o ON o.id = p.id AND {e} ORDER BY p.id", t).rows() == [(i, i if i in want else None) for i, *_ in rows["p"]], e
    # an outer side that can fail does so only where a group is there
    assert ask("SELECT id FROM p WHERE EXISTS (SELECT 1 FROM q WHERE q.g = p.g AND q.x > 60 / (p.id - 5)) ORDER BY id") == [1, 2, 3, 4, 7]
    with pytest.raises(SqlError, match="division by zero"):
        ask("SELECT id FROM p WHERE EXISTS (SELECT 1 FROM q WHERE q.g = p.g AND q.x > 6 / (p.id - 4))")
    for text, message in (("q.g = p.g AND q.x > 'a'", "do not compare"), ("q.g = p.h AND q.x > p.x", "no such column")):
        with pytest.raises(SqlError, match=message):
            ask(f"SELECT EXISTS (SELECT 1 FROM q WHERE {text}) FROM p")


def test_exists_pairs_no_rows(spark, files):
    for text in (
        "SELECT p.id FROM p LEFT JOIN q ON q.g = p.g AND EXISTS (SELECT 1 FROM q r WHERE r.g = p.g AND r.x > q.x + 400.0)",
        "SELECT id FROM p WHERE EXISTS (SELECT 1 FROM q WHERE q.g = p.g AND q.x > p.x)",
        "SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.x > p.x + 400.0)",
    ):
        physical = query(spark, text, files).df._jdf.queryExecution().executedPlan().toString()
        assert "max(" in physical and "Cartesian" not in physical, physical


def test_points_in_intervals(spark):
    """Joins of a point and two bounds, against all pairs looked at one by one."""
    whole = [None, -(2**63), -(2**63) + 1, -(2**61) - 1, -(2**61), -70, -3, -2, -1, 0, 1, 2, 3, 4, 7, 8, 8, 64, 1000, 2**40, 2**61 - 1, 2**61, 2**63 - 2, 2**63 - 1]
    real = [None, NAN, -INF, INF, -1e300, -1.5, -0.0, 0.0, 1e-9, 1.5, 1.5 + 2**-52, 2.0, 3.25, 3.75, 1e9, 1e9 + 0.5, 1e308, 5e-324]
    at = lambda k: None if k is None else EPOCH + datetime.timedelta(seconds=k, milliseconds=250 * (k % 4))
    when = [None, -90000, -1, 0, 1, 2, 59, 86400, 86400 * 365]
    a = [(k, n, m, real[k % len(real)], real[(k * 5 + 2) % len(real)], at(when[k % 9]), at(when[(k * 2 + 1) % 9])) for k, (n, m) in enumerate(zip(whole, whole[2:] + [9, None]))]
    b = [(k, n, real[k % len(real)], at(when[k % 9])) for k, n in enumerate(whole)]
    t = {"a": relation(spark.createDataFrame(a, "id int, n bigint, m bigint, x double, y double, s timestamp_ntz, e timestamp_ntz")), "b": relation(spark.createDataFrame(b, "id int, n bigint, x double, s timestamp_ntz"))}
    ok = lambda *v: all(w is not None and w == w for w in v)
    cases = {  # of rows of a and of b
        "b.n >= a.n AND b.n < a.m": lambda a, b: ok(b[1], a[1], a[2]) and a[1] <= b[1] < a[2],
        "a.m >= b.n AND a.n < b.n AND b.id <> a.id": lambda a, b: ok(b[1], a[1], a[2]) and a[1] < b[1] <= a[2] and a[0] != b[0],
        "a.n BETWEEN b.n AND b.n + 0": lambda a, b: ok(b[1], a[1]) and a[1] == b[1],
        "b.id + 2 >= a.id AND b.id - 3 < a.id - 1": lambda a, b: a[0] <= b[0] + 2 and b[0] - 3 < a[0] - 1,
        "b.id >= a.id * 2 AND b.id <= a.id * 3": lambda a, b: 2 * a[0] <= b[0] <= 3 * a[0],
        "b.x >= a.x AND b.x <= a.y": lambda a, b: ok(b[2], a[3], a[4]) and a[3] <= b[2] <= a[4],
        "b.x > a.id - 1.5 AND b.x < a.id * 0.25 + 2": lambda a, b: ok(b[2]) and a[0] - 1.5 < b[2] < a[0] * 0.25 + 2,
        "b.n >= a.x AND b.n < a.m": lambda a, b: ok(b[1], a[3], a[2]) and a[3] <= b[1] < a[2],
        "b.s >= a.s AND b.s < a.e": lambda a, b: ok(b[3], a[5], a[6]) and a[5] <= b[3] < a[6],
    }
    for on, holds in cases.items():
        want = sorted((p[0], q[0]) for p in a for q in b if holds(p, q))
        assert query(spark, f"SELECT a.id, b.id FROM a JOIN b ON {on} ORDER BY 1, 2", t).rows() == want, on
        if "id" not in on or "*" in on:
            alone = [(p[0], None) for p in a if p[0] not in {i for i, _ in want}]
            assert query(spark, f"SELECT a.id, b.id FROM a LEFT JOIN b ON {on} ORDER BY 1, 2", t).rows() == sorted(want + alone), on
    # a bound that overflows fails where it is compared, as before
    with pytest.raises(SqlError, match="integer overflow"):
        query(spark, "SELECT a.id FROM a JOIN b ON b.n >= a.n AND b.n < a.n + 3", t).rows()
    with pytest.raises(SqlError, match="REAL overflow"):
        query(spark, "SELECT a.id FROM a JOIN b ON b.x >= a.x AND b.x < a.x * 1e9", t).rows()


def test_intervals_are_joined_by_equality(spark, files):
    for text in (
        "SELECT p.id FROM p JOIN q ON q.id >= p.id AND q.id < p.id + 3",
        "SELECT p.id FROM p LEFT JOIN q ON q.x BETWEEN p.x - 0.5 AND p.x + 0.5",
        "SELECT p.id FROM p JOIN q ON p.g <= q.id AND p.id > q.id AND EXISTS (SELECT 1 FROM q r WHERE r.g = q.g)",
        "SELECT id, (SELECT count(*) FROM q JOIN q r ON r.id >= q.id AND r.id < q.id + p.g WHERE q.g = p.g) FROM p",
    ):
        logical = plan_of(spark, text, files)
        assert "explode" in logical and "Cartesian" not in query(spark, text, files).df._jdf.queryExecution().executedPlan().toString(), logical


@pytest.mark.parametrize("n", [5, 12, 16, 17, 64, 65, 1000])
def test_long_sums(spark, n):
    t = {"t": relation(spark.createDataFrame([(1, 0.1, 3), (2, None, None), (3, INF, 1)], "id bigint, x double, k bigint"))}
    total, whole = 0.0, 0
    for k in range(n):
        total, whole = total + 0.1, whole + (3 if k % 2 == 0 else -3)
    x = " + ".join(["x"] * n)
    k = "k" + "".join(" - k" if i % 2 else " + k" for i in range(1, n))
    assert query(spark, f"SELECT {x}, {k} FROM t ORDER BY id", t).rows() == [(total, whole), (None, None), (INF, n % 2)]
    with pytest.raises(SqlError, match="REAL overflow"):
        query(spark, "SELECT 0.0 * (" + " + ".join(["1.7e308 * k"] * n) + ") FROM t WHERE id = 1", t).rows()


def test_deep_expressions(spark):
    t = {"t": relation(spark.createDataFrame([("abcdefgh", 6, 2.5)], "s string, n bigint, x double"))}

    def nested(start, wrap, depth):
        for _ in range(depth):
            start = wrap(start)
        return start

    assert query(spark, "SELECT " + nested("s", lambda e: f"substr({e}, n - 5, n)", 8) + " FROM t", t).rows() == [("abcdef",)]
    want = 2.5
    for _ in range(10):
        want = float(decimal.Decimal(want / 2 + 1).quantize(decimal.Decimal("0.001"), decimal.ROUND_HALF_UP))
    assert query(spark, "SELECT " + nested("x", lambda e: f"round(abs({e} / 2.0 + 1.0), 3)", 10) + " FROM t", t).rows() == [(want,)]
    assert query(spark, f"SELECT max({', '.join(f'n - {k}' for k in range(40))}), min({', '.join(f'x * {k}.0' for k in range(1, 41))}) FROM t", t).rows() == [(6, 2.5)]
    assert query(spark, "SELECT " + nested("n", lambda e: f"CASE {e} % 7 WHEN 0 THEN n WHEN 6 THEN 13 ELSE nullif(n, 1) END", 12) + " FROM t", t).rows() == [(13,)]
    assert query(spark, "SELECT " + nested("x", lambda e: f"({e} - 0.5) * 1.0", 30) + " FROM t", t).rows() == [(2.5 - 15.0,)]
    assert query(spark, "SELECT " + " || ".join(["s"] * 300) + " FROM t", t).rows() == [("abcdefgh" * 300,)]
    assert query(spark, "SELECT n FROM t WHERE " + " OR ".join(f"n = {k}" for k in range(6, 300)), t).rows() == [(6,)]


def test_the_session_must_check_overflow(spark, tables):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(SessionError, match="ansi"):
            query(spark, "SELECT 9223372036854775807 + 1", tables)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_time_zones_play_no_part(spark, tables):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # an hour that New York skips
        assert query(spark, "SELECT CAST(CAST('2024-03-10T02:30:00Z' AS TIMESTAMP) AS TEXT)", tables).rows() == [("2024-03-10T02:30:00Z",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
