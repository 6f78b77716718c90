"""Sentences of a small grammar, answered alike by this engine and by the sqlite3 that Python brings."""

import random
import re
import sqlite3

import pytest

from quillon.plans.run import query
from quillon.sources.parquet import relation

#: What a symbol may become; the first of each symbol ends it.  Only forms that both engines define alike.
GRAMMAR = {
    "N": [
        "#n", "@n", "(N + N)", "(N - N)", "(N * #k)", "(N / #d)", "(N % #d)", "(- N)", "abs(N)", "length(T)", "instr(T, T)", "coalesce(N, N, N)",
        "nullif(N, N)", "min(N, N)", "max(N, N, N, N)", "CASE WHEN B THEN N WHEN B THEN N ELSE N END", "CASE N WHEN N THEN N ELSE N END", "ifnull(N, #n)",
    ],
    "T": [
        "#t", "@t", "(T || T)", "lower(T)", "upper(T)", "trim(T)", "ltrim(T, #t)", "rtrim(T)", "replace(T, #t, T)", "substr(T, N)", "substr(T, #s, #s)",
        "substr(T, N, N)", "CAST(N AS TEXT)", "coalesce(T, #t)", "CASE WHEN B THEN T END", "nullif(T, #t)", "max(T, T)",
    ],
    "B": [
        "(N < N)", "(N >= N)", "(N = N)", "(T <> T)", "(T > T)", "(N IS NULL)", "(T IS NOT NULL)", "(N IS NOT N)", "(B AND B)", "(B OR B)", "(NOT B)",
        "(T LIKE #p)", "(T NOT LIKE T)", "(N BETWEEN N AND N)", "(N NOT IN (N, #n))", "(T IN (T, T, #t))",
    ],
}
TERMINALS = {
    "#n": lambda r: str(r.choice([0, 1, 2, 5, 8, 31, 64, 99]) * r.choice([1, 1, -1])),
    "#k": lambda r: str(r.randint(0, 6)),
    "#d": lambda r: r.choice(["2", "(-3)", "4", "10", "(-11)"]),
    "#s": lambda r: str(r.randint(-6, 6)),
    "#t": lambda r: "'" + r.choice(["", "fig", "Olive", "ÖL", "a_b", "50%", " pad ", "x\\y", "oO", "i"]) + "'",
    "#p": lambda r: "'" + r.choice(["%i%", "_l%", "o%E", "%", "", "a__", "%\\%", "Öl", "%d "]) + "'",
}
SYMBOL = re.compile(r"#[nkdstp]|@[nt]|\b[NTB]\b(?=[\s,)]|$)")


def sentence(r: random.Random, symbol: str, columns: dict, budget: int) -> str:
    """A random derivation: leftmost symbol first, rules that end once the budget is used up."""
    text, used = f"{symbol}", 0
    while m := SYMBOL.search(text):
        s = m[0]
        if s in TERMINALS:
            new = TERMINALS[s](r)
        elif s[0] == "@":
            new = r.choice(columns[s[1]])
        else:
            used += 1
            rules = GRAMMAR[s]
            new = r.choice(rules) if used < budget else r.choice(rules[:2]) if s != "B" else rules[r.choice([0, 3, 5])]
        # what is done is set aside, so that names and texts aren't taken for symbols
        text = text[: m.start()] + (new if s in GRAMMAR else hold(new)) + text[m.end() :]
    return release(text)


HELD: list[str] = []


def hold(text: str) -> str:
    HELD.append(text)
    return f"\x00{len(HELD) - 1}\x01"


def release(text: str) -> str:
    return re.sub("\x00(\\d+)\x01", lambda m: HELD[int(m[1])], text)


FRUIT = [(10, 4, "fig"), (20, None, "Olive"), (30, -31, None), (40, 0, ""), (50, 64, "ÖL 50%"), (60, 4, "oO")]
STALL = [(4, "fig"), (4, "oO"), (-31, None), (None, "Olive"), (64, "x"), (20, "fig")]


@pytest.fixture(scope="module")
def both(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE fruit (code INTEGER PRIMARY KEY, weight INTEGER, kind TEXT)")
    con.executemany("INSERT INTO fruit VALUES (?, ?, ?)", FRUIT)
    con.execute("CREATE TABLE stall (place INTEGER, sells TEXT)")
    con.executemany("INSERT INTO stall VALUES (?, ?)", STALL)
    return con, {
        "fruit": relation(spark.createDataFrame(FRUIT, "code bigint, weight bigint, kind string"), ["code"]),
        "stall": relation(spark.createDataFrame(STALL, "place bigint, sells string")),
    }


def plain(rows):
    return [tuple(int(v) if isinstance(v, bool) else v for v in r) for r in rows]


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_expressions(spark, both, seed):
    con, tables = both
    r = random.Random(seed)
    exprs = [sentence(r, "NTB"[k % 3], {"n": ["code", "weight"], "t": ["kind"]}, 9) for k in range(72)]
    text = "SELECT " + ", ".join(f"{e} AS e{k}" for k, e in enumerate(exprs)) + " FROM fruit ORDER BY code"
    want, got = con.execute(text).fetchall(), plain(query(spark, text, tables).rows())
    for k, e in enumerate(exprs):
        assert [row[k] for row in got] == [row[k] for row in want], e


#: Statements with places for an expression over fruit (F), over both tables (G), and a word to choose.
SHAPES = [
    "SELECT code, sells FROM fruit [|LEFT ]JOIN stall ON G WHERE F",
    "SELECT code, sells FROM fruit LEFT JOIN stall ON place = weight AND G WHERE sells IS [|NOT ]NULL OR F",
    "SELECT count(*), sum(weight), max(kind), count(DISTINCT weight), sum(DISTINCT weight) FROM fruit WHERE F",
    "SELECT sells, count(*), min(place) FROM stall GROUP BY sells HAVING count(*) [<|>=] 2",
    "SELECT weight, count(kind) FROM fruit WHERE F GROUP BY weight",
    "SELECT code FROM fruit WHERE weight [|NOT ]IN (SELECT place FROM stall WHERE G)",
    "SELECT code FROM fruit WHERE [|NOT ]EXISTS (SELECT 1 FROM stall WHERE sells = kind AND G) AND F",
    "SELECT code, kind IN (SELECT sells FROM stall WHERE G), (SELECT count(*) FROM stall WHERE G) FROM fruit",
    "SELECT code, (SELECT max(place) FROM stall WHERE sells = kind HAVING count(*) [=|>] 1) FROM fruit",
    "SELECT code FROM fruit WHERE weight IN (SELECT min(place) FROM stall GROUP BY sells) AND F",
    "SELECT fruit.code, stall.place FROM fruit LEFT JOIN stall ON EXISTS (SELECT 1 FROM stall s WHERE s.sells = kind AND s.place = stall.place) AND G",
    "SELECT DISTINCT weight, length(kind) FROM fruit WHERE F",
]


@pytest.mark.parametrize("seed", [21, 22])
def test_queries(spark, both, seed):
    con, tables = both
    r = random.Random(seed)
    for shape in SHAPES:
        text = re.sub(r"\[([^\]]*)\]", lambda m: r.choice(m[1].split("|")), shape)
        text = re.sub(r"\bF\b", lambda m: hold(sentence(r, "B", {"n": ["code", "weight"], "t": ["kind"]}, 4)), text)
        text = release(re.sub(r"\bG\b", lambda m: hold(sentence(r, "B", {"n": ["place", "weight"], "t": ["sells", "kind"]}, 4)), text))
        want, got = con.execute(text).fetchall(), plain(query(spark, text, tables).rows())
        assert sorted(map(repr, got)) == sorted(map(repr, want)), text
