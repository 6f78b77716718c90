"""Statements that change a database.  Each takes a state and gives the next one.

VALUES lists are as long as the statement's text, so inserts and upserts work row by
row on the driver, against the few stored rows that their keys meet, which one join
finds.  UPDATE and DELETE rewrite the parts that have a row to change, as DataFrames; nothing of
them is collected.  Small parts are merged as they come together.
"""

from __future__ import annotations

import datetime
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import CheckFailed, DuplicateKey, EngineError, Exists, LimitExceeded, NotFound, NotNull, SqlError, TypeMismatch
from quillon.functions import bridge as B
from quillon.plans import ast, printer
from quillon.plans.compile import Col, Compiler, Ctx, Rel, Scope, Typed
from quillon.plans.compile import Table as ScopeTable
from quillon.plans.parser import parse_expr
from quillon.plans.run import translate
from quillon.sources.catalog import MAX_COLUMNS, MAX_INDEXES, Column, Index, State, Storage, Table


@dataclass
class Outcome:
    rows_affected: int = 0
    last_insert_id: int | None = None


def execute(storage: Storage, state: State, stmt, params=()) -> tuple[State, Outcome]:
    """The next state; the given one stays as it is, whatever happens."""
    how = {ast.CreateTable: create_table, ast.CreateIndex: create_index, ast.Drop: drop, ast.AlterAdd: alter, ast.Insert: insert, ast.Update: update, ast.Delete: delete}.get(type(stmt))
    if how is None:
        raise SqlError(*stmt.pos, "this statement gives rows: query it")
    try:
        new = state.copy()
        outcome = how(storage, new, stmt, list(params))
        return new, outcome
    except SqlError:
        raise
    except EngineError as e:
        raise SqlError(*stmt.pos, str(e), e) from e
    except Exception as e:
        raised = translate(e, stmt.pos)
        if raised is e:
            raise
        raise raised from e


def compiler(storage: Storage, state: State, params=()) -> Compiler:
    return Compiler(storage.spark, lambda n: storage.relation(state.tables[n]) if n in state.tables else None, params)


def scoped(c: Compiler, t: Table, df: DataFrame, alias: str | None = None, clause: str = "WHERE") -> Ctx:
    """A context in which a table's columns are read under their ids."""
    cols = [Col(x.name, x.type, x.id, t.hidden and k == 0) for k, x in enumerate(t.columns)]
    scope = Scope([ScopeTable(alias or t.name, cols)])
    return Ctx(Rel(df, scope, [], []), scope, clause=clause)


# definitions


def constant(e: ast.Expr | None, column: ast.ColumnDef) -> tuple[str | None, object]:
    """(printed default, its value)."""
    if e is None:
        return None, None
    if isinstance(e, ast.Call):
        if column.type != "TIMESTAMP":
            raise TypeMismatch(f"CURRENT_TIMESTAMP does not fit {column.type}")
        return "CURRENT_TIMESTAMP", None
    return printer.show(e), fitted(e.value, e.type, column.type, column.name)


def fitted(value, kind: str | None, want: str, name: str):
    """A value for a column of type ``want``; INTEGER goes into REAL where it is exact."""
    if value is None or kind == want:
        return value
    if kind == "INTEGER" and want == "REAL":
        if int(float(value)) != value:
            raise TypeMismatch(f"{value} is not exact as REAL in column {name}")
        return float(value)
    raise TypeMismatch(f"column {name} is {want}, the value is {kind}")


def create_table(storage: Storage, state: State, s: ast.CreateTable, params) -> Outcome:
    if s.name in state.tables and s.if_not_exists:
        return Outcome()
    state.free_name(s.name, "table")
    names = [c.name for c in s.columns]
    for n in names:
        if names.count(n) > 1:
            raise Exists(f"column {n} is there twice")
        if n.lower() == "rowid":
            raise Exists("a column cannot be called rowid")
    if not names:
        raise EngineError("a table needs a column")
    t = Table(s.name, [], list(s.primary), not s.primary)
    if t.hidden:
        t.add("rowid", "INTEGER", nullable=False)
        t.key = ["rowid"]
    for n in s.primary:
        if n not in names or s.primary.count(n) > 1:
            raise NotFound(f"primary key column {n} is unknown or there twice")
    auto = len(s.primary) == 1 and next(c.type for c in s.columns if c.name == s.primary[0]) == "INTEGER"
    for c in s.columns:
        text, value = constant(c.default, c)
        not_null = c.not_null or c.name in s.primary
        if text == "NULL" and not_null:
            raise NotNull(f"column {c.name} is NOT NULL and its default NULL")
        if text is not None and auto and c.name in s.primary:
            raise EngineError(f"column {c.name} counts by itself and takes no default")
        t.add(c.name, c.type, nullable=not not_null, default=text)
    if len(t.columns) > MAX_COLUMNS:
        raise LimitExceeded(f"a table has at most {MAX_COLUMNS} columns")
    state.tables[s.name] = t
    for e in [e for c in s.columns for e in c.checks] + s.checks:
        add_check(storage, state, t, e)
    sets: list[set[str]] = [set(t.key)]
    for cols in s.uniques:
        for n in cols:
            if n not in names or cols.count(n) > 1:
                raise NotFound(f"unique column {n} is unknown or there twice")
        if set(cols) not in sets:
            sets.append(set(cols))
            k = 1
            while f"{s.name}_unique_{k}" in state.indexes or f"{s.name}_unique_{k}" in state.tables:
                k += 1
            state.indexes[f"{s.name}_unique_{k}"] = Index(f"{s.name}_unique_{k}", s.name, list(cols), True)
    state.schema_version += 1
    return Outcome()


def add_check(storage: Storage, state: State, t: Table, e: ast.Expr) -> None:
    for x in ast.walk(e):
        if isinstance(x, ast.Param):
            raise SqlError(*x.pos, "a parameter is not allowed in CHECK")
    c = compiler(storage, state)
    c.boolean(e, scoped(c, t, storage.rows(t), clause="CHECK"), "CHECK")
    t.checks.append(printer.show(e))


def create_index(storage: Storage, state: State, s: ast.CreateIndex, params) -> Outcome:
    if s.name in state.indexes and s.if_not_exists:
        return Outcome()
    state.free_name(s.name, "index")
    t = state.table(s.table)
    for n in s.columns:
        if t.column(n) is None or s.columns.count(n) > 1:
            raise NotFound(f"column {n} is unknown or there twice")
    if sum(i.table == s.table for i in state.indexes.values()) >= MAX_INDEXES:
        raise LimitExceeded(f"a table has at most {MAX_INDEXES} indexes")
    if s.unique:
        no_duplicates(t, storage.rows(t), f"index {s.name}", s.columns)
    state.indexes[s.name] = Index(s.name, s.table, list(s.columns), s.unique)
    state.schema_version += 1
    return Outcome()


def no_duplicates(t: Table, rows: DataFrame, what: str, names: list[str]) -> None:
    ids = [t.column(n).id for n in names]
    full = reduce(lambda a, b: a & b, [F.col(i).isNotNull() for i in ids])
    twice = rows.filter(full).groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).collect()
    if twice:
        raise DuplicateKey(f"duplicate key {tuple(twice[0])[:-1]!r} in {what}")


def drop(storage: Storage, state: State, s: ast.Drop, params) -> Outcome:
    held = state.tables if s.kind == "TABLE" else state.indexes
    if s.name not in held:
        if s.if_exists:
            return Outcome()
        raise NotFound(f"no such {s.kind.lower()}: {s.name}")
    del held[s.name]
    if s.kind == "TABLE":
        state.indexes = {n: i for n, i in state.indexes.items() if i.table != s.name}
    state.schema_version += 1
    return Outcome()


def alter(storage: Storage, state: State, s: ast.AlterAdd, params) -> Outcome:
    t, c = state.table(s.table), s.column
    if c.primary or c.unique:
        raise EngineError("an added column cannot be PRIMARY KEY or UNIQUE")
    if t.column(c.name) is not None or c.name.lower() == "rowid":
        raise Exists(f"column {c.name} is there already")
    text, value = constant(c.default, c)
    if text == "CURRENT_TIMESTAMP":
        raise EngineError("an added column takes no CURRENT_TIMESTAMP")
    if c.not_null and value is None:
        raise NotNull(f"column {c.name} is NOT NULL and needs a default")
    if len(t.columns) >= MAX_COLUMNS:
        raise LimitExceeded(f"a table has at most {MAX_COLUMNS} columns")
    t.add(c.name, c.type, nullable=not c.not_null, default=text, fill=value)
    before = len(t.checks)
    for e in c.checks:
        add_check(storage, state, t, e)
    check_rows(storage, state, t, storage.rows(t), t.checks[before:])
    state.schema_version += 1
    return Outcome()


def check_rows(storage: Storage, state: State, t: Table, rows: DataFrame, checks: list[str]) -> None:
    """An error if a row makes a check FALSE."""
    for text in checks:
        c = compiler(storage, state)
        ok = c.boolean(parse_expr(text), scoped(c, t, rows, clause="CHECK"), "CHECK")
        if rows.filter(~F.coalesce(ok.col, F.lit(True))).limit(1).count():
            raise CheckFailed(f"CHECK {text} failed in table {t.name}")


# rows


def value_rows(storage: Storage, state: State, rows: list[list[ast.Expr]], params) -> list[list[tuple[object, str | None]]]:
    """(value, type) of every expression of a VALUES list, in one job at most."""
    c = compiler(storage, state, params)
    one = Rel(storage.spark.range(1).select(F.lit(1).alias(c.fresh())), Scope([]), [], [])
    out, wanted = [], []
    for r in rows:
        line = []
        for e in r:
            t = c.expr(e, Ctx(one, one.scope, clause="VALUES"))
            if isinstance(e, ast.Lit | ast.Param):
                line.append((t.value, t.type))
            else:
                line.append(len(wanted))
                wanted.append(t)
        out.append(line)
    if wanted:
        got = one.df.select(*[(t.col if t.type else t.col.cast("string")).alias(f"v{k}") for k, t in enumerate(wanted)]).first()
        out = [[(plain(got[x]), wanted[x].type) if isinstance(x, int) else x for x in r] for r in out]
    return out


def plain(v):
    return bytes(v) if isinstance(v, bytearray) else v


def local_frame(storage: Storage, t: Table, rows: list[list], extra: str = "") -> DataFrame:
    schema = storage.schema(t)
    return storage.spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], schema)


def insert(storage: Storage, state: State, s: ast.Insert, params) -> Outcome:
    t = state.table(s.table)
    names = s.columns if s.columns is not None else [c.name for c in t.visible()]
    for n in names:
        if t.column(n) is None:
            raise SqlError(*s.pos, f"no such column: {n}")
        if names.count(n) > 1:
            raise SqlError(*s.pos, f"column {n} is there twice")
    for r in s.rows:
        if len(r) != len(names):
            raise SqlError(*r[0].pos, f"{len(names)} columns and {len(r)} values")
    given = value_rows(storage, state, s.rows, params)
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    auto = t.key[0] if len(t.key) == 1 and t.column(t.key[0]).type == "INTEGER" else None
    defaults = {c.name: now if c.default == "CURRENT_TIMESTAMP" else fitted(*_lit(c.default), c.type, c.name) for c in t.columns if c.default is not None}
    rows: list[list] = []
    place = {c.name: k for k, c in enumerate(t.columns)}
    for line in given:
        row = [defaults.get(c.name) for c in t.columns]
        for n, (v, kind) in zip(names, line):
            row[place[n]] = fitted(v, kind, t.column(n).type, n)
        rows.append(row)
    return put(storage, state, t, rows, auto, s.upsert, params)


def _lit(text: str):
    e = parse_expr(text)
    if isinstance(e, ast.Unary):
        return -e.x.value, e.x.type
    return e.value, e.type


def row_key(row: list, places: list[int]):
    """A key's values, None if one is NULL; -0.0 is 0.0."""
    k = tuple(0.0 if row[p] == 0 and isinstance(row[p], float) else row[p] for p in places)
    return None if any(v is None for v in k) else k


def put(storage: Storage, state: State, t: Table, rows: list[list], auto: str | None, upsert: ast.Upsert | None, params) -> Outcome:
    """Insert rows one after another: key, NOT NULL, CHECK, conflict, write."""
    place = {c.name: k for k, c in enumerate(t.columns)}
    uniques = [(what, cols, [place[n] for n in cols]) for what, cols in state.uniques(t.name)]
    stored = storage.rows(t)
    if auto is not None and any(r[place[auto]] is None for r in rows):
        top = stored.agg(F.max(t.column(auto).id)).first()[0]
        for r in rows:
            k = place[auto]
            if r[k] is None:
                if top is not None and top >= 2**63 - 1:
                    raise EngineError("there is no next key")
                r[k] = 1 if top is None else top + 1
            top = r[k] if top is None else max(top, r[k])
    for r in rows:
        for c in t.columns:
            v = r[place[c.name]]
            if v is None and (not c.nullable or c.name in t.key):
                raise NotNull(f"column {c.name} of {t.name} is NULL")
            if c.name in t.key and isinstance(v, float) and math.isnan(v):
                raise NotNull(f"key column {c.name} of {t.name} is NaN")
    if t.checks:
        check_rows(storage, state, t, local_frame(storage, t, rows), t.checks)
    target = None
    if upsert is not None and upsert.target is not None:
        for k, (_, cols, _) in enumerate(uniques):
            if set(cols) == set(upsert.target) and len(upsert.target) == len(cols):
                target = k
        if target is None:
            raise SqlError(*upsert.pos, f"ON CONFLICT ({', '.join(upsert.target)}) is no key of {t.name}")
    if upsert is not None and upsert.target is None and upsert.sets is not None and len(uniques) == 0:
        raise SqlError(*upsert.pos, "there is no key to conflict with")

    # stored rows that any new key meets; the new rows are few, so they are the broadcast side
    maps: list[dict] = [{} for _ in uniques]
    live: dict[int, list] = {}
    old: dict[int, tuple] = {}
    fresh = local_frame(storage, t, rows).toDF(*[f"n_{c.id}" for c in t.columns])
    met = None
    for _, cols, _ in uniques:
        ids = [t.column(n).id for n in cols]
        hit = stored.join(F.broadcast(fresh), [F.col(i) == F.col(f"n_{i}") for i in ids], "left_semi")
        met = hit if met is None else met.unionByName(hit)
    number = 0
    for r in {tuple(plain(v) for v in r) for r in met.collect()} if t.parts else ():
        live[number], old[number] = list(r), r
        for m, (_, _, places) in zip(maps, uniques):
            if (k := row_key(r, places)) is not None:
                m[k] = number
        number += 1
    changed: set[int] = set()
    added: list[int] = []
    affected, last = 0, None
    pending: list[tuple[int, list]] = []

    def flush() -> None:
        nonlocal affected
        if not pending:
            return
        for (n, _), (keep, new) in zip(pending, updated(storage, state, t, upsert, [(live[n], ex) for n, ex in pending], params)):
            if not keep:
                continue
            before = live[n]
            for c in t.columns:
                if new[place[c.name]] is None and (not c.nullable or c.name in t.key):
                    raise NotNull(f"column {c.name} of {t.name} is NULL")
            for m, (what, _, places) in zip(maps, uniques):
                a, b = row_key(before, places), row_key(new, places)
                if b != a:
                    if b is not None and (m.get(b, n) != n or stored_key(b, what)):
                        raise DuplicateKey(f"duplicate key {b!r} in {what} of {t.name}")
                    if a is not None:
                        m.pop(a, None)
                    if b is not None:
                        m[b] = n
            live[n] = new
            affected += 1
            if n in old:
                changed.add(n)
        if t.checks:
            check_rows(storage, state, t, local_frame(storage, t, [live[n] for n, _ in pending]), t.checks)
        pending.clear()

    def stored_key(key, what) -> bool:
        """Is there a stored row of this key that was not met and is not changed?"""
        cols = next(c for w, c, _ in uniques if w == what)
        places = next(p for w, _, p in uniques if w == what)
        if any(row_key(o, places) == key for o in old.values()):
            return False  # its present place is in the map
        cond = reduce(lambda a, b: a & b, [F.col(t.column(n).id) == B.literal(v, t.column(n).type) for n, v in zip(cols, key)])
        return bool(t.parts) and stored.filter(cond).limit(1).count() > 0

    for r in rows:
        keys = [row_key(r, places) for _, _, places in uniques]
        hits = [m.get(k) if k is not None else None for m, k in zip(maps, keys)]
        if pending and any(h is not None and h in {n for n, _ in pending} for h in hits) or pending and upsert.sets and {n for _, n, _ in upsert.sets} & {c for _, cols, _ in uniques for c in cols}:
            flush()
            hits = [m.get(k) if k is not None else None for m, k in zip(maps, keys)]
        which = [k for k, h in enumerate(hits) if h is not None]
        if which:
            if upsert is None or target is not None and target not in which:
                raise DuplicateKey(f"duplicate key {keys[which[0]]!r} in {uniques[which[0]][0]} of {t.name}")
            if upsert.sets is None:
                continue
            pending.append((hits[target if target is not None else which[0]], r))
            continue
        live[number] = r
        for m, k in zip(maps, keys):
            if k is not None:
                m[k] = number
        added.append(number)
        number += 1
        affected += 1
        last = r[place[t.key[0]]] if auto is not None else None
    flush()
    if changed:
        gone = local_frame(storage, t, [list(old[n]) for n in changed]).select(*[F.col(t.column(n).id) for n in t.key])
        keys = [t.column(n).id for n in t.key]
        hit = storage.rows(t, marked=True).join(F.broadcast(gone), keys, "left_semi").select("_part").distinct().collect()
        parts = [p for p in t.parts if p.name in {r[0] for r in hit}]
        kept = storage.rows(t, parts).join(F.broadcast(gone), keys, "left_anti")
        storage.replace(t, {p.name for p in parts}, storage.write(t, kept.select(*[c.id for c in t.columns])))
    fresh_rows = [live[n] for n in (*sorted(changed), *added)]
    if fresh_rows:
        t.parts.append(storage.write(t, local_frame(storage, t, fresh_rows).coalesce(1)))
        storage.tidy(t)
    return Outcome(affected, last)


def updated(storage: Storage, state: State, t: Table, upsert: ast.Upsert, pairs: list[tuple[list, list]], params) -> list[tuple[bool, list]]:
    """(does WHERE hold, the new row) for pairs of stored and excluded rows, in one job."""
    c = compiler(storage, state, params)
    rows = [[k, *a, *b] for k, (a, b) in enumerate(pairs)]
    schema = "_k bigint, " + ", ".join(f"{x.id} {B.SPARK[x.type]}" for x in t.columns) + ", " + ", ".join(f"x_{x.id} {B.SPARK[x.type]}" for x in t.columns)
    df = storage.spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], schema)
    ctx = scoped(c, t, df, clause="DO UPDATE")
    # unqualified names are the stored row's
    ctx.scope.tables[0].cols = [Col(x.name, x.type, x.id, False) for x in t.columns]
    outer = Scope([ScopeTable("excluded", [Col(x.name, x.type, f"x_{x.id}", False) for x in t.columns])])
    ctx.scope.parent = outer
    where = c.boolean(upsert.where, ctx, "WHERE").col if upsert.where is not None else F.lit(True)
    sets = assignments(c, t, upsert.sets, ctx)
    keep = F.coalesce(where, F.lit(False))
    got = df.select("_k", keep.alias("_keep"), *[(F.when(keep, sets[x.name]).otherwise(F.col(x.id)) if x.name in sets else F.col(x.id)).alias(x.id) for x in t.columns]).orderBy("_k").collect()
    return [(r[1], [plain(v) for v in r[2:]]) for r in got]


def assignments(c: Compiler, t: Table, sets, ctx: Ctx) -> dict[str, SparkColumn]:
    out: dict[str, SparkColumn] = {}
    for pos, name, e in sets:
        col = t.column(name)
        if col is None:
            raise SqlError(*pos, f"no such column: {name}")
        if name in out:
            raise SqlError(*pos, f"column {name} is set twice")
        v = c.expr(e, ctx)
        out[name] = fitting(v, col, e.pos)
    return out


def fitting(v: Typed, col: Column, pos) -> SparkColumn:
    if v.type is None:
        return B.null(col.type)
    if v.type == col.type:
        return v.col.cast(B.SPARK[col.type])
    if v.type == "INTEGER" and col.type == "REAL":
        i = v.col.cast("bigint")
        d = i.cast("double")
        exact = (F.abs(d) < 2.0**63) & (F.when(F.abs(d) < 2.0**63, d).cast("bigint") == i)
        return F.when(i.isNull() | exact, d).otherwise(B.fail(pos, f"INTEGER is not exact as REAL in column {col.name}", "REAL"))
    raise SqlError(*pos, f"column {col.name} is {col.type}, the value is {v.type}")


def update(storage: Storage, state: State, s: ast.Update, params) -> Outcome:
    t = state.table(s.table)
    parts = hit_parts(storage, state, t, s.where, params, s.sets)
    c = compiler(storage, state, params)
    ctx = scoped(c, t, storage.rows(t, [p for p in t.parts if p.name in parts]))
    hit = F.lit(True)
    if s.where is not None:
        hit = F.coalesce(c.boolean(s.where, ctx, "WHERE").col, F.lit(False))
    ctx.clause = "SET"
    sets = assignments(c, t, s.sets, ctx)
    marked = ctx.rel.df.withColumn("_hit", hit)
    olds = [F.col(x.id).alias(f"o_{x.id}") for x in t.columns]
    new = marked.select("_hit", *olds, *[(F.when(F.col("_hit"), sets[x.name]).otherwise(F.col(x.id)) if x.name in sets else F.col(x.id)).alias(x.id) for x in t.columns])
    if not parts:
        return Outcome()
    new = new.persist()
    try:
        touched = new.filter("_hit")
        for x in t.columns:
            if x.name in sets and (not x.nullable or x.name in t.key) and touched.filter(F.col(x.id).isNull()).limit(1).count():
                raise NotNull(f"column {x.name} of {t.name} is NULL")
        if t.checks:
            check_rows(storage, state, t, touched, t.checks)
        for what, names in state.uniques(t.name):
            if set(names) & set(sets):
                rest = storage.rows(t, [p for p in t.parts if p.name not in parts])
                no_duplicates(t, new.select(*rest.columns).unionByName(rest), f"{what} of {t.name}", names)
                no_transient(t, touched, f"{what} of {t.name}", names)
        storage.replace(t, set(parts), storage.write(t, new))
    finally:
        new.unpersist()
    return Outcome(sum(parts.values()))


def hit_parts(storage: Storage, state: State, t: Table, where: ast.Expr | None, params, sets=()) -> dict[str, int]:
    """Rows that WHERE holds for, by part; only these parts are written again."""
    c = compiler(storage, state, params)
    ctx = scoped(c, t, storage.rows(t, marked=True))
    if where is None:
        return {p.name: p.rows for p in t.parts}
    hit = c.boolean(where, ctx, "WHERE").col
    found = ctx.rel.df.filter(hit).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per part
    return {r["_part"]: r["n"] for r in found}


def no_transient(t: Table, touched: DataFrame, what: str, names: list[str]) -> None:
    """Rows are written in key order: a new key must not be the old key of a later row."""
    ids = [t.column(n).id for n in names]
    order = F.struct(*[F.col(f"o_{t.column(n).id}") for n in t.key])
    a = touched.select(order.alias("_a"), *[F.col(i).alias(f"n_{i}") for i in ids])
    b = touched.select(order.alias("_b"), *[F.col(f"o_{i}").alias(f"b_{i}") for i in ids])
    clash = a.join(b, [F.col(f"n_{i}") == F.col(f"b_{i}") for i in ids] + [F.col("_a") < F.col("_b")])
    if clash.limit(1).count():
        raise DuplicateKey(f"duplicate key in {what}")


def delete(storage: Storage, state: State, s: ast.Delete, params) -> Outcome:
    t = state.table(s.table)
    parts = hit_parts(storage, state, t, s.where, params)
    if s.where is None:
        t.parts = []
    elif parts:
        c = compiler(storage, state, params)
        ctx = scoped(c, t, storage.rows(t, [p for p in t.parts if p.name in parts]))
        hit = F.coalesce(c.boolean(s.where, ctx, "WHERE").col, F.lit(False))
        storage.replace(t, set(parts), storage.write(t, ctx.rel.df.filter(~hit).select(*[x.id for x in t.columns])))
    return Outcome(sum(parts.values()))


