"""From trees to DataFrames: names, static types, grouping, subqueries.

Every column gets an internal name of its own, so none of Spark's rules about aliases,
ordinals, case or lateral references ever apply.  Nothing runs here but LIMIT
expressions that aren't constants; the result is a lazy DataFrame.

Subqueries of any depth are made flat: the distinct values of the outer columns that a
subquery reads (its domain) are joined into its FROM, carried through its grouping and
limits, reduced to a row each, and joined back null-safely.  EXISTS, NOT EXISTS and IN
at the top of WHERE become semi and anti joins where the subquery is a plain one.  An
EXISTS with equalities and one other comparison asks for the greatest or least value of
each group, so rows are never paired.  A join whose ON has no equality but a point of one
side between two bounds of the other is a join by equality, too (see ranges).
"""

from __future__ import annotations

import datetime
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.errors import SessionError, SqlError
from quillon.functions import bridge as B
from quillon.plans import ast, printer, ranges
from quillon.plans.parser import deep

#: Chains of arithmetic with more terms than CHAIN are checked at their end, with DEEP and more they are folds over arrays, which keeps trees flat.
CHAIN, DEEP = 16, 128
AGGREGATES = {"count", "sum", "avg", "min", "max"}
_NONE = object()


@dataclass
class Real:
    """A tree of + - * over doubles whose steps aren't checked: a step that overflows leaves an
    infinity or NaN, which no later step takes away, so the result tells."""

    leaves: list[tuple[Column, int, bool]]  # operands, their nodes, and whether they are finite for sure
    raw: Callable[[list[Column]], Column]  # of the operands
    stepwise: Callable[[list[Column]], tuple[Column, int]]  # the same with every step checked, and its nodes
    pos: tuple[int, int]
    steps: int = 1

    @property
    def size(self) -> int:
        return sum(n if n > B.LIGHT else 4 * n for _, n, _ in self.leaves) + 4 * len(self.leaves) + 4 * self.steps

    def checked(self) -> Column:
        def whole(*xs: Column) -> Column:
            raw, ok = self.raw(list(xs)), F.lit(True)
            for x, (_, _, sure) in zip(xs, self.leaves):
                ok = ok if sure else ok & B.finite(x)
            failed = B.fail(self.pos, "REAL overflow", "REAL")
            if self.steps == 1:
                return F.when(~B.finite(raw) & ok, failed).otherwise(raw)
            return F.when(~B.finite(raw), F.when(ok, failed).otherwise(self.stepwise(list(xs))[0])).otherwise(raw)

        return B.let([(x, n) for x, n, _ in self.leaves], whole)


class Typed:
    """A column with its type; value: of a literal; size: nodes of the expression, about."""

    def __init__(self, col: Column | None, type: str | None, value: Any = _NONE, can_fail: bool = False, size: int | None = None, real: Real | None = None):
        self._col, self.type, self.value, self.can_fail, self.size, self.real = col, type, value, can_fail, size, real

    @property
    def col(self) -> Column:
        if self._col is None:
            self._col = self.real.checked()
        return self._col

    def but(self, **changed) -> Typed:
        how = {"col": self._col, "type": self.type, "value": self.value, "can_fail": self.can_fail, "size": self.size, "real": self.real} | changed
        return Typed(**how)

    @property
    def weighed(self) -> tuple[Column, int]:
        return self.col, self.size or 1


@dataclass(frozen=True)
class Col:
    name: str
    type: str | None
    id: str
    hidden: bool = False
    kind: str = ""  # Spark type where the dialect has none


@dataclass
class Table:
    alias: str
    cols: list[Col]


@dataclass
class Relation:
    """What the catalog knows of a table: df has the columns by position."""

    df: DataFrame
    cols: list[tuple[str, str | None]]
    hidden: int = 0  # so many columns at the start are hidden
    key: list[str] = field(default_factory=list)


@dataclass
class Scope:
    tables: list[Table]
    parent: Scope | None = None
    remap: dict[str, Col] | None = None  # after grouping: columns that are keys

    def own(self, n: ast.Name) -> Col | None:
        hits = [(t, c) for t in self.tables if n.table is None or t.alias == n.table for c in t.cols if c.name == n.name and (n.table is not None or not c.hidden or c.name == "rowid")]
        if len(hits) > 1:
            raise SqlError(*n.pos, f"column {n.name} is ambiguous")
        return hits[0][1] if hits else None

    def resolve(self, n: ast.Name) -> Col:
        s: Scope | None = self
        while s is not None:
            c = s.own(n)
            if c is not None:
                if s.remap is not None:
                    if c.id not in s.remap:
                        raise SqlError(*n.pos, f"column {n.name} is neither grouped nor aggregated")
                    c = s.remap[c.id]
                return c
            s = s.parent
        what = f"{n.table}.{n.name}" if n.table else n.name
        raise SqlError(*n.pos, f"no such column: {what}")


@dataclass
class Rel:
    df: DataFrame
    scope: Scope
    domain: list[str]
    key: list[Col]
    joined: bool = False


@dataclass
class Ctx:
    rel: Rel
    scope: Scope
    keymap: dict[str, Col] | None = None
    aggmap: dict[str, Typed] | None = None
    clause: str = ""
    only_true: bool = False


@dataclass
class _Derived:
    """Columns made of the arguments of aggregates: the first of equal values in a group, and the parts of doubles that are summed."""

    firsts: dict[str, str]
    parts: dict[str, tuple[str, str]]


@dataclass
class _Extreme:
    """An EXISTS whose conjuncts are local ones, equalities of local and outer expressions, and one comparison op of the two."""

    inner: list[ast.Expr]
    pairs: list[tuple[ast.Expr, ast.Expr]]  # (local, outer)
    op: str
    local: ast.Expr
    outer: ast.Expr


@dataclass
class Out:
    df: DataFrame
    cols: list[Col]
    domain: list[str]
    single: bool = False  # exactly one row for each row of the domain


class Compiler:
    def __init__(self, spark: SparkSession, lookup: Callable[[str], Relation | None], params: tuple | list = ()):
        if spark.conf.get("spark.sql.ansi.enabled") != "true":
            raise SessionError("spark.sql.ansi.enabled must be true: integer overflow is an error")
        self.spark, self.lookup, self.params = spark, lookup, params
        self._ids = itertools.count()
        self._nodes = 0  # of the operands compiled so far of the expression at hand

    def fresh(self) -> str:
        return f"c{next(self._ids)}"

    # sources

    def table(self, s: ast.Source, taken: list[Table]) -> tuple[Table, DataFrame, Relation]:
        found = self.lookup(s.table)
        if found is None:
            raise SqlError(*s.pos, f"no such table: {s.table}")
        alias = s.alias or s.table
        if any(t.alias == alias for t in taken):
            raise SqlError(*s.pos, f"table name {alias} is used twice")
        cols = []
        for k, (n, kind) in enumerate(found.cols):
            cols.append(Col(n, kind, self.fresh(), k < found.hidden, "" if kind else found.df.schema[k].dataType.simpleString()))
        return Table(alias, cols), found.df.toDF(*[c.id for c in cols]), found

    def from_(self, q: ast.Select, outer: Scope | None, domain: tuple[DataFrame, list[str]] | None) -> Rel:
        scope = Scope([], outer)
        df, ids = domain if domain else (None, [])
        rel = Rel(df if df is not None else self.spark.range(1).select(F.lit(1).alias(self.fresh())), scope, list(ids), [])
        for k, s in enumerate(q.sources):
            t, right, found = self.table(s, scope.tables)
            if k == 0:
                rel.df = rel.df.crossJoin(right) if domain else right
                scope.tables.append(t)
                rel.key = [c for c in t.cols if c.name in found.key]
                continue
            rel.joined, rel.key = True, []
            scope.tables.append(t)
            on = s.on
            if isinstance(on, ast.Lit) and on.value is True and s.join == "INNER":
                rel.df = rel.df.crossJoin(right)
            elif _has_query(on):
                self.join_on_query(rel, right, s)
            else:
                cond = self.boolean(on, Ctx(rel, scope, clause="ON", only_true=True), "ON")
                if s.join == "INNER":
                    rel.df = self.matched(rel, right, _conjuncts(on), cond.col)
                elif self.band(rel, right, _conjuncts(on)) is not None:
                    self.join_on_query(rel, right, s)
                else:
                    rel.df = rel.df.join(right, cond.col, "left")
        return rel

    def matched(self, rel: Rel, right: DataFrame, parts: list[ast.Expr], cond: Column | None) -> DataFrame:
        """The inner join under cond (all pairs where it is None) of rows that may make all of parts true."""
        found = self.band(rel, right, parts)
        if found is None:
            return rel.df.join(right, cond, "inner") if cond is not None else rel.df.crossJoin(right)
        low, high, at, on_right = found
        a, b = (rel.df, right) if on_right else (right, rel.df)
        df = ranges.join(a, low, high, b, at, cond if cond is not None else F.lit(True), [self.fresh() for _ in range(6)])
        return df.select(*rel.df.columns, *right.columns)

    def band(self, rel: Rel, right: DataFrame, parts: list[ast.Expr]) -> tuple[Column, Column, Column, bool] | None:
        """Places of two bounds on one side and of a point between them on the other, and whether the point is on the right.

        None where no conjuncts are such, or an equality joins the sides anyway.
        """
        ctx, sides = Ctx(rel, rel.scope, clause="ON"), {**dict.fromkeys(rel.df.columns, False), **dict.fromkeys(right.columns, True)}

        def side(e: ast.Expr) -> bool | None:
            if _has_query(e):
                return None
            on = {sides.get(rel.scope.resolve(n).id) for n in ast.walk(e) if isinstance(n, ast.Name)}
            return on.pop() if len(on) == 1 else None

        bounds: dict[tuple[bool, str], dict[str, tuple[ast.Expr, ast.Expr, int]]] = {}
        for p in parts:
            compared = [(p.op, p.left, p.right)] if isinstance(p, ast.Binary) and p.op in B._FLIP else [(">=", p.x, p.lo), ("<=", p.x, p.hi)] if isinstance(p, ast.Between) and not p.neg else []
            for op, a, b in compared:
                if None in (side(a), side(b)) or side(a) == side(b) or op == "!=":
                    continue
                types = {self.expr(e, ctx).type for e in (a, b)}
                if op == "=":
                    if len(types) == 1:
                        return None
                    continue
                for o, x, y in ((op, a, b), (B._FLIP[op], b, a)):
                    (x, c), (y, d) = (_shifted(x), _shifted(y)) if types == {"INTEGER"} else ((x, 0), (y, 0))
                    step = (types == {"INTEGER"}) * {">": 1, "<": -1}.get(o, 0)  # so that bounds belong to their interval
                    bounds.setdefault((side(x), self.canon(x, rel.scope)), {}).setdefault(o[0], (x, y, d - c + step))
        for (on_right, _), of in bounds.items():
            if len(of) == 2:
                (x, low, up), (_, high, down) = of[">"], of["<"]
                kinds = {self.expr(e, ctx).type for e in (x, low, high)}
                kind = "REAL" if kinds == {"INTEGER", "REAL"} else kinds.pop() if len(kinds) == 1 else None
                point, ends = self.soft(x, ctx), [self.soft(e, ctx) for e in (low, high)]
                if kind not in ("INTEGER", "REAL", "TIMESTAMP") or point is None or None in ends or not point[1] or max(abs(up), abs(down)) >= 2**62:
                    continue
                at = point[0].cast("double") if kind == "REAL" else point[0]
                at = ranges.place(F.when(~F.isnan(at), at) if kind == "REAL" else at, kind)
                first, last = (ranges.bound(v, leaf, leaves, kind, k, top) for (v, leaf, leaves), k, top in zip(ends, (up, down), (False, True)))
                return first, last, at, on_right
        return None

    def soft(self, e: ast.Expr, ctx: Ctx) -> tuple[Column, bool, list[Column]] | None:
        """A value without errors: NULL where an INTEGER step overflows, not finite where a REAL one does; whether it has no steps; what its steps read.

        None where it may fail otherwise.
        """
        t = self.expr(e, ctx)
        if isinstance(e, ast.Unary) and e.op == "-":
            e = ast.Binary(e.pos, "-", ast.Lit(e.pos, 0.0 if t.type == "REAL" else 0, t.type), e.x)
        if isinstance(e, ast.Binary) and e.op in ("+", "-", "*") and t.type in ("INTEGER", "REAL"):
            a, b = self.soft(e.left, ctx), self.soft(e.right, ctx)
            if a is None or b is None:
                return None
            if t.type == "REAL":
                return B.unchecked(e.op, a[0].cast("double"), b[0].cast("double")), False, a[2] + b[2]
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](a[0], b[0]), False, a[2] + b[2]
        if t.type is None or t.can_fail or any(isinstance(x, ast.Unary) and x.op != "NOT" or isinstance(x, ast.Binary) and x.op in ("+", "-", "*") for x in ast.walk(e)):
            return None
        return _wide(t), True, [_wide(t)]

    def join_on_query(self, rel: Rel, right: DataFrame, s: ast.Source) -> None:
        """A join with a subquery in ON: plain conjuncts join, the others filter what they let through.

        For LEFT that is done for the distinct values that ON reads of the left side, to
        which the rows are joined back by value.
        """
        plain = [p for p in _conjuncts(s.on) if not _has_query(p)]
        asked = [p for p in _conjuncts(s.on) if _has_query(p)]
        left, scope, back = rel.df, rel.scope, {}
        if s.join == "LEFT":
            names = [n for p in plain + asked for x in ast.walk(p) for n in ([x] if isinstance(x, ast.Name) else self.free(x.query, []) if getattr(x, "query", None) else [])]
            for c in (scope.resolve(n) for n in names):
                if c.id in rel.df.columns:
                    back.setdefault(c.id, self.fresh())
            left = rel.df.select(*[F.col(i).alias(d) for i, d in back.items()]).distinct() if back else self.spark.range(1).select(F.lit(1).alias(self.fresh()))
            scope = _carried(scope, back)
        both = Rel(left, scope, [i for i in rel.domain if s.join != "LEFT"], [], True)
        conds = [self.boolean(p, Ctx(both, scope, clause="ON", only_true=True), "ON") for p in plain]
        early = _all([t.col for t in conds if not t.can_fail])
        both.df = self.matched(both, right, plain, early if any(not t.can_fail for t in conds) else None)
        late = [t.col for t in conds if t.can_fail] + [self.boolean(p, Ctx(both, scope, clause="ON"), "ON").col for p in asked]
        both.df = both.df.filter(_in_turn(late)) if late else both.df
        if s.join == "INNER":
            rel.df = both.df.select(*rel.df.columns, *right.columns)
        else:
            kept = both.df.select(*back.values(), *right.columns)
            rel.df = rel.df.join(kept, _all([F.col(i).eqNullSafe(F.col(d)) for i, d in back.items()]), "left").drop(*back.values())

    # queries

    def query(self, q: ast.Select) -> Out:
        with deep():
            return self.select(q, None, None)

    def select(self, q: ast.Select, outer: Scope | None, domain: tuple[DataFrame, list[str]] | None) -> Out:
        rel = self.from_(q, outer, domain)
        scope = rel.scope
        if q.where is not None:
            self.filter(q.where, Ctx(rel, scope, clause="WHERE"))
        items = self.items(q, scope)
        order = self.order_terms(q, items)
        grouped = bool(q.group) or q.having is not None or any(_has_aggregate(e) for e, *_ in items) or any(_has_aggregate(e) for e, _ in order if isinstance(e, ast.Expr))
        single = False
        if grouped:
            if any(i.expr is None for i in q.items):
                raise SqlError(*next(i.pos for i in q.items if i.expr is None), "* does not go with grouping")
            ctx = self.group(q, rel, domain, [e for e, *_ in items] + [e for e, _ in order if isinstance(e, ast.Expr)])
            single = not q.group and q.having is None
            if q.having is not None:
                having = self.boolean(q.having, replace(ctx, clause="HAVING", only_true=True), "HAVING")
                rel.df = rel.df.filter(having.col)  # which the line above may have joined subqueries to
        else:
            ctx = Ctx(rel, scope, clause="SELECT")
        # values of the items and of sort keys as columns
        cols, exprs = [], []
        for e, name, c in items:
            t = Typed(F.col(c.id), c.type) if c else self.expr(e, ctx)
            out = Col(name, t.type, self.fresh(), kind=c.kind if c else "")
            cols.append(out)
            exprs.append((t.col, out.id))
        keys = []
        for e, desc in order:
            if isinstance(e, int):
                keys.append((cols[e].id, cols[e].type, desc))
            else:
                t = self.expr(e, replace(ctx, clause="ORDER BY"))
                i = self.fresh()
                exprs.append((t.col, i))
                keys.append((i, t.type, desc))
        ties: list[str] = []
        if not grouped and rel.key and (q.order or q.limit is not None) and not rel.joined:
            for c in rel.key:
                i = self.fresh()
                exprs.append((F.col(c.id), i))
                ties.append(i)
        df = rel.df.select(*[F.col(d) for d in rel.domain], *[x.alias(i) for x, i in exprs])
        if q.distinct:
            single = False
            rest = [i for _, i in exprs if i not in {c.id for c in cols}]
            group = [F.col(d) for d in rel.domain] + [_normal(c) for c in cols]
            if rest:
                by = F.struct(*[F.col(i) for i in ties]) if ties else F.lit(1)
                firsts = [F.min_by(F.struct(*[F.col(i) for i in rest]), by).alias("_r")]
                df = df.groupBy(*group).agg(*firsts).select(*rel.domain, *[c.id for c in cols], "_r.*")
            else:
                df = df.select(*group).distinct()
        sort = _sort(keys) + [F.col(i).asc_nulls_first() for i in ties]
        limit, offset = self.number(q.limit, "LIMIT"), self.number(q.offset, "OFFSET")
        if limit is not None and limit < 0:
            limit = None
        offset = max(offset or 0, 0)
        if rel.domain:
            if limit is not None or offset:
                single = False
                w = Window.partitionBy(*[F.col(d) for d in rel.domain]).orderBy(*(sort or [F.lit(1)]))
                n = self.fresh()
                df = df.withColumn(n, F.row_number().over(w)).filter((F.col(n) > offset) & (F.lit(True) if limit is None else F.col(n) <= offset + limit))
        else:
            if sort:
                df = df.orderBy(*sort)
            if offset:
                df = df.offset(offset)
                single = False
            if limit is not None:
                df = df.limit(limit)
                single = False
        return Out(df.select(*rel.domain, *[c.id for c in cols]), cols, rel.domain, single)

    def items(self, q: ast.Select, scope: Scope) -> list[tuple[ast.Expr, str, Col | None]]:
        """(expression, result name, column for *)."""
        out: list[tuple[ast.Expr, str, Col | None]] = []
        for i in q.items:
            if i.expr is not None:
                name = i.alias or (i.expr.name if isinstance(i.expr, ast.Name) else printer.show(i.expr))
                direct = None
                if isinstance(i.expr, ast.Name):
                    c = scope.own(i.expr)
                    direct = c if c is not None and c.type is None else None  # passes a column of a type we lack
                out.append((i.expr, name, direct))
                continue
            if not scope.tables:
                raise SqlError(*i.pos, "* needs a FROM")
            tables = [t for t in scope.tables if i.table is None or t.alias == i.table]
            if not tables:
                raise SqlError(*i.pos, f"no such table: {i.table}")
            out += [(ast.Name(i.pos, t.alias, c.name), c.name, c) for t in tables for c in t.cols if not c.hidden]
        return out

    def order_terms(self, q: ast.Select, items) -> list[tuple[ast.Expr | int, bool]]:
        out: list[tuple[ast.Expr | int, bool]] = []
        aliases = [i.alias for i in q.items]
        for e, desc in q.order:
            if isinstance(e, ast.Lit) and e.type == "INTEGER":
                if not 1 <= e.value <= len(items):
                    raise SqlError(*e.pos, f"ORDER BY {e.value} is out of range")
                out.append((e.value - 1, desc))
            elif isinstance(e, ast.Name) and e.table is None and e.name in aliases and not any(i.expr is None for i in q.items):
                out.append((aliases.index(e.name), desc))
            else:
                out.append((e, desc))
        return out

    def number(self, e: ast.Expr | None, what: str) -> int | None:
        if e is None:
            return None
        one = Rel(self.spark.range(1).select(F.lit(1).alias(self.fresh())), Scope([]), [], [])
        t = self.expr(e, Ctx(one, one.scope, clause=what))
        if t.type not in ("INTEGER", None):
            raise SqlError(*e.pos, f"{what} needs INTEGER, not {t.type}")
        value = t.value if t.value is not _NONE else one.df.select(t.col.alias("v")).first()[0]
        if value is None:
            raise SqlError(*e.pos, f"{what} is NULL")
        return int(value)

    # filters

    def boolean(self, e: ast.Expr, ctx: Ctx, what: str) -> Typed:
        t = self.expr(e, ctx)
        if t.type not in ("BOOLEAN", None):
            raise SqlError(*e.pos, f"{what} needs BOOLEAN, not {t.type}")
        return t.but(col=t.col.cast("boolean")) if t.type is None else t

    def filter(self, e: ast.Expr, ctx: Ctx) -> None:
        """Keep the rows of ctx.rel for which e is TRUE, conjunct by conjunct, wherever they stand."""
        late: list[Typed] = []
        for p in _conjuncts(e):
            if self.semi(p, ctx):
                continue
            t = self.boolean(p, ctx_true(ctx), ctx.clause)
            if t.can_fail:
                late.append(t)
            else:
                ctx.rel.df = ctx.rel.df.filter(t.col)
        # what can fail comes last, for rows that joins and all other conjuncts leave
        if late and ctx.rel.joined:
            ctx.rel.df = ctx.rel.df.filter(_in_turn([t.col for t in late]))
        else:
            for t in late:
                ctx.rel.df = ctx.rel.df.filter(t.col)

    def semi(self, e: ast.Expr, ctx: Ctx) -> bool:
        """[NOT] EXISTS or IN at the top of WHERE as a semi or anti join, if the subquery is plain."""
        neg = False
        while isinstance(e, ast.Unary) and e.op == "NOT":
            e, neg = e.x, not neg
        if isinstance(e, ast.Exists):
            q, x = e.query, None
        elif isinstance(e, ast.In) and e.query and e.neg == neg:
            q, x, neg = e.query, e.x, False
        else:
            return False
        return self.plain_semi(e, q, x, neg, ctx) or not neg and x is not None and self.any_semi(e, x, ctx)

    def any_semi(self, e: ast.In, x: ast.Expr, ctx: Ctx) -> bool:
        """x IN (subquery) as a semi join, whatever the subquery is: only TRUE counts."""
        self.may_query(e.query, ctx)
        out, pairs = self.subquery(e.query, ctx)
        if len(out.cols) != 1:
            raise SqlError(*e.pos, f"subquery has {len(out.cols)} columns, not 1")
        a, b = self.expr(x, ctx), Typed(F.col(out.cols[0].id), out.cols[0].type)
        self.comparable(a, b, e.pos)
        if a.can_fail or a.type is None or b.type is None:
            return False
        same = [B.compare("=", a.weighed, a.type, (b.col, 1), b.type, only_true=True)]
        ctx.rel.df = ctx.rel.df.join(out.df, _all(same + [F.col(i).eqNullSafe(F.col(d)) for i, d in pairs]), "left_semi")
        return True

    def plain_semi(self, e: ast.Expr, q: ast.Select, x: ast.Expr | None, neg: bool, ctx: Ctx) -> bool:
        parts = _conjuncts(q.where) if q.where is not None else []
        exprs = ast.select_exprs(q)
        if q.group or q.having or q.limit or q.offset or not q.sources or any(isinstance(y, ast.Scalar | ast.Exists) or isinstance(y, ast.In) and y.query or isinstance(y, ast.Call) and y.name in AGGREGATES for z in exprs for y in ast.walk(z)):
            return False
        if x is not None and (len(q.items) != 1 or q.items[0].expr is None):
            return False
        tables: list[Table] = []
        for s in q.sources:
            tables.append(self.table(s, tables)[0])
        own = Scope(tables)
        local = lambda z: all(own.own(n) is not None for n in ast.walk(z) if isinstance(n, ast.Name))
        if not all(local(s.on) for s in q.sources if s.on is not None):
            return False
        right = self.from_(ast.Select(q.pos, sources=q.sources), None, None)
        for p in parts:
            if local(p):
                self.filter(p, Ctx(right, right.scope, clause="WHERE"))
        if x is None:  # the list of an EXISTS is checked, not read
            for z, _, c in self.items(q, right.scope):
                if c is None and local(z):
                    self.expr(z, Ctx(Rel(right.df, right.scope, [], []), right.scope, clause="SELECT"))
        both = Scope(right.scope.tables, ctx.scope)
        inner = Ctx(right, both, clause="WHERE", only_true=True)
        conds = [self.boolean(p, inner, "WHERE") for p in parts if not local(p)]
        if any(t.can_fail for t in conds):
            return False
        found = self.extreme(q, ctx) if x is None else None
        if found is not None and (grouped := self.by_extreme(found, right, ctx)) is not None:
            df, on, t = grouped
            ctx.rel.df = ctx.rel.df.join(df, _all(on) & t.col, "left_anti" if neg else "left_semi")
            return True
        cond = _all([t.col for t in conds])
        if x is not None:
            a, b = self.expr(x, ctx), self.expr(q.items[0].expr, inner)
            self.comparable(a, b, e.pos)
            cond = B.compare("=", a.weighed, a.type, b.weighed, b.type, only_true=True) & cond
        ctx.rel.df = ctx.rel.df.join(right.df, cond, "left_anti" if neg else "left_semi")
        return True

    # grouping

    def canon(self, e: ast.Expr, scope: Scope) -> str:
        def named(n: ast.Name) -> str:
            try:
                c = scope.own(n)
                return f"#{c.id}" if c is not None else f"^{n.table or ''}.{n.name}"
            except SqlError:
                return f"?{n.table}.{n.name}"

        return printer.show(e, named)

    def group(self, q: ast.Select, rel: Rel, domain, exprs: list[ast.Expr]) -> Ctx:
        scope = rel.scope
        pre = Ctx(rel, scope, clause="GROUP BY")
        keymap: dict[str, Col] = {}
        remap: dict[str, Col] = {}
        key_cols = []
        for e in q.group:
            text = self.canon(e, scope)
            if text in keymap:
                continue
            if _has_aggregate(e):
                raise SqlError(*e.pos, "aggregate is not allowed in GROUP BY")
            t = self.expr(e, pre)
            c = Col(e.name if isinstance(e, ast.Name) else "", t.type, self.fresh())
            keymap[text] = c
            key_cols.append((_norm(t.col, t.type), c.id))
            if isinstance(e, ast.Name) and (own := scope.own(e)) is not None:
                remap[own.id] = c
        calls: dict[str, ast.Call] = {}
        for e in exprs + ([q.having] if q.having is not None else []):
            for x in _aggregates(e):
                calls.setdefault(self.canon(x, scope), x)
        aggs, args, aggmap, more = [], {}, {}, _Derived({}, {})
        for text, call in calls.items():
            arg, out = self.aggregate(call, replace(pre, clause="an aggregate"), args, more)
            i = self.fresh()
            aggs.append((arg, i, call.name == "count"))
            aggmap[text] = Typed(F.col(i), out)
        df = rel.df.select(*[F.col(d) for d in rel.domain], *[k.alias(i) for k, i in key_cols], *[a.alias(i) for a, i in args.values()])
        for value, first in more.firsts.items():  # one row of each value in a group
            same = Window.partitionBy(*rel.domain, *[i for _, i in key_cols], value).orderBy(F.lit(0))
            df = df.withColumn(first, F.when(F.row_number().over(same) == 1, F.col(value)))
        if more.parts:
            df = df.withColumns({whole: B.whole_part(F.col(x)) for x, (whole, _) in more.parts.items()})
            df = df.withColumns({part: B.fraction(F.col(x), F.col(whole)) for x, (whole, part) in more.parts.items()})
        computed = [a.alias(i) for a, i, _ in aggs] or [F.count(F.lit(1)).alias(self.fresh())]
        by = [F.col(d) for d in rel.domain] + [F.col(i) for _, i in key_cols]
        out = df.groupBy(*by).agg(*computed) if by else df.agg(*computed)
        if rel.domain and not key_cols:  # a row for each row of the domain, also over nothing
            every, ids = domain
            other = {d: self.fresh() for d in ids}
            out = out.select(*[F.col(d).alias(other[d]) if d in other else F.col(d) for d in out.columns])
            cond = F.lit(True)
            for d in ids:
                cond = cond & F.col(d).eqNullSafe(F.col(other[d]))
            out = every.join(out, cond, "left").drop(*other.values())
            counts = {i for _, i, is_count in aggs if is_count}
            out = out.select(*[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) if c in counts else F.col(c) for c in out.columns])
        rel.df, rel.key = out, []
        after = Scope(scope.tables, scope.parent, remap)
        rel.scope = after
        ctx = Ctx(rel, after, keymap, aggmap, "SELECT")
        return ctx

    def aggregate(self, c: ast.Call, ctx: Ctx, args: dict[str, tuple[Column, str]], more: _Derived) -> tuple[Column, str | None]:
        if c.star:
            if c.name != "count" or c.distinct:
                raise SqlError(*c.pos, f"{c.name}(*) is not allowed")
            return F.count(F.lit(1)), "INTEGER"
        if len(c.args) != 1:
            raise SqlError(*c.pos, f"{c.name} takes one argument")
        names = [n for n in ast.walk(c.args[0]) if isinstance(n, ast.Name)]
        if names and all(ctx.scope.own(n) is None for n in names):
            raise SqlError(*c.pos, f"{c.name} reads columns of an outer query only")
        t = self.expr(c.args[0], ctx)
        if c.name in ("sum", "avg") and t.type not in ("INTEGER", "REAL", None):
            raise SqlError(*c.pos, f"{c.name} needs a number, not {t.type}")
        _, i = args.setdefault(self.canon(c.args[0], ctx.scope), (t.col if t.type else t.col.cast("bigint"), self.fresh()))
        x = F.col(i)
        kind = t.type or "INTEGER"
        if c.name == "count":
            return (F.count_distinct(x) if c.distinct else F.count(x)), "INTEGER"
        if c.name in ("min", "max"):
            y = F.when(~F.isnan(x), x) if kind == "REAL" else x
            out = F.min(y) if c.name == "min" else F.max(y)
            return (F.coalesce(out, F.max(x)) if kind == "REAL" else out), t.type
        if kind == "INTEGER":
            if c.name == "sum":
                return (F.sum_distinct(x) if c.distinct else F.sum(x)), "INTEGER"
            d = x.cast("decimal(38,0)")
            total, n = (F.sum_distinct(d), F.count_distinct(x)) if c.distinct else (F.sum(d), F.count(x))
            return total.cast("double") / F.when(n != 0, n), "REAL"
        if c.distinct:
            i = more.firsts.setdefault(i, self.fresh())
            x = F.col(i)
        whole, part = more.parts.setdefault(i, (self.fresh(), self.fresh()))
        n, total = F.count(x), B.digit_total(B.digit_sums(x, F.col(whole), F.col(part)), c.pos)
        return (total if c.name == "sum" else total / F.when(n != 0, n)), "REAL"

    # subqueries

    def free(self, q: ast.Select, above: list[Scope]) -> list[ast.Name]:
        """Names in a query that its own tables and those of ``above`` don't have."""
        tables: list[Table] = []
        for s in q.sources:
            tables.append(self.table(s, tables)[0])
        chain = [Scope(tables), *above]
        aliases = {i.alias for i in q.items if i.alias}
        skip = {id(e) for e, _ in q.order if isinstance(e, ast.Name) and e.table is None and e.name in aliases}
        out = []
        for e in ast.select_exprs(q):
            for x in ast.walk(e):
                if isinstance(x, ast.Name) and id(x) not in skip and all(s.own(x) is None for s in chain):
                    out.append(x)
                elif isinstance(x, ast.Scalar | ast.Exists | ast.In) and getattr(x, "query", None):
                    out += self.free(x.query, chain)
        return out

    def may_query(self, q: ast.Select, ctx: Ctx) -> None:
        if ctx.clause in ("CHECK", "DO UPDATE", "DEFAULT"):
            raise SqlError(*q.pos, f"a subquery is not allowed in {ctx.clause}")

    def subquery(self, q: ast.Select, ctx: Ctx) -> tuple[Out, list[tuple[str, str]]]:
        """The compiled query and (column of ctx.rel, column of the domain) pairs."""
        if ctx.clause in ("LIMIT", "OFFSET") and self.free(q, []):
            raise SqlError(*q.pos, f"{ctx.clause} cannot read outer columns")
        refs: dict[str, str] = {}
        for n in self.free(q, []):
            c = ctx.scope.resolve(n)
            refs.setdefault(c.id, self.fresh())
        if not refs:
            return self.select(q, Scope([], None), None), []
        dom = ctx.rel.df.select(*[F.col(i).alias(d) for i, d in refs.items()]).distinct()
        outer = _carried(ctx.scope, refs)
        return self.select(q, outer, (dom, list(refs.values()))), list(refs.items())

    def attach(self, ctx: Ctx, sub: DataFrame, pairs: list[tuple[str, str]], extra: Column | None = None) -> None:
        """Join a frame with a row per row of the domain (or one row) to the relation."""
        if not pairs and extra is None:
            ctx.rel.df = ctx.rel.df.crossJoin(F.broadcast(sub))  # one row
            return
        cond = extra if extra is not None else F.lit(True)
        for a, b in pairs:
            cond = cond & F.col(a).eqNullSafe(F.col(b))
        ctx.rel.df = ctx.rel.df.join(sub, cond, "left").drop(*[b for _, b in pairs])

    def scalar(self, e: ast.Scalar, ctx: Ctx) -> Typed:
        if not e.query.sources and len(e.query.items) == 1 and e.query.items[0].expr is not None and not (e.query.where or e.query.having or e.query.group or e.query.limit or _has_aggregate(e.query.items[0].expr)):
            return self.expr(e.query.items[0].expr, ctx)  # (SELECT x) is x
        found = self.by_key(e.query, ctx)
        if found is not None:
            return found
        out, pairs = self.subquery(e.query, ctx)
        if len(out.cols) != 1:
            raise SqlError(*e.pos, f"subquery has {len(out.cols)} columns, not 1")
        c = out.cols[0]
        if out.single:
            self.attach(ctx, out.df, pairs)
            return Typed(F.col(c.id), c.type)
        n, v = self.fresh(), self.fresh()
        agg = [F.count(F.lit(1)).alias(n), F.first(F.col(c.id)).alias(v)]
        sub = out.df.groupBy(*out.domain).agg(*agg) if pairs else out.df.agg(*agg)
        self.attach(ctx, sub, pairs)
        return Typed(F.when(F.col(n) > 1, B.fail(e.pos, "subquery has more than one row", c.type)).otherwise(F.col(v)), c.type, can_fail=True)

    def by_key(self, q: ast.Select, ctx: Ctx) -> Typed | None:
        """An aggregate over rows that equal outer columns, as one grouping by what equals them and a left join.

        None where the subquery is another kind of one.  A row without a partner, and one
        with a NULL, gets the aggregates over nothing.
        """
        exprs = ast.select_exprs(q)
        if not q.sources or q.group or q.having or q.order or q.limit or q.offset or q.distinct or q.where is None or len(q.items) != 1 or not _has_aggregate(q.items[0].expr) or any(_has_query(x) for x in exprs):
            return None
        tables: list[Table] = []
        for s in q.sources:
            tables.append(self.table(s, tables)[0])
        own = Scope(tables)
        names = lambda x: [n for n in ast.walk(x) if isinstance(n, ast.Name)]
        local = lambda x: all(own.own(n) is not None for n in names(x))
        inner, pairs = [], []
        for c in _conjuncts(q.where):
            if local(c):
                inner.append(c)
                continue
            sides = [(c.left, c.right), (c.right, c.left)] if isinstance(c, ast.Binary) and c.op == "=" else []
            pair = next(((a, b) for a, b in sides if names(a) and local(a) and isinstance(b, ast.Name) and own.own(b) is None), None)
            if pair is None:
                return None
            pairs.append(pair)
        if not pairs or not all(local(x) for x in [q.items[0].expr, *(s.on for s in q.sources if s.on is not None)]):
            return None
        right = self.from_(ast.Select(q.pos, sources=q.sources), None, None)
        before = Ctx(right, right.scope, clause="WHERE")
        typed = [(self.expr(a, before), self.expr(b, ctx)) for a, b in pairs]
        if any(a.type is None or a.type != b.type or a.type == "REAL" or a.can_fail for a, b in typed):
            return None
        for c in inner:
            self.filter(c, before)
        grouped = ast.Select(q.pos, items=q.items, sources=q.sources, group=[a for a, _ in pairs])
        after = self.group(grouped, right, None, [q.items[0].expr])
        keys = [after.keymap[self.canon(a, right.scope)].id for a, _ in pairs]
        ctx.rel.df = ctx.rel.df.join(right.df, _all([b.col == F.col(k) for (_, b), k in zip(typed, keys)]), "left").drop(*keys)
        counts = {self.canon(x, right.scope) for x in _aggregates(q.items[0].expr) if x.name == "count"}
        aggs = {k: t.but(col=F.coalesce(t.col, F.lit(0).cast("bigint"))) if k in counts else t for k, t in after.aggmap.items()}
        return self.expr(q.items[0].expr, replace(after, rel=ctx.rel, keymap={}, aggmap=aggs, scope=replace(after.scope, remap={})))

    def extreme(self, q: ast.Select, ctx: Ctx) -> _Extreme | None:
        """The parts of an EXISTS that the greatest or least value of a group decides; None where it is another kind of one."""
        exprs = ast.select_exprs(q)
        if not q.sources or q.where is None or q.group or q.having or q.order or q.limit or q.offset or any(_has_query(x) or _has_aggregate(x) for x in exprs):
            return None
        tables: list[Table] = []
        for s in q.sources:
            tables.append(self.table(s, tables)[0])
        own = Scope(tables)
        names = lambda x: [n for n in ast.walk(x) if isinstance(n, ast.Name)]
        local = lambda x: all(own.own(n) is not None for n in names(x))
        if not all(local(s.on) for s in q.sources if s.on is not None):
            return None
        inner, pairs, compared = [], [], []
        for c in _conjuncts(q.where):
            if local(c):
                inner.append(c)
                continue
            sides = [(c.op, c.left, c.right), (B._FLIP[c.op], c.right, c.left)] if isinstance(c, ast.Binary) and c.op in B._FLIP else []
            side = next((t for t in sides if names(t[1]) and local(t[1]) and all(own.own(n) is None for n in names(t[2]))), None)
            if side is None:
                return None
            if side[0] == "=":
                pairs.append(side[1:])
            else:
                compared.append(side)
        return _Extreme(inner, pairs, *compared[0]) if len(compared) == 1 else None

    def by_extreme(self, x: _Extreme, right: Rel, ctx: Ctx) -> tuple[DataFrame, list[Column], Typed] | None:
        """right, with the local conjuncts applied, as a row per group; its equalities with ctx.rel; and the test of a group that is there."""
        at = Ctx(right, right.scope, clause="WHERE")
        pairs = [(self.expr(a, at), self.expr(b, ctx)) for a, b in x.pairs]
        value, outer = self.expr(x.local, at), self.expr(x.outer, ctx)
        if value.type is None or outer.type is None or value.can_fail or any(a.type is None or a.type != b.type or a.type == "REAL" or a.can_fail or b.can_fail for a, b in pairs):
            return None
        keys, v = [self.fresh() for _ in pairs], self.fresh()
        y = F.when(~F.isnan(F.col(v)), F.col(v)) if value.type == "REAL" else F.col(v)  # NaN compares as unknown
        ends = {e: self.fresh() for e in ({"<": [F.min], "<=": [F.min], ">": [F.max], ">=": [F.max]}.get(x.op) or [F.min, F.max])}
        df = right.df.select(*[a.col.alias(k) for (a, _), k in zip(pairs, keys)], value.col.alias(v))
        aggs = [f(y).alias(i) for f, i in ends.items()]
        df = df.groupBy(*keys).agg(*aggs) if keys else F.broadcast(df.groupBy(F.lit("")).agg(*aggs).select(*ends.values()))  # one row, or none
        tests = [B.compare(x.op, (F.col(i), 1), value.type, outer.weighed, outer.type, b_value=outer.value) for i in ends.values()]
        return df, [b.col == F.col(k) for (_, b), k in zip(pairs, keys)], Typed(reduce(lambda a, b: a | b, tests), "BOOLEAN", can_fail=outer.can_fail)

    def exists_by_extreme(self, e: ast.Exists, ctx: Ctx) -> Typed | None:
        """EXISTS as a flag, by one grouping of its rows and a left join; None where that doesn't do."""
        q = e.query
        found = self.extreme(q, ctx) if ctx.clause not in ("LIMIT", "OFFSET") else None
        if found is None:
            return None
        right = self.from_(ast.Select(q.pos, sources=q.sources), None, None)
        before = Ctx(right, right.scope, clause="WHERE", only_true=True)
        if any(self.boolean(c, before, "WHERE").can_fail for c in found.inner):  # it may not be run for rows without a partner
            return None
        both = Ctx(Rel(right.df, right.scope, [], []), Scope(right.scope.tables, ctx.scope), clause="WHERE")
        for c in _conjuncts(q.where):
            self.boolean(c, both, "WHERE")
        for z, _, c in self.items(q, right.scope):  # checked, not read
            if c is None:
                self.expr(z, replace(both, clause="SELECT"))
        for c in found.inner:
            self.filter(c, before)
        grouped = self.by_extreme(found, right, ctx)
        if grouped is None:
            return None
        df, on, t = grouped
        there = self.fresh()
        df = df.withColumn(there, F.lit(True)) if on else F.broadcast(df.withColumn(there, F.lit(True)))
        ctx.rel.df = ctx.rel.df.join(df, _all(on), "left")
        return Typed(F.coalesce(F.when(F.col(there), t.col), F.lit(False)), "BOOLEAN", can_fail=t.can_fail)

    def exists(self, e: ast.Exists, ctx: Ctx) -> Typed:
        """As a flag joined to the rows; at the top of WHERE see semi."""
        found = self.exists_by_extreme(e, ctx)
        if found is not None:
            return found
        out, pairs = self.subquery(e.query, ctx)
        n = self.fresh()
        sub = out.df.select(*out.domain).distinct().withColumn(n, F.lit(1)) if pairs else out.df.limit(1).agg(F.count(F.lit(1)).alias(n))
        self.attach(ctx, sub, pairs)
        return Typed(F.coalesce(F.col(n), F.lit(0)) > 0, "BOOLEAN")

    def in_query(self, e: ast.In, ctx: Ctx) -> Typed:
        out, pairs = self.subquery(e.query, ctx)
        if len(out.cols) != 1:
            raise SqlError(*e.pos, f"subquery has {len(out.cols)} columns, not 1")
        x, c = self.expr(e.x, ctx), out.cols[0]
        v = Typed(F.col(c.id), c.type)
        self.comparable(x, v, e.pos)
        n, has_null, hit, key = (self.fresh() for _ in range(4))
        stats = [F.count(F.lit(1)).alias(n), F.max(v.col.isNull()).alias(has_null)]
        set_ = out.df.filter(v.col.isNotNull())
        left, right = x.col, v.col
        if x.type == "INTEGER" and v.type == "REAL":
            whole = (v.col == F.floor(v.col)) & (v.col >= -(2.0**63)) & (v.col < 2.0**63)
            right = F.when(whole, F.when(whole, v.col).cast("bigint"))
        elif x.type == "REAL" and v.type == "INTEGER":
            whole = (x.col == F.floor(x.col)) & (x.col >= -(2.0**63)) & (x.col < 2.0**63)
            left = F.when(whole, F.when(whole, x.col).cast("bigint"))
        elif x.type == "REAL" or v.type == "REAL":
            right = F.when(~F.isnan(v.col), v.col)
        # domain columns twice: once for the counts, once for the values
        again = [self.fresh() for _ in out.domain]
        values = set_.select(*[F.col(d).alias(a) for d, a in zip(out.domain, again)], right.alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn(hit, F.lit(True))
        self.attach(ctx, out.df.groupBy(*out.domain).agg(*stats) if pairs else out.df.agg(*stats), pairs)
        self.attach(ctx, values, [(a, b) for (a, _), b in zip(pairs, again)], left == F.col(key))
        known = F.when(F.coalesce(F.col(n), F.lit(0)) == 0, F.lit(False)).when(x.col.isNull(), B.null("BOOLEAN")).when(F.col(hit), F.lit(True)).when(F.col(has_null), B.null("BOOLEAN")).otherwise(F.lit(False))
        return Typed(~known if e.neg else known, "BOOLEAN")

    # expressions

    def comparable(self, a: Typed, b: Typed, pos) -> None:
        if a.type and b.type and a.type != b.type and {a.type, b.type} != {"INTEGER", "REAL"}:
            raise SqlError(*pos, f"{a.type} and {b.type} do not compare")

    def one_type(self, ts: list[Typed], pos, what: str) -> str | None:
        kinds = {t.type for t in ts if t.type}
        if len(kinds) > 1:
            raise SqlError(*pos, f"{what} must have one type, not {' and '.join(sorted(kinds))}")
        return next(iter(kinds), None)

    def need(self, t: Typed, kinds: tuple[str, ...], pos, what: str) -> Typed:
        if t.type and t.type not in kinds:
            raise SqlError(*pos, f"{what} needs {' or '.join(kinds)}, not {t.type}")
        return t

    def expr(self, e: ast.Expr, ctx: Ctx) -> Typed:
        """The expression compiled, with its number of nodes: that of its operands, as often as it reads them."""
        outer, self._nodes = self._nodes, 0
        t = self.compiled(e, ctx)
        if t.size is None:
            t.size = 2 if getattr(e, "query", None) else 2 + self._nodes * (_READS.get(type(e), 1) if self._nodes <= B.LIGHT else 1)
        self._nodes = outer + t.size
        return t

    def compiled(self, e: ast.Expr, ctx: Ctx) -> Typed:
        if ctx.keymap:
            c = ctx.keymap.get(self.canon(e, ctx.scope)) if not isinstance(e, ast.Lit) else None
            if c is not None:
                return Typed(F.col(c.id), c.type)
        inner = replace(ctx, only_true=False) if ctx.only_true else ctx
        match e:
            case ast.Lit():
                return Typed(B.literal(e.value, e.type), e.type, e.value)
            case ast.Param():
                return self.param(e)
            case ast.Name():
                c = ctx.scope.resolve(e)
                if c.type is None and c.kind and c.kind != "void":
                    raise SqlError(*e.pos, f"column {e.name} has the type {c.kind}, which the dialect lacks")
                col = F.col(c.id)
                return Typed(col, c.type)
            case ast.Unary():
                if e.op == "NOT":
                    x = self.boolean(e.x, inner, "NOT")
                    return Typed(~x.col, "BOOLEAN", can_fail=x.can_fail)
                x = self.need(self.expr(e.x, inner), ("INTEGER", "REAL"), e.pos, e.op)
                if e.op == "+":
                    return x
                if x.type == "REAL":  # so that -(0.0) is 0.0
                    zero = Typed(F.lit(0.0), "REAL", 0.0, size=1)
                    return self.real("-", zero, x, e.pos)
                return Typed(B.let([(_wide(x), x.size)], lambda v: B.negate(v, e.pos)), x.type, can_fail=True)
            case ast.Binary():
                return self.binary(e, ctx, inner)
            case ast.Is():
                a, b = self.expr(e.left, inner), self.expr(e.right, inner)
                self.comparable(a, b, e.pos)
                if b.value is None:
                    same = a.col.isNull()
                else:
                    same = B.is_same(a.weighed, a.type, b.weighed, b.type)
                return Typed(~same if e.neg else same, "BOOLEAN", can_fail=a.can_fail or b.can_fail)
            case ast.In():
                if e.query:
                    self.may_query(e.query, ctx)
                    return self.in_query(e, inner)
                x, items = self.expr(e.x, inner), [self.expr(i, inner) for i in e.items]
                for i in items:
                    self.comparable(x, i, e.pos)
                if all(i.type == x.type and i.type not in ("REAL", None) and i.value is not _NONE for i in items):
                    hit = x.col.isin(*[i.col for i in items])
                else:
                    hit = B.let([x.weighed], lambda v: _balanced([B.compare("=", (v, 1), x.type, i.weighed, i.type, b_value=i.value).cast("boolean") for i in items], lambda a, b: a | b))
                return Typed(~hit if e.neg else hit, "BOOLEAN", can_fail=any(t.can_fail for t in (x, *items)))
            case ast.Between():
                x, lo, hi = (self.expr(y, inner) for y in (e.x, e.lo, e.hi))
                self.comparable(x, lo, e.pos)
                self.comparable(x, hi, e.pos)
                only = ctx.only_true and not e.neg
                r = B.let([x.weighed], lambda v: B.compare(">=", (v, 1), x.type, lo.weighed, lo.type, only, b_value=lo.value) & B.compare("<=", (v, 1), x.type, hi.weighed, hi.type, only, b_value=hi.value))
                return Typed(~r if e.neg else r, "BOOLEAN", can_fail=any(t.can_fail for t in (x, lo, hi)))
            case ast.Like():
                x, p = (self.need(self.expr(y, inner), ("TEXT",), e.pos, "LIKE") for y in (e.x, e.pattern))
                r = B.like(x.col.cast("string"), p.col.cast("string"), p.value if isinstance(p.value, str) else None)
                return Typed(~r if e.neg else r, "BOOLEAN", can_fail=x.can_fail or p.can_fail)
            case ast.Exists():
                self.may_query(e.query, ctx)
                return self.exists(e, inner)
            case ast.Scalar():
                self.may_query(e.query, ctx)
                return self.scalar(e, inner)
            case ast.Cast():
                x = self.expr(e.x, inner)
                if x.type is None:
                    return Typed(B.null(e.type), e.type)
                if e.type not in B.CASTS[x.type]:
                    raise SqlError(*e.pos, f"no CAST from {x.type} to {e.type}")
                if e.type == "TIMESTAMP" and isinstance(x.value, str) and re.match(B._RFC3339, x.value):
                    try:  # a constant, which reaches the scan
                        at = datetime.datetime.fromisoformat(x.value).astimezone(datetime.UTC).replace(tzinfo=None)
                        return Typed(B.literal(at, "TIMESTAMP"), "TIMESTAMP", at)
                    except ValueError:
                        pass
                return Typed(B.let([(_wide(x), x.size)], lambda v: B.cast(v, x.type, e.type, e.pos)), e.type, can_fail=True)
            case ast.Case():
                return self.case(e, inner)
            case ast.Call():
                return self.call(e, inner)
        raise SqlError(*e.pos, "cannot compile this expression")

    def param(self, e: ast.Param) -> Typed:
        if e.n > len(self.params):
            raise SqlError(*e.pos, f"parameter ?{e.n} has no value")
        v = self.params[e.n - 1]
        kind = kind_of(v)
        if v is not None and kind is None or kind == "INTEGER" and not -(2**63) <= v < 2**63:
            raise SqlError(*e.pos, f"parameter ?{e.n} has a type that is not supported")
        if kind == "TIMESTAMP" and v.tzinfo is not None:
            v = v.astimezone(datetime.UTC).replace(tzinfo=None)
        if kind == "BLOB":
            v = bytes(v)
        return Typed(B.literal(v, kind), kind, v)

    def binary(self, e: ast.Binary, ctx: Ctx, inner: Ctx) -> Typed:
        if e.op in ("AND", "OR"):
            chain, x = [], e
            while isinstance(x, ast.Binary) and x.op == e.op:
                chain.append(x.right)
                x = x.left
            parts = [self.boolean(p, replace(ctx, only_true=ctx.only_true), e.op) for p in [x, *reversed(chain)]]
            if any(p.can_fail for p in parts[1:]):  # the right side isn't run where the left decides
                out = parts[-1].col
                for p in reversed(parts[:-1]):
                    out = F.when(p.col.eqNullSafe(F.lit(e.op == "OR")), F.lit(e.op == "OR")).otherwise(p.col & out if e.op == "AND" else p.col | out)
            else:
                out = _balanced([p.col for p in parts], (lambda a, b: a & b) if e.op == "AND" else (lambda a, b: a | b))
            return Typed(out, "BOOLEAN", can_fail=any(p.can_fail for p in parts))
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            a, b = self.expr(e.left, inner), self.expr(e.right, inner)
            self.comparable(a, b, e.pos)
            if a.type is None or b.type is None:
                return Typed(B.null("BOOLEAN"), "BOOLEAN", can_fail=a.can_fail or b.can_fail)
            return Typed(B.compare(e.op, a.weighed, a.type, b.weighed, b.type, ctx.only_true, a.value, b.value), "BOOLEAN", can_fail=a.can_fail or b.can_fail)
        # chains of one level lean left and may be long
        chain, x = [], e
        level = printer._LEVEL[e.op]
        while isinstance(x, ast.Binary) and printer._LEVEL[x.op] == level and not (ctx.keymap and x is not e and self.canon(x, ctx.scope) in ctx.keymap):
            chain.append(x)
            x = x.left
        left = self.expr(x, inner)
        if level == 1:
            parts = [left] + [self.expr(b.right, inner) for b in reversed(chain)]
            for p in parts:
                self.need(p, ("TEXT",), e.pos, "||")
            return Typed(F.concat(*[p.col.cast("string") for p in parts]), "TEXT", can_fail=any(p.can_fail for p in parts))
        rights = [(b, self.expr(b.right, inner)) for b in reversed(chain)]
        while rights:
            b, right = rights[0]
            for t in (left, right):
                self.need(t, ("INTEGER",) if b.op == "%" else ("INTEGER", "REAL"), b.pos, b.op)
            kind = "REAL" if "REAL" in (left.type, right.type) else "INTEGER" if left.type and right.type else None
            same = list(itertools.takewhile(lambda r: r[1].type and r[0].op != "%" if kind == "REAL" else r[1].type == kind, rights))
            risky = left.can_fail or any(t.can_fail for _, t in same)
            divides = any(c.op in "/%" for c, _ in same)
            if kind and left.type and len(same) > (CHAIN if divides or kind == "REAL" else DEEP):
                of = (lambda t: t.col.cast("double")) if kind == "REAL" else _wide
                if len(same) <= DEEP and not divides:
                    left, rights = self.real_chain(left, same), rights[len(same) :]
                    continue
                terms = [(c.op, of(t), c.pos) for c, t in same]
                left = Typed(B.fold(of(left), terms, kind), kind, can_fail=risky or kind == "REAL" or level == 2, size=left.size + sum(t.size for _, t in same) + 8 * len(same))
                rights = rights[len(same) :]
                continue
            rights = rights[1:]
            if left.type is None or right.type is None:
                left = Typed(B.null(kind), kind, can_fail=left.can_fail or right.can_fail, size=2)
            elif kind == "INTEGER":
                col = B.integer(b.op, (_wide(left), left.size), (_wide(right), right.size), b.pos)
                reads = 4 if b.op in "/%" and max(left.size, right.size) <= B.LIGHT else 1
                left = Typed(col, kind, can_fail=left.can_fail or right.can_fail or b.op in ("/", "%"), size=8 * (reads > 1) + 2 + reads * (left.size + right.size))
            else:
                left = self.real(b.op, left, right, b.pos)
        return left

    def real_chain(self, first: Typed, rest: list[tuple[ast.Binary, Typed]]) -> Typed:
        """A chain of + - *, checked at its end; where that fails, step by step."""
        terms = [first, *(t for _, t in rest)]
        xs, sizes = [t.col.cast("double") for t in terms], [t.size for t in terms]
        stepwise = B.fold(xs[0], [(c.op, x, c.pos) for (c, _), x in zip(rest, xs[1:])], "REAL")
        if max(sizes) > B.LIGHT:
            return Typed(stepwise, "REAL", can_fail=True, size=sum(sizes) + 8 * len(xs))
        raw = reduce(lambda a, step: B.unchecked(step[0], a, step[1]), zip([c.op for c, _ in rest], xs[1:]), xs[0])
        return Typed(F.when(~B.finite(raw), stepwise).otherwise(raw), "REAL", can_fail=True, size=3 * sum(sizes) + 8 * len(xs))

    def real(self, op: str, a: Typed, b: Typed, pos) -> Typed:
        """One step of REAL arithmetic; + - * go on as a tree that is checked at its top."""
        x, y = _real(a), _real(b)
        if op == "/":
            reads = 4 if max(a.size, b.size) <= B.LIGHT else 1
            return Typed(B.step("/", (a.col.cast("double"), a.size), (b.col.cast("double"), b.size), pos), "REAL", can_fail=True, size=12 + reads * (a.size + b.size))

        k = len(x.leaves)

        def stepwise(v: list[Column]) -> tuple[Column, int]:
            (p, m), (q, n) = x.stepwise(v[:k]), y.stepwise(v[k:])
            return B.step(op, (p, m), (q, n), pos), 8 + (m if m > B.LIGHT else 3 * m) + (n if n > B.LIGHT else 3 * n)

        tree = Real(x.leaves + y.leaves, lambda v: B.unchecked(op, x.raw(v[:k]), y.raw(v[k:])), stepwise, pos, 1 + x.steps + y.steps)
        return Typed(None, "REAL", can_fail=True, size=tree.size, real=tree)

    def case(self, e: ast.Case, ctx: Ctx) -> Typed:
        operand = self.expr(e.operand, ctx) if e.operand is not None else None
        tests, values = [], []
        for c, v in e.whens:
            tests.append(self.boolean(c, ctx, "WHEN") if operand is None else self.expr(c, ctx))
            if operand is not None:
                self.comparable(operand, tests[-1], c.pos)
            values.append(self.expr(v, ctx))
        default = self.expr(e.default, ctx) if e.default is not None else Typed(B.null(), None, None, size=1)
        kind = self.one_type([*values, default], e.pos, "CASE")

        def built(*x: Column) -> Column:
            out = F
            for t, v in zip(tests, values):
                cond = t.col if operand is None else B.compare("=", (x[0], 1), operand.type, t.weighed, t.type, b_value=t.value) if operand.type and t.type else B.null("BOOLEAN")
                out = out.when(cond, _typed(v, kind))
            return out.otherwise(_typed(default, kind))

        col = built() if operand is None else B.let([operand.weighed], built)
        every = [*tests, *values, default] + ([operand] if operand is not None else [])
        reads = 1 if operand is None or operand.size > B.LIGHT else len(tests)
        return Typed(col, kind, can_fail=any(t.can_fail for t in every), size=2 + sum(t.size for t in every) + (operand.size * reads if operand is not None else 0))

    def call(self, e: ast.Call, ctx: Ctx) -> Typed:
        if e.name in AGGREGATES and (e.star or e.distinct or len(e.args) < 2 or e.name not in ("min", "max")):
            if ctx.aggmap is not None and (t := ctx.aggmap.get(self.canon(e, ctx.scope))) is not None:
                return t
            raise SqlError(*e.pos, f"aggregate {e.name} is not allowed in {ctx.clause or 'this place'}")
        if e.distinct or e.star:
            raise SqlError(*e.pos, f"{e.name} takes no {'DISTINCT' if e.distinct else '*'}")
        how = FUNCTIONS.get(e.name)
        if how is None:
            raise SqlError(*e.pos, f"no such function: {e.name}")
        low, high, build = how
        if not low <= len(e.args) <= high:
            raise SqlError(*e.pos, f"{e.name} takes {low if low == high else f'{low} to {high}' if high < 99 else f'{low} or more'} arguments, not {len(e.args)}")
        args = [self.expr(a, ctx) for a in e.args]
        t = build(self, e, args)
        reads = 4 if max(a.size for a in args) <= B.LIGHT else 1
        return t.but(can_fail=t.can_fail or any(a.can_fail for a in args), size=12 + reads * sum(a.size for a in args))


# functions


def _text(c: Compiler, e: ast.Call, a: Typed, *kinds: str) -> Column:
    c.need(a, kinds or ("TEXT",), e.pos, e.name)
    return a.col if a.type else a.col.cast("string")


def _abs(c, e, a):
    c.need(a[0], ("INTEGER", "REAL"), e.pos, "abs")
    x = [(_wide(a[0]), a[0].size)]
    if a[0].type == "REAL":
        return Typed(B.let(x, lambda v: F.when(v < 0, -v).otherwise(v)), "REAL")
    return Typed(B.let(x, lambda v: F.when(v == -(2**63), B.fail(e.pos, "integer overflow", "INTEGER")).otherwise(F.abs(v))) if a[0].type else B.null("INTEGER"), a[0].type, can_fail=True)


def _length(c, e, a):
    x = _text(c, e, a[0], "TEXT", "BLOB")
    return Typed(F.length(x).cast("bigint"), "INTEGER")


def _fold(up):
    return lambda c, e, a: Typed(B.lettercase(_text(c, e, a[0]), up), "TEXT")


def _trim(name):
    def build(c, e, a):
        chars = _text(c, e, a[1]) if len(a) > 1 else F.lit(" ")
        return Typed({"trim": F.btrim, "ltrim": F.ltrim, "rtrim": F.rtrim}[name](_text(c, e, a[0]), chars), "TEXT")

    return build


def _replace(c, e, a):
    args = [(_text(c, e, t), t.size) for t in a]
    return Typed(B.let(args, lambda x, y, z: F.when(x.isNull() | y.isNull(), B.null("TEXT")).when(y == "", x).otherwise(F.replace(x, y, z))), "TEXT")


def _instr(c, e, a):
    x, y = (_text(c, e, t, "TEXT", "BLOB") for t in a)
    kind = c.one_type(a, e.pos, "arguments of instr")
    if kind == "BLOB":
        return Typed(B.bound(F.struct(x.alias("x"), y.alias("y")), lambda v: B.instr_blob(v["x"], v["y"])), "INTEGER")
    return Typed(F.call_function("instr", x, y).cast("bigint"), "INTEGER")


def _substr(c, e, a):
    x = _text(c, e, a[0], "TEXT", "BLOB")
    nums = [(c.need(t, ("INTEGER",), e.pos, "substr").col.cast("bigint"), t.size) for t in a[1:]]
    return Typed(B.substr((x, a[0].size), nums[0], nums[1] if len(nums) > 1 else None, a[0].type == "BLOB", a[1].value, a[2].value if len(a) > 2 else None), a[0].type or "TEXT")


def _coalesce(c, e, a):
    kind = c.one_type(a, e.pos, f"arguments of {e.name}")
    return Typed(F.coalesce(*[_typed(t, kind) for t in a]), kind)


def _nullif(c, e, a):
    c.comparable(a[0], a[1], e.pos)
    if a[0].type is None or a[1].type is None:
        return Typed(a[0].col, a[0].type)
    return Typed(B.let([a[0].weighed], lambda v: F.when(B.compare("=", (v, 1), a[0].type, a[1].weighed, a[1].type), B.null(a[0].type)).otherwise(v)), a[0].type)


def _extreme(name):
    def build(c, e, a):
        for t in a[1:]:
            c.comparable(a[0], t, e.pos)
        kinds = {t.type for t in a if t.type}
        if None in {t.type for t in a}:
            return Typed(B.null(next(iter(kinds), None)), next(iter(kinds), None))
        kind = "REAL" if len(kinds) > 1 else next(iter(kinds))
        cols = []
        for t in a:
            if kind == "REAL" and t.type == "INTEGER":  # one column has one type: only exact integers mix

                def as_real(i: Column) -> Column:
                    d = i.cast("double")
                    exact = (F.abs(d) < 2.0**63) & (F.when(F.abs(d) < 2.0**63, d).cast("bigint") == i)
                    return F.when(i.isNull() | exact, d).otherwise(B.fail(e.pos, "INTEGER is not exact as REAL", "REAL"))

                cols.append((B.let([(_wide(t), t.size)], as_real), 8 * t.size))
            else:
                cols.append((_wide(t), t.size))

        def best(*xs: Column) -> Column:
            bad = _balanced([x.isNull() | F.isnan(x) if kind == "REAL" else x.isNull() for x in xs], lambda p, q: p | q)
            # of equal ones, as 0.0 and -0.0, the last least and the first greatest
            return F.when(bad, B.null(kind)).otherwise(F.least(*reversed(xs)) if name == "min" else F.greatest(*xs))

        return Typed(B.let(cols, best), kind)

    return build


def _round(c, e, a):
    c.need(a[0], ("INTEGER", "REAL"), e.pos, "round")
    n = (c.need(a[1], ("INTEGER",), e.pos, "round").col.cast("bigint"), a[1].size) if len(a) > 1 else None
    return Typed(B.round_half((a[0].col.cast("double"), a[0].size + 1), n, a[1].value if n is not None else None), "REAL")


FUNCTIONS: dict[str, tuple[int, int, Callable]] = {
    "abs": (1, 1, _abs),
    "length": (1, 1, _length),
    "lower": (1, 1, _fold(False)),
    "upper": (1, 1, _fold(True)),
    "trim": (1, 2, _trim("trim")),
    "ltrim": (1, 2, _trim("ltrim")),
    "rtrim": (1, 2, _trim("rtrim")),
    "replace": (3, 3, _replace),
    "instr": (2, 2, _instr),
    "substr": (2, 3, _substr),
    "coalesce": (2, 99, _coalesce),
    "ifnull": (2, 2, _coalesce),
    "nullif": (2, 2, _nullif),
    "min": (2, 99, _extreme("min")),
    "max": (2, 99, _extreme("max")),
    "round": (1, 2, _round),
}


# helpers

#: How often an operator reads an operand, where that is more than once.
_READS = {ast.Is: 4, ast.In: 3, ast.Between: 4, ast.Cast: 6, ast.Unary: 3, ast.Binary: 2}


def kind_of(v: Any) -> str | None:
    for kind, types in (("BOOLEAN", bool), ("INTEGER", int), ("REAL", float), ("TEXT", str), ("BLOB", bytes | bytearray | memoryview), ("TIMESTAMP", datetime.datetime)):
        if isinstance(v, types):
            return kind
    return None


def _wide(t: Typed) -> Column:
    """int32 columns widen before arithmetic, so that overflow is that of 64 bits."""
    return t.col.cast("bigint") if t.type == "INTEGER" else t.col


def _typed(t: Typed, kind: str | None) -> Column:
    if t.type is None:
        return B.null(kind)
    return _wide(t)


def _norm(col: Column, kind: str | None) -> Column:
    return col if kind else col.cast("string")


def _normal(c: Col) -> Column:
    return F.col(c.id) if c.type or c.kind else F.col(c.id).cast("string").alias(c.id)


def _balanced(cols: list[Column], join: Callable) -> Column:
    """Join a long chain as a balanced tree, which Catalyst's recursion can stand."""
    while len(cols) > 1:
        cols = [join(cols[k], cols[k + 1]) if k + 1 < len(cols) else cols[k] for k in range(0, len(cols), 2)]
    return cols[0]


def _real(t: Typed) -> Real:
    """An operand of REAL arithmetic as a tree."""
    if t.real is not None and t._col is None:
        return t.real
    sure = t.type == "INTEGER" or isinstance(t.value, float) and abs(t.value) < float("inf")
    return Real([(t.col.cast("double") if t.type != "REAL" else t.col, t.size, sure)], lambda v: v[0], lambda v: (v[0], 1), (1, 1), 0)


def _shifted(e: ast.Expr) -> tuple[ast.Expr, int]:
    """An INTEGER expression without the literals that it ends on, and their sum."""
    total = 0
    while isinstance(e, ast.Binary) and e.op in ("+", "-") and isinstance(e.right, ast.Lit) and type(e.right.value) is int:
        total += e.right.value if e.op == "+" else -e.right.value
        e = e.left
    return e, total


def ctx_true(ctx: Ctx) -> Ctx:
    return replace(ctx, only_true=True)


def _has_query(e: ast.Expr) -> bool:
    return any(isinstance(x, ast.Scalar | ast.Exists) or isinstance(x, ast.In) and x.query for x in ast.walk(e))


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def _in_turn(conds: list[Column]) -> Column:
    """All TRUE, each looked at only if those before are; not pushed below a join."""
    cond = conds[-1]
    for c in reversed(conds[:-1]):
        cond = F.when(c, cond).otherwise(F.lit(False))
    return F.when(F.spark_partition_id() >= 0, cond)


def _conjuncts(e: ast.Expr) -> list[ast.Expr]:
    out = []
    while isinstance(e, ast.Binary) and e.op == "AND":
        out.append(e.right)
        e = e.left
    out.append(e)
    flat = []
    for x in reversed(out):
        flat += _conjuncts(x) if isinstance(x, ast.Binary) and x.op == "AND" else [x]
    return flat


def _aggregates(e: ast.Expr) -> list[ast.Call]:
    return [x for x in ast.walk(e) if isinstance(x, ast.Call) and x.name in AGGREGATES and (x.star or x.distinct or len(x.args) < 2 or x.name not in ("min", "max"))]


def _has_aggregate(e) -> bool:
    return isinstance(e, ast.Expr) and bool(_aggregates(e))


def _sort(keys: list[tuple[str, str | None, bool]]) -> list[Column]:
    """NULL, then NaN, then values; the other way round when descending."""
    out = []
    for i, kind, desc in keys:
        c = F.col(i)
        if kind == "REAL":
            rank = F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2)
            out.append(rank.desc() if desc else rank.asc())
        out.append(c.desc_nulls_last() if desc else c.asc_nulls_first())
    return out


def _carried(scope: Scope, refs: dict[str, str]) -> Scope:
    """The scope as an inner query sees it: columns under their names in the domain."""

    def moved(c: Col) -> Col:
        return replace(c, id=refs[c.id]) if c.id in refs else c

    parent = _carried(scope.parent, refs) if scope.parent is not None else None
    if scope.remap is not None:
        return Scope(scope.tables, parent, {k: moved(c) for k, c in scope.remap.items()})
    return Scope([Table(t.alias, [moved(c) for c in t.cols]) for t in scope.tables], parent)
