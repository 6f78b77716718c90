"""Syntax trees.  Every expression knows where it begins: pos = (line, column)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

Pos = tuple[int, int]


@dataclass
class Expr:
    pos: Pos


@dataclass
class Lit(Expr):
    value: Any
    type: str | None  # None for NULL


@dataclass
class Param(Expr):
    n: int


@dataclass
class Name(Expr):
    table: str | None
    name: str


@dataclass
class Unary(Expr):
    op: str  # - + NOT
    x: Expr


@dataclass
class Binary(Expr):
    op: str  # || * / % + - < <= > >= = != AND OR
    left: Expr
    right: Expr


@dataclass
class Is(Expr):
    left: Expr
    right: Expr
    neg: bool


@dataclass
class In(Expr):
    x: Expr
    items: list[Expr] | None
    query: Select | None
    neg: bool


@dataclass
class Between(Expr):
    x: Expr
    lo: Expr
    hi: Expr
    neg: bool


@dataclass
class Like(Expr):
    x: Expr
    pattern: Expr
    neg: bool


@dataclass
class Exists(Expr):
    query: Select


@dataclass
class Scalar(Expr):
    query: Select


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]
    star: bool = False
    distinct: bool = False


@dataclass
class Cast(Expr):
    x: Expr
    type: str


@dataclass
class Case(Expr):
    operand: Expr | None
    whens: list[tuple[Expr, Expr]]
    default: Expr | None


@dataclass
class Item:
    pos: Pos
    expr: Expr | None  # None for * and t.*
    alias: str | None = None
    table: str | None = None


@dataclass
class Source:
    pos: Pos
    table: str
    alias: str | None
    join: str = ""  # "", INNER, LEFT
    on: Expr | None = None


@dataclass
class Select:
    pos: Pos
    distinct: bool = False
    items: list[Item] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)  # (expression, descending)
    limit: Expr | None = None
    offset: Expr | None = None


@dataclass
class ColumnDef:
    pos: Pos
    name: str
    type: str
    not_null: bool = False
    primary: bool = False
    unique: bool = False
    default: Expr | None = None  # Call("current_timestamp") stands for itself
    checks: list[Expr] = field(default_factory=list)


@dataclass
class CreateTable:
    pos: Pos
    name: str
    columns: list[ColumnDef]
    primary: list[str]
    uniques: list[list[str]]
    checks: list[Expr]
    if_not_exists: bool


@dataclass
class CreateIndex:
    pos: Pos
    name: str
    table: str
    columns: list[str]
    unique: bool
    if_not_exists: bool


@dataclass
class Drop:
    pos: Pos
    kind: str  # TABLE INDEX
    name: str
    if_exists: bool


@dataclass
class AlterAdd:
    pos: Pos
    table: str
    column: ColumnDef


@dataclass
class Upsert:
    pos: Pos
    target: list[str] | None
    sets: list[tuple[Pos, str, Expr]] | None  # None: DO NOTHING
    where: Expr | None = None


@dataclass
class Insert:
    pos: Pos
    table: str
    columns: list[str] | None
    rows: list[list[Expr]]
    upsert: Upsert | None = None


@dataclass
class Update:
    pos: Pos
    table: str
    sets: list[tuple[Pos, str, Expr]]
    where: Expr | None


@dataclass
class Delete:
    pos: Pos
    table: str
    where: Expr | None


@dataclass
class Explain:
    pos: Pos
    statement: Any


@dataclass
class Transaction:
    pos: Pos
    kind: str  # BEGIN COMMIT ROLLBACK


def children(e: Expr) -> list[Expr]:
    """The expressions directly below one, without entering subqueries."""
    match e:
        case Unary() | Cast():
            return [e.x]
        case Binary() | Is():
            return [e.left, e.right]
        case In():
            return [e.x, *(e.items or [])]
        case Between():
            return [e.x, e.lo, e.hi]
        case Like():
            return [e.x, e.pattern]
        case Call():
            return e.args
        case Case():
            return [x for x in [e.operand, *(y for w in e.whens for y in w), e.default] if x is not None]
    return []


def select_exprs(q: Select) -> list[Expr]:
    """All expressions at the top of a query's clauses."""
    out = [i.expr for i in q.items if i.expr is not None]
    out += [s.on for s in q.sources if s.on is not None]
    out += [x for x in (q.where, q.having, q.limit, q.offset) if x is not None]
    return out + q.group + [x for x, _ in q.order]


def walk(e: Expr):
    """e and everything below it, a subquery's own expressions left out; linear and without recursion."""
    todo = [e]
    while todo:
        x = todo.pop()
        yield x
        todo += children(x)
