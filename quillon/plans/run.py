"""Results of queries, and running one against a set of tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import EngineError, QueryMemory, SqlError
from quillon.plans import ast
from quillon.plans.compile import Compiler, Relation
from quillon.plans.parser import parse_one

#: Spark's error classes and what the dialect calls them.
_NATIVE = {"DIVIDE_BY_ZERO": "division by zero", "REMAINDER_BY_ZERO": "division by zero", "ARITHMETIC_OVERFLOW": "integer overflow", "CAST_INVALID_INPUT": "value does not convert", "CAST_OVERFLOW": "value does not convert"}


def translate(error: Exception, pos: tuple[int, int] = (1, 1)) -> Exception:
    """A Spark error as an SqlError, if it is one of a statement."""
    if isinstance(error, EngineError):
        return error
    text = str(error)
    m = re.search(r"line (\d+), column (\d+): ([^\n]*?)(?: SQLSTATE|\n|$)", text)
    if m:
        return SqlError(int(m[1]), int(m[2]), m[3].strip(), error)
    for name, message in _NATIVE.items():
        if name in text:
            return SqlError(*pos, message, error)
    return error


class Result:
    """Rows of a query: a lazy DataFrame, an iterator of tuples, and the column names."""

    def __init__(self, df: DataFrame, columns: list[str], types: list[str | None], pos=(1, 1), memory: int | None = None):
        self.df, self.columns, self.types, self._pos, self._memory = df, columns, types, pos, memory

    def __iter__(self) -> Iterator[tuple]:
        """The rows as they come; under a memory bound all of them or, past it, an error and none."""
        if self._memory is None:
            yield from self._read()
            return
        held, used = [], 0
        for values in self._read():
            used += 24 * len(values) + sum(len(v) for v in values if isinstance(v, str | bytes))
            if used > self._memory:
                raise QueryMemory(f"the rows take more than {self._memory} bytes")
            held.append(values)
        yield from held

    def _read(self) -> Iterator[tuple]:
        try:
            for row in self.df.toLocalIterator(prefetchPartitions=True):
                yield tuple(bytes(v) if isinstance(v, bytearray) else v for v in row)
        except Exception as e:
            raised = translate(e, self._pos)
            if raised is e:
                raise
            raise raised from e

    def rows(self) -> list[tuple]:
        return list(self)


def unique_names(names: list[str]) -> list[str]:
    """Names that a DataFrame's consumer can tell apart: a second a is a_2."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def select(spark: SparkSession, q: ast.Select, lookup: Callable[[str], Relation | None], params=(), memory: int | None = None) -> Result:
    out = Compiler(spark, lookup, params).query(q)
    names = [c.name for c in out.cols]
    df = out.df.select(*[(F.col(c.id) if c.type or c.kind not in ("", "void") else F.col(c.id).cast("string")).alias(n) for c, n in zip(out.cols, unique_names(names))])
    return Result(df, names, [c.type for c in out.cols], q.pos, memory)


def query(spark: SparkSession, text: str, tables: dict[str, Relation], params=()) -> Result:
    """Run one SELECT over given tables."""
    q = parse_one(text)
    if not isinstance(q, ast.Select):
        raise SqlError(*q.pos, "expected a SELECT")
    return select(spark, q, tables.get, params)
