"""PEP 249 driver: connect(path) -> Connection.  A connection is a session."""

from __future__ import annotations

from quillon import errors as E
from quillon.database import Database
from quillon.plans import ast
from quillon.plans.parser import parse_one

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Warning(Exception):  # noqa: A001
    pass


class Error(Exception):
    pass


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


def _wrap(e: E.EngineError) -> Error:
    cause = e.cause if isinstance(e, E.SqlError) and e.cause is not None else e
    for kind, wrapped in ((E.ConstraintError, IntegrityError), (E.Corrupt, InternalError), (E.SqlError, ProgrammingError), (E.NotFound, ProgrammingError), (E.Exists, ProgrammingError), (E.TypeMismatch, DataError), (E.Closed, InterfaceError)):
        if isinstance(cause, kind):
            return wrapped(str(e))
    return ProgrammingError(str(e)) if isinstance(e, E.SqlError) else OperationalError(str(e))


def connect(path: str, spark=None, read_only: bool = False, autocommit: bool = True) -> Connection:
    try:
        return Connection(Database(path, spark, read_only=read_only), autocommit)
    except E.EngineError as e:
        raise _wrap(e) from e


class Connection:
    def __init__(self, db: Database, autocommit: bool = True):
        self.db, self.session, self.autocommit = db, db.session(), autocommit

    def cursor(self) -> Cursor:
        if self.db.closed:
            raise InterfaceError("the connection is closed")
        return Cursor(self)

    def begin(self, read_only: bool = False) -> None:
        self._do(self.session.begin_read if read_only else self.session.begin)

    def commit(self) -> None:
        if self.session.tx is not None or self.session.view is not None:
            self._do(self.session.commit)

    def rollback(self) -> None:
        if self.session.tx is not None or self.session.view is not None:
            self._do(self.session.rollback)

    def reset(self) -> None:
        """Undo what an earlier user of the connection left open."""
        self.rollback()

    def _do(self, f, *args):
        try:
            return f(*args)
        except E.EngineError as e:
            raise _wrap(e) from e

    def close(self) -> None:
        self.session.close()
        self.db.close()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount, self.lastrowid = connection, None, -1, None
        self._rows = None

    def execute(self, text: str, params=()) -> Cursor:
        c = self.connection
        stmt = c._do(parse_one, text)
        self.description, self._rows, self.rowcount, self.lastrowid = None, None, -1, None
        if isinstance(stmt, ast.Select | ast.Explain):
            result = c._do(c.session.query, stmt, params)
            self.description = [(n, k, None, None, None, None, None) for n, k in zip(result.columns, result.types)]
            self._rows = iter(result)
            return self
        if not c.autocommit and c.session.tx is None and not isinstance(stmt, ast.Transaction):
            c.begin()
        out = c._do(c.session.execute, stmt, params)
        self.rowcount, self.lastrowid = out.rows_affected, out.last_insert_id
        return self

    def executemany(self, text: str, rows) -> Cursor:
        total = 0
        for params in rows:
            total += max(0, self.execute(text, params).rowcount)
        self.rowcount = total
        return self

    def fetchone(self):
        if self._rows is None:
            raise ProgrammingError("no query has been run")
        return self.connection._do(next, self._rows, None)

    def fetchmany(self, size: int | None = None) -> list:
        out = []
        while len(out) < (size or self.arraysize) and (row := self.fetchone()) is not None:
            out.append(row)
        return out

    def fetchall(self) -> list:
        return list(self)

    def __iter__(self):
        while (row := self.fetchone()) is not None:
            yield row

    def setinputsizes(self, sizes) -> None:
        pass

    def setoutputsize(self, size, column=None) -> None:
        pass

    def close(self) -> None:
        self._rows = None
