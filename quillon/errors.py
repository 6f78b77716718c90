"""Errors of the engine.  SqlError carries a place in the statement text."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of this library."""


class SqlError(EngineError):
    def __init__(self, line: int, col: int, message: str, cause: Exception | None = None):
        super().__init__(f"line {line}, column {col}: {message}")
        self.line, self.col, self.message, self.cause = line, col, message, cause


class SessionError(EngineError):
    """A statement that the state of a session doesn't allow."""


class NotFound(EngineError):
    """No such table, index or row."""


class Exists(EngineError):
    """A name is taken."""


class ConstraintError(EngineError):
    """A row breaks a rule of its table."""


class DuplicateKey(ConstraintError):
    pass


class NotNull(ConstraintError):
    pass


class CheckFailed(ConstraintError):
    pass


class TypeMismatch(EngineError):
    pass


class ReadOnly(EngineError):
    pass


class Locked(EngineError):
    """Another process has the database open."""


class Closed(EngineError):
    pass


class Corrupt(EngineError):
    """A file does not hold what the manifest says."""


class QueryMemory(EngineError):
    """A result is larger than the bound that was asked for."""


class LimitExceeded(EngineError):
    """A name, row or schema beyond the documented limits."""
