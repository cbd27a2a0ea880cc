"""Errors of the engine."""

from __future__ import annotations

#: Result codes that callers test for.
GENERIC, BUSY, CONSTRAINT, RANGE = 1, 5, 19, 25


class EngineError(Exception):
    """Any error of the engine."""


class ConnectionFailed(EngineError):
    """The database can't be opened, or is closed."""


class QueryError(EngineError):
    """A statement failed. code: 1 for syntax and analysis, 19 for a constraint, 25 for a wrong number of parameters."""

    def __init__(self, message: str, sql: str = "", parameters: tuple = (), code: int = GENERIC) -> None:
        super().__init__(message)
        self.message, self.sql, self.parameters, self.code = message, sql, tuple(parameters), code

    def __str__(self) -> str:
        return f"{self.message} (code {self.code}) in: {self.sql}" if self.sql else f"{self.message} (code {self.code})"


class TransactionError(EngineError):
    """begin, commit or rollback failed."""

    def __init__(self, message: str, operation: str, code: int = GENERIC) -> None:
        super().__init__(message)
        self.message, self.operation, self.code = message, operation, code


class StateError(EngineError):
    """A call that the state of a handle doesn't allow: a transaction that has ended, bytes inside a transaction."""
