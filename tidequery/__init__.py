"""tidequery: plain SQL over versioned parquet tables, with live queries, on PySpark."""

from importlib import import_module

_HOMES = {"Database": "database", "local_session": "session"} | dict.fromkeys(("ConnectionFailed", "EngineError", "QueryError", "StateError", "TransactionError"), "errors")
__all__ = sorted(_HOMES)


def __getattr__(name: str) -> object:
    """Names are loaded when asked for, so that executors load only what they run."""
    if name in _HOMES:
        return getattr(import_module(f"tidequery.{_HOMES[name]}"), name)
    raise AttributeError(name)
