"""Errors that a query can end with; each becomes an error row."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ErrorRow:
    message: str
    path: tuple[str, ...] = ()
    extensions: dict[str, str] = field(default_factory=dict)


class GraphError(Exception):
    """A query or schema can't be processed; ``rows`` say why."""

    def __init__(self, message: str, path: tuple[str, ...] = (), **extensions: str):
        super().__init__(message)
        self.rows = [ErrorRow(message, path, extensions)]


class SourceError(GraphError):
    """A source answers with errors of its own beside its data, or instead of it."""

    def __init__(self, *rows: ErrorRow):
        super().__init__(rows[0].message if rows else "source failed")
        self.rows = list(rows)
