"""Bindings: what the types and fields of a schema are in terms of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.errors import ErrorRow, GraphError


@dataclass(frozen=True)
class Ref:
    """A field that refers to one object: its key fields by this table's columns, and fields that come along."""

    on: Mapping[str, str]
    provides: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Many:
    """A list of objects of the same source whose columns hold the parent's key; ``filters``: arguments by column."""

    on: Mapping[str, str]
    order_by: Sequence[str]
    filters: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class One:
    """One object of the same source whose columns hold the parent's key, which is unique there."""

    on: Mapping[str, str]
    filters: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Compute:
    """A column from what the field requires (by field name), this table's ``own`` columns, and the arguments."""

    function: Callable[[dict[str, Column], dict[str, Any]], Column]
    own: Sequence[str] = ()


@dataclass(frozen=True)
class Nested:
    """An object or a list of objects that arrives nested in a column, with fields of the schema's names; scalars and such columns only."""

    column: str


Binding = str | Column | Ref | Many | One | Compute | Nested


@dataclass
class TypeBinding:
    """A type's rows, and its fields' columns where they differ in name."""

    table: DataFrame | Callable[[], DataFrame]
    fields: dict[str, Binding] = field(default_factory=dict)

    def frame(self) -> DataFrame:
        return self.table() if callable(self.table) else self.table

    def of(self, name: str) -> Binding:
        return self.fields.get(name, name)


@dataclass
class Lookup:
    """A type without a table: ``look_up`` gets distinct keys (columns named by key fields) and the fields that are
    wanted, and returns rows of keys and fields. Its objects can't be listed, only found.

    ``lenient`` does the same, but what fails while it runs gives nulls. Frames of either can carry
    ``reported``: a function that gives the error rows met so far, known once the frame is computed.
    """

    look_up: Callable[[DataFrame, Sequence[str]], DataFrame]
    fields: dict[str, Binding] = field(default_factory=dict)
    lenient: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None

    def of(self, name: str) -> Binding:
        return self.fields.get(name, name)

    def frame(self) -> DataFrame:
        raise GraphError("objects of this source can only be found by key")


@dataclass(frozen=True)
class Root:
    """A root field: the rows of its type where columns equal arguments, or what ``rows`` gives for the arguments: a frame, or one with error rows."""

    filters: Mapping[str, str] = field(default_factory=dict)
    rows: Callable[[dict[str, Any]], DataFrame | tuple[DataFrame, list[ErrorRow]]] | None = None
    order_by: Sequence[str] = ()


@dataclass
class SourceBinding:
    """A source: its types, its root fields (for abstract types one ``Root`` per member), and whether it can be reached."""

    types: dict[str, TypeBinding | Lookup]
    roots: dict[str, Root | dict[str, Root]] = field(default_factory=dict)

    def type(self, name: str) -> TypeBinding | Lookup:
        if name not in self.types:
            raise GraphError(f"no rows are bound for {name}")
        return self.types[name]


class Unreachable(SourceBinding):
    """A source whose tables all fail when they are read, for tests of partial answers."""

    def __init__(self, like: SourceBinding, error: Exception | None = None):
        def broken() -> DataFrame:
            raise error or ConnectionError("source is not reachable")

        def broken_rows(args: dict[str, Any]) -> DataFrame:
            return broken()

        super().__init__(
            {name: TypeBinding(broken, t.fields) for name, t in like.types.items()},
            {name: Root(rows=broken_rows) if isinstance(r, Root) else {t: Root(rows=broken_rows) for t in r} for name, r in like.roots.items()},
        )


def exploded(table: DataFrame, keys: Sequence[str], column: str, position: str = "pos", value: str = "value") -> DataFrame:
    """Lists that arrive nested, as rows: the keys, the place in the list, and the element (its fields, if it is a struct)."""
    rows = table.select(*keys, F.posexplode(column).alias(position, value))
    kind = dict(rows.dtypes)[value]
    return rows.select(*keys, position, f"{value}.*") if kind.startswith("struct") else rows


def append(path: str, make: Callable[[dict[str, Any]], DataFrame]) -> Root:
    """A mutation: the row made of the arguments is appended to the Parquet table at ``path`` and returned."""

    def insert(args: dict[str, Any]) -> DataFrame:
        row = make(args)
        row.write.mode("append").parquet(path)
        return row

    return Root(rows=insert)
