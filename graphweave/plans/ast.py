"""Syntax trees of query documents and schema documents."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class TypeRef:
    """A named type, or a list of ``inner``."""

    name: str = ""
    inner: TypeRef | None = None
    required: bool = False

    @property
    def named(self) -> str:
        return self.inner.named if self.inner else self.name

    @property
    def is_list(self) -> bool:
        return self.inner is not None

    def __str__(self) -> str:
        return (f"[{self.inner}]" if self.inner else self.name) + "!" * self.required


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Enum:
    name: str


@dataclass(frozen=True)
class Directive:
    name: str
    args: dict[str, Any] = field(default_factory=dict)


@dataclass
class Field:
    name: str
    alias: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    directives: list[Directive] = field(default_factory=list)
    selections: list[Selection] | None = None

    @property
    def key(self) -> str:
        return self.alias or self.name


@dataclass
class Spread:
    name: str
    directives: list[Directive] = field(default_factory=list)


@dataclass
class Inline:
    condition: str | None
    selections: list[Selection]
    directives: list[Directive] = field(default_factory=list)


Selection = Field | Spread | Inline


@dataclass
class VariableDef:
    name: str
    type: TypeRef
    default: Any = None
    has_default: bool = False


@dataclass
class Operation:
    kind: str
    name: str | None
    variables: list[VariableDef]
    selections: list[Selection]
    directives: list[Directive] = field(default_factory=list)


@dataclass
class Fragment:
    name: str
    condition: str
    selections: list[Selection]


@dataclass
class QueryDocument:
    operations: list[Operation]
    fragments: dict[str, Fragment]


@dataclass
class ArgDef:
    name: str
    type: TypeRef
    default: Any = None
    directives: list[Directive] = field(default_factory=list)


@dataclass
class FieldDef:
    name: str
    type: TypeRef
    args: dict[str, ArgDef] = field(default_factory=dict)
    directives: list[Directive] = field(default_factory=list)

    def directive(self, name: str) -> Directive | None:
        return next((d for d in self.directives if d.name == name), None)


@dataclass
class TypeDef:
    """``kind``: object, interface, union, enum, input, scalar, directive or schema."""

    kind: str
    name: str
    extension: bool = False
    fields: dict[str, FieldDef] = field(default_factory=dict)
    interfaces: list[str] = field(default_factory=list)
    members: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    directives: list[Directive] = field(default_factory=list)
    roots: dict[str, str] = field(default_factory=dict)

    def all(self, name: str) -> list[Directive]:
        return [d for d in self.directives if d.name == name]
