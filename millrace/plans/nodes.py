"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field

INT, TEXT = "INT", "TEXT"


@dataclass(frozen=True)
class Name:
    """A column by name."""

    name: str


@dataclass(frozen=True)
class Literal:
    """An integer or a text."""

    value: int | str

    @property
    def kind(self) -> str:
        return INT if isinstance(self.value, int) else TEXT


@dataclass(frozen=True)
class Aggregate:
    """``COUNT(*)`` (no column), or MIN, MAX, SUM, AVG of a column."""

    function: str
    column: str | None = None

    @property
    def title(self) -> str:
        return f"{self.function}({self.column or '*'})"


@dataclass(frozen=True)
class Comparison:
    op: str
    left: Operand
    right: Operand


@dataclass(frozen=True)
class Logical:
    """AND or OR of two conditions."""

    op: str
    left: Condition
    right: Condition


Operand = Name | Literal | Aggregate
Condition = Comparison | Logical | Name | Literal | Aggregate


@dataclass(frozen=True)
class Star:
    """All columns, in the order of the schema."""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str
    primary_key: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: list[ColumnDef]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class Insert:
    table: str
    values: list[Literal]
    columns: list[str] | None = None


@dataclass(frozen=True)
class Order:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Select:
    table: str
    items: list[Name | Star | Aggregate]
    distinct: bool = False
    where: Condition | None = None
    group_by: list[str] = field(default_factory=list)
    having: Condition | None = None
    order: Order | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Update:
    table: str
    changes: dict[str, Literal]
    where: Condition | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Condition | None = None


Statement = CreateTable | CreateIndex | Insert | Select | Update | Delete
