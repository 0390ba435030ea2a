"""Schemas of tables and indexes, persisted as version files."""

from __future__ import annotations

import json
from dataclasses import dataclass

from millrace import errors
from millrace.errors import QueryError
from millrace.plans import nodes as n
from millrace.sources.files import Files


@dataclass(frozen=True)
class TableSchema:
    """Columns in the order of their declaration; exactly one is the primary key."""

    name: str
    columns: tuple[n.ColumnDef, ...]

    @property
    def pk(self) -> str:
        return next(c.name for c in self.columns if c.primary_key)

    @property
    def kinds(self) -> dict[str, str]:
        return {c.name: c.kind for c in self.columns}

    def to_json(self) -> dict:
        return {"name": self.name, "columns": [[c.name, c.kind, c.primary_key] for c in self.columns]}

    @classmethod
    def from_json(cls, d: dict) -> TableSchema:
        return cls(d["name"], tuple(n.ColumnDef(*c) for c in d["columns"]))


@dataclass(frozen=True)
class IndexSchema:
    name: str
    table_name: str
    column_name: str


class Catalog:
    """Names are compared exactly. Each change publishes the whole catalog under the next number; the last one counts."""

    def __init__(self, files: Files, root: str):
        self.files, self.root = files, root
        self.tables: dict[str, TableSchema] = {}
        self.indexes: dict[str, IndexSchema] = {}
        self.version = 0
        self.load()

    def load(self) -> None:
        names = [x for x in self.files.names(self.root) if x.endswith(".json")]
        if names:
            state = json.loads(self.files.read(f"{self.root}/{names[-1]}"))
            self.version = state["version"]
            self.tables = {t["name"]: TableSchema.from_json(t) for t in state["tables"]}
            self.indexes = {i[0]: IndexSchema(*i) for i in state["indexes"]}

    def _save(self) -> None:
        state = {"version": self.version + 1, "tables": [t.to_json() for t in self.tables.values()], "indexes": [[i.name, i.table_name, i.column_name] for i in self.indexes.values()]}
        if not self.files.create(f"{self.root}/{state['version']:012d}.json", json.dumps(state)):
            self.load()
            raise QueryError("the catalog was changed by another session; try again")
        self.version = state["version"]

    def create_table(self, name: str, columns: list[n.ColumnDef]) -> TableSchema:
        if name in self.tables:
            raise QueryError(errors.TABLE_EXISTS)
        keys = sum(c.primary_key for c in columns)
        if keys == 0:
            raise QueryError(errors.NO_KEY)
        if keys > 1:
            raise QueryError(errors.MANY_KEYS)
        if len({c.name.lower() for c in columns}) < len(columns):
            raise QueryError("column names must differ, also when written in one case")
        self.tables[name] = TableSchema(name, tuple(columns))
        self._save()
        return self.tables[name]

    def check_index(self, name: str, table: str, column: str) -> None:
        """Raise if there can't be such an index."""
        if name in self.indexes:
            raise QueryError(errors.INDEX_EXISTS)
        if column not in self.table(table).kinds:
            raise QueryError(errors.UNKNOWN_COLUMN.format(name=column))

    def create_index(self, name: str, table: str, column: str) -> IndexSchema:
        self.check_index(name, table, column)
        self.indexes[name] = IndexSchema(name, table, column)
        self._save()
        return self.indexes[name]

    def table(self, name: str) -> TableSchema:
        if name not in self.tables:
            raise QueryError(errors.NO_TABLE.format(name=name))
        return self.tables[name]

    def indexes_for(self, table: str) -> list[IndexSchema]:
        return [i for i in self.indexes.values() if i.table_name == table]
