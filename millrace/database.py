"""SQL over keyed tables and attached Parquet files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import errors
from millrace.errors import QueryError
from millrace.functions.columns import col
from millrace.plans import nodes as n
from millrace.plans.analyzer import check_value, check_where
from millrace.plans.compiler import select, where
from millrace.plans.parser import parse
from millrace.sources import workspace
from millrace.sources.catalog import Catalog, IndexSchema, TableSchema
from millrace.sources.files import Files
from millrace.sources.tables import KeyedTable

_SPARK = {n.INT: T.LongType(), n.TEXT: T.StringType()}


@dataclass
class Result:
    """What a statement gives: a message, or rows."""

    message: str | None = None
    rows: DataFrame | None = None


class Database:
    """Tables below ``root``. Statements are atomic: each is one commit, or nothing happened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalog = Catalog(Files(spark), f"{self.root}/catalog")
        self._open: dict[str, KeyedTable] = {}
        self._attached: dict[str, tuple[DataFrame, str | None]] = {}

    # -- tables -----------------------------------------------------------------------------------------

    def attach(self, name: str, rows: DataFrame, pk: str | None = None) -> None:
        """Make a DataFrame a table that can be read. ``pk``, if given, must be unique: it decides between rows that tie."""
        self._attached[name] = rows, pk

    def attach_parquet(self, name: str, path: str, pk: str | None = None) -> None:
        self.attach(name, self.spark.read.parquet(path), pk)

    def rows(self, name: str) -> DataFrame:
        """All rows of a table."""
        return self._attached[name][0] if name in self._attached else self._table(self.catalog.table(name)).read()

    def _table(self, schema: TableSchema) -> KeyedTable:
        if schema.name not in self._open:
            fields = T.StructType([T.StructField(c.name, _SPARK[c.kind]) for c in schema.columns])
            self._open[schema.name] = KeyedTable(self.spark, f"{self.root}/tables/{schema.name}", fields, schema.pk, indexes={i.name: i.column_name for i in self.catalog.indexes_for(schema.name)})
        return self._open[schema.name]

    def _writable(self, name: str) -> TableSchema:
        if name in self._attached and name not in self.catalog.tables:
            raise QueryError(f"table '{name}' is attached and can only be read")
        return self.catalog.table(name)

    def insert_many(self, name: str, rows: DataFrame) -> None:
        """Upsert all rows of a DataFrame in one commit; its columns must be the table's.

        The dialect has no NULL: a row that holds one fails the whole statement, and nothing is written.
        """
        schema = self._writable(name)
        if set(rows.columns) != set(schema.kinds):
            raise QueryError(f"the rows of '{name}' need exactly its columns")
        for f in rows.schema.fields:
            kind = n.INT if isinstance(f.dataType, T.IntegralType) else n.TEXT if isinstance(f.dataType, T.StringType) else None
            if kind != schema.kinds[f.name]:
                raise QueryError(f"Type mismatch: column '{f.name}' expects {schema.kinds[f.name]} but received {f.dataType.simpleString()}")
        absent = F.raise_error(F.lit(f"missing value in the rows of '{name}'"))
        whole = rows.select(*[F.when(col(c).isNull(), absent.cast(rows.schema[c].dataType)).otherwise(col(c)).alias(c) for c in schema.kinds])
        try:
            self._table(schema).write_all(whole)
        except Exception as e:
            if "missing value in the rows" in str(e):
                raise QueryError(f"missing value in the rows of '{name}'") from None
            raise

    # -- indexes ----------------------------------------------------------------------------------------

    def index_entries(self, name: str) -> DataFrame:
        """An index as a table: value and key of each row, ranged and sorted by value, then by the key's text."""
        index = self._index(name)
        rows, pk = self._table(self.catalog.table(index.table_name)).entries(name), self.catalog.table(index.table_name).pk
        return rows.orderBy(col(index.column_name), col(pk).cast("string"))

    def index_lookup(self, name: str, op: str, value: int | str) -> DataFrame:
        """The rows whose indexed column compares so with a value."""
        index = self._index(name)
        schema = self.catalog.table(index.table_name)
        check_where(n.Comparison(op, n.Name(index.column_name), n.Literal(value)), schema.kinds)
        return self._table(schema).lookup(name, op, value)

    def _matching(self, name: str, condition: n.Condition | None) -> DataFrame:
        """The rows of a table that its access paths can't rule out; keyed tables have some."""
        if name in self._attached or condition is None:
            return self.rows(name)
        schema = self.catalog.table(name)
        check_where(condition, schema.kinds)
        return self._table(schema).matching(condition)

    def _index(self, name: str) -> IndexSchema:
        if name not in self.catalog.indexes:
            raise QueryError(errors.NO_INDEX.format(name=name))
        return self.catalog.indexes[name]

    def _pk(self, table: str) -> str | None:
        return self._attached[table][1] if table in self._attached else self.catalog.table(table).pk

    # -- statements -------------------------------------------------------------------------------------

    def sql(self, text: str, *names: str) -> DataFrame:
        """The rows of a SELECT; ``names``, if given, rename its columns."""
        out = self.execute(text).rows
        if out is None:
            raise QueryError("only SELECT gives rows")
        return out.toDF(*names) if names else out

    def execute(self, text: str) -> Result:
        """Parse, check and carry out one statement; raises QueryError if it can't be."""
        match parse(text):
            case n.Select() as s:
                rows = self._matching(s.table, s.where)
                return Result(rows=select(rows, s, self._pk(s.table)))
            case n.CreateTable(name, columns):
                if name in self._attached:
                    raise QueryError(errors.TABLE_EXISTS)
                self.catalog.create_table(name, columns)
                return Result(errors.TABLE_CREATED)
            case n.CreateIndex(name, table, column):
                schema = self._writable(table)
                self.catalog.check_index(name, table, column)
                self._table(schema).add_index(name, column)
                self.catalog.create_index(name, table, column)
                return Result(errors.INDEX_CREATED)
            case n.Insert() as s:
                return self._insert(s)
            case n.Update() as s:
                return self._update(s)
            case n.Delete() as s:
                return self._delete(s)

    def _insert(self, s: n.Insert) -> Result:
        schema = self._writable(s.table)
        columns = s.columns if s.columns is not None else list(schema.kinds)
        if len(set(columns)) < len(columns):
            raise QueryError("a column is named twice")
        if len(columns) != len(s.values):
            raise QueryError(errors.COUNT_OF_VALUES.format(expected=len(columns), received=len(s.values)))
        row = dict(zip(columns, s.values, strict=True))
        for c in columns:
            if c not in schema.kinds:
                raise QueryError(errors.UNKNOWN_COLUMN.format(name=c))
        for c, kind in schema.kinds.items():
            if c not in row:
                raise QueryError(errors.MISSING_VALUE.format(name=c))
            check_value(c, kind, row[c])
        self._table(schema).write({c: v.value for c, v in row.items()})
        return Result(errors.INSERTED)

    def _update(self, s: n.Update) -> Result:
        schema = self._writable(s.table)
        if s.where is None:
            raise QueryError(errors.UPDATE_NEEDS_WHERE)
        if schema.pk in s.changes:
            raise QueryError(errors.KEY_IS_FIXED)
        for c, v in s.changes.items():
            if c not in schema.kinds:
                raise QueryError(errors.UNKNOWN_COLUMN.format(name=c))
            check_value(c, schema.kinds[c], v)
        rows = self._matching(s.table, s.where)
        # the table is read once: what it gives is counted and written from there
        with workspace.borrowed(rows.filter(where(rows, s.where)), "hits") as hit:
            count = hit.count()
            if count:
                self._table(schema).write_all(hit.withColumns({c: F.lit(v.value) for c, v in s.changes.items()}))
        return Result(_counted(count, "updated", self._by_key(s.where, schema)))

    def _delete(self, s: n.Delete) -> Result:
        schema = self._writable(s.table)
        if s.where is None:
            raise QueryError(errors.DELETE_NEEDS_WHERE)
        rows = self._matching(s.table, s.where)
        with workspace.borrowed(rows.filter(where(rows, s.where)).select(col(schema.pk)), "hits") as hit:
            count = hit.count()
            if count:
                self._table(schema).write_all(hit, dead=True)
        return Result(_counted(count, "deleted", self._by_key(s.where, schema)))

    @staticmethod
    def _by_key(c: n.Condition, schema: TableSchema) -> bool:
        return isinstance(c, n.Comparison) and c.op == "=" and c.left == n.Name(schema.pk)

    def compact(self, name: str) -> None:
        """Merge a table's runs."""
        self._table(self._writable(name)).compact()

    def close(self) -> None:
        """Turn all buffered writes into runs. Without it they wait in write-ahead files for the next session."""
        for t in self._open.values():
            t.flush()


def _counted(count: int, done: str, by_key: bool) -> str:
    return (errors.NO_ROWS if count == 0 else errors.ONE_ROW if by_key else errors.SOME_ROWS).format(n=count, done=done)
