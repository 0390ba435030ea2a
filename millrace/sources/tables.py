"""Keyed tables and key-value stores that can be written: a change log with a buffer in front.

Single writes go to a small write-ahead file each and to a buffer in the driver; when ``FLUSH`` have gathered, or a bulk
write comes, the buffer becomes a run of the log and its files go. Reads merge the log with the buffer. A crash
loses nothing: write-ahead files that are left over are replayed, and replaying one twice changes nothing,
as every change carries its number.

A secondary index is a change log of its own, bucketed and sorted by the indexed value. It is written before the table, never after,
so it lacks nothing; entries that the table has outgrown are seen when the rows are fetched, and go when the table is compacted.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError
from millrace.functions.columns import col, quoted
from millrace.operators.changes import ChangeLog
from millrace.plans import nodes as n
from millrace.plans.compiler import OPS
from millrace.sources.files import Files

#: Buffered writes at which they become a run.
FLUSH = 1000
#: Rows up to which an index lookup fetches them by key; beyond it one scan of the table is cheaper.
FEW = 10_000
SEQ, DEAD = "change_no", "is_deleted"


def _crc(text: str) -> str:
    return f"{zlib.crc32(text.encode()):08x}"


class KeyedTable:
    """Rows of ``schema`` (its fields are the key ``key`` and the values), of which each key has one."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, fanout: int = 4, indexes: dict[str, str] | None = None):
        self.spark, self.root, self.schema, self.key = spark, root, schema, key
        self.full = T.StructType([*schema.fields, T.StructField(SEQ, T.LongType()), T.StructField(DEAD, T.BooleanType())])
        self.files = Files(spark)
        self.log = ChangeLog(spark, f"{root}/log", key, [SEQ], DEAD, fanout=fanout)
        self.indexes = {name: self._index(name, column) for name, column in (indexes or {}).items()}
        self.buffer: dict = {}
        self.seq = self.log.greatest(SEQ) or 0
        self._replay()

    # -- recovery ---------------------------------------------------------------------------------------

    def _replay(self) -> None:
        """Take up the write-ahead files. The last may be damaged, as a write that never ended: it is passed over; a damaged one
        before others is a loss and raises."""
        names = [n for n in self.files.names(f"{self.root}/wal") if n.endswith(".json")]
        for name in names:
            crc, _, text = self.files.read(f"{self.root}/wal/{name}").partition(" ")
            if crc != _crc(text):
                if name == names[-1]:
                    self.files.delete(f"{self.root}/wal/{name}")
                    return
                raise QueryError(f"write-ahead file {name} of {self.root} is damaged")
            row = json.loads(text)
            self.buffer[row[self.key]] = row
            self.seq = max(self.seq, row[SEQ])

    # -- writing ----------------------------------------------------------------------------------------

    def write(self, row: dict, dead: bool = False) -> None:
        """Set or delete one key. Missing values are null, which only tombstones may have."""
        self.seq += 1
        row = {f.name: row.get(f.name) for f in self.schema} | {SEQ: self.seq, DEAD: dead}
        text = json.dumps(row)
        if not self.files.create(f"{self.root}/wal/{self.seq:015d}.json", f"{_crc(text)} {text}"):
            raise QueryError(f"another session writes to {self.root}")
        self.buffer[row[self.key]] = row
        if len(self.buffer) >= FLUSH:
            self.flush()

    def write_all(self, rows: DataFrame, dead: bool = False) -> None:
        """Set all rows of a DataFrame, or delete their keys, in one commit; repeated keys among them count once."""
        self.flush()
        self.seq += 1
        values = [col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self._append(rows.select(*values, F.lit(self.seq).cast("long").alias(SEQ), F.lit(dead).alias(DEAD)))

    def _append(self, rows: DataFrame) -> None:
        for log in self.indexes.values():
            log.append(self._entries(rows, log))
        self.log.append(rows)

    def flush(self) -> None:
        """Turn the buffer into a run."""
        if self.buffer:
            self._append(self._buffered())
            self.buffer = {}
        # a write-ahead file may be left of a flush that was interrupted after its commit
        for name in self.files.names(f"{self.root}/wal"):
            self.files.delete(f"{self.root}/wal/{name}")

    def compact(self) -> None:
        """Flush, and merge all runs to one without tombstones: numbers only rise here, so no older change can follow."""
        self.flush()
        if self.log._state() is not None:
            for log in self.indexes.values():
                self._clean(log)
            self.log.compact(horizon=self.seq + 1)
            self.log.vacuum()

    # -- indexes ----------------------------------------------------------------------------------------

    def _index(self, name: str, column: str) -> ChangeLog:
        keys = [column] if column == self.key else [column, self.key]
        return ChangeLog(self.spark, f"{self.root}/indexes/{name}", keys, [SEQ], DEAD)

    def _entries(self, rows: DataFrame, log: ChangeLog) -> DataFrame:
        """The entries that written rows add; what a deleted row had is found out by looking it up."""
        return rows.filter(~col(DEAD)).select(*[col(c) for c in log.keys], col(SEQ), col(DEAD))

    def add_index(self, name: str, column: str) -> None:
        """Build an index from the rows that are there; from now on all writes keep it."""
        self.flush()
        log = self._index(name, column)
        log.append(self._entries(self.merged(), log))
        self.indexes[name] = log

    def entries(self, name: str) -> DataFrame:
        """The entries of an index that hold: indexed value and key."""
        self.flush()
        log = self.indexes[name]
        if log._state() is None:
            return self.spark.createDataFrame([], T.StructType([self.schema[c] for c in log.keys]))
        keys = [col(c) for c in log.keys]
        return log.read().select(*keys).join(self.read().select(*keys), log.keys, "left_semi")

    def _clean(self, log: ChangeLog) -> None:
        """Take out the entries that the table has outgrown."""
        if log._state() is not None:
            keys = [col(c) for c in log.keys]
            stale = log.read().select(*keys).join(self.read().select(*keys), log.keys, "left_anti")
            log.append(stale.withColumn(SEQ, F.lit(self.seq + 1).cast("long")).withColumn(DEAD, F.lit(True)))
            log.compact(horizon=self.seq + 2)
            log.vacuum()

    def lookup(self, name: str, op: str, value: int | str) -> DataFrame:
        """The rows whose indexed column compares so with a value.

        The index is read where its buckets and row groups hold the value; the keys found there are fetched from the buckets
        that hold them and compared again. Where more than ``FEW`` entries match, the table is scanned.
        """
        log = self.indexes[name]
        hit = OPS[op](col(log.key), F.lit(value))
        found = [] if log._state() is None else log.read(hit).select(col(self.key)).limit(FEW + 1).collect()
        if len(found) > FEW:
            return self.read().filter(hit)
        return self.read(col(self.key).isin([*{r[0] for r in found}, *self.buffer])).filter(hit)

    def matching(self, where: n.Condition | None) -> DataFrame:
        """The live rows, less such as a condition rules out that an access path can tell: by key, else by an index. The condition
        itself is still to be applied."""
        parts, todo = [], [where] if where is not None else []
        while todo:
            c = todo.pop()
            if isinstance(c, n.Logical) and c.op == "AND":
                todo += [c.left, c.right]
            elif isinstance(c, n.Comparison) and isinstance(c.left, n.Name) and isinstance(c.right, n.Literal) and c.op != "!=":
                parts.append(c)
        by_key = [OPS[c.op](col(self.key), F.lit(c.right.value)) for c in parts if c.left.name == self.key]
        if by_key:
            only = by_key[0]
            for c in by_key[1:]:
                only &= c
            return self.read(only)
        of_column = {log.key: name for name, log in self.indexes.items()}
        indexed = sorted((c for c in parts if c.left.name in of_column), key=lambda c: c.op != "=")
        return self.lookup(of_column[indexed[0].left.name], indexed[0].op, indexed[0].right.value) if indexed else self.read()

    # -- reading ----------------------------------------------------------------------------------------

    def _buffered(self) -> DataFrame:
        rows = [tuple(r[f.name] for f in self.full) for r in self.buffer.values()]
        return self.spark.createDataFrame(rows, self.full)

    def merged(self, where: Column | None = None) -> DataFrame:
        """The newest change of each key, tombstones included."""
        buffered = self._buffered() if where is None else self._buffered().filter(where)
        if self.log._state() is None:
            return buffered
        if not self.buffer:
            return self.log.merged(where)
        # what is buffered is newer than any run and has at most FLUSH rows, so the log needn't be shuffled to be overlaid
        older = self.log.merged(where).join(F.broadcast(buffered.select(col(self.key))), self.key, "left_anti")
        return older.select(*[col(f.name) for f in self.full]).unionByName(buffered)

    def read(self, where: Column | None = None) -> DataFrame:
        """The live rows; ``where`` may only look at the key."""
        return self.merged(where).filter(~col(DEAD)).select(*[F.col(quoted(f.name)) for f in self.schema])
