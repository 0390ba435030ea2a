"""The key-value surface: a store with commands, and its operators on versioned records of any DataFrame.

The operators take records ``key, value, deleted, seq``: a higher ``seq`` is newer; a deleted one is a tombstone. Records with a
null key or ``seq`` are no versions and are left out; of records with one key and ``seq`` a tombstone wins,
then the greatest value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ParseError
from millrace.operators.changes import newest
from millrace.sources.tables import KeyedTable

RECORD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def merge(*runs: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """The newest version of each key over all runs, whichever run holds it."""
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    out = newest(rows, ["key"], ["seq"], "deleted")
    return out.filter(~F.col("deleted")) if drop_tombstones else out


def get(records: DataFrame, key: str) -> DataFrame:
    """The live version of one key, or none."""
    return merge(records.filter(F.col("key") == key), drop_tombstones=True)


def scan(records: DataFrame, start: str, end: str) -> DataFrame:
    """Live versions with ``start <= key < end``, by key. The range is cut out before anything is merged."""
    return merge(records.filter((F.col("key") >= start) & (F.col("key") < end)), drop_tombstones=True).orderBy("key")


def prefix_scan(records: DataFrame, prefix: str) -> DataFrame:
    """Live versions of keys with a prefix, by key."""
    return merge(records.filter(F.col("key").startswith(prefix)), drop_tombstones=True).orderBy("key")


class KeyValueStore:
    """``SET``, ``GET``, ``DEL``, ``SCAN``, ``COMPACT`` and ``EXIT`` over a durable keyed table."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = KeyedTable(spark, root, RECORD, "key")

    def set(self, key: str, value: str) -> None:
        self.table.write({"key": key, "value": value})

    def delete(self, key: str) -> None:
        """Write a tombstone, also for a key that doesn't exist."""
        self.table.write({"key": key}, dead=True)

    def version(self, key: str):
        """The newest version of a key, tombstones included, or None if it was never written."""
        if key in self.table.buffer:
            r = self.table.buffer[key]
            return r["value"], r["is_deleted"]
        r = self.table.merged(F.col("key") == key).first()
        return r and (r["value"], r["is_deleted"])

    def get(self, key: str) -> str | None:
        v = self.version(key)
        return None if v is None or v[1] else v[0]

    def scan(self, start: str, end: str) -> DataFrame:
        return self.table.read((F.col("key") >= start) & (F.col("key") < end)).orderBy("key")

    def prefix_scan(self, prefix: str) -> DataFrame:
        return self.table.read(F.col("key").startswith(prefix)).orderBy("key")

    def compact(self) -> None:
        self.table.compact()

    def execute(self, line: str) -> str | None:
        """Carry out a command; what it prints, if anything. A value is the words after the key, joined by single blanks."""
        words = line.split()
        match [w.upper() if i == 0 else w for i, w in enumerate(words)]:
            case ["SET", key, _, *_]:
                self.set(key, " ".join(words[2:]))
                return "OK"
            case ["GET", key]:
                v = self.version(key)
                return None if v is None else "Key not found!" if v[1] else v[0]
            case ["DEL", key]:
                self.delete(key)
                return "OK"
            case ["SCAN", start, end]:
                return "\n".join(f"{r['key']} = {r['value']}" for r in self.scan(start, end).toLocalIterator())
            case ["COMPACT"]:
                self.compact()
                return "OK"
            case ["EXIT"]:
                self.table.flush()
                return None
        raise ParseError(f"no command begins with '{words[0]}'" if words else "no command")
