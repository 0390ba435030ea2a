"""Lines of text in, lines of text out: SQL statements and key-value commands."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.database import Database
from millrace.errors import QueryError
from millrace.operators.kv import KeyValueStore

# The words that begin an SQL statement; any other line is a key-value command.
SQL_STARTS = ("CREATE", "INSERT", "SELECT", "UPDATE", "DELETE")


class Shell:
    """A database and a key-value store below one folder; they share no keys."""

    def __init__(self, spark: SparkSession, root: str):
        self.database, self.store = Database(spark, f"{root}/sql"), KeyValueStore(spark, f"{root}/kv")
        self.ended = False

    def run(self, line: str) -> str | None:
        """What a line prints: rows with their values joined by `` | ``, a message, or an error."""
        words = line.split()
        if not words:
            return None
        try:
            if words[0].upper() in SQL_STARTS:
                result = self.database.execute(line)
                if result.rows is None:
                    return result.message
                return "\n".join(" | ".join(map(str, r)) for r in result.rows.toLocalIterator())
            self.ended = words[0].upper() == "EXIT"
            return self.store.execute(line)
        except QueryError as e:
            return f"Error: {e}"

    def close(self) -> None:
        self.database.close()
        self.store.table.flush()
