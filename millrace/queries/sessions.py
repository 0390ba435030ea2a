"""Queries that take several statements or sessions: indexes under writes, recovery, the key-value commands, messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.database import Database
from millrace.plans.lexer import tokens
from millrace.queries.dialect import COPY, orders_copy
from millrace.queries.tables import table
from millrace.shell import Shell
from millrace.sources import workspace


def _indexed_after(column: str, index: str, op: str, value: int | str, *statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """A lookup in an index after statements have changed the table."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        db = orders_copy(spark, d)
        db.execute(f"CREATE INDEX {index} ON orders_copy ({column})")
        for s in statements:
            db.execute(s)
        return db.index_lookup(index, op, value)

    return run


def _over_index(text: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """A SELECT over a table with an index on its customer."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        db = orders_copy(spark, d)
        db.execute("CREATE INDEX by_customer ON orders_copy (o_custkey)")
        return db.sql(text, *names)

    return run


def keyed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One key of a table with several runs and buffered writes."""
    db = orders_copy(spark, d)
    db.execute("UPDATE orders_copy SET o_orderstatus = 'X' WHERE o_custkey < 100")
    db.execute("INSERT INTO orders_copy VALUES (42, 1, 'N')")
    return db.sql("SELECT * FROM orders_copy WHERE o_orderkey = 42")


def avg_negative(spark: SparkSession, d: str) -> DataFrame:
    """Averages below zero are cut toward zero too."""
    db = Database(spark, workspace.place(spark, "database"))
    balances = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 7 - F.col("c_nationkey")).alias("balance"))
    db.attach("balances", balances, "c_custkey")
    return db.sql("SELECT c_mktsegment, AVG(balance), SUM(balance), COUNT(*) FROM balances GROUP BY c_mktsegment", "c_mktsegment", "a", "s", "n")


def catalog_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Tables, columns and indexes as a session finds them that another has left."""
    root = workspace.place(spark, "database")
    first = Database(spark, root)
    first.execute("CREATE TABLE one (id INT PRIMARY KEY, name TEXT)")
    first.execute("CREATE TABLE two (code TEXT PRIMARY KEY, size INT, note TEXT)")
    first.execute("CREATE INDEX by_size ON two (size)")
    found = Database(spark, root).catalog
    rows = [("column", t.name, c.name, c.kind, c.primary_key) for t in found.tables.values() for c in t.columns]
    rows += [("index", i.table_name, i.column_name, i.name, False) for i in found.indexes.values()]
    return spark.createDataFrame(rows, "what string, table_name string, column_name string, kind string, is_key boolean")


def tokens_shown(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of a statement, as messages name them."""
    return spark.createDataFrame([(t.at, t.kind, str(t)) for t in tokens("SELECT a1, COUNT(*) FROM t WHERE b >= 'x y' LIMIT 7;")], "at int, kind string, shown string")


def _said(lines: list[str], reopen: int | None) -> Callable[[SparkSession, str], DataFrame]:
    """What a shell prints for each line; before line ``reopen`` the session ends without closing and another takes over."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        root = workspace.place(spark, "shell")
        shell, out = Shell(spark, root), []
        for i, line in enumerate(lines):
            if i == reopen:
                shell = Shell(spark, root)
            out.append((i, shell.run(line)))
        return spark.createDataFrame(out, "n int, said string")

    return run


_T = {"CREATE TABLE t (id INT PRIMARY KEY, name TEXT, age INT)": "Table created successfully", "INSERT INTO t VALUES (1, 'a', 5)": "Insert parsed successfully"}
#: name: (what each line prints, line before which another session takes over)
_LINES: dict[str, tuple[list[tuple[str, str | None]], int | None]] = {
    "kv_commands": (
        [
            ("SET b two words", "OK"), ("set a 1", "OK"), ("GET b", "two words"), ("GET nothing", None), ("DEL b", "OK"), ("GET b", "Key not found!"), ("SET c 3", "OK"), ("SCAN a d", "a = 1\nc = 3"),
            ("SET a 10", "OK"), ("SCAN a c", "a = 10"), ("COMPACT", "OK"), ("GET a", "10"), ("GET b", None), ("SCAN a z", "a = 10\nc = 3"), ("EXIT", None),
        ],
        None,
    ),
    "kv_replay": ([("SET a 1", "OK"), ("SET b 2", "OK"), ("DEL a", "OK"), ("SET c 3", "OK"), ("GET a", "Key not found!"), ("GET b", "2"), ("SCAN a z", "b = 2\nc = 3")], 4),
    "messages": (
        [
            *_T.items(), ("CREATE INDEX by_age ON t (age)", "Index created successfully"), ("UPDATE t SET age = 6 WHERE id = 1", "1 row updated"), ("UPDATE t SET age = 6 WHERE age > 5", "1 row(s) updated"), ("UPDATE t SET age = 6 WHERE id = 9", "0 rows updated"),
            ("SELECT * FROM t", "1 | a | 6"), ("DELETE FROM t WHERE age = 7", "0 rows deleted"), ("DELETE FROM t WHERE age = 6", "1 row(s) deleted"), ("SELECT COUNT(*) FROM t", "0"),
        ],
        None,
    ),
    "refusals": (
        [
            *_T.items(), ("CREATE TABLE t (id INT PRIMARY KEY)", 'Error: "table already exists"'), ("CREATE TABLE u (id INT)", "Error: table must contain exactly one PRIMARY KEY"), ("CREATE TABLE u (a INT PRIMARY KEY, b INT PRIMARY KEY)", "Error: multiple PRIMARY KEY columns are not allowed"),
            ("SELECT nope FROM t", "Error: unknown column 'nope'"), ("SELECT * FROM t ORDER BY nope", "Error: unknown column 'nope'"), ("SELECT * FROM t WHERE name = 1", "Error: type mismatch"), ("SELECT * FROM t WHERE 1 = id", "Error: left side of WHERE must be a column"),
            ("SELECT name, COUNT(*) FROM t", "Error: Column 'name' must appear in GROUP BY or be used in an aggregate function"), ("SELECT * FROM t GROUP BY name", "Error: SELECT * cannot be used with GROUP BY or aggregates"), ("SELECT SUM(name) FROM t", "Error: SUM only supports INTEGER columns"),
            ("INSERT INTO t VALUES ('x', 'a', 5)", "Error: Type mismatch: column 'id' expects Integer but received TEXT"), ("INSERT INTO t VALUES (1, 'a')", "Error: expected 3 values but received 2"), ("UPDATE t SET id = 2 WHERE id = 1", "Error: updating the primary key is not supported"),
            ("DELETE FROM t", "Error: DELETE without WHERE is not supported"), ("SELECT * FROM gone", "Error: table 'gone' does not exist"), ("SELECT FROM t", "Error: expected a column, found 'FROM' at position 7"), ("INSERT INTO t VALUES (1, 'a', 5) now", "Error: unexpected 'now' at position 33"),
        ],
        None,
    ),
}


def _values(said: list[str | None]) -> str:
    rows = ", ".join(f"({i}, NULL)" if x is None else "({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(said))
    return f"SELECT CAST(n AS INTEGER) AS n, said FROM (VALUES {rows}) AS v(n, said)"


_AVG = "CAST(CASE WHEN sum(b) < 0 THEN -(-sum(b) // count(*)) ELSE sum(b) // count(*) END AS BIGINT)"
_STATE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "index_after_update": (_indexed_after("o_orderstatus", "by_status", "=", "X", "UPDATE orders_copy SET o_orderstatus = 'X' WHERE o_custkey < 100"), "SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus FROM orders WHERE o_custkey < 100"),
    "index_stale_after_update": (_indexed_after("o_custkey", "by_customer", "=", 100, "UPDATE orders_copy SET o_custkey = 7 WHERE o_orderstatus = 'F'"), f"{COPY} WHERE o_custkey = 100 AND o_orderstatus <> 'F'"),
    "index_after_delete": (
        _indexed_after("o_custkey", "by_customer", "<=", 120, "DELETE FROM orders_copy WHERE o_custkey = 100", "INSERT INTO orders_copy VALUES (42, 100, 'N')"),
        f"{COPY} WHERE o_custkey <= 120 AND o_custkey <> 100 AND o_orderkey <> 42 UNION ALL SELECT 42, 100, 'N'",
    ),
    "index_aggregate": (
        _over_index("SELECT COUNT(*), SUM(o_orderkey), MIN(o_orderkey), MAX(o_orderstatus) FROM orders_copy WHERE o_custkey = 100", "n", "s", "lo", "hi"),
        "SELECT count(*) AS n, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS s, min(o_orderkey) AS lo, max(o_orderstatus) AS hi FROM orders WHERE o_custkey = 100 HAVING count(*) > 0",
    ),
    "index_group": (
        _over_index("SELECT o_orderstatus, COUNT(*) FROM orders_copy WHERE o_custkey <= 50 AND o_orderkey > 7 GROUP BY o_orderstatus HAVING COUNT(*) > 1", "o_orderstatus", "n"),
        "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey <= 50 AND o_orderkey > 7 GROUP BY o_orderstatus HAVING count(*) > 1",
    ),
    "keyed_lookup": (keyed_lookup, "SELECT CAST(42 AS BIGINT) AS o_orderkey, CAST(1 AS BIGINT) AS o_custkey, 'N' AS o_orderstatus"),
    "avg_negative": (avg_negative, f"SELECT c_mktsegment, {_AVG} AS a, CAST(sum(b) AS BIGINT) AS s, count(*) AS n FROM (SELECT c_mktsegment, c_custkey % 7 - c_nationkey AS b FROM customer) GROUP BY c_mktsegment"),
    "catalog_recovery": (
        catalog_recovery,
        """SELECT * FROM (VALUES ('column', 'one', 'id', 'INT', true), ('column', 'one', 'name', 'TEXT', false), ('column', 'two', 'code', 'TEXT', true),
  ('column', 'two', 'size', 'INT', false), ('column', 'two', 'note', 'TEXT', false), ('index', 'two', 'size', 'by_size', false)) AS v(what, table_name, column_name, kind, is_key)""",
    ),
    "tokens_shown": (
        tokens_shown,
        """SELECT CAST(p AS INTEGER) AS "at", kind, shown FROM (VALUES (0, 'keyword', '''SELECT'''), (7, 'word', '''a1'''), (9, 'sign', ''','''), (11, 'word', '''COUNT'''), (16, 'sign', '''('''), (17, 'sign', '''*'''),
  (18, 'sign', ''')'''), (20, 'keyword', '''FROM'''), (25, 'word', '''t'''), (27, 'keyword', '''WHERE'''), (33, 'word', '''b'''), (35, 'sign', '''>='''), (38, 'text', '''x y'''), (44, 'keyword', '''LIMIT'''),
  (50, 'number', '''7'''), (51, 'sign', ''';'''), (52, 'end', 'end of statement')) AS v(p, kind, shown)""",
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, (f, _) in _STATE.items()} | {k: _said([line for line, _ in said], at) for k, (said, at) in _LINES.items()}
SQL: dict[str, str] = {k: sql for k, (_, sql) in _STATE.items()} | {k: _values([s for _, s in said]) for k, (said, _) in _LINES.items()}
