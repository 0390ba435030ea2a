"""The SQL dialect and the key-value surface as queries over the driver's tables.

Reading queries attach the tables as they are. Writing ones fill a table of their own in working storage, apply the statements
and read it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.database import Database
from millrace.functions import rowtext
from millrace.operators import kv
from millrace.operators.changes import newest
from millrace.plans.parser import parse
from millrace.queries.tables import table
from millrace.sources import workspace

#: The unique key of each table that has one of a single column.
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id", "block_records": "record_id", "eval_items": "item_id"}


def _reads(text: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    name = parse(text).table

    def run(spark: SparkSession, d: str) -> DataFrame:
        db = Database(spark, workspace.place(spark, "database"))
        db.attach(name, table(spark, d, name), KEYS.get(name))
        return db.sql(text, *names)

    return run


#: name: (statement of the dialect, names of its columns, SQL)
_SELECTS: dict[str, tuple[str, tuple[str, ...], str]] = {}


def _add(name: str, text: str, names: str = "", sql: str | None = None) -> None:
    _SELECTS[name] = text, tuple(names.split()), sql or text


_add("scan_all", "SELECT * FROM region")
_add("project_cols", "SELECT c_custkey, c_name FROM customer")
_add("select_star", "SELECT * FROM nation")
_add("select_star_and_column", "SELECT *, n_name FROM nation", "k a r b", "SELECT n_nationkey AS k, n_name AS a, n_regionkey AS r, n_name AS b FROM nation")
for _word, _op in (("eq", "="), ("ne", "!="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _add(f"filter_{_word}_int", f"SELECT o_orderkey FROM orders WHERE o_custkey {_op} 100")
    _add(f"filter_{_word}_text", f"SELECT c_custkey FROM customer WHERE c_mktsegment {_op} 'BUILDING'")
    _add(f"having_count_{_word}", f"SELECT p_size, COUNT(*) FROM part GROUP BY p_size HAVING COUNT(*) {_op} 40", "p_size n", f"SELECT p_size, count(*) AS n FROM part GROUP BY p_size HAVING count(*) {_op} 40")
_add("filter_and", "SELECT p_partkey FROM part WHERE p_size > 25 AND p_brand = 'Brand#10'")
_add("filter_or", "SELECT p_partkey FROM part WHERE p_size = 40 OR p_brand = 'Brand#10'")
_add("filter_precedence", "SELECT p_partkey FROM part WHERE p_size > 25 AND p_brand = 'Brand#10' OR p_size = 3")
_add("filter_nested", "SELECT p_partkey FROM part WHERE (p_size > 25 AND (p_brand = 'Brand#10' OR p_size = 40)) OR p_size <= 3")
_add("pk_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")
_add("agg_count", "SELECT COUNT(*) FROM orders", "n", "SELECT count(*) AS n FROM orders")
_add("agg_count_where", "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F'", "n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
_add("agg_min_int", "SELECT MIN(o_custkey) FROM orders", "m", "SELECT min(o_custkey) AS m FROM orders")
_add("agg_max_int", "SELECT MAX(o_custkey) FROM orders", "m", "SELECT max(o_custkey) AS m FROM orders")
_add("agg_min_text", "SELECT MIN(c_name) FROM customer", "m", "SELECT min(c_name) AS m FROM customer")
_add("agg_max_text", "SELECT MAX(c_name) FROM customer", "m", "SELECT max(c_name) AS m FROM customer")
_add("agg_min_empty", "SELECT MIN(o_custkey) FROM orders WHERE o_custkey > 999999999", "m", "SELECT min(o_custkey) AS m FROM orders WHERE o_custkey > 999999999 HAVING count(*) > 0")
_add("agg_max_empty", "SELECT MAX(o_custkey) FROM orders WHERE o_custkey > 999999999", "m", "SELECT max(o_custkey) AS m FROM orders WHERE o_custkey > 999999999 HAVING count(*) > 0")
_add("agg_sum", "SELECT SUM(l_linenumber) FROM lineitem", "s", "SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS s FROM lineitem")
_add("agg_sum_empty", "SELECT SUM(l_linenumber) FROM lineitem WHERE l_linenumber > 99", "s", "SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS s FROM lineitem WHERE l_linenumber > 99")
_AVG = "CAST(CASE WHEN count(*) = 0 THEN 0 ELSE sum({0}) // count(*) END AS BIGINT)"
_add("agg_avg", "SELECT AVG(l_partkey) FROM lineitem", "a", f"SELECT {_AVG.format('l_partkey')} AS a FROM lineitem")
_add("agg_avg_empty", "SELECT AVG(l_partkey) FROM lineitem WHERE l_partkey > 999999999", "a", f"SELECT {_AVG.format('l_partkey')} AS a FROM lineitem WHERE l_partkey > 999999999")
_add("agg_count_empty", "SELECT COUNT(*) FROM orders WHERE o_custkey > 999999999", "n", "SELECT count(*) AS n FROM orders WHERE o_custkey > 999999999")
_add("agg_several", "SELECT COUNT(*), MIN(p_size), MAX(p_brand) FROM part", "n a b", "SELECT count(*) AS n, min(p_size) AS a, max(p_brand) AS b FROM part")
_add("group_by_one", "SELECT l_returnflag, COUNT(*) FROM lineitem GROUP BY l_returnflag", "l_returnflag n", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
_add("group_by_multi", "SELECT l_returnflag, l_linestatus, COUNT(*) FROM lineitem GROUP BY l_returnflag, l_linestatus", "l_returnflag l_linestatus n", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
_add("group_no_agg", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", "", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_add("group_sum", "SELECT l_returnflag, SUM(l_linenumber) FROM lineitem GROUP BY l_returnflag", "l_returnflag s", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY ALL")
_add("group_avg", "SELECT l_returnflag, AVG(l_partkey) FROM lineitem GROUP BY l_returnflag", "l_returnflag a", f"SELECT l_returnflag, {_AVG.format('l_partkey')} AS a FROM lineitem GROUP BY ALL")
for _f in ("min", "max"):
    _add(f"group_{_f}_int", f"SELECT c_mktsegment, {_f.upper()}(c_nationkey) FROM customer GROUP BY c_mktsegment", "c_mktsegment m", f"SELECT c_mktsegment, {_f}(c_nationkey) AS m FROM customer GROUP BY ALL")
    _add(f"group_{_f}_text", f"SELECT c_mktsegment, {_f.upper()}(c_name) FROM customer GROUP BY c_mktsegment", "c_mktsegment m", f"SELECT c_mktsegment, {_f}(c_name) AS m FROM customer GROUP BY ALL")
_add(
    "group_multi_agg",
    "SELECT l_returnflag, COUNT(*), SUM(l_linenumber), MIN(l_partkey), MAX(l_suppkey), AVG(l_partkey) FROM lineitem GROUP BY l_returnflag",
    "l_returnflag n s lo hi a",
    f"SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_partkey) AS lo, max(l_suppkey) AS hi, {_AVG.format('l_partkey')} AS a FROM lineitem GROUP BY ALL",
)
_add("having_sum_ge", "SELECT p_brand, SUM(p_size) FROM part GROUP BY p_brand HAVING SUM(p_size) >= 2000", "p_brand s", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY ALL HAVING sum(p_size) >= 2000")
_add("having_avg_ge", "SELECT p_brand FROM part GROUP BY p_brand HAVING AVG(p_size) >= 25", "", "SELECT p_brand FROM part GROUP BY p_brand HAVING sum(p_size) // count(*) >= 25")
_add("having_min_gt", "SELECT o_custkey, MIN(o_orderkey) FROM orders GROUP BY o_custkey HAVING MIN(o_orderkey) > 1000", "o_custkey m", "SELECT o_custkey, min(o_orderkey) AS m FROM orders GROUP BY ALL HAVING min(o_orderkey) > 1000")
_add("having_max_lt", "SELECT o_custkey, MAX(o_orderkey) FROM orders GROUP BY o_custkey HAVING MAX(o_orderkey) < 9000", "o_custkey m", "SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY ALL HAVING max(o_orderkey) < 9000")
_add("having_hidden_agg", "SELECT p_size FROM part GROUP BY p_size HAVING MAX(p_partkey) > MIN(p_partkey) AND COUNT(*) > 40", "", "SELECT p_size FROM part GROUP BY p_size HAVING max(p_partkey) > min(p_partkey) AND count(*) > 40")
_add("having_column_or", "SELECT p_size, COUNT(*) FROM part GROUP BY p_size HAVING p_size = 7 OR COUNT(*) < 30", "p_size n", "SELECT p_size, count(*) AS n FROM part GROUP BY p_size HAVING p_size = 7 OR count(*) < 30")
_add("where_group_by", "SELECT o_orderstatus, COUNT(*) FROM orders WHERE o_custkey >= 500 GROUP BY o_orderstatus", "o_orderstatus n", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey >= 500 GROUP BY ALL")
_add("group_order_limit", "SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey ORDER BY o_custkey DESC LIMIT 7", "o_custkey n", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY o_custkey DESC LIMIT 7")
_add("order_asc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey")
_add("order_desc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC")
_add("order_text", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment")
_add("order_hidden_key", "SELECT o_orderkey FROM orders ORDER BY o_custkey")
_add("limit", "SELECT o_orderkey FROM orders LIMIT 10", "", "SELECT o_orderkey FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 10")
_add("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
_add("topk", "SELECT o_orderkey FROM orders ORDER BY o_custkey DESC LIMIT 10", "", "SELECT o_orderkey FROM orders ORDER BY o_custkey DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10")
_add("where_topk", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_custkey LIMIT 10", "", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_custkey, CAST(o_orderkey AS VARCHAR) LIMIT 10")
_add("distinct_one", "SELECT DISTINCT o_orderstatus FROM orders")
_add("distinct_multi", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_add("distinct_where", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_custkey < 100")
_add("distinct_order", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority DESC")
_add("distinct_limit", "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 5")
_add("distinct_star", "SELECT DISTINCT * FROM region")
for _word, _dir in (("asc", ""), ("desc", " DESC")):
    _add(
        f"distinct_hidden_{_word}",
        f"SELECT DISTINCT p_brand FROM part ORDER BY p_size{_dir} LIMIT 9",
        "",
        f"""SELECT p_brand FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size{_dir}, CAST(p_partkey AS VARCHAR)) AS nth, CAST(p_partkey AS VARCHAR) AS t FROM part)
WHERE nth = 1 ORDER BY p_size{_dir}, t LIMIT 9""",
    )
_add("users_by_city", "SELECT city, COUNT(*), MIN(age), MAX(age) FROM users GROUP BY city", "city n lo hi", "SELECT city, count(*) AS n, min(age) AS lo, max(age) AS hi FROM users GROUP BY ALL")
_add("employees_by_department", "SELECT department, COUNT(*), SUM(salary), AVG(salary), MIN(city) FROM employees GROUP BY department", "department n s a c", f"SELECT department, count(*) AS n, CAST(sum(salary) AS BIGINT) AS s, {_AVG.format('salary')} AS a, min(city) AS c FROM employees GROUP BY ALL")


# -- indexes ------------------------------------------------------------------------------------------------


def _indexed(op: str, value: int | str, index: str = "by_customer") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        db = orders_copy(spark, d)
        db.execute("CREATE INDEX by_customer ON orders_copy (o_custkey)")
        db.execute("CREATE INDEX by_status ON orders_copy (o_orderstatus)")
        return db.index_lookup(index, op, value)

    return run


def orders_copy(spark: SparkSession, d: str) -> Database:
    db = Database(spark, workspace.place(spark, "database"))
    db.execute("CREATE TABLE orders_copy (o_orderkey INT PRIMARY KEY, o_custkey INT, o_orderstatus TEXT)")
    db.insert_many("orders_copy", table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return db


def index_entries(spark: SparkSession, d: str) -> DataFrame:
    db = orders_copy(spark, d)
    db.execute("CREATE INDEX by_status ON orders_copy (o_orderstatus)")
    return db.index_entries("by_status")


# -- writing ------------------------------------------------------------------------------------------------


def _writes(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        db = orders_copy(spark, d)
        for s in statements:
            db.execute(s)
        return db.sql("SELECT * FROM orders_copy")

    return run


COPY = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
#: name: (statements, SQL of the table afterwards)
_WRITES: dict[str, tuple[tuple[str, ...], str]] = {
    "update_pk": (("UPDATE orders_copy SET o_orderstatus = 'X' WHERE o_orderkey = 42",), "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 42 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "update_where": (("UPDATE orders_copy SET o_orderstatus = 'X' WHERE o_custkey < 100 OR o_custkey = 300",), "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 100 OR o_custkey = 300 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "update_multi_col": (
        ("UPDATE orders_copy SET o_orderstatus = 'X', o_custkey = 7 WHERE o_orderstatus = 'F'",),
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 7 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    ),
    "delete_pk": (("DELETE FROM orders_copy WHERE o_orderkey = 42",), f"{COPY} WHERE o_orderkey <> 42"),
    "insert_upsert": (
        ("INSERT INTO orders_copy VALUES (42, 1, 'N')", "INSERT INTO orders_copy (o_orderstatus, o_orderkey, o_custkey) VALUES ('N', 900000001, 2)"),
        f"{COPY} WHERE o_orderkey <> 42 UNION ALL SELECT 42, 1, 'N' UNION ALL SELECT 900000001, 2, 'N'",
    ),
    "insert_after_delete": (("DELETE FROM orders_copy WHERE o_custkey >= 10", "INSERT INTO orders_copy VALUES (42, 1, 'N')"), f"{COPY} WHERE o_custkey < 10 AND o_orderkey <> 42 UNION ALL SELECT 42, 1, 'N'"),
}
for _word, _op in (("eq", "="), ("ne", "!="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _WRITES[f"delete_{_word}"] = (f"DELETE FROM orders_copy WHERE o_custkey {_op} 700",), f"{COPY} WHERE NOT (o_custkey {_op} 700)"


# -- key-value records --------------------------------------------------------------------------------------


def _records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"), (F.col("event_id") % 7 == 0).alias("deleted"), F.col("event_id").alias("seq"))


def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return kv.merge(_records(spark, d))


def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.get(_records(spark, d), "click:5")


def kv_scan(spark: SparkSession, d: str) -> DataFrame:
    return kv.scan(_records(spark, d), "click:2", "purchase:5")


def kv_prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return kv.prefix_scan(_records(spark, d), "view:1")


def _runs(spark: SparkSession, d: str) -> list[DataFrame]:
    r = _records(spark, d)
    return [r.filter(F.pmod("seq", F.lit(3)) == k) for k in (2, 0, 1)]


def kv_merge_keep_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return kv.merge(*_runs(spark, d))


def kv_merge_drop_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return kv.merge(*_runs(spark, d), drop_tombstones=True)


def _versions(spark: SparkSession, d: str) -> kv.KeyValueStore:
    """All versions in a store, as three runs that share keys, tombstones older and newer than values among them."""
    store = kv.KeyValueStore(spark, workspace.place(spark, "kv"))
    rows = _records(spark, d).select("key", "value", F.col("seq").alias("change_no"), F.col("deleted").alias("is_deleted"))
    for k in (2, 0, 1):
        store.table.log.append(rows.filter(F.pmod("change_no", F.lit(3)) == k))
    return store


def kv_compact(spark: SparkSession, d: str) -> DataFrame:
    """Three runs of versions, compacted to one, and read back."""
    store = _versions(spark, d)
    store.table.seq = store.table.log.greatest("change_no")
    store.compact()
    return store.table.read()


def kv_merge_on_read(spark: SparkSession, d: str) -> DataFrame:
    """The same runs, merged when they are read."""
    return _versions(spark, d).table.read()


def kv_purge(spark: SparkSession, d: str) -> DataFrame:
    """Tombstones before and after all runs were merged to one that no older change can follow."""
    log = _versions(spark, d).table.log
    count = F.count_if("is_deleted")
    n_before = log.merged().agg(count.alias("n")).first()["n"]
    log.compact(horizon=log.greatest("change_no") + 1)
    return log.merged().agg(F.lit(n_before).alias("n_before"), count.alias("n_after"))


_VERSIONS = """WITH records AS (
  SELECT concat_ws(':', event_type, CAST(user_id AS VARCHAR)) AS key, props AS value, event_id % 7 = 0 AS deleted, event_id AS seq FROM events
), newest AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
"""

_KV = {
    "kv_latest": (kv_latest, "SELECT * FROM newest"),
    "kv_get": (kv_get, "SELECT * FROM newest WHERE key = 'click:5' AND NOT deleted"),
    "kv_scan": (kv_scan, "SELECT * FROM newest WHERE key >= 'click:2' AND key < 'purchase:5' AND NOT deleted"),
    "kv_prefix_scan": (kv_prefix_scan, "SELECT * FROM newest WHERE starts_with(key, 'view:1') AND NOT deleted"),
    "kv_merge_keep_tombstones": (kv_merge_keep_tombstones, "SELECT * FROM newest"),
    "kv_merge_drop_tombstones": (kv_merge_drop_tombstones, "SELECT * FROM newest WHERE NOT deleted"),
    "kv_compact": (kv_compact, "SELECT key, value FROM newest WHERE NOT deleted"),
    "kv_merge_on_read": (kv_merge_on_read, "SELECT key, value FROM newest WHERE NOT deleted"),
    "kv_purge": (kv_purge, "SELECT CAST(count_if(deleted) AS BIGINT) AS n_before, CAST(0 AS BIGINT) AS n_after FROM newest"),
}

# -- tables kept as text in the store -----------------------------------------------------------------------

_USERS = {"id": "INT", "username": "TEXT", "age": "INT", "city": "TEXT"}


def _live(spark: SparkSession, d: str, *prefixes: str) -> DataFrame:
    """The live records of the feed whose keys begin so; the rest of the keyspace isn't merged."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("rec_key").startswith(p)
    rows = table(spark, d, "block_records").select("rec_key", "rec_value", "deleted", "iter_index", "seq").filter(wanted)
    return newest(rows, ["rec_key"], ["iter_index", "seq"], "deleted").filter("not deleted")


def store_table(spark: SparkSession, d: str) -> DataFrame:
    return rowtext.table_rows(_live(spark, d, "users:"), "users", _USERS)


def store_group_by(spark: SparkSession, d: str) -> DataFrame:
    db = Database(spark, workspace.place(spark, "database"))
    db.attach("users", store_table(spark, d), "id")
    return db.sql("SELECT city, COUNT(*), MAX(age) FROM users WHERE age >= 18 GROUP BY city HAVING COUNT(*) > 1", "city", "n", "oldest")


def store_index_eq(spark: SparkSession, d: str) -> DataFrame:
    live = _live(spark, d, "users:", rowtext.index_prefix("users", "city"))
    return rowtext.index_rows(live, "users", "city", "TEXT", "=", "Kestrel: East").select("rec_key", "rec_value")


def store_index_range(spark: SparkSession, d: str) -> DataFrame:
    live = _live(spark, d, "badges:", rowtext.index_prefix("badges", "tier"))
    return rowtext.index_rows(live, "badges", "tier", "INT", ">=", 400).select("rec_key", "rec_value")


_STORE = r"""WITH live AS (
  SELECT * FROM (SELECT * FROM block_records QUALIFY row_number() OVER (PARTITION BY rec_key ORDER BY iter_index DESC, seq DESC) = 1) WHERE NOT deleted
), users_kept AS (
  SELECT CAST(nullif(regexp_extract(rec_value, '(^|\|)id=i:(-?\d+)', 2), '') AS BIGINT) AS id, CASE WHEN regexp_matches(rec_value, '(^|\|)username=t:') THEN regexp_extract(rec_value, '(^|\|)username=t:([^|]*)', 2) END AS username,
         CAST(nullif(regexp_extract(rec_value, '(^|\|)age=i:(-?\d+)', 2), '') AS BIGINT) AS age, CASE WHEN regexp_matches(rec_value, '(^|\|)city=t:') THEN regexp_extract(rec_value, '(^|\|)city=t:([^|]*)', 2) END AS city
  FROM live WHERE starts_with(rec_key, 'users:')
)
"""
_BY_INDEX = "SELECT rec_key, rec_value FROM live WHERE starts_with(rec_key, '{0}:') AND rec_key IN (SELECT '{0}:' || split_part(rec_key, ':', -1) FROM live WHERE starts_with(rec_key, '__index__:{0}:{1}:') AND {2})"

_KEPT = {
    "store_table": (store_table, _STORE + "SELECT * FROM users_kept"),
    "store_group_by": (store_group_by, _STORE + "SELECT city, count(*) AS n, max(age) AS oldest FROM users_kept WHERE age >= 18 GROUP BY city HAVING count(*) > 1"),
    "store_index_eq": (store_index_eq, _STORE + _BY_INDEX.format("users", "city", "starts_with(rec_key, '__index__:users:city:Kestrel: East:') AND NOT contains(substr(rec_key, 36), ':')")),
    "store_index_range": (store_index_range, _STORE + _BY_INDEX.format("badges", "tier", "CAST(split_part(rec_key, ':', 4) AS BIGINT) >= 400")),
}

_INDEXED = {
    "index_eq": (_indexed("=", 100), "= 100"),
    "index_range_gt": (_indexed(">", 1200), "> 1200"),
    "index_range_ge": (_indexed(">=", 1200), ">= 1200"),
    "index_range_lt": (_indexed("<", 300), "< 300"),
    "index_range_le": (_indexed("<=", 300), "<= 300"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: _reads(text, *names) for k, (text, names, _) in _SELECTS.items()},
    **{k: f for k, (f, _) in _INDEXED.items()},
    "index_eq_text": _indexed("=", "F", "by_status"),
    "index_entries": index_entries,
    **{k: _writes(*statements) for k, (statements, _) in _WRITES.items()},
    **{k: f for k, (f, _) in _KV.items()},
    **{k: f for k, (f, _) in _KEPT.items()},
}

SQL: dict[str, str] = {
    **{k: sql for k, (_, _, sql) in _SELECTS.items()},
    **{k: f"{COPY} WHERE o_custkey {predicate}" for k, (_, predicate) in _INDEXED.items()},
    "index_eq_text": f"{COPY} WHERE o_orderstatus = 'F'",
    "index_entries": "SELECT o_orderstatus, o_orderkey FROM orders",
    **{k: sql for k, (_, sql) in _WRITES.items()},
    **{k: _VERSIONS + sql for k, (_, sql) in _KV.items()},
    **{k: sql for k, (_, sql) in _KEPT.items()},
}
