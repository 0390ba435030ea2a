from pathlib import Path

import pytest

from millrace.database import Database
from millrace.errors import QueryError
from millrace.operators import kv
from millrace.operators.kv import KeyValueStore
from millrace.shell import Shell
from millrace.sources import tables
from millrace.streaming.feeds import follow


def fill(db, n=5):
    db.execute("CREATE TABLE users (id INT PRIMARY KEY, name TEXT, age INT)")
    for i in range(1, n + 1):
        db.execute(f"INSERT INTO users VALUES ({i}, 'u{i}', {20 + i % 2})")
    return db


def rows(db, text="SELECT * FROM users"):
    return sorted(tuple(r) for r in db.sql(text).collect())


@pytest.fixture
def db(spark, folder):
    return fill(Database(spark, folder))


def test_insert_overwrites_and_takes_columns_in_any_order(db):
    assert db.execute("INSERT INTO users (age, id, name) VALUES (9, 1, 'new')").message == "Insert parsed successfully"
    assert rows(db)[0] == (1, "new", 9) and len(rows(db)) == 5


def test_buffer_runs_and_their_mix(spark, db, folder, monkeypatch):
    db.close()
    db.execute("INSERT INTO users VALUES (2, 'newer', 1)")
    db.execute("INSERT INTO users VALUES (6, 'six', 1)")
    assert [r[1] for r in rows(db)] == ["u1", "newer", "u3", "u4", "u5", "six"]
    # what was never flushed is recovered from the write-ahead files, twice if need be
    for _ in range(2):
        assert rows(Database(spark, folder)) == rows(db)
    monkeypatch.setattr(tables, "FLUSH", 3)
    db.execute("INSERT INTO users VALUES (7, 'seven', 1)")
    assert not db._open["users"].buffer and len(rows(Database(spark, folder))) == 7


def test_damaged_write_ahead_files(spark, db, folder):
    wal = Path(folder.removeprefix("file://")) / "tables/users/wal"
    names = sorted(p for p in wal.iterdir() if p.name.endswith(".json"))
    names[-1].write_text(names[-1].read_text()[:-4])
    for p in wal.glob(".*.crc"):
        p.unlink()
    assert [r[0] for r in rows(Database(spark, folder))] == [1, 2, 3, 4]
    names[1].write_text("00000000 {}")
    with pytest.raises(QueryError, match="is damaged"):
        Database(spark, folder).rows("users")


def test_two_sessions_do_not_write_over_each_other(spark, db, folder):
    other = Database(spark, folder)
    other.rows("users")
    other.execute("INSERT INTO users VALUES (6, 'six', 6)")
    with pytest.raises(QueryError, match="another session"):
        db.execute("INSERT INTO users VALUES (7, 'seven', 7)")


def test_replaying_after_a_flush_that_left_its_files(spark, db, folder):
    t = db._open["users"]
    t.log.append(t._buffered())  # the commit of a flush that then crashed
    db.execute("DELETE FROM users WHERE id = 1")
    assert [r[0] for r in rows(Database(spark, folder))] == [2, 3, 4, 5]


@pytest.mark.parametrize(("op", "left"), [(">", [1, 2, 3]), (">=", [1, 2]), ("<", [3, 4, 5]), ("<=", [4, 5]), ("!=", [3]), ("=", [1, 2, 4, 5])])
def test_delete(db, op, left):
    message = db.execute(f"DELETE FROM users WHERE id {op} 3").message
    assert [r[0] for r in rows(db)] == left
    assert message == ("1 row deleted" if op == "=" else f"{5 - len(left)} row(s) deleted")
    assert db.execute("DELETE FROM users WHERE id = 99").message == "0 rows deleted"


def test_update(db):
    assert db.execute("UPDATE users SET age = 50, name = 'x' WHERE id = 2").message == "1 row updated"
    assert db.execute("UPDATE users SET age = 60 WHERE age = 21").message == "3 row(s) updated"
    assert db.execute("UPDATE users SET age = 1 WHERE id = 9 AND age = 4").message == "0 rows updated"
    assert rows(db) == [(1, "u1", 60), (2, "x", 50), (3, "u3", 60), (4, "u4", 20), (5, "u5", 60)]
    db.execute("DELETE FROM users WHERE id = 2")
    db.execute("INSERT INTO users VALUES (2, 'again', 3)")
    db.compact("users")
    assert rows(db)[1] == (2, "again", 3) and len(rows(db)) == 5


def test_text_keys_and_two_tables(spark, folder):
    db = Database(spark, folder)
    for t in ("a", "b"):
        db.execute(f"CREATE TABLE {t} (name TEXT PRIMARY KEY, n INT)")
        db.execute(f"INSERT INTO {t} VALUES ('it: {t}|x=t:y', 1)")
    db.execute("DELETE FROM a WHERE name = 'it: a|x=t:y'")
    assert rows(db, "SELECT * FROM a") == [] and rows(db, "SELECT * FROM b") == [("it: b|x=t:y", 1)]


def test_indexes(spark, db, folder):
    assert db.execute("CREATE INDEX by_age ON users (age)").message == "Index created successfully"
    assert sorted(r.id for r in db.index_lookup("by_age", ">", 20).collect()) == [1, 3, 5]
    db.execute("UPDATE users SET age = 99 WHERE id = 1")
    assert [tuple(r) for r in db.index_entries("by_age").collect()] == [(20, 2), (20, 4), (21, 3), (21, 5), (99, 1)]
    again = Database(spark, folder)
    assert again.catalog.indexes_for("users")[0].column_name == "age" and again.catalog.table("users") == db.catalog.table("users")


def test_insert_many(spark, db):
    new = spark.createDataFrame([("bulk", 7, 1), ("twice", 7, 1), ("one", 1, 1)], "name string, id long, age int")
    db.insert_many("users", new)
    assert len(rows(db)) == 6 and (1, "one", 1) in rows(db)
    with pytest.raises(QueryError):
        db.insert_many("users", new.drop("age"))
    with pytest.raises(QueryError):
        db.insert_many("users", new.selectExpr("name", "id", "string(age) age"))


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("CREATE TABLE users (id INT PRIMARY KEY)", '"table already exists"'), ("CREATE TABLE x (a INT)", "table must contain exactly one PRIMARY KEY"), ("CREATE TABLE x (a INT PRIMARY KEY, b INT PRIMARY KEY)", "multiple PRIMARY KEY columns are not allowed"),
        ("CREATE TABLE x (a INT PRIMARY KEY, A INT)", "column names must differ, also when written in one case"), ("CREATE INDEX i ON users (nope)", "unknown column 'nope'"), ("CREATE INDEX i ON nowhere (a)", "table 'nowhere' does not exist"),
        ("INSERT INTO users VALUES (1, 'a')", "expected 3 values but received 2"), ("INSERT INTO users (id, name) VALUES (1, 'a')", "missing value for column 'age'"), ("INSERT INTO users (id, name, age, x) VALUES (1, 'a', 1, 1)", "unknown column 'x'"), ("INSERT INTO users (id, id, age) VALUES (1, 1, 1)", "a column is named twice"),
        ("INSERT INTO users VALUES ('1', 'a', 1)", "Type mismatch: column 'id' expects Integer but received TEXT"), ("INSERT INTO users VALUES (1, 2, 1)", "Type mismatch: column 'name' expects Text but received INTEGER"),
        ("UPDATE users SET age = 1", "UPDATE without WHERE is not supported"), ("UPDATE users SET id = 1 WHERE id = 2", "updating the primary key is not supported"), ("UPDATE users SET x = 1 WHERE id = 2", "unknown column 'x'"), ("UPDATE users SET age = 'x' WHERE id = 2", "Type mismatch: column 'age' expects Integer but received TEXT"),
        ("DELETE FROM users", "DELETE without WHERE is not supported"), ("DELETE FROM users WHERE name = 1", "type mismatch"), ("DELETE FROM nowhere WHERE a = 1", "table 'nowhere' does not exist"),
    ],
)
def test_messages(spark, tmp_path_factory, text, message, request):
    if not hasattr(test_messages, "db"):
        test_messages.db = fill(Database(spark, f"file://{tmp_path_factory.mktemp('db')}"))
    with pytest.raises(QueryError) as e:
        test_messages.db.execute(text)
    assert str(e.value) == message
    assert len(rows(test_messages.db)) == 5


def test_key_value_commands(spark, folder):
    s = KeyValueStore(spark, folder)
    steps = [("SET a 1 2   3", "OK"), ("get a", "1 2 3"), ("GET zz", None), ("DEL a", "OK"), ("GET a", "Key not found!"), ("DEL never", "OK"), ("GET never", "Key not found!"), ("SET b x", "OK"), ("SET ab y", "OK"), ("SCAN a b", "ab = y"), ("COMPACT", "OK"), ("SCAN a z", "ab = y\nb = x"), ("GET a", None), ("SET b newer", "OK"), ("EXIT", None)]
    for line, out in steps:
        assert s.execute(line) == out, line
    again = KeyValueStore(spark, folder)
    assert again.get("b") == "newer" and [r["key"] for r in again.prefix_scan("a").collect()] == ["ab"]
    with pytest.raises(QueryError):
        s.execute("PUT a b")


def test_versions_of_any_records(spark):
    schema = "key string, value string, deleted boolean, seq long"
    old = spark.createDataFrame([("a", "1", False, 1), ("b", "1", False, 2), ("c", None, True, 3)], schema)
    new = spark.createDataFrame([("a", "0", False, 0), ("b", None, True, 9), ("d", "1", False, 4), (None, "x", False, 1)], schema)
    both = old.unionByName(new)
    assert {r["key"]: r["deleted"] for r in kv.merge(new, old).collect()} == {"a": False, "b": True, "c": True, "d": False}
    assert {r["key"]: r["value"] for r in kv.merge(old, new, drop_tombstones=True).collect()} == {"a": "1", "d": "1"}
    assert [r["key"] for r in kv.scan(both, "a", "d").collect()] == ["a"] and kv.get(both, "b").count() == 0 and kv.get(both, "d").count() == 1
    assert [r["key"] for r in kv.prefix_scan(both, "").collect()] == ["a", "d"]


def test_shell(spark, folder):
    sh = Shell(spark, folder)
    lines = [("CREATE TABLE t (id INT PRIMARY KEY, s TEXT)", "Table created successfully"), ("insert into t values (1, 'x')", "Insert parsed successfully"), ("SELECT * FROM t", "1 | x"), ("SELECT * FROM u", "Error: table 'u' does not exist"), ("SET t:1 foo", "OK"), ("SELECT COUNT(*) FROM t", "1"), ("nonsense", "Error: no command begins with 'nonsense'"), (" ", None)]
    for line, out in lines:
        assert sh.run(line) == out
    sh.run("EXIT")
    assert sh.ended
    sh.close()


def test_streaming_feed(spark, folder):
    from millrace.operators.changes import ChangeLog

    schema = "k string, v string, dead boolean, seq long"
    spark.createDataFrame([("a", "1", False, 1), ("b", "1", False, 2)], schema).coalesce(1).write.parquet(folder + "/in")
    log = ChangeLog(spark, folder + "/log", "k", ["seq"], "dead", buckets=2)

    def run():
        q = follow(spark.readStream.schema(schema).parquet(folder + "/in"), log, folder + "/checkpoint")
        q.awaitTermination(60)

    run()
    spark.createDataFrame([("b", None, True, 3), ("a", "0", False, 0), ("c", "1", False, 4)], schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    run()
    assert {r.k: r.v for r in log.read().collect()} == {"a": "1", "c": "1"}


@pytest.mark.parametrize("bad", [(None, "b", 1), (2, None, 1), (2, "b", None)])
def test_null_in_bulk_rows_fails_the_whole_statement(spark, db, bad):
    before = rows(db)
    with pytest.raises(QueryError, match="missing value"):
        db.insert_many("users", spark.createDataFrame([(77, "a", 1), bad], "id long, name string, age long"))
    assert rows(db) == before


def test_index_lookup_reads_the_buckets_of_its_value_and_of_its_keys(spark, folder):
    db = Database(spark, folder)
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, size INT, name TEXT)")
    db.insert_many("t", spark.range(4000).selectExpr("id", "id div 2 as size", "concat('n', id) as name"))
    db.execute("CREATE INDEX by_size ON t (size)")
    db.insert_many("t", spark.range(4000, 5000).selectExpr("id", "id div 2 as size", "concat('n', id) as name"))
    seen = []
    index = db._table(db.catalog.table("t")).indexes["by_size"]
    read = index.read
    index.read = lambda *a, **k: (seen.append(read(*a, **k)), seen[-1])[1]
    out = db.index_lookup("by_size", "=", 700)
    assert sorted(r.id for r in out.collect()) == [1400, 1401]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 4" in plan(seen[0]) and "Exchange" not in plan(seen[0]) and "EqualTo(size,700)" in plan(seen[0])
    assert "SelectedBucketsCount: 1 out of 4" in plan(out) or "SelectedBucketsCount: 2 out of 4" in plan(out)
    assert [r.name for r in db.sql("SELECT name FROM t WHERE size = 700 AND id > 1400").collect()] == ["n1401"]
    assert "SelectedBucketsCount: 1 out of 4" in plan(db.sql("SELECT name FROM t WHERE id = 7 AND name != 'x'"))


def test_an_index_follows_all_writes(spark, folder, monkeypatch):
    import random

    monkeypatch.setattr(tables, "FLUSH", 4)
    rng, state = random.Random(8), {}
    db = Database(spark, folder)
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, size INT, name TEXT)")
    db.execute("CREATE INDEX by_size ON t (size)")
    db.execute("CREATE INDEX by_name ON t (name)")
    for step in range(24):
        i, size, name = rng.randrange(8), rng.randrange(4), rng.choice(["a", "b:c", ""])
        match rng.randrange(5):
            case 0 | 1 | 2:
                db.execute(f"INSERT INTO t VALUES ({i}, {size}, '{name}')")
                state[i] = size, name
            case 3:
                db.execute(f"UPDATE t SET size = {size} WHERE name = '{name}'")
                state = {k: (size if n == name else s, n) for k, (s, n) in state.items()}
            case 4:
                db.execute(f"DELETE FROM t WHERE size = {size}")
                state = {k: v for k, v in state.items() if v[0] != size}
        if step == 12:
            db = Database(spark, folder)
        if step in (11, 23):
            for op, keep in (("=", lambda a, b: a == b), (">=", lambda a, b: a >= b)):
                got = {(r.id, r.size, r.name) for r in db.index_lookup("by_size", op, 2).collect()}
                assert got == {(k, s, n) for k, (s, n) in state.items() if keep(s, 2)}
            assert {r.id for r in db.sql("SELECT id FROM t WHERE name = 'b:c' AND size < 3").collect()} == {k for k, (s, n) in state.items() if n == "b:c" and s < 3}
            assert sorted((r.size, r.id) for r in db.index_entries("by_size").collect()) == sorted((s, k) for k, (s, _) in state.items())
    db.compact("t")
    assert sorted(tuple(r)[:2] for r in db._table(db.catalog.table("t")).indexes["by_size"].merged().select("size", "id").collect()) == sorted((s, k) for k, (s, _) in state.items())


def test_many_hits_are_scanned(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "FEW", 10)
    db = Database(spark, folder)
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, size INT)")
    db.insert_many("t", spark.range(100).selectExpr("id", "id % 3 as size"))
    db.execute("CREATE INDEX by_size ON t (size)")
    assert db.index_lookup("by_size", "=", 1).count() == 33
    with pytest.raises(QueryError):
        db.index_lookup("by_size", "=", "one")
