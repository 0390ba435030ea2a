import random

import duckdb
import pytest

from millrace.database import Database
from millrace.errors import ParseError, QueryError
from millrace.plans import nodes as n
from millrace.plans.lexer import tokens
from millrace.plans.parser import parse

PEOPLE = [(1, "Ada", 34, "Riga"), (2, "Ben", 19, "Oslo"), (3, "Cleo", 34, "Oslo"), (10, "Dov", 52, "Riga"), (11, "Eve", 19, "Bonn"), (20, "ada", 7, "")]


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    out = Database(spark, f"file://{tmp_path_factory.mktemp('db')}")
    out.attach("people", spark.createDataFrame(PEOPLE, "id long, name string, age long, city string"), "id")
    out.attach("nobody", spark.createDataFrame([], "id long, name string, age long, city string"), "id")
    out.attach("odd", spark.createDataFrame([(1.5, 1), (1.5, 2)], "x double, y int"))
    return out


def ask(db, text):
    return [tuple(r) for r in db.sql(text).collect()]


# -- lexer and parser ---------------------------------------------------------------------------------------


def test_tokens():
    assert [t.value for t in tokens("select a_1,Größe FROM t where x>=10 AND y != 'it is';")] == ["SELECT", "a_1", ",", "Größe", "FROM", "t", "WHERE", "x", ">=", 10, "AND", "y", "!=", "it is", ";", ""]
    assert tokens("'never closed")[0].value == "never closed"
    assert [t.kind for t in tokens("'' ''")] == ["text", "text", "end"]


@pytest.mark.parametrize("bad", ["a <> 1", "-1", "1.5", "a + b", "9223372036854775808", 'a = "x"', "--x", "a ! b"])
def test_characters_the_lexer_rejects(bad):
    with pytest.raises(ParseError):
        parse(f"SELECT * FROM t WHERE {bad}")


def test_and_binds_tighter_than_or_and_both_to_the_left():
    c = lambda x: n.Comparison("=", n.Name(x), n.Literal(1))
    assert parse("SELECT * FROM t WHERE a=1 OR b=1 AND c=1 OR d=1").where == n.Logical("OR", n.Logical("OR", c("a"), n.Logical("AND", c("b"), c("c"))), c("d"))
    assert parse("SELECT * FROM t WHERE (a=1 OR b=1) AND ((c=1))").where == n.Logical("AND", n.Logical("OR", c("a"), c("b")), c("c"))


def test_parsed_statements():
    assert parse("create table t (a int primary key, b TEXT);") == n.CreateTable("t", [n.ColumnDef("a", "INT", True), n.ColumnDef("b", "TEXT")])
    assert parse("CREATE INDEX i ON t (b)") == n.CreateIndex("i", "t", "b")
    assert parse("INSERT INTO t (b, a) VALUES ('x', 1)") == n.Insert("t", [n.Literal("x"), n.Literal(1)], ["b", "a"])
    assert parse("UPDATE t SET a = 1, b = 'y' WHERE c > 2") == n.Update("t", {"a": n.Literal(1), "b": n.Literal("y")}, n.Comparison(">", n.Name("c"), n.Literal(2)))
    assert parse("DELETE FROM t") == n.Delete("t")
    s = parse("SELECT DISTINCT a, COUNT(*), max(b) FROM t GROUP BY a HAVING SUM(c) >= 3 ORDER BY a DESC LIMIT 5")
    assert s.items == [n.Name("a"), n.Aggregate("COUNT"), n.Aggregate("MAX", "b")] and s.distinct and s.group_by == ["a"] and s.order == n.Order("a", True) and s.limit == 5


@pytest.mark.parametrize(
    "bad",
    [
        "", "DROP TABLE t", "SELECT FROM t", "SELECT * t", "SELECT *, * FROM t", "SELECT a, FROM t", "SELECT COUNT(a) FROM t", "SELECT MEDIAN(a) FROM t", "SELECT * FROM t WHERE", "SELECT * FROM t WHERE a =",
        "SELECT * FROM t WHERE (a = 1", "SELECT * FROM t GROUP a", "SELECT * FROM t ORDER BY", "SELECT * FROM t LIMIT x", "SELECT * FROM t LIMIT 1 OFFSET 2", "SELECT * FROM t; SELECT", "SELECT * FROM select",
        "CREATE TABLE t ()", "CREATE TABLE t (a FLOAT)", "CREATE TABLE t (a INT PRIMARY)", "CREATE TABLE t (a INT", "CREATE INDEX i t (a)", "CREATE INDEX i ON t (a, b)", "INSERT INTO t VALUES ()", "INSERT INTO t VALUES (a)", "INSERT t VALUES (1)",
        "INSERT INTO t () VALUES (1)", "UPDATE t WHERE a = 1", "UPDATE t SET a > 1", "DELETE t WHERE a = 1", "SELECT a b FROM t", "SELECT * FROM t, u",
    ],
)
def test_what_is_no_statement(bad):
    with pytest.raises(ParseError):
        parse(bad)


# -- reading ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("where", "ids"),
    [
        ("age = 34", {1, 3}), ("age != 34", {2, 10, 11, 20}), ("age > 34", {10}), ("age >= 34", {1, 3, 10}), ("age < 19", {20}), ("age <= 19", {2, 11, 20}),
        ("name > 'Cleo'", {10, 11, 20}), ("city = ''", {20}), ("name = 'ada'", {20}), ("age = 19 AND city = 'Oslo' OR id = 1", {1, 2}), ("age = 19 AND (city = 'Oslo' OR id = 1)", {2}), ("id = 3", {3}), ("id = 4", set()),
    ],
)
def test_where(db, where, ids):
    assert {r[0] for r in ask(db, f"SELECT id FROM people WHERE {where}")} == ids


def test_projection(db):
    out = db.sql("SELECT *, name, id FROM people WHERE id = 2")
    assert out.columns == ["id", "name", "age", "city", "name", "id"] and tuple(out.first()) == (2, "Ben", 19, "Oslo", "Ben", 2)
    assert [t for t, _ in db.sql("SELECT COUNT(*), min(age) FROM people").dtypes] == ["COUNT(*)", "MIN(age)"]


def test_order_ties_go_by_the_text_of_the_key(db):
    assert [r[0] for r in ask(db, "SELECT id FROM people ORDER BY age")] == [20, 11, 2, 1, 3, 10]
    assert [r[0] for r in ask(db, "SELECT id FROM people ORDER BY age DESC")] == [10, 1, 3, 11, 2, 20]
    assert [r[0] for r in ask(db, "SELECT id FROM people LIMIT 4")] == [1, 10, 11, 2]
    assert ask(db, "SELECT id FROM people LIMIT 0") == [] and len(ask(db, "SELECT id FROM people LIMIT 99")) == 6
    assert ask(db, "SELECT y FROM odd ORDER BY y DESC LIMIT 1") == [(2,)] and ask(db, "SELECT y FROM odd LIMIT 1") == [(1,)]


def test_distinct_keeps_the_first_in_order(db):
    assert [r[0] for r in ask(db, "SELECT DISTINCT city FROM people ORDER BY city DESC")] == ["Riga", "Oslo", "Bonn", ""]
    assert [r[0] for r in ask(db, "SELECT DISTINCT city FROM people ORDER BY age")] == ["", "Bonn", "Oslo", "Riga"]
    assert [r[0] for r in ask(db, "SELECT DISTINCT city FROM people ORDER BY age DESC")] == ["Riga", "Oslo", "Bonn", ""]
    assert [r[0] for r in ask(db, "SELECT DISTINCT city FROM people LIMIT 2")] == ["Riga", "Bonn"]
    assert len(ask(db, "SELECT DISTINCT * FROM people")) == 6 and set(ask(db, "SELECT DISTINCT age, city FROM people WHERE age = 19")) == {(19, "Oslo"), (19, "Bonn")}


def test_global_aggregates(db):
    assert ask(db, "SELECT COUNT(*), SUM(age), AVG(age), MIN(name), MAX(age) FROM people") == [(6, 165, 27, "Ada", 52)]
    for function, rows in (("COUNT(*)", [(0,)]), ("SUM(age)", [(0,)]), ("AVG(age)", [(0,)]), ("MIN(age)", []), ("MAX(name)", [])):
        assert ask(db, f"SELECT {function} FROM nobody") == rows
        assert ask(db, f"SELECT {function} FROM people WHERE id > 99") == rows


def test_average_is_cut_toward_zero(spark, db):
    db.attach("below", spark.createDataFrame([(1, -3), (2, -4)], "id int, v int"), "id")
    assert ask(db, "SELECT AVG(v), SUM(v) FROM below") == [(-3, -7)]


def test_groups(db):
    assert set(ask(db, "SELECT city, COUNT(*), MAX(age) FROM people GROUP BY city")) == {("Riga", 2, 52), ("Oslo", 2, 34), ("Bonn", 1, 19), ("", 1, 7)}
    assert set(ask(db, "SELECT age, city FROM people WHERE age = 19 GROUP BY city, age")) == {(19, "Oslo"), (19, "Bonn")}
    assert set(ask(db, "SELECT city FROM people GROUP BY city HAVING MIN(age) < 30 AND COUNT(*) > 1")) == {("Oslo",)}
    assert set(ask(db, "SELECT city FROM people GROUP BY city HAVING city = 'Bonn' OR MAX(age) > MIN(age)")) == {("Riga",), ("Oslo",), ("Bonn",)}
    assert set(ask(db, "SELECT city FROM people GROUP BY city HAVING 50 <= MAX(age)")) == {("Riga",)}
    assert ask(db, "SELECT city, COUNT(*) FROM people GROUP BY city ORDER BY city DESC LIMIT 2") == [("Riga", 2), ("Oslo", 2)]
    assert sorted(ask(db, "SELECT DISTINCT COUNT(*) FROM people GROUP BY city")) == [(1,), (2,)]
    assert ask(db, "SELECT city, SUM(age) FROM nobody GROUP BY city") == []


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("SELECT * FROM nowhere", "table 'nowhere' does not exist"), ("SELECT x FROM people", "unknown column 'x'"), ("SELECT * FROM nobody WHERE x = 1", "unknown column 'x'"), ("SELECT * FROM people ORDER BY x", "unknown column 'x'"),
        ("SELECT NAME FROM people", "unknown column 'NAME'"), ("SELECT * FROM nobody WHERE age = 'x'", "type mismatch"), ("SELECT * FROM people WHERE id = '1'", "type mismatch"), ("SELECT * FROM people WHERE age = id", "type mismatch"),
        ("SELECT * FROM people WHERE 1 = id", "left side of WHERE must be a column"), ("SELECT * FROM nobody WHERE id", "WHERE expects a comparison"), ("SELECT * FROM people WHERE COUNT(*) = 1", "left side of WHERE must be a column"), ("SELECT * FROM odd WHERE x = 1", "type mismatch"),
        ("SELECT SUM(name) FROM nobody", "SUM only supports INTEGER columns"), ("SELECT city, AVG(name) FROM people GROUP BY city", "AVG only supports INTEGER columns"), ("SELECT name, COUNT(*) FROM people GROUP BY city", "Column 'name' must appear in GROUP BY or be used in an aggregate function"),
        ("SELECT name, COUNT(*) FROM people", "Column 'name' must appear in GROUP BY or be used in an aggregate function"), ("SELECT * FROM people GROUP BY city", "SELECT * cannot be used with GROUP BY or aggregates"), ("SELECT name FROM people HAVING COUNT(*) > 1", "HAVING requires GROUP BY"),
        ("SELECT city FROM people GROUP BY city HAVING COUNT(*) = 'x'", "type mismatch"), ("SELECT city FROM people GROUP BY city HAVING age = 1", "Column 'age' must appear in GROUP BY or be used in an aggregate function"), ("SELECT city FROM people GROUP BY city ORDER BY age", "ORDER BY column 'age' must appear in GROUP BY"),
        ("INSERT INTO people VALUES (1, 'a', 2, 'b')", "table 'people' is attached and can only be read"),
    ],
)
def test_messages(db, text, message):
    with pytest.raises(QueryError) as e:
        db.execute(text)
    assert str(e.value) == message


def test_top_k_needs_no_full_sort_and_filters_reach_the_scan(spark, db, tmp_path):
    spark.createDataFrame(PEOPLE, "id long, name string, age long, city string").write.parquet(f"{tmp_path}/p")
    db.attach_parquet("stored", f"{tmp_path}/p", "id")
    plan = db.sql("SELECT name FROM stored WHERE age > 10 AND city = 'Oslo' ORDER BY age LIMIT 3")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(age,10)" in plan and "EqualTo(city,Oslo)" in plan
    plan = db.sql("SELECT COUNT(*) FROM stored WHERE age > 10")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<age:bigint>" in plan


# -- property: random conditions against DuckDB ------------------------------------------------------------


def random_condition(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        op = rng.choice(["=", "!=", ">", ">=", "<", "<="])
        c = rng.choice(["id", "age", "name", "city"])
        return f"{c} {op} {rng.randrange(40)}" if c in ("id", "age") else f"{c} {op} '{rng.choice(['', 'Ada', 'Oslo', 'a', 'Riga', 'Eve'])}'"
    inner = f" {rng.choice(['AND', 'OR'])} ".join(random_condition(rng, depth - 1) for _ in range(rng.randrange(1, 4)))
    return f"({inner})" if rng.random() < 0.6 else inner


def test_random_conditions(db):
    con = duckdb.connect()
    con.execute("CREATE TABLE people (id BIGINT, name TEXT, age BIGINT, city TEXT)")
    con.executemany("INSERT INTO people VALUES (?, ?, ?, ?)", PEOPLE)
    rng = random.Random(5)
    for _ in range(40):
        where = random_condition(rng, 3)
        assert sorted(ask(db, f"SELECT id FROM people WHERE {where}")) == sorted(con.execute(f"SELECT id FROM people WHERE {where}").fetchall()), where
