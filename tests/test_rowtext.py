from pyspark.sql import functions as F

from millrace.functions import rowtext

KINDS = {"id": "INT", "name": "TEXT", "age": "INT"}


def test_rows_go_there_and_back(spark):
    rows = [(1, "Ann", 30), (-2, "a=b:c", -7), (3, "", None), (4, None, 0)]
    df = spark.createDataFrame(rows, "id long, name string, age long")
    text = df.select("id", rowtext.encode(KINDS).alias("t"))
    assert text.first().t == "age=i:30|id=i:1|name=t:Ann"
    back = text.select(*[rowtext.field(F.col("t"), c, k).alias(c) for c, k in KINDS.items()])
    assert [tuple(r) for r in back.collect()] == rows


def test_fields_that_are_not_there(spark):
    df = spark.createDataFrame([("age=t:x",), ("age=i:x",), ("page=i:3",), ("",), (None,), ("NULL",)], "t string")
    assert [r[0] for r in df.select(rowtext.field(F.col("t"), "age", "INT")).collect()] == [None] * 6


def test_index_rows(spark):
    live = [("t:1", "a"), ("t:2", "b"), ("t:3", "c"), ("t:x", "d"), ("__index__:t:c:Bob:1", ""), ("__index__:t:c:Bob Smith:2", ""), ("__index__:t:c:a:b:3", ""), ("__index__:t:c:a:b:3x", ""), ("__index__:t:c:z:1", ""), ("__index__:t:n:00000000000000000012:1", ""), ("__index__:t:n:-5:2", ""), ("__index__:t:n:bad:3", "")]
    df = spark.createDataFrame(live, "rec_key string, rec_value string")
    ask = lambda *a: {r.rec_key for r in rowtext.index_rows(df, "t", *a).collect()}
    assert ask("c", "TEXT", "=", "a:b") == {"t:3"} and ask("c", "TEXT", ">", "Bob") == {"t:1", "t:2", "t:3"} and ask("c", "TEXT", "=", "Bob") == {"t:1"}
    assert ask("n", "INT", "<", 12) == {"t:2"} and ask("n", "INT", ">=", -5) == {"t:1", "t:2"} and ask("n", "INT", "!=", 0) == {"t:1", "t:2"}
    assert {r.rec_key for r in rowtext.index_rows(df, "t", "c", "TEXT", "!=", "q").collect()} == {"t:1", "t:2", "t:3"}
