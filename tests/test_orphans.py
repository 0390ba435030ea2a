from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import orphans

FEED = "rec_key string, rec_value string, deleted boolean, iter_index long, seq long, arrived_at timestamp_ntz, live int, target_key string, declared string"
SCHEMAS = "index_name string, table_name string, column_name string, live int"
COLUMNS = "table_name string, column_name string, data_type string"


def d(day, hour=12):
    return datetime(2025, 1, day, hour)


def tables(spark, feed, schemas=(("ix", "t", "c", 1),), columns=(("t", "c", "TEXT"),)):
    rows = [(k, "", dead, i, s, at, None, None, None) for k, dead, i, s, at in feed]
    return spark.createDataFrame(rows, FEED), spark.createDataFrame(list(schemas), SCHEMAS), spark.createDataFrame(list(columns), COLUMNS)


def found(spark, *args):
    return {(r.ref_source, r.ref_key) for r in orphans.orphans(*tables(spark, *args)).collect()}


def test_each_reason_and_each_border(spark):
    feed = [
        ("t:ok", False, 1, 1, d(1, 23)), ("__index__:t:c:x:ok", False, 1, 2, d(1, 0)),  # later, but on the same day
        ("__index__:t:c:x:none", False, 1, 3, d(1)),  # missing
        ("t:dead", False, 1, 4, d(1)), ("t:dead", True, 2, 4, d(2)), ("__index__:t:c:x:dead", False, 1, 5, d(1)),  # deleted
        ("__index__:t:c:x2:dead", False, 1, 5, d(3)), ("t:dead", True, 2, 4, d(8)),  # written after the target's interval had ended, which a second delivery of its end doesn't move
        ("t:late", False, 1, 6, d(3)), ("__index__:t:c:x:late", False, 1, 7, d(2)), ("__index__:t:c:x:late", False, 1, 7, d(4)),  # late
        ("t:early", True, 0, 1, d(1)), ("t:early", False, 3, 1, d(9)), ("__index__:t:c:y:early", False, 1, 8, d(5)),  # its first change, a tombstone, was in time
        ("__index__:t:other:x:ok", False, 1, 9, d(1, 23)),  # no such index
        ("__index__:t:c:a:b:c:ok", False, 1, 10, d(1)), ("__index__:t:c::ok", False, 1, 11, d(1)),  # colons and nothing in the value
        ("__index__:t:c:x:gone", True, 1, 12, d(1)),  # not live itself
        ("__index__:t:c", False, 1, 13, d(1)), ("__index__:", False, 1, 14, d(1)),  # malformed
        ("T:ok", False, 1, 15, d(1)), ("__index__:T:c:x:ok", False, 1, 16, d(1)),  # case counts
    ]
    keys = ("__index__:t:c:x:none", "__index__:t:c:x:dead", "__index__:t:c:x2:dead", "__index__:t:c:x:late", "__index__:t:other:x:ok", "__index__:t:c", "__index__:", "__index__:T:c:x:ok")
    assert found(spark, feed) == {("block_records", k) for k in keys}
    changes, schemas, _ = tables(spark, feed)
    why = {r.rec_key: [n for n in ("missing", "deleted", "late", "stillborn", "undeclared") if r[n]] for r in orphans.resolve(changes, schemas).collect()}
    assert why["__index__:t:c:x:dead"] == ["deleted"] and why["__index__:t:c:x2:dead"] == ["deleted", "stillborn"] and why["__index__:t:c:x:late"] == ["late"] and why["__index__:t:other:x:ok"] == ["undeclared"]
    report = {(r.table_name, r.day.day): (r.n_orphans, r.n_missing, r.n_late) for r in orphans.report(changes, schemas).collect()}
    assert report["t", 2] == (1, 0, 1)


def test_schemas_without_catalog_entry(spark):
    schemas = [("a", "t", "c", 1), ("b", "t", "C", 1), ("e", "t ", "c", 1), ("f", None, "c", 1)]
    assert found(spark, [], schemas) == {("index_schemas", x) for x in "bef"}


def test_nulls_and_empty(spark):
    assert found(spark, [], [], []) == set()
    feed = [(None, False, 1, 1, d(1)), ("t:a", None, None, 1, d(1)), ("__index__:t:c:x:a", None, 1, 1, None), ("t:b", False, 1, 2, None), ("__index__:t:c:x:b", False, 1, 3, d(1))]
    assert found(spark, feed) == {("block_records", "__index__:t:c:x:a")}


def test_parsed_parts(spark):
    df = spark.createDataFrame([("__index__:t:col:a:b:7",), ("__index__:t:col::7",), ("__index__:t:col:7",)], "k string")
    f = orphans.parsed(F.col("k"))
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in f.items()]).collect()]
    assert got == [("t", "col", "a:b", "7"), ("t", "col", "", "7"), ("t", "col", None, None)]


def test_a_target_of_a_third_of_all_entries(spark):
    n = 6000
    entries = spark.range(n).select(F.concat(F.lit("__index__:t:c:"), F.col("id").cast("string"), F.lit(":"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))).alias("rec_key"), F.lit("").alias("rec_value"), F.lit(False).alias("deleted"), F.lit(1).cast("long").alias("iter_index"), F.col("id").alias("seq"), F.lit(d(1)).alias("arrived_at"))
    schemas = spark.createDataFrame([("ix", "t", "c")], "index_name string, table_name string, column_name string")
    hot = spark.createDataFrame([("t:hot", "", False, 2, 1, d(1))], entries.schema)
    assert orphans.resolve(entries.unionByName(hot), schemas).filter(orphans.BROKEN).count() == n - n // 3
